import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from sentrel.llm import toxicity as T

BAD = ["grumpfoot", "snarlbag"]


def corpus(n=900):
    rnd = random.Random(4)
    vocab = ["".join(rnd.choice(["ba", "ne", "ri", "to", "lu", "mi", "sa"]) for _ in range(rnd.randrange(2, 5))) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        words = [rnd.choice(vocab) for _ in range(40)]
        toxic = i % 5 == 0
        if toxic:
            words[rnd.randrange(40)] = rnd.choice(BAD)
        docs.append((i, " ".join(words[:20]) + "\n" + " ".join(words[20:])))
        labels.append((i, int(toxic)))
    return docs, labels


def test_held_out_and_disguised(spark):
    docs, labels = corpus()
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, score string")
    s = T.fit(d, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r.doc_id: r for r in T.score(d, s).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got)
    held = [i for i in got if got[i].held_out]
    assert all(got[i].predicted == dict(labels)[i] for i in held)
    strong = lambda t: [w for w, x in s.hits(t).items() if x > 1]
    for t in ("grumpf00t", "grrrrumpfoooot", "ggrumpfoot", "snnarllbag", "g r u m p f o o t", "gr.ump.foot", "gr um pf oo t", "sna rlb ag", "$narlbag", "sn4rlb4g", "SNARLBAG!!"):
        assert strong(f"bane rito {t} lumi"), t
    assert not strong("bane r1to l u m i 2024 10:30 ba ne ri to 4577 sa lu")
    scores = {i: got[i].score for i in held}
    bad, good = [scores[i] for i in held if dict(labels)[i]], [scores[i] for i in held if not dict(labels)[i]]
    assert sum(a > b for a in bad for b in good) > 0.999 * len(bad) * len(good)
    assert len(set(good)) > 0.9 * len(good)  # clean texts are ordered too


def test_odd_rows_and_tables(spark):
    docs, labels = corpus(300)
    rows = [(1, None), (2, ""), (None, "grumpfoot"), (2, ""), (9, "snarlbag " * 30000), (9, "! " * 10)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    s = T.fit(spark.createDataFrame(docs, d.schema), spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = T.score(d, s).collect()
    assert len(got) == 6 and sum(r.predicted for r in got) == 2
    assert len({r.score for r in got if r.doc_id in (1, 2)}) == 1
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {round(r.score, 6) for r in T.score(d, T.fit(d, none)).collect()} == {0.0}
    assert T.score(d.limit(0), T.fit(d.limit(0), none)).collect() == []


def test_language_model_does_not_depend_on_the_layout(spark):
    docs, _ = corpus(200)
    d = spark.createDataFrame([*docs, (900, "Ähre\n\nx"), (901, None), (902, "")], "doc_id long, text string")
    tables = [T.language_model(x) for x in (d.repartition(1), d.repartition(7), d.orderBy("text").coalesce(2))]
    assert (tables[0] == tables[1]).all() and (tables[0] == tables[2]).all()
    count = Counter()
    for _, t in [*docs, (900, "Ähre\n\nx")]:
        c = [0, 0, *(T.CLASS.get(x, 0) for x in t.lower()), 0, 0]
        count.update(zip(c, c[1:], c[2:]))
    uni = np.ones(T.N)
    bi = np.zeros((T.N, T.N))
    for (a, b, c), n in count.items():
        uni[c] += n
        bi[b, c] += n
    bi += 5 * uni / uni.sum()
    bi /= bi.sum(1, keepdims=True)
    for a, b, c in rnd_cells():
        n = sum(v for (x, y, _), v in count.items() if (x, y) == (a, b))
        # texts share the boundaries between them, so only rows that hold a letter are compared
        if a or b:
            assert abs(tables[0][a, b, c] - math.log((count[a, b, c] + 5 * bi[b, c]) / (n + 5))) < 0.02


def rnd_cells():
    rnd = random.Random(8)
    return [(rnd.randrange(20), rnd.randrange(1, 20), rnd.randrange(20)) for _ in range(200)]


def test_decoder_against_all_readings():
    """The Viterbi path is the best of all readings of short strings."""
    rng = np.random.default_rng(2)
    lm = np.log(rng.dirichlet(np.ones(T.N) * 0.2, (T.N, T.N)) + 1e-9)
    decoder, rnd = T.Decoder(lm), random.Random(3)

    def cost(said, channel):
        a = b = 0
        total = channel
        for c in said:
            z = T.CLASS.get(c, 0)
            total += lm[a, b, z]
            a, b = b, z
        return total + lm[a, b, 0]

    for _ in range(150):
        t = "".join(rnd.choice("aabo014$. ") for _ in range(rnd.randrange(1, 7)))
        best = max((("".join(x for x, _ in r), sum(c for _, c in r)) for r in itertools.product(*decoder.readings(t))), key=lambda x: cost(*x))
        assert decoder.restore(t) == " ".join(best[0].split()), t


def test_training_against_brute_force(spark):
    docs, labels = corpus(300)
    docs += [(i + 1000, docs[i][1]) for i in range(0, 60, 3)]  # copies, some of them labelled otherwise
    known = dict(labels) | {i + 1000: 0 for i in range(0, 60, 3)}
    d = spark.createDataFrame([(t, known[i]) for i, t in docs], "text string, toxic int")
    lexicon, slots = T.learn(d)
    lines = {}
    for i, t in docs:
        for line in t.lower().split("\n"):
            lines[line] = min(lines.get(line, 1), known[i])
    n = Counter()
    for line, toxic in lines.items():
        words = {w for w in re.findall(r"[^\W_]+", line) if not w.isdigit()}
        keys = {k for w in words for k in (w, *(f"{w[:m]}~" for m in T.PREFIXES if len(w) >= m))}
        n.update((k, toxic) for k in keys | {zlib.crc32(w.encode()) % T.SLOTS for w in words})
    share = sum(lines.values()) / len(lines)

    def weight(k):
        p = (n[k, 1] + T.SHRINK * share) / (n[k, 0] + n[k, 1] + T.SHRINK)
        return math.log(p / (1 - p)) - math.log(share / (1 - share))

    want = T.prune({k: weight(k) for k in {k for k, _ in n if isinstance(k, str)} if weight(k) >= T.LEANS})
    assert lexicon.keys() == want.keys() and all(abs(lexicon[k] - w) < 1e-9 for k, w in want.items()) and len(want) > 4
    assert all(abs(slots[k] - weight(k)) < 1e-5 for k in {k for k, _ in n if isinstance(k, int)})
    # scores of a table are those of a scorer on each text
    s = T.fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    x = np.array([s.features(t) for _, t in docs])
    by_id = {r.doc_id: r.score for r in T.score(spark.createDataFrame(docs, "doc_id long, text string"), s).collect()}
    for (i, _), f in zip(docs, x):
        assert math.isclose(by_id[i], 1 / (1 + math.exp(-(s.w[0] + f @ s.w[1:]))), abs_tol=1e-9)
