import random

import corpus_pipeline
import numpy as np
from sentrel.llm import near_dedup as N


def grams(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def groups(rows):
    """The group of each row, by all pairs."""
    sets, root = [grams(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(rows))]


def brute(rows):
    """The component's least id per row."""
    least, group = {}, groups(rows)
    for g, (d, _) in zip(group, rows):
        least[g] = min((x for x in (least.get(g), d) if x is not None), default=None)
    return sorted(((d, least[g]) for g, (d, _) in zip(group, rows)), key=str)


def kept(rows):
    """One row of each group: the least doc_id, null last."""
    group, out = groups(rows), []
    for g in set(group):
        mine = [r for r, k in zip(rows, group) if k == g]
        least = min((d is None, d or 0) for d, _ in mine)
        out.append((least, {t for d, t in mine if (d is None, d or 0) == least}))
    return sorted(out, key=lambda x: (x[0], sorted(map(str, x[1]))))


def corpus():
    rnd = random.Random(6)
    words = ["Alpha", "beta", "Gamma", "delta", "É", "zeta"]
    rows = [(900, None), (901, ""), (902, " \t "), (903, "one"), (904, "one two"), (905, "ONE  two")]
    base = [[rnd.choice(words) + str(rnd.randrange(90)) for _ in range(250)] for _ in range(12)]
    for i in range(120):  # up to 7 edits of 250 words: similarity 0.75 to 1
        w = list(base[i % 12])
        for _ in range(i // 12 % 8):
            w[rnd.randrange(len(w))] = f"edit{i}"
        rows.append((500 - i, " ".join(w)))
    return rows


def odd(rows):
    """With rows that have no id, several texts of one id, and repeated rows."""
    text = rows[10][1]
    return [*rows, (None, text), (None, "unrelated, without an id"), (None, "and another one"), (1, text), (5, text), (5, "unrelated text of a repeated id"), rows[40], rows[40], (2000, "twice"), (2000, "twice")]


def test_against_brute_force(spark):
    rows = odd(corpus())
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, key int, node string")
    for long in (N.LONG, 2):  # 2: lists of three and more are split
        assert sorted(((r.doc_id, r.component_id) for r in N.near_duplicates(df, long=long).collect()), key=str) == brute(rows)


def test_stage_keeps_one_row_of_each_group(spark):
    rows = odd(corpus())
    df = spark.createDataFrame([(d, t, "n", 0) for d, t in rows], "doc_id long, text string, near_id string, near_copies int")
    got = corpus_pipeline.keep_one(spark, df, "")
    assert got.columns == df.columns
    out = [((r.doc_id is None, r.doc_id or 0), r.text) for r in got.collect()]
    want = kept(rows)
    assert len(out) == len(want)
    for least, texts in want:  # the row is one of those of the least id
        match = next(k for k, (d, t) in enumerate(out) if d == least and t in texts)
        out.pop(match)
    assert not out


def test_rows_that_lost_each_other_by_id(spark):
    rows = [(1, "base " * 9), (5, "base " * 9), (5, "unrelated text"), (None, "base " * 9), (None, "unrelated, without an id")]
    got = N.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted([rows[0], rows[2], rows[4]], key=str)
    same = spark.createDataFrame([(3, "a b"), (3, "a b"), (None, None), (None, "")], "doc_id long, text string")
    assert sorted((r.doc_id is None, r.text) for r in N.keep_one(same).select("doc_id", "text").na.fill("").collect()) == [(False, "a b"), (True, "")]


def test_a_large_group_of_one_template(spark):
    """Many texts around one template, few of them alike in pairs: long lists, one component, no pair lost."""
    rnd = random.Random(2)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(260):
        w = list(base)
        for k in rnd.sample(range(120), rnd.randrange(1, 5)):
            w[k] = f"e{i}x{k}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for long in (N.LONG, 64):
        assert sorted((r.doc_id, r.component_id) for r in N.near_duplicates(df, long=long).collect()) == sorted(brute(rows))


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert N.near_duplicates(df).collect() == [] and N.keep_one(df).collect() == []


def test_fingerprint_is_a_weighted_vote():
    """Each bit against sums over all shingles, and the agreement of pairs at the threshold against what the index counts on."""
    rnd = np.random.default_rng(3)
    h = rnd.integers(0, 1 << 63, 37, dtype=np.uint64)
    want = bytearray()
    for p in range(N.POSITIONS):
        votes, (a, b) = [0.0] * 8, (int(N._MIX[0][p]), int(N._MIX[1][p]))
        for v in h.tolist():
            x = (v ^ a) * b % (1 << 64)
            x = (x ^ x >> 32) * a % (1 << 64)
            weight = (((x >> 11) + 1) / (1 << 53)) ** -4
            votes = [s + (weight if x >> 7 - k & 1 else -weight) for k, s in enumerate(votes)]
        want.append(sum((s > 0) << 7 - k for k, s in enumerate(votes)))
    assert N.signature(h)[0] == bytes(want)
    assert N.signature(h[:0])[0] == bytes(N.POSITIONS)
    for n in (10, 40, 400):
        same = []
        for _ in range(40):
            h = rnd.integers(0, 1 << 63, n, dtype=np.uint64)
            x, y = (np.frombuffer(N.signature(s)[0], np.uint8) for s in (h[n // 10 :], h[: n - n // 10]))
            same.append((x == y).mean())
        assert np.mean(same) >= N.KEPT * 0.8 - 0.02
