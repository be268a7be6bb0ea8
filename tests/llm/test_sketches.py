import hashlib
import random

import numpy as np
import xxhash

from sentrel.llm import sketches as S


def brute_sketch(text):
    """(digest, set of the leading 32 bits of the kept hashes), in plain Python."""
    w = text.encode().lower().split()
    if not w:
        return 0, set()
    grams = {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    limit = 2**64 // S.SCALE
    return xxhash.xxh64_intdigest(b" ".join(w), 42), {h * 2**32 // limit for h in (xxhash.xxh64_intdigest(g, 42) for g in grams) if h < limit}


def shown(s):
    return f"{s[0]:016x}" + "".join(f"{h:08x}" for h in sorted(s[1]))


def alike(a, b):
    return 1.0 if a[0] == b[0] else len(a[1] & b[1]) / len(a[1] | b[1]) if a[1] | b[1] else 0.0


def held(a, b):
    return 1.0 if a[0] == b[0] else len(a[1] & b[1]) / len(a[1]) if a[1] else 0.0


def brute(rows):
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    out = []
    for i, (d, t) in enumerate(rows):
        nxt = rows[(i + 1) % len(rows)][1]
        m = len(t) // 4
        e = t[: len(t) - m] + nxt[:m]
        s, f, n = brute_sketch(t), brute_sketch(e), brute_sketch(nxt)
        out.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), shown(s), shown(f), alike(s, f), alike(s, n), held(s, f)))
    return sorted(map(str, out))


def corpus():
    rnd = random.Random(5)
    rows = [(i, " ".join(rnd.choice(["näive", "b", "cc", "ddd"]) + str(rnd.randrange(30)) for _ in range(rnd.randrange(90)))) for i in rnd.sample(range(1000), 150)]
    return rows + [(1009, None), (None, "no id at all"), (1003, ""), (1014, "x" * 50), (1020, " ".join(f"w{k}" for k in range(30_000)))]


def test_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(d, t, 0, "x") for d, t in rows], "doc_id long, text string, sid int, guest string")
    assert sorted(str(tuple(r)) for r in S.compare_with_next(df).collect()) == brute(rows)


def test_rows_of_one_id(spark):
    """Most rows without an id: their range is cut by the hash of the text, and every row still has its next one."""
    rows = [(None, f"text {k} of a row without an id and some more words {k}") for k in range(200)] + [(None, "equal")] * 20 + [(k, f"t {k}") for k in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert len({b for b in S._bounds(df.selectExpr(f"coalesce(doc_id, {S.FLOOR}) AS sid"), 4)}) == 3
    got = S.compare_with_next(df).collect()
    assert sorted((str(r.doc_id), r.fingerprint) for r in got) == sorted((str(d), shown(brute_sketch(t))) for d, t in rows)
    assert sum(r.near_next == 1.0 for r in got) == 19  # the equal rows but the last one follow each other


def test_lone_and_empty(spark):
    one = S.compare_with_next(spark.createDataFrame([(1, "a b c d e f g h")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert S.compare_with_next(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_every_range_has_a_partition(spark):
    for ranges, n in ((7, 7), (12, 12), (20, 7), (1, 4)):
        to = S._spread(spark, ranges, n)
        at = [r.p for r in spark.createDataFrame([(k,) for k in to], "k int").selectExpr(f"pmod(hash(k), {n}) AS p").collect()]
        assert len(at) == ranges and max(map(at.count, at)) <= -(-ranges // n)


def test_estimates_and_merging():
    words = [f"w{i}" for i in range(30000)]
    whole, part = S.sketch(" ".join(words)), S.sketch(" ".join(words[5000:6500]))
    assert S.containment(part, whole) == 1.0
    assert abs(S.likeness(whole, part) - 0.05) < 0.02
    left, right = S.sketch(" ".join(words[:15004])), S.sketch(" ".join(words[15000:]))
    assert (S.merge(left, right)[1] == whole[1]).all() and S.merge(left, right)[0] == S.merge(right, left)[0]
    again = S.from_text(S.to_text(part))
    assert again[0] == part[0] and (again[1] == part[1]).all()
    nothing = (0, np.zeros(0, np.uint32))
    assert S.likeness(nothing, nothing) == 1.0 and S.likeness(nothing, whole) == 0.0
    short = [s for s in map(S.sketch, ("a b", "c d", "e f", "g h")) if not len(s[1])]
    assert len(short) > 1 and S.likeness(short[0], short[1]) == 0.0  # empty sketches of unlike texts
