import itertools
import random

import numpy as np
import xxhash
from pyspark.sql import Row

from sentrel.llm import simhash


def brute(rows):
    def fp(t):
        w = (t or "").encode().lower().split()
        if not w:
            return 0
        s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))

    fps = [fp(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        least[r] = min((x for x in (least.get(r), d) if x is not None), default=None)
    return sorted(((d, f"{fps[i]:016x}", least[find(i)]) for i, (d, _) in enumerate(rows)), key=str)


def corpus():
    rnd = random.Random(3)
    words = ["Alpha", "beta", "Gamma", "delta", "É", "epsilon", "zeta"]
    rows = [(100, None), (7, ""), (8, " \t "), (9, "one"), (10, "one two")]
    base = [" ".join(rnd.choice(words) + str(rnd.randrange(60)) for _ in range(300)) for _ in range(8)]
    for i in range(60):
        w = base[i % 8].split()
        for _ in range(rnd.randrange(3)):
            w[rnd.randrange(len(w))] = "edit" + str(i)
        rows.append((200 - i, "  ".join(w)))
    # no ids, repeated ids, repeated rows
    return [*rows, (None, base[0]), (None, "alone without an id"), (None, None), (150, base[3]), (150, "another text of this id"), rows[20], rows[20]]


def test_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([Row(doc_id=d, text=t, key=1, fp="clash", a=2) for d, t in rows], "doc_id long, text string, key int, fp string, a int")
    for long in (simhash.LONG, 3):  # 3: lists of four and more are split, over and over
        got = sorted((tuple(r) for r in simhash.near_duplicates(df, long=long).collect()), key=str)
        assert got == brute(rows)
    assert len({r[2] for r in got}) < len(rows) - 20


def test_index_misses_no_pair():
    """Whatever three bits differ, a first list holds both, and every split of a shared list keeps them together."""
    rnd = random.Random(1)
    for _ in range(400):
        differ = sum(1 << b for b in rnd.sample(range(64), 3))
        shared = [m for m in simhash.FIRST if not m & differ]
        assert shared
        for _ in range(8):
            shared = [n for m in shared for n in simhash.split(m) if not n & differ]
            assert shared
            shared = shared[:3]
    # splitting ends: ten free bits leave no list longer than LONG
    mask, steps = simhash.FIRST[0], 0
    while 64 - bin(mask).count("1") > simhash.FREE:
        mask, steps = min(simhash.split(mask), key=lambda m: bin(m).count("1")), steps + 1
    assert steps < 12


def test_tally_and_forest():
    rnd = np.random.default_rng(1)
    v = np.unique(rnd.integers(0, 1 << 20, 900, dtype=np.uint64) << np.uint64(40))
    v = np.unique(np.r_[v, v[:300] ^ np.uint64(1 << 41), v[:200] ^ np.uint64(3 << 45)])
    key = np.sort(rnd.integers(0, 5, len(v)))
    want = {(i, j) for i, j in itertools.combinations(range(len(v)), 2) if key[i] == key[j] and bin(int(v[i] ^ v[j])).count("1") <= 3}
    i, j = simhash.pairs(key, v)
    assert set(zip(i.tolist(), j.tolist())) == want and len(want) > 100
    label = simhash.forest(len(v), i, j)
    assert all(label[a] == label[b] for a, b in want) and all(label[k] <= k for k in range(len(v)))


def test_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
