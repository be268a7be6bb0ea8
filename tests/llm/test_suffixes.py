import hashlib
import random

import numpy as np
import pytest

from sentrel.llm import suffixes as S


def brute(rows):
    first = {}
    raw = [(S.LAST if d is None else d, d, (t or "").encode()) for d, t in rows]
    for k, _, b in raw:
        for i in range(len(b) - 49):
            first[b[i : i + 50]] = min(first.get(b[i : i + 50], k), k)
    out = []
    for k, d, b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < k:
                gone[i : i + 50] = True
        spans = sum(1 for i in range(len(b)) if gone[i] and (not i or not gone[i - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus():
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(1, 9)))
    passages = [" ".join(word() for _ in range(40)) for _ in range(6)] + ["a" * 300, "ab" * 120, "zyxwvutsrqponmlkjihgfedcba" * 6, "\x00" * 60 + "x"]
    rows = []
    for i in range(160):
        parts = [rnd.choice(passages)[rnd.randrange(30) :][: rnd.randrange(20, 400)] if rnd.random() < 0.5 else " ".join(word() for _ in range(rnd.randrange(25))) for _ in range(rnd.randrange(5))]
        rows.append((i * 37 % 500, " ".join(parts)))
    return rows + [rows[3], rows[4], (9999, rows[5][1]), (None, rows[6][1]), (None, rows[7][1]), (5000, None), (5001, ""), (-7, rows[9][1]), (5002, "a" * 49), (5003, "a" * 50)]


@pytest.mark.parametrize("block, hot", [(1 << 11, S.HOT), (S.BLOCK, S.HOT), (1 << 12, 0), (S.BLOCK, 5)])
def test_against_brute_force(spark, block, hot):
    """With all anchors hot, with some, and with none; in small blocks and in one."""
    rows = corpus()
    df = spark.createDataFrame([(d, t, 1, b"x") for d, t in rows], "doc_id long, text string, block int, blob binary")
    out = S.dedup_substrings(df, with_text=True, block=block, hot=hot).collect()
    assert sorted((tuple(r)[:5] for r in out), key=str) == brute(rows)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in out)


def test_texts_longer_than_a_chunk(spark):
    rnd = np.random.default_rng(3)
    noise = lambda n: bytes(rnd.integers(97, 123, n, dtype=np.uint8)).decode()
    shared, edge = noise(S.CHUNK // 2), noise(200)
    first = noise(S.CHUNK - 100) + edge + shared + noise(1000)  # the passage lies across the end of a chunk
    second = shared + noise(S.CHUNK) + edge
    df = spark.createDataFrame([(1, first), (2, second), (3, edge)], "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in S.dedup_substrings(df).collect()}
    assert got == {1: (len(first), 0, 0), 2: (len(second), len(shared) + len(edge), 2), 3: (200, 200, 1)}


def test_two_stage_is_a_suffix_order():
    rnd = random.Random(5)
    texts = ["".join(rnd.choice("aab") for _ in range(rnd.randrange(51, 90))) for _ in range(60)]
    width = max(map(len, texts)) + S.LENGTH + 1
    m = np.zeros((len(texts), width), np.uint8)
    for i, t in enumerate(texts):
        m[i, : len(t)] = np.frombuffer(t.encode(), np.uint8)
    seeds = np.array([len(t) for t in texts])
    rank = S.two_stage(m, seeds, np.zeros(len(texts), bool))
    at = sorted(((i, j) for i, t in enumerate(texts) for j in range(len(t))), key=lambda p: rank[p])
    cut = [texts[i][j : j + S.LENGTH] for i, j in at]
    assert cut == sorted(cut)


def test_common_prefixes():
    rows = sorted("".join(random.Random(k).choice("ab") * n for n in range(1, 20))[: S.LENGTH].ljust(S.LENGTH, "c") for k in range(40))
    words = np.frombuffer("".join(r.ljust(56, "\0") for r in rows).encode(), np.uint64).reshape(-1, 7)
    want = [0] + [next((k for k in range(S.LENGTH) if a[k] != b[k]), S.LENGTH) for a, b in zip(rows, rows[1:])]
    assert S.common_prefixes(words).tolist() == want


def test_empty(spark):
    assert S.dedup_substrings(spark.createDataFrame([], "doc_id long, text string")).collect() == []
