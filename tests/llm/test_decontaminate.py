import random
import re

from sentrel.llm import decontaminate as D
from sentrel.llm.common import small_enough


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items):
    out = []
    for d, t in docs:
        w, hit, who = words(t), set(), set()
        for i, x in items:
            v = words(x)
            n = min(10, len(v))
            for k in range(len(v) - n + 1 if n else 0):
                for s in range(len(w) - n + 1):
                    if w[s : s + n] == v[k : k + n]:
                        hit |= set(range(s + 1, s + n + 1))
                        who.add(str(i))
        out.append((d, len(w), sorted(hit), sorted(who)))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rnd = random.Random(8)
    vocab = ["alpha", "Beta", "É", "é", "9", "nine", "übel", "x"]
    line = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    items = [(k, line(n)) for k, n in enumerate((1, 3, 9, 10, 11, 30, 45))] + [(20, None), (21, " ... "), (22, "zzz")]
    docs = [(1, None), (2, ""), (3, "zzz"), (4, "a zzz, b")]
    for i in range(60):
        x = items[rnd.randrange(3, 7)][1].split()
        s = rnd.randrange(len(x))
        docs.append((10 + i, ";  ".join([line(rnd.randrange(12)), " - ".join(x[s:]).upper() if i % 3 else " ".join(x[s:]), line(rnd.randrange(12))])))
    docs.append((None, items[6][1] + " " + items[6][1]))
    d = spark.createDataFrame([(i, t, 1, "k") for i, t in docs], "doc_id long, text string, tag int, key string")
    b = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    got = sorted(((r.doc_id, r.n_words, r.hit, r["items"]) for r in D.decontaminate(d, b).collect()), key=str)
    assert got == brute(docs, items)
    assert any(len(g[2]) > 30 for g in got)


def test_bytes_are_measured(spark):
    """A side of few long rows is not small."""
    df = spark.createDataFrame([("x" * 1000, ["y" * 500] * 2, 1)], "a string, b array<string>, c long")
    assert small_enough(df, 2200) and not small_enough(df, 2000) and small_enough(df.limit(0), 0)


def test_repeated_rows_and_empty_tables(spark):
    d = spark.createDataFrame([(1, "zzz")] * 3, "doc_id long, text string")
    b = spark.createDataFrame([(1, "zzz")], "item_id long, text string")
    assert [r.copies for r in D.decontaminate(d, b).collect()] == [3]
    assert [r.hit for r in D.decontaminate(d, b.limit(0)).collect()] == [[]]
    assert D.decontaminate(d.limit(0), b).collect() == []
