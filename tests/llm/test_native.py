"""Line dedup, sharding and URL filter: odd rows, ties and empty tables."""

import hashlib
import math
import random
import zlib
from collections import Counter

from sentrel.llm import line_dedup as L
from sentrel.llm import sharding as S
from sentrel.llm import url_templates as U


def kinds(df):
    return {(r.doc_id, r.doc, r.pos): r.kind for r in L.judge_lines(df).collect()}


def test_lines(spark):
    rows = [
        (1, "one two three four five\nkeep me\n\nkeep me"),
        (2, "ONE two  three four five\none two three four six\none two three four"),
        (3, "one two three four five six\nfour words in here\nfour words in there"),
        (4, None), (5, ""), (None, "keep me\nlast of all"), (6, "x one two three four five six"),
        (7, "a b c d e f\na b c x d e f"), (7, "a b c d e f\nanother version")]
    df = spark.createDataFrame([(d, t, 0, "h") for d, t in rows], "doc_id long, text string, pos int, h1 string")
    got = kinds(df)
    by = lambda d: sorted((p, k) for (i, _, p), k in got.items() if i == d)
    assert by(1) == [(0, "keep"), (1, "keep"), (2, "keep"), (3, "exact")]
    assert by(2) == [(0, "exact"), (1, "near"), (2, "near")]
    assert by(3) == [(0, "near"), (1, "keep"), (2, "keep")]  # four words are too few for an edit
    assert by(6) == [(0, "near")]
    assert sorted(k for _, k in by(7)) == ["exact", "keep", "keep", "near"]  # one version is before the other, by its hash
    assert by(None) == [(0, "exact"), (1, "keep")]
    kept = {(r.doc_id, r.text) for r in L.dedup_lines(df).collect()}
    assert (1, "one two three four five\nkeep me\n") in kept and (4, None) in kept and (5, "") in kept
    assert not any(d in (2, 6) for d, _ in kept) and (3, "four words in here\nfour words in there") in kept
    assert L.judge_lines(df.limit(0)).collect() == [] and L.dedup_lines(df.limit(0)).collect() == []


def one_edit(a, b):
    """At most one word edit apart, the longer one of five words at least."""
    if abs(len(a) - len(b)) > 1 or max(len(a), len(b)) < L.LEAST:
        return a == b
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_lines(rows):
    """Gone line numbers per distinct (doc_id, text)."""
    digest = lambda t: hashlib.md5(t.encode()).hexdigest()
    docs = sorted({(d, t or "") for d, t in rows}, key=lambda r: (r[0] is None, r[0] or 0, digest(r[1])[:15] if r[0] is None else digest(r[1])[:6]))
    seen, out = [], {}
    for d, t in docs:
        out[d, t] = []
        for k, line in enumerate(t.split("\n")):
            w = [x for x in line.lower().split(" ") if x]
            if w and any(one_edit(w, s) for s in seen):
                out[d, t].append(k)
            if w:
                seen.append(w)
    return out


def test_lines_against_brute_force(spark):
    """Lines of three to six words of a small alphabet, with null and repeated ids, several texts of an id, repeated rows."""
    rnd = random.Random(5)
    rows = []
    for i in range(150):
        rows.append((rnd.choice([None, i % 40, i]), "\n".join(" ".join(rnd.choice("abF") for _ in range(rnd.randrange(3, 7))) for _ in range(rnd.randrange(4)))))
    rows += [rows[3], rows[3], (None, "a b c d e\na b c d e"), (None, "a b c d e\na b c d e"), (None, None), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_lines(rows)
    left = Counter()
    for d, t in rows:
        lines, gone = (t or "").split("\n"), want[d, t or ""]
        text = "\n".join(x for k, x in enumerate(lines) if k not in gone) if gone else t
        if not gone or text.strip():
            left[d, text] += 1
    assert Counter((r.doc_id, r.text) for r in L.dedup_lines(df).collect()) == left
    assert sum(map(len, want.values())) > 100


def test_a_partner_that_is_ruled_out_hides_none(spark):
    rows = [(1, "a b c d"), (2, "a b c d e"), (3, "a b c e"), (4, "q r s t u"), (5, "q r s t"), (6, "q r s u")]
    got = {r.doc_id: r.kind for r in L.judge_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "keep", 2: "near", 3: "near", 4: "keep", 5: "near", 6: "near"}


def test_a_short_partner_hides_no_valid_one(spark):
    rows = [(1, "Are, is anwh reenen."), (2, "As are is anwh reenen."), (3, "Are is anwh reenen."), (4, "Are is anwh reenen. too")]
    got = {r.doc_id: r.kind for r in L.judge_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "keep", 2: "keep", 3: "near", 4: "near"}  # 1 and 3 differ in a word of four; 3 is 2 without a word


def test_a_long_line_costs_no_square(spark):
    w = [f"w{i}" for i in range(20000)]
    rows = [(1, " ".join(w)), (2, " ".join([*w[:9000], "new", *w[9000:]])), (3, " ".join([*w[:5], "x", *w[6:100], "y", *w[101:]]))]
    got = {r.doc_id: r.kind for r in L.judge_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "keep", 2: "near", 3: "keep"}


def test_shards(spark):
    rnd = random.Random(1)
    rows = [(i, "x" * rnd.randrange(50)) for i in range(3000)] + [(None, None), (5, "again"), (7, "né")]
    df = spark.createDataFrame([(d, t, 3, 9) for d, t in rows], "doc_id long, text string, shard int, k int")
    got = S.shard_records(df, [1.0] * 16).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.grown_shard in (r.shard, 16)
    for s in range(16):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots))) and 130 < len(slots) < 250

    def brute(d, weights):
        u = lambda k: (int(hashlib.md5(f"{'null' if d is None else d}:{k}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        return min((-math.log(u(k)) / w, k) for k, w in enumerate(weights))[1]

    assert all(r.shard == brute(r.doc_id, [1.0] * 16) for r in got[:200])
    assert {r.text_crc32 for r in got if r.doc_id == 7} >= {zlib.crc32("né".encode())}
    assert [(r.size, r.text_crc32) for r in got if r.doc_id is None] == [(1, 0)]
    heavy = S.shard_records(df, [1.0, 3.0]).collect()
    assert 0.7 < sum(r.shard == 1 for r in heavy) / len(heavy) < 0.8
    assert S.shard_records(df.limit(0), [1.0, 1.0]).collect() == []


def test_urls(spark):
    urls = [None, "no scheme", "http://", "HTTP://A.Example.ORG/en/1x?q#f", "http://example.org", "http://xexample.org/es/1", "http://a.com/de/1", "http://a.com/fr/2", "ftp://a.com/en/3#x://y", "http://a.com?x=/de/", "http://É.org/"]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.judge_urls(df).collect()}
    assert got[0] == got[1] == ("", "", None, "allow") and got[2][:3] == ("", "", None)
    assert got[3] == ("a.example.org", "/en/1x", "example.org/en/1", "block")
    assert got[4] == ("example.org", "", None, "allow")
    assert got[5][2] == "org/" and got[6][2:] == ("com/de/", "block") and got[7][2:] == ("com/fr/", "allow")
    assert got[8] == ("a.com", "/en/3", None, "allow") and got[9][:3] == ("a.com", "", None) and got[10][0] == "É.org"
    assert U.judge_urls(df.limit(0)).collect() == []


def test_shards_of_a_hot_key(spark):
    rows = [(None, "x" * (i % 7)) for i in range(900)] + [(5, "y")] * 300 + [(i, "z") for i in range(100, 400)]
    got = S.shard_records(spark.createDataFrame(rows, "doc_id long, text string"), [1.0] * 4, lanes=8, hot=100).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((d, len(t) + 1) for d, t in rows)
    for s in range(4):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    assert len({r.shard for r in got if r.doc_id is None}) == len({r.shard for r in got if r.doc_id == 5}) == 1


def test_write_shards(spark, tmp_path):
    df = spark.createDataFrame([(i, "t") for i in range(50)], "doc_id long, text string")
    S.write_shards(df, f"{tmp_path}/out", [1.0, 1.0, 2.0])
    back = {r.doc_id: r.shard for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert back == {r.doc_id: r.shard for r in S.shard_records(df, [1.0, 1.0, 2.0]).collect()}


def tree(spark, rows):
    return {(r.host, r["shape"]): (r.template, round(r.purity, 6)) for r in U.templates(spark.createDataFrame(rows, "host string, shape string, bad long")).collect()}


def test_templates_reject_by_purity(spark):
    rows = [("h", "/spam/#", 1)] * 30 + [("h", "/good/#", 0)] * 30 + [("h", "/good/#", None)] * 5 + [("h", "/spam/#", None)] * 5
    rows += [("h", f"/rare{chr(97 + k)}", None) for k in range(8)] + [("g", "/x", None)] * 9
    t = tree(spark, rows)
    assert t["h", "/spam/#"][1] < 0.1 and t["h", "/good/#"][1] > 0.9
    assert t["h", "/raree"] == t["h", "/rarea"] and t["h", "/rarea"][0] == "/*"
    # an unlabelled branch follows the one above it, a host without labels all hosts
    assert t["h", "/rarea"][1] == 0.5 and t["g", "/x"] == ("/*", 0.5)
    bad = tree(spark, [("h", "/spam/#", 1)] * 30 + [("h", "/good/#", 0)] * 6 + [("h", f"/r{k}", None) for k in "abc"] + [("g", "/x", None)] * 2)
    assert bad["h", "/ra"][1] < 0.2 and bad["g", "/x"][1] < 0.2


def test_similar_branches_merge(spark):
    """Branches of like purity are one; unlabelled ones join the branch that goes on as they do."""
    rows = [("h", f"/{s}/list", 1) for s in "abc" for _ in range(20)] + [("h", f"/{s}/item/#", 0) for s in "de" for _ in range(20)]
    rows += [("h", "/f/list", None)] * 9 + [("h", "/g/item/#", None)] * 9 + [("h", "/k/other", None)] * 9
    t = tree(spark, rows)
    assert t["h", "/a/list"] == t["h", "/b/list"] == t["h", "/c/list"] == t["h", "/f/list"] and t["h", "/a/list"][0] == "/a|"
    assert t["h", "/d/item/#"] == t["h", "/e/item/#"] == t["h", "/g/item/#"] and t["h", "/d/item/#"][1] > 0.9 > 0.1 > t["h", "/a/list"][1]
    assert t["h", "/k/other"][0] == "/*"


def test_templates_go_as_deep_as_labels_differ(spark):
    deep = "/a" * 9
    rows = [("h", f"{deep}/x/#", 1)] * 20 + [("h", f"{deep}/y/#", 0)] * 20 + [("h", deep, 0)] * 6
    t = tree(spark, rows)
    assert t["h", f"{deep}/x/#"] == (f"{deep}/x", t["h", f"{deep}/x/#"][1]) and t["h", f"{deep}/x/#"][1] < 0.1 < 0.9 < t["h", f"{deep}/y/#"][1]


def test_long_urls_and_repeated_rows(spark):
    long = "http://a.com/de/" + "x/" * 50_000 + "9" * 50_000
    rows = [(1, long), (1, long), (2, "http://a.com/" + "y" * 200_000), (None, None), (None, "http://a.com/fr/1")] + [(3, "http://a.com/fr/1")] * 7
    got = U.judge_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()
    assert Counter((r.page_id, r.verdict) for r in got if r.page_id != 2) == {(1, "block"): 2, (None, "allow"): 2, (3, "allow"): 7}
    assert next(len(r.path) for r in got if r.page_id == 2) == 200_001
