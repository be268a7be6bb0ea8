"""Line deduplication by a deletion-neighbourhood join.

A line is its lower-cased words. A line goes if an earlier one, by (document, line number), has the same words, or
is one word edit away (one word inserted, deleted or replaced) and the longer of the two has at least five
words, so the two agree in four fifths or more. Earlier lines count whether or not they go themselves. Lines
without words always stay. Documents are ordered by doc_id (null last), those of one doc_id by a hash of their text.

All steps are DataFrame expressions, and none makes pairs within a group:

1. Equal lines meet by a 128-bit hash; the least position wins by a pre-aggregated minimum.
2. A pair one edit apart shares its first or its last (m - 1) div 2 words, m being the longer length. Lines that share
   such a half with no other line have no partner and emit no variants.
3. The others emit all their variants with one word deleted, as hashed keys, over the half where the edit can be. A
   key is the XOR of hashes of (word, place), built from running XORs, so a line of n words costs n, not n squared.
   Lines that become equal by deleting the same place are one replacement apart; a variant that equals a whole
   line is one deletion or insertion apart. So a key's least position, per place and for whole lines, is all that is needed.
4. The earliest partner of each kind of edit is verified word by word.

Defined cases: a null text is an empty one; rows that are equal in doc_id and text are one document, whose lines don't
remove each other; a document may lose all lines; empty tables give empty results; other columns are ignored or kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrel.llm.common import fresh, materialize, pick, release

#: The least words that the longer line needs for one word edit to count.
LEAST = 5
#: Line numbers, and texts of one doc_id, that positions have room for.
LINES, VERSIONS = 1 << 31, 1 << 24


def _normal(line: Column) -> Column:
    """The lower-cased words, parted by single spaces."""
    low = F.lower(line)
    return F.trim(F.when(F.contains(low, F.lit("  ")), F.regexp_replace(low, " +", " ")).otherwise(low))


def _whole(x: int) -> Column:
    return F.lit(str(x)).cast(f"decimal({len(str(x))},0)")


def _document(doc_id: Column, text: Column) -> Column:
    """A document's place: doc_id, then 24 bits of the text's MD5; without a doc_id 60 bits of it, behind all others."""
    digits = lambda n: F.conv(F.substring(F.md5(text), 1, n), 16, 10).cast("decimal(19,0)")
    known = (doc_id.cast("decimal(20,0)") + _whole(1 << 63)).cast("decimal(20,0)") * _whole(VERSIONS) + digits(6)
    return F.coalesce(known.cast("decimal(29,0)"), (_whole(VERSIONS << 64) + digits(15)).cast("decimal(29,0)"))


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, doc, pos, words): every line with its words; doc orders documents."""
    src = pick(docs, "doc_id", "text").select("doc_id", _text().alias("text"))
    # the place comes first: beside the explode it would be computed for every line
    src = src.select("doc_id", _document(F.col("doc_id"), F.col("text")).alias("doc"), "text")
    src = src.select("doc_id", "doc", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return src.select("doc_id", "doc", "pos", _normal(F.col("line")).alias("words"))


def _hashes(words: Column) -> tuple[Column, Column]:
    return F.xxhash64(words), F.xxhash64(F.lit(1), words)


def _hashed(lines: DataFrame) -> DataFrame:
    """Lines by position (ord), 128-bit hash (h1, h2) and the hashes of their halves; no text."""
    words = F.col("words")
    lines = lines.withColumn("n", F.when(words == "", 0).otherwise(F.octet_length(words) - F.octet_length(F.replace(words, F.lit(" "), F.lit(""))) + 1))
    half = lambda side, k, sign="": F.xxhash64(F.lit(side), F.expr(f"substring_index(words, ' ', {sign}CAST({k} AS INT))"))
    a, b = "greatest(n - 1, 0) div 2", "n div 2"
    h1, h2 = _hashes(words)
    place = (F.col("doc") * _whole(LINES) + F.col("pos").cast("decimal(10,0)")).cast("decimal(38,0)")
    return lines.select("doc_id", place.alias("ord"), "n", h1.alias("h1"), h2.alias("h2"), half("front", a).alias("fa"), half("front", b).alias("fb"), half("back", a, "-").alias("ba"), half("back", b, "-").alias("bb"))


def _place(ord_: Column) -> tuple[Column, Column]:
    """The document and the line number of a position."""
    pos = F.pmod(ord_, _whole(LINES))
    return ((ord_ - pos) / _whole(LINES)).cast("decimal(29,0)"), pos.cast("int")


def _candidates(distinct: DataFrame) -> DataFrame:
    """(h1, front, back): lines that share their first or last half with another line."""
    even = F.col("n") % 2 == 0
    # the low bit of a key tells the side, so that a row of the shuffle is two numbers
    front, back = (lambda c: F.col(c).bitwiseAND(F.lit(-2))), (lambda c: F.col(c).bitwiseOR(F.lit(1)))
    halves = F.when(even, F.array(front("fa"), front("fb"), back("ba"), back("bb"))).otherwise(F.array(front("fa"), back("ba")))
    keyed = distinct.where(F.col("n") >= LEAST - 1).select("h1", F.explode(halves).alias("key"))
    shared = keyed.groupBy("key").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo <> hi").select("key")
    side = F.col("key").bitwiseAND(F.lit(1))
    return keyed.join(shared, "key", "left_semi").groupBy("h1").agg(F.max(side == 0).alias("front"), F.max(side == 1).alias("back"))


def _variants(cand: DataFrame) -> DataFrame:
    """(key, place, ord): hashed one-word deletions of candidate lines by deleted place, whole lines at place 0.

    key also holds the number of words left. Running XORs over a line's words give every variant in one pass.
    """
    word = cand.select("ord", "n", "front", "back", F.posexplode("w").alias("i", "x")).withColumn("i", F.col("i") + 1)
    word = word.select("ord", "n", "front", "back", "i", F.xxhash64("x", "i").alias("here"), F.xxhash64("x", F.col("i") - 1).alias("moved"))
    run = "OVER (PARTITION BY ord ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    word = word.select("*", F.expr(f"bit_xor(here) {run}").alias("upto"), F.expr(f"bit_xor(moved) {run}").alias("mupto"), F.expr("bit_xor(moved) OVER (PARTITION BY ord)").alias("mall"))
    h = F.floor((F.col("n") - 1) / 2)
    # an edit of a pair that shares its first half lies behind it, and so on
    reach = (F.col("front") & (F.col("i") > h)) | (F.col("back") & (F.col("i") <= F.col("n") - h))
    # shorter lines have valid partners by their whole only; their deletions would hide those behind pairs that are too short
    reach = (F.col("n") >= LEAST) & reach
    key = F.col("upto").bitwiseXOR(F.col("here")).bitwiseXOR(F.col("mall")).bitwiseXOR(F.col("mupto"))
    out = F.array(
        F.when(reach, F.struct(F.xxhash64(key, F.col("n") - 1).alias("key"), F.col("i").alias("place"))),
        F.when(F.col("i") == F.col("n"), F.struct(F.xxhash64("upto", "n").alias("key"), F.lit(0).alias("place"))))
    return word.select("ord", F.explode(out).alias("v")).where("v IS NOT NULL").select("v.key", "v.place", "ord")


def _partners(variants: DataFrame) -> DataFrame:
    """(ord, partner): per line and kind of edit the earliest line that shares a key in a way that means one edit."""
    same = variants.groupBy("key", "place").agg(F.min("ord").alias("least"), F.max("ord").alias("most"))
    both = same.groupBy("key").agg(F.min(F.when(F.col("place") == 0, F.col("least"))).alias("whole"), F.min(F.when(F.col("place") > 0, F.col("least"))).alias("cut"), F.max((F.col("place") > 0) & (F.col("least") < F.col("most"))).alias("again"))
    live = both.where(F.col("again") | (F.col("whole").isNotNull() & F.col("cut").isNotNull()))
    # per key and place: what a member there has lost (partner: whole), gained (cut) or replaced (least)
    at = F.col("place") > 0
    first = same.join(live, "key").select("key", "place", F.when(~at, F.col("cut")).alias("gained"), F.when(at, F.col("whole")).alias("lost"), F.when(at, F.col("least")).alias("replaced"))
    met = variants.join(first, ["key", "place"])
    kinds = [F.min(F.when(F.col(k) < F.col("ord"), F.col(k))).alias(k) for k in ("gained", "lost", "replaced")]
    best = met.groupBy("ord").agg(*kinds)
    return best.select("ord", F.explode(F.array_distinct(F.array("gained", "lost", "replaced"))).alias("partner")).where("partner IS NOT NULL")


def _verified(pairs: DataFrame, cand: DataFrame) -> DataFrame:
    """(h1, h2) of lines with a partner at most one word edit apart, word by word."""
    a = cand.select("ord", "h1", "h2", F.col("w").alias("x"))
    b = cand.select(F.col("ord").alias("partner"), F.col("w").alias("y"))
    p = pairs.join(a, "ord").join(b, "partner")
    x, y, n, m = F.col("x"), F.col("y"), F.size("x"), F.size("y")
    d = F.array_position(F.zip_with(x, y, lambda s, t: s.eqNullSafe(t)), F.lit(False)).cast("int")  # first difference; past the shorter one: an absent word
    tail = lambda c, k: F.slice(c, k, F.size(c) + 1)
    near = F.when(d == 0, F.lit(True)).when(n == m, tail(x, d + 1) == tail(y, d + 1)).when(n == m + 1, tail(x, d + 1) == tail(y, d)).when(m == n + 1, tail(x, d) == tail(y, d + 1)).otherwise(False)
    return p.where(near & (F.greatest(n, m) >= LEAST)).groupBy("h1", "h2").agg(F.lit(True).alias("near"))


def _candidate_lines(docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """(ord, h1, h2, front, back, n, w): the first of each candidate line, its words read again from the texts."""
    wanted = _candidates(distinct).join(distinct.select("h1", "h2", "ord"), "h1")
    doc, pos = _place(F.col("ord"))
    wanted = wanted.select(doc.alias("doc"), F.struct(pos.alias("pos"), "h1", "h2", "front", "back", "ord").alias("c"))
    wanted = wanted.groupBy("doc").agg(F.collect_list("c").alias("cs"))  # a document's own lines
    texts = pick(docs, "doc_id", "text").where("text IS NOT NULL").select(_document(F.col("doc_id"), F.col("text")).alias("doc"), "text")
    held = texts.join(wanted, "doc").select("cs", F.split("text", "\n", -1).alias("lines"))
    found = held.select(F.explode(F.transform("cs", lambda c: F.struct(c.alias("c"), F.get("lines", c["pos"]).alias("line")))).alias("x")).select("x.c.*", _normal(F.coalesce("x.line", F.lit(""))).alias("words"))
    h1, h2 = _hashes(F.col("words"))
    # a row per copy of the document; texts that share the document's hash bits are told apart by the line's own
    found = found.where((h1 == F.col("h1")) & (h2 == F.col("h2"))).dropDuplicates(["ord", "h1"])
    w = F.split("words", " ", -1)
    return found.select("ord", "h1", "h2", "front", "back", F.size(w).alias("n"), w.alias("w"))


def judge_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, doc, pos, n, kind) of every line: kind is keep, exact or near."""
    lines = materialize(_hashed(lines_of(docs)), "lines")
    full = lines.where("n > 0")
    distinct = materialize(full.groupBy("h1", "h2").agg(F.min("ord").alias("ord"), F.max("ord").alias("last"), *(F.first(c).alias(c) for c in ("n", "fa", "fb", "ba", "bb"))), "distinct-lines")
    cand = materialize(_candidate_lines(docs, distinct), "candidate-lines")
    variants = materialize(_variants(cand), "variants")
    near = _verified(_partners(variants), cand)
    # only lines that repeat or have a partner are looked up, from a table of their own, so that a join on a hot line can be split
    verdict = distinct.join(near, ["h1", "h2"], "left").where("ord < last OR near").select("h1", "h2", F.col("ord").alias("first"), "near")
    verdict = materialize(verdict, "line-verdicts")
    release(distinct, cand, variants)
    kind = F.when(F.col("first") < F.col("ord"), "exact").when(F.col("near"), "near").otherwise("keep")
    doc, pos = _place(F.col("ord"))
    judged = full.select("doc_id", "ord", "n", "h1", "h2").join(verdict, ["h1", "h2"], "left")
    out = judged.select("doc_id", "ord", "n", kind.alias("kind")).unionByName(lines.where("n = 0").select("doc_id", "ord", "n", F.lit("keep").alias("kind")))
    return out.select("doc_id", doc.alias("doc"), pos.alias("pos"), "n", "kind")


def dropped_lines(docs: DataFrame) -> DataFrame:
    """(doc, gone): per document that loses lines, their sorted numbers."""
    return judge_lines(docs).where("kind <> 'keep'").groupBy("doc").agg(F.array_sort(F.collect_set("pos")).alias("gone"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """The documents without the lines that go; a document that had words and loses every one of them goes too."""
    doc, lost = fresh(docs, "doc", "lost")
    gone = dropped_lines(docs).select(F.col("doc").alias(doc), F.col("gone").alias(lost))
    rows = docs.withColumn(doc, _document(F.col("doc_id"), _text())).join(gone, doc, "left")
    lines = F.split("text", "\n", -1)
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), lost), lambda i: F.get(lines, i))
    rows = rows.withColumn("text", F.when(F.col(lost).isNull(), F.col("text")).otherwise(F.array_join(left, "\n")))
    rows = rows.where(F.col(lost).isNull() | (F.trim("text") != ""))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col(lost).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return rows.select(*(F.col(f"`{c}`") for c in docs.columns))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct document's lines judged: their number, how many go and which."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    size = F.length(_text()) - F.length(F.replace(_text(), F.lit("\n"), F.lit(""))) + 1
    every = docs.select("doc_id", _document(F.col("doc_id"), _text()).alias("doc"), size.cast("long").alias("n_lines")).groupBy("doc").agg(F.first("doc_id").alias("doc_id"), F.first("n_lines").alias("n_lines"))
    of = lambda *kinds: F.collect_set(F.when(F.col("kind").isin(*kinds), F.col("pos")))
    text = F.array_join(F.transform(F.array_sort(of("exact", "near")), lambda p: p.cast("string")), ",")
    gone = judge_lines(docs).where("kind <> 'keep'").groupBy("doc").agg(F.size(of("exact")).cast("long").alias("n_exact"), F.size(of("near")).cast("long").alias("n_near"), text.alias("gone"))
    none = {"n_exact": F.lit(0), "n_near": F.lit(0), "gone": F.lit("")}
    return every.join(gone, "doc", "left").select("doc_id", "n_lines", *(F.coalesce(c, z).alias(c) for c, z in none.items()))


ORACLE = f"""
WITH t AS (
  SELECT DISTINCT doc_id, coalesce(text, '') AS text,
         CASE WHEN doc_id IS NULL THEN {VERSIONS << 64}::HUGEINT + ('0x' || substr(md5(coalesce(text, '')), 1, 15))::BIGINT
              ELSE (doc_id::HUGEINT + {1 << 63}) * {VERSIONS} + ('0x' || substr(md5(coalesce(text, '')), 1, 6))::BIGINT END AS doc FROM documents),
l AS (
  SELECT doc_id, doc, pos, list_filter(string_split(lower(line), ' '), lambda x: x <> '') AS w
  FROM (SELECT doc_id, doc, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM t)),
o AS (SELECT doc_id, doc, pos, w, len(w) AS n, doc * {LINES} + pos AS ord FROM l),
d AS (SELECT w, n, min(ord) AS ord FROM o WHERE n > 0 GROUP BY w, n),
v AS (
  SELECT w, n, ord, i, array_to_string(list_concat(w[:i - 1], w[i + 1:]), ' ') AS k FROM d, range(1, 100000) r(i) WHERE i <= n AND n >= {LEAST - 1}),
s AS (SELECT k, i, n, min(ord) AS least FROM v GROUP BY ALL),
f AS (SELECT array_to_string(w, ' ') AS k, n, ord FROM d),
near AS (
  SELECT v.ord FROM v JOIN s USING (k, i, n) WHERE n >= {LEAST} AND least < v.ord
  UNION SELECT v.ord FROM v JOIN f ON v.k = f.k AND f.n = v.n - 1 WHERE v.n >= {LEAST} AND f.ord < v.ord
  UNION SELECT f.ord FROM f JOIN v ON v.k = f.k AND f.n = v.n - 1 WHERE v.n >= {LEAST} AND v.ord < f.ord),
j AS (
  SELECT o.doc_id, o.doc, o.pos, CASE WHEN o.n = 0 THEN 'keep' WHEN d.ord < o.ord THEN 'exact' WHEN near.ord IS NOT NULL THEN 'near' ELSE 'keep' END AS kind
  FROM o LEFT JOIN d USING (w) LEFT JOIN near ON near.ord = d.ord)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (kind = 'exact') AS n_exact, count(*) FILTER (kind = 'near') AS n_near,
       coalesce(string_agg(pos::VARCHAR, ',' ORDER BY pos) FILTER (kind <> 'keep'), '') AS gone
FROM j GROUP BY doc"""

QUERIES = {"op2_line_dedup": op2_line_dedup}
ORACLES = {"op2_line_dedup": ORACLE}
