"""Benchmark decontamination: a broadcast hash set of normalised test n-grams against training windows.

A window is ten consecutive words of a benchmark item. Instead of hashing every ten-word window of the
corpus, a document probes the set with the five-word grams that start at every sixth word: each
ten-word window holds exactly one of them in full, so no occurrence is missed and none is found twice.
A probe that hits is verified word by word in its context (up to five words before, ten after), which
gives the windows that really occur. Items of fewer words are one window, probed at every word.

The probe and its context never leave the scan's stage; only verified hits are shuffled. The set is broadcast
while its summed bytes stay under ``BROADCAST_BYTES`` and joined by shuffle beyond.

Defined cases: null and wordless texts have no words and are clean; a null item has no window; rows are told
apart by (doc_id, text), so equal rows get equal results; empty tables give empty or clean results;
other columns are ignored whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrel.llm.common import ascii_lower, pick, small_enough

WINDOW = 10
GRAM = 5
STRIDE = WINDOW - GRAM + 1
#: What separates words once A-Z count as letters too; words keep their case until they are compared.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words in their own case; an empty array for null."""
    return F.coalesce(F.array_remove(F.split(text, GAP, -1), ""), F.array().cast("array<string>"))


def _joined(words: Column, start: Column, length: Column | int) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def _grams(benchmark: DataFrame) -> DataFrame:
    """(key, item_id, before, words, at): five-word grams of the long items with the item's words around."""
    items = pick(benchmark, "item_id", "text").select("item_id", words_of(ascii_lower(F.col("text"))).alias("w"))
    at = F.explode(F.sequence(F.lit(1), F.size("w") - GRAM + 1)).alias("i")
    return items.where(F.size("w") >= WINDOW).select("item_id", "w", at).select(
        "item_id", F.xxhash64(F.lower(_joined(F.col("w"), F.col("i"), GRAM))).alias("key"),
        F.slice("w", F.greatest(F.col("i") - (STRIDE - 1), F.lit(1)), F.least(F.col("i") - 1, F.lit(STRIDE - 1)) + WINDOW).alias("iw"),
        F.least(F.col("i") - 1, F.lit(STRIDE - 1)).alias("ib"))


def _probes(docs: DataFrame) -> DataFrame:
    """One row per probed gram with its context, and one (key null) that stands for the document."""
    w = F.col("w")
    n = F.size(w)

    def probe(j: Column) -> Column:
        before = F.least(j - 1, F.lit(STRIDE - 1))
        return F.struct(
            j.alias("j"), before.alias("db"), F.xxhash64(F.lower(_joined(w, j, GRAM))).alias("key"),
            _joined(w, j - before, before + WINDOW).alias("ctx"))

    starts = F.when(n >= WINDOW, F.sequence(F.lit(1), n - GRAM + 1, F.lit(STRIDE))).otherwise(F.array().cast("array<int>"))
    alone = F.array(F.struct(F.lit(0).alias("j"), F.lit(0).alias("db"), F.lit(None).cast("long").alias("key"), F.lit(None).cast("string").alias("ctx")))
    return docs.select("doc_id", "tag", n.cast("long").alias("n_words"), F.explode(F.concat(alone, F.transform(starts, probe))).alias("p")).select("doc_id", "tag", "n_words", "p.*")


def _hits(probes: DataFrame, grams: DataFrame) -> DataFrame:
    """Verified windows: a row per probe and gram with the window starts that match, document rows kept."""
    met = probes.join(grams, "key", "left").where(F.col("item_id").isNotNull() | (F.col("j") == 0))
    d, i = F.split(ascii_lower(F.col("ctx")), " ", -1), F.col("iw")
    back = F.least("db", "ib")

    def equal(o: Column) -> Column:  # o words before the gram
        left, right = F.slice(d, F.col("db") + 1 - o, WINDOW), F.slice(i, F.col("ib") + 1 - o, WINDOW)
        return (F.size(left) == WINDOW) & (left == right)

    starts = F.transform(F.filter(F.sequence(F.lit(0), back), equal), lambda o: F.col("j") - o)
    none = F.array().cast("array<int>")
    return met.select("doc_id", "tag", "n_words", "j", "item_id", F.lit(WINDOW).alias("len"), F.when(F.col("j") > 0, starts).otherwise(none).alias("starts"))


def _short_hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The same rows for items of one to nine words, by their first word and then their whole sequence; None without any."""
    items = pick(benchmark, "item_id", "text").select("item_id", words_of(ascii_lower(F.col("text"))).alias("iw")).where(F.size("iw").between(1, WINDOW - 1))
    items = items.select("item_id", F.size("iw").alias("len"), F.get("iw", F.lit(0)).alias("word"), F.array_join("iw", " ").alias("whole"))
    if items.isEmpty():
        return None
    at = F.posexplode(F.transform("w", ascii_lower)).alias("j", "word")
    rows = docs.select("doc_id", "tag", "w", F.size("w").cast("long").alias("n_words"), at).withColumn("j", F.col("j") + 1)
    rows = rows.join(F.broadcast(items) if small_enough(items) else items, "word")
    rows = rows.where(ascii_lower(_joined(F.col("w"), F.col("j"), F.col("len"))) == F.col("whole"))
    return rows.select("doc_id", "tag", "n_words", "j", "item_id", "len", F.array("j").alias("starts"))


def window_hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, tag, n_words, j, item_id, len, starts): verified windows, and a row j = 0 for every document."""
    base = pick(docs, "doc_id", "text").select("doc_id", F.xxhash64("text").alias("tag"), words_of(F.col("text")).alias("w"))
    grams = _grams(benchmark)
    if small_enough(grams):
        grams = F.broadcast(grams)
    hits = _hits(_probes(base), grams)
    short = _short_hits(base, benchmark)
    return hits if short is None else hits.unionByName(short)


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per (doc_id, text): n_words, how many rows it has (``copies``), hit word positions (sorted, from 1) and ``items``."""
    rows = window_hits(docs, benchmark)
    at = F.explode_outer(F.flatten(F.transform("starts", lambda s: F.sequence(s, s + F.col("len") - 1)))).alias("p")
    seen = rows.where((F.col("j") == 0) | (F.size("starts") > 0))
    words = seen.select("doc_id", "tag", "n_words", F.when(F.size("starts") > 0, F.col("item_id")).alias("item_id"), "j", at)
    return words.groupBy("doc_id", "tag").agg(F.max("n_words").alias("n_words"), F.sum((F.col("j") == 0).cast("int")).alias("copies"), F.array_sort(F.collect_set("p")).alias("hit"), F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))  # rows that repeat come back
    return out.select(
        "doc_id", "n_words", F.size("hit").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hit") > 0).alias("contaminated"))


ORACLE = """
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
  FROM b, range(1, 100000) r(i) WHERE len(w) > 0 AND i <= greatest(len(w) - 9, 1)),
sizes AS (SELECT DISTINCT m FROM win),
pos AS (
  SELECT rid, m, i, array_to_string(w[i:i + m - 1], ' ') AS g
  FROM (SELECT rid, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, sizes WHERE len(w) >= m)),
hit AS (SELECT rid, i, win.m, item_id FROM pos JOIN win USING (m, g)),
cov AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + m)) AS p FROM hit) GROUP BY rid),
its AS (
  SELECT rid, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s
  FROM (SELECT DISTINCT rid, item_id FROM hit) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (rid) LEFT JOIN its USING (rid)"""

QUERIES = {"op3_decontaminate": op3_decontaminate}
ORACLES = {"op3_decontaminate": ORACLE}
