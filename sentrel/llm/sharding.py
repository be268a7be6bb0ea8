"""Sharding by rendezvous (highest random weight) hashing.

Each (key, shard) pair gets a uniform draw u from md5(key:shard); a record goes to the shard with the
least -ln(u) / weight, so a shard's share follows its weight and a further shard only takes records
into itself. Everything is a DataFrame expression; texts are read once and never shuffled: a record of a few
numbers per row is written and numbered.

Defined cases: a null key hashes as the text ``null``; a null text has zero bytes; rows that repeat a key
go to the same shard and get slots of their own, however many there are; an empty table gives an empty result; other columns are
ignored whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sentrel.llm.common import materialize, pick

N_SHARDS = 16
#: Slot numbers are dealt per (shard, lane), so no task ever numbers a whole shard.
LANES = 1024
#: Rows beyond which a key is dealt over further lanes.
HOT = 100_000


def _key(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("null"))


def _draw(key: Column, shard: int) -> Column:
    """Uniform in (0, 1): 52 bits of md5(key:shard)."""
    digits = F.substring(F.md5(F.concat(key, F.lit(f":{shard}"))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def _costs(key: Column, weights: Sequence[float]) -> Column:
    """Per shard of some weight: (cost, shard), where cost is -ln(u) / weight."""
    return F.array(*(F.struct((-F.log(_draw(key, k)) / F.lit(float(w))).alias("c"), F.lit(k).alias("k")) for k, w in enumerate(weights) if w > 0))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard of a key: least -ln(u) / weight over shards 0..n-1, the lower shard on a tie."""
    return F.array_min(_costs(key, weights))["k"]


def _placed(rows: DataFrame, weights: Sequence[float]) -> DataFrame:
    """Rows with shard and grown_shard; each draw is taken once."""
    present = sum(w > 0 for w in weights)
    rows = rows.withColumn("costs", _costs(F.col("key"), [*weights, weights[-1]]))
    return rows.withColumns({"shard": F.array_min(F.slice("costs", 1, present))["k"], "grown_shard": F.array_min("costs")["k"]}).drop("costs")


def shard_records(docs: DataFrame, weights: Sequence[float], lanes: int = LANES, hot: int = HOT) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row.

    ``weights`` are those of the present shards; ``grown_shard`` is where the row goes once a further shard
    with the last weight joins. Slots count 0.. within each shard without gaps: by lane, then key. The rows of a key that
    has more than ``hot`` are dealt over lanes of their own, so that no task numbers them all.
    """
    text = F.coalesce("text", F.lit(""))
    rows = pick(docs, "doc_id", "text").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), _key(F.col("doc_id")).alias("key"), F.monotonically_increasing_id().alias("n"))
    rows = _placed(rows, weights).withColumn("lane", (F.conv(F.substring(F.md5("key"), 1, 8), 16, 10).cast("long") % lanes).cast("int"))
    rows = materialize(rows, "placed")  # numbers and records only; it is read by the counts and the numbering
    often = rows.groupBy("key").agg(F.count("*").alias("often")).where(F.col("often") > hot).select("key", F.lit(1).alias("often"))
    rows = rows.join(materialize(often, "hot-keys"), "key", "left")
    rows = rows.withColumn("part", F.when(F.col("often") == 1, F.pmod(F.xxhash64("n"), F.lit(lanes)).cast("int")).otherwise(0))
    # at most shards x lanes x parts rows, whatever the input; parts only where a key is hot
    counts = rows.groupBy("shard", "lane", "part").agg(F.count("*").alias("count"))
    before = Window.partitionBy("shard").orderBy("lane", "part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "lane", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("shard", "lane", "part").orderBy(F.col("doc_id").asc_nulls_first(), "size", "text_crc32", "n")
    numbered = rows.withColumn("at", F.row_number().over(within) - 1)
    return numbered.join(offsets, ["shard", "lane", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("base") + F.col("at")).cast("long").alias("slot"), F.col("grown_shard").cast("int").alias("grown_shard")
    )


def write_shards(docs: DataFrame, path: str, weights: Sequence[float]) -> None:
    """Write the rows, one folder per shard; every file holds a part of the rows that one task had."""
    docs.withColumn("shard", rendezvous(_key(F.col("doc_id")), weights)).write.partitionBy("shard").parquet(path)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents over 16 equal shards."""
    return shard_records(spark.read.parquet(f"{sf_dir}/documents.parquet"), [1.0] * N_SHARDS)


def oracle(shards: int = N_SHARDS, lanes: int = LANES) -> str:
    """DuckDB SQL; the CRC is folded byte by byte over a table that the query builds."""
    return f"""
WITH tab AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
hexes AS (SELECT list_transform(range(256), lambda i: printf('%02X', i)) AS hx),
docs AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, coalesce(strlen(text), 0) + 1 AS size,
         coalesce(CAST(doc_id AS VARCHAR), 'null') AS k FROM documents),
crc AS (
  SELECT rid, xor(list_reduce(list_concat([4294967295], list_transform(regexp_extract_all(hex(encode(text)), '..'),
           lambda h: ('0x' || h)::BIGINT)),
           lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) AS text_crc32
  FROM docs, tab),
draws AS (
  SELECT rid, s, -ln((('0x' || substr(md5(k || ':' || s), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) AS c
  FROM docs, range({shards + 1}) r(s)),
best AS (
  SELECT rid, arg_min(s, c) FILTER (s < {shards}) AS shard, arg_min(s, c) AS grown_shard FROM draws GROUP BY rid)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard::INTEGER AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY ('0x' || substr(md5(k), 1, 8))::BIGINT % {lanes}, doc_id NULLS FIRST, size, text_crc32) - 1 AS slot,
       grown_shard::INTEGER AS grown_shard
FROM docs JOIN crc USING (rid) JOIN best USING (rid)"""


QUERIES = {"op5_sharding": op5_sharding}
ORACLES = {"op5_sharding": oracle()}
