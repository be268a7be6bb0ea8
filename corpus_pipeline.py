"""A training-corpus pipeline: quality, line dedup, near-dedup, decontamination, tokens.

Each stage is (name, function); a function takes (spark, docs, sf_dir), works on all that the stage before kept and
returns the columns of documents, but for the last, which returns piece ids. A stage's result is written as
Parquet and read again as the next one's docs.

Defined cases: stages decide by row, not by doc_id, so that rows without an id, or several texts of one id, don't go for
each other; of rows that are equal in doc_id and text one is left; null texts are empty ones; an empty table gives an empty
result; without labels no document goes for its quality (its score is 0.5); other columns pass through as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrel.llm import decontaminate, line_dedup, near_dedup, pieces, quality
from sentrel.llm.common import fresh, materialize, release


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier accepts."""
    return quality.keep_good(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier one has or nearly has; those that lose every line go."""
    return line_dedup.dedup_lines(docs)


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, by verified five-word similarity, the row of the least doc_id."""
    return near_dedup.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window."""
    hits = decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where(F.size("hit") > 0)
    ident, tag = fresh(docs, "gone_id", "gone_tag")
    gone = hits.select(F.col("doc_id").alias(ident), F.col("tag").alias(tag))
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col(ident)) & (F.xxhash64("text") == F.col(tag)), "left_anti")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_chars, n_ids, round_trip, ids) of every document that is left."""
    return pieces.encode_documents(docs)


STAGES = [("quality", keep_quality), ("line_dedup", drop_lines), ("near_dedup", keep_one), ("decontaminate", drop_leaks), ("pieces", encode)]

#: The classifier's fit, min-wise hashes and the tokenizer are beyond SQL; tests/llm/test_pipeline.py holds brute force against run().
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
