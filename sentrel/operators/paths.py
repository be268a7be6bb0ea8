"""Source-to-sink pairs, sanitizer blocking, dedup and folds along paths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentrel.functions import fixed


def compat_table(spark, table: dict[str, list[str]] | None = None) -> DataFrame:
    rows = [(s, c) for s, cs in (table or fixed.COMPATIBLE).items() for c in cs]
    return spark.createDataFrame(rows, "source_type string, category string").distinct()


def compatible_pairs(sources: DataFrame, sinks: DataFrame, compat: DataFrame, on: Sequence[str] = ()) -> DataFrame:
    """Pairs whose (source_type, category) is listed, and all pairs of an unlisted type.

    Known types meet their categories by equality; only unlisted types pair with every sink. ``on`` adds equality
    keys (say, a file) that both sides share.
    """
    types = compat.select("source_type").distinct()
    listed = sources.join(F.broadcast(compat), "source_type").join(sinks, ["category", *on])
    free = sources.join(F.broadcast(types), "source_type", "left_anti")
    open_pairs = free.join(sinks, list(on)) if on else free.crossJoin(sinks)
    return listed.unionByName(open_pairs)


def file_limited_pairs(sources: DataFrame, sinks: DataFrame, local: Sequence[str], key: str = "file") -> DataFrame:
    """Sinks of ``local`` categories meet sources of their own file by equality; the others meet every source."""
    near = F.col("category").isin(*local)
    s = sources.withColumnRenamed(key, f"source_{key}")
    own = sinks.where(near).join(s, F.col(key) == F.col(f"source_{key}"))
    return own.unionByName(sinks.where(~near).crossJoin(s))


def keep_first(rows: DataFrame, by: Sequence[str], order: Sequence) -> DataFrame:
    """The first row of each combination by an explicit order."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_r = 1").drop("_r")


def file_limited_counts(sources: DataFrame, sinks: DataFrame, local: Sequence[str], source: str, key: str = "file") -> DataFrame:
    """Sinks with n_sources and first_source of file_limited_pairs(), without making the pairs."""
    near = F.col("category").isin(*local)
    sums = [F.count("*").alias("n_sources"), F.min(source).alias("first_source")]
    own = sinks.where(near).join(sources.groupBy(key).agg(*sums), key)
    every = sinks.where(~near).crossJoin(F.broadcast(sources.agg(*sums))).where("n_sources > 0")  # one row
    return own.unionByName(every.select(*own.columns))


def exploitable(blocked: Column, category: Column, sink_on_path: Column, steps: Column) -> Column:
    """Whether a path counts: blocked ones don't, timing and configuration ones do, the rest if the sink is on it."""
    return F.when(blocked, False).when(category.isin("race_condition", "security_misconfig", "toctou"), True).when((steps > 0) & ~sink_on_path, False).otherwise(True)


def fold_steps(steps: DataFrame, key: str, order: str, names: str) -> DataFrame:
    """(key, order, seen): the distinct names up to each step, as an ordered fold over the key's steps."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(names).alias("n"))))
    zero = F.struct(F.array().cast("array<string>").alias("seen"), F.array().cast("array<struct<o:bigint,seen:array<string>>>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        seen = F.array_union(acc["seen"], s["n"])
        return F.struct(seen.alias("seen"), F.concat(acc["out"], F.array(F.struct(s["o"].cast("bigint").alias("o"), seen.alias("seen")))).alias("out"))

    return steps.groupBy(key).agg(ordered.alias("s")).select(key, F.explode(F.aggregate("s", zero, step, lambda a: a["out"])).alias("x")).select(key, F.col("x.o").alias(order), F.col("x.seen").alias("seen"))
