"""Evaluation, votes, anomaly tests and summaries."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentrel.functions.expressions import hypotheses, severity_rank


def confusion(rows: DataFrame, truth: Column, predicted: Column, sets: Sequence[Sequence[str]], columns: Sequence[str]) -> DataFrame:
    """Confusion counts and ratios (4 digits, 0 for an empty denominator) at several grains in one pass."""
    t, p = truth.cast("boolean"), predicted.cast("boolean")
    flags = rows.withColumns({"_tp": (t & p).cast("int"), "_fp": (~t & p).cast("int"), "_fn": (t & ~p).cast("int"), "_tn": (~t & ~p).cast("int")})
    sums = [F.sum(f"_{k}").alias(k) for k in ("tp", "fp", "fn", "tn")]
    out = flags.groupingSets([[F.col(c) for c in s] for s in sets], *columns).agg(*sums, F.grouping_id().alias("grain"))
    ratio = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 4)
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    return out.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn), "accuracy": ratio(tp + tn, tp + fp + fn + tn)})


def anomalies(baseline: DataFrame, current: DataFrame, key: str, sigmas: float = 3.0) -> DataFrame:
    """Ratios below mean - sigmas * stdev of their key's baseline; one baseline value counts half its mean as stdev.

    baseline: (key, ratio); current: (key, ratio). A null ratio is not suspicious.
    """
    stats = baseline.groupBy(key).agg(F.avg("ratio").alias("mean"), F.coalesce(F.stddev_samp("ratio"), F.avg("ratio") * 0.5).alias("spread"))
    rows = current.join(stats, key, "left")
    limit = F.col("mean") - sigmas * F.col("spread")
    return rows.withColumn("limit", F.round(limit, 6)).withColumn("suspicious", F.coalesce(F.col("ratio") < limit, F.lit(False)))


def vote(rows: DataFrame, key: str, run: str, value: str, least: float) -> DataFrame:
    """Share of runs that agree with the first one, and whether it reaches ``least``; the majority value beside it."""
    first = rows.groupBy(key).agg(F.min_by(value, run).alias("first_value"))
    counts = rows.groupBy(key, value).agg(F.count("*").alias("n"))
    best = counts.groupBy(key).agg(F.sum("n").alias("runs"), F.max_by(F.struct(value, "n"), F.struct(F.col("n"), F.col(value))).alias("top"))
    agree = counts.join(first, key).where(F.col(value).eqNullSafe(F.col("first_value"))).select(key, "first_value", F.col("n").alias("agreeing"))
    return best.join(agree, key).select(key, "first_value", F.round(F.col("agreeing") / F.col("runs"), 4).alias("agreement"), (F.col("agreeing") / F.col("runs") >= least).alias("stable"), F.col(f"top.{value}").alias("majority"), (F.col("top.n") / F.col("runs") >= 2 / 3).alias("by_two_thirds"))


def verdict_of(raw: Column) -> Column:
    """Raw verdicts to the engine's own."""
    low = F.lower(F.coalesce(raw, F.lit("")))
    return F.when(low == "exploitable", "VERIFIED_EXPLOITABLE").when(low == "blocked", "BLOCKED").otherwise("UNCERTAIN")


def confidence_of(raw: Column, confidence: Column) -> Column:
    """The stated confidence; 0.5 where an answer states none, 0.3 where there is no answer."""
    return F.when(F.trim(F.coalesce(raw, F.lit(""))) == "", F.lit(0.3)).otherwise(F.coalesce(confidence, F.lit(0.5)))


def serious(findings: DataFrame, least: float = 0.6) -> DataFrame:
    """CRITICAL and HIGH findings from a confidence up."""
    return findings.where(F.col("severity").isin("CRITICAL", "HIGH") & (F.col("confidence") >= least))


def report_order(findings: DataFrame, ident: str) -> DataFrame:
    """By severity, then by confidence from high to low, then by id."""
    return findings.orderBy(severity_rank(F.col("severity")), F.desc("confidence"), ident)


def tree_hash(rows: DataFrame, by: str, path: str, digest: str) -> DataFrame:
    """(by, tree): SHA-256 over a group's sorted lines path:digest.

    SHA-256 is sequential, so a group's lines meet in one task; they come sorted from the shuffle and are hashed as
    they pass, so the task holds one Arrow batch, not the group.
    """
    lines = rows.select(F.col(by).cast("string").alias("g"), F.concat_ws(":", path, digest).alias("line"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, h, first = None, None, True
        for b in batches:
            for g, line in zip(b.column("g").to_pylist(), b.column("line").to_pylist()):
                if first or g != now:
                    if not first:
                        yield pa.RecordBatch.from_pydict({by: [now], "tree": [h.hexdigest()]})
                    now, h, first = g, hashlib.sha256(line.encode()), False
                else:
                    h.update(b"\n" + line.encode())
        if not first:
            yield pa.RecordBatch.from_pydict({by: [now], "tree": [h.hexdigest()]})

    return lines.repartition("g").sortWithinPartitions("g", "line").mapInArrow(run, f"{by} string, tree string")


def verdict_summary(results: DataFrame) -> DataFrame:
    """Verdicts by analysis source; one column per verdict."""
    return results.groupBy("analysis_source").pivot("verdict", ["VERIFIED_EXPLOITABLE", "BLOCKED", "UNCERTAIN"]).count().na.fill(0)


def path_summary(paths: DataFrame) -> DataFrame:
    place = lambda side: F.concat_ws("|", f"{side}_file", f"{side}_line")
    return paths.agg(F.count("*").alias("paths"), F.count_if("blocked").alias("blocked"), F.count_if(~F.col("blocked") & F.col("exploitable")).alias("exploitable"), F.countDistinct(place("source")).alias("sources"), F.countDistinct(place("sink")).alias("sinks"))


def calibrated(precision: Column, threshold: Column) -> Column:
    """A threshold moved by the precision it reached, within 0.3 and 0.95."""
    step = F.when(precision < 0.3, 0.15).when(precision < 0.5, 0.1).when(precision < 0.7, 0.05).when(precision > 0.9, -0.05).otherwise(0.0)
    return F.least(F.lit(0.95), F.greatest(F.lit(0.3), threshold + step))


def breakdown(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n"))


def budget_pack(rows: DataFrame, order: str, size: Column, budget: int, by: str, parts: int = 64) -> DataFrame:
    """Rows in order whose running size stays within the budget, per group. Sizes are 0 or more.

    A group is summed by ranges of the order first, and only rows of ranges that the budget reaches are numbered: a window
    sees a budget's worth of a group and the range that overflows it, not the group.
    """
    rows = rows.withColumn("_size", size)
    bounds = sorted(set(rows.approxQuantile(order, [k / parts for k in range(1, parts)], 0.25 / parts)))
    at = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda x: x <= F.col(order))) if bounds else F.lit(0)
    rows = rows.withColumn("_part", at)
    w = Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    before = rows.groupBy(by, "_part").agg(F.sum("_size").alias("_sum")).select(by, "_part", F.coalesce(F.sum("_sum").over(w), F.lit(0)).alias("_before")).where(F.col("_before") <= budget)
    near = rows.join(F.broadcast(before), [by, "_part"])
    run = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return near.withColumn("running", F.sum("_size").over(run)).where(F.col("running") <= budget).drop("_size", "_part", "_before")


def unsent(rows: DataFrame, key: list[str], order: str, sent: DataFrame | None = None) -> DataFrame:
    """Rows that are still to be packed: the first of each key by ``order``, without keys that were sent before."""
    names = rows.columns
    first = rows.groupBy(*key).agg(F.min_by(F.struct(*names), order).alias("_r")).select("_r.*")
    return first if sent is None else first.join(sent.select(*key).distinct(), key, "left_anti").select(*names)


def best_setting(tests: DataFrame, setting: str, rate: str) -> DataFrame:
    """One row (setting, rate, hypotheses): the setting of the highest rate, the least of equal ones; without a rate 30 a second."""
    best = F.max_by(F.struct(setting, rate), F.struct(F.coalesce(rate, F.lit(0.0)), -F.col(setting)))
    one = tests.agg(best.alias("b")).select(F.coalesce(f"b.{setting}", F.lit(0)).alias(setting), F.coalesce(f"b.{rate}", F.lit(30.0)).alias(rate))
    return one.withColumn("hypotheses", hypotheses(F.col(rate)))
