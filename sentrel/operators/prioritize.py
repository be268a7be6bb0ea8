"""Ranking, budgets and plans over findings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentrel.functions import fixed
from sentrel.functions.expressions import lookup, severity_rank, weight_of
from sentrel.operators.paths import keep_first
from sentrel.session import cut_lineage


def best_per_sink(rows: DataFrame, sink: Sequence[str], order: Sequence) -> DataFrame:
    """The best row of each sink."""
    return keep_first(rows, sink, order)


def adaptive_cap(n: Column, limit: int = 2000) -> Column:
    """Budget by the number of paths; 0 is unlimited."""
    share = F.floor(n / 15)
    return F.when(n < 5000, F.lit(0)).when(n >= 50000, F.greatest(F.lit(limit), F.least(F.lit(5000), share))).when(n >= 30000, F.greatest(F.lit(limit), F.least(F.lit(4000), share))).otherwise(F.lit(limit))


def numbered(rows: DataFrame, order: Sequence, name: str = "n") -> DataFrame:
    """Rows with their number from 1 in an order, counted per sorted partition, so that no task numbers them all."""
    at = rows.orderBy(*order).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id() % (1 << 33)})
    at = cut_lineage(at, "sorted")
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    before = at.groupBy("_part").agg(F.count("*").alias("_size")).select("_part", F.coalesce(F.sum("_size").over(w), F.lit(0)).alias("_before"))
    return at.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_at") + 1).drop("_part", "_at", "_before")


def tiered_budget(rows: DataFrame, ceiling: int, sink: Sequence[str], weights: Mapping[str, int] = fixed.WEIGHTS, ident: str = "id") -> DataFrame:
    """Rows (id, severity, category, direct, blocked, steps, sink keys) that fit a budget, with their tier.

    Tiers: 0 direct rows, 1 CRITICAL, 2 HIGH, 3 one row of each category that those leave out, 4 MEDIUM, 5 LOW.
    Direct and CRITICAL rows always stay, HIGH ones give way to the ceiling, MEDIUM and LOW fill what is left.
    Below the direct rows a sink counts once, by its best row. A ceiling of 0 keeps all.

    The ranked rows are written once, as every tier reads them. What the ceiling cuts is a top-k of that size, so no task
    sorts a whole tier; the ceiling is a bounded parameter.
    """
    rank, weight = severity_rank(F.col("severity")), weight_of(F.col("category"), weights)
    kept, names = rows.columns, ["_rank", "_weight"]
    rows = rows.withColumns({"_rank": F.least(rank, F.lit(3)), "_weight": weight})
    order = [F.desc("_weight"), F.col("blocked"), F.col("steps"), F.col(ident)]
    best = keep_first(rows.where("NOT direct"), sink, order)
    ranked = cut_lineage(rows.where("direct").withColumn("_rank", F.lit(-1)).unionByName(best), "ranked")
    tier = lambda k: ranked.where(F.col("_rank") == k)
    top = ranked.where("_rank <= 0").withColumn("tier", F.col("_rank") + 1)
    sizes = {r["_rank"]: r["n"] for r in ranked.where("_rank <= 0").groupBy("_rank").agg(F.count("*").alias("n")).collect()}  # two rows
    high = tier(1)
    if ceiling:
        high = high.orderBy(*order).limit(max(ceiling - sum(sizes.values()), 0))
    top = top.unionByName(high.withColumn("tier", F.lit(2)))
    # the best row of each category that is left out: one per category and task goes to the shuffle
    rest = ranked.where("_rank >= 2")
    missing = rest.join(F.broadcast(top.select("category").distinct()), "category", "left_anti")
    lead = F.struct("_rank", -F.col("_weight"), "blocked", "steps", ident)
    extra = missing.groupBy("category").agg(F.min_by(F.struct(*(F.col(c) for c in [*kept, *names])), lead).alias("r")).select("r.*").withColumn("tier", F.lit(3))
    chosen = cut_lineage(top.unionByName(extra.select(*top.columns)), "chosen")
    fill = rest.join(chosen.where("tier = 3").select(ident), ident, "left_anti")
    if ceiling:
        fill = fill.orderBy("_rank", *order).limit(max(ceiling - chosen.count(), 0))
    return chosen.unionByName(fill.withColumn("tier", F.col("_rank") + 2).select(*chosen.columns)).select(*kept, "tier")


def score(severity: Column, category: Column, steps: Column, sanitized: Column) -> Column:
    """The alternative score: points for severity and class, short paths, half as much again without a sanitizer."""
    base = lookup(F.upper(severity), fixed.SEVERITY_POINTS, 10) + lookup(category, fixed.CLASS_POINTS, 20) + F.greatest(F.lit(0), 50 - 5 * steps)
    return F.when(sanitized, base.cast("double")).otherwise(base * 1.5)


def strategic_sample(rows: DataFrame, every: int, first_low: int, ident: str = "id") -> DataFrame:
    """All CRITICAL and HIGH rows, every k-th MEDIUM one and the first LOW ones, by id."""
    of = lambda *names: rows.where(F.col("severity").isin(*names))
    medium = numbered(of("MEDIUM"), [ident], "_n").where((F.col("_n") - 1) % every == 0).drop("_n")
    return of("CRITICAL", "HIGH").unionByName(medium.select(*rows.columns)).unionByName(of("LOW").orderBy(ident).limit(first_low))


def coverage_plan(parts: Sequence[tuple[DataFrame, int | None]], key: str, order: str) -> DataFrame:
    """Union of prioritised parts (frame, limit); a key keeps its first priority."""
    out = None
    for k, (df, limit) in enumerate(parts):
        rows = (df.orderBy(order, key).limit(limit) if limit else df).select(key, F.col(order).alias("ord")).withColumn("priority", F.lit(k))
        out = rows if out is None else out.unionByName(rows)
    return keep_first(out, [key], ["priority", "ord"])


def estimate(n: Column) -> dict[str, Column]:
    """Functions, sources, sinks, paths and minutes to expect from a number of files."""
    paths = F.greatest(F.lit(50), F.floor(n * 3 * n * 2 * 1e-4))
    return {"functions": n * 5, "sources": n * 3, "sinks": n * 2, "paths": paths, "minutes": F.least(F.lit(5000), paths) * 15 / 60}


def scale_of(files: Column, megabytes: Column) -> Column:
    """The class of a code base by its size."""
    return F.when(megabytes > 1000, "huge").when(files < 100, "small").when(files < 1000, "medium").when(files < 10000, "large").otherwise("huge")
