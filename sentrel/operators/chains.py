"""Chains of findings over role transitions.

Paths are found between roles, a handful, and findings are bound to them afterwards: the least id of each role stands for it on
the way. So the work follows the findings, not their pairs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sentrel.functions import fixed
from sentrel.session import cut_lineage

_LINK = "struct<id:bigint,severity:int,confidence:double>"


def least_paths(roles: Sequence[str], rows: Sequence[tuple[str, str, str]] | None = None) -> list[tuple[str, str, list[str], str]]:
    """(src, dst, path, label): the least of the shortest paths between present roles; cycles return to their role."""
    steps: dict[str, list[tuple[str, str]]] = {}
    for a, b, label in rows or fixed.TRANSITIONS:
        if a in roles and b in roles:
            steps.setdefault(a, []).append((b, label))
    out = []
    for start in sorted(roles):  # configuration-sized: the roles of the table
        level, seen = [([start], [])], set()
        while level:
            grown: dict[str, tuple] = {}
            for path, labels in level:
                for b, label in steps.get(path[-1], []):
                    if b not in seen:
                        grown[b] = min(grown.get(b, ([*path, b], [*labels, label])), ([*path, b], [*labels, label]))
            out += [(start, b, p, " -> ".join(labels)) for b, (p, labels) in grown.items()]
            seen |= set(grown)
            level = [g for b, g in grown.items() if b != start]  # a way back to the start ends there
    return out


def role_paths(spark: SparkSession, roles: Sequence[str], rows: Sequence[tuple[str, str, str]] | None = None) -> DataFrame:
    return spark.createDataFrame(least_paths(roles, rows), "src string, dst string, path array<string>, label string")


def role_of(text: Column, roles: dict[str, str] = fixed.ROLES) -> Column:
    """The role of a finding: that of the first category that its text names."""
    out = None
    for category, role in roles.items():
        hit = F.contains(text, F.lit(category))
        out = F.when(hit, F.lit(role)) if out is None else out.when(hit, F.lit(role))
    return out


def chains(findings: DataFrame, paths: DataFrame, top: int = 50) -> DataFrame:
    """Best chains (name, ids, size, severity, confidence, impact) from findings (id, role, severity, confidence).

    Severity is 4 for CRITICAL down to 1. A chain starts and ends at any findings of the ends' roles; between
    them the least id of each role stands. Confidence is the least one, times 0.8 per step, rounded to two digits. A set of
    ids counts once. The best are those of the highest confidence, then of the least sorted ids.

    Which ends a path needs: a chain's value is the lower of its ends' values, in steps of 0.01 and never above the best
    end of the other side. Among ends of one value the least ids win. So per side all ends above the value of the (top + 1)-th
    and the top + 1 least ids of that value hold every chain of the top, ties included. Both selections are
    group limits, which tasks apply before they shuffle; no task holds the findings of a role.
    """
    best = findings.groupBy("role").agg(F.min_by(F.struct(F.col("id").cast("long").alias("id"), F.col("severity").cast("int").alias("severity"), F.col("confidence").cast("double").alias("confidence")), "id").alias("rep"))
    paths = paths.withColumn("leg", F.xxhash64("src", "dst"))
    mid = paths.select("leg", F.posexplode(F.slice("path", 2, F.size("path") - 2)).alias("pos", "role"))
    mid = mid.join(F.broadcast(best), "role").groupBy("leg").agg(F.sort_array(F.collect_list(F.struct("pos", "rep"))).alias("m"))
    legs = paths.join(mid, "leg", "left").select("leg", "src", "dst", "label", F.size("path").alias("size"), F.coalesce(F.transform("m", lambda x: x["rep"]), F.array().cast(f"array<{_LINK}>")).alias("mids"))
    legs = legs.where(F.size("mids") == F.col("size") - 2)  # a role on the way without a finding makes no chain
    value = lambda c, mids, size: F.round(F.least(c, F.coalesce(F.array_min(F.transform(mids, lambda m: m["confidence"])), c)) * F.pow(F.lit(0.8), size - 1), 2)
    sides = legs.select("leg", "size", "mids", F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("src").alias("role")), F.struct(F.lit("b").alias("side"), F.col("dst").alias("role")))).alias("s")).select("leg", "size", "mids", "s.*")
    link = F.struct(F.col("id").cast("long").alias("id"), F.col("severity").cast("int").alias("severity"), F.col("confidence").cast("double").alias("confidence"))
    ends = findings.join(F.broadcast(sides), "role").select("leg", "side", link.alias("end"), F.col("id").cast("long").alias("id"), value(F.col("confidence"), F.col("mids"), F.col("size")).alias("v"))
    of_value = Window.partitionBy("leg", "side", "v").orderBy("id")
    ends = ends.withColumn("_r", F.row_number().over(of_value)).where(F.col("_r") <= top + 1).drop("_r")
    ends = cut_lineage(ends, "chain-ends")  # at most 101 values x (top + 1) rows a side
    most = ends.groupBy("leg", "side").agg(F.max("v").alias("most")).select("leg", F.when(F.col("side") == "a", "b").otherwise("a").alias("side"), "most")
    ends = ends.join(F.broadcast(most), ["leg", "side"]).withColumn("v", F.least("v", "most"))
    side = Window.partitionBy("leg", "side").orderBy(F.desc("v"), "id")
    ends = ends.withColumns({"_n": F.row_number().over(side), "_r": F.row_number().over(of_value)})
    last = F.max(F.when(F.col("_n") == top + 1, F.col("v"))).over(Window.partitionBy("leg", "side"))
    ends = ends.withColumn("_v", last).where("_v IS NULL OR v > _v OR (v = _v AND _r <= %d)" % (top + 1))
    a = ends.where("side = 'a'").select("leg", F.col("end").alias("a"))
    b = ends.where("side = 'b'").select("leg", F.col("end").alias("b"))
    rows = a.join(b, "leg").where("a.id <> b.id").join(F.broadcast(legs.select("leg", "label", "mids")), "leg").select("label", F.concat(F.array("a"), "mids", F.array("b")).alias("links"))
    size = F.size("links")
    severity = F.array_max(F.transform("links", lambda x: x["severity"]))
    confidence = F.round(F.array_min(F.transform("links", lambda x: x["confidence"])) * F.pow(F.lit(0.8), size - 1), 2)
    ids = F.array_sort(F.transform("links", lambda x: x["id"]))
    impact = F.when(F.col("severity") == 4, "Remote Code Execution").when(F.col("severity") == 3, "Privilege Escalation").otherwise("Data Exposure")
    out = rows.select(F.col("label").alias("name"), ids.alias("ids"), size.alias("size"), severity.alias("severity"), confidence.alias("confidence"))
    out = out.groupBy("ids").agg(F.min_by(F.struct("name", "size", "severity", "confidence"), F.struct(-F.col("confidence"), "name")).alias("r")).select("r.name", "ids", "r.size", "r.severity", "r.confidence")
    out = out.orderBy(F.desc("confidence"), "ids").limit(top)
    return out.withColumns({"impact": impact, "ids": F.array_join("ids", ",")})
