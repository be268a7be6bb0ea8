"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is a grouped minimum and a join on the node; nothing is collected, and a node of any degree is
summed before the shuffle and split by adaptive skew joins after it. A round is written to the shared folder, and
the one before it deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentrel.llm.common import materialize, release


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame, name: str = "components", rounds: int = 64) -> DataFrame:
    """(node, root): every node of the edges (a, b) but the roots, with the least node it reaches."""
    e = materialize(edges.select("a", "b").where("a <> b").distinct(), f"{name}-0")
    seen = None
    for k in range(1, rounds + 1):
        before, e = e, materialize(_small_star(_large_star(e)), f"{name}-{k}")
        release(before)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == now:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")
