"""Queries over tables whose keys have very many rows: pairs of them can't be made in the time of a test."""

import pytest
from pyspark.sql import functions as F

from sentrel import catalog

PARTS, SUPPLIERS = 200_000, 100_000


@pytest.fixture(scope="module")
def big(spark, tmp_path_factory):
    """One name, brand and nation for all rows; parts of even keys have size 1, those of odd ones size 2."""
    d = str(tmp_path_factory.mktemp("big"))
    k = F.col("id")
    spark.range(PARTS).select(k.alias("p_partkey"), F.lit("hot bolt").alias("p_name"), F.lit("Brand#0").alias("p_brand"), F.lit("SMALL").alias("p_type"), (k % 2 + 1).cast("int").alias("p_size"), F.lit(900.0).alias("p_retailprice")).write.parquet(f"{d}/part.parquet")
    spark.range(SUPPLIERS).select(k.alias("s_suppkey"), F.lit(0).alias("s_nationkey")).write.parquet(f"{d}/supplier.parquet")
    spark.createDataFrame([(0, 0)], "n_nationkey int, n_regionkey int").write.parquet(f"{d}/nation.parquet")
    return d


def test_calls_by_name_are_counted_without_pairs(spark, big):
    got = catalog.QUERIES["call_edges_by_name"](spark, big)
    assert got.agg(F.count("*"), F.min("n_callees"), F.max("n_callees"), F.min("first_callee"), F.max("first_callee")).first() == (PARTS // 2, PARTS // 2, PARTS // 2, 1, 1)


def test_parts_without_a_name_call_nothing(spark, tmp_path):
    rows = [(1, None, "Brand#1", 1), (2, None, "Brand#1", 2), (3, "a b", "Brand#1", 1), (4, "c b", "Brand#1", 2)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    assert [tuple(r) for r in catalog.QUERIES["call_edges_by_name"](spark, str(tmp_path)).collect()] == [(3, 1, 4)]


def test_scoped_calls_are_counted_without_pairs(spark, big):
    got = catalog.QUERIES["scoped_call_edges"](spark, big)
    assert got.agg(F.count("*"), F.min("n_callees"), F.max("n_callees")).first() == (PARTS, PARTS, PARTS)


def test_lookup_by_version_keeps_top_records_of_each_kind(spark, big):
    got = catalog.QUERIES["version_lookup"](spark, big).where("dep IN (0, 1, 2, 4)").orderBy("dep", "rank").collect()
    even, odd = [(i, r) for r, i in enumerate((0, 2, 4, 6, 8), 1)], [(i, r) for r, i in enumerate((1, 3, 5, 7, 9), 1)]
    # 0 states no version, 1 and 2 ones that are mentioned, 4 one that is not
    assert [tuple(r) for r in got] == [(d, i, r) for d, ids in ((0, odd), (1, even), (2, odd)) for i, r in ids]


def test_context_keeps_top_records_of_each_id(spark, big):
    got = catalog.QUERIES["path_context"](spark, big).where("s_suppkey IN (0, 99999)").orderBy("s_suppkey", "rank").collect()
    assert [tuple(r) for r in got] == [(s, i, "cwe", r) for s in (0, 99999) for r, i in enumerate((7, 21, 35), 1)]
