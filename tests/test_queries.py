"""Every query of the catalogue against its SQL on the smallest tables."""

import os

import pytest
from oracle import DATA, compare, connection

from sentrel import catalog

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, con, name):
    compare(spark, con, catalog.QUERIES[name], catalog.ORACLES[name])


@pytest.mark.parametrize("name", ["tiered_budget", "shortest_paths", "tag_sinks_dedup"])
def test_results_do_not_depend_on_partitions(spark, con, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        compare(spark, con, catalog.QUERIES[name], catalog.ORACLES[name])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_entry_returns_rows(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["severity", "category", "n_blocks", "n_documents", "n_matches"] and df.count() > 0
