"""The registered queries that have SQL, and the entry's names."""

import os

import pytest
from oracle import DATA, compare, connection

import __spark_entry__ as entry
from sentrel.llm import registry

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, name):
    compare(spark, connection(), registry.QUERIES[name], registry.ORACLES[name])


def test_entry_names_all_operators():
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(entry.oracle_sql()) <= set(names)
