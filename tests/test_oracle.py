"""Every registered query against its SQL oracle on the smallest tables."""

import pytest
from oracle_check import compare, connect

import __spark_entry__ as entry
from catalogspark.plans.registry import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"
#: Queries without a result on the smallest tables.
MAY_BE_EMPTY = frozenset(("relaxations", "rule_numeric"))


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    sql = ORACLE.get(name)
    if sql is None:
        assert df.columns and df.collect() is not None
    else:
        problem = compare(df, con, sql)
        assert problem is None or (problem == "both empty" and name in MAY_BE_EMPTY), problem


def test_entry(spark):
    assert entry.entry(spark).columns == ["rank", "id", "brand", "model", "diameter", "price", "total"]
