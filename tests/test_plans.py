"""The physical plans the operators are written for."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  registers the queries
from catalogspark.operators import merge, reconcile, search
from catalogspark.plans.registry import QUERIES, Tables

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]


def run(spark, name):
    return plan(QUERIES[name](spark, FOLDER))


def test_facets_prune_and_pre_aggregate(spark):
    text = run(spark, "facet_any")
    assert text.count("Exchange") == 1 and "partial" not in text.split("Exchange")[0]
    assert "ReadSchema: struct<p_partkey:bigint,p_name:string" in text


def test_bounds_reach_the_scan(spark):
    df = Tables(spark, FOLDER).part.where(search.numeric_predicate({("p_retailprice", "min"): 950}))
    assert "PushedFilters: [IsNotNull(p_retailprice), GreaterThanOrEqual(p_retailprice,950.0)]" in plan(df)


def test_page_is_a_top_k(spark):
    assert "TakeOrderedAndProject" in run(spark, "page_keyset") or "TakeOrderedAndProject" in run(spark, "page_two")
    assert "left_semi" in run(spark, "search_page").lower() or "LeftSemi" in run(spark, "search_page")


def test_top_sources_trims_before_the_shuffle(spark):
    text = run(spark, "top_sources")
    assert "WindowGroupLimit" in text and "Partial" in text


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_products_and_no_python(spark, name):
    text = run(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    if name not in ("page_facts", "page_fact_counts"):
        assert "Python" not in text and "InPandas" not in text


def test_relaxations_scan_once(spark):
    assert run(spark, "relaxations").count("FileScan") == 1


def test_ordered_operators_split_hot_keys(spark):
    """No window over the rows is partitioned by the bare key: the chunk is always part of it."""
    for name in ("pacing_audit", "retry_runs", "freshness", "change_feed", "curated_order"):
        windows = [line for line in run(spark, name).splitlines() if "Window [" in line]
        assert any("__key" in line.split("windowspecdefinition(")[1].split("ORDER")[0] for line in windows)


def test_ambiguous_refresh_fails_loudly(spark):
    schema = "id string, brand string, reference string, model string, status string"
    current = spark.createDataFrame([("a", "X", "1/2", "m", "s"), ("b", "X", "1-2", "m", "s")], schema)
    captures = spark.createDataFrame([("c", "X", "12", "m")], "id string, brand string, reference string, model string")
    merged = merge.merge_refresh(current, captures, F.lit(True), ["model"], {})
    with pytest.raises(Exception, match="Ambiguous catalog reference"):
        merged.collect()


def test_duplicates_are_counted_before_the_join(spark):
    a = spark.range(3).select(F.lit(1).alias("k"))
    out = reconcile.reconcile_sets(a, a, "k").collect()
    assert [(r["k"], r["status"]) for r in out] == [(1, "duplicate")]


def test_mapped_facts_are_dealt_by_page_and_never_broadcast(spark):
    text = run(spark, "eav_pivot")
    assert text.count("BroadcastExchange") == 1 and "FileScan" not in text.split("BroadcastExchange")[1]
    assert text.count("Exchange hashpartitioning(page_id") == text.count("Exchange hashpartitioning(") == 1
