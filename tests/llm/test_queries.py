"""The registered queries of the numbered operators: against their SQL where there is some, whole tables otherwise."""

import pytest
from oracle_check import compare, connect

import __spark_entry__ as entry
from catalogspark.llm.queries import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"


def test_all_operators_are_registered():
    names = entry.queries()
    assert set(QUERIES) | {"pipeline"} <= set(names)
    assert sorted({int(n[2:].split("_")[0]) for n in QUERIES}) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, name):
    assert compare(QUERIES[name](spark, FOLDER), connect(FOLDER), ORACLE[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE) - {"op12_spelling"}))
def test_query_has_a_row_for_each_of_its_table(spark, name):
    table = {"op3_language": "pages", "op11_main_text": "pages", "op10_chat": "conversations"}.get(name, "documents")
    rows = QUERIES[name](spark, FOLDER)
    n = spark.read.parquet(f"{FOLDER}/{table}.parquet").count()
    assert (rows.agg({"copies": "sum"}).first()[0] if "copies" in rows.columns else rows.count()) == n


@pytest.mark.parametrize("name", ["op4_mixing", "op8_quality", "op10_chat"])
def test_native_operators_use_no_python(spark, name):
    text = QUERIES[name](spark, FOLDER)._jdf.queryExecution().toString()
    assert not any(word in text for word in ("Python", "Arrow", "Pandas"))
