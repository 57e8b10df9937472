"""Lineage is cut in the reliable folder, never in an executor's own disk."""

from catalogspark.session import cut_lineage


def test_cut_lineage(spark):
    df = cut_lineage(spark.range(5))
    assert df.count() == 5 and spark.sparkContext.getCheckpointDir()
    assert "Scan ExistingRDD" in df._jdf.queryExecution().toString()
