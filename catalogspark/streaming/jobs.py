"""Runnable streaming jobs: sinks that merge each micro-batch into a table."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from catalogspark.operators.merge import latest_state
from catalogspark.sources.writers import overwrite_partitions
from catalogspark.streaming import log


BUCKETS = 64


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The table under ``path`` with its partition columns; None before anything was written."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _newest(table: DataFrame, gens: Column) -> DataFrame:
    """Rows of each bucket's newest generation among ``gens``. Which ones these are is read from the partition columns;
    the driver sees one pair per bucket, and only those partitions are scanned."""
    pairs = table.where(gens).groupBy("bucket").agg(F.max("gen").alias("gen")).collect()
    return table.where(F.struct("bucket", "gen").isin([F.struct(F.lit(r["bucket"]), F.lit(r["gen"])) for r in pairs]) if pairs else F.lit(False))


def merge_latest(path: str, keys: list[str], order: list[str], values: list[str], buckets: int = BUCKETS):
    """foreachBatch sink: upsert by key, the latest row by ``order`` wins.

    The table is cut into buckets by a hash of the key. A micro-batch reads the newest generation of the buckets that it
    touches and writes those buckets anew, as its own generation; all other files stay as they are. A replayed batch
    starts from the same earlier generations and replaces its own, so a restart neither loses nor repeats an
    update. The commit is recorded when the rows are written; readers look at recorded generations only.
    """
    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        columns = list(dict.fromkeys([*keys, *order, *values]))
        changes = batch.select(*columns).withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        touched = [r["bucket"] for r in changes.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
        known = _stored(spark, f"{path}/rows")
        if known is not None and touched:
            older = _newest(known.where(F.col("bucket").isin(touched)), F.col("gen") < batch_id)
            changes = changes.unionByName(older.select(*columns, "bucket"))
        merged = latest_state(changes, ["bucket", *keys], order, [c for c in columns if c not in keys])
        merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/rows/gen={batch_id}")
        spark.range(1).write.mode("overwrite").parquet(f"{path}/commits/gen={batch_id}")

    return apply


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    """Current rows of a table that ``merge_latest`` keeps."""
    commits = [r["gen"] for r in spark.read.parquet(f"{path}/commits").select("gen").distinct().collect()]  # one number per batch
    return _newest(spark.read.parquet(f"{path}/rows"), F.col("gen").isin(commits)).drop("bucket", "gen")


def start_queue(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Work queue: new work is inserted, known work moves to its latest status."""
    sink = merge_latest(path, ["key"], ["ts", "event_id"], ["status"])
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_queue(spark: SparkSession, path: str) -> DataFrame:
    return read_latest(spark, path)


def start_import(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Incremental catalog import of rows with ``dataset``, ``capture`` and ``declared``, the capture's own total.

    A capture may arrive over several micro-batches: each writes its own partition, and a replayed batch replaces
    only what it wrote before.
    """
    def apply(batch: DataFrame, batch_id: int) -> None:
        overwrite_partitions(batch.withColumn("batch", F.lit(batch_id)), path, "dataset", "capture", "batch")

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start()


def read_imports(spark: SparkSession, path: str) -> DataFrame:
    """The catalog as imported: per dataset the latest capture that has reached its declared total. A capture that is
    still arriving is not served, repeated rows count once, and a dataset never mixes two captures."""
    rows = spark.read.parquet(path)
    arrived = rows.groupBy("dataset", "capture").agg(F.count_distinct("id").alias("n"), F.max("declared").alias("total"))
    latest = arrived.where(F.col("n") >= F.col("total")).groupBy("dataset").agg(F.max("capture").alias("capture"))
    return rows.join(latest, ["dataset", "capture"], "left_semi").drop("batch")


def start_circuits(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch merges the hosts whose state it changed into the table of current circuits."""
    sink = merge_latest(path, ["key"], ["batch"], ["reason", "until_us", "openings"])

    def apply(batch: DataFrame, batch_id: int) -> None:
        sink(batch.withColumn("batch", F.lit(batch_id).cast("long")), batch_id)

    state = log.circuit_state(log.event_time(stream), "key", ["ts", "event_id"])
    return state.writeStream.outputMode("update").foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start()


def read_circuits(spark: SparkSession, path: str) -> DataFrame:
    """Current circuit per host."""
    return read_latest(spark, path).drop("batch")


def rate_stream(stream: DataFrame, key: str = "key", period: str = "1 minute",
                limit: int = log.LOOKUPS_PER_MINUTE) -> DataFrame:
    """Append-mode limiter windows; state of a window is dropped once the watermark passes it."""
    return log.rate_windows(log.event_time(stream), key, period, limit)


def flight_stream(stream: DataFrame, key: str = "key", flight: str = "1 minute") -> DataFrame:
    return log.single_flight(log.event_time(stream), key, flight)


def lookup_stream(stream: DataFrame, results: DataFrame) -> DataFrame:
    served = log.serve(log.event_time(stream), results, "key")
    return served.withColumn("refresh", F.col("state") != "fresh")
