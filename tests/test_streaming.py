"""Each streaming job gives the result of its batch twin."""

import pytest
from pyspark.sql import functions as F

from catalogspark.plans.registry import Tables
from catalogspark.streaming import jobs, log

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def logs(spark, tmp_path_factory):
    """The request log as a folder of several files, plus its batch view."""
    batch = Tables(spark, FOLDER).log
    path = str(tmp_path_factory.mktemp("log") / "events")
    # Files arrive in event order, one append each: anything older than the watermark would rightly be dropped.
    for day in (1, 8, 15, 22):
        part = batch.where((F.dayofmonth("ts") >= day) & ((F.dayofmonth("ts") < day + 7) | F.lit(day == 22)))
        part.coalesce(1).write.mode("append").parquet(path)
    return batch, path


def stream(spark, logs, files=1):
    batch, path = logs
    return spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", files).parquet(path)


def drain(df, name, tmp_path, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option(
        "checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start()
    query.awaitTermination(180)
    assert query.exception() is None
    return df.sparkSession.table(name)


def key(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def test_circuit_state(spark, logs, tmp_path):
    query = jobs.start_circuits(stream(spark, logs), str(tmp_path / "circuits"), str(tmp_path / "c"))
    query.awaitTermination(180)
    assert query.exception() is None
    cols = ("key", "reason", "until_us", "openings")
    assert key(jobs.read_circuits(spark, str(tmp_path / "circuits")), *cols) == key(log.circuit_state(logs[0], "key", ["ts", "event_id"]), *cols)


def closed(logs, rows, start, period):
    """Windows the watermark has passed at the end of the stream: those an append-mode query has emitted."""
    last = logs[0].agg(F.max("ts")).first()[0]
    return rows.where(F.col(start) + F.expr(f"interval {period}") <= F.lit(last) - F.expr("interval 10 minutes"))


def test_rate_windows(spark, logs, tmp_path):
    got = drain(jobs.rate_stream(stream(spark, logs), period="1 hour", limit=1), "rates", tmp_path)
    want = closed(logs, log.rate_windows(logs[0], "key", "1 hour", 1), "window_start", "1 hour")
    cols = ("key", "window_start", "n", "over_limit")
    assert key(closed(logs, got, "window_start", "1 hour"), *cols) == key(want, *cols) != []


def test_single_flight(spark, logs, tmp_path):
    got = drain(jobs.flight_stream(stream(spark, logs), flight="1 hour"), "flights", tmp_path)
    want = closed(logs, log.single_flight(logs[0], "key", "1 hour"), "flight_start", "1 hour")
    assert key(closed(logs, got, "flight_start", "1 hour"), "key", "flight_start", "requests") == key(want, "key", "flight_start", "requests") != []


def test_first_in_flight(spark, logs, tmp_path):
    got = drain(log.first_in_flight(log.event_time(stream(spark, logs, 4)), "key"), "first", tmp_path)
    assert got.count() == got.select("key").distinct().count() == logs[0].select("key").distinct().count()


def test_lookup_freshness(spark, logs, tmp_path):
    outcome = F.when(F.col("kind") == "purchase", "found").when(F.col("kind") == "signup", "not_found")
    results = log.latest_results(logs[0], "key", outcome)
    got = drain(jobs.lookup_stream(stream(spark, logs), results), "lookups", tmp_path)
    want = log.serve(logs[0], results, "key")
    assert key(got, "event_id", "state") == key(want, "event_id", "state")


def test_queue_resumes_after_restart(spark, logs, tmp_path):
    batch, _ = logs
    source, table, ckpt = str(tmp_path / "in"), str(tmp_path / "queue"), str(tmp_path / "ckpt")
    rows = batch.select("key", F.col("kind").alias("status"), "ts", "event_id")
    half = rows.where("event_id < 500")
    for part in (half, rows.where("event_id >= 500")):
        part.coalesce(1).write.mode("append").parquet(source)
        query = jobs.start_queue(spark.readStream.schema(rows.schema).parquet(source), table, ckpt)
        query.awaitTermination(180)
        assert query.exception() is None
    want = log.queue_status(rows, "key", ["ts", "event_id"], "status")
    assert key(jobs.read_queue(spark, table), "key", "status") == key(want, "key", "status")


def test_upserts_touch_their_buckets_only(spark, tmp_path):
    path = str(tmp_path / "t")
    sink = jobs.merge_latest(path, ["key"], ["at"], ["status"], buckets=8)
    batches = [[(i, 1, "new") for i in range(40)], [(3, 2, "done"), (3, 1, "late"), (99, 1, "new")], [(3, 3, "again")]]
    for n, rows in enumerate(batches):
        before = {f for f in spark.read.parquet(f"{path}/rows").inputFiles()} if n else set()
        for _ in range(2):  # every batch is replayed
            sink(spark.createDataFrame(rows, "key int, at int, status string"), n)
        after = set(spark.read.parquet(f"{path}/rows").inputFiles())
        assert before <= after and len(after - before) <= len({r[0] for r in rows})
    got = {r["key"]: r["status"] for r in jobs.read_latest(spark, path).collect()}
    assert len(got) == 41 and got[3] == "again" and got[99] == "new" and got[5] == "new"
    sink(spark.createDataFrame([], "key int, at int, status string"), 3)
    assert jobs.read_latest(spark, path).count() == 41


def test_incremental_import(spark, tmp_path):
    source, table, ckpt = str(tmp_path / "in"), str(tmp_path / "cat"), str(tmp_path / "ckpt")
    schema = "id long, dataset string, capture string, declared long"
    # The second capture of "a" declares two rows; with one of them the first capture is still served.
    for rows, served in (([(1, "a", "1", 1), (2, "b", "1", 1)], [1, 2]), ([(3, "a", "2", 2), (3, "a", "2", 2)], [1, 2]), ([(4, "a", "2", 2)], [2, 3, 4])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        query = jobs.start_import(spark.readStream.schema(schema).parquet(source), table, ckpt)
        query.awaitTermination(180)
        assert query.exception() is None
        assert sorted({r["id"] for r in jobs.read_imports(spark, table).collect()}) == served
