import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))


@pytest.fixture(scope="session")
def spark():
    from catalogspark.session import build_session

    session = build_session(
        "tests", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory="6g",
        spark__sql__streaming__stateStore__providerClass="org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def one(spark):
    """Evaluate a column built from one text: ``one(fn, 'text')``."""
    def run(fn, *texts):
        from pyspark.sql import functions as F

        schema = ", ".join(f"c{i} string" for i in range(len(texts)))
        df = spark.createDataFrame([tuple(texts)], schema)
        return df.select(fn(*[F.col(f"c{i}") for i in range(len(texts))]).alias("x")).first()["x"]

    return run
