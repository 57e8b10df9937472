"""Query registry and the role mapping of the generic tables.

``part`` plays the catalog, ``lineitem`` the price facts and offers, ``orders`` the dated captures, ``documents``
the text corpus, ``pages`` the page snapshots and ``events`` the request log.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogspark.operators.facets import build_facets
from catalogspark.session import dealt
from catalogspark.sources.index import with_keys

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """Lazy access to the tables of one scale factor and to the roles derived from them."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self._folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self._folder}/{name}.parquet")

    @cached_property
    def texts(self) -> DataFrame:
        """Documents for pattern-heavy work."""
        return dealt(self.documents)

    @cached_property
    def snapshots(self) -> DataFrame:
        return dealt(self.pages)

    @cached_property
    def offers(self) -> DataFrame:
        """Offers for pattern-heavy work."""
        return dealt(self.lineitem)

    @cached_property
    def catalog(self) -> DataFrame:
        size = F.col("p_size")
        reference = F.when(size <= 48, F.concat(
            F.upper(F.substring("p_type", 1, 2)), F.format_string("%06d", "p_partkey"), F.lit("-"), size))
        rows = self.part.select(
            F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"), F.col("p_type").alias("collection"),
            F.col("p_name").alias("model"), reference.alias("reference"),
            F.when(size <= 45, size.cast("double")).alias("diameter"),
            F.when(F.col("p_type") == "PROMO", "Historical · unverified").otherwise("current").alias("status"),
            F.col("p_retailprice").alias("retail"),
        )
        return with_keys(rows)

    @cached_property
    def facets(self) -> DataFrame:
        return build_facets(self.part, "p_partkey", {
            "brand": F.array("p_brand"), "collection": F.array("p_type"), "complication": F.split("p_name", " ")})

    @cached_property
    def prices(self) -> DataFrame:
        source = F.when(F.col("l_returnflag") == "R", "recorded_catalog").otherwise("official_retail")
        currency = F.when(F.col("l_linestatus") == "O", "USD").otherwise("INR")
        return self.lineitem.groupBy(
            F.col("l_partkey").alias("id"), source.alias("source"), currency.alias("currency"),
        ).agg(F.min("l_extendedprice").alias("amount"), F.max("l_shipdate").cast("date").cast("string").alias("captured"))

    @cached_property
    def log(self) -> DataFrame:
        """Request log: key, event_id, ts (UTC instant), micros, kind, content, and the status each kind stands for."""
        kind = F.col("event_type")
        status = (F.when(kind == "error", 429).when(kind == "signup", 304).when((kind == "purchase") & (F.col("value") > 100), 403)
                  .otherwise(200))
        ts = F.col("ts").cast("timestamp")
        return self.events.select(
            F.col("user_id").alias("key"), "event_id", ts.alias("ts"), F.unix_micros(ts).alias("us"), kind.alias("kind"),
            "value", "props", status.alias("status"), F.floor("value").cast("int").alias("retry_after"))


# The same roles for the oracle.
CATALOG = """catalog AS (SELECT p_partkey AS id, p_brand AS brand, p_type AS collection, p_name AS model,
  CASE WHEN p_size <= 48 THEN upper(substr(p_type,1,2)) || printf('%06d', p_partkey) || '-' || p_size END AS reference,
  CASE WHEN p_size <= 48 THEN lower(substr(p_type,1,2)) || printf('%06d', p_partkey) || p_size END AS reference_key,
  CASE WHEN p_size <= 45 THEN CAST(p_size AS DOUBLE) END AS diameter,
  CASE WHEN p_type = 'PROMO' THEN 'Historical · unverified' ELSE 'current' END AS status,
  p_retailprice AS retail FROM part)"""
FACETS = """facets AS (SELECT p_partkey AS id, 'brand' AS facet, p_brand AS value FROM part
  UNION ALL SELECT p_partkey, 'collection', p_type FROM part
  UNION SELECT p_partkey, 'complication', unnest(string_split(p_name, ' ')) FROM part)"""
PRICES = """prices AS (SELECT l_partkey AS id,
  CASE WHEN l_returnflag = 'R' THEN 'recorded_catalog' ELSE 'official_retail' END AS source,
  CASE WHEN l_linestatus = 'O' THEN 'USD' ELSE 'INR' END AS currency,
  min(l_extendedprice) AS amount, CAST(CAST(max(l_shipdate) AS DATE) AS VARCHAR) AS captured
  FROM lineitem GROUP BY 1, 2, 3)"""
LOG = """log AS (SELECT user_id AS key, event_id, ts, epoch_us(ts) AS us, event_type AS kind, value, props,
  CASE WHEN event_type = 'error' THEN 429 WHEN event_type = 'signup' THEN 304
       WHEN event_type = 'purchase' AND value > 100 THEN 403 ELSE 200 END AS status,
  CAST(floor(value) AS INTEGER) AS retry_after FROM events)"""


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``, with its oracle when SQL can express it."""
    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(Tables(spark, folder))

        QUERIES[name] = run
        if sql:
            ORACLE[name] = sql
        return fn

    return register
