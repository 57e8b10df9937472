"""Scans of record exports, snapshots, sitemaps and crawl state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalogspark.schema import COLUMNS, FLAT_SCHEMA, RECORD_SCHEMA

CORRUPT = "_corrupt_record"


def read_records(spark: SparkSession, path: str, schema: T.StructType = RECORD_SCHEMA) -> DataFrame:
    """JSON-lines records with a fixed schema; a broken line is kept in ``_corrupt_record``."""
    full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    return spark.read.schema(full).json(path, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT)


def read_csv_strict(spark: SparkSession, path: str, columns: Sequence[str] = COLUMNS) -> DataFrame:
    """CSV whose header must be exactly ``columns`` in order; blanks are read as null. One header is compared here; the
    others are checked by the scan itself (``enforceSchema=False``), which fails on a file with other names."""
    header = spark.read.option("header", True).csv(path).columns
    if header != list(columns):
        raise ValueError(f"unexpected CSV header in {path}")
    schema = FLAT_SCHEMA if tuple(columns) == COLUMNS else T.StructType(
        [T.StructField(c, T.StringType()) for c in columns])
    return spark.read.csv(path, header=True, schema=schema, enforceSchema=False, multiLine=True, escape='"', nullValue="")


def read_document(spark: SparkSession, path: str) -> DataFrame:
    """Whole JSON documents, one per file, as (path, doc VARIANT); invalid JSON gives a null doc."""
    files = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    return files.select("path", F.try_parse_json("value").alias("doc"))


def read_snapshots(spark: SparkSession, folder: str, manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(verified, rejected) page bodies. Files are named by the SHA-256 of their bytes; the manifest
    (url, sha256, fetched_at) says which are expected. A missing or altered body is rejected."""
    files = spark.read.format("binaryFile").load(folder).select(
        F.regexp_extract("path", "([^/]+)$", 1).alias("sha256"), F.sha2("content", 256).alias("actual"), "content")
    return verify_bodies(manifest, files)


def verify_bodies(manifest: DataFrame, bodies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(verified, rejected) manifest rows by ``bodies`` (sha256 as named, actual, ...): the latter with the reason."""
    joined = manifest.join(bodies, "sha256", "left")
    intact = F.coalesce(F.col("actual") == F.col("sha256"), F.lit(False))
    reason = F.when(F.col("actual").isNull(), "missing body").otherwise("hash mismatch")
    verified = joined.where(intact).drop("actual")
    return verified, joined.where(~intact).select(*manifest.columns, reason.alias("reason"))


def read_sitemaps(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(found, refused): (file, kind, loc) of sitemap indexes and url sets, plain or gzip, and (file, reason) of the rest.

    Only page locations count: image and video extensions use prefixed elements and are not matched. Documents
    with a DOCTYPE are refused, so no external entity is ever resolved; so are documents that are no sitemap.
    """
    files = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    reason = (F.when(F.upper("value").contains("<!DOCTYPE"), "has a DOCTYPE")
              .when(~F.col("value").rlike(r"<(?:sitemapindex|urlset)[\s>]"), "not a sitemap"))
    files = files.withColumn("reason", reason)
    sound = files.where("reason is null")
    kinds = []
    for kind, root, parent in (("index", "sitemapindex", "sitemap"), ("urlset", "urlset", "url")):
        locs = F.xpath("value", F.lit(f"/{root}/{parent}/loc/text()"))
        of_kind = sound.where(F.col("value").rlike(rf"<{root}[\s>]"))
        kinds.append(of_kind.select("file", F.lit(kind).alias("kind"), F.explode(locs).alias("loc")))
    found = kinds[0].unionByName(kinds[1])
    return found.withColumn("loc", F.trim("loc")).where(F.col("loc") != ""), files.where("reason is not null").select("file", "reason")


def read_state(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """One of the crawl state tables (cache, circuits, queue, records, events) kept as Parquet."""
    if table not in ("cache", "circuits", "queue", "records", "events"):
        raise ValueError(f"unknown state table {table}")
    return spark.read.parquet(f"{folder}/{table}")


def read_lookup_jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int) -> DataFrame:
    """Relational scan of an external store, split on a numeric key so no single task reads the table."""
    return spark.read.jdbc(url, table, column=key, lowerBound=low, upperBound=high, numPartitions=parts)
