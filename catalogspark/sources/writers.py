"""Sinks. Every write goes to a folder through Spark's commit protocol, which replaces rename tricks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogspark.functions.text import csv_cell
from catalogspark.operators.quality import quality_report, split_quarantine, with_errors
from catalogspark.schema import COLUMNS

EXPORT_ORDER = ("brand", "reference_number", "market", "language")


def write_csv(df: DataFrame, path: str, columns: Sequence[str] = COLUMNS) -> None:
    """Fixed columns in fixed order, extras dropped, unknown as an empty cell."""
    df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns]).write.mode("overwrite").csv(
        path, header=True, escape='"', quoteAll=False, emptyValue="")


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path, ignoreNullFields=False)


def write_by(df: DataFrame, path: str, column: str) -> None:
    """One folder per value of ``column`` (all / wrist / pocket style splits)."""
    df.write.mode("overwrite").partitionBy(column).parquet(path)


def export_records(df: DataFrame, folder: str, rules: Mapping[str, Column], columns: Sequence[str] = COLUMNS) -> DataFrame:
    """Accepted rows to CSV and JSON lines, rejected rows with reasons to quarantine; returns the quality metrics.

    The checked rows are cached once (they are recomputed if an executor is lost) and freed at the end.
    """
    checked = with_errors(df, rules).persist()
    try:
        accepted, _ = split_quarantine(checked)
        order = [c for c in EXPORT_ORDER if c in df.columns]
        accepted = accepted.orderBy(*order) if order else accepted
        write_csv(accepted, f"{folder}/watches_csv", columns)
        write_jsonl(accepted, f"{folder}/watches_jsonl")
        write_jsonl(checked.where(F.size("errors") > 0), f"{folder}/quarantine")
        quality = quality_report(checked, columns)
        write_jsonl(quality, f"{folder}/quality")
    finally:
        checked.unpersist()
    return df.sparkSession.read.schema("metric string, n long").json(f"{folder}/quality")


def compare_table(df: DataFrame, heading: Column, fields: Mapping[str, Column], products: Sequence[str]) -> DataFrame:
    """One row per field, one column per product; ``products`` are the headings to compare."""
    if not products:
        raise ValueError("name a product to compare")
    wide = df.select(heading.alias("__product"), *[c.cast("string").alias(n) for n, c in fields.items()])
    long = wide.unpivot(["__product"], list(fields), "field", "value")
    return long.groupBy("field").pivot("__product", list(products)).agg(F.first("value", ignorenulls=True))


def compare_csv(table: DataFrame) -> DataFrame:
    """Comparison rows as safe CSV lines."""
    return table.select(F.concat_ws(",", *[csv_cell(F.col(f"`{c}`")) for c in table.columns]).alias("line"))


def overwrite_partitions(df: DataFrame, path: str, *columns: str) -> None:
    """Replace exactly the partitions present in ``df``; every other partition keeps its files."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*columns).parquet(path)
