"""Accept/quarantine split and run quality."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogspark.functions.records import collect_errors, present


def with_errors(df: DataFrame, rules: Mapping[str, Column], out: str = "errors") -> DataFrame:
    """Add the array of failed rule messages; an empty array means accepted."""
    return df.withColumn(out, collect_errors(rules))


def split_quarantine(df: DataFrame, errors: str = "errors") -> tuple[DataFrame, DataFrame]:
    return df.where(F.size(errors) == 0).drop(errors), df.where(F.size(errors) > 0)


def quality_report(df: DataFrame, fields: Sequence[str], errors: str = "errors") -> DataFrame:
    """(metric, n): accepted, quarantined, and missing values per field among the accepted, in one pass."""
    accepted = F.size(errors) == 0
    wide = df.agg(
        F.count_if(accepted).alias("accepted"), F.count_if(~accepted).alias("quarantined"),
        *[F.count_if(accepted & ~present(f)).alias(f"missing_{f}") for f in fields],
    )
    names = ["accepted", "quarantined", *[f"missing_{f}" for f in fields]]
    return wide.select(F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("n")) for n in names])))


def identity_gate(joined: DataFrame, identities: Mapping[str, Column], expected: Column) -> DataFrame:
    """Add ``errors``: every identity found on a page must equal the expected one; disagreement rejects the page."""
    rules = {f"{name} differs": ~value.eqNullSafe(expected) for name, value in identities.items()}
    return with_errors(joined, rules)


def with_printed_exception(df: DataFrame, printed: Column, published: Column, suffix: Column) -> DataFrame:
    """Record, never hide, the one tolerated difference: the printed reference lacks a known suffix."""
    omitted = ~printed.eqNullSafe(published) & (F.concat(printed, suffix) == published)
    entry = F.struct(F.lit("reference_number").alias("field"), printed.alias("printed_reference"),
                     published.alias("product_sku"))
    return df.withColumn("source_discrepancies", F.when(omitted, F.array(entry)))


def discrepancies(facts: DataFrame, keys: Sequence[str], source: str, value: str, preferred: str) -> DataFrame:
    """Keys whose sources disagree: both values, and the one selected (the preferred source)."""
    grouped = facts.groupBy(*keys).agg(
        F.min(F.when(F.col(source) == preferred, F.col(value))).alias("selected"),
        F.min(F.when(F.col(source) != preferred, F.col(value))).alias("other"),
    )
    both = F.col("selected").isNotNull() & F.col("other").isNotNull()
    return grouped.where(both & (F.col("selected") != F.col("other")))
