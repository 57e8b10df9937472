"""Catalog summaries: counts, coverage, insights and invariants."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogspark.operators.ordered import top_per_key

from catalogspark.functions.records import present


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).select(column).distinct()


def extra_labels(df: DataFrame, extra_specs: str = "extra_specs") -> DataFrame:
    """Vocabulary of the additional specification labels."""
    return df.select(F.explode(F.transform(extra_specs, lambda s: s["label"])).alias("label")).distinct()


def top_counts(df: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """Most frequent keys, ties by name."""
    order = [F.col("n").desc(), *[F.col(k).asc() for k in keys]]
    return df.groupBy(*keys).agg(F.count("*").alias("n")).orderBy(*order).limit(n)


def brand_summary(df: DataFrame, brand: str, family: str, coverage: Column, core: Sequence[str]) -> DataFrame:
    """Rows, rounded mean coverage, distinct families and present core fields per brand.

    The distinct count goes through (brand, family) groups first, so a hot brand is spread over its families.
    """
    families = df.withColumn("__coverage", coverage).groupBy(brand, family).agg(
        F.count("*").alias("__rows"), F.sum("__coverage").alias("__sum"),
        *[F.count_if(present(f)).alias(f"__f_{f}") for f in core],
    )
    return families.groupBy(brand).agg(
        F.sum("__rows").alias("records"),
        F.round(F.sum("__sum") / F.sum("__rows")).cast("int").alias("coverage"),
        F.count(family).alias("families"),
        *[F.sum(f"__f_{f}").alias(f"has_{f}") for f in core],
    )


def insights(df: DataFrame, brand: str, segment: str, measure: str, eligible: Column, mentions: Column,
             caliber: str) -> DataFrame:
    """(scope, name, ...) overall, per brand and per segment in one grouping-sets pass."""
    rows = df.withColumns({"__m": F.when(eligible, F.col(measure)), "__g": mentions.cast("int")})
    grouped = rows.groupingSets([[], [F.col(brand)], [F.col(segment)]], F.col(brand), F.col(segment)).agg(
        F.grouping_id().alias("__gid"),
        F.count("*").alias("n"),
        F.count("__m").alias("measured"),
        F.round(F.avg("__m"), 6).alias("mean_measure"),
        (F.count("*") - F.count("__m")).alias("excluded"),
        F.sum("__g").alias("mentions"),
        F.countDistinct(caliber).alias("calibers"),
    )
    scope = F.when(F.col("__gid") == 3, "overall").when(F.col("__gid") == 1, "brand").otherwise("segment")
    name = F.coalesce(F.col(brand).cast("string"), F.col(segment).cast("string"), F.lit("all"))
    return grouped.select(scope.alias("scope"), name.alias("name"), "n", "measured", "mean_measure", "excluded",
                          "mentions", "calibers")


def missing_report(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(field, documented, missing) from one pass."""
    counts = df.agg(*[F.count_if(present(f)).alias(f) for f in fields], F.count("*").alias("__rows"))
    long = counts.unpivot(["__rows"], list(fields), "field", "documented")
    return long.select("field", "documented", (F.col("__rows") - F.col("documented")).alias("missing"))


def catalog_stats(df: DataFrame, brand: str, family: str, core: Sequence[str]) -> DataFrame:
    """Rows, distinct brand+family pairs and overall coverage percentage."""
    known = sum((present(f).cast("int") for f in core), F.lit(0))
    pairs = df.groupBy(brand, family).agg(F.count("*").alias("__n"), F.sum(known).alias("__known"))
    return pairs.agg(
        F.sum("__n").alias("records"),
        F.count("*").alias("families"),
        F.round(F.sum("__known") * 100 / (F.sum("__n") * len(core))).cast("int").alias("coverage"),
    )


def sole_value(df: DataFrame, keys: Sequence[str], value: str, out: str = "value") -> DataFrame:
    """The value of a key that has exactly one; null when it has several. Min and max decide, no set is kept."""
    low, high = F.min(value), F.max(value)
    return df.groupBy(*keys).agg(F.when(low == high, low).alias(out))


def key_conflicts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Keys seen with more than one value, with the number of values."""
    pairs = df.select(*keys, value).distinct()
    return pairs.groupBy(*keys).agg(F.count(value).alias("n_values")).where(F.col("n_values") > 1)


def date_range(df: DataFrame, keys: Sequence[str], date: Column) -> DataFrame:
    """First and last date, number of dates and the printed range label."""
    days = df.select(*keys, date.cast("string").alias("__d")).distinct()
    low, high = F.min("__d"), F.max("__d")
    return days.groupBy(*keys).agg(
        low.alias("first_date"), high.alias("last_date"), F.count("__d").alias("n_dates"),
        F.when(low == high, low).otherwise(F.concat(low, F.lit(" to "), high)).alias("label"),
    )


def code_coverage(df: DataFrame, codes: Column) -> DataFrame:
    """Occurrences of each source code in a map column."""
    return df.select(F.explode(F.map_keys(codes)).alias("code")).groupBy("code").agg(F.count("*").alias("n"))


def concat_values(df: DataFrame, keys: Sequence[str], value: str, out: str = "values") -> DataFrame:
    """Distinct values of one record joined in order. Duplicates are removed before the group is formed."""
    distinct = df.select(*keys, value).distinct()
    return distinct.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(value)), "; ").alias(out))


def invariants(df: DataFrame, checks: Mapping[str, tuple[Column, Column]]) -> DataFrame:
    """(check, ok, observed, expected): each check compares two aggregates over the same single pass."""
    names = list(checks)
    wide = df.agg(*[
        F.struct(checks[n][0].cast("long").alias("observed"), checks[n][1].cast("long").alias("expected")).alias(f"__{i}")
        for i, n in enumerate(names)
    ])
    rows = F.array(*[
        F.struct(F.lit(n).alias("name"), F.col(f"__{i}.observed").eqNullSafe(F.col(f"__{i}.expected")).alias("ok"),
                 F.col(f"__{i}.observed").alias("observed"), F.col(f"__{i}.expected").alias("expected"))
        for i, n in enumerate(names)
    ])
    return wide.select(F.inline(rows))


def first_values(df: DataFrame, keys: Sequence[str], value: str, n: int, out: str, separator: str = "; ") -> DataFrame:
    """(keys, ``out``, n_values): the first ``n`` distinct values per key joined in order, and how many there are. Of any
    key at most ``n`` values are held together, whatever its number."""
    distinct = df.where(F.col(value).isNotNull()).select(*keys, value).distinct()
    first = top_per_key(distinct, keys, [F.col(value).asc()], n).groupBy(*keys).agg(
        F.array_join(F.array_sort(F.collect_list(value)), separator).alias(out))
    return first.join(distinct.groupBy(*keys).agg(F.count("*").alias("n_values")), keys)
