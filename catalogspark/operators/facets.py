"""Facet relation (id, facet, value) and the predicates over it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def build_facets(df: DataFrame, id_col: str, facets: Mapping[str, Column]) -> DataFrame:
    """Long relation of the documented facet values; ``facets`` maps a facet name to an array column.

    One scan and no shuffle: each row's pairs are made distinct inside the row, so (facet, value, id) is a key.
    """
    def pairs(facet: str, values: Column) -> Column:
        known = F.filter(values, lambda v: v.isNotNull() & (F.trim(v) != ""))
        return F.transform(known, lambda v: F.struct(F.lit(facet).alias("facet"), v.alias("value")))

    every_pair = F.concat(*[pairs(facet, values) for facet, values in facets.items()])
    exploded = df.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(every_pair)).alias("p"))
    return exploded.select("id", "p.facet", "p.value")


def facet_any(facets: DataFrame, facet: str, values: Sequence[str]) -> DataFrame:
    """Ids with at least one of ``values``. The filter reaches the scan, the distinct is pre-aggregated."""
    return facets.where((F.col("facet") == facet) & F.col("value").isin(*values)).select("id").distinct()


def facet_all(facets: DataFrame, facet: str, values: Sequence[str]) -> DataFrame:
    """Ids that have every one of ``values`` (relational division): one grouped pass, whatever their number."""
    wanted = sorted(set(values))
    hits = facets.where((F.col("facet") == facet) & F.col("value").isin(*wanted))
    seen = [F.bool_or(F.col("value") == v) for v in wanted]
    every = seen[0]
    for one in seen[1:]:
        every = every & one
    return hits.groupBy("id").agg(every.alias("__all")).where("__all").select("id")


def facet_and(facets: DataFrame, groups: Mapping[str, Sequence[str]], all_of: Sequence[str] = ()) -> DataFrame:
    """Ids that satisfy every group: OR inside a group, AND across groups, ALL for the facets in ``all_of``."""
    wanted = F.lit(False)
    tests: list[Column] = []
    for facet, values in groups.items():
        in_group = (F.col("facet") == facet) & F.col("value").isin(*values)
        wanted = wanted | in_group
        if facet in all_of:
            tests += [F.bool_or((F.col("facet") == facet) & (F.col("value") == v)) for v in sorted(set(values))]
        else:
            tests.append(F.bool_or(in_group))
    every = tests[0]
    for one in tests[1:]:
        every = every & one
    return facets.where(wanted).groupBy("id").agg(every.alias("__all")).where("__all").select("id")


def vocabulary(facets: DataFrame) -> DataFrame:
    """Documented values with their counts."""
    return facets.groupBy("facet", "value").agg(F.count("*").alias("n"))
