"""Faceted search: a spec becomes one lazy plan of semi joins, bounds, price join, ranking and a bounded page."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalogspark.functions.text import compact, fold
from catalogspark.operators.facets import facet_and
from catalogspark.session import scratch_folder

PAGE_SIZE = 24
RELAX_KEPT = 3
DEFAULT_CURRENCY = "USD"
# Inclusive and strict bounds.
BOUND_OPS = {
    "min": lambda c, v: c >= v, "max": lambda c, v: c <= v, "gt": lambda c, v: c > v, "lt": lambda c, v: c < v,
}
HISTORICAL = "Historical · unverified"


@dataclass(frozen=True)
class SearchSpec:
    """One search: facet groups, numeric bounds ``{(measure, op): value}``, text, price basis, order and page."""

    facets: Mapping[str, Sequence[str]] = field(default_factory=dict)
    all_of: tuple[str, ...] = ("complication",)
    bounds: Mapping[tuple[str, str], float] = field(default_factory=dict)
    q: str = ""
    source: str = "official_retail"
    #: None: not stated. Searches then use ``DEFAULT_CURRENCY``.
    currency: str | None = None
    sort: str = "relevance"
    page: int = 1


def check_spec(spec: SearchSpec) -> list[str]:
    """Messages for bounds whose minimum exceeds the maximum."""
    errors = []
    for measure in sorted({m for m, _ in spec.bounds}):
        low = spec.bounds.get((measure, "min"), spec.bounds.get((measure, "gt")))
        high = spec.bounds.get((measure, "max"), spec.bounds.get((measure, "lt")))
        if low is not None and high is not None and low > high:
            errors.append(f"{measure} minimum exceeds maximum")
    return errors


def effective_spec(explicit: SearchSpec, parsed: SearchSpec) -> SearchSpec:
    """Explicit filters override those read from the query text, but a currency that the text names holds."""
    return replace(
        parsed,
        facets={**parsed.facets, **explicit.facets},
        bounds={**parsed.bounds, **explicit.bounds},
        currency=parsed.currency or explicit.currency, source=explicit.source, sort=explicit.sort, page=explicit.page, all_of=explicit.all_of,
    )


def numeric_predicate(bounds: Mapping[tuple[str, str], float], columns: Mapping[str, Column] | None = None) -> Column:
    """AND of the bounds; null, hence no match, for an unknown measure. Left bare so a filter reaches the scan."""
    tests = [BOUND_OPS[op]((columns or {}).get(measure, F.col(measure)), F.lit(float(value)))
             for (measure, op), value in bounds.items()]
    every = tests[0]
    for one in tests[1:]:
        every = every & one
    return every


def with_price(products: DataFrame, prices: DataFrame, source: str, currency: str | None) -> DataFrame:
    """Left join of the one price fact in the chosen source and currency; the filter is applied before the join."""
    fact = prices.where((F.col("source") == source) & (F.col("currency") == (currency or DEFAULT_CURRENCY)))
    return products.join(fact.select("id", F.col("amount").alias("price")), "id", "left")


def reference_predicate(query: str, key: Column) -> Column:
    """Exact or prefix reference, only when the query holds a digit; a blank key is null and cannot match."""
    wanted = compact(F.lit(query))
    return F.coalesce(wanted.rlike("[0-9]") & key.startswith(wanted), F.lit(False))


def rank_tier(query: Column | str, reference_key: Column, model: Column, collection: Column) -> Column:
    """0 exact reference, 1 reference prefix, 2 exact model or collection, 3 the rest."""
    query = F.lit(query) if isinstance(query, str) else query
    wanted, folded = compact(query), fold(F.trim(query))
    return (
        F.when(reference_key == wanted, 0).when(reference_key.startswith(wanted), 1)
        .when((fold(model) == folded) | (F.lower(collection) == folded), 2).otherwise(3)
    )


def sort_order(sort: str) -> list[Column]:
    """Order of a sort mode. Numeric modes put unknown last both ways; the id always decides ties."""
    orders = {
        "brand": [F.lower("brand").asc(), F.lower("model").asc()],
        "newest": [F.col("captured").desc_nulls_last()],
        "price-asc": [F.col("price").asc_nulls_last()],
        "price-desc": [F.col("price").desc_nulls_last()],
        "diameter-asc": [F.col("diameter").asc_nulls_last()],
        "diameter-desc": [F.col("diameter").desc_nulls_last()],
        # An unscored reference hit leads its tier.
        "relevance": [F.col("tier").asc(), F.col("score").desc_nulls_first()],
        "default": [F.coalesce(F.col("status") == HISTORICAL, F.lit(False)).asc(), F.lower("brand").asc(),
                    F.lower("model").asc()],
    }
    return [*orders[sort], F.col("id").asc()]


@dataclass(frozen=True)
class Ranking:
    """Rows in the order of a search, stored in ranges of that order with the number of rows in each. Any page reads the
    ranges it lies in and nothing else, however deep it is."""

    rows: DataFrame
    order: tuple[Column, ...]
    counts: tuple[tuple[int, int], ...]

    @staticmethod
    def build(df: DataFrame, order: Sequence[Column], path: str) -> Ranking:
        """One sort by ranges. The order must end with a key, so that equal values are split over ranges as well."""
        ranged = df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
        ranged.write.partitionBy("__part").parquet(path)
        rows = df.sparkSession.read.schema(ranged.schema).parquet(path)
        counts = rows.groupBy("__part").agg(F.count("*").alias("n")).orderBy("__part").collect()  # one number per range
        return Ranking(rows, tuple(order), tuple((r["__part"], r["n"]) for r in counts))

    @property
    def total(self) -> int:
        return sum(n for _, n in self.counts)

    def page(self, page: int = 1, size: int = PAGE_SIZE) -> DataFrame:
        """One page with its ``rank``."""
        first, before, touched = (page - 1) * size, 0, {}
        for part, n in self.counts:
            if before < first + size and before + n > first:
                touched[part] = before
            before += n
        here = self.rows.where(F.col("__part").isin(*touched) if touched else F.lit(False))
        offset = F.lit(0)
        for part, n in touched.items():
            offset = F.when(F.col("__part") == part, n).otherwise(offset)
        ranked = here.withColumn("rank", F.row_number().over(Window.partitionBy("__part").orderBy(*self.order)) + offset)
        return ranked.where(F.col("rank").between(first + 1, first + size)).drop("__part")


def page_of(df: DataFrame, order: Sequence[Column], page: int = 1, size: int = PAGE_SIZE) -> DataFrame:
    """One page with its rank. The first page is a distributed top-k, so only its own rows meet in one task; a later one is
    read from a ``Ranking`` in the checkpoint folder. Keep the ranking where several pages are wanted."""
    if page > 1:
        return Ranking.build(df, order, scratch_folder(df.sparkSession, "ranking")).page(page, size)
    rows = df.orderBy(*order).limit(size)
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def page_after(df: DataFrame, order: Sequence[Column], after: Column, size: int = PAGE_SIZE) -> DataFrame:
    """Next page by keyset: ``after`` compares the sort keys with the last row seen, so deep pages cost the same
    as the first."""
    return df.where(after).orderBy(*order).limit(size)


def matches(products: DataFrame, facets: DataFrame, prices: DataFrame, spec: SearchSpec,
            text_scores: DataFrame | None = None) -> DataFrame:
    """All products that satisfy the spec, with ``price``, ``score`` and ``tier``."""
    errors = check_spec(spec)
    if errors:
        raise ValueError("; ".join(errors))
    plain = {k: v for k, v in spec.bounds.items() if k[0] != "price"}
    rows = products.where(numeric_predicate(plain)) if plain else products
    if spec.facets:
        rows = rows.join(facet_and(facets, spec.facets, spec.all_of), "id", "left_semi")
    rows = with_price(rows, prices, spec.source, spec.currency)
    priced = {k: v for k, v in spec.bounds.items() if k[0] == "price"}
    if priced:
        rows = rows.where(numeric_predicate(priced))
    if spec.q and text_scores is None:
        raise ValueError("a text query needs text_scores")
    if spec.q:
        rows = rows.join(text_scores, "id", "left")
        rows = rows.where(F.col("score").isNotNull() | reference_predicate(spec.q, F.col("reference_key")))
        tier = rank_tier(spec.q, F.col("reference_key"), F.col("model"), F.col("collection"))
    else:
        rows, tier = rows.withColumn("score", F.lit(None).cast("double")), F.lit(3)
    return rows.withColumn("tier", tier)


def search(products: DataFrame, facets: DataFrame, prices: DataFrame, spec: SearchSpec,
           text_scores: DataFrame | None = None) -> DataFrame:
    """One ranked page with the total number of matches, as a single job."""
    found = matches(products, facets, prices, spec, text_scores)
    sort = "default" if spec.sort == "relevance" and not spec.q else spec.sort
    return with_total(found, page_of(found, sort_order(sort), spec.page))


def with_total(found: DataFrame, page: DataFrame) -> DataFrame:
    """Attach the total as a scalar subquery: the count is pre-aggregated, the page stays bounded."""
    return page.withColumn("total", found.agg(F.count("*")).scalar())


def by_ids(products: DataFrame, ids: Sequence) -> DataFrame:
    """Full records of some ids; the filter reaches the scan."""
    wanted = list(dict.fromkeys(ids))
    if not wanted:
        raise ValueError("Supply an id")
    return products.where(F.col("id").isin(*wanted))


def relaxations(rows: DataFrame, constraints: Mapping[str, Column], kept: int = RELAX_KEPT) -> DataFrame:
    """(key, ord, n): how many rows would match with one constraint dropped, for the first few that help.

    Empty when the full spec already matches something. All counts come from one pass of conditional
    aggregates, whatever the number of constraints.
    """
    names = list(constraints)
    flags = {f"__c{i}": F.coalesce(constraints[name], F.lit(False)) for i, name in enumerate(names)}
    tested = rows.select(*[c.alias(k) for k, c in flags.items()])

    def others(skip: int) -> Column:
        every = F.lit(True)
        for i in range(len(names)):
            if i != skip:
                every = every & F.col(f"__c{i}")
        return every

    counts = tested.agg(
        F.count_if(others(-1)).alias("__all"),
        *[F.count_if(others(i)).alias(f"__n{i}") for i in range(len(names))],
    )
    found = F.filter(
        F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(names[i]).alias("key"), F.col(f"__n{i}").alias("n"))
                  for i in range(len(names))]),
        lambda x: x["n"] > 0,
    )
    return counts.where(F.col("__all") == 0).select(F.inline(F.slice(found, 1, kept)))


def suggest(brands: DataFrame, found: DataFrame, query: str, aliases: Mapping[str, str]) -> DataFrame:
    """(group, rank, label): 3 brands by prefix or alias, 3 collections by matches, 5 references, and the query itself
    with, if a brand was found, one search within it."""
    query = " ".join(query.split())
    alias = aliases.get(query.lower())
    brand_hit = fold(F.col("brand")).startswith(fold(F.lit(query)))
    if alias:
        brand_hit = brand_hit | (F.col("brand") == alias)

    def top(df: DataFrame, group: str, label: Column, order: Sequence[Column], n: int) -> DataFrame:
        rows = df.orderBy(*order).limit(n).withColumn("rank", F.row_number().over(Window.orderBy(*order)))
        return rows.select(F.lit(group).alias("grp"), "rank", label.alias("label"))

    named = top(brands.where(brand_hit), "Brands", F.col("brand"), [F.col("brand").asc()], 3)
    grouped = found.groupBy("brand", "collection").agg(F.count("*").alias("n"))
    collections = top(grouped, "Collections", F.concat_ws(" ", "brand", "collection"),
                      [F.col("n").desc(), F.col("collection").asc(), F.col("brand").asc()], 3)
    references = top(found, "References", F.concat_ws(" ", "brand", "reference"), sort_order("relevance"), 5)
    whole = brands.sparkSession.range(1).select(F.lit("Suggested searches").alias("grp"), F.lit(1).alias("rank"), F.lit(query).alias("label"))
    narrower = named.where("rank = 1").select(F.lit("Suggested searches").alias("grp"), F.lit(2).alias("rank"),
                                              F.concat("label", F.lit(" watches under 40mm")).alias("label"))
    return named.unionByName(collections).unionByName(references).unionByName(whole).unionByName(narrower)
