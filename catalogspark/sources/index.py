"""Derived search projection: wide index, facet relation, price facts and text postings from one catalog scan."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogspark.functions.text import compact, fold
from catalogspark.operators.facets import build_facets
from catalogspark.operators.text_search import build_doc_stats, build_postings

OFFICIAL, RECORDED = "official_retail", "recorded_catalog"


def price_source(source_kind: Column | str) -> Column:
    """Where a catalog price comes from: the manufacturer's own catalog or an archive record."""
    c = F.col(source_kind) if isinstance(source_kind, str) else source_kind
    return F.when(c == "Official catalog", OFFICIAL).otherwise(RECORDED)


def build_prices(df: DataFrame, id_col: str, source: Column, currency: Column, amount: Column, captured: Column) -> DataFrame:
    """Price facts with the table's check applied: positive finite amount and an ISO currency."""
    rows = df.select(F.col(id_col).alias("id"), source.alias("source"), currency.alias("currency"),
                     amount.cast("double").alias("amount"), captured.alias("captured"))
    finite = ~F.isnan("amount") & (F.col("amount") > 0) & (F.col("amount") < float("inf"))
    return rows.where(finite & F.col("currency").rlike("^[A-Z]{3}$"))


@dataclass(frozen=True)
class SearchIndex:
    products: DataFrame
    facets: DataFrame
    prices: DataFrame
    postings: DataFrame
    doc_stats: DataFrame

    def write(self, path: str) -> None:
        """Laid out for pruning: facets by facet, prices and postings sorted so row-group statistics skip. The id ends
        every range key, so a value that a third of the catalog shares is still split over many tasks and files."""
        self.products.write.mode("overwrite").parquet(f"{path}/products")
        facets = self.facets.repartitionByRange("facet", "value", "id").sortWithinPartitions("facet", "value", "id")
        facets.write.mode("overwrite").partitionBy("facet").parquet(f"{path}/facets")
        self.prices.repartitionByRange("source", "currency", "amount", "id").sortWithinPartitions(
            "source", "currency", "amount", "id").write.mode("overwrite").parquet(f"{path}/prices")
        self.postings.repartitionByRange("term", "id").sortWithinPartitions("term", "id").write.mode(
            "overwrite").parquet(f"{path}/postings")
        spark = self.products.sparkSession
        lengths = spark.read.parquet(f"{path}/postings").groupBy("id").agg(F.sum("tf").cast("int").alias("length"))
        ids = spark.read.parquet(f"{path}/products").select("id")
        ids.join(lengths, "id", "left").select("id", F.coalesce("length", F.lit(0)).alias("length")).write.mode("overwrite").parquet(f"{path}/doc_stats")

    @staticmethod
    def read(spark, path: str) -> SearchIndex:
        names = ("products", "facets", "prices", "postings", "doc_stats")
        return SearchIndex(*[spark.read.parquet(f"{path}/{name}") for name in names])


def with_keys(df: DataFrame, reference: str = "reference", model: str = "model") -> DataFrame:
    return df.withColumns({"reference_key": compact(reference), "model_key": fold(model)})


def card(df: DataFrame) -> DataFrame:
    """Light projection for result pages: long text and image lists stay unread."""
    heavy = ("description", "short_description", "image_urls", "extra_specs", "raw")
    return df.drop(*[c for c in heavy if c in df.columns])


def build_index(products: DataFrame, facets: Mapping[str, Column], prices: DataFrame, text: Mapping[str, Column],
                only: Column | None = None) -> SearchIndex:
    """All derived relations of the searchable products (``only`` excludes other catalog items)."""
    rows = with_keys(products if only is None else products.where(only))
    return SearchIndex(
        card(rows), build_facets(rows, "id", facets), prices.join(rows.select("id"), "id", "left_semi"),
        build_postings(rows, "id", text), build_doc_stats(rows, "id", text))


def bootstrap(products: DataFrame, brands: list[str], image: str = "image_url") -> DataFrame:
    """One featured product per showcase brand: the first with an image, in brand order."""
    shown = products.where(F.col("brand").isin(*brands) & F.col(image).isNotNull())
    rows = shown.groupBy("brand").agg(F.min_by(F.struct(*[c for c in products.columns if c != "brand"]), "id").alias("p"))
    position = F.array_position(F.array(*[F.lit(b) for b in brands]), F.col("brand"))
    return rows.select("brand", position.alias("position"), "p.*")


def scale_up(df: DataFrame, copies: int, id_col: str = "id") -> DataFrame:
    """Synthetic copies of template rows for load tests; each row explodes in place, so nothing is shuffled."""
    numbered = df.withColumn("__n", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    return numbered.withColumn(id_col, F.concat(F.col(id_col), F.lit("-synthetic-"), F.col("__n"))).drop("__n")
