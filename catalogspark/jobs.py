"""End-to-end jobs: snapshots to records, records to catalog, catalog to search index."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogspark.functions.records import coverage_pct, missing_fields, record_id, validation_errors
from catalogspark.functions.urls import resolve
from catalogspark.operators import extraction as ex
from catalogspark.operators.json_graph import own_products
from catalogspark.operators.quality import split_quarantine
from catalogspark.operators.reconcile import diff_rows
from catalogspark.schema import COLUMNS, CORE
from catalogspark.sources.writers import overwrite_partitions


def structured_facts(pages: DataFrame, facts: DataFrame) -> DataFrame:
    """Facts of the page's own JSON-LD product: sku, name, description, image, price and currency of a single offer.

    ``pages`` has (page_id, url, reference). The JSON texts and canonical addresses are facts already; only those rows are
    parsed.
    """
    scripts = facts.where((F.col("kind") == "json") & (F.col("label") == "application/ld+json"))
    canonical = facts.where(F.col("kind") == "canonical").groupBy("page_id").agg(F.min_by("value", "ord").alias("canonical"))
    joined = scripts.select("page_id", F.col("value").alias("body")).join(pages, "page_id").join(canonical, "page_id", "left")
    own = own_products(joined, "body", canonical="canonical")

    def text(path: str) -> Column:
        return F.try_variant_get("product", path, "string")

    # One offer object, or a list of exactly one, states a price; several offers select none.
    one = F.coalesce(F.size(F.try_variant_get("offers", "$", "array<variant>")), F.lit(1)) == 1

    def offered(name: str) -> Column:
        return F.when(one, F.coalesce(F.try_variant_get("offers", f"$.{name}", "string"), F.try_variant_get("offers", f"$[0].{name}", "string")))

    price, currency = offered("price"), offered("priceCurrency")
    image = F.coalesce(text("$.image.url"), text("$.image[0].url"), text("$.image[0]"), F.when(F.schema_of_variant(F.try_variant_get("product", "$.image", "variant")) == "STRING", text("$.image")))
    stated = F.array(*[
        F.struct(F.lit(label).alias("label"), value.alias("value"), F.lit(i).alias("ord"))
        for i, (label, value) in enumerate([
            ("reference", text("$.sku")), ("reference", text("$.mpn")), ("model", text("$.name")),
            ("description", text("$.description")), ("image", image), ("price", price), ("currency", currency)])
    ])
    extra = F.transform(
        F.try_variant_get("product", "$.additionalProperty", "array<struct<name:string,value:string>>"),
        lambda p: F.struct(p["name"].alias("label"), p["value"].alias("value"), F.lit(100).alias("ord")))
    rows = own.select("page_id", F.inline(F.concat(stated, F.coalesce(extra, F.array().cast(
        "array<struct<label:string,value:string,ord:int>>")))))
    return rows.where(F.col("value").isNotNull()).select(
        "page_id", F.lit("jsonld").alias("kind"), F.lit("").alias("section"), "label", "value",
        F.concat(F.lit("Product JSON-LD."), "label").alias("locator"), "ord")


def extract_records(pages: DataFrame, mapping: DataFrame, brand: Column, market: Column, language: Column) -> DataFrame:
    """Records of product pages (page_id, url, reference, html, captured_at, source_hash).

    Structured data comes first, then labelled specifications, then the heading; the page's address and reference
    are the adapter's own facts. A description stated by the page's own markup, the meta description (short), and the
    image that the page states for itself fill their columns; images are resolved against the page.
    """
    facts = ex.extract_facts(pages, "page_id", "html")
    keyed = pages.withColumn("page_id", F.col("page_id").cast("string"))
    # Structured facts rank before the page's visible facts: their position is made negative.
    structured = structured_facts(keyed.select("page_id", "url", "reference"), facts).withColumn("ord", F.col("ord") - 1_000_000)
    facts = facts.where(F.col("section") != ex.OUTSIDE)
    visible = facts.where(F.col("kind").isin("spec", "pair"))
    heading = facts.where(F.col("kind") == "h1").withColumn("label", F.lit("model"))
    said = F.when(F.col("kind") == "description", "description").when(F.col("kind") == "meta", F.when(
        F.lower("label") == "description", "short description").when(F.lower("label") == "og:image", "image"))
    stated = facts.withColumn("label", said).where(F.col("label").isNotNull())
    identity = keyed.select(
        "page_id", F.lit("url").alias("kind"), F.lit("").alias("section"), F.lit("reference").alias("label"),
        F.col("reference").alias("value"), F.lit("official URL reference segment").alias("locator"), F.lit(-1).alias("ord"))
    every = structured.unionByName(visible).unionByName(heading).unionByName(stated).unionByName(identity)
    taken = [c for c in COLUMNS if c not in ("brand", "watch_URL")]
    wide = ex.pivot_records(ex.map_fields(every, mapping), taken)
    rows = keyed.select("page_id", F.col("url").alias("watch_URL"), "captured_at", "source_hash").join(wide, "page_id")
    rows = rows.withColumns({"brand": brand, "market": market, "language": language, "image_URL": resolve("watch_URL", "image_URL")})
    rows = rows.withColumn("id", record_id("brand", "reference_number", "watch_URL", "market", "language"))
    return rows.withColumns({
        "missing_fields": missing_fields(COLUMNS), "missing_core_fields": missing_fields(CORE), "coverage": coverage_pct(),
        "validation_errors": validation_errors(),
    })


def accept(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined) by the records' own validation."""
    return split_quarantine(records, "validation_errors")


def publish(records: DataFrame, catalog_path: str, dataset: Column) -> None:
    """Replace the records of their dataset in the catalog, leaving every other dataset's files alone."""
    overwrite_partitions(records.withColumn("dataset", dataset), catalog_path, "dataset")


def reparse_check(saved: DataFrame, rebuilt: DataFrame, columns: Sequence[str] = COLUMNS) -> DataFrame:
    """Fields on which saved records differ from a fresh parse of the same snapshots; empty when the run is sound."""
    return diff_rows(saved, rebuilt, "id", list(columns))


def coverage_by(records: DataFrame, keys: Sequence[str], fields: Mapping[str, Column]) -> DataFrame:
    """Documented share of chosen fields per key."""
    known = [F.round(F.count(c) / F.count("*") * 100).cast("int").alias(name) for name, c in fields.items()]
    return records.groupBy(*keys).agg(F.count("*").alias("records"), *known)
