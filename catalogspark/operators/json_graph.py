"""Objects of nested JSON at any depth, and JSON-LD products that are their page's own."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogspark.functions.text import norm_ref
from catalogspark.functions.urls import resolve, url_key
from catalogspark.session import scratch_folder

#: Containers, by the type that a VARIANT states of itself.
_CONTAINER = r"^(?:OBJECT|ARRAY)\b"


def json_walk(rows: DataFrame, keys: Sequence[str], body: str) -> DataFrame:
    """(keys, path, key, node VARIANT, depth) of every object inside the JSON texts of ``rows``, at any depth.

    Level by level: a level's containers are written once and their members are the next one's rows, so every container is
    written once and no depth is assumed. ``path`` names members as '$.a[0].b'; ``key`` is the name under which an object
    stands, or that of its array. Invalid JSON has no object.
    """
    spark = rows.sparkSession
    folder = scratch_folder(spark, "json")
    level = rows.select(*keys, F.lit("$").alias("path"), F.lit("").alias("key"), F.try_parse_json(body).alias("node"))
    for depth in count():
        level.where(F.schema_of_variant("node").rlike(_CONTAINER)).write.parquet(f"{folder}/depth={depth}")
        stored = spark.read.schema(level.schema).parquet(f"{folder}/depth={depth}")
        if stored.isEmpty():
            every = spark.read.schema(level.schema.add("depth", "integer")).parquet(folder)
            return every.where(F.schema_of_variant("node").startswith("OBJECT"))
        member = F.when(F.col("m.key").isNull(), F.concat(F.lit("["), F.col("m.pos"), F.lit("]"))).otherwise(F.concat(F.lit("."), F.col("m.key")))
        members = stored.alias("r").lateralJoin(spark.tvf.variant_explode(F.col("r.node").outer()).alias("m"))
        level = members.select(*[F.col(f"r.{k}").alias(k) for k in keys], F.concat("r.path", member).alias("path"),
                               F.coalesce("m.key", "r.key").alias("key"), F.col("m.value").alias("node"))


def _text(path: str) -> Column:
    return F.try_variant_get("node", path, "string")


def types(node: str = "node") -> Column:
    """Exact types of a JSON-LD node, one or several, without a vocabulary address before them."""
    listed = F.try_variant_get(node, "$['@type']", "array<string>")
    stated = F.coalesce(listed, F.array_compact(F.array(F.try_variant_get(node, "$['@type']", "string"))))
    return F.transform(stated, lambda t: F.regexp_replace(t, "^(?:https?://schema\\.org/|schema:)", ""))


def own_products(pages: DataFrame, body: str, key: str = "page_id", canonical: str | None = None) -> DataFrame:
    """(key, path, product VARIANT, offers VARIANT) of JSON-LD products that are their page's own, at any depth.

    ``pages`` has the key, url, reference and the JSON text ``body``, and may have a ``canonical`` address; a page may have several
    texts. A product is own if its address, resolved against the page, is the page's or its canonical one, or if it
    states no address and its sku (or mpn) is the page's reference. Related products are out, and so are kinds of other names such as
    ProductGroup. A product that stands elsewhere in the page as a mere reference is found where it is described, by
    its ``@id``; so are its offers.
    """
    addresses = pages.groupBy(key).agg(F.first("url", ignorenulls=True).alias("url"), F.first("reference", ignorenulls=True).alias("reference"),
                                       (F.first(canonical, ignorenulls=True) if canonical else F.lit(None).cast("string")).alias("canonical"))
    nodes = json_walk(pages, [key], body).withColumn("node_id", _text("$['@id']"))
    described = nodes.where(F.size(F.map_keys(F.try_variant_get("node", "$", "map<string,variant>"))) > 1)
    products = described.where(F.array_contains(types(), "Product")).join(addresses, key)
    link = F.coalesce(_text("$.url"), _text("$['@id']"))
    # The canonical address counts if it is of the page's own site.
    own_site = F.substring_index(resolve("url", "canonical"), "/", 3) == F.substring_index("url", "/", 3)
    target = url_key(resolve("url", link))
    own = (target == url_key("url")) | (own_site & (target == url_key(resolve("url", "canonical"))))
    same = link.isNull() & (norm_ref(F.coalesce(_text("$.sku"), _text("$.mpn"))) == norm_ref("reference")) & (norm_ref("reference") != "")
    chosen = products.where(F.coalesce(own, F.lit(False)) | F.coalesce(same, F.lit(False)))
    chosen = chosen.select(key, "path", F.col("node").alias("product"), F.try_variant_get("node", "$.offers", "variant").alias("stated"),
                           F.try_variant_get("node", "$.offers['@id']", "string").alias("node_id"))
    # One description per @id: the first by path.
    by_id = described.where("node_id is not null").groupBy(key, "node_id").agg(F.min_by(F.to_json("node"), "path").alias("text"))
    offers = by_id.select(key, "node_id", F.try_parse_json("text").alias("found"))
    joined = chosen.join(offers, [key, "node_id"], "left")
    return joined.select(key, "path", "product", F.coalesce("found", "stated").alias("offers"))
