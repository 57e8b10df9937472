"""Catalog integration: refresh, replacement, enrichment and the ordering of the merged catalog."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogspark.functions.text import norm_ref
from catalogspark.operators.ordered import chunked_row_number

VERIFIED, UNVERIFIED = "verified", "unverified"


def match_key(brand: str = "brand", reference: str = "reference") -> Column:
    return F.concat_ws("|", F.col(brand), norm_ref(reference))


def merge_refresh(current: DataFrame, captures: DataFrame, target: Column, fields: Sequence[str],
                  historical: Mapping[str, Column]) -> DataFrame:
    """Refresh the ``target`` rows of the catalog with verified captures.

    A matched target takes the captured ``fields`` and keeps its id; an unmatched target stays as a historical
    record with the ``historical`` expressions applied; an unmatched capture is added. Rows outside the target
    are passed through unjoined. Both inputs carry ``id, brand, reference`` and ``fields``.

    A key that occurs twice on either side fails the job. The check shares the join's partitioning, and it keeps one
    row per key, so even a key with a third of all rows is reported instead of being multiplied.
    """
    rest = current.where(~target)
    old = current.where(target)
    left = _unique_by_key(old, F.struct(*old.columns), "o", "Ambiguous catalog reference ")
    right = _unique_by_key(captures, F.struct("id", "brand", "reference", *fields), "n", "Duplicate refreshed reference ")
    joined = left.join(right, "__k", "full_outer")
    captured, existing = F.col("n").isNotNull(), F.col("o").isNotNull()
    columns = {
        "id": F.coalesce(F.col("o.id"), F.col("n.id")),
        "brand": F.coalesce(F.col("n.brand"), F.col("o.brand")),
        "reference": F.coalesce(F.col("n.reference"), F.col("o.reference")),
    }
    for name in fields:
        columns[name] = F.when(captured, F.col(f"n.{name}")).otherwise(F.col(f"o.{name}"))
    columns["status"] = F.when(captured, VERIFIED).otherwise(UNVERIFIED)
    merged = joined.select(*[c.alias(k) for k, c in columns.items()], (existing & ~captured).alias("__historical"))
    masked = merged.withColumns({
        name: F.when(F.col("__historical"), value).otherwise(F.col(name)) for name, value in historical.items()
    })
    return rest.select(*columns).unionByName(masked.select(*columns))


def _unique_by_key(df: DataFrame, row: Column, out: str, message: str) -> DataFrame:
    grouped = df.groupBy(match_key().alias("__k")).agg(F.count("*").alias("__n"), F.any_value(row).alias("__row"))
    failure = F.raise_error(F.concat(F.lit(message), F.col("__k")))
    return grouped.select("__k", F.when(F.col("__n") == 1, F.col("__row")).otherwise(failure).alias(out))


def ambiguous_keys(df: DataFrame) -> DataFrame:
    """Match keys that more than one row carries; a refresh must not start while there are any."""
    return df.groupBy(match_key().alias("match_key")).agg(F.count("*").alias("n")).where(F.col("n") > 1)


def historical_mask(df: DataFrame, model: str, reference: str, clear: Mapping[str, Column],
                    withhold: Sequence[str]) -> DataFrame:
    """Downgrade a record whose page is gone: ``clear`` fields always go, and when the model's number disagrees
    with the reference the ``withhold`` fields are hidden as well. Identity always survives."""
    number = F.regexp_extract(F.coalesce(F.col(model), F.lit("")), r"\b(\d{4})\b", 1)
    mismatch = (number != "") & (number != F.substring(norm_ref(reference), 1, 4))
    df = df.withColumn("__mismatch", mismatch)
    columns: dict[str, Column] = dict(clear)
    for name in withhold:
        columns[name] = F.when(~F.col("__mismatch"), columns.get(name, F.col(name)))
    columns["identity_status"] = F.when(F.col("__mismatch"), "mismatched").otherwise("not_currently_verified")
    columns["status"] = F.lit(UNVERIFIED)
    return df.withColumns(columns).drop("__mismatch")


def replace_dataset(catalog: DataFrame, imported: DataFrame, dataset: str = "dataset") -> DataFrame:
    """Rows of the imported datasets are replaced as a whole; every other dataset is untouched.

    The dataset ids of an import are few; the anti join broadcasts them only while they are small, by statistics.
    """
    ids = imported.select(dataset).distinct()
    return catalog.join(ids, dataset, "left_anti").unionByName(imported, allowMissingColumns=True)


def require_proof(records: DataFrame, proofs: DataFrame, image: str = "image_url") -> DataFrame:
    """Records that fail the image proof: a stated image must be proven 'working', a missing one must be explained."""
    proven = proofs.select(F.col("url").alias(image), F.col("proof_status"))
    joined = records.join(proven, image, "left")
    broken = F.col(image).isNotNull() & ~F.coalesce(F.col("proof_status") == "working", F.lit(False))
    unexplained = F.col(image).isNull() & ~F.coalesce(F.col("image_status") == "not_published_by_source", F.lit(False))
    reason = F.when(broken, "Unverified image").when(unexplained, "Unexplained missing image")
    return joined.withColumn("violation", reason).where(F.col("violation").isNotNull())


def first_by_priority(facts: DataFrame, keys: Sequence[str], value: str, locator: str, priority: Sequence[str]) -> DataFrame:
    """First non-blank value per key by precedence, with where it was found. Pre-aggregated, no window."""
    known = facts.where(F.trim(F.col(value)) != "")
    best = F.min_by(F.struct(value, locator), F.struct(*priority))
    return known.groupBy(*keys).agg(best.alias("__b")).select(*keys, f"__b.{value}", f"__b.{locator}")


def enrich(sources: DataFrame, keys: Sequence[str], fields: Sequence[str], order: str) -> DataFrame:
    """One row per key; an earlier source wins, a later one fills the blanks."""
    def pick(name: str) -> Column:
        known = F.col(name).isNotNull() & (F.trim(F.col(name).cast("string")) != "")
        return F.min_by(name, F.when(known, F.col(order))).alias(name)

    return sources.groupBy(*keys).agg(*[pick(f) for f in fields], F.count("*").alias("n_sources"))


def dedupe_last(df: DataFrame, keys: Sequence[str], position: str, values: Sequence[str]) -> DataFrame:
    """Last value per key at the first position of that key, like writing into an insertion-ordered map."""
    last = F.max_by(F.struct(*values), F.col(position))
    grouped = df.groupBy(*keys).agg(last.alias("__v"), F.min(position).alias("first_pos"))
    return grouped.select(*keys, "first_pos", "__v.*")


def first_capture(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """First discovered row per key."""
    first = F.min_by(F.struct(*values), F.struct(*order))
    return df.groupBy(*keys).agg(first.alias("__v")).select(*keys, "__v.*")


def latest_state(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Latest version per key."""
    last = F.max_by(F.struct(*values), F.struct(*order))
    return df.groupBy(*keys).agg(last.alias("__v")).select(*keys, "__v.*")


def coalesce_lists(items: DataFrame, key: str, listing: str, order: str, values: Sequence[str]) -> DataFrame:
    """One row per reference with the first item seen and the sorted names of the lists it was found in."""
    pairs = items.groupBy(key, listing).agg(F.min_by(F.struct(*values), order).alias("__v"), F.min(order).alias("__o"))
    grouped = pairs.groupBy(key).agg(
        F.min_by("__v", "__o").alias("__v"), F.array_sort(F.collect_list(listing)).alias("lists")
    )
    return grouped.select(key, "__v.*", "lists")


def curated_order(df: DataFrame, brand: str, brand_rank: Column, verified: Column, order: str, chunk: Column) -> DataFrame:
    """Round-robin over brands: the first of each in brand order, then the second of each, and so on.

    ``round`` and ``brand_rank`` together with ``order`` are the sort key; verified records lead their brand.
    Row numbers inside a hot brand are computed in chunks of ``order``.
    """
    rows = df.withColumns({"__late": (~verified).cast("int"), "brand_rank": brand_rank})
    # Verified rows and the rest are two sequences; the chunk grows through the first, then through the second.
    position = F.struct(F.col("__late"), chunk.alias("c"))
    return chunked_row_number(rows, [brand], ["__late", order], position, "round").drop("__late")


def link_targets(df: DataFrame, id_col: str, urls: Mapping[str, Column]) -> DataFrame:
    """Distinct (url, id, kind) users of every link, long form: a hot url stays spread over many rows."""
    used = F.array(*[F.struct(c.alias("url"), F.lit(kind).alias("kind")) for kind, c in urls.items()])
    rows = df.select(F.col(id_col).alias("id"), F.inline(used))
    return rows.where(F.col("url").isNotNull()).distinct()


def union_distinct(first: DataFrame, second: DataFrame, key: str, order: str) -> DataFrame:
    """Work-list union; a key in both keeps the entry of the first list."""
    tagged = first.withColumn("__l", F.lit(0)).unionByName(second.withColumn("__l", F.lit(1)))
    rest = [c for c in first.columns if c != key]
    return first_capture(tagged, [key], ["__l", order], rest)
