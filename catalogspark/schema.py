"""Fixed record schema: column order, core fields and the nested extras of a product record."""

from __future__ import annotations

from pyspark.sql import types as T

# The published 40-column export order.
COLUMNS: tuple[str, ...] = (
    "reference_number", "watch_URL", "type", "brand", "year_introduced", "parent_model", "specific_model",
    "nickname", "marketing_name", "style", "currency", "price", "image_URL", "made_in", "case_shape",
    "case_material", "case_finish", "caseback", "diameter", "between_lugs", "lug_to_lug", "case_thickness",
    "bezel_material", "bezel_color", "crystal", "water_resistance", "weight", "dial_color", "numerals",
    "bracelet_material", "bracelet_color", "clasp_type", "movement", "caliber", "power_reserve", "frequency",
    "jewels", "features", "short_description", "description",
)

# The ten fields that make up the coverage percentage.
CORE: tuple[str, ...] = (
    "reference_number", "watch_URL", "parent_model", "case_material", "diameter", "movement",
    "water_resistance", "power_reserve", "dial_color", "image_URL",
)

FLAT_SCHEMA = T.StructType([T.StructField(name, T.StringType()) for name in COLUMNS])

PROVENANCE = T.MapType(
    T.StringType(),
    T.StructType([
        T.StructField("url", T.StringType()),
        T.StructField("locator", T.StringType()),
        T.StructField("value", T.StringType()),
    ]),
)

RECORD_SCHEMA = T.StructType(
    FLAT_SCHEMA.fields
    + [
        T.StructField("id", T.StringType()),
        T.StructField("schema_version", T.LongType()),
        T.StructField("market", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("captured_at", T.StringType()),
        T.StructField("source_hash", T.StringType()),
        T.StructField("coverage", T.LongType()),
        T.StructField("image_urls", T.ArrayType(T.StringType())),
        T.StructField("missing_fields", T.ArrayType(T.StringType())),
        T.StructField("extraction_warnings", T.ArrayType(T.StringType())),
        T.StructField("validation_errors", T.ArrayType(T.StringType())),
        T.StructField("provenance", PROVENANCE),
    ]
)

FACT_SCHEMA = T.StructType([
    T.StructField("page_id", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("section", T.StringType()),
    T.StructField("label", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("locator", T.StringType()),
    T.StructField("ord", T.IntegerType()),
])
