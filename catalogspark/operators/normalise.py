"""Raw records to comparable products: measures, classes and facets, with unknown kept unknown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogspark.functions.dates import local_date
from catalogspark.functions.measures import diameter_mm, frequency_hz, measure, water_metres
from catalogspark.functions.money import grouped_price
from catalogspark.functions.records import coverage_pct
from catalogspark.functions.terms import MATERIALS, classify_segment, stated_terms, term_extract, whole_words
from catalogspark.functions.text import blank_to_null, fold

# Movement families and the wording that proves each.
MOVEMENTS = (("Automatic", r"automatic|self-winding"), ("Manual winding", r"manual|hand-wound|hand-winding"), ("Quartz", r"quartz"))
# Complications stated by features or model names.
COMPLICATIONS = (
    ("GMT", "gmt"), ("Chronograph", "chrono(?:graph)?"), ("Date", "date"), ("Tourbillon", "tourbillon"),
    ("Perpetual calendar", "perpetual calendar"), ("Annual calendar", "annual calendar"), ("Moon phase", "moon[- ]?phase"),
    ("Flyback", "flyback"), ("Minute repeater", "minute repeat(?:er|ing)"), ("World time", "world ?time"),
    ("Alarm", "alarm"),
)
# Dial colours, and the parts of a dial whose colour is not the dial's.
DIAL_COLOURS = ("Black", "Blue", "Green", "White", "Silver", "Grey", "Brown", "Red", "Yellow", "Pink", "Purple", "Beige")
NOT_THE_DIAL = r"(?i)hands?\b|marker|counter|subdial|appliqu|bezel|\bgold\b|\bsteel\b|\bplatinum\b"
# Gemstones named in settings.
GEMSTONES = (("Diamond", "diamonds?"), ("Ruby", "rub(?:y|ies)"), ("Emerald", "emeralds?"), ("Sapphire", "sapphires"))
POCKET, WRIST = "Pocket watch", "Wristwatch"


def movement_family(movement: Column) -> Column:
    result = F.lit(None).cast("string")
    for name, pattern in reversed(MOVEMENTS):
        result = F.when(movement.rlike(f"(?i){pattern}"), name).otherwise(result)
    return result


def dial_facet(dial: Column) -> Column:
    """Colours of clauses that speak of the dial itself."""
    clauses = F.filter(F.split(dial, "[,;.]"), lambda c: ~c.rlike(NOT_THE_DIAL))
    found = [F.when(F.exists(clauses, _names(colour)), F.lit(colour)) for colour in DIAL_COLOURS]
    return F.coalesce(F.array_compact(F.array(*found)), F.array().cast("array<string>"))


def _names(colour: str):
    return lambda clause: clause.rlike(whole_words(colour))


def watch_kind(subtype: Column) -> Column:
    return F.when(subtype.rlike(r"(?i)pocket\s*watch"), POCKET).otherwise(WRIST)


def diameter_eligible(kind: Column, display: Column) -> Column:
    """Only a wristwatch's own diameter is comparable; pocket pieces and diagonals are not."""
    return (kind != POCKET) & ~F.coalesce(display.rlike("(?i)diagonal|width"), F.lit(False))


def gemstones(setting: Column) -> Column:
    """Stones named by the selected product's setting; sapphire crystal is glass, not a stone."""
    return F.coalesce(term_extract(setting, [(n, whole_words(p)) for n, p in GEMSTONES], {}), F.array().cast("array<string>"))


def optional(df: DataFrame, name: str, kind: str = "string") -> Column:
    """A column a source may not publish at all."""
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def normalise_records(df: DataFrame) -> DataFrame:
    """Catalog row of a source record: local capture date, price, movement family, segment, stones, kind."""
    text = F.concat_ws("; ", "specific_model", optional(df, "features"))
    kind = watch_kind(optional(df, "subtype"))
    return df.withColumns({
        "captured_date": local_date("captured_at"),
        "price_value": grouped_price(optional(df, "price")),
        "movement_family": F.coalesce(movement_family(F.col("movement")), F.lit("Not specified")),
        "segment": classify_segment(fold(text)),
        "watch_kind": kind,
        "gemstones": gemstones(optional(df, "gem_setting")),
        "diameter_metric_eligible": diameter_eligible(kind, optional(df, "case_dimensions_display")),
    }).withColumns({
        "gem_set": F.size("gemstones") > 0,
        "diameter_mm": diameter_mm("diameter", F.col("diameter_metric_eligible")),
        "is_watch": F.lit(True),
    })


def searchable(df: DataFrame) -> DataFrame:
    """Measures and facet arrays of the search projection, from raw record columns."""
    eligible = optional(df, "diameter_metric_eligible", "boolean")
    return df.withColumns({
        "brand": F.col("brand"), "collection": F.coalesce("collection_label", F.lit("")),
        "model": F.coalesce("specific_model", F.lit("")), "reference": blank_to_null("reference_number"),
        "diameter_text": F.col("diameter"),
    }).withColumns({
        "diameter": diameter_mm("diameter_text", eligible),
        "thickness": measure("case_thickness", "mm"),
        "water": water_metres("water_resistance"),
        "reserve": measure("power_reserve", "h"),
        "frequency_hz": frequency_hz(optional(df, "frequency")),
        "status": optional(df, "status"),
        "material_facet": term_extract(F.coalesce("case_material", F.lit(""))),
        "movement_facet": F.array_compact(F.array(movement_family(F.coalesce("movement_family", "movement")))),
        "complication_facet": stated_terms(
            F.concat_ws("; ", "features", "specific_model"), [(n, whole_words(p)) for n, p in COMPLICATIONS]),
        "dial_facet": dial_facet(optional(df, "dial_color")),
    })


def facet_columns() -> dict[str, Column]:
    return {"brand": F.array("brand"), "collection": F.array("collection"), "material": F.col("material_facet"),
            "movement": F.col("movement_facet"), "complication": F.col("complication_facet"), "dial": F.col("dial_facet")}


def text_columns(df: DataFrame) -> dict[str, Column]:
    """The five weighted text fields of a product."""
    def joined(*names: str) -> Column:
        return F.concat_ws(" ", *[F.col(n) for n in names if n in df.columns])

    return {
        "identity": joined("brand", "collection_label", "parent_model", "specific_model"),
        "reference_key": F.coalesce("reference_key", F.lit("")), "aliases": joined("aliases"),
        "specs": joined("case_material", "dial_color", "movement", "caliber", "features"),
        "content": joined("marketing_name", "nickname", "short_description", "description"),
    }


def with_coverage(df: DataFrame) -> DataFrame:
    return df.withColumn("coverage", coverage_pct())


__all__ = ["MATERIALS", "normalise_records", "searchable", "facet_columns", "text_columns", "with_coverage"]
