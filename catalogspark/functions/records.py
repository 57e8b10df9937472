"""Identity, coverage and validation of catalog records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from catalogspark.functions.text import _col
from catalogspark.functions.urls import scheme
from catalogspark.schema import CORE


def record_id(brand: Column | str, reference: Column | str, url: Column | str,
              market: Column | str, language: Column | str) -> Column:
    """First 24 hex digits of the identity hash; markets and languages never merge."""
    def text(c: Column | str) -> Column:
        return F.coalesce(_col(c).cast("string"), F.lit(""))

    page_or_ref = F.when(text(reference) != "", text(reference)).otherwise(text(url))
    identity = F.concat_ws("|", text(brand), page_or_ref, text(market), text(language))
    return F.substring(F.sha2(identity, 256), 1, 24)


def present(c: Column | str) -> Column:
    """Known and not blank."""
    return F.coalesce(F.trim(_col(c).cast("string")) != "", F.lit(False))


def missing_fields(fields: Sequence[str]) -> Column:
    return F.array_compact(F.array(*[F.when(~present(name), F.lit(name)) for name in fields]))


def coverage_pct(fields: Sequence[str] = CORE) -> Column:
    """Share of ``fields`` that are present, as a rounded percentage."""
    known = sum((present(name).cast("int") for name in fields), F.lit(0))
    return F.round(known * 100 / len(fields)).cast("int")


def collect_errors(rules: Mapping[str, Column] | Sequence[tuple[str, Column]]) -> Column:
    """Array of the messages whose failure condition holds; an unknown condition is no failure."""
    pairs = rules.items() if isinstance(rules, Mapping) else rules
    return F.array_compact(F.array(*[F.when(failed, F.lit(message)) for message, failed in pairs]))


def validation_errors(brand: str = "brand", reference: str = "reference_number", model: str = "specific_model",
                      url: str = "watch_URL", diameter: str = "diameter", currency: str = "currency") -> Column:
    """Messages of the record rules: identity present, https source, plausible single diameter, ISO currency."""
    named = {"brand": brand, "reference_number": reference, "specific_model": model, "watch_URL": url}
    rules = [(f"Missing identity field: {label}", ~present(column)) for label, column in named.items()]
    figure = F.regexp_extract(_col(diameter), r"(?i)^(\d+(?:[.,]\d+)?)\s*mm$", 1)
    millimetres = F.replace(figure, F.lit(","), F.lit(".")).try_cast("double")
    rules += [
        ("Source URL must use HTTPS", F.coalesce(scheme(url), F.lit("")) != "https"),
        ("Case diameter outside wristwatch review range", ~millimetres.between(5, 100)),
        ("Currency must be an ISO code", present(currency) & ~_col(currency).rlike("^[A-Z]{3}$")),
    ]
    return collect_errors(rules)


def provenance_matches(provenance: Column | str, row_fields: Sequence[str], url: Column | str) -> Column:
    """Every provenance entry repeats the exported value and the exported page address."""
    exported = F.create_map(*[x for name in row_fields for x in (F.lit(name), F.col(name))])
    return F.forall(
        F.map_entries(_col(provenance)),
        lambda e: e["value"]["value"].eqNullSafe(F.try_element_at(exported, e["key"]))
        & e["value"]["url"].eqNullSafe(_col(url)),
    )
