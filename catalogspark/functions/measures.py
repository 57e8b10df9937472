"""Measurements: one stated figure becomes a number, anything ambiguous stays unknown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from catalogspark.functions.text import _col

# Spellings accepted per unit.
UNITS = {
    "mm": r"mm|millimet(?:er|re)s?",
    "h": r"h|hrs?|hours?",
    "g": r"g|grams?",
    "m": r"m|met(?:er|re)s?",
}


def measure(c: Column | str, unit: str) -> Column:
    """Single ``N unit`` figure. Ranges, ``a x b``, diagonals, other units and bare numbers give null."""
    pattern = rf"(?i)^\s*(?:approx(?:imately|\.)?\s+|circa\s+|about\s+)?(\d+(?:[.,]\d+)?)\s*(?:{UNITS[unit]})\.?\s*$"
    figure = F.regexp_extract(_col(c), pattern, 1)
    return F.replace(figure, F.lit(","), F.lit(".")).try_cast("double")


def water_metres(c: Column | str) -> Column:
    """Water rating in metres: bar/ATM x 10, else the first metric figure, 0 when denied, null when not stated."""
    c = _col(c)
    plain = F.regexp_replace(c, r"(?<=\d),(?=\d{3})", "")
    bars = F.regexp_extract(plain, r"(?i)(\d+(?:\.\d+)?)\s*(?:bars?|atm)\b", 1).try_cast("double")
    metres = F.regexp_extract(plain, r"(?i)(\d+(?:\.\d+)?)\s*(?:m|met(?:er|re)s?)\b", 1).try_cast("double")
    return F.when(c.rlike(r"(?i)\bnot water[- ]?resistant\b"), F.lit(0.0)).otherwise(F.coalesce(bars * 10, metres))


def frequency_hz(c: Column | str) -> Column:
    """Hz as stated, or vibrations per hour / 7200; null when both are stated and disagree."""
    plain = F.regexp_replace(_col(c), r"(?<=\d)[,' ](?=\d{3})", "")
    hertz = F.regexp_extract(plain, r"(?i)(\d+(?:\.\d+)?)\s*hz\b", 1).try_cast("double")
    vibrations = F.regexp_extract(
        plain, r"(?i)(\d+(?:\.\d+)?)\s*(?:vph|v/h|a/h|(?:semi-?)?(?:vibrations|oscillations)(?:\s+per\s+|/)h(?:our)?)", 1
    ).try_cast("double") / 7200
    agree = hertz.isNull() | vibrations.isNull() | (F.abs(hertz - vibrations) < 1e-9)
    return F.when(agree, F.coalesce(hertz, vibrations))


def diameter_mm(c: Column | str, eligible: Column | None = None) -> Column:
    """Diameter usable for comparison; pass ``eligible`` = False for pocket pieces and diagonal measures."""
    value = measure(c, "mm")
    return value if eligible is None else F.when(F.coalesce(eligible, F.lit(True)), value)
