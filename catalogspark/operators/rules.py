"""Comparison rules: typed conditions with an explicit policy for unknown values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogspark.functions.text import blank_to_null

NUMERIC_OPS = ("lte", "gte", "eq", "between")
TEXT_OPS = ("equals", "contains", "excludes")


@dataclass(frozen=True)
class Field:
    """A comparable field: its kind ('number', 'price' or 'text') and the typed expression to read."""

    name: str
    kind: str
    expr: Column
    currency: Column | None = None


@dataclass(frozen=True)
class Rule:
    field: str
    op: str
    value: str = ""
    value2: str = ""
    currency: str = ""


def validate_rule(rule: Rule, fields: Mapping[str, Field]) -> str | None:
    """Message for a rule that cannot be evaluated, None when it is sound."""
    field = fields.get(rule.field)
    if field is None:
        return f"Unknown field: {rule.field}"
    if rule.op == "known":
        return None
    allowed = TEXT_OPS if field.kind == "text" else NUMERIC_OPS
    if rule.op not in allowed:
        return f"{rule.op} does not apply to a {field.kind} field"
    if field.kind == "text":
        return None if rule.value.strip() else "Enter a value"
    bounds = [rule.value, rule.value2] if rule.op == "between" else [rule.value]
    try:
        numbers = [float(b) for b in bounds]
    except ValueError:
        return "Enter a number"
    if numbers != sorted(numbers):
        return "The minimum exceeds the maximum"
    if field.kind == "price" and not rule.currency:
        return "Choose a currency"
    return None


def validate_rules(rules: Sequence[Rule], fields: Mapping[str, Field]) -> list[str]:
    return [e for e in (validate_rule(r, fields) for r in rules) if e]


def condition(rule: Rule, field: Field) -> Column:
    """The bare condition; null where the field is unknown."""
    c = field.expr
    if field.kind == "text":
        value = F.lower(F.lit(rule.value))
        if rule.op == "equals":
            return F.lower(c) == value
        inside = F.contains(F.lower(c), value)
        return ~inside if rule.op == "excludes" else inside
    low = float(rule.value)
    tests = {"lte": lambda: c <= low, "gte": lambda: c >= low, "eq": lambda: c == low,
             "between": lambda: c.between(low, float(rule.value2))}
    test = tests[rule.op]()
    if field.kind == "price":
        test = test & (field.currency == rule.currency)
    return test


def with_unknown(field: Column, test: Column, allow_unknown: bool) -> Column:
    """Unknown satisfies nothing unless the caller explicitly lets it pass; the result is never null."""
    if allow_unknown:
        return field.isNull() | F.coalesce(test, F.lit(False))
    return field.isNotNull() & F.coalesce(test, F.lit(False))


def rule_predicate(rule: Rule, fields: Mapping[str, Field], allow_unknown: bool = False) -> Column:
    field = fields[rule.field]
    if rule.op == "known":
        return field.expr.isNotNull()
    return with_unknown(field.expr, condition(rule, field), allow_unknown)


def match_rules(df: DataFrame, rules: Sequence[Rule], fields: Mapping[str, Field],
                allow_unknown: bool = False) -> DataFrame:
    """Rows that satisfy every rule; one filter, so typed conditions reach the scan."""
    errors = validate_rules(rules, fields)
    if errors:
        raise ValueError("; ".join(errors))
    for rule in rules:
        field = fields[rule.field]
        if rule.op == "known":
            df = df.where(field.expr.isNotNull())
        elif allow_unknown:
            df = df.where(field.expr.isNull() | condition(rule, field))
        else:
            # A filter drops null anyway, so the bare condition is enough and can be pushed into the scan.
            df = df.where(condition(rule, field))
    return df


def evaluate_rules(df: DataFrame, rules: Sequence[Rule], fields: Mapping[str, Field],
                   allow_unknown: bool = False) -> DataFrame:
    """Add ``passes`` and ``unknown_count`` (rules whose field is unknown) instead of filtering."""
    passes, unknown = F.lit(True), F.lit(0)
    for rule in rules:
        passes = passes & rule_predicate(rule, fields, allow_unknown)
        unknown = unknown + fields[rule.field].expr.isNull().cast("int")
    return df.withColumns({"passes": passes, "unknown_count": unknown})


# What a comparison field reads when the record is silent or uses a placeholder.
DEFAULT_KIND, ARCHIVE_LABEL, NO_MOVEMENT = "Wristwatch", "2023–2024 archive", "Not specified"


def kind_or_default(c: Column | str) -> Column:
    return F.coalesce(blank_to_null(c), F.lit(DEFAULT_KIND))


def captured_or_archive(c: Column | str) -> Column:
    return F.coalesce(blank_to_null(c), F.lit(ARCHIVE_LABEL))


def movement_or_null(c: Column | str) -> Column:
    return F.nullif(blank_to_null(c), F.lit(NO_MOVEMENT))


def list_or_null(c: Column | str) -> Column:
    """An empty list is "not recorded", never "none"."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.size(c) > 0, F.array_join(c, "; "))


def extra_spec(label: str, extra_specs: str = "extra_specs") -> Column:
    """Values of one additional specification, joined; null when the product does not list it."""
    values = F.transform(F.filter(extra_specs, lambda s: s["label"] == label), lambda s: s["value"])
    return F.when(F.size(values) > 0, F.array_join(values, "; "))


def difference_rows(df: DataFrame, shortlist: str, fields: Mapping[str, Column | tuple[Column, Column]]) -> DataFrame:
    """(shortlist, field, differs): unknown against known counts as a difference. An amount is given as (value,
    currency): equal numbers in two currencies differ.

    Values are compared by their minimum and maximum encoding, so each task keeps two strings per field
    instead of a set of values.
    """
    def encoded(value: Column | tuple[Column, Column]) -> Column:
        parts = value if isinstance(value, tuple) else (value,)
        return F.coalesce(F.concat(F.lit("="), F.concat_ws(" ", *[F.coalesce(p.cast("string"), F.lit("?")) for p in parts[1:]]),
                                   F.lit(" "), parts[0].cast("string")), F.lit("?"))

    known = {name: encoded(value) for name, value in fields.items()}
    aggregates = [(F.min(v) != F.max(v)).alias(name) for name, v in known.items()]
    wide = df.groupBy(shortlist).agg(*aggregates)
    return wide.unpivot([shortlist], list(fields), "field", "differs")
