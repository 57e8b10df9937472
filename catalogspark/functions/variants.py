"""Reading values out of embedded JSON kept as VARIANT."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from catalogspark.functions.text import _col


def parse(c: Column | str) -> Column:
    """VARIANT of a JSON text; invalid JSON is null, never an error."""
    return F.try_parse_json(_col(c))


def first_path(v: Column | str, paths: Sequence[str], kind: str = "string") -> Column:
    """First of several paths that holds a value."""
    v = _col(v)
    return F.coalesce(*[F.try_variant_get(v, path, kind) for path in paths])


def cms_value(v: Column | str) -> Column:
    """Display text of a content-management node, whichever wrapper it uses."""
    return first_path(v, ["$.jsonValue.value", "$.fields.Name.value", "$.translation.plainText", "$.plainText",
                          "$.name", "$.value", "$"])


def first_boolean(v: Column | str) -> Column:
    """First explicit boolean of ``values[*].boolean``; three-valued, so absent stays null."""
    flags = F.try_variant_get(_col(v), "$.values", "array<struct<boolean:boolean>>")
    stated = F.filter(F.transform(flags, lambda x: x["boolean"]), lambda b: b.isNotNull())
    return F.get(stated, 0)
