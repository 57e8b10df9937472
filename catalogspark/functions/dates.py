"""Dates. The clock is always an argument, so results are repeatable."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from catalogspark.functions.text import _col

COLLECTION_ZONE = "Asia/Kolkata"


def local_date(ts: Column | str, zone: str = COLLECTION_ZONE) -> Column:
    """Calendar date of a UTC instant in the collection's time zone."""
    return F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(zone), _col(ts).cast("timestamp_ntz")))


def _parse(c: Column, fmt: str) -> Column:
    return F.try_to_timestamp(c, F.lit(fmt)).cast("timestamp_ntz")


def _whole(c: Column, pattern: str, fmt: str) -> Column:
    return F.when(c.rlike(pattern), _parse(c, fmt))


def reported_date(raw: Column | str, now: Column) -> Column:
    """Date a search hit claims: relative ages, ISO dates or month names. Never the future, never a bare year."""
    c = F.trim(_col(raw))
    now = now.cast("timestamp_ntz")
    words = F.split(F.lower(c), r"\s+")
    unit = F.regexp_replace(F.get(words, 1), "s$", "")
    hours = F.create_map(*[F.lit(x) for pair in
                           {"hour": 1, "day": 24, "week": 168, "month": 720, "year": 8760}.items() for x in pair])
    age = F.get(words, 0).try_cast("int") * F.try_element_at(hours, unit)
    is_age = F.lower(c).endswith("ago") & (F.size(words) == 3) & F.get(words, 0).rlike(r"^\d+$")
    # Only the first three letters of a month name count.
    month_first = r"^([A-Z][a-z]{2})[a-z]* (\d{1,2}),? (\d{4})$"
    day_first = r"^(\d{1,2}) ([A-Z][a-z]{2})[a-z]* (\d{4})$"
    named = F.regexp_replace(F.regexp_replace(c, day_first, "$2 $1 $3"), month_first, "$1 $2 $3")
    stated = (
        F.when(is_age, now - F.make_dt_interval(hours=age))
        .when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), _parse(c, "yyyy-MM-dd"))
        .when(named.rlike(r"^[A-Z][a-z]{2} \d{1,2} \d{4}$"), _parse(named, "MMM d yyyy"))
    )
    return F.when(stated <= now, F.to_date(stated))


def launch_year(c: Column | str) -> Column:
    """Year of a launch date printed as dd.MM.yyyy, yyyy-MM-dd or dd/MM/yyyy."""
    c = F.trim(_col(c))
    return F.year(F.coalesce(
        _whole(c, r"^\d{1,2}\.\d{1,2}\.\d{4}$", "d.M.yyyy"),
        _whole(c, r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
        _whole(c, r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
    ))


def is_active(available: Column | str, run_out: Column | str, as_of: Column) -> Column:
    """Open-ended availability: started by ``as_of`` (or no start) and not yet run out."""
    available, run_out = _col(available), _col(run_out)
    return (available.isNull() | (available <= as_of)) & (run_out.isNull() | (run_out > as_of))
