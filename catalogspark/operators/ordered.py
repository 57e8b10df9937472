"""Ordered operators that never put a whole key into one task.

A plain ``Window.partitionBy(key).orderBy(...)`` sends every row of a key to one task, and one key may hold a third
of the table. Here each key is cut into chunks by a monotone function of its ordering (a day, an id range, a value
bucket). The window runs inside (key, chunk); one summary row per chunk carries the state across chunk borders and
is joined back on (key, chunk).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_KEY = "__key"


def _name(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _keyed(df: DataFrame, keys: Sequence[str], chunk: Column) -> DataFrame:
    """Pack keys and chunk into one struct. A struct is never null itself, so rows with an unknown key or position
    form a group of their own in windows, aggregates and joins alike, and none is lost in the join back."""
    return df.withColumn(_KEY, F.struct(*keys, chunk.alias("__chunk")))


def _within(order: Sequence[Column | str]) -> Window:
    return Window.partitionBy(_KEY).orderBy(*[_name(o) for o in order])


def _across(keys: Sequence[str]) -> Window:
    return Window.partitionBy(*[F.col(f"{_KEY}.{k}") for k in keys]).orderBy(f"{_KEY}.__chunk")


def _position(order: Sequence[Column | str]) -> Column:
    return F.struct(*[_name(o) for o in order])


def chunked_lag(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column,
                values: dict[str, str]) -> DataFrame:
    """Add ``out`` = previous row's ``column`` for each ``{out: column}``, within ``keys`` by ``order``.

    ``chunk`` must not decrease along ``order``. A null from the previous row stays null.
    """
    carried = F.struct(*[F.col(source).alias(out) for out, source in values.items()])
    rows = _keyed(df, keys, chunk).withColumn("__prev", F.lag(carried).over(_within(order)))
    ends = rows.groupBy(_KEY).agg(F.max_by(carried, _position(order)).alias("__end"))
    borders = ends.select(_KEY, F.lag("__end").over(_across(keys)).alias("__border"))
    # A struct from lag is null only on the first row of a chunk; its fields may be null on any row.
    previous = F.coalesce("__prev", "__border")
    return rows.join(borders, _KEY).select(*df.columns, *[previous[out].alias(out) for out in values])


def chunked_last_known(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column,
                       values: dict[str, Column], known: Column) -> DataFrame:
    """Add, per row, the ``values`` of the latest strictly earlier row on which ``known`` holds (an as-of lookup)."""
    state = F.struct(*[c.alias(out) for out, c in values.items()])
    rows = _keyed(df, keys, chunk).withColumn("__state", F.when(known, state))
    before = _within(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__inside", F.last("__state", ignorenulls=True).over(before))
    ends = rows.groupBy(_KEY).agg(
        F.max_by("__state", F.when(F.col("__state").isNotNull(), _position(order))).alias("__end")
    )
    earlier = _across(keys).rowsBetween(Window.unboundedPreceding, -1)
    borders = ends.select(_KEY, F.last("__end", ignorenulls=True).over(earlier).alias("__border"))
    found = F.coalesce("__inside", "__border")
    return rows.join(borders, _KEY).select(*df.columns, *[found[out].alias(out) for out in values])


def chunked_running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], chunk: Column,
                        value: Column, out: str) -> DataFrame:
    """Add the running sum of ``value`` up to and including each row."""
    upto = _within(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = _keyed(df, keys, chunk).withColumn("__value", value)
    rows = rows.withColumn("__inside", F.sum("__value").over(upto))
    totals = rows.groupBy(_KEY).agg(F.sum("__value").alias("__total"))
    earlier = _across(keys).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(_KEY, F.coalesce(F.sum("__total").over(earlier), F.lit(0)).alias("__offset"))
    return rows.join(offsets, _KEY).select(*df.columns, (F.col("__inside") + F.col("__offset")).alias(out))


def chunked_row_number(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], chunk: Column,
                       out: str = "rn") -> DataFrame:
    """Add an exact 1-based row number within ``keys``."""
    return chunked_running_sum(df, keys, order, chunk, F.lit(1).cast("long"), out)


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, out: str = "rank") -> DataFrame:
    """First ``n`` rows per key. Spark trims each task to ``n`` rows per key before the shuffle
    (WindowGroupLimit), so a hot key ships at most ``n`` rows per map task."""
    ranked = df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col(out) <= n)


def nth_border(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int, out: str) -> DataFrame:
    """(keys, ``out``): position (struct of ``order``) of the n-th row of every group that has more rows than n. Each task
    ships at most n + 1 rows of a group, so a group's size does not matter."""
    first = top_per_key(df.select(*keys, *order), keys, [F.col(o).asc() for o in order], n + 1, "__nth")
    cut = F.max_by(_position(order), F.when(F.col("__nth") <= n, F.col("__nth")))
    return first.groupBy(*keys).agg(cut.alias(out), F.count("*").alias("__n")).where(F.col("__n") > n).drop("__n")


def split_chunks(df: DataFrame, keys: Sequence[str], position: Column, chunk: Column, rows: int = 1_000_000,
                 parts: int = 1000, out: str = "__part") -> DataFrame:
    """Add ``out``, a finer chunk for the ordered operators: (chunk, part). Chunks of a key beyond ``rows`` rows are cut at
    the quantiles of the numeric ``position`` (mergeable sketches, one row per chunk), so a chunk's part holds about
    one ``parts``-th of its rows; rows at one and the same position stay together."""
    keyed = df.withColumns({"__at": position, "__g": F.struct(*keys, chunk.alias("__c"))})
    large = keyed.groupBy("__g").agg(F.count("*").alias("__n")).where(F.col("__n") > rows).select("__g")
    # Only rows of large chunks are sketched.
    shares = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    cuts = keyed.join(large, "__g", "left_semi").groupBy("__g").agg(F.percentile_approx("__at", shares, 10 * parts).alias("__cuts"))
    joined = keyed.join(cuts, "__g", "left")
    part = F.when(F.col("__cuts").isNull(), 0).otherwise(_below(F.col("__cuts"), F.col("__at"), parts))
    return joined.select(*df.columns, F.struct(F.col("__g.__c").alias("chunk"), part.alias("part")).alias(out))


def _below(cuts: Column, value: Column, most: int) -> Column:
    """How many of the ascending ``cuts`` (fewer than ``most``) are below ``value``: binary search."""
    steps = F.array(*[F.lit(1 << i) for i in range(most.bit_length() - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(
        (at + step <= F.size(cuts)) & F.coalesce(F.get(cuts, at + step - 1) < value, F.lit(False)), at + step).otherwise(at))


def upper_median(df: DataFrame, keys: Sequence[str], value: str, bucket: Column) -> DataFrame:
    """Exact element at index n // 2 of the sorted values, and the maximum, per key.

    Equal values are counted first, so the ranking step sees distinct values only; ``bucket`` is a monotone
    function of ``value`` that cuts a key into chunks.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__n"))
    running = chunked_running_sum(counts, keys, [value], bucket, F.col("__n"), "__upto")
    group = F.struct(*keys).alias("__group")
    totals = counts.groupBy(group).agg(F.sum("__n").alias("n"), F.max(value).alias("max_value"))
    middle = F.floor(F.col("n") / 2)
    picked = running.withColumn("__group", group).join(totals, "__group").where(
        middle.between(F.col("__upto") - F.col("__n"), F.col("__upto") - 1))
    return picked.select(*keys, "n", F.col(value).alias("median_value"), "max_value")
