"""Operators that accept a batch or a streaming log. Columns: ``key``, ``ts`` (timestamp), plus what each names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogspark.operators.ordered import chunked_lag, chunked_last_known, nth_border

WATERMARK = "10 minutes"
# Limits and lifetimes of the lookup service.
LOOKUPS_PER_MINUTE, BUDGET_PER_MINUTE = 6, 30
FOUND_TTL_S, NOT_FOUND_TTL_S, RETAINED_S = 6 * 3600, 15 * 60, 7 * 86400
MIN_RETRY_S, DEFAULT_RETRY_S = 60, 3600


def event_time(df: DataFrame, ts: str = "ts", watermark: str | None = WATERMARK) -> DataFrame:
    """Log timestamps carry no zone: read them as UTC instants, which a watermark requires."""
    rows = df.withColumn(ts, F.col(ts).cast("timestamp"))
    return rows.withWatermark(ts, watermark) if watermark and df.isStreaming else rows


def micros(ts: str = "ts") -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def not_from_future(df: DataFrame, now: Column, ts: str = "ts") -> DataFrame:
    """Evidence dated after the clock is refused before it can move the watermark."""
    return df.where(F.col(ts) <= now)


def rate_windows(df: DataFrame, key: str, period: str, limit: int, ts: str = "ts") -> DataFrame:
    """(key, window_start, n, over_limit) of a fixed-window limiter; streaming and batch."""
    grouped = df.groupBy(F.col(key), F.window(ts, period).alias("w")).agg(F.count("*").alias("n"))
    return grouped.select(key, F.col("w.start").alias("window_start"), "n",
                          F.greatest(F.col("n") - limit, F.lit(0)).alias("over_limit"))


def rate_limited(df: DataFrame, key: str, order: list[str], period: str, limit: int, budget: int | None = None,
                 ts: str = "ts") -> DataFrame:
    """Batch verdict per event: 'ok', 'rate_limited' (own limit) or 'busy' (shared budget, where there is one).

    Only events within their own limit draw on the budget. A verdict needs no rank, only the position of the last event
    admitted: the ``limit``-th of a key and window, the ``budget``-th of a window. Groups of any size ship that many rows
    from each task at most.
    """
    # The window's number rather than ``F.window``, which drops events without a time.
    length = F.unix_micros(F.expr(f"timestamp'1970-01-01 00:00:00Z' + interval {period}"))
    rows = df.withColumn("__w", F.struct(F.floor(micros(ts) / length).alias("n")))
    position = F.struct(*order)
    own = nth_border(rows, [key, "__w"], order, limit, "__own")
    group = F.struct(key, "__w")
    own = own.select(group.alias("__g"), "__own")
    judged = rows.withColumn("__g", group).join(own, "__g", "left").withColumn("__in", F.coalesce(position <= F.col("__own"), F.lit(True)))
    if budget is None:
        return judged.select(*df.columns, F.when(~F.col("__in"), "rate_limited").otherwise("ok").alias("verdict"))
    shared = nth_border(judged.where("__in"), ["__w"], order, budget, "__shared")
    judged = judged.join(shared, "__w", "left")
    verdict = F.when(~F.col("__in"), "rate_limited").when(position > F.col("__shared"), "busy").otherwise("ok")
    return judged.select(*df.columns, verdict.alias("verdict"))


def circuit_openings(df: DataFrame, status: str = "status", retry_after: str = "retry_after", ts: str = "ts") -> DataFrame:
    """Events that open a host's circuit: refusals without expiry, 429 until its retry time (60 s at least)."""
    wait = F.greatest(F.coalesce(F.col(retry_after), F.lit(DEFAULT_RETRY_S)), F.lit(MIN_RETRY_S))
    refused = F.col(status).isin(401, 403, 429, 451)
    until = F.when(F.col(status) == 429, micros(ts) + wait.cast("long") * 1_000_000)
    return df.where(refused).withColumns({"reason": F.concat(F.lit("HTTP "), F.col(status)), "until_us": until})


def circuit_state(df: DataFrame, key: str, order: list[str], ts: str = "ts") -> DataFrame:
    """Current circuit per host: the latest opening replaces the one before. A plain aggregate, so it runs
    unchanged as a streaming query, and a late event with an older time never shortens a newer circuit."""
    openings = circuit_openings(df, ts=ts)
    last = F.max_by(F.struct("reason", "until_us"), F.struct(*order))
    return openings.groupBy(key).agg(last.alias("c"), F.count("*").alias("openings")).select(key, "c.*", "openings")


def blocked_requests(df: DataFrame, key: str, order: list[str], chunk: Column, ts: str = "ts") -> DataFrame:
    """Batch as-of check: add ``blocked`` = the host's latest earlier opening was still in force."""
    wait = F.greatest(F.coalesce(F.col("retry_after"), F.lit(DEFAULT_RETRY_S)), F.lit(MIN_RETRY_S)).cast("long")
    until = F.when(F.col("status") == 429, micros(ts) + wait * 1_000_000).otherwise(F.lit(2**62))
    seen = chunked_last_known(df, [key], order, chunk, {"__until": until}, F.col("status").isin(401, 403, 429, 451))
    return seen.withColumn("blocked", F.coalesce(F.col("__until") > micros(ts), F.lit(False))).drop("__until")


def single_flight(df: DataFrame, key: str, flight: str, ts: str = "ts") -> DataFrame:
    """(key, flight window, requests): the requests of a key in one flight window share one lookup."""
    grouped = df.groupBy(F.col(key), F.window(ts, flight).alias("w")).agg(F.count("*").alias("requests"))
    return grouped.select(key, F.col("w.start").alias("flight_start"), "requests")


def first_in_flight(df: DataFrame, key: str) -> DataFrame:
    """Streaming form that forwards the first request at once and drops repeats while the watermark holds them."""
    return df.dropDuplicatesWithinWatermark([key])


def freshness(df: DataFrame, key: str, order: list[str], outcome: Column, is_lookup: Column, chunk: Column,
              ts: str = "ts") -> DataFrame:
    """Lookups with the state of the latest earlier result: 'fresh', 'stale' (served, refresh requested) or 'miss'.

    ``outcome`` is 'found', 'not_found' or null when the event is no result.
    """
    rows = df.withColumn("__o", outcome)
    seen = chunked_last_known(rows, [key], order, chunk, {"__at": micros(ts), "__was": F.col("__o")},
                              F.col("__o").isNotNull())
    age = (micros(ts) - F.col("__at")) / 1_000_000
    found = F.col("__was") == "found"
    ttl, kept = F.when(found, FOUND_TTL_S).otherwise(NOT_FOUND_TTL_S), F.when(found, RETAINED_S).otherwise(NOT_FOUND_TTL_S)
    state = F.when(age < ttl, "fresh").when(age < kept, "stale").otherwise("miss")
    return seen.where(is_lookup).select(*df.columns, state.alias("state"), (state != "fresh").alias("refresh"))


def latest_results(df: DataFrame, key: str, outcome: Column, ts: str = "ts") -> DataFrame:
    """(key, checked_at, outcome): the static side of the streaming freshness join."""
    results = df.withColumn("outcome", outcome).where(F.col("outcome").isNotNull())
    return results.groupBy(key).agg(F.max(ts).alias("checked_at"), F.max_by("outcome", ts).alias("outcome"))


def serve(lookups: DataFrame, results: DataFrame, key: str, ts: str = "ts") -> DataFrame:
    """Stream-static join: state of every lookup against the stored results."""
    joined = lookups.join(results, key, "left")
    age = (micros(ts) - micros("checked_at")) / 1_000_000
    found = F.col("outcome") == "found"
    ttl, kept = F.when(found, FOUND_TTL_S).otherwise(NOT_FOUND_TTL_S), F.when(found, RETAINED_S).otherwise(NOT_FOUND_TTL_S)
    return joined.withColumn("state", F.when(age < ttl, "fresh").when(age < kept, "stale").otherwise("miss"))


def change_feed(df: DataFrame, key: str, order: list[str], content: str, chunk: Column) -> DataFrame:
    """Fetches whose content differs from the previous fetch of the same page; the first fetch is a change."""
    linked = chunked_lag(df, [key], order, chunk, {"__before": content})
    return linked.where(~F.col("__before").eqNullSafe(F.col(content))).drop("__before")


def queue_status(df: DataFrame, key: str, order: list[str], status: str) -> DataFrame:
    """Resumable work queue: first insertion kept, latest status wins; streaming in complete/update mode."""
    position = F.struct(*order)
    return df.groupBy(key).agg(F.min_by(status, position).alias("first_status"), F.max_by(status, position).alias("status"),
                               F.count("*").alias("updates"))
