"""Reconciliation of captures with inventories, listings with details, and runs with their declared totals."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogspark.functions.records import collect_errors
from catalogspark.operators.ordered import chunked_lag, chunked_running_sum

PAGE_ITEMS = 24


def in_inventory(records: DataFrame, inventory: DataFrame, key: str) -> DataFrame:
    """Only records of the current inventory are exported."""
    return records.join(inventory.select(key), key, "left_semi")


def remaining(inventory: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Inventory entries not captured yet."""
    return inventory.join(done.select(key), key, "left_anti")


def reconcile_sets(expected: DataFrame, observed: DataFrame, key: str) -> DataFrame:
    """(key, status) of every key that does not occur exactly once on both sides.

    Each side is counted before the join, so a repeated key costs one row whatever its frequency.
    """
    want = expected.groupBy(key).agg(F.count("*").alias("n_expected"))
    seen = observed.groupBy(key).agg(F.count("*").alias("n_observed"))
    both = want.join(seen, key, "full_outer")
    status = (
        F.when(F.col("n_observed").isNull(), "missing").when(F.col("n_expected").isNull(), "unexpected")
        .when((F.col("n_observed") > 1) | (F.col("n_expected") > 1), "duplicate")
    )
    return both.select(key, status.alias("status")).where(F.col("status").isNotNull())


def agreement_errors(joined: DataFrame, checks: Mapping[str, tuple[Column, Column]]) -> DataFrame:
    """Add ``errors``: the checks whose two sides differ; unknown against known differs, unknown twice agrees."""
    rules = [(message, ~a.eqNullSafe(b)) for message, (a, b) in checks.items()]
    return joined.withColumn("errors", collect_errors(rules))


def diff_rows(a: DataFrame, b: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, field, left_value, right_value) of every field that differs between two versions of a table."""
    left = a.select(key, F.struct(*[F.col(c).cast("string").alias(c) for c in columns]).alias("a"))
    right = b.select(key, F.struct(*[F.col(c).cast("string").alias(c) for c in columns]).alias("b"))
    cells = F.array(*[
        F.struct(F.lit(c).alias("field"), F.col(f"a.{c}").alias("left_value"), F.col(f"b.{c}").alias("right_value"))
        for c in columns
    ])
    changed = F.filter(cells, lambda x: ~x["left_value"].eqNullSafe(x["right_value"]))
    return left.join(right, key).select(key, F.inline(changed))


def set_equality(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: rows only on the left, only on the right, as bags. Equal tables give (0, 0)."""
    columns = a.columns
    signed = a.withColumn("__s", F.lit(1)).unionByName(b.select(*columns).withColumn("__s", F.lit(-1)))
    net = signed.groupBy(*columns).agg(F.sum("__s").alias("__net"))
    return net.agg(
        F.coalesce(F.sum(F.greatest("__net", F.lit(0))), F.lit(0)).alias("only_left"),
        F.coalesce(F.sum(F.greatest(-F.col("__net"), F.lit(0))), F.lit(0)).alias("only_right"),
    )


def totals_reconcile(declared: DataFrame, observed: DataFrame, key: str) -> DataFrame:
    """Declared against observed counts per family; a missing side counts as zero."""
    counts = observed.groupBy(key).agg(F.count("*").alias("observed"))
    both = declared.join(counts, key, "full_outer")
    want, have = F.coalesce("declared", F.lit(0)), F.coalesce("observed", F.lit(0))
    return both.select(key, want.alias("declared"), have.alias("observed"), (want == have).alias("ok"))


def page_gaps(pages: DataFrame, run: str, page: str, size: int) -> DataFrame:
    """Completeness of paged listings: pages must be 0..n-1 and all but the last must hold ``size`` items.

    ``pages`` has one row per listed item; it is counted per page first, then per run.
    """
    counted = pages.groupBy(run, page).agg(F.count("*").alias("__n"))
    runs = counted.groupBy(run).agg(
        F.min(page).alias("first_page"), F.max(page).alias("last_page"), F.count("*").alias("n_pages"),
        F.max_by("__n", page).alias("__last"), F.count_if(F.col("__n") == size).alias("__full"),
    )
    consecutive = (F.col("first_page") == 0) & (F.col("n_pages") == F.col("last_page") + 1)
    full_before_last = F.col("__full") - (F.col("__last") == size).cast("int") == F.col("n_pages") - 1
    return runs.select(run, "n_pages", consecutive.alias("consecutive"), full_before_last.alias("pages_full"))


def cumulative_gaps(items: DataFrame, run: str, page: str, item: str) -> DataFrame:
    """Items that an earlier page of a cumulative listing showed and the run's next page dropped, counted per run.

    No page's item set is ever built: an item row is fine when the same item is on the run's next page.
    """
    rows = items.select(run, page, item).distinct()
    steps = rows.select(run, page).distinct()
    steps = _next_page(steps, run, page)
    held = rows.select(run, F.col(page).alias("__next"), item, F.lit(True).alias("__held"))
    checked = rows.join(steps, [run, page]).join(held, [run, "__next", item], "left")
    dropped = F.col("__next").isNotNull() & F.col("__held").isNull()
    return checked.groupBy(run).agg(
        F.max(page).alias("last_page"), F.count_if(dropped).alias("dropped"),
    )


def _next_page(steps: DataFrame, run: str, page: str) -> DataFrame:
    """(run, page, __next): the following page of the run, null on the last."""
    backwards = steps.withColumn("__neg", -F.col(page))
    linked = chunked_lag(backwards, [run], ["__neg"], F.floor(F.col("__neg") / 1000), {"__next": page})
    return linked.drop("__neg")


def page_sizes(items: DataFrame, run: str, page: str, total: Column, size: int = PAGE_ITEMS) -> DataFrame:
    """Cumulative page size check: page p holds min(total, p * size) items."""
    counted = items.withColumn("__t", total).groupBy(run, page).agg(
        F.count("*").alias("n_items"), F.max("__t").alias("total"))
    want = F.least(F.col("total"), F.col(page) * size)
    return counted.select(run, page, "n_items", want.alias("expected"), (F.col("n_items") == want).alias("ok"))


def total_drift(pages: DataFrame, run: str, page: str, total: str) -> DataFrame:
    """Runs whose declared total differs from the first page's on some page, with the number of such pages."""
    per_total = pages.groupBy(run, total).agg(F.count("*").alias("__n"), F.min(page).alias("__first"))
    runs = per_total.groupBy(run).agg(
        F.min_by(total, "__first").alias("first_total"),
        (F.sum("__n") - F.min_by("__n", "__first")).alias("n_drifted"),
    )
    return runs.where(F.col("n_drifted") > 0)


def pacing_violations(events: DataFrame, host: str, order: Sequence[str], micros: str, min_delay_s: Column,
                      chunk: Column) -> DataFrame:
    """Requests that followed the previous one to the same host sooner than the host's delay allows."""
    linked = chunked_lag(events, [host], order, chunk, {"__before": micros})
    gap = F.col(micros) - F.col("__before")
    return linked.withColumn("gap_us", gap).where(gap < min_delay_s.cast("long") * 1_000_000).drop("__before")


def retry_runs(events: DataFrame, key: str, order: Sequence[str], transient: Column, chunk: Column,
               budget: int = 3) -> DataFrame:
    """Runs of consecutive transient answers per key: (key, run, attempts, over_budget)."""
    flagged = events.withColumn("__t", transient)
    islands = chunked_running_sum(flagged, [key], order, chunk, (~F.col("__t")).cast("long"), "run")
    runs = islands.where("__t").groupBy(key, "run").agg(F.count("*").alias("attempts"))
    return runs.withColumn("over_budget", F.col("attempts") > budget)


def reuse_proofs(proofs: DataFrame, targets: DataFrame) -> DataFrame:
    """Targets with their earlier working proof, or pending when there is none."""
    working = proofs.where(F.col("proof_status") == "working").select("url", F.lit("reused").alias("__s")).distinct()
    joined = targets.select("url").distinct().join(working, "url", "left")
    return joined.select("url", F.coalesce("__s", F.lit("pending")).alias("status"))
