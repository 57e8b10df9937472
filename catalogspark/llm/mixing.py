"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed per cell (source x language x topic), the only pass over the text. Raking then scales cells to the
target shares of each margin in turn until they all fit. A document's probability is its cell's fitted share over its
available share, scaled so that the largest is ``top``; a hash of its id decides, so a sample can be drawn again. Expected
tokens of the sample then have the target margins.

Categories that a target does not name, and nulls, are one category ``other``, so there are at most
(sources + 1) x (languages + 1) x (topics + 1) cells, as many as the targets allow, whatever the corpus. That bound is
what lets the cells travel in one row and be broadcast. Targets of categories without tokens are left out and the rest
scaled up. Margins that no weights can meet (empty cells) end as near as the sweeps bring them; ``margin_error`` tells.

Defined cases: a null or empty text has no tokens and shares its cell's probability; repeated rows are sampled alike; a
null doc_id is sampled as the text 'null'; an empty table gives no rows; extra columns stay.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogspark.llm.quality import let
from catalogspark.llm.staging import written

DIMENSIONS = ("source", "lang", "topic")
#: Weights of the production mix. A category's target share is its weight times its available share to the power
#: ``TEMPER``: 1 leaves the margins as they are, 0 makes the weights themselves the shares.
TARGETS = {
    "source": {**{f"src{i}": 1.0 for i in range(20)}, "other": 1.0},
    "lang": {"en": 1.0, "de": 1.0, "fr": 1.0, "es": 1.0, "other": 1.0},
    "topic": {"short": 1.0, "symbols": 1.0, "loud": 1.0, "lines": 1.0, "other": 1.0},
}
TEMPER = 0.9
SWEEPS = 40


def topic_of(text: Column) -> Column:
    """The kind of a text by its outer form, for tables without a topic: symbols, loud, lines, short or other."""
    size = F.greatest(F.length(text), F.lit(1))
    return (F.when(F.regexp_count(text, F.lit(r"[#*$%&|<>]")) * 50 > size, "symbols")
            .when(F.regexp_count(text, F.lit(r"[!?]")) * 50 > size, "loud")
            .when(F.length(text) < 500, "short")
            .when(F.regexp_count(text, F.lit(r"\n")) * 200 > size, "lines").otherwise("other"))


def tokens_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t-\r]+")), F.lit(0)).cast("long")


def _named(column: str, target: dict[str, float]) -> Column:
    return F.when(F.col(column).isin(*target), F.col(column)).otherwise("other")


def _shares(cells: Column, dim: str, target: dict[str, float], temper: float) -> Column:
    """Target shares of one margin over the categories that have tokens, as an array of (name, share)."""
    def available(name: Column) -> Column:
        return F.aggregate(F.filter(cells, lambda c: c[dim] == name), F.lit(0.0), lambda a, c: a + c["n"])

    given = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(v)).alias("v")) for k, v in sorted(target.items())])
    there = F.filter(given, lambda g: F.exists(cells, lambda c: (c[dim] == g["k"]) & (c["n"] > 0)))
    raw = F.transform(there, lambda g: F.struct(g["k"].alias("k"), (g["v"] * F.pow(available(g["k"]), F.lit(temper))).alias("v")))
    return let(raw, lambda r: let(F.aggregate(r, F.lit(0.0), lambda a, g: a + g["v"]), lambda t: F.transform(
        r, lambda g: F.struct(g["k"].alias("k"), (g["v"] / t).alias("v")))))


def _raked(cells: Column, dim: str) -> Column:
    """Cells scaled so that the margin ``dim`` has its target shares."""
    sums = F.transform(F.col(f"share_{dim}"), lambda g: F.struct(g["k"].alias("k"), (g["v"] / F.aggregate(
        F.filter(cells, lambda c: c[dim] == g["k"]), F.lit(0.0), lambda a, c: a + c["w"])).alias("f")))
    return let(sums, lambda s: F.transform(cells, lambda c: F.struct(
        *[c[d].alias(d) for d in DIMENSIONS], c["n"].alias("n"),
        (c["w"] * F.coalesce(F.filter(s, lambda g: g["k"] == c[dim])[0]["f"], F.lit(0.0))).alias("w"))))


def _rake(dim: str) -> Callable[[Column], Column]:
    return lambda cells: _raked(cells, dim)


def fitted_cells(docs: DataFrame, targets: dict[str, dict[str, float]] = TARGETS, sweeps: int = SWEEPS,
                 top: float = 1.0, temper: float = TEMPER) -> DataFrame:
    """One row per cell: source, lang, topic, n_tokens, weight (fitted share), probability, margin_error."""
    targets = {d: {**t, "other": t.get("other", 0.0)} for d, t in targets.items()}
    counted = docs.groupBy(*[_named(d, targets[d]).alias(d) for d in DIMENSIONS]).agg(F.sum("n_tokens").cast("double").alias("n"))
    # One row: its length is bounded by the targets. Sorted, so that sums are the same in every run.
    packed = counted.groupBy().agg(F.sort_array(F.collect_list(F.struct(*DIMENSIONS, "n", F.col("n").alias("w")))).alias("cells"))

    def sweep(cells: Column, _: Column) -> Column:
        for d in DIMENSIONS:
            cells = let(cells, _rake(d))
        return cells

    shares = written(packed.select("cells", *[_shares(F.col("cells"), d, targets[d], temper).alias(f"share_{d}") for d in DIMENSIONS]), "margins")
    fit = shares.withColumn("fit", F.aggregate(F.sequence(F.lit(1), F.lit(sweeps)), F.col("cells"), sweep))
    fit = written(fit.drop("cells"), "fit")

    def off(d: str) -> Column:
        return F.array_max(F.transform(F.col(f"share_{d}"), lambda g: F.abs(g["v"] - F.aggregate(
            F.filter("fit", lambda c: c[d] == g["k"]), F.lit(0.0), lambda a, c: a + c["w"]))))

    ratio = F.transform("fit", lambda c: F.when(c["n"] > 0, c["w"] / c["n"]).otherwise(0.0))
    rows = fit.withColumn("highest", F.array_max(ratio)).withColumn("margin_error", F.greatest(*[off(d) for d in DIMENSIONS]))
    rows = rows.select("highest", "margin_error", F.explode("fit").alias("c"))
    # A cell without tokens has nothing to weigh; its documents stay.
    chance = F.when(F.col("c.n") > 0, F.col("c.w") / F.col("c.n") / F.col("highest") * top).otherwise(1.0)
    return written(rows.select(*[F.col(f"c.{d}").alias(d) for d in DIMENSIONS], F.col("c.n").cast("long").alias("n_tokens"),
                               F.col("c.w").alias("weight"), chance.alias("probability"), "margin_error"), "cells")


def draw(doc_id: Column) -> Column:
    """Uniform number in [0, 1) that depends on the id only."""
    return F.conv(F.substring(F.md5(F.concat(F.lit("mix"), F.coalesce(doc_id.cast("string"), F.lit("null")))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def weighed(docs: DataFrame, targets: dict[str, dict[str, float]] = TARGETS, sweeps: int = SWEEPS,
            top: float = 1.0, temper: float = TEMPER) -> DataFrame:
    """``docs`` (doc_id, source, lang, topic, n_tokens) with ``weight``, ``probability``, ``margin_error``, ``sampled``."""
    cells = fitted_cells(docs, targets, sweeps, top, temper)
    named = cells.select(*[F.col(d).alias(f"__{d}") for d in DIMENSIONS], "weight", "probability", "margin_error")
    full = {d: {**t, "other": 0.0} for d, t in targets.items()}
    same = [_named(d, full[d]) == F.col(f"__{d}") for d in DIMENSIONS]
    rows = docs.join(F.broadcast(named), same[0] & same[1] & same[2])
    return rows.select(*docs.columns, "weight", "probability", "margin_error").withColumn("sampled", draw(F.col("doc_id")) < F.col("probability"))


def described(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", "lang", topic_of(F.col("text")).alias("topic"), tokens_of(F.col("text")).alias("n_tokens"))


def mixed(docs: DataFrame) -> DataFrame:
    """The sampled documents, unchanged. The text is read twice and never moves."""
    extra = docs.withColumn("__topic", topic_of(F.col("text")))
    cells = fitted_cells(described(docs)).select(*[F.col(d).alias(f"__c_{d}") for d in DIMENSIONS], "probability")
    full = {d: {**t, "other": 0.0} for d, t in TARGETS.items()}
    same = [_named("__topic" if d == "topic" else d, full[d]) == F.col(f"__c_{d}") for d in DIMENSIONS]
    rows = extra.join(F.broadcast(cells), same[0] & same[1] & same[2])
    return rows.where(draw(F.col("doc_id")) < F.col("probability")).select(*docs.columns)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = written(described(spark.read.parquet(f"{sf_dir}/documents.parquet")), "described")
    return weighed(rows).select("doc_id", "topic", "n_tokens", F.round("weight", 9).alias("weight"), F.round("probability", 9).alias("probability"), "sampled")


_NAMES = ", ".join(f"('{d}', '{k}', {v})" for d, t in TARGETS.items() for k, v in t.items())
ORACLE_SQL = rf"""
WITH RECURSIVE target(dim, k, v) AS (VALUES {_NAMES}),
described AS (
  SELECT doc_id, lang, source,
         CASE WHEN length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) * 50 > greatest(length(text), 1) THEN 'symbols'
              WHEN length(regexp_replace(text, '[^!?]', '', 'g')) * 50 > greatest(length(text), 1) THEN 'loud'
              WHEN length(text) < 500 THEN 'short'
              WHEN length(regexp_replace(text, '[^\n]', '', 'g')) * 200 > greatest(length(text), 1) THEN 'lines' ELSE 'other' END AS topic,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens FROM documents),
named AS (
  SELECT doc_id, topic AS kind, n_tokens,
         coalesce((SELECT k FROM target WHERE dim = 'source' AND k = source), 'other') AS source,
         coalesce((SELECT k FROM target WHERE dim = 'lang' AND k = lang), 'other') AS lang,
         coalesce((SELECT k FROM target WHERE dim = 'topic' AND k = topic), 'other') AS topic FROM described),
cells AS (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS n FROM named GROUP BY ALL),
margin AS (SELECT 'source' AS dim, source AS k, sum(n) AS n FROM cells GROUP BY source UNION ALL SELECT 'lang', lang, sum(n) FROM cells GROUP BY lang
           UNION ALL SELECT 'topic', topic, sum(n) FROM cells GROUP BY topic),
raw AS (SELECT t.dim, t.k, t.v * pow(m.n, {TEMPER}) AS v FROM target t JOIN margin m ON m.dim = t.dim AND m.k = t.k WHERE m.n > 0),
share AS (SELECT dim, k, v / sum(v) OVER (PARTITION BY dim) AS v FROM raw),
ipf AS (
  SELECT 0 AS step, source, lang, topic, n, n AS w FROM cells
  UNION ALL
  SELECT step + 1, source, lang, topic, n, w * s.v / sum(w) OVER (PARTITION BY CASE step % 3 WHEN 0 THEN source WHEN 1 THEN lang ELSE topic END)
  FROM ipf JOIN share s ON s.dim = CASE step % 3 WHEN 0 THEN 'source' WHEN 1 THEN 'lang' ELSE 'topic' END
                       AND s.k = CASE step % 3 WHEN 0 THEN source WHEN 1 THEN lang ELSE topic END
  WHERE step < {3 * SWEEPS}),
fit AS (SELECT *, w / n / max(w / n) OVER () AS p FROM ipf WHERE step = {3 * SWEEPS})
SELECT d.doc_id, d.kind AS topic, d.n_tokens, round(f.w, 9) AS weight, round(f.p, 9) AS probability,
       CAST('0x' || substring(md5('mix' || CAST(d.doc_id AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0 < f.p AS sampled
FROM named d JOIN fit f ON f.source = d.source AND f.lang = d.lang AND f.topic = d.topic
"""
