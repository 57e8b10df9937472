"""Quality rules with thresholds that the corpus sets itself: mergeable quantile sketches per language and source.

Every document gets four rates. Each (language, source) keeps one KLL sketch per rate; sketches merge into their
language's and the corpus's, so a small group borrows its parent's quantiles and no value is read twice. A document is
rejected if a rate lies beyond the upper fence (third quartile + ``reach`` times the spread) of its group.

Defined cases: a null text has no words and fails the base rules, as does an empty one; a null language or source is a
group of its own; repeated rows are judged alike, each on its own; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogspark.llm.staging import written

#: Rates and the smallest spread each fence is given, so that a uniform group does not reject its slightest deviation.
RATES = {"symbol_rate": 0.02, "mark_rate": 0.05, "dup_line_rate": 0.1, "word_length": 1.0}
REACH = 3.0
MIN_GROUP = 200
SKETCH_K = 4096
_WHITE = r"[ \t-\r]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.transform(F.array(value), body)[0]


def _covered(grams: Column, width: int) -> Column:
    """Words in windows that occur twice or more. Windows are sorted with their positions; equal neighbours repeat."""
    placed = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

    def repeated(s: Column) -> Column:
        hit = F.filter(s, lambda x, k: (x["g"] == F.get(s, k - 1)["g"]) | (x["g"] == F.get(s, k + 1)["g"]))
        return F.sort_array(F.transform(hit, lambda x: x["i"]))

    def union(places: Column) -> Column:
        gaps = F.transform(places, lambda p, k: F.least(F.lit(width), F.coalesce(F.get(places, k + 1) - p, F.lit(width))))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    some = let(let(placed, repeated), union)
    return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0)).otherwise(some)


def repeat_words(words: Column, width: int = 5) -> Column:
    """Words that lie in windows of ``width`` words found twice or more in the text, the first included."""
    def windows(h: Column) -> Column:
        last = F.size(h) - width
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(width)]))

    counted = let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: let(windows(h), lambda g: _covered(g, width)))
    return F.when(F.size(words) > width, counted).otherwise(F.lit(0)).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__q``: counts of the base rules, the rates and the base verdict. No row moves."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, _WHITE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^ \t-\r]"))

    def counts(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            F.regexp_count(text, F.lit(r"[!?¡¿]")).cast("long").alias("n_marks"),
            let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("lines"),
            repeat_words(w).alias("n_repeat_words"))

    def judged(c: Column) -> Column:
        n = F.greatest(c["n_words"], F.lit(1))
        return F.struct(
            c["n_words"].alias("n_words"), c["word_chars"].alias("word_chars"), c["n_symbols"].alias("n_symbols"),
            c["lines"]["dup"].alias("n_dup_lines"), c["n_repeat_words"].alias("n_repeat_words"),
            ((c["n_words"] < 10) | (100 * c["n_repeat_words"] > 20 * c["n_words"])).alias("base_failed"),
            (c["n_symbols"] / n).alias("symbol_rate"), (c["n_marks"] / n).alias("mark_rate"),
            (c["lines"]["dup"] / F.greatest(c["lines"]["n"], F.lit(1))).alias("dup_line_rate"), (c["word_chars"] / n).alias("word_length"))

    return docs.withColumn("__q", let(let(words, counts), judged))


def fences(rates: DataFrame, reach: float = REACH, min_group: int = MIN_GROUP) -> DataFrame:
    """Upper fence of every rate per (lang, source), from ``rates`` with lang, source and the columns of ``RATES``.

    One pass builds the sketches of the groups; parents are merged sketches. A group below ``min_group`` rows takes its
    language's quantiles, a language below it the corpus's. One row per group, whatever its size.
    """
    groups = rates.groupBy("lang", "source").agg(
        F.count("*").alias("n"), *[F.kll_sketch_agg_double(r, F.lit(SKETCH_K)).alias(r) for r in RATES])
    groups = written(groups, "sketches")
    langs = groups.groupBy(F.col("lang").alias("__lang")).agg(
        F.sum("n").alias("__n"), *[F.kll_merge_agg_double(r, F.lit(SKETCH_K)).alias(f"__lang_{r}") for r in RATES])
    whole = groups.groupBy().agg(*[F.kll_merge_agg_double(r, F.lit(SKETCH_K)).alias(f"__all_{r}") for r in RATES])
    joined = groups.join(langs, F.col("lang").eqNullSafe(F.col("__lang"))).join(F.broadcast(whole), F.lit(True), "left")

    def fence(rate: str) -> Column:
        sketch = F.when(F.col("n") >= min_group, F.col(rate)).when(F.col("__n") >= min_group, F.col(f"__lang_{rate}")).otherwise(F.col(f"__all_{rate}"))
        low, high = (F.kll_sketch_get_quantile_double(sketch, F.lit(q)) for q in (0.25, 0.75))
        return (high + reach * F.greatest(high - low, F.lit(RATES[rate]))).alias(f"max_{rate}")

    return written(joined.select(F.col("lang").alias("__fl"), F.col("source").alias("__fs"), *[fence(r) for r in RATES]), "fences")


def verdicts(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """``rows`` (lang, source and ``__q``) with ``kept``. Groups without a fence, which cannot come from the same rows,
    keep the base verdict."""
    met = F.lit(True)
    for rate in RATES:
        met = met & (F.coalesce(F.col(f"__q.{rate}") <= F.col(f"max_{rate}"), F.lit(True)))
    same = F.col("lang").eqNullSafe(F.col("__fl")) & F.col("source").eqNullSafe(F.col("__fs"))
    return rows.join(limits, same, "left").withColumn("kept", ~F.col("__q.base_failed") & met)


def quality_report(docs: DataFrame) -> DataFrame:
    """One row per document: counts, rates, base verdict and ``kept``."""
    rows = written(measured(docs.select("doc_id", "text", "lang", "source")).drop("text"), "rates")
    limits = fences(rows.select("lang", "source", *[F.col(f"__q.{r}").alias(r) for r in RATES]))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return verdicts(rows, limits).select("doc_id", *[F.col(f"__q.{c}").alias(c) for c in counts], "kept")


def quality_filter(docs: DataFrame) -> DataFrame:
    """Documents that pass, unchanged. Texts are measured twice rather than moved: only fences, one row per group, are
    joined, and the planner broadcasts them if the written table is small."""
    rows = measured(docs.select("lang", "source", "text")).drop("text")
    limits = fences(rows.select("lang", "source", *[F.col(f"__q.{r}").alias(r) for r in RATES]))
    return verdicts(measured(docs), limits).where("kept").select(*docs.columns)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Quantiles are exact below ``SKETCH_K`` rows, so SQL can state them for small tables.
ORACLE_SQL = r"""
WITH cut AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
places AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 4), ' ') AS g
           FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 4)) AS i FROM cut)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM places) WHERE n > 1),
gaps AS (SELECT doc_id, least(5, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 5)) AS c FROM twice),
rep AS (SELECT doc_id, sum(c) AS r FROM gaps GROUP BY doc_id),
counted AS (
  SELECT cut.doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         length(regexp_replace(t, '[^!?¡¿]', '', 'g')) AS n_marks, len(l) AS n_lines,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r, 0) AS BIGINT) AS n_repeat_words
  FROM cut LEFT JOIN rep ON rep.doc_id = cut.doc_id),
judged AS (
  SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
         n_symbols / greatest(n_words, 1) AS r1, n_marks / greatest(n_words, 1) AS r2,
         n_dup_lines / greatest(n_lines, 1) AS r3, word_chars / greatest(n_words, 1) AS r4 FROM counted),
levels AS (
  SELECT lang, source, lvl, count(*) AS n,
         quantile_disc(r1, 0.75) + 3 * greatest(quantile_disc(r1, 0.75) - quantile_disc(r1, 0.25), 0.02) AS m1,
         quantile_disc(r2, 0.75) + 3 * greatest(quantile_disc(r2, 0.75) - quantile_disc(r2, 0.25), 0.05) AS m2,
         quantile_disc(r3, 0.75) + 3 * greatest(quantile_disc(r3, 0.75) - quantile_disc(r3, 0.25), 0.1) AS m3,
         quantile_disc(r4, 0.75) + 3 * greatest(quantile_disc(r4, 0.75) - quantile_disc(r4, 0.25), 1.0) AS m4
  FROM (SELECT r1, r2, r3, r4, lang, source, 1 AS lvl FROM judged UNION ALL
        SELECT r1, r2, r3, r4, lang, NULL, 2 FROM judged UNION ALL SELECT r1, r2, r3, r4, NULL, NULL, 3 FROM judged)
  GROUP BY lang, source, lvl),
picked AS (
  SELECT j.*, CASE WHEN a.n >= 200 THEN a.m1 WHEN b.n >= 200 THEN b.m1 ELSE c.m1 END AS m1,
         CASE WHEN a.n >= 200 THEN a.m2 WHEN b.n >= 200 THEN b.m2 ELSE c.m2 END AS m2,
         CASE WHEN a.n >= 200 THEN a.m3 WHEN b.n >= 200 THEN b.m3 ELSE c.m3 END AS m3,
         CASE WHEN a.n >= 200 THEN a.m4 WHEN b.n >= 200 THEN b.m4 ELSE c.m4 END AS m4
  FROM judged j JOIN levels a ON a.lvl = 1 AND a.lang IS NOT DISTINCT FROM j.lang AND a.source IS NOT DISTINCT FROM j.source
  JOIN levels b ON b.lvl = 2 AND b.lang IS NOT DISTINCT FROM j.lang JOIN levels c ON c.lvl = 3)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND r1 <= m1 AND r2 <= m2 AND r3 <= m3 AND r4 <= m4) AS kept
FROM picked
"""
