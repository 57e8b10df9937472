"""Language identification by Bayesian fusion of evidence.

Four kinds of evidence on a page are combined: its text (naive Bayes over hashed letter trigrams, learned from labelled
documents), the language its markup declares, the suffix of its address, and its host's prior. What a declaration or a
suffix is worth is not assumed but counted: for each value, the text posteriors of the pages that carry it. Host priors
are smoothed along host, registered domain, suffix and corpus: each level is drawn to the one above with a few
pseudo-pages. Every count is a grouped aggregation with one row per group, and a page's own posterior is taken out of
each of them, so no evidence counts twice.

Defined cases: a null or empty page has no text evidence and goes by its address; an unknown or missing declaration,
suffix or host counts as a value of its own; without labelled documents there are no languages and no rows; ties go to the
language first in the alphabet; repeated rows are judged alike; a null page_id stays; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogspark.llm.staging import written
from catalogspark.llm.text_arrays import as_bytes, blocks, lowered

BUCKETS = 1 << 16
#: Bound on the languages of a model, which is sent to every task (64 x 65,536 numbers at most).
MAX_LANGUAGES = 64
#: Text evidence of n trigrams counts like min(n, TRUST) independent ones: neighbouring trigrams repeat each other.
TRUST = 60
PSEUDO_PAGES = 4.0


def _trigrams(part: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of lower-cased bytes and their texts; none crosses a border of texts or holds a digit, a sign or
    two blanks."""
    data = lowered(part)
    letter = ((data >= 97) & (data <= 122)) | (data >= 128) | (data == 32)
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    blank = data == 32
    good = letter[:-2] & letter[1:-1] & letter[2:] & (owner[:-2] == owner[2:]) & ~(blank[1:-1] & (blank[:-2] | blank[2:]))
    wide = data.astype(np.uint32)
    mixed = (wide[:-2] << 16 | wide[1:-1] << 8 | wide[2:]) * np.uint32(2654435761)
    return (mixed >> np.uint32(16)).astype(np.int64)[good], owner[:-2][good]


def trigram_model(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and log P(bucket | language), from all of ``docs`` (text, lang) with a known language."""
    langs = sorted(r["lang"] for r in docs.where("lang is not null and lang <> ''").select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(langs) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {lang: i for i, lang in enumerate(langs)}
        counts = np.zeros((len(langs), BUCKETS), np.int64)
        for batch in batches:
            data, offsets = as_bytes(batch.column("text"))
            of = np.array([place.get(x, -1) for x in batch.column("lang").to_pylist()], np.int64)
            for a, b in blocks(offsets):
                bucket, owner = _trigrams(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                which = of[a:b][owner]
                counts += np.bincount((which * BUCKETS + bucket)[which >= 0], minlength=counts.size).reshape(counts.shape)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts.ravel()[at])], ["at", "n"])

    total = np.zeros((len(langs), BUCKETS))
    if langs:
        # At most one row per language and bucket comes back.
        rows = docs.select("text", "lang").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
        total.ravel()[rows["at"].to_numpy()] = rows["n"].to_numpy()
    return langs, np.log((total + 0.5) / (total.sum(1, keepdims=True) + 0.5 * BUCKETS))


def _plain(html: Column) -> Column:
    """Text of a page: scripts, styles, comments and tags go, entities become blanks."""
    return F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&#?\w+;", " ")


def text_evidence(texts: DataFrame, langs: list[str], model: np.ndarray) -> DataFrame:
    """``texts`` with ``like``: tempered log-likelihood of ``plain`` per language, highest 0."""
    shared = texts.sparkSession.sparkContext.broadcast(model.astype(np.float32))
    kept = [c for c in texts.columns if c != "plain"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(langs)
        for batch in batches:
            data, offsets = as_bytes(batch.column("plain"))
            out = np.zeros((batch.num_rows, k))
            for a, b in blocks(offsets):
                bucket, owner = _trigrams(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                n = np.bincount(owner, minlength=b - a)
                for i in range(k):
                    out[a:b, i] = np.bincount(owner, shared.value[i][bucket], b - a) * (np.minimum(n, TRUST) / np.maximum(n, 1))
            out -= out.max(1, keepdims=True) if len(out) else 0
            lists = pa.ListArray.from_arrays(np.arange(batch.num_rows + 1, dtype=np.int32) * k, pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], lists], [*kept, "like"])

    types = {f.name: f.dataType.simpleString() for f in texts.schema.fields}
    return texts.mapInArrow(run, ", ".join([*[f"`{c}` {types[c]}" for c in kept], "like array<double>"]))


def _normal(log: Column) -> Column:
    """Probabilities from log weights."""
    weights = F.transform(F.array(F.array_max(log)), lambda top: F.transform(log, lambda x: F.exp(x - top)))[0]
    return F.transform(F.array(weights), lambda w: F.transform(w, lambda x: x / F.aggregate(w, F.lit(0.0), lambda a, y: a + y)))[0]


def _sums(rows: DataFrame, keys: list[str], k: int, name: str) -> DataFrame:
    """Pages and summed posteriors per group, as one array."""
    return rows.groupBy(*keys).agg(F.array(*[F.sum(F.col("post")[i]) for i in range(k)]).alias(name))


def _drawn(own: Column, above: Column, taken: Column) -> Column:
    """Shares of a group without this page, drawn to the shares of the level above."""
    rest = F.zip_with(own, taken, lambda s, t: F.greatest(s - t, F.lit(0.0)))
    total = F.aggregate(rest, F.lit(0.0), lambda a, x: a + x) + PSEUDO_PAGES
    return F.zip_with(rest, above, lambda s, p: (s + PSEUDO_PAGES * p) / total)


def identify(pages: DataFrame, labelled: DataFrame) -> DataFrame:
    """page_id, lang, probability, and the best language by text alone, for every row of ``pages`` (page_id, url, html)."""
    langs, model = trigram_model(labelled)
    k = len(langs)
    if not k:
        return pages.select("page_id", *[F.lit(None).cast(t).alias(c) for c, t in (("lang", "string"), ("probability", "double"), ("text_lang", "string"), ("declared", "string"))]).limit(0)
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    declared = F.lower(F.regexp_extract(F.coalesce("html", F.lit("")), r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?\s*([a-z]{2,3})\b", 1))
    parts = F.split(host, r"\.")
    path = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"(?i)^[^:]+://[^/]*/([a-z]{2})(?:[/?#-]|$)", 1))
    rows = pages.select("page_id", host.alias("host"), F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2), ".").alias("domain"),
                        F.element_at(parts, -1).alias("suffix"), path.alias("path"), declared.alias("declared"), _plain(F.col("html")).alias("plain"))
    rows = written(text_evidence(rows, langs, model).withColumn("post", _normal(F.col("like"))), "text")

    corpus = _sums(rows, [], k, "all")
    levels = [(["suffix"], "by_suffix"), (["suffix", "domain"], "by_domain"), (["suffix", "domain", "host"], "by_host")]
    joined = rows.join(F.broadcast(corpus), F.lit(True), "left")
    for keys, name in [*levels, (["declared"], "by_declared"), (["path"], "by_path")]:
        joined = joined.join(_sums(rows, keys, k, name), keys)
    even = F.array(*[F.lit(1.0 / k)] * k)
    joined = joined.withColumn("p0", _drawn(F.col("all"), even, F.col("post")))
    joined = joined.withColumn("p1", _drawn(F.col("by_suffix"), F.col("p0"), F.col("post")))
    joined = joined.withColumn("p2", _drawn(F.col("by_domain"), F.col("p1"), F.col("post")))
    joined = joined.withColumn("p3", _drawn(F.col("by_host"), F.col("p2"), F.col("post")))
    # A value's evidence is the shares of its pages over those of all pages: P(l | value) / P(l) = P(value | l) / P(value).
    for name in ("by_declared", "by_path"):
        joined = joined.withColumn(name, F.zip_with(_drawn(F.col(name), F.col("p0"), F.col("post")), "p0", lambda s, p: F.log(s) - F.log(p)))
    total = F.zip_with(F.zip_with("like", "p3", lambda t, p: t + F.log(p)), F.zip_with("by_declared", "by_path", lambda a, b: a + b), lambda a, b: a + b)
    names = F.array(*[F.lit(x) for x in langs])
    joined = joined.withColumn("fused", _normal(total))
    best = F.get(names, (F.array_position("fused", F.array_max("fused")) - 1).cast("int"))
    by_text = F.when(F.size(F.array_distinct("like")) > 1, F.get(names, (F.array_position("like", F.array_max("like")) - 1).cast("int")))
    return joined.select("page_id", best.alias("lang"), F.array_max("fused").alias("probability"), by_text.alias("text_lang"), F.nullif("declared", F.lit("")).alias("declared"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.read.parquet(f"{sf_dir}/documents.parquet"))
