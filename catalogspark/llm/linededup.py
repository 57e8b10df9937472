"""Line deduplication by winnowing.

Lines with a word are hashed. Windows are the shortest runs of lines with at least ``MIN_WORDS`` words, from every line
forwards and from every line backwards. Each window selects its smallest line hash (the rightmost of equals): that is a
fingerprint, and any repeated run of that many words contains a window, so both occurrences select the same line.
Positions are joined on fingerprints; only windows whose fingerprint occurs elsewhere go on. A window's content hash then
finds its first occurrence, and windows that continue each other at the same distance from their source extend the match
both ways to its full length. Two windows per line, forwards and backwards, cover every line of every repeated run
exactly, so no pair of occurrences is ever compared: each later occurrence meets the first one only.

The first occurrence by (doc_id, line) stays, every later one goes. Defined cases: null and empty texts have no lines;
a line without a word goes or stays with the line before it and is never a match by itself; runs below ``MIN_WORDS`` words
stay; identical rows are one document and stay alike; a null doc_id comes first; extra columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catalogspark.llm.staging import written
from catalogspark.llm.text_arrays import NEWLINE, as_bytes, blocks, hash_spans, mix, spans

MIN_WORDS = 50
_STEP = 0x9E3779B97F4A7C17  # odd, so it has an inverse, and 3 modulo 4


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n + 1, base, np.uint64)
    steps[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(steps)


def _ranges(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices first..last of every pair in a row, and where each begins."""
    sizes = last - first + 1
    begun = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) - np.repeat(begun - first, sizes), begun


def window_minima(lines: list[np.ndarray], words: np.ndarray, owner: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """First and last line, fingerprint, its line, and two content hashes of every window. ``lines``: two hashes of each
    line; ``owner``: its text, ascending."""
    n = len(words)
    total = np.concatenate([[0], np.cumsum(words)])
    text_end, text_begin = np.searchsorted(owner, owner, "right"), np.searchsorted(owner, owner, "left")
    here = np.arange(n)
    ahead = np.searchsorted(total, total[:-1] + least) - 1
    back = np.searchsorted(total, total[1:] - least, "right") - 1
    forwards, backwards = ahead < text_end, back >= text_begin
    pairs = np.unique(np.concatenate([here[forwards] * n + ahead[forwards], back[backwards] * n + here[backwards]]))
    first, last = pairs // max(n, 1), pairs % max(n, 1)
    if not len(first):
        return (first,) * 3 + (np.zeros(0, np.uint64),) * 3
    inside, begun = _ranges(first, last)
    value = lines[0][inside]
    smallest = np.minimum.reduceat(value, begun)
    at = np.maximum.reduceat(np.where(value == np.repeat(smallest, last - first + 1), inside, -1), begun)
    keys = []
    with np.errstate(over="ignore"):
        up, down = _powers(_STEP, n), _powers(pow(_STEP, -1, 1 << 64), n)
        for h in lines:
            prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[:-1])])
            keys.append(mix((prefix[last + 1] - prefix[first]) * down[first] + (last - first).astype(np.uint64)))
    return first, last, at, smallest, keys[0], keys[1]


def fingerprints(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """One row per window of ``docs`` (doc_id, version, text). Line numbers count all lines of the text from 0."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = as_bytes(batch.column("text"))
            for a, b in blocks(offsets):
                part, border = data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
                starts, ends, owner = spans(part, border, NEWLINE)
                word_starts, _, _ = spans(part, border)
                words = np.bincount(np.searchsorted(starts, word_starts, "right") - 1, minlength=len(starts)) if len(starts) else np.zeros(0, int)
                full = words > 0
                starts, ends, owner, words = starts[full], ends[full], owner[full], words[full]
                breaks = np.concatenate([[0], np.cumsum(part == 10)])
                number = breaks[starts] - breaks[border[owner]]
                # A line without a word goes with the line before it.
                until = breaks[border[owner + 1]] - breaks[border[owner]]
                within = np.flatnonzero(owner[1:] == owner[:-1])
                until[within] = number[within + 1] - 1
                hashes = [hash_spans(part, starts, ends, seed) for seed in (1, 2)]
                first, last, at, print_, key, check = window_minima(hashes, words, owner, least)
                rows = pa.array(owner[first])
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(a, b - a).take(rows), batch.column("version").slice(a, b - a).take(rows),
                    *[pa.array(x.view(np.int64)) for x in (print_, key, check)],
                    *[pa.array(x.astype(np.int32)) for x in (number[at], number[first], until[last])],
                ], ["doc_id", "version", "fingerprint", "key", "check", "line", "from_line", "to_line"])

    schema = "doc_id long, version long, fingerprint long, key long, check long, line int, from_line int, to_line int"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "version", "text").mapInArrow(run, schema)


def repeated_runs(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """Later occurrences of repeated runs: doc_id, version, from_line, to_line, and where the source begins."""
    windows = written(fingerprints(docs, least), "windows")
    place = F.struct("doc_id", "version", "line")
    again = windows.groupBy("fingerprint").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).where("lo < hi").select("fingerprint")
    shared = windows.join(again, "fingerprint", "left_semi")
    begin = F.struct("doc_id", "version", "from_line")
    sources = shared.groupBy("key", "check").agg(F.min(begin).alias("source"), F.max(begin).alias("hi")).where("source < hi").drop("hi")
    matches = shared.join(sources, ["key", "check"]).where(begin > F.col("source"))
    # Extension: windows that overlap or touch, at one distance from one source, are one match. A group is lines of one text.
    same = Window.partitionBy("doc_id", "version", "source.doc_id", "source.version", F.col("from_line") - F.col("source.from_line")).orderBy("from_line", "to_line")
    so_far = F.max("to_line").over(same.rowsBetween(Window.unboundedPreceding, -1))
    opened = matches.withColumn("begins", F.coalesce((F.col("from_line") > so_far + 1).cast("int"), F.lit(1)))
    numbered = opened.withColumn("run", F.sum("begins").over(same.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("doc_id", "version", F.col("source.doc_id").alias("source_doc"), F.col("source.version").alias("source_version"),
                            (F.col("from_line") - F.col("source.from_line")).alias("shift"), "run").agg(
        F.min("from_line").alias("from_line"), F.max("to_line").alias("to_line")).drop("run")


def dedup_lines(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """``docs`` with later repeated runs deleted from ``text``, and ``n_lines`` and ``n_removed``. Every row stays."""
    keyed = docs.withColumn("version", F.xxhash64("text"))
    runs = repeated_runs(keyed.select("doc_id", "version", "text"), least)
    # Runs of one text: at most one for each of its windows.
    gone = runs.groupBy("doc_id", "version").agg(F.collect_set(F.struct("from_line", "to_line")).alias("runs"))
    gone = gone.select(F.col("doc_id").alias("__doc"), F.col("version").alias("__version"), F.array_distinct(F.flatten(
        F.transform("runs", lambda r: F.sequence(r["from_line"], r["to_line"])))).alias("__gone"))
    rows = keyed.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col("__doc")) & (F.col("version") == F.col("__version")), "left")
    lines = F.split("text", "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "__gone")
    cut = F.transform(F.array(lines), lambda ls: F.array_join(F.transform(stay, lambda i: F.get(ls, i)), "\n"))[0]
    return rows.select(
        *[F.when(F.col("__gone").isNull(), F.col("text")).otherwise(cut).alias("text") if c == "text" else F.col(c) for c in docs.columns],
        F.coalesce(F.when(F.length("text") > 0, F.size(lines)), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_removed"))


def op1_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


ORACLE_SQL = r"""
WITH line AS (
  SELECT doc_id, n - 1 AS raw, t FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS n
                                       FROM documents WHERE text <> '')),
full_ AS (SELECT *, len(list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS w FROM line WHERE regexp_matches(t, '[^\x20\x09-\x0D]')),
placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY raw) AS i, sum(w) OVER (PARTITION BY doc_id ORDER BY raw) AS c,
           coalesce(lead(raw) OVER (PARTITION BY doc_id ORDER BY raw) - 1, 1000000000) AS until FROM full_),
texts AS (SELECT doc_id, list(t ORDER BY i) AS ts, list(raw ORDER BY i) AS raws, list(until ORDER BY i) AS untils FROM placed GROUP BY doc_id),
win AS (
  SELECT a.doc_id, a.i AS s, min(b.i) AS e FROM placed a JOIN placed b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.c - a.c + a.w >= 50 GROUP BY a.doc_id, a.i
  UNION
  SELECT b.doc_id, max(a.i), b.i FROM placed a JOIN placed b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.c - a.c + a.w >= 50 GROUP BY b.doc_id, b.i),
content AS (SELECT win.*, array_to_string(list_slice(ts, s, e), chr(10)) AS k, raws[s] AS f, untils[e] AS l FROM win JOIN texts ON texts.doc_id = win.doc_id),
later AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS nth FROM content) WHERE nth > 1),
gone AS (SELECT DISTINCT line.doc_id, line.raw FROM later JOIN line ON line.doc_id = later.doc_id AND line.raw BETWEEN f AND l),
kept AS (SELECT line.doc_id, string_agg(t, chr(10) ORDER BY line.raw) AS t FROM line LEFT JOIN gone ON gone.doc_id = line.doc_id AND gone.raw = line.raw
         WHERE gone.raw IS NULL GROUP BY line.doc_id),
n AS (SELECT doc_id, count(*) AS c FROM gone GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN n.c IS NULL THEN d.text ELSE coalesce(kept.t, '') END AS text,
       CAST(CASE WHEN d.text <> '' THEN len(string_split(d.text, chr(10))) ELSE 0 END AS BIGINT) AS n_lines, CAST(coalesce(n.c, 0) AS BIGINT) AS n_removed
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id
"""
