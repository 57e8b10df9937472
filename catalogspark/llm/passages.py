"""Passage deduplication: winnowing over word windows, so that a repeated run is found wherever it begins.

Every run of ``MIN_WORDS`` words is a window. Its seed is the smallest hash of the short word runs inside it; equal windows
have equal seeds, and neighbours share one, so a text has about one seed for each 18 words. Only seeds are dealt out for
all texts. Windows whose seed is selected elsewhere too go on: first all neighbours of one seed as one content, then, where
contents of a seed differ, one by one. Each meets the first place of its content, never the others.

A word goes if it lies in a window that occurs earlier by (doc_id, word). Where a window overlaps its own source, the
source's words stay, so of ``a a a ...`` the first ``MIN_WORDS`` stay. What is cut mid-line leaves the rest of the line; lines
that lose all words go with the lines without a word behind them.

Copies of a text are one text: only the first one has windows, of later ones everything goes that could match. Texts and
words are told apart by 64-bit hashes, windows by two (seed and content). Defined cases: null texts and texts without words stay;
identical rows are one document and stay alike; a null doc_id comes first; extra columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalogspark.llm.linededup import _STEP, MIN_WORDS, _powers
from catalogspark.llm.staging import written
from catalogspark.llm.text_arrays import as_bytes, blocks, hash_spans, mix, spans


def _sums(hashes: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """One hash of each run of words first..last."""
    n = len(hashes)
    up, down = _powers(_STEP, n), _powers(pow(_STEP, -1, 1 << 64), n)
    with np.errstate(over="ignore"):
        prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * up[:-1])])
        return mix((prefix[last + 1] - prefix[first]) * down[first] + (last - first).astype(np.uint64))


def _least_of(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of every ``width`` values in a row."""
    have = 1
    while have < width:
        step = min(have, width - have)
        values = np.minimum(values[:-step], values[step:])
        have += step
    return values


def word_windows(hashes: np.ndarray, owner: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """First word, last word and seed of every window, and whether the seed may stand there twice. ``owner``: the text
    of each word, ascending."""
    n, k = len(hashes), max(1, least // 3)
    if n < least:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
    grams = _sums(hashes, np.arange(n - k + 1), np.arange(k - 1, n))
    width = least - k + 1
    first = np.arange(n - least + 1)
    seed = _least_of(grams, width)
    again = np.zeros(len(grams), bool)
    for q in range(1, width + 1):
        again[q:] |= grams[q:] == grams[:-q]
    so_far = np.concatenate([[0], np.cumsum(again)])
    # One window more than this one, so that it meets the same run of words right behind it.
    twice = so_far[np.minimum(first + width + 1, len(grams))] > so_far[first]
    whole = owner[first] == owner[first + least - 1]
    return first[whole], first[whole] + least - 1, seed[whole], twice[whole]


def _parts(part: np.ndarray, border: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """Words (start, end, text, hash) of some texts and their windows (first, last, seed, twice)."""
    starts, ends, owner = spans(part, border)
    hashes = hash_spans(part, starts, ends, 1)
    return starts, ends, owner, hashes, *word_windows(hashes, owner, least)


def seeds(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """One row per text and seed: doc_id, version, seed, and whether it is selected there twice."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = as_bytes(batch.column("text"))
            for a, b in blocks(offsets):
                _, _, owner, _, first, _, seed, twice = _parts(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], least)
                text = owner[first]
                new = np.ones(len(first), bool)
                new[1:] = (seed[1:] != seed[:-1]) | (text[1:] != text[:-1])
                begun = np.flatnonzero(new)
                twice = np.logical_or.reduceat(twice, begun) if len(begun) else twice
                order = np.lexsort((seed[begun], text[begun]))
                text, seed, twice = text[begun][order], seed[begun][order], twice[order]
                new = np.ones(len(text), bool)
                new[1:] = (seed[1:] != seed[:-1]) | (text[1:] != text[:-1])
                begun = np.flatnonzero(new)
                if len(begun):
                    twice = np.logical_or.reduceat(twice, begun) | (np.diff(np.append(begun, len(text))) > 1)
                rows = pa.array(text[begun])
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(a, b - a).take(rows), batch.column("version").slice(a, b - a).take(rows),
                    pa.array(seed[begun].view(np.int64)), pa.array(twice)], ["doc_id", "version", "seed", "twice"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "version", "text").mapInArrow(
        run, "doc_id long, version long, seed long, twice boolean")


def _groups(texts: DataFrame, least: int) -> DataFrame:
    """Neighbouring windows of one seed as one row, where it is among the text's ``seeds``: ``key`` is a hash of all their
    words, ``keys`` has one of each window."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = as_bytes(batch.column("text"))
            wanted = batch.column("seeds")
            for a, b in blocks(offsets):
                _, _, owner, hashes, first, last, seed, _ = _parts(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], least)
                text, keep = owner[first], np.zeros(len(first), bool)
                at, to = np.searchsorted(text, np.arange(b - a)), np.searchsorted(text, np.arange(b - a), "right")
                for i in range(b - a):
                    keep[at[i]:to[i]] = np.isin(seed[at[i]:to[i]].view(np.int64), wanted[a + i].values.to_numpy())
                first, last, text, seed = first[keep], last[keep], text[keep], seed[keep]
                new = np.ones(len(first), bool)
                new[1:] = (seed[1:] != seed[:-1]) | (text[1:] != text[:-1]) | (first[1:] != first[:-1] + 1)
                begun = np.flatnonzero(new)
                ended = np.append(begun[1:], len(first)) - 1 if len(begun) else begun
                begins = np.searchsorted(owner, text[begun])
                rows = pa.array(text[begun])
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(a, b - a).take(rows), batch.column("version").slice(a, b - a).take(rows), pa.array(seed[begun].view(np.int64)),
                    pa.array(_sums(hashes, first[begun], last[ended]).view(np.int64)),
                    *[pa.array((x - begins).astype(np.int32)) for x in (first[begun], last[ended] + 1)],
                    pa.ListArray.from_arrays(pa.array(np.append(begun, len(first)).astype(np.int32)), pa.array(_sums(hashes, first, last).view(np.int64))),
                ], ["doc_id", "version", "seed", "key", "from_word", "to_word", "keys"])

    return texts.select(F.col("doc_id").cast("long").alias("doc_id"), "version", "text", "seeds").mapInArrow(
        run, "doc_id long, version long, seed long, key long, from_word int, to_word int, keys array<long>")


def _marked(rows: DataFrame, versions: DataFrame) -> DataFrame:
    """``rows`` and whether their version may be among ``versions``: a filter of 2^25 bits at most, whatever the tables'
    size, so that most texts need not be dealt out. It errs on the side of True only."""
    slot, bit = F.pmod("version", F.lit(1 << 19)), F.shiftrightunsigned("version", 19).bitwiseAND(63)
    bits = versions.groupBy(slot.alias("__slot")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit.cast("int"))).alias("__bits"))
    held = F.call_function("shiftright", F.col("__bits"), bit.cast("int")).bitwiseAND(1) == 1
    return rows.join(F.broadcast(bits), slot == F.col("__slot"), "left").withColumn("__marked", F.coalesce(held, F.lit(False))).drop("__slot", "__bits")


def _later(places: DataFrame, least: int) -> DataFrame:
    """Words that rows of ``places`` (doc_id, version, seed, key, from_word, to_word) have in common with the first of their seed and key."""
    place = F.struct("doc_id", "version", "from_word")
    sources = places.groupBy("seed", "key").agg(F.min(place).alias("source"), F.max(place).alias("hi")).where("source < hi").drop("hi")
    later = places.join(sources, ["seed", "key"]).where(place > F.col("source"))
    own = F.col("version") == F.col("source.version")
    low = F.when(own, F.greatest("from_word", F.col("source.from_word") + least)).otherwise(F.col("from_word"))
    return later.select("version", low.alias("from_word"), "to_word").where("from_word < to_word")


def repeated_words(keyed: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """version and the runs (from_word, to_word) of the words that stand earlier too, of the first copy of every text."""
    found = written(seeds(keyed, least), "seeds")
    shared = found.groupBy("seed").agg(F.min("version").alias("lo"), F.max("version").alias("hi"), F.max("twice").alias("twice")).where(
        "lo < hi or twice").select("seed")
    # Copies of a text have the same seeds; a text has no more seeds than words.
    chosen = written(found.join(shared, "seed", "left_semi").groupBy("version").agg(
        F.min(F.struct("doc_id")).alias("first"), F.collect_set("seed").alias("seeds")), "chosen")
    texts = _marked(keyed, chosen).where("__marked").join(chosen, "version").where(F.col("doc_id").cast("long").eqNullSafe(F.col("first.doc_id")))
    groups = written(_groups(texts, least), "groups")
    # A group that stands earlier as a whole is done with. Of all others, and of first ones, the windows are compared
    # where a seed has several contents, or one content the same window twice.
    firsts = groups.groupBy("seed", "key").agg(F.min(F.struct("doc_id", "version", "from_word")).alias("source"))
    firsts = firsts.withColumn("others", F.count("*").over(Window.partitionBy("seed")))
    one = groups.join(firsts, ["seed", "key"]).where(F.struct("doc_id", "version", "from_word").eqNullSafe(F.col("source")))
    one = one.where((F.col("others") > 1) | (F.size(F.array_distinct("keys")) < F.size("keys")))
    windows = written(one.select("doc_id", "version", "seed", "from_word", F.posexplode("keys").alias("i", "key")).select(
        "doc_id", "version", "seed", "key", (F.col("from_word") + F.col("i")).alias("from_word"), (F.col("from_word") + F.col("i") + least).alias("to_word")), "windows")
    runs = _later(groups.drop("keys"), least).unionByName(_later(windows, least))
    return runs.groupBy("version").agg(F.collect_list(F.struct("from_word", "to_word")).alias("runs"))


def cut(text: bytes, starts: np.ndarray, ends: np.ndarray, gone: np.ndarray) -> bytes:
    """``text`` without the words that are gone."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))).reshape(-1, 2)
    out, at = [], 0
    for i, j in edges.tolist():
        line = text.rfind(b"\n", 0, starts[i]) + 1
        opens = i == 0 or ends[i - 1] <= line
        start = max(line if opens else int(ends[i - 1]), at)
        if j == len(starts):  # nothing follows; the break before a line that goes, goes too
            stop, start = len(text), start - 1 if opens and start > at else start
        else:
            line = text.rfind(b"\n", 0, starts[j]) + 1
            if opens:
                stop = line if line >= ends[j - 1] else int(starts[j])
            elif line >= ends[j - 1]:
                stop = line - 1
            elif line > start:  # a break inside what goes: two lines stay two
                out.append(text[at:start] + b"\n")
                at = int(starts[j])
                continue
            else:
                stop = int(ends[j - 1])
        out.append(text[at:start])
        at = stop
    out.append(text[at:])
    return b"".join(out)


def dedup_passages(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """``docs`` with later repeated runs of words deleted from ``text``, and ``n_removed``, the words that went. Every row stays."""
    keyed = docs.withColumn("version", F.xxhash64("text"))
    runs = repeated_words(keyed.select("doc_id", "version", "text"), least)
    named = F.struct(F.col("doc_id").cast("long").alias("doc_id"))
    copies = keyed.where("text <> ''").groupBy("version").agg(F.min(named).alias("first"), F.max(named).alias("hi")).where("first < hi").select("version", "first")
    gone = written(runs.join(copies, "version", "full").select(F.col("version").alias("__version"), F.col("first").alias("__first"), F.col("runs").alias("__runs")), "gone")
    marked = _marked(keyed, gone.select(F.col("__version").alias("version")))
    rows = marked.where("__marked").join(gone, F.col("version") == F.col("__version"), "left").select(
        *docs.columns, "__runs",
        (F.col("__first").isNotNull() & ~F.col("doc_id").cast("long").eqNullSafe(F.col("__first.doc_id"))).alias("__copy"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed = np.zeros(batch.num_rows, np.int64)
            column, texts = batch.column("text"), None
            runs_, copy = batch.column("__runs"), batch.column("__copy")
            for r in range(batch.num_rows):
                if not (copy[r].as_py() or runs_[r].is_valid):
                    continue
                text = (column[r].as_py() or "").encode()
                data = np.frombuffer(text, np.uint8)
                starts, ends, owner, _, first, last, *_ = _parts(data, np.array([0, len(data)]), least)
                if not copy[r].as_py():
                    pairs = runs_[r].values
                    first, last = pairs.field("from_word").to_numpy(), pairs.field("to_word").to_numpy() - 1
                steps = np.zeros(len(starts) + 1, np.int64)
                np.add.at(steps, first, 1)
                np.add.at(steps, last + 1, -1)
                words = np.cumsum(steps[:-1]) > 0
                removed[r] = words.sum()
                if removed[r]:
                    texts = column.to_pylist() if texts is None else texts
                    texts[r] = cut(text, starts, ends, words).decode()
            out = [(pa.array(texts, column.type) if c == "text" and texts is not None else batch.column(c)) for c in docs_columns]
            yield pa.RecordBatch.from_arrays([*out, pa.array(removed)], [*docs_columns, "n_removed"])

    docs_columns = docs.columns
    cut_rows = rows.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("n_removed", T.LongType())]))
    return cut_rows.unionByName(marked.where("not __marked").select(*docs.columns, F.lit(0).cast("long").alias("n_removed")))


def op1_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_passages(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
