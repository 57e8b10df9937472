"""Periodic run detection in word sequences, by longest common extensions over a difference cover.

A run is a stretch of consecutive words with smallest period q, at least ``max(least, 3q)`` words long, that no
neighbouring word extends keeping that period. Words q apart agree over at least ``s = max(least - q, 2q)`` places of it, so
of the grid of every s-th word one lies inside: over all periods that grid is harmonic, n log n places. At each place
whose two words agree, the longest common extensions of it and its partner q words on, forwards and backwards, give the
whole stretch.

An extension is found over a difference cover: of every ``MODULUS`` residues only those in ``COVER`` are sampled, and for
any two positions some shift below ``MODULUS`` takes both to samples. Only sampled suffixes are sorted (by doubling over
blocks of ``MODULUS`` words). A query compares few words up to the samples, takes the minimum of the neighbours' common
prefixes from a sparse table, and compares few words after it. Many texts share one structure; no match leaves its text.

Texts never meet, so nothing is shuffled. Defined cases: a null text is an empty one, which has no word and no run; null
doc_ids and repeated rows are documents like others; extra columns are ignored. Words are told apart by 64-bit hashes
within blocks of some megabytes; a text longer than that is a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogspark.llm.text_arrays import as_bytes, blocks, hash_spans, mix, spans

LEAST = 24
#: A perfect difference set: every residue but 0 is the difference of exactly one pair.
MODULUS, COVER = 13, (0, 1, 3, 9)
_BLOCK = 8 << 20
_GRID = 2_000_000
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def _shifts() -> np.ndarray:
    """[i, j] -> the smallest shift that takes the residues i and j into the cover."""
    inside = np.isin(np.arange(2 * MODULUS) % MODULUS, COVER)
    both = inside[np.arange(MODULUS)[:, None, None] + np.arange(MODULUS)] & inside[np.arange(MODULUS)[None, :, None] + np.arange(MODULUS)]
    return both.argmax(2)


class Extensions:
    """Longest common extensions between positions of one sequence of symbols (uint64, none is 0)."""

    def __init__(self, symbols: np.ndarray):
        self.symbols = np.concatenate([symbols, np.zeros(3 * MODULUS, np.uint64)])
        n = len(symbols)
        places = [np.arange(r, n, MODULUS) for r in COVER]
        sizes = np.array([len(p) for p in places])
        self.begun = np.zeros(MODULUS, np.int64)
        self.begun[list(COVER)] = np.cumsum(sizes) - sizes
        at = np.concatenate(places)
        block = np.zeros(len(at), np.uint64)
        with np.errstate(over="ignore"):
            for t in range(MODULUS):
                block = mix(block * _PRIME + self.symbols[at + t])
        end = np.repeat(np.cumsum(sizes), sizes)  # where the samples of one residue end
        here = np.arange(len(at))
        levels = [np.unique(block, return_inverse=True)[1].astype(np.int64)]
        step = 1
        while len(at) and int(levels[-1].max()) + 1 < len(at):
            rank = levels[-1]
            on = here + step
            follow = np.where(on < end, rank[np.minimum(on, len(at) - 1)] + 1, 0)
            levels.append(np.unique(rank * (len(at) + 1) + follow, return_inverse=True)[1].astype(np.int64))
            step *= 2
        self.rank = levels[-1]
        order = np.empty(len(at), np.int64)
        order[self.rank] = here
        a, b, common = order[:-1], order[1:], np.zeros(max(len(at) - 1, 0), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            x, y = a + common, b + common
            same = (x < end[a]) & (y < end[b])
            same[same] = levels[k][x[same]] == levels[k][y[same]]
            # Equal ranks of blocks that both reach an end differ in length, so they are never equal beyond it.
            common += same.astype(np.int64) << k
        self.least = [common.astype(np.int32)]
        while 2 << (len(self.least) - 1) <= len(common):
            last, half = self.least[-1], 1 << (len(self.least) - 1)
            self.least.append(np.minimum(last[:-half], last[half:]))
        self.shift = _shifts()

    def _compared(self, i: np.ndarray, j: np.ndarray, length: np.ndarray, until: np.ndarray) -> np.ndarray:
        """``length`` grown word by word while both sides agree, up to ``until``; true where ``until`` was reached."""
        going = np.flatnonzero(length < until)
        while len(going):
            same = self.symbols[i[going] + length[going]] == self.symbols[j[going] + length[going]]
            going = going[same]
            length[going] += 1
            going = going[length[going] < until[going]]
        return length >= until

    def __call__(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Length of the common extension from i and j (i < j), at most ``most``."""
        length = np.zeros(len(i), np.int64)
        shift = self.shift[i % MODULUS, j % MODULUS]
        met = self._compared(i, j, length, np.minimum(shift, most)) & (shift < most)
        far = np.flatnonzero(met)
        if len(far):
            x, y = i[far] + shift[far], j[far] + shift[far]
            x, y = (self.rank[self.begun[z % MODULUS] + z // MODULUS] for z in (x, y))
            lo, hi = np.minimum(x, y), np.maximum(x, y)
            k = np.frexp((hi - lo).astype(np.float64))[1] - 1
            common = np.empty(len(far), np.int64)
            for level in np.unique(k):
                rows = np.flatnonzero(k == level)
                table = self.least[level]
                common[rows] = np.minimum(table[lo[rows]], table[hi[rows] - (1 << int(level))])
            length[far] = np.minimum(length[far] + common * MODULUS, most[far])
            rest = length[far]
            self._compared(i[far], j[far], rest, np.minimum(rest + MODULUS, most[far]))
            length[far] = rest
        return length


def _grid(sizes: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Text, place and period of every point of the grids of all texts, in slices."""
    texts = np.flatnonzero(sizes >= least)
    most = sizes[texts] // 3
    text = np.repeat(texts, most)
    period = np.arange(len(text)) - np.repeat(np.cumsum(most) - most, most) + 1
    step = np.maximum(least - period, 2 * period)
    points = (sizes[text] - period + step - 1) // step
    total = np.cumsum(points)
    at = 0
    while at < len(text):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + _GRID, "right")))
        n = points[at:to]
        which = np.repeat(np.arange(at, to), n)
        place = (np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)) * step[which]
        yield text[which], place, period[which]
        at = to


def runs_of(symbols: np.ndarray, begun: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, ...]:
    """Text, start, length and period of all runs, by text, start and period. Text t is ``symbols[begun[t]:begun[t + 1]]``."""
    sizes, n = np.diff(begun), len(symbols)
    found, ahead_of, back_of = [np.zeros((4, 0), np.int64)], None, None
    for text, place, period in _grid(sizes, least):
        i = begun[text] + place
        same = symbols[i] == symbols[i + period]
        text, i, period = text[same], i[same], period[same]
        if not len(text):
            continue
        if ahead_of is None:
            # Symbols of different texts differ, so that sorting suffixes ends early.
            with np.errstate(over="ignore"):
                own = mix(symbols + np.repeat(np.arange(len(sizes)), sizes).astype(np.uint64) * _PRIME) | np.uint64(1)
            ahead_of = Extensions(own)
        ahead = ahead_of(i, i + period, begun[text + 1] - i - period)
        # What would be too short even if all before it agreed needs no look back.
        maybe = ahead + (i - begun[text]) + period >= np.maximum(least, 3 * period)
        text, i, period, ahead = text[maybe], i[maybe], period[maybe], ahead[maybe]
        if not len(text):
            continue
        back_of = back_of or Extensions(own[::-1])
        back = back_of(n - i - period, n - i, i - begun[text])
        length = back + ahead + period
        long = length >= np.maximum(least, 3 * period)
        found.append(_smallest(np.stack([text, i - back - begun[text], length, period])[:, long]))
    rows = _smallest(np.concatenate(found, axis=1))
    return tuple(rows[:, np.lexsort((rows[3], rows[1], rows[0]))])


def _smallest(rows: np.ndarray) -> np.ndarray:
    """Each stretch (text, start, length) once, with its smallest period: a stretch is found at every grid point in it and
    for every multiple of that period."""
    rows = rows[:, np.lexsort((rows[3], rows[2], rows[1], rows[0]))]
    first = np.ones(rows.shape[1], bool)
    first[1:] = (rows[:3, 1:] != rows[:3, :-1]).any(0)
    return rows[:, first]


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, owner: np.ndarray, n_texts: int) -> pa.Array:
    """Texts of the given words (by ``owner``, ascending), one blank between two."""
    last = np.ones(len(owner), bool)
    last[:-1] = owner[1:] != owner[:-1]
    sizes = ends - starts + ~last
    begun = np.cumsum(sizes) - sizes
    out = np.full(int(sizes.sum()), 0x20, np.uint8)
    lengths = ends - starts
    inside = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[np.repeat(begun, lengths) + inside] = data[np.repeat(starts, lengths) + inside]
    offsets = np.zeros(n_texts + 1, np.int64)
    offsets[1:] = np.cumsum(np.bincount(owner, sizes, n_texts).astype(np.int64))
    return pa.LargeStringArray.from_buffers(n_texts, pa.py_buffer(offsets), pa.py_buffer(out))


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def periodic_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, n_words, ``runs`` (array of start, length, period in words, by start and period) and ``collapsed``, the text
    without all but the first period of each run, its words joined by one blank. One row for each row of ``docs``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = as_bytes(batch.column("text"))
            for a, b in blocks(offsets, _BLOCK):
                part, n_texts = data[offsets[a]:offsets[b]], b - a
                starts, ends, owner = spans(part, offsets[a:b + 1] - offsets[a])
                begun = np.searchsorted(owner, np.arange(n_texts + 1))
                text, start, length, period = runs_of(hash_spans(part, starts, ends), begun, least)
                # Words covered by any run after its first period.
                depth = np.zeros(len(starts) + 1, np.int64)
                np.add.at(depth, begun[text] + start + period, 1)
                np.add.at(depth, begun[text] + start + length, -1)
                stay = np.cumsum(depth[:-1]) == 0
                lists = np.searchsorted(text, np.arange(n_texts + 1)).astype(np.int32)
                values = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], fields=list(_RUN))
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(a, n_texts), pa.array(np.diff(begun)), pa.ListArray.from_arrays(pa.array(lists), values),
                    _joined(part, starts[stay], ends[stay], owner[stay], n_texts).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def with_planted_period(doc_id: Column, text: Column) -> Column:
    """Text whose words from some place on repeat, for every tenth document by the CRC of its id; null ids stay as they are."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def planted(words: Column) -> Column:
        n = F.size(words)
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        return F.when(n > 0, F.concat_ws(" ", F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, F.when(
            i < a, i).otherwise(a + (i - a) % p).cast("int"))))).otherwise("")

    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    return F.when(h % 10 == 0, F.transform(F.array(words), planted)[0]).otherwise(text)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = periodic_runs(docs.select("doc_id", with_planted_period(F.col("doc_id"), F.coalesce("text", F.lit(""))).alias("text")))

    def better(best: Column, r: Column) -> Column:
        # Exact comparison of length/period; runs come by start and period, so the first of equals stays.
        return F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)

    best = F.aggregate("runs", F.lit(None).cast("struct<start: long, length: long, period: long>"), better)
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    digest = F.sha2(F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")).cast("binary"), 256)
    rows = rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), digest.alias("runs_sha256"),
                       F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    return rows.select("doc_id", "n_runs", "best.start", "best.length", "best.period",
                       F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
                       "runs_sha256", "collapsed_sha256")
