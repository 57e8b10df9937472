"""Spelling variants: words that differ by one inserted, deleted or replaced code point, and the commoner form of each.

Candidate pairs come from blocked Gram matrices. With the letter counts of a block's words as rows, one NumPy product gives
all squared distances of the block; one edit changes them by at most two, so pairs at most two apart stay and are then
verified. Only words of one length, or of adjacent lengths, lie in a block.

A block further holds only words that agree outside one of their ``parts``: one edit leaves all parts but one as they
are, at the start and at the end of the word. The parts of the common length have at most three letters in words of up
to 24, so a block's size is bounded by the alphabet there and does not grow with the vocabulary. A pair is met in exactly
one block, that of its first difference. Blocks beyond ``TILE`` words are dealt to tiles by a hash, and each pair of tiles
is a piece of work of its own, so neither rows nor memory of a task depend on the largest block.

Counting is a grouped aggregation over all runs of letters. Forms lead to words at least ten times as frequent, so chains
are short; roots are found by pointer doubling over written tables.

Defined cases: null and empty texts hold no word; a null doc_id counts as an empty one in the digest; repeated rows
count each; extra columns are ignored; without words the result is empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogspark.llm.staging import written
from catalogspark.llm.text_arrays import as_bytes

SHORTEST, LEAST, RATIO = 7, 2, 10
TILE = 1000
#: Rows of one product; blocks are taken together up to it.
_ROWS = 256
_LETTERS = 90


def misspelt_words(docs: DataFrame) -> DataFrame:
    """(word, n) of all runs of letters with at least ``SHORTEST`` code points; one run in 31, by the CRC of its document and
    itself, has lost one code point."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(F.regexp_extract_all(
        "text", F.lit(f"[A-Za-z\\u00C0-\\u00FF]{{{SHORTEST},}}"), F.lit(0))).alias("run"))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    runs = runs.select("doc", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", upper, upper.lower())).otherwise(F.col("run")).alias("run"))
    h, run = F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary")), F.col("run")
    at = (h % F.length(run)).cast("int")
    word = F.when(h % 31 == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)
    return runs.select(word.alias("word")).where(F.length("word") >= SHORTEST).groupBy("word").agg(F.count("*").alias("n"))


def _parts(length: Column) -> Column:
    return F.greatest(F.lit(3), F.least(F.lit(8), F.ceil(length / 3).cast("int")))


def _border(length: Column, part: Column, parts: Column) -> Column:
    return F.floor(length * part / parts).cast("int")


def _blocks_of(word: Column, longer: int) -> Column:
    """Blocks of a word as one of the common length ``size`` (or, with ``longer``, one code point longer)."""
    size = F.length(word) - longer
    parts = _parts(size)

    def block(j: Column) -> Column:
        begin, rest = _border(size, j, parts), size - _border(size, j + 1, parts)
        ends = F.struct(F.substring(word, F.lit(1), begin), F.when(rest > 0, F.right(word, rest)).otherwise(""))
        return F.struct(F.xxhash64(size, j, ends).alias("key"), size.alias("size"), j.alias("part"))

    return F.when(size >= 1, F.transform(F.sequence(F.lit(0), parts - 1), block)).otherwise(F.array().cast("array<struct<key: long, size: int, part: int>>"))


def _code_points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words in a row, and where each word begins."""
    data, offsets = as_bytes(column)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    return points, np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]


def letter_counts(points: np.ndarray, begun: np.ndarray) -> np.ndarray:
    """One row of counts per word: a column for each of a-z and of the 64 Latin letters; others share them."""
    n = len(begun) - 1
    column = np.where((points >= 97) & (points <= 122), points - 97, np.where((points >= 192) & (points <= 255), points - 166, points % _LETTERS))
    row = np.repeat(np.arange(n), np.diff(begun))
    kind = np.float32 if not n or np.diff(begun).max() < 2000 else np.float64  # squares stay exact
    return np.bincount(row * _LETTERS + column.astype(np.int64), minlength=n * _LETTERS).reshape(n, _LETTERS).astype(kind)


def near_rows(counts: np.ndarray, group: np.ndarray, short: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows (a, b) of one group at a squared distance of at most two: both short, or a short and b longer."""
    squares = (counts ** 2).sum(1)
    a = np.flatnonzero(short)
    gram = counts[a] @ counts.T
    near = (squares[a][:, None] + squares[None, :] - 2 * gram <= 2) & (group[a][:, None] == group[None, :])
    near &= ~short[None, :] | (a[:, None] < np.arange(len(group))[None, :])
    x, b = np.nonzero(near)
    return a[x], b


def _outside(size: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points before and after a part."""
    parts = np.maximum(3, np.minimum(8, -(-size.astype(np.int64) // 3)))
    return size * part.astype(np.int64) // parts, size - size * (part.astype(np.int64) + 1) // parts


def one_edit(points: np.ndarray, begun: np.ndarray, size: np.ndarray, part: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs differ by one edit whose first place lies in their block's part. Outside the part they agree."""
    parts = np.maximum(3, np.minimum(8, -(-size // 3)))
    low, after = _outside(size, part)
    width = size - after - low
    extra = np.diff(begun) - size
    column = np.arange(int(width.max()) + 1)
    inside = column[None, :] < (width + extra)[:, None]
    at = np.minimum((begun[:-1] + low)[:, None] + column[None, :], max(len(points) - 1, 0))
    middle = np.where(inside, points[at].astype(np.int64), -1)
    x, y = middle[a], middle[b]
    unlike = x != y
    first = unlike.argmax(1)
    replaced = (extra[b] == 0) & (unlike.sum(1) == 1)
    moved = (x[:, :-1] != y[:, 1:]) & (column[None, :-1] >= first[:, None])
    inserted = (extra[b] == 1) & ~moved.any(1) & ((first < width[a]) | (part[a] == parts[a] - 1))
    return replaced | inserted


def _grouped_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of words from rows that are sorted by block and cell."""
    def found(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        key, cell, tile, size, part, count = (rows.column(c).to_numpy() for c in ("key", "cell", "tile", "size", "part", "n"))
        changed = (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])
        group = np.concatenate([[0], np.cumsum(changed)])
        _, first, many = np.unique(group, return_index=True, return_counts=True)
        keep = np.flatnonzero(many[group] > 1)
        if not len(keep):
            return
        words = rows.column("word").combine_chunks().take(pa.array(keep))
        group, cell, tile, size, part, count = (x[keep] for x in (group, cell, tile, size, part, count))
        points, begun = _code_points(words)
        borders = np.append(np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])), len(group))
        pairs, at = [], 0
        while at < len(borders) - 1:
            to = max(at + 1, int(np.searchsorted(borders, borders[at] + _ROWS, "right")) - 1)
            lo, hi = borders[at], borders[to]
            mine = slice(lo, hi)
            own, starts = points[begun[lo]:begun[hi]], begun[lo:hi + 1] - begun[lo]
            a, b = near_rows(letter_counts(own, starts), group[mine], np.diff(starts) == size[mine])
            # Keys are hashes: rows of another kind that share one are told apart. A cell of two tiles pairs across them.
            ok = (size[mine][a] == size[mine][b]) & (part[mine][a] == part[mine][b]) & ((cell[mine][a] % 2 == 0) | (tile[mine][a] != tile[mine][b]))
            a, b = a[ok], b[ok]
            if len(a):
                ok = one_edit(own, starts, size[mine], part[mine], a, b)
                a, b = a[ok] + lo, b[ok] + lo
                pairs.append((a, b, *_outside(size[a], part[a])))
            at = to
        if pairs:
            a, b, before, after = (np.concatenate(x) for x in zip(*pairs))
            yield pa.RecordBatch.from_arrays([words.take(pa.array(a)), pa.array(count[a]), words.take(pa.array(b)), pa.array(count[b]),
                                              pa.array(before.astype(np.int32)), pa.array(after.astype(np.int32))], ["a", "a_n", "b", "b_n", "before", "after"])

    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        if not rows.num_rows:
            continue
        key, cell = rows.column("key").to_numpy(), rows.column("cell").to_numpy()
        last = np.flatnonzero((key != key[-1]) | (cell != cell[-1]))
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield from found(rows.slice(0, cut))
        held = rows.slice(cut)
    if held is not None and held.num_rows:
        yield from found(held)


def near_pairs(words: DataFrame, tile: int = TILE) -> DataFrame:
    """a, a_n, b, b_n of every two words of ``words`` (word, n; distinct) that one edit turns into each other, once."""
    rows = words.select("word", "n", F.explode(F.concat(_blocks_of(F.col("word"), 0), _blocks_of(F.col("word"), 1))).alias("b"))
    rows = rows.select("word", "n", "b.*")
    large = rows.groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") > tile).select("key", F.ceil(F.col("m") / tile).cast("int").alias("tiles"))
    rows = rows.join(large, "key", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    # A tile meets itself (even cells) and every other tile of its block (odd cells).
    own = F.pmod(F.xxhash64("word"), F.col("tiles")).cast("int")
    rows = rows.withColumn("tile", own)
    cells = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda u: F.when(u == F.col("tile"), u.cast("long") * 2).otherwise(
        (F.least(u, F.col("tile")).cast("long") * F.col("tiles") + F.greatest(u, F.col("tile"))) * 2 + 1))
    rows = rows.withColumn("cell", F.explode(cells)).select("key", "cell", "tile", "size", "part", "word", "n")
    rows = rows.repartition("key", "cell").sortWithinPartitions("key", "cell")
    pairs = rows.mapInArrow(_grouped_pairs, "a string, a_n long, b string, b_n long, before int, after int")
    # Blocks are known by a hash: what lies outside the part is compared itself.
    ends = [F.struct(F.substring(w, F.lit(1), F.col("before")), F.when(F.col("after") > 0, F.right(w, F.col("after"))).otherwise("")) for w in (F.col("a"), F.col("b"))]
    return pairs.where(ends[0] == ends[1]).drop("before", "after")


def spelling_groups(words: DataFrame, ratio: int = RATIO, tile: int = TILE) -> DataFrame:
    """word, form, root, n, n_near, form_n of every row of ``words`` (word, n; distinct)."""
    words = written(words.select("word", F.col("n").cast("long").alias("n")), "words")
    met = near_pairs(words, tile).select(F.explode(F.array(
        F.struct(F.col("a").alias("word"), F.col("a_n").alias("n"), F.col("b").alias("other"), F.col("b_n").alias("other_n")),
        F.struct(F.col("b").alias("word"), F.col("b_n").alias("n"), F.col("a").alias("other"), F.col("a_n").alias("other_n")))).alias("p")).select("p.*")
    alone = words.select("word", "n", F.lit(None).cast("string").alias("other"), F.lit(None).cast("long").alias("other_n"))
    rows = met.unionByName(alone).groupBy("word", "n").agg(
        F.count("other").alias("n_near"),
        F.min(F.when(F.col("other").isNotNull(), F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form")))).alias("best"))
    far = -F.col("best.less") >= ratio * F.col("n")
    rows = written(rows.select("word", "n", "n_near", F.when(far, F.col("best.form")).alias("form"), F.when(far, -F.col("best.less")).alias("form_n")), "forms")
    steps = rows.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    steps = written(steps, "steps")
    while True:
        on = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = written(steps.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "steps")
        steps = moved.drop("moved")
        if moved.where("moved").isEmpty():
            break
    return rows.join(steps, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = misspelt_words(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return spelling_groups(words.where(F.col("n") >= LEAST))
