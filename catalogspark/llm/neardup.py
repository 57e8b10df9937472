"""Near-duplicates by DartMinHash signatures, banded joining and exact verification.

Each text is a weighted set of shingles of five words. Every element throws a stream of hashed darts into its own strip
of weights: a dart has a position on the weight axis, a rank (arrivals of a Poisson process, so any text sees the same
darts) and a coordinate. A dart counts if its position lies inside the element's weight. The earliest dart of a
coordinate is its signature value; two texts agree in a coordinate with the probability of their weighted Jaccard
similarity. Only darts up to a rank that fills about all coordinates are thrown, k log k of them per text whatever its
length. Production weights are 1 for each distinct shingle, so the similarity is the Jaccard similarity of shingle sets;
``weights="count"`` gives the weighted form.

Exact copies are folded first, so signatures are made for distinct texts only. Bands of four coordinates join texts: in
every bucket each text meets one centre only. Links are verified on whole shingle sets and followed to classes. Buckets
that still hold several classes get new centres for a few rounds; pairs that are open even then (both in one bucket, in
different classes) are met in a last join, after a filter on set sizes, on the number of shingles that other classes have
at all and on the whole signature, and verified as well.
No pair inside a class that is already known is emitted. The last filter's signatures are packed, two bits of each coordinate;
it passes all but six deviations below the expected agreement, which loses a pair of similarity 0.8 with probability
1e-9. What the first filters lose is met there again, so the loss is that of 20 bands of 4, 3e-5 for such a pair.

Defined cases: a null text is a class of its own; equal texts are one class, empty ones included; a text without words
has no shingles and is like equal texts only; a text of one to four words is one shorter shingle; repeated rows and ties
get the same class, whose id is the smallest doc_id in it; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogspark.llm.staging import written
from catalogspark.llm.text_arrays import as_bytes, blocks, hash_spans, mix, shingles, spans

BANDS, ROWS, SIMILARITY = 20, 4, 0.8
#: Rounds in which open buckets get a new centre before their remaining pairs are met one by one.
CENTRES = 2
PRUNES = 3
#: Coordinates of the last filter's signatures, bits kept of each, and how many deviations below the expected agreement pass.
PRECISE, PLANES, DEVIATIONS = 1024, 2, 6


def elements(words: np.ndarray, owner: np.ndarray, weights: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles with text and weight, ordered by text."""
    hashes, texts = shingles(words, owner)
    order = np.lexsort((hashes, texts))
    hashes, texts = hashes[order], texts[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (texts[1:] != texts[:-1])
    first = np.flatnonzero(new)
    counts = np.diff(np.append(first, len(hashes))).astype(float)
    return hashes[first], texts[first], counts if weights == "count" else np.ones(len(first))


def _unit(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)


def dart_signatures(element: np.ndarray, text: np.ndarray, weight: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts (ascending) and one row of ``k`` signature values for each. Elements are ordered by text."""
    # A weight above one takes several strips of width one; the last may be cut.
    strips = np.maximum(np.ceil(weight), 1).astype(np.int64)
    at = np.repeat(np.arange(len(element)), strips)
    strip = np.arange(len(at)) - np.repeat(np.cumsum(strips) - strips, strips)
    key = mix(element[at] + mix(strip.astype(np.uint64)))
    width = np.minimum(weight[at] - strip, 1.0)
    texts, owner = np.unique(text[at], return_inverse=True)
    total = np.bincount(owner, width, len(texts))
    reach = (k * np.log(k) + 2 * k) / total
    best_rank = np.full(len(texts) * k, np.inf)
    best = np.zeros(len(texts) * k, np.uint64)
    rank, thrown = np.zeros(len(at)), 0
    waiting = np.arange(len(at))
    while True:
        active = waiting
        while len(active):
            thrown += 1
            # The number of the dart is part of its hash; every element throws its darts in the same order.
            dart = mix(key[active] + np.uint64((thrown * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF))
            rank[active] -= np.log(_unit(mix(dart + np.uint64(1))))
            within = rank[active] < reach[owner[active]]
            active, dart = active[within], dart[within]
            inside = _unit(mix(dart + np.uint64(2))) < width[active]
            _keep_earliest(best_rank, best, owner[active[inside]] * k + (mix(dart[inside] + np.uint64(3)) % np.uint64(k)).astype(np.int64), rank[active[inside]], dart[inside])
        empty = np.isinf(best_rank).reshape(len(texts), k).any(1)
        if not empty.any():
            return texts, best.reshape(len(texts), k)
        # A few texts have coordinates without a dart: theirs are thrown anew from the first, up to a later rank.
        again = empty[owner]
        reach[empty] *= 1.6
        waiting = np.flatnonzero(again)
        rank[waiting], thrown = 0.0, 0


def _keep_earliest(best_rank: np.ndarray, best: np.ndarray, cell: np.ndarray, rank: np.ndarray, dart: np.ndarray) -> None:
    order = np.lexsort((rank, cell))
    cell, rank, dart = cell[order], rank[order], dart[order]
    first = np.ones(len(cell), bool)
    first[1:] = cell[1:] != cell[:-1]
    cell, rank, dart = cell[first], rank[first], dart[first]
    earlier = rank < best_rank[cell]
    best_rank[cell[earlier]], best[cell[earlier]] = rank[earlier], dart[earlier]


def _words(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Blocks of texts with the hashes and texts of their words."""
    data, offsets = as_bytes(column)
    for a, b in blocks(offsets):
        part = data[offsets[a]:offsets[b]]
        starts, ends, owner = spans(part, offsets[a:b + 1] - offsets[a])
        yield a, b, hash_spans(part, starts, ends), owner


def _lists(owner: np.ndarray, n: int, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.searchsorted(owner, np.arange(n + 1)).astype(np.int32), values)


def signed(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, weights: str = "unit") -> DataFrame:
    """``docs`` (id, key, text) as id, key, ``sig`` (coordinates cut to 16 bits, for the filter), ``size`` (elements) and
    ``buckets`` (one hash per band). A text without words has none. Rows stay where they are."""
    k = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, words, owner in _words(batch.column("text")):
                element, text, weight = elements(words, owner, weights)
                if len(element):
                    present, signature = dart_signatures(element, text, weight, k)
                else:
                    present, signature = np.zeros(0, np.int64), np.zeros((0, k), np.uint64)
                band = signature.reshape(len(present), bands, rows)
                keys = np.zeros((len(present), bands), np.uint64) + np.arange(bands, dtype=np.uint64)
                for r in range(rows):
                    keys = mix(keys * np.uint64(3) + band[:, :, r])
                cut = (signature >> np.uint64(48)).astype(np.uint16).view(np.int16)
                yield pa.RecordBatch.from_arrays([
                    batch.column("id").slice(a, b - a), batch.column("key").slice(a, b - a),
                    _lists(np.repeat(present, k), b - a, pa.array(cut.ravel())),
                    pa.array(np.bincount(text, weight, b - a).astype(np.int64)),
                    _lists(np.repeat(present, bands), b - a, pa.array(keys.view(np.int64).ravel())),
                ], ["id", "key", "sig", "size", "buckets"])

    return docs.select("id", "key", "text").mapInArrow(run, "id long, key string, sig array<smallint>, size long, buckets array<long>")


def gram_sets(docs: DataFrame, weights: str = "unit") -> DataFrame:
    """(id, grams) of ``docs`` (id, text): distinct shingle hashes, or with weights="count" one hash per occurrence."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, words, owner in _words(batch.column("text")):
                element, text, weight = elements(words, owner, weights)
                times = weight.astype(np.int64)
                nth = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
                element, text = np.repeat(element, times) + mix(nth.astype(np.uint64)) * (nth > 0).astype(np.uint64), np.repeat(text, times)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), _lists(text, b - a, pa.array(element.view(np.int64)))], ["id", "grams"])

    return docs.select("id", "text").mapInArrow(run, "id long, grams array<long>")


def _promising(pairs: DataFrame, brief: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) whose sizes allow ``similarity`` and whose signatures agree often enough."""
    one, two = (brief.select(F.col("id").alias(s), F.col("sig").alias(f"sig_{s}"), F.col("size").alias(f"size_{s}")) for s in "ab")
    return pairs.join(one, "a").join(two, "b").where(_near(similarity)).select("a", "b").distinct()


def _sizes_allow(similarity: float) -> Column:
    return F.least("size_a", "size_b") >= F.lit(similarity) * F.greatest("size_a", "size_b")


def _near(similarity: float) -> Column:
    agreeing = F.size(F.filter(F.zip_with("sig_a", "sig_b", lambda x, y: x == y), lambda same: same))
    # Four and a half deviations below the expected number of agreements.
    least = F.size("sig_a") * similarity - 4.5 * F.sqrt(F.size("sig_a") * similarity * (1 - similarity))
    return _sizes_allow(similarity) & (agreeing >= least)


def packed(signature: np.ndarray, planes: int = PLANES) -> np.ndarray:
    """``planes`` bits of every coordinate, plane by plane, 64 coordinates to a word."""
    words = [np.packbits(((signature >> np.uint64(63 - i)) & np.uint64(1)).astype(np.uint8), axis=1, bitorder="little").view("<i8") for i in range(planes)]
    return np.concatenate(words, 1)


def least_agreement(similarity: float, k: int = PRECISE, planes: int = PLANES) -> int:
    """Agreements of packed coordinates that texts of ``similarity`` reach but for ``DEVIATIONS`` deviations; unlike values
    agree by chance in all planes."""
    p = similarity + (1 - similarity) / (1 << planes)
    return int(np.floor(k * p - DEVIATIONS * np.sqrt(k * p * (1 - p))))


def _near_packed(similarity: float) -> Column:
    words, unlike = PRECISE // 64, F.lit(0)
    for w in range(words):
        bits = None
        for i in range(PLANES):
            x = F.get("sig_a", F.lit(i * words + w)).bitwiseXOR(F.get("sig_b", F.lit(i * words + w)))
            bits = x if bits is None else bits.bitwiseOR(x)
        unlike = unlike + F.bit_count(bits)
    return _sizes_allow(similarity) & (F.lit(PRECISE) - unlike >= least_agreement(similarity))


def _precise(grams: DataFrame, k: int) -> DataFrame:
    """(id, sig) of ``k`` packed coordinates, from gram sets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                batch = whole.slice(at, 200)
                lists = batch.column("grams")
                n = lists.value_lengths().to_numpy(zero_copy_only=False)
                element = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                present, signature = dart_signatures(element, np.repeat(np.arange(len(n)), n), np.ones(len(element)), k)
                bits = packed(signature)
                yield pa.RecordBatch.from_arrays([batch.column("id"), _lists(np.repeat(present, bits.shape[1]), len(n), pa.array(bits.ravel()))], ["id", "sig"])

    return grams.select("id", "grams").mapInArrow(run, "id long, sig array<long>")


def _only(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``rows`` whose id may be among ``ids``, by a filter of 2^25 bits at most, whatever the tables' size: rows that a join would
    drop need not be dealt out. It errs on the side of keeping."""
    def slot(h: Column) -> Column:
        return F.pmod(h, F.lit(1 << 19))

    def bit(h: Column) -> Column:
        return F.shiftrightunsigned(h, 19).bitwiseAND(63).cast("int")

    h = F.xxhash64("id")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit(h))
    bits = ids.select("id").groupBy(slot(h).alias("__slot")).agg(F.bit_or(one).alias("__bits"))
    held = F.call_function("shiftright", F.col("__bits"), bit(h)).bitwiseAND(1) == 1
    return rows.join(F.broadcast(bits), slot(h) == F.col("__slot")).where(held).drop("__slot", "__bits")


def _alike(pairs: DataFrame, grams: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) that reach ``similarity``, by the intersection of whole gram sets. Only the sets of either side are moved."""
    pairs = written(pairs.select("a", "b"), "pairs")
    left, right = (_only(grams, pairs.select(F.col(s).alias("id"))).select(F.col("id").alias(s), F.col("grams").alias(f"g{s}")) for s in "ab")
    shared = F.size(F.array_intersect("ga", "gb"))
    total = F.size("ga") + F.size("gb")
    return pairs.join(left, "a").join(right, "b").where(shared >= F.lit(similarity) * (total - shared)).select("a", "b")


def _shareable(open_: DataFrame, grams: DataFrame, sizes: DataFrame, similarity: float) -> DataFrame:
    """(id, size, shareable): how many shingles of an open text occur in another class at all. Texts that could not reach
    ``similarity`` with anything, as too many of their shingles are their class's own, are left out."""
    of = open_.select("id", "class").distinct()
    placed = of.join(_only(grams, of), "id").select("id", "class", F.explode("grams").alias("gram"))
    common = placed.groupBy("gram").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo < hi").select("gram")
    counted = placed.join(common, "gram").groupBy("id").agg(F.count("*").alias("shareable"))
    return counted.join(sizes, "id").where(F.col("shareable") >= similarity * F.col("size"))


def follow(links: DataFrame) -> DataFrame:
    """(id, class) for every id that has a link: the smallest id that links lead to.

    Every class takes the smallest label among its neighbours and then that label's own label, so the rounds grow with
    the logarithm of a chain's length. Links stay only while their ends differ, and only between classes."""
    edges = written(links.select("a", "b").where("a <> b").distinct(), "edges")
    labels = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("class", F.col("id"))
    while True:
        ends = (edges.join(labels.select(F.col("id").alias("a"), F.col("class").alias("ca")), "a")
                .join(labels.select(F.col("id").alias("b"), F.col("class").alias("cb")), "b").where("ca <> cb"))
        edges = written(ends.select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct(), "edges")
        if edges.isEmpty():
            return labels
        best = edges.groupBy(F.col("b").alias("class")).agg(F.min("a").alias("to"))
        jump = best.select(F.col("class").alias("to"), F.col("to").alias("further"))
        best = best.join(jump, "to", "left").select("class", F.coalesce("further", "to").alias("to"))
        labels = written(labels.join(best, "class", "left").select("id", F.coalesce("to", "class").alias("class")), "labels")


def _open(members: DataFrame, found: DataFrame, step: int) -> DataFrame:
    """Members (bucket, id, class) of buckets with several classes, with the bucket's largest class and, for this step,
    a member of it. A class counts once per task and bucket before it is shuffled."""
    labelled = members.select("bucket", "id").join(found, "id", "left").withColumn("class", F.coalesce("class", "id"))
    labelled = written(labelled, "labelled")
    any_ = F.min_by("id", F.xxhash64("id", "bucket", F.lit(step)))
    per_class = labelled.groupBy("bucket", "class").agg(F.count("*").alias("n"), any_.alias("one"))
    largest = per_class.groupBy("bucket").agg(F.max_by(F.struct("class", "one"), F.struct("n", "class")).alias("m"), F.count("*").alias("kinds"))
    largest = largest.where("kinds > 1").select("bucket", F.col("m.class").alias("main"), F.col("m.one").alias("centre"))
    return written(labelled.join(largest, "bucket"), "open")


def _with_key(docs: DataFrame) -> DataFrame:
    unknown = F.concat(F.lit("\u0000"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    return docs.withColumn("key", F.sha2(F.coalesce("text", unknown), 256))


def classes(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, weights: str = "unit") -> DataFrame:
    """(doc_id, class_id, n_in_class) for every row of ``docs`` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    signatures = written(signed(_with_key(docs), bands, rows, weights), "signatures")
    # Exact copies: the smallest id of a text stands for it, the smallest text of an id for the id.
    first = written(signatures.groupBy("key").agg(F.min("id").alias("first")), "first")
    keys = first.groupBy(F.col("first").alias("id")).agg(F.min("key").alias("key"))
    distinct = signatures.join(keys, ["id", "key"], "left_semi").dropDuplicates(["id"])
    brief = written(distinct.where("size > 0").select("id", "sig", "size", "buckets"), "distinct")

    placed = brief.select("id", F.explode("buckets").alias("bucket"))
    shared = placed.groupBy("bucket").agg(F.min("id").alias("centre"), F.count("*").alias("n")).where("n > 1").drop("n")
    members = written(placed.join(shared, "bucket"), "members")
    # Whole shingle sets of the texts that share a bucket; no other text moves.
    needed = written(members.select("id").distinct().join(keys, "id"), "needed")
    texts = _with_key(_only(docs, needed)).join(needed, ["id", "key"], "left_semi").dropDuplicates(["id"])
    grams = written(gram_sets(texts, weights), "grams")
    sizes = written(grams.select("id", F.size("grams").cast("long").alias("size")), "sizes")
    # The first centre of a bucket is its smallest id.
    star = members.where("id <> centre").select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct()
    links = written(_alike(_promising(star, brief, similarity), grams, similarity), "found")
    found = follow(links)

    # Buckets with members of several classes are open. Their members outside the largest class meet one other member of
    # that class, a new one in each round; most of what the first centre left open closes in one of the buckets.
    for step in range(CENTRES):
        open_ = _open(members, found, step)
        if open_.isEmpty():
            break
        fresh = open_.where("class <> main").select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct()
        more = written(_alike(_promising(fresh, brief, similarity), grams, similarity), "found")
        links = links.unionByName(more)
        found = follow(links)

    # The rest, exactly: members outside a bucket's largest class meet those of every other class; no pair inside a class.
    # Texts that share too little with other classes cannot have a link there and are not met.
    open_ = _open(members, found, CENTRES)
    for _ in range(PRUNES):  # without the texts left out, others share less
        able = written(_shareable(open_, grams, sizes, similarity), "shareable")
        open_ = open_.select("bucket", "id", "class", "main").join(able, "id")
    precise = written(_precise(_only(grams, able), PRECISE), "precise")
    open_ = written(open_.join(precise, "id").join(brief.select("id", "buckets"), "id"), "open")
    minor = open_.where("class <> main").select("bucket", *[F.col(c).alias(f"{c}_a") for c in ("id", "class", "sig", "size", "shareable", "buckets")])
    others = open_.select("bucket", "main", *[F.col(c).alias(f"{c}_b") for c in ("id", "class", "sig", "size", "shareable", "buckets")])
    once = (F.col("class_a") < F.col("class_b")) | (F.col("class_b") == F.col("main"))
    enough = F.least("shareable_a", "shareable_b") >= F.lit(similarity / (1 + similarity)) * (F.col("size_a") + F.col("size_b"))
    first_shared = F.array_min(F.array_intersect("buckets_a", "buckets_b")) == F.col("bucket")  # a pair comes from one bucket
    cross = minor.join(others, "bucket").where((F.col("class_a") != F.col("class_b")) & once & enough & first_shared & _near_packed(similarity))
    cross = written(cross.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct(), "pairs")
    links = links.unionByName(_alike(cross, grams, similarity))

    final = follow(links).withColumnRenamed("id", "first").withColumnRenamed("class", "class_id")
    rows_ = signatures.select("id", "key").join(first, "key").join(final, "first", "left")
    rows_ = rows_.select(F.col("id").alias("doc_id"), F.coalesce("class_id", "first").alias("class_id"))
    sizes = rows_.groupBy("class_id").agg(F.count("*").alias("n_in_class"))
    known = rows_.join(sizes, "class_id").select("doc_id", "class_id", "n_in_class")
    # A null doc_id cannot be named by a class; such rows are kept with an unknown class.
    return known.unionByName(rows_.where("class_id is null").select("doc_id", "class_id", F.lit(1).cast("long").alias("n_in_class")))


def one_per_class(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each class: the one with the smallest doc_id. Rows without a doc_id stay if no other
    row has their text; of equal ones among them one stays, of null texts all."""
    kept = classes(docs).where("doc_id = class_id").select("doc_id").distinct()
    named = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*docs.columns)
    unnamed = docs.where("doc_id is null")
    if unnamed.isEmpty():
        return named
    digest = F.sha2("text", 256).alias("__text")
    others = docs.where("doc_id is not null").select(digest)
    told = unnamed.where("text is not null").select("*", digest).join(others, "__text", "left_anti").dropDuplicates(["__text"])
    return named.unionByName(told.select(*docs.columns)).unionByName(unnamed.where("text is null"))


def op2_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
