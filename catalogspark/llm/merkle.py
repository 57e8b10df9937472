"""Merkle-tree fingerprints: sections of paragraphs of sentences.

Leaves are sentences (with the blanks after them), paragraphs are lines, and a section ends at an empty line or after a
paragraph whose own hash says so, so an edit shifts no later border. Every inner node hashes its children; equal roots
mean equal texts, and where roots differ only the branches that differ are followed. The likeness of two trees is the
share of their characters that lies in equal branches: 2 x common / (both lengths).

Defined cases: a null text is an empty one, whose tree has no sentence; two empty texts are alike (1); equal doc_ids
follow each other by text, and null doc_ids come last; a single document is its own next one; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catalogspark.llm.staging import written

_SENTENCE = re.compile(r"[^.!?]*[.!?]+\s*|[^.!?]+")
_LONGEST = 96

Tree = tuple[str, list[tuple[bytes, list[tuple[bytes, list[tuple[bytes, int]]]]]]]


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def sentences(paragraph: str) -> list[str]:
    """Pieces of a paragraph; joined they are the paragraph. A piece beyond 96 characters is cut."""
    return [s[i:i + _LONGEST] for s in _SENTENCE.findall(paragraph) for i in range(0, len(s), _LONGEST)]


def tree(text: str) -> Tree:
    """Root and sections: (hash, paragraphs: (hash, sentences: (hash, characters)))."""
    sections, paragraphs = [], []
    lines = text.split("\n")
    for n, line in enumerate(lines):
        end = "\n" if n < len(lines) - 1 else ""
        leaves = [(_digest(s.encode("utf-8", "surrogatepass")), len(s)) for s in sentences(line)]
        if end:
            leaves.append((b"\n", 1))
        node = _digest(b"p" + b"".join(h for h, _ in leaves))
        paragraphs.append((node, leaves))
        if not line or node[0] < 32 or not end:
            sections.append((_digest(b"s" + b"".join(h for h, _ in paragraphs)), paragraphs))
            paragraphs = []
    return hashlib.sha256(b"r" + b"".join(h for h, _ in sections)).hexdigest(), sections


def _unlike(a: list, b: list) -> tuple[list, list]:
    """Nodes of either side without an equal one on the other, each counted once."""
    common = Counter(n[0] for n in a) & Counter(n[0] for n in b)
    def rest(nodes: list) -> list:
        left, out = Counter(common), []
        for n in nodes:
            if left[n[0]] > 0:
                left[n[0]] -= 1
            else:
                out.append(n)
        return out
    return rest(a), rest(b)


def likeness(a: Tree, b: Tree, n_a: int, n_b: int) -> float:
    """Share of characters in equal branches. Equal branches are not descended into."""
    if a[0] == b[0]:
        return 1.0
    left, right = _unlike(a[1], b[1])
    left, right = _unlike([p for _, ps in left for p in ps], [p for _, ps in right for p in ps])
    left, right = _unlike([s for _, ss in left for s in ss], [s for _, ss in right for s in ss])
    differing = sum(n for _, n in left) + sum(n for _, n in right)
    return max(0.0, 1 - differing / max(n_a + n_b, 1))


def nodes(docs: DataFrame) -> DataFrame:
    """The trees as rows: doc_id, level (0 root, 1 section, 2 paragraph, 3 sentence), place, hash, from_char, n_chars."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, value in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                text = value.as_py() or ""
                root, sections = tree(text)
                rows, at = [(doc, 0, 0, root, 0, len(text))], 0
                place = [0, 0, 0]
                for section, paragraphs in sections:
                    begun = at
                    for paragraph, leaves in paragraphs:
                        first = at
                        for leaf, n in leaves:
                            rows.append((doc, 3, place[2], leaf.hex(), at, n))
                            place[2], at = place[2] + 1, at + n
                        rows.append((doc, 2, place[1], paragraph.hex(), first, at - first))
                        place[1] += 1
                    rows.append((doc, 1, place[0], section.hex(), begun, at - begun))
                    place[0] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()))],
                                                 ["doc_id", "level", "place", "hash", "from_char", "n_chars"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, level int, place int, hash string, from_char long, n_chars long")


def edits(old: DataFrame, new: DataFrame) -> DataFrame:
    """Sentences of ``new`` trees that the tree of the same doc_id in ``old`` lacks: where the edits are."""
    changed = new.where("level = 0").join(old.where("level = 0").select("doc_id", "hash"), ["doc_id", "hash"], "left_anti").select("doc_id")
    leaves = new.where("level = 3").join(changed, "doc_id", "left_semi")
    return leaves.join(old.where("level = 3").select("doc_id", "hash"), ["doc_id", "hash"], "left_anti")


_OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
                  ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compared(doc: int | None, text: str, own: Tree, following: str, its: Tree) -> tuple:
    n = len(text)
    third = n // 3
    edited = text[:n - third] + following[:third]
    changed = tree(edited)
    return (doc, n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), own[0], changed[0],
            likeness(own, changed, n, len(edited)), likeness(own, its, n, len(following)))


def compared_with_next(docs: DataFrame) -> DataFrame:
    """Every document against its edited text and the next document.

    Texts move once, to range partitions of doc_id; inside one, each row meets the next. The last row of a partition
    waits for the first of the next one: those border rows, one for each partition, are joined afterwards.
    """
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = ordered.repartitionByRange(F.col("doc_id").desc()).sortWithinPartitions(F.col("doc_id").desc(), "text")
    extended = pa.schema([*_OUT, ("part", pa.int32()), ("kind", pa.int32()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId(), None
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                rows = []
                piece = batch.slice(at, 500)
                for doc, value in zip(piece.column("doc_id").to_pylist(), piece.column("text")):
                    text = value.as_py()
                    own = tree(text)
                    if held is None:
                        rows.append((doc, *[None] * 6, part, 0, text))
                    else:
                        rows.append((*_compared(*held, text, own), part, 1, None))
                    held = doc, text, own
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), extended)], schema=extended)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip((held[0], *[None] * 6, part, 2, held[1]), extended)], schema=extended)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, a, b in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("next_text")):
                text, following = a.as_py(), b.as_py()
                row = _compared(doc, text, tree(text), following, tree(following))
                yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(row, _OUT)], schema=_OUT)

    rows = written(ordered.mapInArrow(run, f"{_RESULT}, part int, kind int, text string"), "compared")
    firsts, lasts = rows.where("kind = 0"), rows.where("kind = 2")
    # Numbers of the partitions that have rows, in order: one number each, no text.
    parts = firsts.select("part")
    order = Window.orderBy("part")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = parts.select("part", F.coalesce(F.lead("part").over(order), F.first("part").over(whole)).alias("next"))
    waiting = lasts.select("doc_id", "part", "text").join(after, "part").join(firsts.select(F.col("part").alias("next"), F.col("text").alias("next_text")), "next")
    return rows.where("kind = 1").select(*_OUT.names).unionByName(waiting.select("doc_id", "text", "next_text").mapInArrow(finish, _RESULT))


def op9_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared_with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
