"""Byte-level BPE over overlapping chunks, and back.

A text is cut into chunks that overlap. Every chunk is pre-tokenised on its own. In the overlap of two neighbours both
have boundaries; the first one they share that follows a non-blank character is where they resynchronise, and from a
shared boundary on the pattern finds the same tokens, since it never looks back. Left of that point the left chunk's
tokens count, right of it the right one's. Where an overlap has no shared boundary (one run of letters longer than the
overlap), the two chunks are joined and pre-tokenised as one, so the result is that of the whole text for any text.
Each pre-token is merged by rank on its own. Decoding concatenates the bytes of the ids.

Defined cases: null and empty texts have no ids and decode to no bytes; repeated rows are encoded alike; extra columns
stay. Text that holds names of special tokens is ordinary text.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RANKS = "byte_bpe_multi_50k.tiktoken"
CHUNK, OVERLAP = 16_384, 512
_MEMO = 200_000
_NONE = np.int64(1 << 40)
_SHORT = 64


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file)}


def _cuts(pattern: regex.Pattern, text: str) -> list[int]:
    """Ends of the pre-tokens of one chunk."""
    return [m.end() for m in pattern.finditer(text)]


def pretokens(pattern: regex.Pattern, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[str]:
    """Pre-tokens of ``text``, found chunk by chunk and stitched where neighbours resynchronise."""
    if len(text) <= chunk + overlap:
        return pattern.findall(text)
    out: list[str] = []
    left_from, left_to = 0, chunk + overlap
    left, done = _cuts(pattern, text[:left_to]), 0
    while True:
        begin, to = left_to - overlap, min(len(text), left_to - overlap + chunk + overlap)
        right = [begin + e for e in _cuts(pattern, text[begin:to])]
        # A chunk's last boundary may be an artefact of its end; one after a blank may hide a longer run of blanks.
        shared = sorted({x for x in left[:-1] if x > begin} & set(right[:-1]))
        meet = next((x for x in shared if not text[x - 1].isspace()), None)
        if meet is None:
            left = [left_from + e for e in _cuts(pattern, text[left_from:to])]
        else:
            for end in left:
                if done < end <= meet:
                    out.append(text[done:end])
                    done = end
            left_from, left = meet, [e for e in right if e > meet]
        left_to = to
        if to == len(text):
            for end in left:
                if end > done:
                    out.append(text[done:end])
                    done = end
            return out


def merge(ranks: dict[bytes, int], token: bytes) -> list[int]:
    """Ids of one long pre-token: join the neighbours of lowest rank, leftmost first, with a heap of candidate pairs."""
    parts = [token[i:i + 1] for i in range(len(token))]
    after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
    heap = [(r, i, parts[i] + parts[i + 1]) for i in range(len(parts) - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, joined = heapq.heappop(heap)
        j = after[i]
        if parts[i] is None or j >= len(parts) or parts[i] + parts[j] != joined or len(joined) == len(parts[i]):
            continue  # one side has changed since
        parts[i], parts[j] = joined, None
        after[i] = after[j]
        if after[j] < len(parts):
            before[after[j]] = i
        for left in (before[i], i):
            if left >= 0 and after[left] < len(parts):
                pair = parts[left] + parts[after[left]]
                if (r := ranks.get(pair)) is not None:
                    heapq.heappush(heap, (r, left, pair))
    return [ranks[p] for p in parts if p is not None]


class Merger:
    """Merges many short pre-tokens at once: each round joins every pre-token's leftmost pair of lowest rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        pairs = {(ranks[t[:k]] << 32) | ranks[t[k:]]: r for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
        self.keys = np.array(sorted(pairs), np.int64)
        self.joined = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.single = np.array([ranks.get(bytes([i]), -1) for i in range(256)], np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.joined[at], _NONE)

    def merged(self, tokens: list[bytes]) -> list[list[int]]:
        out: list[list[int]] = [[]] * len(tokens)
        short = []
        for i, token in enumerate(tokens):
            whole = self.ranks.get(token)
            if whole is not None:
                out[i] = [whole]
            elif len(token) > _SHORT or not len(self.keys):
                out[i] = merge(self.ranks, token)
            else:
                short.append(i)
        if not short:
            return out
        ids = self.single[np.frombuffer(b"".join(tokens[i] for i in short), np.uint8)]
        owner = np.repeat(np.array(short), [len(tokens[i]) for i in short])
        rank = np.full(len(ids), _NONE)  # of the pair that begins here
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        rank[inner] = self._rank(ids[inner], ids[inner + 1])
        ready_ids, ready_at, ready_sizes = [], [], []
        while len(ids):
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            sizes = np.diff(np.append(first, len(ids)))
            lowest = np.minimum.reduceat(rank, first)
            over = lowest == _NONE
            keep = np.repeat(~over, sizes)
            ready_ids.append(ids[~keep])
            ready_at.append(owner[first[over]])
            ready_sizes.append(sizes[over])
            hits = np.flatnonzero((rank == np.repeat(lowest, sizes)) & keep)
            if len(hits):  # the leftmost of each pre-token
                hits = hits[np.concatenate([[True], owner[hits[1:]] != owner[hits[:-1]]])]
            ids[hits] = rank[hits]
            rank[hits] = rank[hits + 1]
            keep[hits + 1] = False
            here = np.cumsum(keep)[hits] - 1
            ids, owner, rank = ids[keep], owner[keep], rank[keep]
            for at in (here, here[here > 0] - 1):
                at = at[at + 1 < len(ids)]
                rank[at] = np.where(owner[at] == owner[at + 1], self._rank(ids[at], ids[at + 1]), _NONE)
        flat, to = np.concatenate(ready_ids).tolist(), np.cumsum(np.concatenate(ready_sizes)).tolist()
        begun = 0
        for at, end in zip(np.concatenate(ready_at).tolist(), to):
            out[at] = flat[begun:end]
            begun = end
        return out


def _ship(spark: SparkSession, path: str) -> str:
    """The rank file on every executor; its size is that of a public vocabulary, whatever the corpus."""
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def encode(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, out: str = "ids") -> DataFrame:
    """``docs`` with ``ids`` (array of int) for ``text``. Rows stay where they are."""
    name = _ship(docs.sparkSession, path)
    kept = [c for c in docs.columns if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger, compiled = Merger(read_ranks(SparkFiles.get(name))), regex.compile(pattern)
        memo: dict[str, list[int]] = {}  # of this and the last generation of pre-tokens
        older: dict[str, list[int]] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                ids, offsets = [], [0]
                texts = [pretokens(compiled, text.as_py() or "") for text in batch.column("text")]
                fresh = []
                for token in {token for tokens in texts for token in tokens} - memo.keys():
                    found = older.get(token)
                    if found is None:
                        fresh.append(token)
                    else:
                        memo[token] = found
                memo.update(zip(fresh, merger.merged([token.encode() for token in fresh])))
                for tokens in texts:
                    for found in map(memo.__getitem__, tokens):
                        ids += found
                    offsets.append(len(ids))
                if len(memo) > _MEMO:
                    memo, older = {}, memo
                array = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.array(ids, np.int32)))
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], array], [*kept, out])

    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    return docs.mapInArrow(run, ", ".join([*[f"`{c}` {types[c]}" for c in kept], f"`{out}` array<int>"]))


def decode(rows: DataFrame, path: str, ids: str = "ids", out: str = "bytes") -> DataFrame:
    """``rows`` with ``bytes``: the raw bytes of every id in a row, joined."""
    name = _ship(rows.sparkSession, path)
    kept = [c for c in rows.columns if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = read_ranks(SparkFiles.get(name))
        tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        known = pa.array(tokens, pa.binary())
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                column = batch.column(ids)
                offsets = np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
                parts = known.take(column.flatten())  # its data buffer is the joined bytes
                sizes = np.concatenate([[0], np.cumsum(pc.binary_length(parts).to_numpy(zero_copy_only=False))])
                ends = pa.py_buffer(sizes[offsets].astype(np.int32).tobytes())
                array = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, ends, parts.buffers()[2] or pa.py_buffer(b"")])
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], array], [*kept, out])

    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInArrow(run, ", ".join([*[f"`{c}` {types[c]}" for c in kept], f"`{out}` binary"]))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Per document: number of ids, digest of the ids, digest of what they decode to."""
    rows = decode(encode(docs.select("doc_id", "text"), path).drop("text"), path)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path(RANKS))
