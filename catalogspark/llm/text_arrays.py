"""Tokens of many texts at once as numpy arrays: no Python object per word, memory in proportion to one block of text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 2 << 20
#: Separators of words: blank, tab, line feed, vertical tab, form feed, carriage return.
WHITE = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
NEWLINE = (0x0A,)
_ROWS = 64


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (the published SplitMix64 constants)."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x += np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def _table(seed: int) -> np.ndarray:
    cells = np.arange(_ROWS * 256, dtype=np.uint64) + np.uint64(seed << 20)
    return mix(mix(cells))


_TABLES: dict[int, np.ndarray] = {}


def as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row, and where each begins (one more entry than texts). Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first, last = (int(offsets[0]), int(offsets[-1])) if len(column) else (0, 0)
    return flat[first:last], (offsets - first) if len(column) else np.zeros(1, np.int64)


def blocks(offsets: np.ndarray, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about ``size`` bytes; a longer text is a block of its own."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


def spans(data: np.ndarray, offsets: np.ndarray, separators: tuple[int, ...] = WHITE) -> tuple[np.ndarray, ...]:
    """Start, end and text of every non-empty run of bytes between separators; no run crosses a text's border."""
    n = len(data)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    is_separator = np.zeros(256, bool)
    is_separator[list(separators)] = True
    inside = ~is_separator[data]
    border = np.zeros(n + 1, bool)
    border[offsets] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    starts = np.flatnonzero(inside & (~before | border[:-1]))
    ends = np.flatnonzero(inside & (~after | border[1:])) + 1
    owner = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, owner


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z; all other bytes as they are."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table[data]


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit tabulation hash of every span (spans are not empty)."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    if seed not in _TABLES:
        _TABLES[seed] = _table(seed)
    lengths = ends - starts
    begun = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(begun, lengths)
    values = _TABLES[seed][((place & (_ROWS - 1)) << 8) | data[np.repeat(starts, lengths) + place]]
    with np.errstate(over="ignore"):
        if int(lengths.max()) > _ROWS:
            values = values * ((place >> 6) * 2 + 1).astype(np.uint64)
        sums = np.add.reduceat(values, begun)
        return mix(sums + lengths.astype(np.uint64))


def shingles(words: np.ndarray, owner: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of each run of ``width`` words; a text with fewer words is one shorter run. ``owner`` ascends."""
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    texts, first, counts = np.unique(owner, return_index=True, return_counts=True)
    made = np.maximum(counts - width + 1, 1)
    begun = np.cumsum(made) - made
    at = np.arange(int(made.sum())) - np.repeat(begun, made) + np.repeat(first, made)
    last = np.repeat(first + counts, made)
    out = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(width):
            there = at + j < last
            out[there] = mix(out[there] * np.uint64(3) + words[at[there] + j])
    return out, np.repeat(texts, made)
