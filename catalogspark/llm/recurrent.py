"""Language-model scoring by a gated recurrent network in numpy.

Tokens are words, lower-cased A-Z, and one end per document. The network reads units: the most frequent words one by one,
all others by the hash of their last two letters. Its output is factored, P(class) x P(unit | class), and a word below a
unit of rare words has its smoothed share of the unit's counts, so probabilities sum to one over all known words and one
unknown word per unit. A document's state is carried through all of it, from the first word to the end.

Counts cover every training token: a grouped aggregation with one row per word. The ``FREQUENT`` commonest words are sent
to the tasks; counts of all others meet the documents in a join, so nothing that grows with the vocabulary is broadcast
or collected. Training is data-parallel: in each round every task runs truncated backpropagation over its share of the
training documents and the parameters are averaged, as arrays in two steps; all training documents are visited once,
to their last token. The parameters have a fixed size. Words are told apart by 64-bit hashes.

Defined cases: null and empty texts are one end; a null doc_id is not held out; without training documents nothing is
known and the network is untrained; repeated rows are scored each; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogspark.llm.staging import written
from catalogspark.llm.text_arrays import as_bytes, blocks, hash_spans, lowered, mix, spans

FREQUENT = 100_000
UNITS, RARE_UNITS, CLASSES, HIDDEN = 1024, 256, 32, 24
ROUNDS, WINDOW, LANES, RATE = 2, 32, 512, 0.01
ROWS_AT_ONCE = 5_000
#: Numbers of groups in which the tasks' parameters are averaged, one after the other.
GROUPS = (64, 4)
END = np.uint64(0x5DEECE66D1234567)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, rare unit and text of every token; each text's last one is its end."""
    data, offsets = as_bytes(column)
    hashes, rare, owners = [], [], []
    for a, b in blocks(offsets):
        part = lowered(data[offsets[a]:offsets[b]])
        starts, ends, owner = spans(part, offsets[a:b + 1] - offsets[a])
        last = part[ends - 1].astype(np.uint64)
        before = np.where(ends - starts > 1, part[np.maximum(ends - 2, 0)], 0).astype(np.uint64)
        n = b - a
        # Every text before a word has one end before it.
        place = np.arange(len(starts)) + owner
        size = np.bincount(owner, minlength=n) + 1
        hashed, unit = np.full(len(starts) + n, END), np.zeros(len(starts) + n, np.int64)
        hashed[place] = hash_spans(part, starts, ends)
        unit[place] = (mix(before << np.uint64(8) | last) & np.uint64(RARE_UNITS - 1)).astype(np.int64)
        hashes.append(hashed)
        rare.append(unit)
        owners.append(np.repeat(np.arange(a, b), size))
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(rare), np.concatenate(owners)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, rare, n) over all tokens of ``docs``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                hashes, rare, _ = words_of(whole.slice(at, ROWS_AT_ONCE).column("text"))
                word, first, n = np.unique(hashes, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(rare[first].astype(np.int32)), pa.array(n)], ["word", "rare", "n"])

    return docs.select("text").mapInArrow(run, "word long, rare int, n long").groupBy("word", "rare").agg(F.sum("n").alias("n"))


class Vocabulary:
    """Counts of the commonest words, totals of the rare units, and the unit of every word."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, tokens: int, kinds: int, rare_tokens: np.ndarray, rare_kinds: np.ndarray):
        own = UNITS - RARE_UNITS
        by_count = np.argsort(-counts, kind="stable")
        by_count = np.concatenate([by_count[words[by_count] == END], by_count[words[by_count] != END]])
        unit = np.full(len(words), -1, np.int32)
        unit[by_count[:own]] = np.arange(min(own, len(words)))
        order = np.argsort(words)
        self.words, self.counts, self.unit = words[order], counts[order], unit[order]
        self.tokens, self.kinds = tokens, kinds
        self.unit_tokens = np.concatenate([np.zeros(own), rare_tokens]).astype(float)
        self.unit_tokens[unit[unit >= 0]] = counts[unit >= 0]
        #: What the counts in a rare unit, each and the unknown word's raised by one, add up to.
        self.rare_total = rare_tokens + rare_kinds + 1.0

    def look(self, hashes: np.ndarray, rare: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unit and count of every token; the count is -1 where the joined table has to tell."""
        if not len(self.words):
            return np.where(hashes == END, 0, UNITS - RARE_UNITS + rare).astype(np.int32), np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        known = self.words[at] == hashes
        unit = np.where(known, self.unit[at], -1)
        unit = np.where(hashes == END, 0, np.where(unit < 0, UNITS - RARE_UNITS + rare, unit))
        return unit.astype(np.int32), np.where(known, self.counts[at], -1)


def vocabulary(counts: DataFrame, most: int = FREQUENT) -> Vocabulary:
    top = counts.orderBy(F.desc("n"), "word").limit(most).toPandas()  # ``most`` rows at most
    words, n, rare = top["word"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64), top["rare"].to_numpy(np.int64)
    sums = counts.groupBy("rare").agg(F.sum("n").alias("n"), F.count("*").alias("k")).toPandas()  # one row per rare unit
    tokens, kinds = np.zeros(RARE_UNITS), np.zeros(RARE_UNITS)
    tokens[sums["rare"].to_numpy(int)], kinds[sums["rare"].to_numpy(int)] = sums["n"], sums["k"]
    made = Vocabulary(words, n, int(tokens.sum()), int(kinds.sum()), np.zeros(RARE_UNITS), np.zeros(RARE_UNITS))
    own = made.unit[np.searchsorted(made.words, words)] >= 0 if len(words) else np.zeros(0, bool)
    tokens -= np.bincount(rare[own], n[own], RARE_UNITS)
    kinds -= np.bincount(rare[own], minlength=RARE_UNITS)
    return Vocabulary(words, n, made.tokens, made.kinds, tokens, kinds)


SHAPES = {"inp": (UNITS, 3 * HIDDEN), "gate": (HIDDEN, 2 * HIDDEN), "cand": (HIDDEN, HIDDEN), "cls": (HIDDEN, CLASSES), "cls_b": (CLASSES,),
          "mem": (CLASSES, HIDDEN, UNITS // CLASSES), "mem_b": (CLASSES, UNITS // CLASSES)}


def unpack(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in SHAPES.items():
        size = int(np.prod(shape))
        out[name] = np.array(flat[at:at + size], np.float32).reshape(shape)
        at += size
    return out


def pack(params: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([params[name].ravel() for name in SHAPES]).astype(np.float32)


def untrained(unit_tokens: np.ndarray) -> np.ndarray:
    """Small random weights; the output's offsets are the units' counts, so the network starts as a unigram model."""
    rng = np.random.default_rng(7)
    params = {name: rng.normal(0, 0.1, shape) for name, shape in SHAPES.items()}
    shares = (unit_tokens + 1.0).reshape(CLASSES, -1)
    params["cls_b"] = np.log(shares.sum(1) / shares.sum())
    params["mem_b"] = np.log(shares / shares.sum(1, keepdims=True))
    params["cls"], params["mem"] = params["cls"] * 0, params["mem"] * 0
    return pack(params)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def forward(p: dict[str, np.ndarray], ids: np.ndarray, h: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """State after one unit per lane."""
    inp = p["inp"][ids]
    gates = _sigmoid(inp[:, :2 * HIDDEN] + h @ p["gate"])
    z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
    rh = r * h
    n = np.tanh(inp[:, 2 * HIDDEN:] + rh @ p["cand"])
    if keep is not None:
        keep.update(h=h, z=z, r=r, rh=rh, n=n)
    return h + z * (n - h)


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x = np.minimum(x, 60)  # far above any sensible score; exp stays finite
    return x - np.log(np.exp(x) @ np.ones((x.shape[1], 1), x.dtype))


def output(p: dict[str, np.ndarray], h: np.ndarray, ids: np.ndarray, grads: dict | None = None, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """log P(unit) from the states before it, and with ``grads`` the slope of the mean loss (by ``weight``) at the states."""
    if weight is None:
        weight = np.full(len(ids), 1 / max(len(ids), 1), np.float32)
    size = UNITS // CLASSES
    cls, member = ids // size, ids % size
    lc = _log_softmax(h @ p["cls"] + p["cls_b"])
    here = np.arange(len(ids))
    out = lc[here, cls]
    slope = None
    if grads is not None:
        d = np.exp(lc)
        d[here, cls] -= 1
        d *= weight[:, None]
        grads["cls"] += h.T @ d
        grads["cls_b"] += d.sum(0)
        slope = d @ p["cls"].T
    order = np.argsort(cls, kind="stable")
    borders = np.searchsorted(cls[order], np.arange(CLASSES + 1))
    for c in range(CLASSES):
        rows = order[borders[c]:borders[c + 1]]
        if not len(rows):
            continue
        lm = _log_softmax(h[rows] @ p["mem"][c] + p["mem_b"][c])
        own = np.arange(len(rows))
        out[rows] += lm[own, member[rows]]
        if grads is not None:
            d = np.exp(lm)
            d[own, member[rows]] -= 1
            d *= weight[rows, None]
            grads["mem"][c] += h[rows].T @ d
            grads["mem_b"][c] += d.sum(0)
            slope[rows] += d @ p["mem"][c].T
    return out, slope


class Trainer:
    """Truncated backpropagation over lanes of documents, with Adam."""

    def __init__(self, flat: np.ndarray):
        self.p = unpack(flat)
        self.m = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.v = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.steps = 0

    def window(self, ids: np.ndarray, h: np.ndarray, real: np.ndarray | None = None) -> np.ndarray:
        """One update from ``ids`` (steps x lanes), of which only ``real`` ones count; returns the state that the next
        window goes on from."""
        p, g = self.p, {k: np.zeros_like(v) for k, v in self.p.items()}
        states, kept = [], []
        for row in ids:
            states.append(h)
            kept.append({})
            h = forward(p, row, h, kept[-1])
            h[row == 0] = 0  # after an end the next document begins
        lanes = ids.shape[1]
        before = np.concatenate(states)
        weight = None if real is None else (real.ravel() / max(int(real.sum()), 1)).astype(np.float32)
        _, slopes = output(p, before, ids.ravel(), g, weight)
        dh = np.zeros_like(h)
        into = np.empty((*ids.shape, 3 * HIDDEN), np.float32)
        for t in range(len(ids) - 1, -1, -1):
            k = kept[t]
            dh[ids[t] == 0] = 0
            dz = dh * (k["n"] - k["h"]) * k["z"] * (1 - k["z"])
            dn = dh * k["z"] * (1 - k["n"] ** 2)
            drh = dn @ p["cand"].T
            dr = drh * k["h"] * k["r"] * (1 - k["r"])
            gates = np.concatenate([dz, dr], 1)
            into[t, :, :2 * HIDDEN], into[t, :, 2 * HIDDEN:] = gates, dn
            dh = dh * (1 - k["z"]) + drh * k["r"] + gates @ p["gate"].T + slopes[t * lanes:(t + 1) * lanes]
        flat, rows = ids.ravel(), into.reshape(-1, 3 * HIDDEN)
        g["gate"] = before.T @ rows[:, :2 * HIDDEN]
        g["cand"] = np.concatenate([k["rh"] for k in kept]).T @ rows[:, 2 * HIDDEN:]
        columns = np.ascontiguousarray(rows.T)
        g["inp"] = np.stack([np.bincount(flat, c, UNITS) for c in columns], 1).astype(np.float32)
        self.steps += 1
        norm = float(np.sqrt(sum((x ** 2).sum() for x in g.values())))
        clip = min(1.0, 1.0 / (norm + 1e-9))
        rate = RATE * min(1.0, self.steps / 20)
        for name in SHAPES:
            grad = g[name] * clip
            self.m[name] = 0.9 * self.m[name] + 0.1 * grad
            self.v[name] = 0.99 * self.v[name] + 0.01 * grad ** 2
            m, v = self.m[name] / (1 - 0.9 ** self.steps), self.v[name] / (1 - 0.99 ** self.steps)
            p[name] -= (rate * m / (np.sqrt(v) + 1e-6)).astype(np.float32)
        return h

    def read(self, units: np.ndarray) -> None:
        """One pass over the units of whole documents, dealt to lanes that run side by side."""
        lanes = int(min(LANES, max(8, len(units) // (WINDOW * 75))))
        steps = -(-len(units) // lanes)
        # The last lane is filled up with ends that do not count.
        filled = np.zeros(steps * lanes, units.dtype)
        filled[:len(units)] = units
        grid, real = filled.reshape(lanes, steps).T, (np.arange(steps * lanes) < len(units)).reshape(lanes, steps).T
        h = np.zeros((lanes, HIDDEN), np.float32)
        for at in range(0, steps, WINDOW):
            now = real[at:at + WINDOW]
            h = self.window(np.ascontiguousarray(grid[at:at + WINDOW]), h, None if now.all() else now)


def averaged(results: DataFrame, groups: int = GROUPS) -> tuple[float, np.ndarray] | None:
    """Sum of the weights and weighted mean of the arrays of ``results`` (weight, params). Arrays are added within fixed groups
    of tasks, then once more, so that what is shuffled is one array per task and the driver gets ``groups[-1]``."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, total = 0.0, None
        for batch in batches:
            for w, values in zip(batch.column("weight").to_pylist(), batch.column("params")):
                part = values.values.to_numpy(zero_copy_only=False).astype(np.float64) * w
                weight, total = weight + w, part if total is None else total + part
        if total is not None:
            mean = pa.array((total / weight).astype(np.float32))
            yield pa.RecordBatch.from_arrays([pa.array([weight]), pa.ListArray.from_arrays(pa.array([0, len(mean)], pa.int32()), mean)], ["weight", "params"])

    for n in groups:
        results = results.repartition(n).mapInArrow(add, "weight double, params array<float>")
    rows = results.collect()  # at most as many arrays as the last number of groups
    if not rows:
        return None
    weight = sum(r["weight"] for r in rows)
    return weight, sum(np.array(r["params"], np.float64) * r["weight"] for r in rows) / weight


def trained(docs: DataFrame, words: Vocabulary, rounds: int = ROUNDS) -> np.ndarray:
    """Parameters after ``rounds`` rounds; the documents of a round are a share of all, by a hash, and each is in one."""
    flat, context = untrained(words.unit_tokens), docs.sparkSession.sparkContext
    shared = context.broadcast(words)
    for r in range(rounds):
        now = context.broadcast(flat)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trainer, tokens = None, 0
            for whole in batches:
                for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                    trainer = trainer or Trainer(now.value)
                    hashes, rare, _ = words_of(whole.slice(at, ROWS_AT_ONCE).column("text"))
                    trainer.read(shared.value.look(hashes, rare)[0])
                    tokens += len(hashes)
            if trainer:
                values = pa.array(pack(trainer.p))
                yield pa.RecordBatch.from_arrays([pa.array([float(tokens)]), pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)], ["weight", "params"])

        part = docs.where(F.pmod(F.xxhash64("text"), F.lit(rounds)) == r).select("text")
        mean = averaged(part.mapInArrow(run, "weight double, params array<float>"))
        flat = flat if mean is None else mean[1].astype(np.float32)
    return flat


def log_units(p: dict[str, np.ndarray], units: np.ndarray, begun: np.ndarray, lanes: int = 1024) -> np.ndarray:
    """log P of every unit of texts that begin at ``begun`` (and end where the next begins). Texts are dealt whole to
    lanes, the longest first, and a lane's state starts anew with each text."""
    sizes = np.diff(np.append(begun, len(units)))
    lanes = int(min(lanes, max(1, len(begun))))
    load, lists = [(0, i) for i in range(lanes)], [[] for _ in range(lanes)]
    for text in np.argsort(-sizes, kind="stable"):
        n, lane = heapq.heappop(load)
        lists[lane].append(text)
        heapq.heappush(load, (n + int(sizes[text]), lane))
    lengths = np.array([n for n, _ in sorted(load, key=lambda x: x[1])])
    by_length = np.argsort(-lengths, kind="stable")
    lengths = lengths[by_length]
    place = np.full((int(lengths[0]), lanes), -1, np.int32)
    for column, lane in enumerate(by_length):
        texts = np.array(lists[lane], int)
        if len(texts):
            n = sizes[texts]
            inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            place[:lengths[column], column] = np.repeat(begun[texts], n) + inside
    out = np.zeros(len(units), np.float32)
    h = np.zeros((lanes, HIDDEN), np.float32)
    states, where, held = [], [], 0
    for t in range(len(place)):
        active = int(np.searchsorted(-lengths, -t, "left"))  # lanes longer than t
        h = h[:active]
        at = place[t, :active]
        ids = units[at]
        states.append(h)
        where.append(at)
        h = forward(p, ids, h)
        h[ids == 0] = 0
        held += active
        if held > 30_000 or t == len(place) - 1:
            at = np.concatenate(where)
            out[at] = output(p, np.concatenate(states), units[at])[0]
            states, where, held = [], [], 0
    return out


def scored(docs: DataFrame, train: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every row of ``docs``, learned from ``train``."""
    counts = written(word_counts(train), "counts")
    words = vocabulary(counts)
    context = docs.sparkSession.sparkContext
    shared, flat = context.broadcast(words), context.broadcast(trained(train, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, p = shared.value, unpack(flat.value)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                part = whole.slice(at, ROWS_AT_ONCE)
                k = part.num_rows
                hashes, rare, owner = words_of(part.column("text"))
                unit, count = vocab.look(hashes, rare)
                begun = np.searchsorted(owner, np.arange(k))
                logs = log_units(p, unit, begun).astype(float)
                told, below = count >= 0, unit >= UNITS - RARE_UNITS
                plus = np.where(told, np.log10(np.maximum(count, 0) + 1.0), 0.0)
                score = logs / np.log(10) + np.where(below, plus - np.log10(vocab.rare_total[np.where(below, unit - (UNITS - RARE_UNITS), 0)]), 0.0)
                open_ = np.flatnonzero(~told)
                order = open_[np.lexsort((hashes[open_], owner[open_]))]
                w, o = hashes[order], owner[order]
                first = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (o[1:] != o[:-1])])) if len(w) else np.zeros(0, int)
                times = np.diff(np.append(first, len(w)))
                lists = np.searchsorted(o[first], np.arange(k + 1)).astype(np.int32)
                sums = [np.bincount(owner, x, k) for x in (np.ones(len(owner)), told, plus, score)]
                yield pa.RecordBatch.from_arrays([
                    part.column("row"), part.column("doc_id"), pa.array(sums[0].astype(np.int64)), pa.array(sums[1].astype(np.int64)), pa.array(sums[2]), pa.array(sums[3]),
                    pa.ListArray.from_arrays(lists, pa.array(w[first].view(np.int64))), pa.ListArray.from_arrays(lists, pa.array(times.astype(np.int32)))],
                    ["row", "doc_id", "n_tokens", "n_known", "plus", "score", "words", "times"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = written(rows.mapInArrow(run, "row long, doc_id long, n_tokens long, n_known long, plus double, score double, words array<long>, times array<int>"), "scored")
    # Words beyond the commonest: their counts are joined, one row per document and word.
    rare = rows.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    met = rare.join(counts.select("word", "n"), "word").groupBy("row").agg(
        F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("gain"))
    out = rows.drop("words", "times").join(met, "row", "left")
    more, gain = F.coalesce("more", F.lit(0).cast("long")), F.coalesce("gain", F.lit(0.0))
    total = float(np.log10((words.tokens or 0) + words.kinds + 1.0))
    return out.select("doc_id", "n_tokens", (F.col("n_known") + more).alias("n_known"), F.lit(words.tokens).cast("long").alias("train_tokens"),
                      (F.col("plus") + gain - F.col("n_tokens") * total).alias("base_score"), (F.col("score") + gain).alias("score"))


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = scored(docs, docs.where(~held_out(F.col("doc_id"))))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
