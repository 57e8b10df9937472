"""Toxicity: a learned lexicon, found through Levenshtein automata on its trie, and context windows around every hit.

The lexicon comes from labelled documents: whole terms and word stems that occur in toxic documents far more often than
in clean ones. A token is walked through the product of the trie and a Levenshtein automaton, made deterministic as far
as tokens need it; tokens that no term is near leave it after a few characters. A hit has a class: exact term, stem, or
near (one edit, with or without digits and signs among its letters), and a window that tells whether it stands in a
quotation. The odds of every term and class are learned, so surfaces that clean texts use stay harmless. A document's
score is the chance that at least one of its hits is meant.

The lexicon is learned from a bounded sample of labelled rows (``MAX_LABELLED`` toxic and three times as many clean ones, by a hash of the id), and
holds ``MAX_TERMS`` terms at most; only that model is sent to the tasks. Every document is read whole and scored.

Defined cases: null and empty texts score the rate of toxic documents among those without a hit; without labels every
score is 0; a null doc_id is not held out; repeated rows score alike; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogspark.llm.staging import written
from catalogspark.llm.text_arrays import as_bytes, blocks, hash_spans, mix, shingles, spans

#: Labelled rows that the lexicon is learned from, at most: so many toxic ones and three times as many clean ones.
MAX_LABELLED = 10_000
MAX_TERMS = 5_000
MIN_DOCUMENTS = 4
STEMS = (4, 5, 6)
WINDOW = 60
_MEMO = 200_000
#: A token runs from a letter or digit to the last one before a separator, so signs inside a word belong to it.
_TOKEN = re.compile(r"[^\W_](?:[^\s.,;:\"“”«»()\[\]]*[^\W_])?")
_QUOTES = re.compile(r"“[^”]*”|«[^»]*»|\"[^\"\n]*\"|(?m:^\s*>.*$)")


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def allowed_edits(term: str) -> int:
    """Edits within which another spelling counts as the term."""
    return 1 if len(term) >= 5 else 0


class Automaton:
    """The trie of a lexicon times a Levenshtein automaton. A state is a set of (trie node, edits so far)."""

    def __init__(self, terms: list[str], edits: int = 1):
        self.edits = edits
        self.children: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        for term in sorted(terms):
            node = 0
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.term.append(None)
                node = self.children[node][c]
            self.term[node] = term
        self.states: list[dict[int, int]] = [self._closed({0: 0})]
        self.steps: list[dict[str, int]] = [{}]
        self.known = {frozenset(self.states[0].items()): 0}

    def _closed(self, state: dict[int, int]) -> dict[int, int]:
        """With the nodes that letters left out of the token lead to."""
        waiting = list(state)
        while waiting:
            node = waiting.pop()
            e = state[node] + 1
            if e <= self.edits:
                for child in self.children[node].values():
                    if state.get(child, e + 1) > e:
                        state[child] = e
                        waiting.append(child)
        return state

    def _step(self, at: int, c: str) -> int:
        out: dict[int, int] = {}
        for node, e in self.states[at].items():
            moves = [(child, e + (letter != c)) for letter, child in self.children[node].items()]
            for to, cost in [*moves, (node, e + 1)]:
                if cost <= self.edits and out.get(to, cost + 1) > cost:
                    out[to] = cost
        key = frozenset(self._closed(out).items())
        if key not in self.known:
            self.known[key] = len(self.states)
            self.states.append(out)
            self.steps.append({})
        self.steps[at][c] = self.known[key]
        return self.known[key]

    def nearest(self, token: str) -> tuple[int, str] | None:
        """Edits and term of the nearest term within reach."""
        at = 0
        for c in token:
            to = self.steps[at].get(c)
            at = self._step(at, c) if to is None else to
            if not self.states[at]:
                return None
        found = [(e, self.term[n]) for n, e in self.states[at].items() if self.term[n] is not None and e <= allowed_edits(self.term[n])]
        return min(found, default=None)


@dataclass
class Model:
    """Chance that a document with the hit is toxic, by term, stem and class of near hits."""

    terms: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    near: dict[str, float] = field(default_factory=dict)
    harmless: frozenset[str] = frozenset()
    quoted: float = 1.0
    without: float = 0.0


class Matcher:
    def __init__(self, model: Model):
        self.model = model
        self.automaton = Automaton(list(model.terms))
        self.memo: dict[str, tuple[str, str] | None] = {}

    def _look(self, token: str) -> tuple[str, str] | None:
        model = self.model
        if token in model.terms:
            return "exact", token
        for n in STEMS:
            if len(token) >= n and token[:n] in model.stems:
                return "stem", token[:n]
        if token in model.harmless:
            return None
        found = self.automaton.nearest(token)
        return found and ("near" if token.isalpha() else "disguised", found[1])

    def hit(self, token: str) -> tuple[str, str] | None:
        """Class and term of a token, or None."""
        if token not in self.memo:
            if len(self.memo) > _MEMO:
                self.memo.clear()
            self.memo[token] = self._look(token)
        return self.memo[token]

    def hits(self, text: str) -> list[tuple[str, str, str, bool]]:
        """(token, class, term, quoted) of the hits of one text, each surface once; quoted if it is so everywhere."""
        lower = text.lower()
        found = {t: h for t in set(_TOKEN.findall(lower)) if (h := self.hit(t))}
        if not found:
            return []
        inside = [m.span() for m in _QUOTES.finditer(lower)]
        meant = {m.group() for m in _TOKEN.finditer(lower) if m.group() in found and not _quotation(lower, m.start(), m.end(), inside)}
        return [(t, kind, term, t not in meant) for t, (kind, term) in sorted(found.items())]

    def chance(self, kind: str, term: str) -> float:
        model = self.model
        return model.terms[term] if kind == "exact" else model.stems[term] if kind == "stem" else model.near.get(kind, 0.0)

    def score(self, hits: list[tuple[str, str, str, bool]]) -> float:
        clean = 1 - self.model.without
        for _, kind, term, quoted in hits:
            clean *= 1 - self.chance(kind, term) * (self.model.quoted if quoted else 1.0)
        return min(1.0, max(0.0, 1 - clean))


def _quotation(text: str, start: int, end: int, inside: list[tuple[int, int]]) -> bool:
    """Whether a hit's window shows a quotation: it lies between quotation marks, or in a quoted line."""
    return any(a <= start and end <= b and (b - a) <= 40 * WINDOW for a, b in inside)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """(toxic, text) of at most ``most`` toxic and 3 x ``most`` clean labelled documents that are not held out, by a hash of the id."""
    rows = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    rows = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = [rows.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most * (1 if y else 3)) for y in (0, 1)]
    chosen = written(picked[0].unionByName(picked[1]), "labelled")  # at most 4 x ``most`` rows
    return _unlike(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("toxic", "text").where("text is not null"))


def _unlike(examples: DataFrame) -> DataFrame:
    """One of each group of copies, near ones included, or all their words would look like terms. Texts that share the
    smallest of their shingle hashes, under one seed or another, count once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = as_bytes(batch.column("text"))
            for a, b in blocks(offsets):
                part = data[offsets[a]:offsets[b]]
                starts, ends, owner = spans(part, offsets[a:b + 1] - offsets[a])
                grams, texts = shingles(hash_spans(part, starts, ends), owner)
                least = np.arange(2 * (b - a), dtype=np.uint64).reshape(2, -1)  # a text without words is like no other
                there, first = np.unique(texts, return_index=True)
                for seed in range(2 if len(first) else 0):
                    least[seed, there] = np.minimum.reduceat(mix(grams + np.uint64(seed)), first)
                yield pa.RecordBatch.from_arrays([batch.column("toxic").slice(a, b - a), batch.column("text").slice(a, b - a),
                                                  *[pa.array(x.view(np.int64)) for x in least]], ["toxic", "text", "m0", "m1"])

    rows = examples.select(F.col("toxic").cast("long").alias("toxic"), "text").mapInArrow(run, "toxic long, text string, m0 long, m1 long")
    for key in ("m0", "m1"):
        one = F.min_by(F.struct("toxic", "text", "m0", "m1"), F.xxhash64("text"))
        rows = rows.groupBy(F.col(key).alias("__key")).agg(one.alias("r")).select("r.*")
    return written(rows.select("toxic", "text"), "examples")


def _per_document(examples: DataFrame, features, share: float) -> dict[str, tuple[int, int]]:
    """Toxic and clean documents of every feature that toxic ones (``share`` of all examples) have too often for chance."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part, counts = batch.slice(at, 2000), Counter()
                for toxic, text in zip(part.column("toxic").to_pylist(), part.column("text")):
                    counts.update((f, toxic) for f in features(text.as_py()))
                yield pa.RecordBatch.from_arrays([
                    pa.array([f for f, _ in counts], pa.string()), pa.array([y * n for (_, y), n in counts.items()], pa.int64()),
                    pa.array([(1 - y) * n for (_, y), n in counts.items()], pa.int64())], ["feature", "bad", "good"])

    counted = written(examples.mapInArrow(run, "feature string, bad long, good long").groupBy("feature").agg(
        F.sum("bad").alias("bad"), F.sum("good").alias("good")).where("bad > 0"), "features")
    kinds = {r["kind"]: r["n"] for r in counted.groupBy(F.substring("feature", 1, 1).alias("kind")).agg(F.count("*").alias("n")).collect()}
    best = counted.where(F.col("bad") >= MIN_DOCUMENTS).orderBy((F.col("bad") / (F.col("good") + 1)).desc(), "feature").limit(4 * MAX_TERMS)
    return {r["feature"]: (r["bad"], r["good"]) for r in best.collect() if surprise(r["bad"], r["good"], share) > math.log(kinds[r["feature"][0]]) + 1}


def surprise(bad: int, good: int, share: float) -> float:
    """Minus the log of a bound on the chance that a word of no meaning is found in so many toxic documents (Chernoff).
    Among n words, those above log n + 1 are hardly there by chance, however small the sample."""
    n = bad + good
    p = bad / n
    if p <= share:
        return 0.0
    return n * (p * math.log(p / share) + ((1 - p) * math.log((1 - p) / (1 - share)) if p < 1 else 0.0))


def _features(text: str) -> set[str]:
    words = set(tokens(text))
    return {f"w{w}" for w in words} | {f"s{w[:n]}" for w in words for n in STEMS if len(w) >= n}


def learn(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> Model:
    examples = labelled_sample(docs, labels, most)
    totals = {r["toxic"]: r["n"] for r in examples.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = totals.get(1, 0), totals.get(0, 0)
    if not bad or not good:
        return Model()
    rate = labels.where(~held_out(F.col("doc_id"))).agg(F.avg(F.col("toxic").cast("double"))).first()[0] or 0.0

    def chance(b: float, g: float, prior: float = 0.5, weight: float = 1.0) -> float:
        """Toxic share of documents with a feature, at the true share of toxic documents, drawn to ``prior``."""
        b_, g_ = rate * b / bad * (bad + good), (1 - rate) * g / good * (bad + good)
        return (b_ + prior * weight) / (b_ + g_ + weight)

    model = Model()
    for feature, (b, g) in _per_document(examples, _features, bad / (bad + good)).items():
        (model.terms if feature[0] == "w" else model.stems)[feature[1:]] = chance(b, g)
    # Words that merely go with toxic texts add up in long ones; a term has to make its document toxic by itself, and a
    # stem must be clearer than a term, as it stands for many words.
    model.stems = {s: p for s, p in model.stems.items() if p > 0.9}
    model.terms = dict(sorted(((t, p) for t, p in model.terms.items() if p > 0.75), key=lambda x: (-x[1], x[0]))[:MAX_TERMS])
    first = Matcher(model)

    def outcomes(text: str) -> set[str]:
        hits = first.hits(text)
        strong = [q for _, kind, _, q in hits if kind in ("exact", "stem")]
        near = {kind for _, kind, _, _ in hits if kind in ("near", "disguised")}
        return {*(near if not strong else ()), "any hit" if strong or near else "no hit",
                *(["quoted"] if strong and all(strong) else ["meant"] if strong else [])}

    counts = _all_counts(examples, outcomes)
    for kind in ("near", "disguised"):
        model.near[kind] = chance(*counts.get(kind, (0, 0)), prior=0.7, weight=2.0)
    quoted, meant = chance(*counts.get("quoted", (0, 0)), prior=0.25, weight=2.0), chance(*counts.get("meant", (0, 0)), prior=0.75, weight=2.0)
    model.quoted = min(1.0, quoted / meant)
    model.without = chance(*counts.get("no hit", (0, 0)), prior=rate, weight=1.0)
    # Surfaces near a term that clean documents use are words of their own.
    model.harmless = frozenset(_surfaces(examples.where("toxic = 0"), first))
    return model


def _all_counts(examples: DataFrame, outcomes) -> dict[str, tuple[int, int]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = Counter((f, toxic) for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("text")) for f in outcomes(text.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in counts], pa.string()), pa.array([y for _, y in counts], pa.int64()),
                                              pa.array(list(counts.values()), pa.int64())], ["f", "y", "n"])

    rows = examples.mapInArrow(run, "f string, y long, n long").groupBy("f", "y").agg(F.sum("n").alias("n")).collect()  # a handful
    out: dict[str, list[int]] = {}
    for r in rows:
        out.setdefault(r["f"], [0, 0])[1 - r["y"]] += r["n"]
    return {f: (b, g) for f, (b, g) in out.items()}


def _surfaces(examples: DataFrame, matcher: Matcher) -> list[str]:
    """Near surfaces in ``examples``, the most frequent ``MAX_TERMS``; their number is bounded by the sample's."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = Counter(t for text in batch.column("text") for t, kind, _, _ in matcher.hits(text.as_py()) if kind in ("near", "disguised"))
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["t", "n"])

    rows = examples.mapInArrow(run, "t string, n long").groupBy("t").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "t").limit(MAX_TERMS)
    return [r["t"] for r in rows.collect()]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and the hits (surface, class, term, quoted) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most a few ``MAX_TERMS`` strings

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(shared.value)
        kind = pa.list_(pa.struct([("surface", pa.string()), ("kind", pa.string()), ("term", pa.string()), ("quoted", pa.bool_())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                found = [matcher.hits(text.as_py() or "") for text in part.column("text")]
                rows = [[dict(zip(("surface", "kind", "term", "quoted"), h)) for h in hits] for hits in found]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([matcher.score(h) for h in found], pa.float64()), pa.array(rows, kind)], ["doc_id", "score", "hits"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, score double, hits array<struct<surface: string, kind: string, term: string, quoted: boolean>>")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = score(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), F.size("hits").alias("n_hits"))
