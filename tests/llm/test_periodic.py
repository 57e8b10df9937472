"""Runs of periodic words against brute force over all periods."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from catalogspark.llm import periodic

from .conftest import ODD, words

SF = "/root/testdata/sf0.001"


def brute(ws, least=24):
    found = {}
    for p in range(1, len(ws) // 3 + 1):
        i = 0
        while i + p < len(ws):
            if ws[i] != ws[i + p]:
                i += 1
                continue
            j = i
            while j + p < len(ws) and ws[j] == ws[j + p]:
                j += 1
            if j + p - i >= max(least, 3 * p):
                found.setdefault((i, j + p - i), p)  # the smallest period comes first
            i = j
    return sorted((s, n, p) for (s, n), p in found.items())


def planted(doc_id, text):
    ws = words(text)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not ws:
        return ws
    g, n = h // 10, len(ws)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [ws[i] if i < a else ws[a + (i - a) % p] for i in range(n)]


def expected(doc_id, text):
    ws = planted(doc_id, text)
    runs = brute(ws)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    top = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(runs), *top, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(w for i, w in enumerate(ws) if i not in gone)))


def test_extensions_against_comparison():
    rng = np.random.default_rng(1)
    for n in (1, 2, 30, 400):
        symbols = rng.integers(1, 3, n).astype(np.uint64)
        symbols[n // 3:n // 2] = 1
        ext = periodic.Extensions(symbols)
        i = rng.integers(0, n, 500)
        j = rng.integers(0, n, 500)
        i, j = np.minimum(i, j), np.maximum(i, j)
        i, j = i[i < j], j[i < j]
        got = ext(i, j, n - j)
        for x, y, g in zip(i, j, got):
            k = 0
            while y + k < n and symbols[x + k] == symbols[y + k]:
                k += 1
            assert g == k


def test_runs_against_brute_force_over_several_texts():
    rng = random.Random(3)
    for least in (6, 24):
        for _ in range(60):
            texts = []
            for _ in range(rng.choice([1, 5])):
                ws = []
                while len(ws) < rng.choice([0, 10, 80, 300]):
                    unit = [rng.randint(1, 3) for _ in range(rng.choice([1, 2, 3, 7, 20]))]
                    ws += unit * rng.choice([1, 1, 3, 5, 12])
                texts.append(ws)
            symbols = np.array([w for ws in texts for w in ws], np.uint64)
            begun = np.concatenate([[0], np.cumsum([len(ws) for ws in texts])]).astype(np.int64)
            got = list(zip(*(x.tolist() for x in periodic.runs_of(symbols, begun, least))))
            assert got == [(t, *r) for t, ws in enumerate(texts) for r in brute(ws, least)]


@pytest.fixture(scope="module")
def result(spark):
    return {r["doc_id"]: tuple(r)[1:] for r in periodic.op13_periodic_runs(spark, SF).collect()}


def test_query_against_brute_force(spark, result):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(result) == len(rows)
    # Brute force is quadratic: the texts of up to 1,500 words, nearly all.
    short = [r for r in rows if len(words(r["text"])) <= 1500]
    assert len(short) > 0.9 * len(rows)
    for r in short:
        assert result[r["doc_id"]] == expected(r["doc_id"], r["text"]), r["doc_id"]
    assert any(v[0] for v in result.values())


def test_odd_cases_and_collapsed_texts(docs):
    pairs = [*ODD, (8, "a b " * 40), (9, "x " + "k l m " * 20 + "y " + "z " * 30), (10, "é " * 24)]
    got = periodic.periodic_runs(docs(pairs)).collect()
    assert len(got) == len(pairs)
    for (_, text), r in zip(sorted(pairs, key=lambda p: (str(p[0]), p[1] or "")), sorted(got, key=lambda r: (str(r["doc_id"]), r["collapsed"]))):
        assert r["n_words"] == len(words(text))
        assert [tuple(x) for x in r["runs"]] == brute(words(text))
    texts = {r["doc_id"]: r["collapsed"] for r in got}
    assert texts[8] == "a b" and texts[9] == "x k l m y z" and texts[10] == "é" and texts[1] == ""
    assert periodic.periodic_runs(docs([]).limit(0)).count() == 0
