"""Spelling variants against brute force over all pairs."""

import random
import re
import zlib
from collections import Counter

import numpy as np

from catalogspark.llm import spelling

from .conftest import ODD

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(pairs):
    out = Counter()
    for doc, text in pairs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1:]
            if len(run) >= 7:
                out[run] += 1
    return {w: n for w, n in out.items() if n >= 2}


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)):] == b[i + 1:]


def brute(words):
    """Every word against all that share its deletion neighbourhood."""
    hood = {}
    for w in words:
        for key in {w} | {w[:i] + w[i + 1:] for i in range(len(w))}:
            hood.setdefault(key, []).append(w)
    links = {w: set() for w in words}
    for group in hood.values():
        for a in group:
            links[a].update(b for b in group if near(a, b))
    form = {}
    for w, others in links.items():
        best = min(others, key=lambda o: (-words[o], o), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, words[w], len(links[w]), words[form[w]] if form[w] else None))
    return out


def test_query_against_brute_force(spark):
    pairs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = [tuple(r) for r in spelling.op12_spelling(spark, SF).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    want = brute(counted(pairs))
    assert len(got) == len(want) and set(got) == want
    assert any(r[1] for r in got)


def test_blocks_tiles_and_chains_against_brute_force(spark):
    rng = random.Random(2)
    words = {}
    for size in (7, 8, 9, 13, 25, 40):
        for _ in range(25):
            base = "".join(rng.choice("abcé") for _ in range(size))
            words[base] = rng.choice([2, 1000, 100_000])
            for _ in range(12):
                i, kind = rng.randrange(size + 1), rng.randrange(3)
                made = base[:i] + ("" if kind == 0 else rng.choice("abcéz")) + base[i + (kind < 2):]
                words.setdefault(made, rng.choice([2, 3, 20, 200, 10_000]))
    words |= {"aaaaaaa" + c: 2 for c in "bcdefghijklmnopqrstuvwxyz"} | {"日本語の単語です": 5, "日本語の単語で": 50, "x" * 90_000: 3, "x" * 90_001: 40}
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    want = brute({w: n for w, n in words.items() if len(w) < 1000})
    want |= {("x" * 90_000, "x" * 90_001, "x" * 90_001, 3, 1, 40), ("x" * 90_001, None, "x" * 90_001, 40, 1, None)}
    for tile in (1000, 6):  # with small tiles most blocks are split
        got = [tuple(r) for r in spelling.spelling_groups(frame, tile=tile).select("word", "form", "root", "n", "n_near", "form_n").collect()]
        assert len(got) == len(want) and set(got) == want


def test_squared_distances_of_a_block():
    words = ["abcdefg", "abcdefh", "abcdef", "gfedcba", "zzzzzzz"]
    points = np.array([ord(c) for w in words for c in w], np.uint32)
    begun = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    counts = spelling.letter_counts(points, begun)
    a, b = spelling.near_rows(counts, np.zeros(5, int), np.ones(5, bool))
    assert sorted(zip(a.tolist(), b.tolist())) == [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)]


def test_odd_cases(docs):
    pairs = [*ODD, (20, "Straße größere GRÖSSERE größere"), (21, "größere größer größere xyz"), (None, "größere")]
    got = {tuple(r) for r in spelling.misspelt_words(docs(pairs)).where("n >= 2").collect()}
    assert got == set(counted(pairs).items())
    assert spelling.spelling_groups(spelling.misspelt_words(docs([]).limit(0))).count() == 0
