"""Passage dedup against brute force, and runs that begin or end inside a line."""

import random

import pytest

from catalogspark.llm import passages

from .conftest import ODD, words


def brute_words(pairs, least):
    """Words left of every text: those in no run of ``least`` words that stands earlier by (doc, word), sources kept."""
    seen, left = {}, {}
    for d, t in sorted(pairs):
        w = words(t)
        gone = set()
        for i in range(len(w) - least + 1):
            source = seen.setdefault(tuple(w[i:i + least]), (d, i))
            if source != (d, i):
                gone |= set(range(max(i, source[1] + least) if source[0] == d else i, i + least))
        left[d] = [x for i, x in enumerate(w) if i not in gone]
    return left


@pytest.mark.parametrize("seed", range(4))
def test_passages_equal_brute_force(docs, seed):
    rng = random.Random(seed)
    parts = [[f"w{rng.randrange(50)}" for _ in range(rng.choice([4, 9, 10, 11, 25]))] for _ in range(8)] + [["a"] * 7, ["a", "b", "c"] * 5, [f"z{j}" for j in range(8)] * 3]
    pairs = []
    for i in range(40):
        flow = [x for _ in range(rng.randint(0, 5)) for x in [*rng.choice(parts), *(f"u{rng.randrange(10 ** 6)}" for _ in range(rng.choice([0, 1, 3])))]]
        pairs.append((i, "".join(x + rng.choice([" ", " ", "\n", "  ", "\n\n"]) for x in flow)))
    pairs += [(100, pairs[3][1]), (101, pairs[3][1]), (102, pairs[7][1])]
    got = {r["doc_id"]: words(r["text"]) for r in passages.dedup_passages(docs(pairs), 10).collect()}
    assert got == brute_words(pairs, 10)


def test_a_passage_inside_lines_goes_and_the_rest_of_the_lines_stays(docs):
    shared = [f"p{i}" for i in range(59)]
    pairs = [(1, "head one " + " ".join(shared) + " tail one\nlast"),
             (2, "other\nbefore " + " ".join(shared[:30]) + "\n" + " ".join(shared[30:]) + " after\nend"),
             (3, "x " + " ".join(shared[:50]) + " y"), (4, "v " + " ".join(shared[:49]) + " z")]
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in passages.dedup_passages(docs(pairs)).collect()}
    assert got == {1: (pairs[0][1], 0), 2: ("other\nbefore\nafter\nend", 59), 3: ("x y", 50), 4: (pairs[3][1], 0)}


def test_passages_odd_cases(docs):
    rows = passages.dedup_passages(docs(ODD), 5).collect()
    assert len(rows) == len(ODD)
    texts = {(r["doc_id"], r["text"]) for r in rows}
    assert (1, None) in texts and (2, "") in texts and (None, "a b c d e f") in texts and (5, "") in texts
    assert passages.dedup_passages(docs(ODD).limit(0)).count() == 0
