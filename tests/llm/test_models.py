"""Language, toxicity and recurrent model: held-out accuracy, exact contracts and odd cases."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalogspark.llm import language, recurrent, toxicity

from .conftest import ODD

SF = "/root/testdata/sf0.01"


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_automaton_finds_what_edit_distance_says():
    rng = random.Random(1)
    terms = ["".join(rng.choice("abc") for _ in range(rng.randint(3, 7))) for _ in range(25)]
    automaton = toxicity.Automaton(terms)
    for _ in range(3000):
        token = "".join(rng.choice("abcd") for _ in range(rng.randint(1, 8)))
        best = min((e, t) for t in terms if (e := edit_distance(token, t)) <= toxicity.allowed_edits(t)) if any(
            edit_distance(token, t) <= toxicity.allowed_edits(t) for t in terms) else None
        assert automaton.nearest(token) == best


def test_misspelled_disguised_and_quoted_terms(docs, spark):
    rng = random.Random(2)
    plain = lambda: [f"w{rng.randrange(4000)}" for _ in range(40)]
    pairs, labels = [], []
    for i in range(600):
        text = plain()
        if i % 4 == 0:
            text[5:7] = ["blockhead", "muppet"]
        pairs.append((i, " ".join(text)))
        labels.append((i, 1 if i % 4 == 0 else 0))
    pairs += [(1000, " ".join([*plain(), "bl0ckhead"])), (1001, " ".join([*plain(), "blockhaed", "blokhead"])), (1002, " ".join(plain())),
              (1003, " ".join(["he", "said", "“you", "blockhead”", *plain()])), (1004, " ".join(["you", "blockhead", *plain()])), *[(i, t) for i, t in ODD if i != 5]]
    frame = docs(pairs)
    model = toxicity.learn(frame, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert {"blockhead", "muppet"} <= set(model.terms)
    score = {r["doc_id"]: r["score"] for r in toxicity.score(frame, model).collect()}
    assert score[1000] > 0.3 and score[1001] > 0.3 and score[1004] > 0.9
    assert score[1002] < 0.3 and score[1003] < score[1004] and score[1] == score[2] == score[3]
    assert toxicity.score(docs(ODD), toxicity.Model()).agg(F.max("score")).first()[0] == 0.0
    empty = toxicity.learn(frame, spark.createDataFrame([], "doc_id long, toxic int"))
    assert not empty.terms


def test_toxicity_of_held_out_documents(spark):
    rows = toxicity.op5_toxicity(spark, SF).toPandas()
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in zip(rows.doc_id, rows.held_out))
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    both = rows[rows.held_out].merge(labels, on="doc_id")
    assert both[both.toxic == 0].predicted.mean() < 0.05 and both[both.toxic == 1].predicted.mean() > 0.5


def test_language_evidence_is_fused(spark):
    labelled = spark.createDataFrame([("the cat and the dog were here " * 5, "en"), ("der hund und die katze waren hier " * 5, "de")] * 4, "text string, lang string")
    page = lambda i, url, lang, body: (i, url, f"<html{lang}><script>und die der</script><body><p>{body}</p></body></html>", "x")
    rows = [page(i, f"http://a{i % 3}.de/x", " lang='de-AT'", "und die katze und der hund") for i in range(30)]
    rows += [page(100 + i, f"http://b{i % 3}.uk/x", ' lang="en"', "and the cat and the dog") for i in range(30)]
    rows += [page(200, "http://a1.de/x", "", ""), page(201, "http://new.uk/x", "", ""), page(202, "http://other.org/", ' lang="de"', ""), (203, None, None, "y"), page(204, "http://b1.uk/y", " lang=de", "and the cat and the dog here")]
    got = {r["page_id"]: r for r in language.identify(spark.createDataFrame(rows, "page_id long, url string, html string, host string"), labelled).collect()}
    assert len(got) == len(rows)
    assert got[0]["lang"] == "de" and got[100]["lang"] == "en"
    assert got[200]["lang"] == "de" and got[201]["lang"] == "en" and got[202]["lang"] == "de" and got[204]["lang"] == "en"
    assert got[200]["text_lang"] is None and got[203]["probability"] <= 0.8
    assert language.identify(spark.createDataFrame([], "page_id long, url string, html string"), labelled).count() == 0
    assert language.identify(spark.createDataFrame(rows, "page_id long, url string, html string, host string"), labelled.limit(0)).count() == 0


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")) + ["\0end"]


def test_language_model_base_is_exact_and_the_model_better(docs):
    rng = random.Random(6)
    chain = {c: rng.sample("abcdefgh", 2) for c in "abcdefgh"}
    pairs = []
    for i in range(300):
        c, text = rng.choice("abcdefgh"), []
        for _ in range(rng.randint(1, 120)):
            text.append(c * 2 + (f"{rng.randrange(500)}" if rng.random() < 0.2 else ""))
            c = rng.choice(chain[c])
        pairs.append((i, " ".join(text)))
    pairs += [(1000, None), (1001, ""), (1002, "Unseen WORDS")]
    frame = docs(pairs)
    rows = recurrent.scored(frame, frame.where("doc_id < 250")).toPandas()
    counts = Counter(t for i, text in pairs if i < 250 for t in tokens(text))
    total, kinds = sum(counts.values()), len(counts)
    for r in rows.itertuples():
        own = tokens(dict(pairs)[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(counts[t] > 0 for t in own), total)
        assert r.base_score == pytest.approx(sum(math.log10((counts[t] + 1) / (total + kinds + 1)) for t in own), rel=1e-9)
    new = rows[(rows.doc_id >= 250) & (rows.doc_id < 300)]
    assert new.score.sum() > new.base_score.sum()


def test_language_model_gradients():
    rng = np.random.default_rng(3)
    flat = recurrent.untrained(np.ones(recurrent.UNITS)) + rng.normal(0, 0.2, recurrent.untrained(np.ones(recurrent.UNITS)).shape).astype(np.float32)
    ids = rng.integers(0, 40, (5, 3)).astype(np.int32)

    def loss(p):
        h, total = np.zeros((3, recurrent.HIDDEN), np.float64), 0.0
        for row in ids:
            total -= recurrent.output(p, h, row)[0].sum()
            h = recurrent.forward(p, row, h)
            h[row == 0] = 0
        return total / ids.size

    trainer = recurrent.Trainer(flat)
    seen = {}
    trainer.m = {k: np.zeros_like(v) for k, v in trainer.p.items()}
    before = {k: v.astype(np.float64) for k, v in trainer.p.items()}
    trainer.window(ids, np.zeros((3, recurrent.HIDDEN), np.float32))
    norm = math.sqrt(sum(((m * 10) ** 2).sum() for m in trainer.m.values()))
    for name in ("inp", "gate", "cand", "cls", "mem"):
        slope = trainer.m[name] * 10  # Adam's first moment after one step, clipped at norm 1
        at = np.unravel_index(np.argmax(np.abs(slope)), slope.shape)
        up, down = ({k: v.copy() for k, v in before.items()} for _ in range(2))
        up[name][at] += 1e-4
        down[name][at] -= 1e-4
        seen[name] = (slope[at], (loss(up) - loss(down)) / 2e-4)
    ratio = [a / b for a, b in seen.values()]
    assert norm <= 1.001 and max(ratio) - min(ratio) < 0.02 * max(ratio) and min(ratio) > 0


def test_scores_add_up_to_one():
    """The network's chances over all units are one; so are a rare unit's words with its unknown word."""
    p = recurrent.unpack(recurrent.untrained(np.arange(recurrent.UNITS, dtype=float)))
    h = np.random.default_rng(1).normal(0, 1, (1, recurrent.HIDDEN)).repeat(recurrent.UNITS, 0).astype(np.float32)
    assert np.exp(recurrent.output(p, h, np.arange(recurrent.UNITS))[0].astype(float)).sum() == pytest.approx(1, abs=1e-3)
    words = recurrent.Vocabulary(np.array([1, 2, 3], np.uint64), np.array([5, 2, 1]), 8, 3, np.full(recurrent.RARE_UNITS, 4.0), np.full(recurrent.RARE_UNITS, 2.0))
    assert words.rare_total[0] == 7.0  # (c1 + 1) + (c2 + 1) + 1


def test_every_unit_is_trained_and_fill_does_not_count():
    rng = np.random.default_rng(2)
    flat = recurrent.untrained(np.ones(recurrent.UNITS))
    # One unit more than full lanes: it must change the parameters, and filled places must not.
    units = rng.integers(1, recurrent.UNITS, 8 * 5)
    whole, longer = recurrent.Trainer(flat), recurrent.Trainer(flat)
    whole.read(units)
    longer.read(np.append(units, 7))
    assert not np.allclose(recurrent.pack(whole.p), recurrent.pack(longer.p))
    few = recurrent.Trainer(flat)
    few.read(np.array([3]))
    alone = recurrent.Trainer(flat)
    alone.window(np.array([[3]]), np.zeros((1, recurrent.HIDDEN), np.float32))
    assert np.allclose(recurrent.pack(few.p), recurrent.pack(alone.p), atol=1e-5)


def test_two_level_average(spark):
    rows = [(float(w), [float(w * i) for i in range(50)]) for w in range(1, 40)]
    weight, mean = recurrent.averaged(spark.createDataFrame(rows, "weight double, params array<float>").repartition(9), (6, 2))
    assert weight == sum(w for w, _ in rows)
    assert np.allclose(mean, sum(np.array(v) * w for w, v in rows) / weight, rtol=1e-5)
    assert recurrent.averaged(spark.createDataFrame([], "weight double, params array<float>")) is None
