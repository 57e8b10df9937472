"""BPE, Merkle trees, chat threads and the whole pipeline."""

import hashlib
import random

import public_tokenizers
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from catalogspark.llm import bpe, chat, merkle, neardup, quality

from .conftest import ODD

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path(bpe.RANKS)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def test_chunks_resynchronise_to_the_tokens_of_the_whole(library):
    rng, pattern = random.Random(1), regex.compile(public_tokenizers.PATTERN)
    merger = bpe.Merger(bpe.read_ranks(PATH))
    for _ in range(800):
        text = "".join(rng.choice(["a", "b ", " ", "\n", "  ", "'s", "é1", "!!", "x" * 40, "\t", "' ve", "𝒳"]) for _ in range(rng.choice([3, 60, 200])))
        chunk = rng.choice([8, 20, 50])
        found = bpe.pretokens(pattern, text, chunk, min(chunk, rng.choice([2, 4, 9, 20])))
        assert found == pattern.findall(text)
        assert [i for ids in merger.merged([t.encode() for t in found]) for i in ids] == library.encode_ordinary(text)
        assert [i for t in found for i in bpe.merge(merger.ranks, t.encode())] == library.encode_ordinary(text)


def test_digests_are_those_of_the_library(docs, library):
    pairs = [*ODD, (20, "<|endoftext|> a  b\n\n c"), (21, "wort " * 9000), (22, "​  漢字漢字" * 50)]
    rows = bpe.digests(docs(pairs), PATH).collect()
    assert len(rows) == len(pairs)
    texts = dict(pairs)
    for r in rows:
        text = texts[r["doc_id"]] or ""
        ids = library.encode_ordinary(text)
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    kept = bpe.encode(docs(pairs), PATH)
    assert set(docs(pairs).columns) < set(kept.columns) and bpe.encode(docs(pairs).limit(0), PATH).count() == 0


def test_merkle_contract_against_brute_force(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r for r in merkle.compared_with_next(table.repartition(7)).collect()}
    texts = sorted(((r["doc_id"], r["text"]) for r in table.collect()), reverse=True)
    assert len(rows) == len(texts)
    for k, (doc, text) in enumerate(texts):
        following, third = texts[(k + 1) % len(texts)][1], len(text) // 3
        edited, r = text[:len(text) - third] + following[:third], rows[doc]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == merkle.tree(text)[0] and r["edited_fingerprint"] == merkle.tree(edited)[0]
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert sum(r["near_edited"] > r["near_next"] for r in rows.values()) > 0.9 * len(rows)


def test_merkle_odd_cases_and_edits(docs):
    rows = merkle.compared_with_next(docs(ODD)).collect()
    assert len(rows) == len(ODD)
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert by[1][0]["fingerprint"] == by[2][0]["fingerprint"] and by[5][0]["fingerprint"] == by[5][1]["fingerprint"] == by[None][0]["fingerprint"]
    assert by[1][0]["n_chars"] == 0 and merkle.compared_with_next(docs(ODD).limit(0)).count() == 0
    assert merkle.compared_with_next(docs([(4, "one only.")])).first()["near_next"] == 1.0
    old, new = merkle.nodes(docs([(1, "One. Two.\nThree. Four.")])), merkle.nodes(docs([(1, "One. Two.\nThree! Four.")]))
    assert [(r["from_char"], r["n_chars"]) for r in merkle.edits(old, new).collect()] == [(10, 7)]
    assert merkle.edits(old, old).count() == 0
    text = "A b. C d!\n\nE f " * 30
    assert "".join(s for line in text.split("\n") for s in merkle.sentences(line)) == text.replace("\n", "")


CHAT = [(1, 0, "user", "Hello there.\nHow are you?"), (1, 1, "assistant", "Fine, thanks."), (1, 2, "user", "And tomorrow?"),
        (1, 3, "assistant", "On Monday A wrote:\n> hello   There.\n> How are you?\nReply to first."), (1, 4, "user", "> Reply to first.\n>> How are you?\nnested"),
        (1, 5, "user", "goes on"), (1, 6, "assistant", "> fine, thanks.\nto the second"), (1, 7, "user", "> unknown words\nfree"),
        (2, 0, "user", None), (2, 0, "user", None), (None, 1, "user", "x"), (None, 2, "user", "> x\ny"), (3, None, "user", "")]


def test_replies_follow_what_they_quote(spark):
    rows = spark.createDataFrame([(*r, "z") for r in CHAT], "conv_id long, turn long, role string, text string, body string")
    got = chat.reply_ordered(rows).collect()
    one = [(r["turn"], r["body"], r["n_quotes"], r["reply_to"], r["depth"]) for r in got if r["conv_id"] == 1]
    assert one == [(0, "Hello there.\nHow are you?", 0, None, 0), (1, "Fine, thanks.", 0, None, 0), (2, "And tomorrow?", 0, None, 0),
                   (6, "to the second", 1, 1, 1), (7, "free", 1, None, 1), (3, "Reply to first.", 1, 0, 1), (4, "nested", 2, 3, 2), (5, "goes on", 0, None, 2)]
    assert [(r["turn"], r["reply_to"]) for r in got if r["conv_id"] is None] == [(1, None), (2, 1)]
    assert [(r["body"], r["copies"]) for r in got if r["conv_id"] == 2] == [("", 2)]
    assert sum(r["copies"] for r in got) == len(CHAT)
    assert chat.reply_ordered(rows.limit(0)).count() == 0


def test_reply_order_of_deep_threads(spark):
    """Random reply trees: rows come in the order in which the tree is read."""
    rng = random.Random(7)
    parent = {0: None}
    rows = [(1, 0, "user", "message number 0 here")]
    for n in range(1, 60):
        to = rng.randrange(n)
        quote = rng.random() < 0.6
        parent[n] = (to, True) if quote else (n - 1, False)
        rows.append((1, n, "user", (f"> message number {to} here\n" if quote else "") + f"message number {n} here"))
    got = [r["turn"] for r in chat.reply_ordered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()]

    def read(n):
        goes_on = [m for m in parent if parent[m] == (n, False)]
        replies = sorted(m for m in parent if parent[m] == (n, True))
        return [n, *(x for m in [*goes_on, *replies] for x in read(m))]

    assert got == read(0)


def test_pipeline_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF).cache()
        seen[name] = (docs, out)
        docs = out
    start, judged = seen["quality_rules"]
    kept = {r["doc_id"] for r in quality.quality_report(start).where("kept").collect()}
    assert {r["doc_id"] for r in judged.collect()} == kept and judged.columns == corpus_pipeline.COLUMNS
    before, after = seen["near_dedup"]
    classes = {r["class_id"] for r in neardup.classes(before).collect()}
    assert {r["doc_id"] for r in after.collect()} == classes
    assert after.where(F.length("text") != F.col("n_chars")).count() == 0
    sampled, ids = seen["encode_bytes"]
    assert sampled.count() == ids.count() > 0


def test_pipeline_of_nothing_and_of_odd_rows(spark, docs, tmp_path):
    docs(ODD).drop("id", "key").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() >= 0
