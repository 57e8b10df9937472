import numpy as np
import pyarrow as pa
from hypothesis import given
from hypothesis import strategies as st

from catalogspark.llm.text_arrays import as_bytes, blocks, hash_spans, shingles, spans

TEXT = st.lists(st.one_of(st.none(), st.text(alphabet="ab \n\té", max_size=30)), max_size=8)


@given(TEXT)
def test_words_are_those_of_each_text(texts):
    data, offsets = as_bytes(pa.array(texts, pa.string()))
    starts, ends, owner = spans(data, offsets)
    got = [[] for _ in texts]
    for s, e, o in zip(starts, ends, owner):
        got[o].append(bytes(data[s:e]).decode())
    assert got == [(t or "").split() for t in texts]


@given(TEXT, TEXT)
def test_equal_words_have_equal_hashes_and_others_differ(one, two):
    def hashes(texts):
        data, offsets = as_bytes(pa.array(texts, pa.string()))
        starts, ends, _ = spans(data, offsets)
        return dict(zip([bytes(data[s:e]) for s, e in zip(starts, ends)], hash_spans(data, starts, ends)))

    a, b = hashes(one), hashes(two)
    assert all((a[x] == b[y]) == (x == y) for x in a for y in b)


def test_long_words_do_not_collide_by_moving_letters():
    texts = ["a" * 64 + "b" + "c" * 80, "b" + "a" * 63 + "a" + "c" * 80, "a" * 64 + "c" * 80 + "b"]
    data, offsets = as_bytes(pa.array(texts))
    starts, ends, _ = spans(data, offsets)
    assert len(set(hash_spans(data, starts, ends))) == 3


def test_blocks_are_whole_texts_in_order():
    offsets = np.array([0, 5, 5, 30, 31, 40])
    assert [x for a, b in blocks(offsets, 10) for x in range(a, b)] == [0, 1, 2, 3, 4]


def test_shingles_of_short_texts():
    grams, owner = shingles(np.arange(1, 9, dtype=np.uint64), np.array([0, 0, 0, 1, 1, 1, 1, 1]))
    assert owner.tolist() == [0, 1] and len(set(grams)) == 2
