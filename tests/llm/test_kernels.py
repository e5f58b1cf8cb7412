import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import kernels as K
from tidemark.llm.components import components

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aAbZ09 .-_é中\n😀", max_size=30)), min_size=1, max_size=8)


def lower(t):
    return bytes(K.LOWER[np.frombuffer((t or "").encode(), np.uint8)])


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_words_equal_the_pattern(texts):
    data, offsets = K.buffers(pa.array(texts, pa.string()))
    h, starts, ends, first = K.word_hashes(data, offsets)
    want = [WORD.findall(lower(t)) for t in texts]
    got = [[bytes(K.LOWER[data[s:e]]) for s, e in zip(starts[a:b], ends[a:b])] for a, b in zip(first, first[1:])]
    assert got == want
    flat = [w for ws in want for w in ws]
    assert len(set(flat)) == len(set(h.tolist())) and all(len({x for x, w in zip(h.tolist(), flat) if w == v}) == 1 for v in set(flat))


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.integers(1, 5))
def test_shingles(texts, k):
    data, offsets = K.buffers(pa.array(texts, pa.string()))
    h, _, _, first = K.word_hashes(data, offsets)
    s, text = K.shingle_hashes(h, first, k)
    for i, t in enumerate(texts):
        w = WORD.findall(lower(t))
        want = {tuple(w[j : j + k]) for j in range(max(len(w) - k + 1, 1))} if w else set()
        assert len(set(s[text == i].tolist())) == len(want) and (text == i).sum() == (max(len(w) - k + 1, 1) if w else 0)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=40), st.integers(1, 40))
def test_sliding_min(values, w):
    if w <= len(values):
        got = K.sliding_min(np.array(values, dtype=np.uint64), w)
        assert got.tolist() == [min(values[i : i + w]) for i in range(len(values) - w + 1)]


def test_slices_of_arrow_arrays():
    column = pa.array(["xx", None, "a b", "c"]).slice(1, 2)
    data, offsets = K.buffers(column)
    assert bytes(data) == b"a b" and offsets.tolist() == [0, 0, 3]
    assert [(a, b) for a, b, _, _ in K.chunks(data, offsets, 1)] == [(0, 1), (1, 2)]


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7), (200, 200)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(chain, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0
