import re

import numpy as np
import pyarrow as pa

from textsieve.llm import kernels as K

TEXTS = ["Hello, World! x", "", None, "  a  b ", "É über\tQ\n", "one", "a" * 5000 + " b", "\x0b\x0c\x85x"]


def sets(texts, k):
    data, offsets = K.text_buffer(pa.array(texts))
    return K.shingle_sets(K.words_of(data, offsets, K.NOT_SPACE), k)


def test_words_follow_their_rules():
    data, offsets = K.text_buffer(pa.array(TEXTS))
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    for mask, rule in ((K.NOT_SPACE, r"[^\x20\x09-\x0D]+"), (K.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        w = K.words_of(data, offsets, mask)
        got = [[w.data[s:e].tobytes().decode() for s, e in zip(w.start[a:b], w.end[a:b], strict=True)] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
        assert got == [re.findall(rule, low(t)) for t in TEXTS]


def test_hashes_depend_on_words_only():
    data, offsets = K.text_buffer(pa.array(["aa bb aa", "bb", "ab"]))
    h = K.words_of(data, offsets, K.ALNUM).hashes()
    assert h[0] == h[2] and h[1] == h[3] and len(set(h.tolist())) == 3


def test_shingles():
    values, bounds = sets(["a b c d", "a b c", "b c", "c b", "", None, "a b c a b c", "B C"], 3)
    own = [set(values[a:b].tolist()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    assert [len(x) for x in own] == [2, 1, 1, 1, 0, 0, 3, 1]
    assert own[1] < own[0] and own[2] != own[3] and own[2] == own[7]


def test_slices_and_segments():
    assert list(K.slices(np.array([0, 5, 6, 30, 31]), 10)) == [(0, 2), (2, 3), (3, 4)]
    got = K.segment_reduce(np.minimum, np.array([3, 1, 2]), np.array([0, 0, 2, 2, 3, 3]), 9)
    assert got.tolist() == [9, 1, 9, 2, 9]
    assert list(K.slices(np.array([0]))) == []


def test_sliced_arrays_and_offsets():
    array = pa.array(["zz", "aa bb", "cc"]).slice(1)
    data, offsets = K.text_buffer(array)
    assert data.tobytes() == b"aa bbcc" and offsets.tolist() == [0, 5, 7]


def test_long_texts_hash_like_short_ones(monkeypatch):
    text = " ".join(f"word{i % 97} É{i % 13}" for i in range(4000)) + " " + "z" * 3000
    data, offsets = K.text_buffer(pa.array([text]))
    whole = K.words_of(data, offsets, K.ALNUM)
    ranges = whole.start[::-7], whole.end[::-7]
    want = whole.hashes(), whole.range_hashes(*ranges)
    monkeypatch.setattr(K, "SLICE_BYTES", 500)
    pieces = K.words_of(data, offsets, K.ALNUM)
    assert (pieces.hashes() == want[0]).all() and (pieces.range_hashes(*ranges) == want[1]).all() and pieces.sums is None
