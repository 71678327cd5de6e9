import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from siftline.llm import textvec as tv

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB é\n\t\x0b\x85 ", max_size=30)), max_size=12), st.integers(1, 40))
def test_words_and_hashes(texts, limit):
    column = pa.array(["x", *texts], pa.string()).slice(1)
    seen = {}
    rows = 0
    for a, b, data, offsets in tv.each_block(column, limit):
        starts, ends, bounds = tv.word_spans(data, offsets)
        hashes = tv.Prefix(data).hashes(starts, ends)
        for row in range(b - a):
            raw = (texts[a + row] or "").encode()
            got = [data[s:e].tobytes() for s, e in zip(starts[bounds[row] : bounds[row + 1]], ends[bounds[row] : bounds[row + 1]], strict=True)]
            assert got == WORD.findall(raw)
            for word, h in zip(got, hashes[bounds[row] : bounds[row + 1]], strict=True):
                assert seen.setdefault(word, h) == h
        rows += b - a
    assert rows == len(texts) and len(set(seen.values())) == len(seen)


def test_windows_and_large_buffers():
    data = np.frombuffer(b"abcabcabc" * 400_000, np.uint8)  # beyond the tables of powers made at first
    p = tv.Prefix(data)
    w = p.windows(5)
    assert len(np.unique(w)) == 3 and w[0] == w[-5] == p.hashes(np.array([3]), np.array([8]))[0]
    assert len(tv.Prefix(data[:3]).windows(5)) == 0


def test_kinds_of_columns():
    assert tv.buffers(pa.nulls(2))[1].tolist() == [0, 0, 0]
    assert tv.buffers(pa.array([b"ab", None, b"c"], pa.binary()))[0].tobytes() == b"abc"
    assert tv.buffers(pa.array([], pa.string()))[1].tolist() == [0]
    assert tv.buffers(pa.array(["é", "b"], pa.large_string()))[1].tolist() == [0, 2, 3]
    assert tv.sums_by(np.array([0, 2, 2, 3]), np.array([1, 2, 3])).tolist() == [3, 0, 3]
