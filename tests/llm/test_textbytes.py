import re

import numpy as np
import pyarrow as pa

from pagesig.llm import textbytes as tb

TEXTS = ["The  cat", "", None, " tail \n", "a", "é ü\t漢字", "x\x0by\x0cz", "A" * 50]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_word_runs_follow_the_pattern():
    raw, off = tb.buffers(pa.array(TEXTS))
    starts, ends, row = tb.word_runs(raw, off)
    got = [(int(r), raw[s:e].tobytes().decode()) for s, e, r in zip(starts, ends, row)]
    assert got == [(i, w) for i, t in enumerate(TEXTS) for w in words(t)]


def test_hashes_agree_with_equality():
    texts = ["b a b c a", "c C A", "longer longer"]
    hashes, _ = tb.word_hashes(*tb.buffers(pa.array(texts)))
    every = [w.lower() for t in texts for w in words(t)]
    assert [(a == b) for a in every for b in every] == [bool(a == b) for a in hashes for b in hashes]


def test_segments_cover_the_text():
    raw, off = tb.buffers(pa.array(TEXTS))
    starts, ends, row = tb.segment_runs(raw, off)
    for i, t in enumerate(TEXTS):
        assert b"".join(raw[s:e].tobytes() for s, e, r in zip(starts, ends, row) if r == i).decode() == (t or "")


def test_slices_cover_all_rows():
    off = np.array([0, 5, 5, 100, 101, 300])
    assert [r for i, j in tb.slices(off, 50) for r in range(i, j)] == [0, 1, 2, 3, 4]


def test_ragged():
    v = np.arange(10)
    assert tb.ragged(v, np.array([3, 0, 7]), np.array([2, 0, 3])).tolist() == [3, 4, 7, 8, 9]
