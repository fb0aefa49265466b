"""Vectorised tokenising and hashing of Arrow string columns (runs inside tasks).

A batch of texts is one byte buffer plus offsets. Runs of bytes are found with a class table,
and each run gets a 64-bit polynomial hash from prefix sums, so no Python code runs per word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
SLICE_BYTES = 1 << 21  # texts are worked on in slices of about this many bytes

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
# space 0, ASCII punctuation and symbols 1, everything else (letters, digits, non-ASCII) 2
_CLASS = np.full(256, 2, np.uint8)
_CLASS[33:48] = _CLASS[58:65] = _CLASS[91:97] = _CLASS[123:127] = 1
_CLASS[list(SPACES)] = 0

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (xor-shift-multiply), elementwise."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + n + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES):
    """Row ranges [i, j) whose texts hold about `limit` bytes (a longer text is its own range)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def text_slices(column: pa.Array, limit: int = SLICE_BYTES):
    """(i, j, bytes, offsets from 0) for each slice of a string column."""
    raw, off = buffers(column)
    for i, j in slices(off, limit):
        yield i, j, raw[off[i]:off[j]], off[i:j + 1] - off[i]


def _doc_starts(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    mark = np.zeros(len(raw) + 1, bool)
    mark[off[:-1]] = True
    return mark[:-1]


def word_runs(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row of the runs of non-space bytes."""
    word = ~_IS_SPACE[raw]
    prev = np.empty_like(word)
    prev[:1] = False
    prev[1:] = word[:-1]
    first = _doc_starts(raw, off)
    starts = np.flatnonzero(word & (~prev | first))
    last = np.empty_like(word)
    last[-1:] = True
    last[:-1] = ~word[1:] | first[1:]
    ends = np.flatnonzero(word & last) + 1
    return starts, ends, np.searchsorted(off, starts, side="right") - 1


def class_runs(raw: np.ndarray, off: np.ndarray):
    """Starts, ends, row and kind (1 punctuation, 2 word) of runs of one character class."""
    kind = _CLASS[raw]
    edge = _doc_starts(raw, off)
    edge[1:] |= kind[1:] != kind[:-1]
    cut = np.flatnonzero(edge)
    ends = np.append(cut[1:], len(raw))
    keep = kind[cut] > 0
    cut, ends = cut[keep], ends[keep]
    return cut, ends, np.searchsorted(off, cut, side="right") - 1, kind[cut]


def segment_runs(raw: np.ndarray, off: np.ndarray):
    """Starts, ends and row of segments: a run of spaces (maybe empty) and the word after it.
    A segment starts where a text starts and where a space follows a non-space."""
    if not len(raw):
        z = np.zeros(0, np.int64)
        return z, z, z
    space = _IS_SPACE[raw]
    edge = _doc_starts(raw, off)
    edge[1:] |= space[1:] & ~space[:-1]
    cut = np.flatnonzero(edge)
    return cut, np.append(cut[1:], len(raw)), np.searchsorted(off, cut, side="right") - 1


def lowered(raw: np.ndarray) -> np.ndarray:
    return _LOWER[raw]


def run_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each run of bytes."""
    n = len(raw)
    if n == 0 or not len(starts):
        return np.zeros(0, np.uint64)
    have = _powers.get(0)
    if have is None or len(have[0]) < n:
        size = max(n, SLICE_BYTES + (SLICE_BYTES >> 2))
        up, down = np.full(size, _BASE), np.full(size, _INVERSE)
        up[0] = down[0] = 1
        have = (np.multiply.accumulate(up), np.multiply.accumulate(down))
        if size <= 4 * SLICE_BYTES:
            _powers[0] = have
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[raw] * have[0][:n], out=total[1:])
    return mix((total[ends] - total[starts]) * have[1][starts] + (ends - starts).astype(np.uint64))


def word_hashes(raw: np.ndarray, off: np.ndarray):
    """Hash and row of every word, A-Z lower-cased."""
    low = lowered(raw)
    starts, ends, row = word_runs(low, off)
    return run_hashes(low, starts, ends), row


def ragged(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of values[s : s + n] over all (s, n)."""
    total = int(lengths.sum())
    if not total:
        return values[:0]
    begin = np.cumsum(lengths) - lengths
    return values[np.arange(total) + np.repeat(starts - begin, lengths)]
