"""Importance resampling: CRCs against zlib, the whole operator against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagesig.llm import resampling as R
from pagesig.llm import textbytes as tb

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_features(text, max_n):
    words = WORD.findall((text or "").translate(LOWER))
    return words, [" ".join(words[i:i + n]) for n in range(1, max_n + 1) for i in range(len(words) - n + 1)]


def plain(docs, target, max_n, buckets, percent=10, least=20):
    """[(doc_id, n_words, n_features, weight, score, rank)] with one loop per document."""
    def bucket(f):
        return zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for text in texts for f in plain_features(text, max_n)[1])
            for texts in ([x for _, x in docs], target))
    all_s, all_t = sum(s.values()), sum(t.values())
    rows = []
    for i, text in docs:
        words, features = plain_features(text, max_n)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
                     for b in map(bucket, features))
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, len(words), len(features), weight, score, None])
    ranked = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for k, r in enumerate(ranked[:len(ranked) * percent // 100]):
        r[5] = k + 1
    return Counter(map(tuple, rows))


def of(frame):
    return Counter((r["doc_id"], r["n_words"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in frame.collect())


@settings(deadline=None, max_examples=200)
@given(st.lists(st.binary(min_size=1, max_size=300), min_size=1, max_size=20))
def test_span_crcs_match_zlib(parts):
    raw = np.frombuffer(b"".join(parts), np.uint8)
    ends = np.cumsum([len(p) for p in parts])
    got = R.span_crcs(raw, ends - [len(p) for p in parts], ends)
    assert got.tolist() == [zlib.crc32(p) for p in parts]


@pytest.mark.parametrize("size", [R.REACH - 1, R.REACH, R.REACH + 1, 4 * R.REACH, 3 * R.REACH + 7, 1_000_003])
def test_long_spans(size):
    raw = np.random.default_rng(size).integers(0, 256, size + 5).astype(np.uint8)
    got = R.span_crcs(raw, np.array([0, 2, 5]), np.array([1, size + 2, size + 5]))
    assert got.tolist() == [zlib.crc32(raw[a:b].tobytes()) for a, b in ((0, 1), (2, size + 2), (5, size + 5))]


@settings(deadline=None, max_examples=100)
@given(st.lists(st.text(alphabet="aZ9 .é漢\x00\n-", max_size=40), max_size=6), st.integers(1, 3))
def test_features_match_the_pattern(texts, max_n):
    raw, off = tb.buffers(pa.array(texts, pa.string()))
    crcs, row, words = R.feature_crcs(raw, off, max_n)
    want = [plain_features(t, max_n) for t in texts]
    assert words.tolist() == [len(w) for w, _ in want]
    for k, (_, features) in enumerate(want):
        assert Counter(crcs[row == k].tolist()) == Counter(zlib.crc32(f.encode()) for f in features)


@pytest.mark.parametrize("max_n,buckets", [(1, 10_000), (2, 500)])
def test_documents_match_brute_force(spark, docs, max_n, buckets):
    target = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    own = [(r["doc_id"], r["text"]) for r in docs.collect()]
    aimed = [r["text"] for r in target.collect()]
    got = of(R.resample(docs, target, max_n, buckets))
    assert got == plain(own, aimed, max_n, buckets)
    assert sum(r[5] is not None for r in got) == sum(r[1] >= 20 for r in got) // 10


def test_odd_rows(spark, odd, empty):
    target = spark.createDataFrame([(1, "the warm cat", "x"), (2, None, "y"), (3, "shared1 shared2", "z")],
                                   "item_id long, text string, weight string")
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = R.resample(odd, target, percent=50)
    assert of(got) == plain(rows, [r["text"] for r in target.collect()], 1, R.BUCKETS, percent=50)
    assert of(R.resample(odd, target.filter("item_id > 9"))) == plain(rows, [], 1, R.BUCKETS)
    assert R.resample(empty, target).collect() == []


def test_ties_and_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(25))
    df = spark.createDataFrame([(5, text)] * 7 + [(6, text)] * 3 + [(None, text)] * 2, "doc_id long, text string")
    target = spark.createDataFrame([(text,)], "text string")
    got = R.resample(df, target, percent=50).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == [1, 2, 3, 4, 5, 6]
    assert len({(r["doc_id"], r["score"]) for r in got}) == 3
    assert of(R.resample(df, target, percent=50)) == plain([(r["doc_id"], r["text"]) for r in df.collect()], [text], 1, R.BUCKETS, 50)
