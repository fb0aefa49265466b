"""Target-distribution importance resampling over hashed n-gram features.

Features are the runs of 1 to `MAX_N` words of a text, joined by one space; a feature's bucket is
the CRC-32 of its UTF-8 bytes modulo `BUCKETS`. A bucket's gain compares its share of the target
texts with its share of all documents, a document's weight is the sum of its features' gains, and
the documents with the highest weight plus Gumbel noise (a hash of the id) are drawn, which is a
draw without replacement in proportion to exp(weight / 1000).

Method (position-table CRC): CRC-32 is linear over XOR, so the CRC of a span is the XOR of one
table entry per byte, chosen by the byte and its distance from the span's end, and of a constant of
the span's length. All features of a slice of texts are hashed at once: their bytes look up the
tables, `bitwise_xor.reduceat` folds each span. Spans longer than the tables are folded block by
block: every block of `REACH` bytes has its own XOR, and a block's value is moved past the blocks
behind it by a table of REACH zero bytes.

Plan: one pass over the documents and one over the target texts count the buckets (a task's counts
are added up before the exchange: at most `BUCKETS` rows a task); the gains, one number a bucket,
go to the tasks of the second pass, which sums them per document. Scores are built-in expressions,
and ranks come from a range-partitioned running count.

Defined cases: null texts and texts without words have no features and weight 0; a null doc_id
counts as the empty text in the noise and stands last among ties; repeated rows are documents of
their own; an empty table gives no rows, an empty target table leaves every t at 0; other columns
are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesig.llm import textbytes as tb
from pagesig.llm.common import doc_columns, running, small_batches, stored

MAX_N = 1
BUCKETS = 10_000
SEED = 2024
LEAST_WORDS = 20
PERCENT = 10
REACH = 64  # bytes a position table covers
_POLY = 0xEDB88320  # reversed CRC-32 polynomial

# bytes of words: digits, letters and everything outside ASCII
_IS_WORD = np.zeros(256, bool)
_IS_WORD[0x30:0x3A] = _IS_WORD[0x61:0x7B] = _IS_WORD[0x80:] = True


def _position_tables(reach: int) -> np.ndarray:
    """[d, b]: what byte b with d bytes after it adds to the CRC register."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(_POLY), step >> 1).astype(np.uint32)
    out = np.empty((reach, 256), np.uint32)
    out[0] = step
    for d in range(1, reach):
        out[d] = (out[d - 1] >> 8) ^ step[out[d - 1] & 0xFF]
    return out


TABLES = _position_tables(REACH + 4)
# what each byte of a register (lowest first) becomes after REACH zero bytes: the register's bytes act
# as if XORed into the next four message bytes
SHIFT = np.stack([TABLES[REACH - 1 - k] for k in range(4)])
LENGTHS = np.array([zlib.crc32(bytes(n)) for n in range(4 * REACH)], np.uint32)


def length_constants(lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of so many zero bytes: what a span's length alone adds."""
    out = LENGTHS[np.minimum(lengths, len(LENGTHS) - 1)]
    for n in np.unique(lengths[lengths >= len(LENGTHS)]):
        out[lengths == n] = zlib.crc32(bytes(int(n)))
    return out


def span_crcs(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of raw[s:e] for each span (none empty; spans may overlap)."""
    if not len(starts):
        return np.zeros(0, np.uint32)
    edges = np.concatenate([[0], np.cumsum(ends - starts)])
    return np.concatenate([_crcs(raw, starts[i:j], ends[i:j]) for i, j in tb.slices(edges)])  # bounded working arrays


def _crcs(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    lengths = ends - starts
    # spans become blocks of REACH bytes counted from the end; a span's first block may be shorter
    counts = -(-lengths // REACH)
    first = np.cumsum(counts) - counts
    nth = np.arange(int(counts.sum())) - np.repeat(first, counts)  # blocks in text order
    block_end = np.repeat(ends - counts * REACH, counts) + (nth + 1) * REACH
    block_start = np.maximum(block_end - REACH, np.repeat(starts, counts))
    sizes = block_end - block_start
    at = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum())) - np.repeat(at, sizes)
    data = raw[place + np.repeat(block_start, sizes)]
    blocks = np.bitwise_xor.reduceat(TABLES[np.repeat(sizes, sizes) - 1 - place, data], at)
    total = blocks[first]
    more = np.flatnonzero(counts > 1)
    for k in range(1, int(counts.max())):
        more = more[counts[more] > k]
        value = total[more]
        total[more] = blocks[first[more] + k] ^ SHIFT[0][value & 0xFF] ^ SHIFT[1][(value >> 8) & 0xFF] \
            ^ SHIFT[2][(value >> 16) & 0xFF] ^ SHIFT[3][value >> 24]
    return total ^ length_constants(lengths)


def word_spans(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row of the words of lower-cased bytes."""
    word = _IS_WORD[raw]
    if not word.any():
        return (np.zeros(0, np.int64),) * 3
    edge = np.zeros(len(raw) + 1, bool)
    edge[off[:-1]] = True
    before = np.concatenate([[False], word[:-1]])
    after = np.concatenate([word[1:], [False]])
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(off, starts, side="right") - 1


def feature_crcs(raw: np.ndarray, off: np.ndarray, max_n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(CRC, row) of all features of the texts, and the number of words of each text."""
    low = tb.lowered(raw)
    starts, ends, row = word_spans(low, off)
    words = np.bincount(row, minlength=len(off) - 1)
    if max_n == 1:
        return span_crcs(low, starts, ends), row, words
    # the words again, one space between neighbours: a run of words is then one span
    sizes = ends - starts
    begin = np.cumsum(sizes + 1) - sizes - 1
    spaced = np.full(int((sizes + 1).sum()), 0x20, np.uint8)
    spaced[np.repeat(begin, sizes) + np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = \
        tb.ragged(low, starts, sizes)
    crcs, rows = [], []
    for n in range(1, max_n + 1):
        last = len(starts) - n + 1
        if last <= 0:
            break
        own = np.flatnonzero(row[:last] == row[n - 1:])
        crcs.append(span_crcs(spaced, begin[own], begin[own + n - 1] + sizes[own + n - 1]))
        rows.append(row[own])
    if not crcs:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64), words
    return np.concatenate(crcs), np.concatenate(rows), words


def bucket_counts(texts: DataFrame, max_n: int = MAX_N, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how many features of the column `text` fall into each bucket."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, raw, off in tb.text_slices(batch.column(0)):
                total += np.bincount(feature_crcs(raw, off, max_n)[0] % np.uint32(buckets), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    small_batches(texts.sparkSession)
    parts = texts.select(F.col("text").cast("string").alias("text")).filter("text is not null")
    return parts.mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, max_n: int = MAX_N, buckets: int = BUCKETS) -> np.ndarray:
    """One gain per bucket: 1000 times the logarithm of how much likelier the target has it."""
    source = bucket_counts(docs, max_n, buckets).withColumnRenamed("n", "s")
    aimed = bucket_counts(target, max_n, buckets).withColumnRenamed("n", "t")
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(source, "bucket", "left").join(aimed, "bucket", "left").select(
        "bucket", *[F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("s", "t")])
    both = stored(both, "buckets")
    sums = both.agg(F.sum("s").alias("s"), F.sum("t").alias("t")).first()
    rise = ((F.col("t") + 1) * (sums["s"] + buckets)) / ((F.col("s") + 1) * (sums["t"] + buckets))
    rows = both.select("bucket", F.floor(1000 * F.log(rise)).cast("long").alias("gain"))
    out = np.zeros(buckets, np.int64)
    for r in rows.collect():  # one row per bucket
        out[r["bucket"]] = r["gain"]
    return out


def weights(docs: DataFrame, gain: np.ndarray, max_n: int = MAX_N) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every document."""
    buckets = len(gain)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for i, j, raw, off in tb.text_slices(batch.column(1)):
                crcs, row, words = feature_crcs(raw, off, max_n)
                value = np.zeros(j - i, np.int64)
                np.add.at(value, row, gain[crcs % np.uint32(buckets)])
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, j - i), *[pa.array(x.astype(np.int64)) for x in (words, np.bincount(row, minlength=j - i), value)]],
                    names=["doc_id", "n_words", "n_features", "weight"])

    return doc_columns(docs, "doc_id", "text").mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, from a hash of the id."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame, max_n: int = MAX_N, buckets: int = BUCKETS, seed: int = SEED,
             least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank): rank is null for documents not drawn."""
    rows = weights(docs, gains(docs, target, max_n, buckets), max_n)
    rows = stored(rows.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "weights")
    enough = F.col("n_words") >= least_words
    number = rows.filter(enough).count() * percent // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    ranked = running(rows.filter(enough), order, {"before": F.lit(1)})
    drawn = ranked.withColumn("rank", F.when(F.col("before") < number, F.col("before") + 1).cast("long")).drop("before")
    return drawn.unionByName(rows.filter(~enough).withColumn("rank", F.lit(None).cast("long")))
