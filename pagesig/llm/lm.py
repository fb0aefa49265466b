"""Language-model scoring by deleted interpolation.

Model: P(w | v) = a2 * c(v w) / c(v) + a1 * c(w) / N + a0 / (V + 1), the weights a taken from the
bucket of the context's frequency (powers of two; unseen contexts have a bucket of their own).
Counts come from all training documents; the weights are learned by expectation-maximisation on
the documents of one training fold (`TUNE`), against counts from which that fold is deleted.

Data flow. Texts are cut into chunks of a few megabytes, stored compressed. Each chunk asks for
the counts of its distinct unigrams and bigrams: 64-bit keys, sorted, a packed array per key
bucket, together with how often the chunk has each in training text. A bucket adds up what all
chunks have and answers each with a packed array of totals, so an n-gram travels once per chunk
that has it, whatever its frequency, and a hot word or pair is one key among many. The chunk
then scores its documents. No n-gram table is cut, capped, sampled or sent to the driver; keys
are hashes (two n-grams share one with a probability of 5e-20 per pair).

Defined cases: a null text is an empty one (its end token only); a null doc_id counts as the
empty text for its fold; repeated rows are scored and counted as often as they occur; with no
training text only the uniform part is left; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesig.llm import textbytes as tb
from pagesig.llm.common import doc_columns, fold_of, stored

FOLDS, HELD_OUT, TUNE = 10, 0, 1
ADD = 0.1  # of the base model
CHUNK_BYTES = 4 << 20
BUCKET_BYTES = 12 << 20  # of text behind one key bucket
STEPS = 4  # quantisation of probabilities in the tuning histogram, per power of two
ROUNDS = 40
_END, _START = np.uint64(0xE4D), np.uint64(0x57A47)
_ONE, _MULT = np.uint64(1), np.uint64(0x9E3779B97F4A7C15)


def _pack(values: np.ndarray) -> bytes:
    import zstandard
    return zstandard.ZstdCompressor(level=1).compress(values.tobytes())


def _unpack(data: bytes, kind) -> np.ndarray:
    import zstandard
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


CHUNK = "chunk long, tune boolean, bytes long, doc_ids array<long>, folds array<int>, offsets array<long>, text binary"


def chunks(docs: DataFrame) -> DataFrame:
    """Documents in chunks, lower-cased and compressed; tuning documents in chunks of their own."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        held = {True: [], False: []}
        size = {True: 0, False: 0}

        def flush(tune: bool) -> pa.RecordBatch:
            nonlocal made
            ids, folds, parts = zip(*held[tune])
            off = np.cumsum([0, *map(len, parts)])
            raw = tb.lowered(np.concatenate(parts))
            row = {"chunk": [(task << 32) | made], "tune": [tune], "bytes": [int(off[-1])], "doc_ids": [list(ids)],
                   "folds": [list(folds)], "offsets": [off.tolist()], "text": [_pack(raw)]}
            made += 1
            held[tune], size[tune] = [], 0
            return pa.RecordBatch.from_pylist([{k: v[0] for k, v in row.items()}], schema=schema)

        for batch in batches:
            ids, folds = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            raw, off = tb.buffers(batch.column(2))
            for k, (i, fold) in enumerate(zip(ids, folds)):
                tune = fold == TUNE
                held[tune].append((i, fold, raw[off[k]:off[k + 1]]))
                size[tune] += int(off[k + 1] - off[k])
                if size[tune] >= CHUNK_BYTES:
                    yield flush(tune)
        for tune in held:
            if held[tune]:
                yield flush(tune)

    schema = pa.schema([("chunk", pa.int64()), ("tune", pa.bool_()), ("bytes", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
                        ("folds", pa.list_(pa.int32())), ("offsets", pa.list_(pa.int64())), ("text", pa.binary())])
    rows = doc_columns(docs, "doc_id", "text").select(
        "doc_id", fold_of(F.col("doc_id"), FOLDS).cast("int").alias("fold"), "text")
    return stored(rows.mapInArrow(cut, CHUNK), "chunks")


class Tokens:
    """Keys of a chunk: per token (words, then an end token per text) its row, the key of its
    word, of its context and of the pair. Unigram keys are odd, pair keys even."""

    def __init__(self, offsets: np.ndarray, text: bytes):
        raw = _unpack(text, np.uint8)
        rows = len(offsets) - 1
        starts, ends, row = tb.word_runs(raw, offsets)
        words = tb.run_hashes(raw, starts, ends)
        count = np.bincount(row, minlength=rows) + 1
        last = np.cumsum(count) - 1  # where each text's end token is
        word = np.full(int(count.sum()), _END)
        inner = np.ones(len(word), bool)
        inner[last] = False
        word[inner] = words
        context = np.empty_like(word)
        context[1:] = word[:-1]
        context[last - count + 1] = _START
        self.row = np.repeat(np.arange(rows), count)
        self.first = last - count + 1
        self.word = tb.mix(word) | _ONE
        self.context = tb.mix(context) | _ONE
        self.pair = tb.mix(tb.mix(context) * _MULT + word) & ~_ONE


START_KEY = int((tb.mix(np.array([_START])) | _ONE)[0])


def bucket_edges(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins in sorted keys (buckets are equal ranges of the key's top half)."""
    top = (np.arange(buckets + 1, dtype=np.uint64) << np.uint64(32)) // np.uint64(buckets)
    return np.searchsorted(keys >> np.uint64(32), top[:-1]).tolist() + [len(keys)]


def totals(chunked: DataFrame, buckets: int) -> DataFrame:
    """Answers (chunk, bucket, train, tune): packed totals for the chunk's sorted distinct keys
    in the bucket; and per bucket a row with chunk null and the bucket's share of N and V, with
    and without the tuning fold."""
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                t = Tokens(np.array(r["offsets"], np.int64), r["text"])
                train = (np.array(r["folds"]) != HELD_OUT)[t.row]
                starts = train[t.first]
                keys, back = np.unique(np.concatenate([t.word, t.pair, [np.uint64(START_KEY)]]), return_inverse=True)
                n = np.bincount(back, weights=np.concatenate([train, train, [starts.sum()]]), minlength=len(keys)).astype(np.uint32)
                edges = bucket_edges(keys, buckets)
                yield pa.RecordBatch.from_pydict({
                    "bucket": pa.array(range(buckets), pa.int32()), "chunk": pa.array([r["chunk"]] * buckets),
                    "is_tune": pa.array([r["tune"]] * buckets),
                    "keys": pa.array([keys[a:b].tobytes() for a, b in zip(edges, edges[1:])], pa.binary()),
                    "counts": pa.array([_pack(n[a:b]) for a, b in zip(edges, edges[1:])], pa.binary())})

    answer = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("is_tune", pa.bool_()), ("train", pa.binary()),
                        ("tune", pa.binary()), ("sums", pa.list_(pa.int64()))])

    def add(table: pa.Table) -> pa.Table:
        keys = [np.frombuffer(k, np.uint64) for k in table.column("keys").to_pylist()]
        counts = [_unpack(c, np.uint32) for c in table.column("counts").to_pylist()]
        tune = table.column("is_tune").to_pylist()
        own, back = np.unique(np.concatenate(keys), return_inverse=True)
        every = np.concatenate(counts).astype(np.float64)
        tuned = np.concatenate([c if t else np.zeros(len(c), np.uint32) for c, t in zip(counts, tune)])
        total = np.bincount(back, weights=every, minlength=len(own)).astype(np.uint64)
        held = np.bincount(back, weights=tuned, minlength=len(own)).astype(np.uint64)
        word = (own & _ONE).astype(bool) & (own != np.uint64(START_KEY))
        sums = [int(total[word].sum()), int((total[word] > 0).sum()), int((total - held)[word].sum()), int((total - held)[word].astype(bool).sum())]
        bucket, rows, at = table.column("bucket")[0].as_py(), [], 0
        for chunk, k, t in zip(table.column("chunk").to_pylist(), keys, tune):
            mine = back[at:at + len(k)]
            rows.append({"chunk": chunk, "bucket": bucket, "is_tune": t, "train": _pack(total[mine]),
                         "tune": _pack(held[mine]) if t else None, "sums": None})
            at += len(k)
        rows.append({"chunk": None, "bucket": bucket, "is_tune": None, "train": None, "tune": None, "sums": sums})
        return pa.Table.from_pylist(rows, schema=answer)

    asked = chunked.mapInArrow(ask, "bucket int, chunk long, is_tune boolean, keys binary, counts binary")
    return stored(asked.groupBy("bucket").applyInArrow(
        add, "chunk long, bucket int, is_tune boolean, train binary, tune binary, sums array<long>"), "totals")


def answered(chunk: pa.Table, answers: pa.Table, without_tune: bool):
    """A chunk's tokens with the totals of word, context and pair."""
    r = chunk.to_pylist()[0]
    t = Tokens(np.array(r["offsets"], np.int64), r["text"])
    rows = sorted(answers.to_pylist(), key=lambda a: a["bucket"])
    total = np.concatenate([_unpack(a["train"], np.uint64) for a in rows])
    if without_tune:
        total = total - np.concatenate([_unpack(a["tune"], np.uint64) for a in rows])
    keys, back = np.unique(np.concatenate([t.word, t.pair, [np.uint64(START_KEY)]]), return_inverse=True)
    assert len(keys) == len(total)
    n = len(t.word)
    word, pair = total[back[:n]].astype(np.float64), total[back[n:2 * n]].astype(np.float64)
    context = np.empty(n)
    context[1:] = word[:-1]
    context[t.first] = float(total[back[2 * n]])
    return r, t, word, context, pair


def level(context: np.ndarray) -> np.ndarray:
    """Bucket of a context frequency: 0 unseen, then powers of two."""
    return np.where(context > 0, np.floor(np.log2(np.maximum(context, 1))) + 1, 0).astype(np.int64)


def _steps(p: np.ndarray) -> np.ndarray:
    return np.where(p > 0, np.round(-np.log2(np.where(p > 0, p, 1)) * STEPS), -1).astype(np.int32)


def histogram(chunked: DataFrame, answers: DataFrame, n: int) -> DataFrame:
    """(level, q2, q1, tokens): how many tuning tokens have which quantised pair and word
    probabilities under the counts without the tuning fold."""
    def count(chunk: pa.Table, own: pa.Table) -> pa.Table:
        _, _, word, context, pair = answered(chunk, own, True)
        code = np.stack([level(context), _steps(pair / np.maximum(context, 1)), _steps(word / max(n, 1))], axis=1)
        rows, times = np.unique(code, axis=0, return_counts=True)
        return pa.table({"level": rows[:, 0].astype(np.int32), "q2": rows[:, 1].astype(np.int32),
                         "q1": rows[:, 2].astype(np.int32), "tokens": times.astype(np.int64)})

    found = chunked.filter("tune").groupBy("chunk").cogroup(answers.filter("is_tune").groupBy("chunk")).applyInArrow(
        count, "level int, q2 int, q1 int, tokens long")
    return found.groupBy("level", "q2", "q1").agg(F.sum("tokens").alias("tokens"))


def weights(found: DataFrame, types: int) -> dict[int, tuple[float, float, float]]:
    """Mixture weights per context level by expectation-maximisation; a level's histogram is
    bounded by the quantisation, so each level is one small group."""
    def em(rows: pd.DataFrame) -> pd.DataFrame:
        p = np.stack([np.where(rows["q2"] < 0, 0.0, 2.0 ** (-rows["q2"] / STEPS)),
                      np.where(rows["q1"] < 0, 0.0, 2.0 ** (-rows["q1"] / STEPS)),
                      np.full(len(rows), 1.0 / (types + 1))], axis=1)
        n, a = rows["tokens"].to_numpy(float), np.array([0.4, 0.4, 0.2])
        if rows["level"].iloc[0] == 0:
            a = np.array([0.0, 0.6, 0.4])
        for _ in range(ROUNDS):
            share = p * a
            share *= (n / share.sum(axis=1))[:, None]
            a = (share.sum(axis=0) + np.array([0, 0, 0.5])) / (n.sum() + 0.5)
        return pd.DataFrame({"level": [int(rows["level"].iloc[0])], "a2": [a[0]], "a1": [a[1]], "a0": [a[2]]})

    learned = found.groupBy("level").applyInPandas(em, "level int, a2 double, a1 double, a0 double").collect()
    return {r["level"]: (r["a2"], r["a1"], r["a0"]) for r in learned}


def weight_table(learned: dict[int, tuple[float, float, float]], levels: int = 64) -> np.ndarray:
    """A row of weights per level; a level without tuning tokens takes the nearest one's."""
    seen = sorted(k for k in learned if k > 0)
    table = np.zeros((levels, 3))
    for k in range(levels):
        if k == 0:
            table[k] = learned.get(0, (0.0, 0.6, 0.4))
        else:
            table[k] = learned[min(seen, key=lambda s: abs(s - k))] if seen else (0.3, 0.4, 0.3)
    return table


SCORES = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score(docs: DataFrame) -> DataFrame:
    """One row per document: the base (unigram) and the model's log10 probability of its text."""
    chunked = chunks(docs)
    size = chunked.agg(F.sum("bytes")).first()[0] or 0
    buckets = max(1, -(-size // BUCKET_BYTES))
    answers = totals(chunked, buckets)
    sums = answers.filter("chunk is null").select(*[F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(4)]).first()
    n, types, n_rest, types_rest = (int(sums[k] or 0) for k in range(4))
    table = weight_table(weights(histogram(chunked, answers, n_rest), types_rest))

    def judge(chunk: pa.Table, own: pa.Table) -> pa.Table:
        r, t, word, context, pair = answered(chunk, own, False)
        a = table[level(context)]
        p = a[:, 0] * pair / np.maximum(context, 1) + a[:, 1] * word / max(n, 1) + a[:, 2] / (types + 1)
        p = p / a.sum(axis=1) if n else np.full(len(word), 1.0 / (types + 1))
        rows = len(r["doc_ids"])
        base = np.log10((word + ADD) / (n + ADD * (types + 1)))
        return pa.table({
            "doc_id": pa.array(r["doc_ids"], pa.int64()), "held_out": pa.array(np.array(r["folds"]) == HELD_OUT),
            "n_tokens": np.bincount(t.row, minlength=rows).astype(np.int64),
            "n_known": np.bincount(t.row, weights=word > 0, minlength=rows).astype(np.int64),
            "train_tokens": np.full(rows, n, np.int64),
            "base_score": np.bincount(t.row, weights=base, minlength=rows),
            "score": np.bincount(t.row, weights=np.log10(p), minlength=rows)})

    return chunked.groupBy("chunk").cogroup(answers.filter("chunk is not null").groupBy("chunk")).applyInArrow(judge, SCORES)
