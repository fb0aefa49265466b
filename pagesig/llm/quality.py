"""Quality classifier: logistic regression on hashed word n-grams, trained with
follow-the-regularised-leader (FTRL-proximal) updates, scored as sparse dot products.

Tokens are runs of letters and digits, and runs of other signs; a token equal to the one before
it becomes one fixed token, and a word in capitals gets a marker, so that repetition, sign noise
and shouting show in n-grams of unseen words too. Features are hashed token uni- and bigrams
plus the share of each kind of token in eighths of a power of two; a feature's value is the
square root of its share of the text's n-grams, and a text's features have length one.

The fit uses at most `FIT_ROWS` labelled rows per class outside the held-out fold, in hash order;
features are computed in Spark, the updates run over that bounded sample in a fixed order.
Scoring covers every whole text; the model (`2 ** BITS` floats at most) travels with the function.

Defined cases: null and empty texts score as a text without features (the bias alone); with no
labelled rows every score is 0.5; with rows of one class only, the bias decides; repeated rows score alike; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesig.llm import textbytes as tb
from pagesig.llm.common import doc_columns, fold_of
from pagesig.llm.toxicity import fit_rows

FIT_ROWS = 4000
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3
BITS = 18
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.5
_REPEAT, _MULT = np.uint64(0x5EED), np.uint64(0x9E3779B97F4A7C15)


def features(raw: np.ndarray, off: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value) of a slice of texts, sorted by row."""
    rows = len(off) - 1
    low = tb.lowered(raw)
    starts, ends, row, kind = tb.class_runs(low, off)
    if not len(row):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    token = tb.run_hashes(low, starts, ends)
    upper = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw >= 65) & (raw <= 90), out=upper[1:])
    shout = (upper[ends] - upper[starts] > 1) & (kind == 2)
    same = np.zeros(len(token), bool)
    same[1:] = (token[1:] == token[:-1]) & (row[1:] == row[:-1])
    token = np.where(same, _REPEAT, token)
    nexts = np.flatnonzero(row[1:] == row[:-1])
    pair = tb.mix(token[nexts] * _MULT + token[nexts + 1])
    total = np.maximum(np.bincount(row, minlength=rows), 1)
    extra_row, extra_key = [], []
    for n, mark in enumerate((same, shout, kind == 1)):
        count = np.bincount(row, weights=mark, minlength=rows)
        some = np.flatnonzero(count)
        step = np.round(np.log2(count[some] / total[some]) * 2).astype(np.int64)
        extra_row.append(some)
        extra_key.append(tb.mix((np.uint64(n + 1) << np.uint64(32)) + (step + 1000).astype(np.uint64)))
    at = np.concatenate([row, row[nexts]])
    key = np.concatenate([tb.mix(token), pair]) >> np.uint64(64 - bits)
    code, times = np.unique((at.astype(np.uint64) << np.uint64(bits)) | key, return_counts=True)
    at, key = (code >> np.uint64(bits)).astype(np.int64), (code & np.uint64((1 << bits) - 1)).astype(np.int64)
    value = np.sqrt(times)
    extra_row, extra_key = np.concatenate(extra_row), np.concatenate(extra_key) >> np.uint64(64 - bits)
    value = value / np.sqrt(np.bincount(at, weights=value ** 2, minlength=rows))[at]
    at = np.concatenate([at, extra_row])
    key = np.concatenate([key, extra_key.astype(np.int64)])
    value = np.concatenate([value, np.full(len(extra_row), 0.5)])
    order = np.argsort(at, kind="stable")
    return at[order], key[order], value[order]


def sparse_rows(rows: DataFrame) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(label, features, values) of the bounded fit rows, in an order fixed by their texts."""
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column(0).to_numpy(zero_copy_only=False)
            for i, j, raw, off in tb.text_slices(batch.column(1)):
                at, key, value = features(raw, off)
                edges = np.searchsorted(at, np.arange(j - i + 1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(labels[i:j].astype(np.int32)), batch.column(2).slice(i, j - i),
                     pa.array([key[a:b].astype(np.int32).tobytes() for a, b in zip(edges, edges[1:])], pa.binary()),
                     pa.array([value[a:b].astype(np.float32).tobytes() for a, b in zip(edges, edges[1:])], pa.binary())],
                    names=["label", "order", "keys", "vals"])

    found = rows.select("label", "text", F.xxhash64("text", "label").alias("order")).mapInArrow(
        extract, "label int, order long, keys binary, vals binary").toPandas()  # bounded by the fit rows
    found = found.sort_values(["order", "label"])
    return [(k, np.frombuffer(a, np.int32), np.frombuffer(v, np.float32)) for k, a, v in zip(found["label"], found["keys"], found["vals"])]


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], bits: int = BITS) -> tuple[np.ndarray, float]:
    """(weights, bias) after `EPOCHS` passes of per-coordinate FTRL-proximal updates."""
    size = (1 << bits) + 1  # the last coordinate is the bias
    z, n = np.zeros(size), np.zeros(size)

    def weight(at: np.ndarray) -> np.ndarray:
        free = np.abs(z[at]) > L1
        return np.where(free, -(z[at] - np.sign(z[at]) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2), 0.0)

    for _ in range(EPOCHS):
        for label, keys, values in rows:
            at, x = np.append(keys, size - 1), np.append(values, 1.0).astype(float)
            w = weight(at)
            slope = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
            z[at] += slope - (np.sqrt(n[at] + slope ** 2) - np.sqrt(n[at])) / ALPHA * w
            n[at] += slope ** 2
    every = weight(np.arange(size))
    return every[:-1].astype(np.float32), float(every[-1])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> tuple[np.ndarray, float]:
    return train(sparse_rows(fit_rows(docs, labels, label, FOLDS, HELD_OUT, FIT_ROWS)))


def scored(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """(doc_id, held_out, score, predicted) per document."""
    weights, bias = model
    used = np.flatnonzero(weights).astype(np.int32)  # the model is sparse: ship what is not zero
    values = weights[used]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.zeros(1 << BITS, np.float32)
        w[used] = values
        for batch in batches:
            for i, j, raw, off in tb.text_slices(batch.column(2)):
                at, key, value = features(raw, off)
                score = 1 / (1 + np.exp(-(np.bincount(at, weights=w[key] * value, minlength=j - i) + bias)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(score),
                     pa.array((score >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = doc_columns(docs, "doc_id", "text").select(
        "doc_id", (fold_of(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "text")
    return rows.mapInArrow(judge, "doc_id long, held_out boolean, score double, predicted int")
