import math
import re
import zlib
from collections import Counter

import pytest

from pagesig.llm import lm


def tokens(text):
    text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", text) + ["</s>"]


def fold(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 10


def brute(rows):
    """Base scores and counts; the model's scores for given weights."""
    word, pair, context = Counter(), Counter(), Counter()
    for i, text in rows:
        if fold(i):
            own = tokens(text)
            word.update(own)
            pair.update(zip(["<s>", *own], own))
            context.update(["<s>", *own[:-1]])
    return word, pair, context


def test_scores_match_brute_force(spark, docs, odd, monkeypatch):
    monkeypatch.setattr(lm, "CHUNK_BYTES", 30_000)  # many chunks and buckets
    monkeypatch.setattr(lm, "BUCKET_BYTES", 60_000)
    learned = {}
    table = lm.weight_table
    monkeypatch.setattr(lm, "weight_table", lambda w: learned.setdefault("table", table(w)))
    for df in (docs, odd):
        learned.clear()
        rows = [(r["doc_id"], r["text"]) for r in df.collect()]
        word, pair, context = brute(rows)
        n, v = sum(word.values()), len(word)
        got = sorted((str(r["doc_id"]), r["n_tokens"], round(r["base_score"], 4)) for r in lm.score(df).collect())
        scored = {}
        for r in lm.score(df).collect():
            scored.setdefault(r["doc_id"], []).append(r)
        want = []
        for i, text in rows:
            own = tokens(text)
            base = sum(math.log10((word[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
            want.append((str(i), len(own), round(base, 4)))
            p = 0.0
            for c, w in zip(["<s>", *own], own):
                a = learned["table"][int(math.log2(context[c])) + 1 if context[c] else 0]
                p += math.log10((a[0] * (pair[c, w] / context[c] if context[c] else 0) + a[1] * word[w] / n + a[2] / (v + 1)) / sum(a))
            hits = [r for r in scored[i] if r["n_tokens"] == len(own) and abs(r["score"] - p) < 1e-6 * abs(p) + 1e-9]
            assert hits
            assert hits[0]["n_known"] == sum(w in word for w in own) and hits[0]["train_tokens"] == n
            assert hits[0]["held_out"] == (fold(i) == 0)
        assert got == sorted(want)


def test_beats_the_base_on_held_out_documents(docs):
    rows = [r for r in lm.score(docs).collect() if r["held_out"]]
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_weights_prefer_the_better_estimate(spark):
    df = spark.createDataFrame([(3, 4, 40, 1000), (5, -1, 40, 1000)], "level int, q2 int, q1 int, tokens long")
    learned = lm.weights(df, 10_000)
    assert learned[3][0] > 0.9 and learned[5][0] < 0.01
    assert all(sum(a) == pytest.approx(1) for a in learned.values())


def test_empty(empty):
    assert lm.score(empty).collect() == []
