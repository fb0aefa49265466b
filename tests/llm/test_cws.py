import hashlib
from collections import Counter

import numpy as np

from pagesig.llm import cws


def jaccard(a, b):
    a, b = Counter(a.lower().split()), Counter(b.lower().split())
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def check(rows, got, tolerance):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert len(got) == len(rows)
    errors = []
    for k, (i, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        sha = hashlib.sha256(edited.encode()).hexdigest()
        own = [r for r in got if r["doc_id"] == i and r["edited_sha256"] == sha and r["n_chars"] == len(text)]
        assert own
        errors += [own[0]["near_edited"] - jaccard(text, edited) if text.split() else 0,
                   own[0]["near_next"] - jaccard(text, after) if text.split() else 0]
        if edited == text:
            assert own[0]["near_edited"] == 1.0 and own[0]["fingerprint"] == own[0]["edited_fingerprint"]
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < tolerance
    by_text = {}
    for r, text in ((r, t) for i, t in rows for r in got if r["doc_id"] == i and r["n_chars"] == len(t)):
        by_text.setdefault(text, set()).add(r["fingerprint"])
    assert len({next(iter(f)) for f in by_text.values()}) >= len(by_text) * 0.8


def test_collision_rate_is_the_generalised_jaccard_similarity(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    check(rows, cws.fingerprints(docs).collect(), 0.1)


def test_many_buckets_give_the_same_result(docs, monkeypatch):
    one = {r["doc_id"]: tuple(r) for r in cws.fingerprints(docs).collect()}
    monkeypatch.setattr(cws.with_next, "__defaults__", (7,))
    assert {r["doc_id"]: tuple(r) for r in cws.fingerprints(docs).collect()} == one


def test_odd_rows(odd, empty, spark):
    rows = [(r["doc_id"], r["text"] or "") for r in odd.select("doc_id", "text").collect()]
    got = cws.fingerprints(odd).collect()
    assert len(got) == len(rows)
    prints = {}
    for r in got:
        prints.setdefault(r["doc_id"], set()).add(r["fingerprint"])
    assert prints[1] == prints[6] and len(prints[7]) == 1 and prints[2] == prints[3] == prints[4] != prints[1]
    assert cws.fingerprints(empty).collect() == []
    alone = spark.createDataFrame([(1, "only one here")], "doc_id long, text string")
    assert cws.fingerprints(alone).first()["near_next"] == 1.0


def test_range_bucket(spark):
    from pyspark.sql import functions as F
    cuts = [3, 5, 8, 13, 21, 34]
    rows = spark.range(0, 40).select("id", cws.range_bucket(F.col("id"), cuts).alias("b")).collect()
    assert all(r["b"] == sum(c < r["id"] for c in cuts) for r in rows)


def test_no_python_on_the_executors(docs):
    plan = cws.fingerprints(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
