import re

import pytest

from pagesig.llm import mixing


def targets(sizes):
    """Sources' targets by repeated resharing."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        weigh = sum(weight[s] for s in names if s not in capped) or 1
        over = {s for s in names if s not in capped and left * weight[s] / weigh > 3 * sizes[s]}
        if not over:
            return {s: 3.0 * sizes[s] if s in capped else left * weight[s] / weigh for s in names}
        capped |= over


def run(df):
    return mixing.mixture(df).collect()


def check(df, slack):
    rows, sizes, taken, got = run(df), {}, {}, {}
    for r in df.collect():
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        sizes[r["source"]] = sizes.get(r["source"], 0) + n
    for r in rows:
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        got[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"] and r["source_size"] == sizes[r["source"]]
    want = targets(sizes)
    assert got == pytest.approx(want) and len(rows) == df.count()
    for s in want:
        assert abs(taken[s] - want[s]) <= slack * max(want[s], 1) + 1
    return rows


def test_documents(docs):
    rows = check(docs, 0.1)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, run(docs)))


def test_caps_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 16)
    monkeypatch.setattr(mixing, "FAN_IN", 4)
    text = [(i, " ".join(["w"] * (1 + i * 7 % 40)), "hot" if i % 3 else f"s{i % 5}") for i in range(1500)]
    text += [(5000, "one two three", "tiny"), (5001, "solo", None)]
    df = spark.createDataFrame(text, "doc_id long, text string, source string")
    rows = check(df, 0.02)
    assert {r["taken"] for r in rows if r["source"] in ("tiny", None)} == {9, 3}


def test_expected_copies_stand():
    import numpy as np
    part, n = np.zeros(40), 400
    for seed in range(n):
        rng = np.random.default_rng(seed)
        size = np.arange(40, 0, -1) * 10
        out, held = mixing.fights(size, np.full(40, 0.3), rng.integers(0, 1 << 62, 40).astype(np.uint64), 0)
        assert abs((out * size).sum() - 0.3 * size.sum()) < 1e-6  # words never change
        part += out
    assert abs(part / n - 0.3).max() < 0.12


def test_mix_and_odd_rows(odd, empty):
    rows = run(odd)
    assert len(rows) == odd.count() and all(r["taken"] == 0 for r in rows if r["size"] == 0)
    mixed = mixing.mix(odd)
    assert mixed.columns == odd.columns
    assert mixed.count() == sum(r["copies"] for r in rows)
    assert run(empty) == [] and mixing.mix(empty).collect() == []


def test_large_ids_beside_null_ids(spark):
    ids = [2 ** 60 + 1, 2 ** 60 + 3, None, 7]
    df = spark.createDataFrame([(i, "some words here", "s") for i in ids], "doc_id long, text string, source string")
    assert sorted(r["doc_id"] or 0 for r in run(df)) == sorted(i or 0 for i in ids)
