import numpy as np

from pagesig.llm import ann


def brute(rows, k, mod):
    out = {}
    for q, x in rows:
        if q % mod == 0:
            near = sorted((-float((np.array(v, float) * np.array(x, float)).sum()), i) for i, v in rows if i != q and len(v) == len(x))
            out[q] = [(i, -s) for s, i in near[:k]]
    return out


def found(df, **more):
    out = {}
    for r in sorted(ann.search(df, **more).collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_recall_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 60)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 10)
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    want, got = brute(rows, 20, 20), found(df)
    assert set(want) == set(got)
    share = [len({i for i, _ in want[q]} & {i for i, _ in got[q]}) / len(want[q]) for q in want]
    assert np.mean(share) >= 0.9
    score = {(q, i): s for q in want for i, s in want[q]}
    assert all(abs(score[q, i] - s) < 1e-12 for q in got for i, s in got[q] if (q, i) in score)


def test_copies_of_a_query_are_dealt_over_all_blocks(spark):
    df = ann.usable(spark.createDataFrame([(20 * i, [1.0, 2.0]) for i in range(800)], "vec_id long, embedding array<double>"))
    sizes = [r["count"] for r in df.groupBy(ann.query_block(8)).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 200


def test_ties_and_unusable_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 2.0, 2.0]) for i in range(40)] + [(41, None), (42, []), (43, [0.0, 0.0, 0.0]), (44, [1.0, None, 1.0]),
            (45, [nan, 1.0, 1.0]), (46, [inf, 1.0, 1.0]), (60, [0.0, 0.0, 0.0]), (80, [1.0, 1.0]), (81, [3.0, 4.0]), (None, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows + rows[:3], "vec_id long, embedding array<double>")
    got = found(df)
    assert set(got) == {0, 20, 80}
    assert got[0] == [(i, 9.0) for i in range(1, 21)] and got[20] == [(i, 9.0) for i in range(20)]
    assert got[80] == [(81, 7.0)]
    assert found(df.limit(0)) == {}
