import numpy as np
import pytest
import xxhash

from pagesig.llm import simhash
from pagesig.llm.components import components


def brute(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    count = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            count[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * count[b] > len(shingles))


def groups(fps, bits):
    left, out = set(fps), []
    while left:
        todo = [left.pop()]
        own = set(todo)
        while todo:
            x = todo.pop()
            near = {y for y in left if (x ^ y).bit_count() <= bits}
            left -= near
            own |= near
            todo += near
        out.append(frozenset(own))
    return set(out)


def test_fingerprints_and_components(docs, odd):
    for table in (docs, odd):
        rows = [(r["doc_id"], r["text"]) for r in table.collect()]
        fps = {brute(t) for _, t in rows}
        first = {}
        for own in groups(fps, 4):
            ids = [i for i, t in rows if i is not None and brute(t) in own]
            first.update(dict.fromkeys(own, min(ids) if ids else None))
        want = sorted((str(i), f"{brute(t):016x}", first[brute(t)]) for i, t in rows)
        got = sorted((str(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(table).collect())
        assert got == want


def clustered(rng, n):
    centres = rng.integers(0, 1 << 63, 20, dtype=np.uint64)
    out = set(rng.integers(0, 1 << 63, n, dtype=np.uint64).tolist())
    for c in centres.tolist():
        for _ in range(30):
            for b in rng.choice(64, rng.integers(1, 6), replace=False).tolist():
                c ^= 1 << b
            out.add(c)
    return sorted(out)


@pytest.mark.parametrize("segments,shard_max,bits", [(5, 20_000, 4), (2, 20_000, 4), (3, 100, 3), (5, 40, 4)])
def test_links_are_exact_for_any_segments_and_split_shards(spark, segments, shard_max, bits):
    fps = clustered(np.random.default_rng(segments + bits), 800)
    df = spark.createDataFrame([(np.uint64(f).astype(np.int64).item(),) for f in fps], "fp long")
    edges = simhash.links(df, bits, segments, sample=500, shard_max=shard_max)
    rooted = {r["node"]: r["root"] for r in components(edges).collect()}
    got = {}
    for f in fps:
        s = np.uint64(f).astype(np.int64).item()
        got.setdefault(rooted.get(s, s), set()).add(f)
    assert {frozenset(g) for g in got.values()} == groups(fps, bits)


def test_triangle_bound_routes_neighbours_into_home_shards():
    rng = np.random.default_rng(0)
    points = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
    for mask, share in simhash.shares(4, 2):
        tree = simhash.grow(points[:300], mask, 8)
        home_at, home = simhash.route(points, tree, mask, 0)
        assert len(home_at) == len(points)
        at, shard = simhash.route(points, tree, mask, share)
        visits = set(zip(at.tolist(), shard.tolist()))
        own = dict(zip(home_at.tolist(), home.tolist()))
        close = np.bitwise_count((points[:, None] ^ points[None, :]) & np.uint64(mask)) <= share
        assert all((int(j), own[int(i)]) in visits for i, j in np.argwhere(close))


def test_components_of_long_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(200)]
    star = [(1000, i) for i in range(1001, 1400)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain + star + [(5, 5)], "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(201), 0), **dict.fromkeys(range(1000, 1400), 1000)}


def test_keep_one(odd, empty):
    kept = sorted((str(r["doc_id"]), r["text"] or "") for r in simhash.keep_one(odd).collect())
    ids = [k[0] for k in kept]
    assert "6" not in ids and ids.count("7") == 1 and ids.count("None") == 2 and {"1", "5", "8", "9", "10"} <= set(ids)
    assert {"2", "3", "4"} & set(ids) == {"2"}  # all wordless
    assert simhash.keep_one(odd).columns == odd.columns
    assert simhash.keep_one(empty).collect() == [] and simhash.near_duplicates(empty).collect() == []
