"""SimHash near-duplicates through vantage-point trees.

Fingerprint: 64-bit SimHash over the XXH64 values of the word shingles. Linking: two
fingerprints that differ in at most `max_bits` bits.

Search: the fingerprint's bits are dealt into segments; the Hamming distance within a segment
is a pseudo-metric, and if the whole distance is at most `max_bits`, some segment's distance is
at most that segment's share of it (the shares plus one add up to max_bits + 1). For each segment a vantage-point tree partitions the
fingerprints by their distance to vantage points. A fingerprint lives in one shard of the tree
and is also sent to every shard across a boundary that lies within the segment's share of it
(triangle bound; with a share of 0 no boundary is crossed). Shards are then queried for exact
pairs over all 64 bits. One tree over all 64 bits is no use: distances to any vantage point
gather around 32, and a radius of 4 keeps 84 % of the pairs at every level.

The trees are built from a bounded sample (`SAMPLE` fingerprints), which shapes the shards only;
every fingerprint is routed and every link is found. Shards over `SHARD_MAX` fingerprints are
split into blocks that are paired with one another, so a hot group is spread over many tasks.
In a shard, connected fingerprints are given as a star (one edge per member), never as all
pairs; copies collapse into one fingerprint before the search.

Defined cases: a null or wordless text has fingerprint zero and is linked like any other;
repeated rows and ties share a component; rows whose doc_id is null get the component of their
fingerprint (null if no document of it has an id); an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesig.llm.common import doc_columns, stored, whole_rows
from pagesig.llm.components import components

SHINGLE_WORDS = 4
MAX_BITS = 4
HASH_SEED = 42
SAMPLE = 32_768
LEAF = 8
SHARD_MAX = 20_000
BUCKET_ROWS = 40_000
CHUNK = 1 << 16

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: str | None, words_per_shingle: int) -> int:
    """Unsigned SimHash of one text: a bit is 1 if set in over half the shingle hashes."""
    import xxhash
    words = (text or "").encode("utf-8").lower().split()  # splits at ASCII white space
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(sizes + 1) - sizes - 1
    ends = starts + sizes
    span = min(words_per_shingle, len(words))
    starts, ends = starts[:len(words) - span + 1], ends[span - 1:]
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), CHUNK):
        hashes = np.array([digest(joined[s:e], HASH_SEED) for s, e in
                           zip(starts[at:at + CHUNK].tolist(), ends[at:at + CHUNK].tolist())], dtype=">u8")
        octets = hashes.view(np.uint8).reshape(-1, 8)
        for k in range(8):
            ones[8 * k:8 * k + 8] += np.bincount(octets[:, k], minlength=256) @ _BITS
    return int.from_bytes(np.packbits(2 * ones > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame, words_per_shingle: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp): the fingerprint's bits as a signed long."""
    @F.pandas_udf("long")
    def simhash(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, words_per_shingle) for t in texts], np.uint64).astype(np.int64))

    return doc_columns(docs, "doc_id", "text").select("doc_id", simhash("text").alias("fp"))


def shares(max_bits: int, segments: int) -> list[tuple[int, int]]:
    """(mask, share) per segment that must be searched."""
    edges = [64 * i // segments for i in range(segments + 1)]
    quota = [(max_bits + 1) // segments + (i < (max_bits + 1) % segments) for i in range(segments)]
    return [(((1 << (b - a)) - 1) << a, q - 1) for a, b, q in zip(edges, edges[1:], quota) if q]


def grow(points: np.ndarray, mask: int, leaf: int) -> list[tuple[int, int, int, int]]:
    """Vantage-point tree over the masked distance: (vantage, radius, inside, outside) per node;
    a child below 0 is shard ~child."""
    nodes: list = []
    shards = 0

    def split(own: np.ndarray) -> int:
        nonlocal shards
        if len(own) > leaf:
            best = None
            for vantage in own[:: max(1, len(own) // 4)][:4]:
                d = np.bitwise_count((own ^ vantage) & np.uint64(mask)).astype(np.int64)
                for radius in (int(np.median(d)), int(np.median(d)) - 1):
                    inside = d <= radius
                    even = min(int(inside.sum()), len(own) - int(inside.sum()))
                    if even and (best is None or even > best[0]):
                        best = (even, int(vantage), radius, inside)
            if best:
                at = len(nodes)
                nodes.append(None)
                _, vantage, radius, inside = best
                nodes[at] = (vantage, radius, split(own[inside]), split(own[~inside]))
                return at
        shards += 1
        return ~(shards - 1)

    split(points)
    return nodes


def route(fps: np.ndarray, tree: list[tuple[int, int, int, int]], mask: int, share: int) -> tuple[np.ndarray, np.ndarray]:
    """(index, shard) of every shard that each fingerprint lives in or borders on."""
    if not tree:
        return np.arange(len(fps)), np.zeros(len(fps), np.int64)
    vantage = np.array([t[0] for t in tree], np.uint64)
    radius, inside, outside = (np.array([t[k] for t in tree], np.int64) for k in (1, 2, 3))
    at, node = np.arange(len(fps)), np.zeros(len(fps), np.int64)
    found = []
    while len(at):
        d = np.bitwise_count((fps[at] ^ vantage[node]) & np.uint64(mask)).astype(np.int64)
        left, right = d <= radius[node] + share, d > radius[node] - share
        nxt = np.concatenate([inside[node[left]], outside[node[right]]])
        at = np.concatenate([at[left], at[right]])
        done = nxt < 0
        found.append((at[done], ~nxt[done]))
        at, node = at[~done], nxt[~done]
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def stars(points: np.ndarray, max_bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """(centre, members) of each connected group of two or more points.

    Members leave the open set when first reached, so a dense group costs one pass."""
    if len(points) <= 512:
        near = np.bitwise_count(points[:, None] ^ points[None, :]) <= max_bits
        linked = near.sum(axis=1) > 1
        if not linked.any():
            return
        points = points[linked]
    rest = points
    while len(rest):
        centre, rest = rest[0], rest[1:]
        group, todo = [], [centre]
        while todo and len(rest):
            near = np.bitwise_count(rest ^ todo.pop()) <= max_bits
            if near.any():
                new, rest = rest[near], rest[~near]
                group.append(new)
                todo.extend(new)
        if group:
            yield int(centre), np.concatenate(group)


def links(fps: DataFrame, max_bits: int = MAX_BITS, segments: int | None = None, sample: int = SAMPLE,
          shard_max: int = SHARD_MAX) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp, a stored table) that connect exactly
    those within `max_bits` bits of each other."""
    n = fps.count()
    picked = [r["fp"] for r in fps.orderBy(F.xxhash64("fp"), "fp").limit(sample).collect()]
    points = np.array(picked, np.int64).astype(np.uint64)
    trees = [(grow(points, mask, LEAF), mask, share) for mask, share in shares(max_bits, segments or max_bits + 1)]
    buckets = max(1, n * len(trees) // BUCKET_ROWS)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy().astype(np.uint64)
            for t, (tree, mask, share) in enumerate(trees):
                at, shard = route(own, tree, mask, share)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), t, np.int32)), pa.array(shard), pa.array(own[at].astype(np.int64))],
                    names=["tree", "shard", "fp"])

    dealt = fps.select("fp").mapInArrow(deal, "tree int, shard long, fp long")
    # a shard over shard_max: blocks of it, each paired with itself and every other block
    large = (dealt.groupBy("tree", "shard").agg(F.count("*").alias("rows")).filter(F.col("rows") > shard_max)
             .select("tree", "shard", F.ceil(F.col("rows") / shard_max).cast("int").alias("blocks")))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    dealt = (dealt.join(large, ["tree", "shard"], "left")
             .withColumn("own", F.coalesce(own, F.lit(0)))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("blocks"), F.lit(1)) - 1)))
             .select("tree", "shard", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp"))
    dealt = dealt.withColumn("bucket", F.pmod(F.xxhash64("tree", "shard", "i", "j"), F.lit(buckets)))

    def query(table: pa.Table) -> pa.Table:
        cell = [table.column(c).to_numpy() for c in ("j", "i", "shard", "tree")]
        order = np.lexsort(cell)
        fp = table.column("fp").to_numpy().astype(np.uint64)[order]
        change = np.zeros(len(order), bool)
        for c in cell:
            c = c[order]
            change[1:] |= c[1:] != c[:-1]
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        edges = [0, *np.flatnonzero(change).tolist(), len(fp)]
        for s, e in zip(edges, edges[1:]):
            if e - s > 1:
                for centre, members in stars(fp[s:e], max_bits):
                    b.append(members.astype(np.int64))
                    a.append(np.full(len(members), centre, np.uint64).astype(np.int64))
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    return dealt.groupBy("bucket").applyInArrow(query, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, words_per_shingle: int = SHINGLE_WORDS, max_bits: int = MAX_BITS,
                    segments: int | None = None) -> DataFrame:
    """(doc_id, fingerprint, component_id) per document."""
    marked = stored(fingerprints(docs, words_per_shingle), "fingerprints")
    nodes = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    roots = components(links(nodes.select("fp"), max_bits, segments))
    # stored, like the aggregate of it, so that the join's sides come straight from an exchange and a
    # component of any size can be split
    rooted = stored(nodes.join(roots, nodes.fp == roots.node, "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")), "rooted")
    smallest = stored(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "smallest")
    named = stored(rooted.join(smallest, "root").select("fp", "component_id"), "named")
    return marked.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, words_per_shingle: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of `docs` without near-duplicates: of each component, the document with the
    smallest id stays (one row per different text under that id); rows without an id stay."""
    found = near_duplicates(docs, words_per_shingle, max_bits)
    gone = found.filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("id")).distinct()
    left = whole_rows(docs).join(gone, "id", "left_anti")
    # of repeated rows (same id, same text) one stays: only ids that do repeat are dealt with
    twice = left.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1 and id is not null").select("id")
    again = left.join(twice, "id", "left_semi").withColumn("digest", F.md5(F.col("row.text").cast("binary")))
    once = left.join(twice, "id", "left_anti").select("row")
    return once.union(again.dropDuplicates(["id", "digest"]).select("row")).select("row.*")
