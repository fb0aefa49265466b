"""Nearest neighbours by inner product with randomly rotated one-bit codes.

Index: every vector, less the centroid of all, is turned by a fixed random rotation and kept as
the sign bits of its direction, with two correction scalars: its distance from the centroid and
the inner product of its direction with its own code. From these a query's inner product with
the vector is estimated without bias, with an error that exceeds `EPSILON` times a known scale
only rarely. In a block, a vector whose upper bound is below the query's k-th largest lower
bound is dropped; the rest are reranked with the original vectors in double precision. The best
k of every block meet in one top-k per query.

Plan: the index is dealt into blocks of about `BLOCK` vectors and the stated query set into
blocks of `QUERY_BLOCK`; each pair of blocks is one task's work, so neither a task nor the driver
holds more than two blocks, however many vectors, queries or copies of a vector there are.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no
part, neither do rows without vec_id; vectors meet only vectors of their own dimension; a row
repeated with the same vec_id and vector counts once; ties go to the smaller vec_id; with fewer
than k candidates all are returned; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagesig.llm.common import small_batches, stored

K = 20
QUERY_MOD = 20
BLOCK = 4096
QUERY_BLOCK = 8192
EPSILON = 3.5
SEED = 11


def rotation(dim: int) -> np.ndarray:
    """A fixed random rotation (orthogonal factor of a Gaussian matrix)."""
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64(SEED)).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, dim, vec): the vectors that take part, as packed doubles."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, dims, packed = [], [], []
            for vec_id, vec in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if vec_id is None or not vec or None in vec:
                    continue
                vec = np.array(vec, float)
                if np.isfinite(vec).all() and vec.any():
                    ids.append(vec_id)
                    dims.append(len(vec))
                    packed.append(vec.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(packed, pa.binary())],
                                             names=["vec_id", "dim", "vec"])

    small_batches(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    return rows.mapInArrow(pack, "vec_id long, dim int, vec binary").dropDuplicates()


def centroids(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Mean vector per dimension, from all vectors; one row per task and dimension is added up."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for dim, vec in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = sums.setdefault(dim, [0, np.zeros(dim)])
                own[0] += 1
                own[1] += np.frombuffer(vec)
        yield pa.RecordBatch.from_pydict({
            "dim": pa.array(list(sums), pa.int32()), "n": pa.array([s[0] for s in sums.values()], pa.int64()),
            "total": pa.array([s[1].tolist() for s in sums.values()], pa.list_(pa.float64()))})

    parts = vectors.select("dim", "vec").mapInArrow(add, "dim int, n long, total array<double>")
    means = parts.select("dim", "n", F.posexplode("total").alias("at", "x")).groupBy("dim", "at").agg(
        (F.sum("x") / F.sum("n")).alias("mean")).collect()  # one row per coordinate
    out = {d: np.zeros(d) for d in {r["dim"] for r in means}}
    for r in means:
        out[r["dim"]][r["at"]] = r["mean"]
    return out


def index(vectors: DataFrame, centres: dict[int, np.ndarray], blocks: int) -> DataFrame:
    """(vec_id, dim, block, vec, bits, norm, own): the code and its scalars for every vector."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns = {d: rotation(d) for d in centres}
        for batch in batches:
            dims = batch.column(1).to_pylist()
            bits, norm, own = [], [], []
            for dim, vec in zip(dims, batch.column(2).to_pylist()):
                turned = (np.frombuffer(vec) - centres[dim]) @ turns[dim]
                size = float(np.linalg.norm(turned))
                bits.append(np.packbits(turned > 0).tobytes())
                norm.append(size)
                own.append(float(np.abs(turned).sum() / (size * np.sqrt(dim))) if size else 1.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bits, pa.binary()), pa.array(norm, pa.float64()),
                                              pa.array(own, pa.float64())],
                                             names=["vec_id", "dim", "vec", "block", "bits", "norm", "own"])

    return vectors.withColumn("block", F.pmod(F.xxhash64("vec_id", "vec"), F.lit(blocks)).cast("int")).mapInArrow(
        encode, "vec_id long, dim int, vec binary, block int, bits binary, norm double, own double")


def block_search(queries: np.ndarray, query_ids: np.ndarray, ids: np.ndarray, vecs: np.ndarray, bits: np.ndarray,
                 norm: np.ndarray, own: np.ndarray, centre: np.ndarray, k: int, epsilon: float):
    """(query_id, vec_id, score) of the best k of one block for each query."""
    dim = vecs.shape[1]
    signs = (np.unpackbits(bits, axis=1, count=dim).astype(np.float32) * 2 - 1) / np.float32(np.sqrt(dim))
    turned = (queries @ rotation(dim)).astype(np.float32)
    shift = queries @ centre
    length = np.linalg.norm(queries, axis=1)
    scale = norm / own
    slack = norm * np.sqrt(np.maximum(0, 1 - own ** 2)) / own * epsilon / np.sqrt(max(1, dim - 1)) + 1e-9
    for q in range(len(queries)):
        estimate = (signs @ turned[q]) * scale + shift[q]
        error = slack * length[q] + 1e-6 * np.abs(estimate)
        lower = np.where(ids == query_ids[q], -np.inf, estimate - error)
        bound = np.partition(lower, -k)[-k] if len(lower) > k else -np.inf
        near = np.flatnonzero((estimate + error >= bound) & (ids != query_ids[q]))
        score = (vecs[near] * queries[q]).sum(axis=1)
        best = np.lexsort((ids[near], -score))[:k]
        yield query_ids[q], ids[near[best]], score[best]


def query_block(blocks: int) -> Column:
    """The block of a query: by its id too, so that copies of a vector are dealt over all blocks."""
    return F.pmod(F.xxhash64("vec_id", "vec"), F.lit(blocks)).cast("int")


def search(vectors: DataFrame, k: int = K, query_mod: int = QUERY_MOD, epsilon: float = EPSILON) -> DataFrame:
    """(query_id, rank, vec_id, score) for every row whose vec_id is divisible by `query_mod`."""
    vectors = stored(usable(vectors), "vectors")
    total = vectors.count()
    is_query = F.col("vec_id") % query_mod == 0
    asked = vectors.filter(is_query).count()
    blocks, query_blocks = max(1, -(-total // BLOCK)), max(1, -(-asked // QUERY_BLOCK))
    centres = centroids(vectors)
    codes = stored(index(vectors, centres, blocks), "codes")
    codes = codes.withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    queries = vectors.filter(is_query).select(
        "vec_id", "vec", "dim", query_block(query_blocks).alias("query_block"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))

    def pair(block: pa.Table, ask: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], []]
        if len(block) and len(ask):
            dim = block.column("dim")[0].as_py()

            def rows(table: pa.Table, name: str, kind, width: int) -> np.ndarray:
                return np.frombuffer(b"".join(table.column(name).to_pylist()), kind).reshape(-1, width)

            own = {c: block.column(c).to_numpy() for c in ("vec_id", "norm", "own")}
            for query_id, ids, score in block_search(
                    rows(ask, "vec", np.float64, dim), ask.column("vec_id").to_numpy(), own["vec_id"],
                    rows(block, "vec", np.float64, dim), rows(block, "bits", np.uint8, -(-dim // 8)), own["norm"],
                    own["own"], centres[dim], k, epsilon):
                for c, x in zip(out, (np.full(len(ids), query_id), ids, score)):
                    c.append(x)
        names = (("query_id", np.int64), ("vec_id", np.int64), ("score", np.float64))
        return pa.table({n: np.concatenate([np.zeros(0, t), *c]).astype(t) for (n, t), c in zip(names, out)})

    keys = ["block", "query_block", "dim"]
    found = codes.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(pair, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
