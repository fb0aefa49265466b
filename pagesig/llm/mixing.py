"""Mixing sources to target weights by pivotal dependent rounding.

Every document gets a number of copies whose expectation is its source's target over the
source's size; only the fractional part is random. Documents of a source fight in pairs: words
move from one to the other, in a random direction chosen so that both expectations stand, until
the number of copies of one of them is whole; the other carries on. Words are what moves, so
the words taken from a source never change. Long documents fight first, and the one left over at
the end is among the short; its words go, as nearly as whole documents can, to others of the last
block (a source's taken words miss the target by no more than that).

The fights run as a reduction tree: documents are dealt into blocks of a source by a hash of
their id, each block leaves one document, the documents left by `FAN_IN` blocks meet in the
next level, and so on until one is left per source. A hot source is only more blocks. All
random numbers are hashes of ids, so reruns agree.

Targets: sources, sorted by code point with null last, weigh 1, 2, 3, repeating; they share all
words by weight, no target exceeds `MAX_COPIES` times its source's size, and the excess goes to
the other sources by weight until none is above. That is the level L at which the targets
min(cap, weight * L) add up to the total, found from distributed running totals.

Defined cases: a null text has size 0; documents of size 0 are never taken (no words); a null
source is a source of its own; repeated rows are rounded each for itself; an empty table gives
no rows; other columns are ignored (kept by `mix`).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagesig.llm.common import WORD, doc_columns, running, stored, whole_rows

WEIGHTS = (1, 2, 3)
MAX_COPIES = 3
BLOCK = 1024
FAN_IN = 256
TINY = 1e-9


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0,
                   most: int = MAX_COPIES) -> DataFrame:
    """(key, source, docs, source_size, target) per source of a table with source and size; key
    numbers the sources."""
    sources = sized.groupBy("source").agg(F.count("*").alias("docs"), F.sum("size").alias("source_size"))
    numbered = running(sources, [F.col("source").isNull(), F.col("source")], {"key": F.lit(1)})
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("key") % len(weights) + 1).cast("int"))
    numbered = numbered.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    ordered = running(numbered, [F.col("cap") / F.col("weight"), F.col("key")],
                      {"cap_before": F.col("cap"), "weight_before": F.col("weight")})
    ordered = stored(ordered, "levels")
    total = ordered.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    words, weigh = (total["size"] or 0) * share, total["weight"] or 0
    # the level if all sources before this one are at their cap: the first source whose own cap
    # is not below it sets the level
    level = (F.lit(words) - F.col("cap_before")) / (F.lit(weigh) - F.col("weight_before"))
    found = ordered.select((F.col("cap") / F.col("weight")).alias("own"), level.alias("level")).filter(
        "own >= level").agg(F.min_by("level", "own")).first()[0]
    target = F.col("cap").cast("double") if found is None else F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(found))
    return ordered.select("key", "source", "docs", "source_size", target.alias("target"))


def uniform(a: int, b: int, level: int) -> float:
    """A number in [0, 1) from two hashes."""
    x = (a * 0x9E3779B97F4A7C15 ^ (b + level) * 0xC2B2AE3D27D4EB4F) & 0xFFFFFFFFFFFFFFFF
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = ((x ^ x >> shift) * factor) & 0xFFFFFFFFFFFFFFFF
    return ((x ^ x >> 31) >> 11) / (1 << 53)


def fights(size: np.ndarray, part: np.ndarray, seed: np.ndarray, level: int) -> tuple[np.ndarray, int]:
    """Rounds fractional parts (already in fighting order) until at most one is left fractional:
    the new parts, and the index of the one left (-1 if none)."""
    part, size, seed = part.tolist(), size.tolist(), seed.tolist()
    held = -1
    for j, p in enumerate(part):
        if not TINY < p < 1 - TINY:
            part[j] = float(round(p))
            continue
        if held < 0:
            held = j
            continue
        a, b, q = size[held], size[j], part[held]
        up, down = min((1 - q) * a, p * b), min(q * a, (1 - p) * b)  # words that could move to, from the held one
        moved = up if uniform(seed[held], seed[j], level) * (up + down) < down else -down
        part[held], part[j] = q + moved / a, p - moved / b
        for k in (held, j):
            if not TINY < part[k] < 1 - TINY:
                part[k] = float(round(part[k]))
        held = held if 0 < part[held] < 1 else j if 0 < part[j] < 1 else -1
    return np.array(part), held


def settle_last(size: np.ndarray, part: np.ndarray, held: int, moves: int = 20) -> np.ndarray:
    """The source's last fractional document is left out, and its words go, as nearly as whole
    documents can, to the others here: the best single document to take, to give up, or to
    exchange for one another, as long as that comes nearer."""
    words = part[held] * size[held]
    part[held] = 0.0
    for _ in range(moves):
        free, taken = np.append(-1, np.flatnonzero(part == 0)), np.append(-1, np.flatnonzero(part == 1))
        gains, costs = np.where(free < 0, 0, size[free]), np.where(taken < 0, 0, size[taken])
        order = np.argsort(gains, kind="stable")
        free, gains = free[order], gains[order]
        at = np.searchsorted(gains, words + costs)
        take = np.concatenate([np.clip(at - 1, 0, len(free) - 1), np.clip(at, 0, len(free) - 1)])
        give = np.tile(np.arange(len(taken)), 2)
        left = words - (gains[take] - costs[give])
        best = int(np.argmin(np.abs(left)))
        if abs(left[best]) >= abs(words):
            break
        words = left[best]
        for k, value in ((free[take[best]], 1.0), (taken[give[best]], 0.0)):
            if k >= 0:
                part[k] = value
    return part


def block_fights(level: int, names: list[str]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The function that settles one block, longest documents first."""
    def settle(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "seed"], ascending=[False, True], ignore_index=True)
        left = np.zeros(len(rows), bool)
        if rows["size"].iloc[0] > 0:
            rows["part"], held = fights(rows["size"].to_numpy(), rows["part"].to_numpy(),
                                        rows["seed"].to_numpy().astype(np.uint64), level)
            if held >= 0 and -(-int(rows["docs"].iloc[0]) // BLOCK) <= FAN_IN ** level:
                rows["part"] = settle_last(rows["size"].to_numpy(), rows["part"].to_numpy().copy(), held)
            elif held >= 0:
                left[held] = True
        else:
            rows["part"] = 0.0
        return rows.assign(left=left)[names]
    return settle


def copies(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0,
           most: int = MAX_COPIES) -> DataFrame:
    """(doc_id, source, text_hash, size, source_size, target, copies) per document."""
    sized = stored(doc_columns(docs, "doc_id", "source", "text").select(
        "doc_id", "source", F.xxhash64("text").alias("text_hash"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")), "sizes")
    sources = stored(source_targets(sized, weights, share, most), "targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    units = (sized.join(sources, sized["source"].eqNullSafe(sources["source"])).drop(sources["source"])
             .withColumn("rate", F.least(rate, F.lit(float(most))))
             .withColumn("whole", F.floor(F.col("rate") + TINY).cast("int"))
             .withColumn("part", F.greatest(F.col("rate") - F.col("whole"), F.lit(0.0)))
             .withColumn("seed", F.xxhash64("key", "doc_id", "size", "text_hash"))
             .withColumn("doc_id", F.col("doc_id").cast("string")))  # pandas would turn longs with nulls into floats
    largest = sources.agg(F.max("docs")).first()[0] or 0
    block = F.pmod("seed", F.greatest(F.lit(1), F.ceil(F.col("docs") / BLOCK)))
    open_, closed, level = units.withColumn("block", F.when(F.col("size") > 0, block).otherwise(-1 - block)), [], 0
    blocks = -(-largest // BLOCK)
    while True:
        schema = T.StructType([*open_.schema.fields, T.StructField("left", T.BooleanType())])
        done = stored(open_.groupBy("key", "block").applyInPandas(block_fights(level, schema.fieldNames()), schema), f"fights{level}")
        closed.append(done.filter(~F.col("left")))
        open_ = done.filter("left").drop("left").withColumn("block", F.floor(F.col("block") / FAN_IN))
        if blocks <= 1:
            break
        blocks, level = -(-blocks // FAN_IN), level + 1
    out = closed[0]
    for more in closed[1:]:
        out = out.unionByName(more)
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text_hash", "size", "source_size", "target",
                      F.when(F.col("size") > 0, F.col("whole") + F.round("part").cast("int")).otherwise(0).alias("copies"))


def mixture(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) per document."""
    return copies(docs).drop("text_hash").withColumn("taken", F.col("size") * F.col("copies"))


def mix(docs: DataFrame) -> DataFrame:
    """The mixture itself: each row of `docs` as often as it is taken, all columns. Rows repeated
    with the same id, source and text are taken as copies of one of them."""
    chosen = copies(docs).groupBy("doc_id", "source", "text_hash").agg(
        F.sum("copies").cast("int").alias("copies"), F.count("*").alias("twins")).filter("copies > 0")
    rows = whole_rows(docs, origin=F.col("source").cast("string"), digest=F.xxhash64(F.col("text").cast("string")))
    joined = rows.join(chosen, rows["id"].eqNullSafe(chosen["doc_id"]) & rows["origin"].eqNullSafe(chosen["source"])
                       & (rows["digest"] == chosen["text_hash"]))
    kept = joined.filter("twins = 1").select("row", "copies").union(
        joined.filter("twins > 1").dropDuplicates(["id", "origin", "digest"]).select("row", "copies"))
    return kept.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
