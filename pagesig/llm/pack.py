"""Best-fit packing of token pieces into sequences of bounded length.

Method: bulk-synchronous best-fit. Rounds go through the pieces from long to short; in a round
every piece of one length is matched with the smallest open gap that holds it (its successor
among the sorted gaps), ties between pieces for a gap are settled by the pieces' rank, gaps are
updated, and the next round starts. Pieces of one length are interchangeable, and so are
sequences with the same content by length, so a round's sweep works on classes: how many pieces
there are of each length (at most `capacity` rows, whatever the corpus) against how many
sequences have which gap. The plan of all rounds is therefore a small table of rank intervals
(bounded by the capacity, checked); pieces find their place in it by their distributed rank
within their length, so no task sees more than one block of one length.

Defined cases: a null text packs as an empty one (its end token only); repeated rows are packed
as often as they occur; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import json
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagesig.llm import textbytes as tb
from pagesig.llm.common import doc_columns, stored

CAPACITY = 1024
END_ID = 2
BLOCK_ROWS = 4096
SLICE_BYTES = 1 << 19  # of text worked on at a time
CACHE_WORDS = 250_000  # encoded words a worker keeps, as arrays (some 8 MB)
CACHE_BYTES = 64  # longer words are encoded anew in every slice
# white space outside ASCII: a text that has any is encoded in one go, not by segments
_WIDE_SPACE = "".join(map(chr, [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))

_encoders: dict[tuple, "WordEncoder"] = {}


def vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def added_tokens(path: str | None = None) -> dict[str, int]:
    """Ids of the tokens that the tokenizers file of the same vocabulary adds to it: they are taken
    out of a text, wherever they stand, before the rest is encoded."""
    import public_tokenizers
    with open(path or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        added = json.load(f).get("added_tokens", [])
    odd = [t["content"] for t in added if t["single_word"] or t["lstrip"] or t["rstrip"]]
    if odd:
        raise ValueError(f"tokens that depend on what stands beside them are not supported: {odd}")
    return {t["content"]: t["id"] for t in added}


class WordEncoder:
    """Byte-level BPE ids of texts, a distinct word at a time.

    The split pattern never joins a non-space with a space after it, so a text's ids are the
    ids of its segments (spaces plus the word after them) in a row; each distinct segment of a
    slice is encoded once and known ones come from a bounded cache, arrays and no Python objects. The file holds the same
    vocabulary as the tokenizers library's JSON file (a test holds the ids against it). Texts with
    added tokens are split there first, texts with white space outside ASCII are encoded in one go."""

    def __init__(self, path: str, added: dict[str, int]):
        import public_tokenizers
        import tiktoken
        self.added = added
        longest = sorted(added, key=len, reverse=True)
        self.split = re.compile("(" + "|".join(map(re.escape, longest)) + ")").split if added else None
        self.marks = [t.encode("utf-8") for t in longest]
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("corpus", pat_str=public_tokenizers.PATTERN,
                                        mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # hashes of the known segments, sorted
        self.place = np.zeros((0, 2), np.int32)  # of each, where its ids begin in the pool, and how many
        self.pool = np.zeros(0, np.uint32)

    def segment_ids(self, data: bytes, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids in a row, and (begin, number) of each segment; keys are their hashes, sorted and distinct."""
        if len(self.keys) > CACHE_WORDS:
            self.forget()
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        new = np.flatnonzero(~known)
        ids = [self.encode(data[a:b].decode("utf-8")) for a, b in zip(starts[new].tolist(), ends[new].tolist())]
        number = np.fromiter(map(len, ids), np.int64, len(ids))
        begin = len(self.pool) + np.cumsum(number) - number
        where = np.empty((len(keys), 2), np.int64)
        where[known] = self.place[at[known]]
        where[new, 0], where[new, 1] = begin, number
        fresh = np.fromiter(chain.from_iterable(ids), np.uint32, int(number.sum()))
        pool = np.concatenate([self.pool, fresh])
        short = ends[new] - starts[new] <= CACHE_BYTES
        keep, kept = new[short], number[short]
        self.place = np.insert(self.place, at[keep], np.stack([len(self.pool) + np.cumsum(kept) - kept, kept], axis=1), axis=0)
        self.keys = np.insert(self.keys, at[keep], keys[keep])
        self.pool = pool if short.all() else np.concatenate([self.pool, fresh[np.repeat(short, number)]])
        return pool, where

    def slice_ids(self, raw: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
        """Ids of each text of a slice."""
        starts, ends, row = tb.segment_runs(raw, off)
        keys, first, back = np.unique(tb.run_hashes(raw, starts, ends), return_index=True, return_inverse=True)
        data = raw.tobytes()
        pool, where = self.segment_ids(data, keys, starts[first], ends[first])
        where = where[back]
        flat = tb.ragged(pool, where[:, 0], where[:, 1])
        ends_at = np.zeros(len(off) - 1, np.int64)
        np.add.at(ends_at, row, where[:, 1])
        ids = np.split(flat, np.cumsum(ends_at)[:-1]) if len(off) > 1 else []
        wide, marked = raw.max(initial=0) >= 0xC2, any(m in data for m in self.marks)
        if wide or marked:
            for k in range(len(ids)):
                text = data[off[k]:off[k + 1]].decode("utf-8")
                if (marked and any(t in text for t in self.added)) or (not text.isascii() and any(c in text for c in _WIDE_SPACE)):
                    ids[k] = np.array(self.whole(text), np.uint32)
        return ids

    def whole(self, text: str) -> list[int]:
        """Ids of a text that is not encoded by segments."""
        parts = self.split(text) if self.split else [text]
        return [i for p in parts for i in ([self.added[p]] if p in self.added else self.encode(p))]


def encoder(path: str, added: dict[str, int]) -> WordEncoder:
    key = (path, *sorted(added.items()))
    if key not in _encoders:
        _encoders[key] = WordEncoder(path, added)
    return _encoders[key]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocab: str | None = None, end_id: int = END_ID,
           with_ids: bool = False, added: dict[str, int] | None = None) -> DataFrame:
    """Token pieces of every document: ids plus the end id, cut only where longer than
    `capacity`; the first piece takes the remainder, all others are full."""
    path, added = vocab or vocabulary(), added_tokens() if added is None else added

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, added)
        for batch in batches:
            doc_ids = batch.column(0)
            for i, j, raw, off in tb.text_slices(batch.column(1), SLICE_BYTES):
                rows, ids_out = [], []
                for k, ids in zip(range(i, j), enc.slice_ids(raw, off)):
                    data = np.append(ids, np.uint32(end_id)).astype("<u4")
                    first = len(data) % capacity or capacity
                    edges = [0, *range(first, len(data) + 1, capacity)]
                    for p, (a, b) in enumerate(zip(edges, edges[1:])):
                        part = data[a:b]
                        rows.append((k, p, a, b - a, zlib.crc32(part.tobytes())))
                        if with_ids:
                            ids_out.append(part.astype(np.int32))
                cols = np.array(rows, np.int64).reshape(-1, 5)
                out = [doc_ids.take(pa.array(cols[:, 0])), pa.array(cols[:, 1].astype(np.int32)),
                       *[pa.array(cols[:, c]) for c in (2, 3, 4)]]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    out, names = [*out, pa.array(ids_out, pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(out, names=names)

    return doc_columns(docs, "doc_id", "text").mapInArrow(cut, PIECES + (", ids array<int>" if with_ids else ""))


def sweep(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """The plan of all rounds: (length, first rank, number, first sequence, offset).

    Open sequences are classes (gap, first sequence id, how many); a round takes the pieces of
    one length, longest first, and fills the class with the smallest sufficient gap, then its
    successor, and so on; what is left opens new sequences."""
    gaps: list[tuple[int, int, int]] = []  # sorted by gap, then sequence
    plan, next_sequence = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect.bisect_left(gaps, (length, -1, -1))
            if at < len(gaps):
                gap, seq, number = gaps.pop(at)
                take = min(left, number)
                if take < number:
                    bisect.insort(gaps, (gap, seq + take, number - take))
            else:
                gap, seq = capacity, next_sequence
                # as many whole sequences as this length alone fills, one layer at a time
                take = -(-left // (capacity // length))
                next_sequence += take
            plan.append((length, rank, take, seq, capacity - gap))
            if gap > length:
                bisect.insort(gaps, (gap - length, seq, take))
            left, rank = left - take, rank + take
    return plan


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces (a stored table with doc_id, piece, length, and a number
    `_row` of its own per row, by which rows are dealt: ids may repeat or be null)."""
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}
    assert len(counts) <= capacity, "one row per length"
    plan = sorted(sweep(counts, capacity))
    blocks = F.get(F.lit([max(1, counts.get(n, 0) // BLOCK_ROWS) for n in range(capacity + 1)]), F.col("length").cast("int"))
    # rank within the length: count per (length, block), running totals of those, rank in the block
    parts = parts.withColumn("_block", F.pmod(F.xxhash64("_row"), blocks))
    sizes = parts.groupBy("length", "_block").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("length", "_block").orderBy("doc_id", "piece", "_row")
    ranked = (parts.join(sizes, ["length", "_block"])
              .withColumn("_rank", F.row_number().over(inside) - 1 + F.col("_before")).drop("_block", "_before"))
    length, rank, number, seq, offset = (np.array(c, np.int64) for c in zip(*plan)) if plan else [np.zeros(0, np.int64)] * 5
    base = int(rank.max(initial=0) + number.max(initial=0) + 1)
    key = length * base + rank

    @F.pandas_udf("struct<sequence_id: long, offset: long>")
    def place(lengths: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        at = np.searchsorted(key, lengths.to_numpy() * base + ranks.to_numpy(), side="right") - 1
        return pd.DataFrame({"sequence_id": seq[at] + (ranks.to_numpy() - rank[at]), "offset": offset[at]})

    return ranked.withColumn("_at", place("length", "_rank")).select(
        *[c for c in parts.columns if c != "_block"], F.col("_at.sequence_id").alias("sequence_id"),
        F.col("_at.offset").alias("offset"))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, vocab: str | None = None, end_id: int = END_ID,
                   with_ids: bool = False, added: dict[str, int] | None = None) -> DataFrame:
    """Tokenise, cut and pack; one row per piece. `added` are the added tokens of the vocabulary
    (none given: those of the public tokenizers file)."""
    parts = pieces(docs, capacity, vocab, end_id, with_ids, added).withColumn("_row", F.monotonically_increasing_id())
    return pack(stored(parts, "pieces"), capacity).drop("_row")
