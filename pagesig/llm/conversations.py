"""Repair of damaged conversations by depth-first branch-and-bound.

A conversation is sound if the initials of its roles read `(s?(ua)+)?`. Its rows may be kept,
get another role, be deleted, and empty turns may be inserted; the cheapest edits are wanted, among
equally cheap ones those whose audit (one initial per edit, in order) is least in ASCII order.
Blank rows and rows seen before must go; keeping a truncated row costs `TRUNCATED`.

Method: the edits of a segment of at most `SEGMENT` rows are searched depth first with an explicit
stack. A node is (rows edited, state), the state being what the output's last role allows next;
children are tried from the cheapest step on. A table per node holds the best prefix (cost, audit)
that reached it and drops worse ones: equally cheap prefixes of one node are never prefixes of each
other (they differ in cost, as only insertions add letters without rows), so their order is that of
the whole audits. A prefix is also dropped when its cost plus the least cost of the rows to come
cannot beat the incumbent of any state that it can end in. When the stack is empty, the incumbents
are proved: the best edits from the segment's first state to each last state.

A conversation of any length is a sequence of segments, searched in parallel for each first state;
what stays sequential is one pass over a conversation's segments in order, which keeps the best
edits and the running hash per state (at most four) and never holds more than one segment's texts.

Plan: equal rows are counted first; first occurrences of (role, text) come from an aggregate and a
join by conversation and content, both sides stored; segments from a range-partitioned running
total; then one exchange by segment and one by conversation.

Defined cases: null roles and texts are one space; null conv_ids are one conversation; rows are
taken by turn (nulls first), then role, then text; repeated rows stand beside each other;
conversations without rows after damage are sound; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesig.llm.common import running, small_batches, stored

SEGMENT = 64  # rows of one search
SEGMENT_ROW_BYTES = 1024  # a longer text counts as several rows
DAMAGES = 20
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
SPACE = r"\x20\x09-\x0D"
OPEN, SYSTEM, USER, ASSISTANT = range(4)  # states: no output yet, or the kind of its last role
NEXT = {OPEN: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
SOUND = (OPEN, ASSISTANT)
ENDS = {OPEN: (OPEN, SYSTEM, USER, ASSISTANT), SYSTEM: (SYSTEM, USER, ASSISTANT), USER: (USER, ASSISTANT), ASSISTANT: (USER, ASSISTANT)}
ROLES = {"u": "user", "a": "assistant"}
BLANK, DUPLICATE, CUT, FINE = range(4)


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role0, text0, role, text, copies): distinct rows, damaged by the CRC-32 of
    `conv_id:turn`; dropped rows have no copies."""
    def words(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                words("role").alias("role0"), words("text").alias("text0"))
    rows = rows.groupBy("conv_id", "turn", "role0", "text0").agg(F.count("*").alias("times"))
    damage = F.crc32(F.concat(words("conv_id"), F.lit(":"), words("turn")).cast("binary")) % DAMAGES
    text = (F.when(damage == 1, "").when(damage == 2, F.regexp_replace("text0", "[.!?]", "")).otherwise(F.col("text0")))
    return rows.select("conv_id", "turn", "role0", "text0", F.when(damage == 4, "user").otherwise(F.col("role0")).alias("role"),
                       text.alias("text"), (F.col("times") * F.when(damage == 0, 0).when(damage == 3, 2).otherwise(1)).alias("copies"))


def with_faults(rows: DataFrame) -> DataFrame:
    """Adds fault: of a row's copies the first has it, the others are duplicates (or blank)."""
    place = F.struct("turn", "role0", "text0")
    # stored before they are joined: both sides then come straight from an exchange, where Spark can
    # split a hot content
    rows = stored(rows.withColumn("content", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"),
                                                             F.col("text")).cast("binary"), 256)), "turns")
    first = rows.filter("copies > 0").groupBy(F.col("conv_id").alias("c"), F.col("content").alias("k")).agg(F.min(place).alias("first"))
    joined = rows.join(stored(first, "first-turns"), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("content") == F.col("k")), "left")
    fault = (F.when(~F.col("text").rlike(f"[^{SPACE}]"), BLANK).when(~place.eqNullSafe(F.col("first")), DUPLICATE)
             .when(~F.col("text").rlike(rf"[.!?][{SPACE}]*\z"), CUT).otherwise(FINE))
    return joined.withColumn("fault", fault).drop("c", "k", "first", "content")


def segments(rows: DataFrame) -> DataFrame:
    """(conv_id, segment, turns, inner): consecutive rows of a conversation, at most SEGMENT; inner says
    that rows of the conversation may stand before them. These are in the segment before, so the first
    row's running total then exceeds the segment's own first one by less than one row's units."""
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role0").asc(), F.col("text0").asc()]
    units = (1 + F.floor(F.octet_length("text") / SEGMENT_ROW_BYTES)).cast("long")
    ranked = running(rows, order, {"before": units})
    most = ranked.agg(F.max(units)).first()[0] or 1
    turns = F.sort_array(F.collect_list(F.struct("before", "turn", "role", "text", "fault", "copies")))  # at most SEGMENT
    return ranked.groupBy("conv_id", F.floor(F.col("before") / SEGMENT).cast("long").alias("segment")).agg(
        turns.alias("turns"), (F.min("before") % SEGMENT < most).alias("inner"))


def choices(initial: str, fault: int, state: int) -> list[tuple[int, str, int]]:
    """(cost, letter, next state) of the edits of one row, cheapest first."""
    if fault in (BLANK, DUPLICATE):
        return [(DELETE, "D", state)]
    extra = TRUNCATED if fault == CUT else 0
    out = [(DELETE, "D", state)]
    if initial in NEXT[state]:
        out.append((extra, "K", NEXT[state][initial]))
    out += [(extra + REROLE, "R", after) for role, after in NEXT[state].items() if role in ROLES]
    return sorted(out)


def least_costs(rows: list[tuple[str, int, int]]) -> list[int]:
    """Per place, what the rows from there on cost at least, whatever stands around them."""
    out = [0] * (len(rows) + 1)
    for k in range(len(rows) - 1, -1, -1):
        initial, fault, copies = rows[k]
        own = min(DELETE, (TRUNCATED if fault == CUT else 0) + (0 if initial in ("s", "u", "a") else REROLE)) if fault > DUPLICATE else DELETE
        out[k] = out[k + 1] + own + DELETE * (copies - 1)
    return out


def search(rows: list[tuple[str, int, int]], entry: int) -> dict[int, tuple[int, str]]:
    """The best (cost, audit) from state `entry` to each state that the rows (initial, fault,
    copies) can end in."""
    n, least = len(rows), least_costs(rows)
    best: dict[tuple[int, int], tuple[int, str]] = {}
    done: dict[int, tuple[int, str]] = {}
    stack = [(0, entry, 0, "")]
    while stack:
        at, state, cost, audit = stack.pop()
        known = best.get((at, state))
        if known is not None and known <= (cost, audit):
            continue
        bound, size = cost + least[at], len(audit)
        if not any(end not in done or bound < done[end][0] or (bound == done[end][0] and audit <= done[end][1][:size])
                   for end in ENDS[state]):
            continue
        best[at, state] = (cost, audit)
        if at == n and (state not in done or (cost, audit) < done[state]):
            done[state] = (cost, audit)
        for role, after in NEXT[state].items():
            if role in ROLES:
                stack.append((at, after, cost + INSERT, audit + "I"))
        if at < n:
            initial, fault, copies = rows[at]
            # copies after the first must go; an insertion between them is better placed behind them
            for price, letter, after in reversed(choices(initial, fault, state)):
                stack.append((at + 1, after, cost + price + DELETE * (copies - 1), audit + letter + "D" * (copies - 1)))
    return done


def edited(turns: list[dict], entry: int, audit: str) -> list[tuple[str, str]]:
    """(role, text) of the output of a segment's edits."""
    out, state, k, left = [], entry, 0, 0
    for letter in audit:
        if letter == "I" or letter == "R":
            role, state = next((ROLES[r], after) for r, after in NEXT[state].items() if r in ROLES)
            out.append((role, "" if letter == "I" else turns[k]["text"]))
        elif letter == "K":
            out.append((turns[k]["role"], turns[k]["text"]))
            state = NEXT[state][turns[k]["role"][0]]
        if letter != "I":
            left = left or turns[k]["copies"]
            left -= 1
            k += not left
    return out


def searched(parts: DataFrame) -> DataFrame:
    """Adds the best edits between states to segments, as an array of (entry, exit, cost, audit): from all
    states, or from the first one where a segment begins its conversation."""
    kind = pa.list_(pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for turns, inner in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                rows = [(t["role"][:1], t["fault"], t["copies"]) for t in turns if t["copies"]]
                found.append([{"entry": a, "exit": b, "cost": cost, "audit": audit}
                              for a in (NEXT if inner else (OPEN,)) for b, (cost, audit) in search(rows, a).items()])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, kind)], names=["conv_id", "segment", "turns", "edits"])

    turns = parts.schema["turns"].dataType.simpleString()
    return parts.mapInArrow(solve, f"conv_id long, segment long, turns {turns}, "
                            "edits array<struct<entry: int, exit: int, cost: long, audit: string>>")


class Conversation:
    """What the segments so far come to: counts, and per state the best edits."""

    def __init__(self):
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.last = None
        # per state: cost, audit, hash of the output, the segments' choices as a linked list
        self.ways: dict[int, tuple[int, str, object, tuple | None]] = {OPEN: (0, "", hashlib.sha256(), None)}

    def add(self, segment: int, turns: list[dict], edits: list[dict]) -> None:
        turns = [t for t in turns if t["copies"]]
        for t in turns:
            self.blank += t["copies"] if t["fault"] == BLANK else 0
            self.duplicate += 0 if t["fault"] == BLANK else t["copies"] - (t["fault"] != DUPLICATE)
            self.truncated += t["fault"] == CUT
            initial = t["role"][:1]
            self.illegal += (t["copies"] - 1) + (self.last is not None and self.last + initial not in ("su", "ua", "au"))
            self.last = initial
            if t["turn"] is not None and t["turn"] != self.high:  # turns ascend
                self.low = t["turn"] if self.low is None else self.low
                self.high = t["turn"]
                self.turns += 1
        ways: dict[int, tuple] = {}
        for e in edits:
            if e["entry"] in self.ways:
                cost, audit, _, _ = self.ways[e["entry"]]
                way = (cost + e["cost"], audit + e["audit"], e)
                if e["exit"] not in ways or way[:2] < ways[e["exit"]][:2]:
                    ways[e["exit"]] = way
        before, self.ways = self.ways, {}
        for state, (cost, audit, e) in ways.items():
            digest = before[e["entry"]][2].copy()
            out = "\n".join(f"{role}:{text}" for role, text in edited(turns, e["entry"], e["audit"]))
            if e["entry"] != OPEN and len(e["audit"].replace("D", "")):
                out = "\n" + out
            digest.update(out.encode("utf-8", "surrogatepass"))
            self.ways[state] = (cost, audit, digest, (before[e["entry"]][3], segment, e["entry"], e["audit"]))

    def row(self) -> tuple[dict, list[tuple[int, int, str]]]:
        """The conversation's result, and (segment, entry, audit) of the chosen edits."""
        cost, audit, digest, link = min((self.ways[s] for s in SOUND if s in self.ways), key=lambda w: w[:2])
        chosen = []
        while link:
            link, *own = link
            chosen.append(tuple(own))
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return dict(gaps=gaps, blank=self.blank, duplicate=self.duplicate, truncated=self.truncated, illegal=self.illegal,
                    cost=cost, audit=audit, repaired_sha256=digest.hexdigest()), chosen[::-1]


RESULT = {"gaps": pa.int64(), "blank": pa.int64(), "duplicate": pa.int64(), "truncated": pa.int64(), "illegal": pa.int64(),
          "cost": pa.int64(), "audit": pa.string(), "repaired_sha256": pa.string()}
RESULT_SQL = ", ".join(f"{n} {'string' if t == pa.string() else 'long'}" for n, t in RESULT.items())


def composed(parts: DataFrame) -> DataFrame:
    """(conv_id, segment, entry, edits, result): the chosen edits of each segment; the last one of a
    conversation carries its result."""
    kind = pa.struct(list(RESULT.items()))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, now = None, None

        def finished():
            result, chosen = now.row()
            last = len(chosen) - 1
            cols = list(zip(*chosen))
            return pa.RecordBatch.from_arrays(
                [pa.array([at[0]] * len(chosen), pa.int64()), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()),
                 pa.array(cols[2], pa.string()), pa.array([result if k == last else None for k in range(len(chosen))], kind)],
                names=["conv_id", "segment", "entry", "edits", "result"])

        for batch in batches:
            for k in range(batch.num_rows):  # one segment's texts at a time
                conv, segment, turns, edits = (batch.column(c)[k].as_py() for c in range(4))
                if at != (conv,):
                    if at is not None:
                        yield finished()
                    at, now = (conv,), Conversation()
                now.add(segment, turns, edits)
        if at is not None:
            yield finished()

    dealt = parts.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "segment")
    return dealt.mapInArrow(fold, f"conv_id long, segment long, entry int, edits string, result struct<{RESULT_SQL.replace(' ', ': ').replace(',:', ',')}>")


def plan(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The searched segments (stored), and their chosen edits."""
    small_batches(conversations.sparkSession)
    parts = stored(searched(segments(with_faults(damaged(conversations)))), "segments")
    return parts, composed(parts)


def repair(conversations: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)."""
    return plan(conversations)[1].filter("result is not null").select("conv_id", "result.*")


def repaired(conversations: DataFrame) -> DataFrame:
    """(conv_id, segment, place, role, text): the turns of the repaired conversations, in order of
    segment and place."""
    parts, chosen = plan(conversations)
    chosen = chosen.select(F.col("conv_id").alias("c"), F.col("segment").alias("s"), "entry", F.col("edits").alias("letters"))
    rows = parts.join(chosen, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("segment") == F.col("s"))).select(
        "conv_id", "segment", "turns", "entry", "letters")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in (batch.slice(k, 1).to_pylist()[0] for k in range(batch.num_rows)):
                out = edited([t for t in r["turns"] if t["copies"]], r["entry"], r["letters"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["conv_id"]] * len(out), pa.int64()), pa.array([r["segment"]] * len(out), pa.int64()),
                     pa.array(range(len(out)), pa.int32()), pa.array([a for a, _ in out], pa.string()),
                     pa.array([b for _, b in out], pa.string())], names=["conv_id", "segment", "place", "role", "text"])

    return rows.mapInArrow(apply, "conv_id long, segment long, place int, role string, text string")
