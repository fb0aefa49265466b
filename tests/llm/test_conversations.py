"""Conversation repair: the search against trying everything, segments against one search, odd tables."""

import hashlib
import itertools
import random
import re
import time
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagesig.llm import conversations as C

SOUND = re.compile(r"(s?(ua)+)?")
GAPS = ["", "u", "a", "ua", "au"]


def everything(rows):
    """The best (cost, audit) by trying all edits (at most two insertions per gap)."""
    def edits(initial, fault):
        out = [(2, "D", "")]
        if fault not in (C.BLANK, C.DUPLICATE):
            extra = 5 if fault == C.CUT else 0
            out += [(extra, "K", initial or "?"), (extra + 1, "R", "u"), (extra + 1, "R", "a")]
        return out
    best = None
    for own in itertools.product(*(edits(i, f) for i, f, _ in rows)):
        if best and sum(c for c, _, _ in own) > best[0]:
            continue
        for gaps in itertools.product(GAPS, repeat=len(rows) + 1):
            if SOUND.fullmatch("".join(g + e[2] for g, e in zip(gaps, (*own, (0, "", ""))))):
                cost = sum(c for c, _, _ in own) + 5 * sum(map(len, gaps))
                audit = "".join("I" * len(g) + e[1] for g, e in zip(gaps, (*own, (0, "", ""))))
                best = min(best or (cost, audit), (cost, audit))
    return best


def tabled(rows, entry=C.OPEN):
    """The best (cost, audit) to each state, row by row, insertions as two rounds per gap."""
    def widen(now):
        for _ in range(3):
            for state, (cost, audit) in list(now.items()):
                for role, after in C.NEXT[state].items():
                    if role != "s":
                        now[after] = min(now.get(after, (9e9, "")), (cost + 5, audit + "I"))
        return now
    now = {entry: (0, "")}
    for initial, fault, copies in rows:
        for k in range(copies):
            own, now = fault if k == 0 or fault == C.BLANK else C.DUPLICATE, widen(now) if k == 0 else now
            new = {}
            for state, (cost, audit) in now.items():
                for price, letter, after in C.choices(initial, own, state):
                    new[after] = min(new.get(after, (9e9, "")), (cost + price, audit + letter))
            now = new
    return widen(now)


row = st.tuples(st.sampled_from(["s", "u", "a", "t", ""]), st.sampled_from([C.BLANK, C.DUPLICATE, C.CUT, C.FINE, C.FINE, C.FINE]), st.just(1))
more = st.tuples(st.sampled_from("suat"), st.sampled_from([C.BLANK, C.DUPLICATE, C.CUT, C.FINE, C.FINE, C.FINE]), st.sampled_from([1, 1, 1, 2, 3]))


@settings(deadline=None, max_examples=80)
@given(st.lists(row, max_size=3))
def test_search_matches_trying_everything(rows):
    done = C.search(rows, C.OPEN)
    assert min(done[s] for s in C.SOUND if s in done) == everything(rows)


@settings(deadline=None, max_examples=300)
@given(st.lists(more, max_size=30), st.sampled_from(range(4)))
def test_search_matches_the_table(rows, entry):
    assert C.search(rows, entry) == tabled(rows, entry)


@pytest.mark.parametrize("roles", ["u", "a", "ua", "uua", "aau", "t", "suat", "st"])
def test_searches_of_full_segments_end(roles):
    rows = [(roles[k % len(roles)], C.CUT if k % 7 == 0 else C.FINE, 1) for k in range(C.SEGMENT)]
    begin = time.process_time()
    assert C.search(rows, C.OPEN) == tabled(rows)
    assert time.process_time() - begin < 5


def plain(rows):
    """{conv_id: (gaps, blank, duplicate, truncated, illegal, cost, audit, text)} one conversation at a time."""
    out, convs = {}, {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    for conv, own in convs.items():
        turns = []
        for turn, role, text in sorted(own, key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2])):
            damage = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if damage == 1 else re.sub("[.!?]", "", text) if damage == 2 else text
            turns += [(turn, "user" if damage == 4 else role, text)] * (0 if damage == 0 else 2 if damage == 3 else 1)
        seen, faults = set(), []
        for _, role, text in turns:
            own = text.strip(" \t\n\v\f\r")
            faults.append(C.BLANK if not own else C.DUPLICATE if (role, text) in seen else C.CUT if own[-1] not in ".!?" else C.FINE)
            seen.add((role, text))
        initials = [r[:1] for _, r, _ in turns]
        done = tabled([(i, f, 1) for i, f in zip(initials, faults)])
        cost, audit = min(done[s] for s in C.SOUND if s in done)
        lines, k, need = [], 0, "u"
        for letter in audit:
            if letter in "IR":
                lines.append(f"{C.ROLES[need]}:{'' if letter == 'I' else turns[k][2]}")
            elif letter == "K":
                lines.append(f"{turns[k][1]}:{turns[k][2]}")
            if letter != "D" and not (letter == "K" and initials[k] == "s"):
                need = "a" if need == "u" else "u"
            k += letter != "I"
        real = [t for t, _, _ in turns if t is not None]
        out[conv] = (max(real) - min(real) + 1 - len(set(real)) if real else 0, *(faults.count(f) for f in (C.BLANK, C.DUPLICATE, C.CUT)),
                     sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, "\n".join(lines))
    return out


def check(spark, rows, frame=None):
    frame = frame or spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = plain(rows)
    got = C.repair(frame).collect()
    assert len(got) == len(want) == len({r["conv_id"] for r in got})
    for r in got:
        w = want[r["conv_id"]]
        assert tuple(r[1:8]) == w[:7] and r["repaired_sha256"] == hashlib.sha256(w[7].encode()).hexdigest()
    turns = {}
    for r in sorted(C.repaired(frame).collect(), key=lambda r: (r["segment"], r["place"])):
        turns.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    assert {c: "\n".join(t) for c, t in turns.items()} == {c: w[7] for c, w in want.items() if w[7]}


def test_conversations_match_brute_force(spark):
    check(spark, [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
                  .select("conv_id", "turn", "role", "text").collect()])


def test_long_conversation_and_hot_texts(spark):
    rng = random.Random(3)
    rows = [(7, k + k // 50, rng.choice(["user", "assistant", "user", "assistant", "tool", "system"]), f"line {rng.randrange(900)}.") for k in range(900)]
    rows += [(8, k, "user" if k % 2 == 0 else "assistant", f"turn {k}" + "." * (k % 9 > 0)) for k in range(500)]
    rows += [(9, k, "user", "same.") for k in range(300)] + [(10, 1, "user", "repeated.")] * 400 + [(11, 0, "user", "x" * 70_000 + "."), (11, 1, "assistant", "ok!")]
    check(spark, rows)


def test_odd_rows(spark):
    rows = [(1, 0, None, None), (1, None, "user", "hello."), (1, 1, "assistant", "a b?  \t"), (2, None, None, ""), (2, None, "assistant", "é!"),
            (None, 0, "user", "u."), (None, 1, "assistant", "a."), (None, 1, "assistant", "b."), (3, -5, "", "empty role."), (3, 4, "sam", "sys."),
            (3, 6, "ursula", "u!"), (3, 7, "anna", "a!"), (4, 3, "user", "q."), (4, 3, "user", "q."), (4, 3, "assistant", "r.")]
    extra = [(*r, "x", "y", 1, "z") for r in rows]
    frame = spark.createDataFrame(extra, "conv_id long, turn long, role string, text string, segment string, fault string, before int, copies string")
    check(spark, rows, frame.repartition(3))
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    check(spark, [(dropped, 0, "user", "gone.")])
    got = C.repair(spark.createDataFrame([(dropped, 0, "user", "gone.")], "conv_id long, turn long, role string, text string")).first()
    assert tuple(got) == (dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert C.repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []
