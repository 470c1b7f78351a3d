"""Conversation repair against a search over all edits."""

import hashlib
import random
import sys
import zlib
from functools import lru_cache

import pytest

from datadict.llm import conversations
from datadict.llm import turn_alignment as ta

sys.setrecursionlimit(20_000)

COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string"


def cheapest(turns):
    """(cost, least audit) by recursion over (turn, state), without tables or bands."""

    @lru_cache(None)
    def best(i, state, inserted):
        found = []
        want = "a" if state == ta.USER else "u"
        after = ta.USER if want == "u" else ta.ASSISTANT
        if i == len(turns) and state in (ta.BEGIN, ta.ASSISTANT):
            found.append((0, ""))
        if inserted < 3:
            found.append(step(3, "I", best(i, after, inserted + 1)))
        if i < len(turns):
            initial, fault = turns[i]
            found.append(step(4, "D", best(i + 1, state, 0)))
            if fault != ta.FORCED:
                more = 3 * (fault == ta.TRUNCATED)
                if initial == "s" and state == ta.BEGIN:
                    found.append(step(more, "K", best(i + 1, ta.SYSTEM, 0)))
                if initial == want:
                    found.append(step(more, "K", best(i + 1, after, 0)))
                found.append(step(3 + more, "R", best(i + 1, after, 0)))
        return min((f for f in found if f), default=None)

    def step(cost, letter, rest):
        return rest and (cost + rest[0], letter + rest[1])

    return best(0, ta.BEGIN, 0)


@pytest.mark.parametrize("segment", [2, 256])
def test_alignment(monkeypatch, segment):
    monkeypatch.setattr(ta, "SEGMENT", segment)
    rng = random.Random(segment)
    for _ in range(4000):
        size = rng.randrange(1, 9)
        turns = [(rng.choice("uuuaaasx"), rng.choice((0, 0, 0, 1, 2))) for _ in range(size)]
        assert ta.completed(ta.run_ways(turns, ta.BEGIN)) == cheapest(turns), turns
        at = rng.randrange(1, size + 1)
        runs = [{(s, e): w for s in ta.STATES for e, w in ta.run_ways(r, s).items()} for r in (turns[:at], turns[at:]) if r]
        cost, pieces = ta.joined_runs(runs)
        assert (cost, "".join(a for _, a in pieces)) == cheapest(turns)


def test_long_alignment():
    rng = random.Random(9)
    turns = [("ua"[i % 2] if rng.random() < 0.8 else rng.choice("uasx"), rng.choice((0,) * 8 + (1, 2))) for i in range(230)]
    assert ta.completed(ta.run_ways(turns, ta.BEGIN)) == cheapest(turns)


def expected(rows):
    out = []
    for conv in {r[0] for r in rows}:
        own = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            name = ":".join(" " if v is None else str(v) for v in (conv, turn))
            hit = zlib.crc32(name.encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            if hit == 0:
                continue
            text = "" if hit == 1 else "".join(c for c in text if c not in ".!?") if hit == 2 else text
            own += [(turn, "user" if hit == 4 else role, text)] * (2 if hit == 3 else 1)
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, turns, counts = set(), [], [0, 0, 0]
        for turn, role, text in own:
            said = text.rstrip(" \t\n\x0b\x0c\r")
            if not said:
                fault, at = ta.FORCED, 0
            elif (role, text) in seen:
                fault, at = ta.FORCED, 1
            elif said[-1] not in ".!?":
                fault, at = ta.TRUNCATED, 2
            else:
                fault, at = ta.NONE, None
            if at is not None:
                counts[at] += 1
            seen.add((role, text))
            turns.append((role[:1], fault))
        places = {t for t, _, _ in own if t is not None}
        gaps = max(places) - min(places) + 1 - len(places) if places else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        cost, audit = cheapest(turns)
        lines = [f"{r}:{t}" for r, t in ta.repaired(((r, t) for _, r, t in own), audit)]
        out.append((conv, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def conversation(rng, conv, size):
    said = ["Yes.", "No!", "why?", "cut off", "", " \t", None, "A b.\n", "x. y"]
    return [(conv, rng.choice([i, i, i, i + 1, None]) if rng.random() < 0.3 else i,
             rng.choice(["user", "assistant"]) if rng.random() < 0.2 else ("user", "assistant")[i % 2]
             if rng.random() < 0.95 else rng.choice(["system", None, "", "tool"]),
             rng.choice(said) if rng.random() < 0.3 else f"Turn {i}.") for i in range(size)]


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


def test_repaired_conversations(spark):
    rng = random.Random(3)
    rows = [r for c in range(60) for r in conversation(rng, c if c else None, rng.randrange(1, 12))]
    rows += rows[:20] + [(1000 + i, 0, "user", "Hi.") for i in range(60)]  # repeated rows; single rows, some dropped
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert rows_of(conversations.repaired_conversations(df)) == expected(rows)


@pytest.mark.parametrize("hot", [7, None])
def test_conversation_over_several_ranges(spark, hot):
    rng = random.Random(5)
    rows = conversation(rng, hot, 260) + [r for c in range(100, 110) for r in conversation(rng, c, 9)]
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "false")
    try:
        df = spark.createDataFrame(rows, SCHEMA)
        parts = conversations.repair(conversations.damaged(df))
        assert parts.where("parts > 1").count() > 2
        assert rows_of(conversations.repaired_conversations(df)) == expected(rows)
    finally:
        spark.conf.set(setting, before)


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert conversations.repaired_conversations(empty).count() == 0
    long = "word " * 200_000 + "end."
    rows = [(1, 5, "user", long), (1, 6, "assistant", long), (2, None, None, None), (3, 1, "user", "a."), (3, 1, "user", "a.")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", copies int, `_slice` string")
    assert rows_of(conversations.repaired_conversations(df)) == expected(rows)
