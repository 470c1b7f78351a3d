"""Conversation structure repair: faults, and the cheapest edits that make roles alternate.

Rows of a conversation are taken by turn, nulls first; rows of one turn by role and text, so equal rows
stand together. Equal rows are counted and not kept apart, and a row whose role and text stood at an
earlier turn is found by a minimum per (conversation, role, text), so no conversation is gathered for
that. The rows are then dealt to ranges of (conversation, turn). A conversation inside one range is
aligned there (see `turn_alignment`). One that is cut, at most one for each border between ranges, is
aligned in its ranges for all four ways it may begin there; the results are put together and the ranges
are read again with their part of the audit. Its size is then only that of its audit.

Defined results: null roles and texts are one blank; a null conversation is a conversation of its own;
rows of one turn are ordered by role and text; a conversation without rows is not in `repair`; an empty
table gives an empty one; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datadict.llm import turn_alignment as ta
from datadict.operators.ordered import arrange
from datadict.storage import store

_BLANKS = " \t\n\x0b\x0c\r"
_COUNTS = ("blank", "duplicate", "truncated", "illegal")
_TURNS = "array<struct<role:string,text:string>>"


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with faults put in by a hash of their place; `copies` counts each row, none are 0."""
    blank = F.lit(" ")
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), blank) for c in ("conv_id", "turn")])
    hit = F.crc32(name) % 20
    text = F.coalesce(F.col("text").cast("string"), blank)
    return conversations.select(
        "conv_id", "turn",
        F.when(hit == 4, F.lit("user")).otherwise(F.coalesce(F.col("role").cast("string"), blank)).alias("role"),
        F.when(hit == 1, F.lit("")).when(hit == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(hit == 0, 0).when(hit == 3, 2).otherwise(1).cast("bigint").alias("copies"))


def _counted(rows: DataFrame) -> DataFrame:
    """Distinct rows with their number, and whether role and text stood at an earlier turn."""
    key = ["conv_id", "turn", "role", "text"]
    own = rows.where("copies > 0").groupBy(*key).agg(F.sum("copies").alias("copies"))
    own = own.withColumn("content", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    firsts = own.groupBy("conv_id", "content").agg(F.min(F.struct("turn")).alias("first"), F.count(F.lit(1)).alias("n"))
    firsts = firsts.where("n > 1").select(F.col("conv_id").alias("of"), F.col("content").alias("at"), "first")
    met = F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("content") == F.col("at"))
    repeated = F.col("first").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first.turn"))
    return own.join(firsts, met, "left").select(*key, "copies", repeated.alias("repeated"))


def _runs(batches: Iterator) -> Iterator[tuple]:
    """(conv_id, slice, turns) of each conversation in a sorted partition; a turn is (turn, role, text, duplicate)."""
    at, rows = None, []
    for batch in batches:
        for conv, part, turn, role, text, copies, repeated in zip(*(batch.column(c).to_pylist() for c in (
                "conv_id", "_slice", "turn", "role", "text", "copies", "repeated"))):
            if rows and at != (conv, part):
                yield *at, rows
                rows = []
            at = conv, part
            rows.append((turn, role, text, repeated))
            rows += [(turn, role, text, True)] * (copies - 1)
    if rows:
        yield *at, rows


def _faults(rows: list[tuple]) -> tuple[list[ta.Turn], dict[str, int]]:
    """The turns to align, and the counts of their faults."""
    turns, counts = [], dict.fromkeys(_COUNTS, 0)
    for _, role, text, duplicate in rows:
        said = text.rstrip(_BLANKS)
        fault = ta.FORCED if not said or duplicate else ta.TRUNCATED if said[-1] not in ".!?" else ta.NONE
        if fault != ta.NONE:
            counts["blank" if not said else "duplicate" if duplicate else "truncated"] += 1
        turns.append((role[:1], fault))
    counts["illegal"] = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
    return turns, counts


def _gaps(least: int | None, most: int | None, distinct: int) -> int:
    return 0 if least is None else most - least + 1 - distinct


def _turn_rows(rows: list[tuple], audit: str, start: int = ta.BEGIN) -> list[dict]:
    return [{"role": role, "text": text} for role, text in ta.repaired(((r[1], r[2]) for r in rows), audit, start)]


def _output(kind: str) -> str:
    return (f"conv_id {kind}, part bigint, parts bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint,"
            f" illegal bigint, cost bigint, audit string, turns {_TURNS}")


_SIZE = 4 << 20


def _whole(pinned: DataFrame, kind: str, cut: frozenset) -> DataFrame:
    def run(batches: Iterator) -> Iterator:
        names = ["conv_id", "part", "parts", "gaps", *_COUNTS, "cost", "audit", "turns"]
        out, size = [], 0

        def written() -> pa.RecordBatch:
            columns = list(zip(*out))
            types = [id_type, *[pa.int64()] * 8, pa.string(), pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        id_type = None

        def typed(source: Iterator) -> Iterator:
            nonlocal id_type
            for batch in source:
                id_type = batch.column("conv_id").type
                yield batch

        for conv, _, rows in _runs(typed(batches)):
            if conv in cut:
                continue
            turns, counts = _faults(rows)
            cost, audit = ta.completed(ta.run_ways(turns, ta.BEGIN))
            places = {r[0] for r in rows if r[0] is not None}
            gaps = _gaps(min(places, default=None), max(places, default=None), len(places))
            out.append((conv, 0, 1, gaps, *counts.values(), cost, audit, _turn_rows(rows, audit)))
            size += sum(len(r[2]) for r in rows)
            if size > _SIZE or len(out) >= 4096:
                yield written()
                out, size = [], 0
        if out:
            yield written()

    return pinned.mapInArrow(run, _output(kind))


def _cut(pinned: DataFrame, kind: str, cut: frozenset) -> DataFrame:
    """Conversations that lie in several ranges."""
    import pandas as pd

    conv = F.col("conv_id")
    mine = pinned.where(F.when(conv.isNull(), F.lit(None in cut)).otherwise(conv.isin([c for c in cut if c is not None])))

    def facts(batches: Iterator) -> Iterator:
        for conv, part, rows in _runs(batches):
            turns, counts = _faults(rows)
            ways = [(s, e, cost, audit) for s in ta.STATES for e, (cost, audit) in ta.run_ways(turns, s).items()]
            places = [r[0] for r in rows if r[0] is not None]
            yield pa.RecordBatch.from_pylist([{
                "conv_id": conv, "part": part, **counts, "first": turns[0][0], "last": turns[-1][0],
                "least": places[0] if places else None, "most": places[-1] if places else None,
                "distinct": len(set(places)),
                "ways": [dict(zip(("start", "end", "cost", "audit"), w)) for w in ways]}], facts_type)

    facts_schema = (f"conv_id {kind}, part bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint,"
                    " first string, last string, least bigint, most bigint, distinct bigint,"
                    " ways array<struct<start:int,end:int,cost:bigint,audit:string>>")
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    facts_type = to_arrow_schema(_parse_datatype_string(facts_schema))

    def together(parts: pd.DataFrame) -> pd.DataFrame:
        parts = parts.sort_values("part")
        cost, pieces = ta.joined_runs([{(w["start"], w["end"]): (w["cost"], w["audit"]) for w in ways} for ways in parts["ways"]])
        last, first = list(parts["last"]), list(parts["first"])
        illegal = int(parts["illegal"].sum()) + sum(a + b not in ("su", "ua", "au") for a, b in zip(last, first[1:]))
        known = parts.dropna(subset=["least"])
        least, most = list(known["least"]), list(known["most"])
        distinct = int(known["distinct"].sum()) - sum(a == b for a, b in zip(most, least[1:]))
        gaps = _gaps(int(least[0]), int(most[-1]), distinct) if least else 0
        out = pd.DataFrame({"conv_id": parts["conv_id"], "part": parts["part"]})
        out["parts"], out["gaps"] = len(parts), gaps
        for name in ("blank", "duplicate", "truncated"):
            out[name] = int(parts[name].sum())
        out["illegal"], out["cost"] = illegal, cost
        out["audit"] = [a for _, a in pieces]
        out["start"] = [s for s, _ in pieces]
        return out

    schema = _output(kind)
    summary = schema.removesuffix(f", turns {_TURNS}")
    pieces = mine.mapInArrow(facts, facts_schema).groupBy("conv_id").applyInPandas(together, f"{summary}, start int")

    def turns_of(rows: pd.DataFrame, piece: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_row")
        said = []
        for role, text, copies in zip(rows["role"], rows["text"], rows["copies"]):
            said += [(None, role, text)] * int(copies)
        out = piece.drop(columns="start")
        out["turns"] = [_turn_rows(said, piece["audit"].iloc[0], int(piece["start"].iloc[0]))]
        return out

    ranges = mine.withColumnRenamed("_slice", "part").groupBy("conv_id", "part")
    return ranges.cogroup(pieces.groupBy("conv_id", "part")).applyInPandas(turns_of, schema)


def _repaired(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Conversations that lie in one range, and those that are cut."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    pinned = arrange(_counted(rows), ["conv_id"], ["turn", "role", "text"])
    spread = pinned.groupBy("conv_id").agg(F.min("_slice").alias("lo"), F.max("_slice").alias("hi")).where("lo < hi")
    cut = frozenset(r["conv_id"] for r in spread.select("conv_id").collect())  # at most one per border of ranges
    return _whole(pinned, kind, cut), store(_cut(pinned, kind, cut), "cut") if cut else None


def repair(rows: DataFrame) -> DataFrame:
    """Repaired conversations. `rows`: conv_id, turn, role, text, and `copies`, how often each row stands there.

    One row per conversation, or per range of it where it lies in several (`part`, of `parts`): gaps,
    faults and cost of the whole conversation, the range's part of the audit, and the repaired turns.
    """
    whole, cut = _repaired(rows)
    return whole if cut is None else whole.unionByName(cut)


def _line(turn: Column) -> Column:
    return F.concat(turn["role"], F.lit(":"), turn["text"])


def _digest(parts: DataFrame, kind: str) -> DataFrame:
    """SHA-256 of the lines of conversations in several parts: the parts of one run through a task, one at a time."""

    def run(batches: Iterator) -> Iterator:
        import hashlib

        at, own, empty = None, None, True

        def written() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at[0]], id_type), pa.array([own.hexdigest()])], ["of", "hashed"])

        id_type = None
        for batch in batches:
            id_type = batch.column(0).type
            for conv, lines, some in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "lines", "some"))):
                if at != (conv,):
                    if at:
                        yield written()
                    at, own, empty = (conv,), hashlib.sha256(), True
                if some:
                    own.update(lines.encode() if empty else b"\n" + lines.encode())
                    empty = False
        if at:
            yield written()

    return parts.repartition("conv_id").sortWithinPartitions("conv_id", "part").select(
        "conv_id", "lines", "some").mapInArrow(run, f"of {kind}, hashed string")


def repaired_conversations(conversations: DataFrame) -> DataFrame:
    """Per original conversation the faults of its damaged rows, the cheapest audit and a digest of the repair."""
    kind = conversations.schema["conv_id"].dataType.simpleString()
    rows = conversations.select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", "text")
    whole, cut = _repaired(damaged(rows))
    lines = F.array_join(F.transform("turns", _line), "\n")
    done = whole.select("conv_id", "gaps", *_COUNTS, "cost", "audit", F.sha2(lines, 256).alias("hashed"))
    if cut is not None:
        several = cut.select("*", lines.alias("lines"), (F.size("turns") > 0).alias("some"))
        audits = cut.groupBy("conv_id", "gaps", *_COUNTS, "cost").agg(F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("part", "audit"))), lambda p: p["audit"]), "").alias("audit"))
        long = audits.join(_digest(several, kind), F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")
        done = done.unionByName(long)
    done = done.withColumnRenamed("conv_id", "of")
    every = conversations.select("conv_id").distinct()
    met = F.col("conv_id").eqNullSafe(F.col("of"))
    zero = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", *_COUNTS, "cost")]
    return every.join(done, met, "left").select(
        "conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("hashed", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
