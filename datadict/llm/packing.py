"""Best-fit decreasing packing of documents into sequences of a fixed number of tokens.

Documents are cut only where they are longer than a sequence. Best-fit decreasing looks at lengths
alone, and pieces of equal length are interchangeable, so the packing of the whole corpus follows
from the number of pieces of each length: at most `capacity` numbers, whatever the corpus. One plan
is made from them on the driver, with open bins kept by remaining capacity and a segment tree over
the capacities that finds the tightest one. A step of the plan puts a run of equal pieces into a
run of equal bins, so its size depends on the capacity, not on the number of pieces. The pieces are
then ranked within their length, in salted groups, and take their places from the plan.

Defined results: a null or empty text is the one end-of-document token; rows of equal id are packed
one by one; an empty table gives an empty one; a text of any length is cut into full pieces and a rest.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datadict.llm.tokens import id_encoder, text_groups
from datadict.llm.words import give_back
from datadict.storage import store

CAPACITY = 2048
END_OF_DOCUMENT = 0
PIECES_PER_SALT = 20_000


@dataclass(frozen=True)
class Step:
    """`items` pieces of `length`, from `rank` on, `per_bin` to a bin from `bin` on, after `offset` tokens."""

    length: int
    rank: int
    items: int
    per_bin: int
    bin: int
    offset: int


class Capacities:
    """Runs of bins by remaining capacity, under a segment tree that knows which capacities have any."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.runs: dict[int, list[tuple[int, int]]] = defaultdict(list)

    def _change(self, capacity: int, by: int) -> None:
        node = self.leaves + capacity
        while node:
            self.tree[node] += by
            node //= 2

    def put(self, capacity: int, first: int, bins: int) -> None:
        if bins and capacity:
            self.runs[capacity].append((first, bins))
            self._change(capacity, 1)

    def take(self, capacity: int) -> tuple[int, int]:
        self._change(capacity, -1)
        return self.runs[capacity].pop()

    def tightest(self, length: int) -> int | None:
        """The smallest capacity of an open bin that is not below `length`."""
        node = self.leaves + length
        if self.tree[node]:
            return length
        while node > 1:
            if not node & 1 and self.tree[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.tree[2 * node] else 2 * node + 1
                return node - self.leaves
            node //= 2
        return None


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[Step]:
    """The steps of best-fit decreasing over `counts` pieces of each length.

    A piece put into the tightest bin leaves it the tightest one as long as another equal piece
    fits, so a bin takes all the equal pieces it can before the next bin is asked.
    """
    open_bins, steps, new_bin = Capacities(capacity), [], 0
    for length in sorted((n for n, c in counts.items() if c), reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = open_bins.tightest(length)
            if room is None:
                room, first, bins = capacity, new_bin, -(-left // (capacity // length))
                new_bin += bins
            else:
                first, bins = open_bins.take(room)
            fit = room // length
            full = min(bins, left // fit)
            if full:
                steps.append(Step(length, rank, full * fit, fit, first, capacity - room))
                open_bins.put(room - fit * length, first, full)
                rank, left, first, bins = rank + full * fit, left - full * fit, first + full, bins - full
            if left and bins:
                steps.append(Step(length, rank, left, left, first, capacity - room))
                open_bins.put(room - left * length, first, 1)
                rank, left, first, bins = rank + left, 0, first + 1, bins - 1
            open_bins.put(room, first, bins)
    return steps


def _piece_schema(id_type: T.DataType, with_ids: bool) -> T.StructType:
    fields = [T.StructField("doc_id", id_type), T.StructField("piece", T.IntegerType()),
              T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
              T.StructField("ids_crc32", T.LongType())]
    return T.StructType([*fields, T.StructField("ids", T.BinaryType())] if with_ids else fields)


def cut(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
        tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece of a document's ids; `with_ids` adds them as little-endian 32-bit bytes."""
    end = END_OF_DOCUMENT.to_bytes(4, "little")

    def run(batches: Iterator) -> Iterator:
        import zlib

        import pyarrow as pa

        encode = id_encoder(tokenizer)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for first, last in text_groups(texts):
                rows, piece, start, length, crc, ids = [], [], [], [], [], []
                for i, found in enumerate(encode(texts[first:last]), first):
                    found += end
                    for k, at in enumerate(range(0, len(found), 4 * capacity)):
                        part = found[at:at + 4 * capacity]
                        rows.append(i), piece.append(k), start.append(at // 4)
                        length.append(len(part) // 4), crc.append(zlib.crc32(part))
                        if with_ids:
                            ids.append(part)
                columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()),
                           pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(ids, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)
        del encode
        give_back()

    slim = documents.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return slim.mapInArrow(run, _piece_schema(slim.schema["doc_id"].dataType, with_ids))


def ranked(pieces: DataFrame) -> DataFrame:
    """`pieces` with `rank`, 0-based within their length. A length of any number of pieces is spread over salts."""
    total = pieces.count()
    own = pieces.columns
    salts = max(1, -(-total // PIECES_PER_SALT))
    rows = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(salts)))
    counts = rows.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    rows = rows.withColumn("at", F.row_number().over(inside))
    return rows.join(counts, ["length", "salt"]).select(*own, (F.col("at") - 1 + F.col("before")).alias("rank"))


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """`pieces` (stored; lengths from 1 to `capacity`) with `sequence_id` and `offset`."""
    found = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # at most `capacity` rows
    steps = best_fit_decreasing({r["length"]: r["n"] for r in found}, capacity)
    own = pieces.columns
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()),
                           T.StructField("offset", T.LongType())])

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        step = {n: np.array([getattr(s, n) for s in steps], dtype=np.int64)
                for n in ("length", "rank", "per_bin", "bin", "offset")}
        for batch in batches:
            length, rank = (batch.column(n).to_numpy() for n in ("length", "rank"))
            at = np.empty(len(rank), dtype=np.int64)
            for n in np.unique(length):
                rows = np.flatnonzero(length == n)
                lo, hi = np.searchsorted(-step["length"], [-n, -n + 1])
                at[rows] = lo + np.searchsorted(step["rank"][lo:hi], rank[rows], side="right") - 1
            inside = rank - step["rank"][at]
            sequence = step["bin"][at] + inside // step["per_bin"][at]
            offset = step["offset"][at] + inside % step["per_bin"][at] * length
            columns = [batch.column(c) for c in own]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(sequence), pa.array(offset)], [*own, "sequence_id", "offset"])

    return ranked(pieces).mapInArrow(run, schema)


def packed_documents(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
                     tokenizer: str | None = None) -> DataFrame:
    """The pieces of all documents with their places. Pieces are stored, so texts are encoded once."""
    return pack(store(cut(documents, doc_id, text, capacity, tokenizer), "pieces"), capacity)
