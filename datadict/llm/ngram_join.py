"""Jaccard self-join of documents on word n-grams, as a blocked sparse matrix product.

The rows of the incidence matrix are the distinct n-gram sets (copies are one row), its columns the
n-grams. Two rows link when 100 * overlap >= percent * union. The product is not formed in full:

* Columns are ordered by how often they occur, by counters of a fixed number; a row of n entries can
  only reach the bound if it shares one of its n - ceil(percent * n / 100) + 1 first columns with the
  other row. Any order gives whole results; a rarest-first one gives short columns.
* The shared columns are dealt to blocks. Every row carries the parities of its entries in a fixed
  number of cells. The number of cells that differ is at most the number of n-grams in one row only,
  so a pair whose difference exceeds what the two sizes allow is discarded without its sets.
* A first round compares each row of a column with one leader, a second one with the row of another
  component whose parities are nearest. Rows that link are one component, and the last round takes all
  pairs of different components, so large groups of near copies do not become pairs. Columns with many
  rows are cut into blocks of bounded size.
* For the pairs that are left the overlap is counted over the whole sets.

Components are therefore those of all links. Rows are named by a 64-bit hash of their set.

Defined results: a text without words, or null, is linked with nothing; one with fewer words than n
has its whole sequence as its one n-gram; rows of equal id are rows of their own; a null id is
larger than any other; other columns are left alone; an empty table gives an empty one.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datadict.llm.components import components
from datadict.llm.registry import free_name
from datadict.llm.tables import Scratch, bit_field, in_field, slot_of
from datadict.llm.words import give_back, mix64, shingle_sets, text_slices, words_of
from datadict.storage import store

COUNTERS = 1 << 20
COUNTER_PARTS = 64
FAN_IN = 1024
BLOCK_ROWS = 2048
PAIR_BATCH = 256
LEADER, NEAREST, ALL = "leader", "nearest", "all"


@dataclass(frozen=True)
class Bound:
    """n-grams of `words` words; a link at a Jaccard similarity of `percent` / 100 or more."""

    words: int = 5
    percent: int = 80

    def needed(self, n: int) -> int:
        """The smallest overlap that a row of n entries can link with."""
        return -(-self.percent * n // 100)

    def cells(self, n: int) -> int:
        """Parity cells of a row: enough that unrelated rows differ in more of them than a link may."""
        cells = 512
        while cells * (100 + self.percent) < 7 * n * (100 - self.percent):
            cells *= 2
        return cells


def _counted(documents: DataFrame, bound: Bound):
    """How often n-grams occur, by the first bits of their hashes: `COUNTERS` numbers, whatever the corpus."""
    import numpy as np
    import pandas as pd

    words, part = bound.words, COUNTERS // COUNTER_PARTS

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        found, held, size = np.zeros(COUNTERS, np.int64), [np.zeros(0, np.int64)], 0
        for batch in batches:
            for _, data, offsets in text_slices(batch.column(0)):
                for grams in shingle_sets(words_of(data, offsets, True), words):
                    held.append((grams >> np.uint64(44)).astype(np.int64))
                    size += len(grams)
                if size > COUNTERS // 4:
                    found += np.bincount(np.concatenate(held), minlength=COUNTERS)
                    held, size = held[:1], 0
        found += np.bincount(np.concatenate(held), minlength=COUNTERS)
        if found.any():
            capped = np.minimum(found, 0xFFFFFFFF).astype("<u4")
            yield pa.RecordBatch.from_arrays([
                pa.array(range(COUNTER_PARTS), pa.int32()),
                pa.array([TaskContext.get().partitionId() // FAN_IN] * COUNTER_PARTS, pa.int32()),
                pa.array([capped[i * part:(i + 1) * part].tobytes() for i in range(COUNTER_PARTS)], pa.binary()),
            ], ["part", "upper", "counts"])
        give_back()

    def total(rows: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(part, np.uint64)
        for c in rows["counts"]:
            out += np.frombuffer(c, "<u4")
        first = rows.iloc[0]
        return pd.DataFrame({"part": [first["part"]], "upper": [first["upper"]],
                             "counts": [np.minimum(out, 0xFFFFFFFF).astype("<u4").tobytes()]})

    schema = "part int, upper int, counts binary"
    partial = documents.select("text").mapInArrow(count, schema)
    summed = partial.groupBy("part", "upper").applyInPandas(total, schema).withColumn("upper", F.lit(0))
    whole = np.zeros(COUNTERS, np.uint32)
    for row in summed.groupBy("part").applyInPandas(total, schema).collect():
        whole[row["part"] * part:(row["part"] + 1) * part] = np.frombuffer(row["counts"], "<u4")
    return np.minimum(whole, (1 << 24) - 1)


def _set_key(grams) -> int:
    import numpy as np

    total = int(np.sum(mix64(grams ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64))
    mixed = int(mix64(np.array([(total + len(grams)) & 0xFFFFFFFFFFFFFFFF], np.uint64)).view(np.int64)[0])
    return mixed


def _described(documents: DataFrame, bound: Bound, held) -> DataFrame:
    """Per document its set's key and size, its parities and its first columns. `held`: the counters, 4 MB."""
    import numpy as np

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        table = held.value
        for batch in batches:
            for first, data, offsets in text_slices(batch.column("text")):
                keys, sizes, cells, columns = [], [], [], []
                for grams in shingle_sets(words_of(data, offsets, True), bound.words):
                    n = len(grams)
                    sizes.append(n)
                    if not n:
                        keys.append(0), cells.append(b""), columns.append(np.zeros(0, np.int64))
                        continue
                    keys.append(_set_key(grams))
                    width = bound.cells(n)
                    odd = np.bincount((grams & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
                    cells.append(np.packbits(odd.astype(np.uint8), bitorder="little").tobytes())
                    order = (table[(grams >> np.uint64(44)).astype(np.int64)].astype(np.uint64) << np.uint64(40)) | (
                        grams >> np.uint64(24))
                    prefix = n - bound.needed(n) + 1
                    limit = np.partition(order, prefix - 1)[prefix - 1]
                    columns.append(np.unique(order[order <= limit]).view(np.int64))
                ends = np.cumsum([0, *map(len, columns)])
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(first, len(keys)), batch.column("text_key").slice(first, len(keys)),
                    pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(cells, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(columns), pa.int64())),
                ], ["doc_id", "text_key", "row", "n", "cells", "columns"])
        give_back()

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text_key", "text").mapInArrow(
        run, f"doc_id {kind}, text_key bigint, row bigint, n bigint, cells binary, columns array<bigint>")


def _shared(entries: DataFrame, bound: Bound) -> DataFrame:
    """The entries whose column has another row of a size they can link with.

    One shuffle. The rows of a column come by size, so a row's nearest sizes stand beside it, and a
    column is never held as a whole.
    """
    percent = bound.percent

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        held, repeated = None, False  # the last entry so far, and whether the one before it has its column
        for batch in batches:
            if held is not None:
                batch = pa.RecordBatch.from_arrays(
                    [pa.concat_arrays([h, c]) for h, c in zip(held.columns, batch.columns)], batch.schema.names)
            if not batch.num_rows:
                continue
            column, n = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            same = (column[1:] == column[:-1]) & (n[1:] * percent <= 100 * n[:-1])
            keep = np.zeros(len(column), bool)
            keep[1:] = same
            keep[:-1] |= same
            keep[0] |= repeated
            repeated = bool(keep[-1])
            held = batch.slice(batch.num_rows - 1)
            yield batch.slice(0, batch.num_rows - 1).filter(pa.array(keep[:-1]))
        if held is not None and repeated:
            yield held

    return entries.select("column", "row", "n").repartition("column").sortWithinPartitions("column", "n").mapInArrow(
        run, "column bigint, row bigint, n bigint")


def _candidates(members: DataFrame, bound: Bound, take: str) -> DataFrame:
    """Pairs of rows of different components that share a column, fit in size and may overlap enough.

    `members`: column, row, n, cells, component, and `lo`, `hi`, `side`: the block and the part of the
    column a row comes from. `take` is LEADER (each row with one row of its block), NEAREST (each row with
    the one that it may overlap most) or ALL.
    """
    percent, leaders = bound.percent, take == LEADER

    def pairs(rows: list[tuple], diagonal: bool) -> Iterator[tuple[int, int]]:
        met = fitting(rows, diagonal)
        if take != NEAREST:
            return ((a, b) for a, b, _ in met)
        best: dict[int, tuple[int, int, int]] = {}
        for a, b, excess in met:
            for row in (a, b):
                if row not in best or (excess, a, b) < best[row]:
                    best[row] = (excess, a, b)
        return ((a, b) for _, a, b in best.values())

    def fitting(rows: list[tuple], diagonal: bool) -> Iterator[tuple[int, int, int]]:
        rows.sort()
        sizes = [r[0] for r in rows]
        if leaders:
            lead = min(rows, key=lambda r: (r[4], (r[1] * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF, r[1]))
            others = [(lead, rows)]
        else:
            others = ((r, rows[i + 1:bisect_right(sizes, r[0] * 100 // percent, lo=i + 1)]) for i, r in enumerate(rows))
        for (n, row, component, cells, side, width), near in others:
            for m, other, at, more, part, wide in near:
                if at == component or (part == side and not diagonal and not leaders):
                    continue
                if n * percent > 100 * m or m * percent > 100 * n:
                    continue
                mine = cells
                while wide > width:
                    wide //= 2
                    more = (more ^ more >> wide) & ((1 << wide) - 1)
                narrow = width
                while narrow > wide:
                    narrow //= 2
                    mine = (mine ^ mine >> narrow) & ((1 << narrow) - 1)
                excess = (mine ^ more).bit_count() * (100 + percent) - (n + m) * (100 - percent)
                if excess <= 0:
                    yield (row, other, excess) if row < other else (other, row, excess)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def written(found: set) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([p[0] for p in found], pa.int64()), pa.array([p[1] for p in found], pa.int64())], ["a", "b"])

        found: set = set()
        block, rows = None, []
        for batch in batches:
            for column, lo, hi, side, row, n, component, cells in zip(*(batch.column(c).to_pylist() for c in (
                    "column", "lo", "hi", "side", "row", "n", "component", "cells"))):
                if block != (column, lo, hi):
                    if len(rows) > 1:
                        found.update(pairs(rows, block[1] == block[2]))
                    block, rows = (column, lo, hi), []
                rows.append((n, row, component, int.from_bytes(cells, "little"), side, 8 * len(cells)))
            if len(found) > 200_000:
                yield written(found)
                found = set()
        if len(rows) > 1:
            found.update(pairs(rows, block[1] == block[2]))
        if found:
            yield written(found)
        del found, rows
        give_back()

    dealt = members.repartition("column", "lo", "hi").sortWithinPartitions("column", "lo", "hi")
    return dealt.mapInArrow(run, "a bigint, b bigint").distinct()


def _blocks(shared: DataFrame) -> DataFrame:
    """`shared` with its block: columns of more than `BLOCK_ROWS` rows are cut, and each two parts meet once."""
    large = shared.groupBy("column").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > BLOCK_ROWS).select(
        F.col("column").alias("large"), F.ceil(F.col("c") / BLOCK_ROWS).cast("int").alias("parts"))
    rows = shared.join(large, shared["column"] == large["large"], "left").drop("large")
    parts = F.coalesce("parts", F.lit(1))
    rows = rows.withColumn("side", F.pmod(F.xxhash64("row"), parts).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    return rows.select("column", "row", "n", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"), "side")


def _linked(pairs: DataFrame, classes: DataFrame, documents: DataFrame, bound: Bound, scratch: Scratch) -> DataFrame:
    """The pairs (stored) whose whole sets link. Sets are made again from the texts of rows in pairs only.

    Which documents those are is sent as a bit field of fixed size; what it lets through beyond them
    is dropped by a join.
    """
    import numpy as np

    spark = documents.sparkSession
    nodes = pairs.select(F.col("a").alias("row")).union(pairs.select("b")).distinct()
    chosen = scratch.store(classes.select("row", "id").join(nodes, "row"), "nodes")
    field = bit_field(chosen, "id")
    held = spark.sparkContext.broadcast(field)

    def sets(batches: Iterator) -> Iterator:
        import pyarrow as pa

        field = held.value
        for batch in batches:
            at = batch.column(0).to_numpy()
            batch = batch.filter(pa.array(in_field(field, at)))
            for _, data, offsets in text_slices(batch.column(1)):
                grams = [g for g in shingle_sets(words_of(data, offsets, True), bound.words) if len(g)]
                yield pa.RecordBatch.from_arrays([
                    pa.array([_set_key(g) for g in grams], pa.int64()), pa.array([g.tobytes() for g in grams], pa.binary()),
                ], ["row", "grams"])
        give_back()

    def overlaps(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                at = np.searchsorted(x, y)
                at[at == len(x)] = 0
                overlap = int(np.count_nonzero(x[at] == y))
                keep.append(100 * overlap >= bound.percent * (len(x) + len(y) - overlap))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
        give_back()

    made = documents.select(slot_of(F.col("doc_id")).alias("slot"), "text").mapInArrow(sets, "row bigint, grams binary")
    made = made.join(chosen.select("row"), "row").dropDuplicates(["row"])
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    try:
        made = scratch.store(made, "sets")
        spark.conf.set(setting, PAIR_BATCH)
        both = pairs.join(made.select(F.col("row").alias("a"), F.col("grams").alias("x")), "a")
        both = both.join(made.select(F.col("row").alias("b"), F.col("grams").alias("y")), "b")
        return scratch.store(both.select("a", "b", "x", "y").mapInArrow(overlaps, "a bigint, b bigint"), "links")
    finally:
        spark.conf.set(setting, before)
        held.unpersist()


def joined(documents: DataFrame, bound: Bound = Bound(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of `documents`: `doc_id`, `text_key` (a hash of the text), `n` (size of its set), `component_id`."""
    spark = documents.sparkSession
    scratch, kept = Scratch(spark), Scratch(spark)
    body = F.col(f"`{text}`").cast("string")
    docs = documents.select(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(body).alias("text_key"), body.alias("text"))
    counts = spark.sparkContext.broadcast(_counted(docs, bound))
    described = scratch.store(_described(docs, bound, counts), "described")
    counts.unpersist()
    classes = scratch.store(described.where("n > 0").groupBy("row").agg(
        F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("cells").alias("cells"),
        F.first("columns").alias("columns")), "classes")
    shared = scratch.store(_shared(classes.select("row", "n", F.explode("columns").alias("column")), bound), "shared")
    blocks = scratch.store(_blocks(shared), "blocks")
    cells = classes.select("row", "cells")
    named, links = cells.withColumn("component", F.col("row")), None
    for take in (LEADER, NEAREST, ALL):
        pairs = scratch.store(_candidates(blocks.join(named, "row"), bound, take), "pairs")
        more = _linked(pairs, classes, docs, bound, scratch)
        links = more if links is None else links.union(more)
        found = scratch.store(components(links, scratch), "found")
        named = cells.join(found.withColumnRenamed("node", "row"), "row", "left").select(
            "row", "cells", F.coalesce("root", "row").alias("component"))
    smallest = found.join(classes.select(F.col("row").alias("node"), "id"), "node").groupBy("root").agg(
        F.min("id").alias("component_id"))
    named = found.join(smallest, "root").select(F.col("node").alias("row"), "component_id")
    named = classes.select("row", "id").join(named, "row", "left").select(
        F.col("row").alias("of"), F.coalesce("component_id", "id").alias("component_id"))
    rows = described.select("doc_id", "text_key", "row", "n").join(named, (F.col("row") == F.col("of")) & (F.col("n") > 0), "left")
    out = store(rows.select("doc_id", "text_key", "n", F.when(F.col("n") > 0, F.col("component_id")).otherwise(
        F.col("doc_id")).alias("component_id")), "joined")
    scratch.clear()
    return out


def one_of_each(documents: DataFrame, bound: Bound = Bound(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`documents` with one row of each component: the one of smallest id, then smallest hash of its text.

    Documents with nothing to compare stay, but for equal rows (same id, same text), of which one stays.
    The texts meet only the keys of rows that go, so Spark may broadcast these where they are few.
    """
    rows = joined(documents, bound, doc_id, text)
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("text_key"))
    best = rows.where("n > 0").groupBy("component_id").agg(F.min(order).alias("best"))
    keys = rows.groupBy("doc_id", "text_key", "n", "component_id").agg(F.count(F.lit(1)).alias("times"))
    keys = keys.join(best.withColumnRenamed("component_id", "of"), F.col("component_id").eqNullSafe(F.col("of")), "left")
    stays = (F.col("n") == 0) | order.eqNullSafe(F.col("best"))
    marked = store(keys.select(F.col("doc_id").alias("k_id"), F.col("text_key").alias("k_text"), "times",
                               stays.alias("stays")).where("not stays or times > 1"), "marked")
    k_text = free_name(documents, "text_key")
    keyed = documents.withColumn(k_text, F.xxhash64(F.col(f"`{text}`").cast("string")))
    met = keyed[doc_id].eqNullSafe(F.col("k_id")) & (F.col(k_text) == F.col("k_text"))
    out = keyed.join(marked, met, "left_anti").drop(k_text)
    twice = marked.where("stays and times > 1")
    if not twice.isEmpty():
        again = keyed.join(twice, met, "left_semi").dropDuplicates([doc_id, k_text]).drop(k_text)
        out = out.unionByName(again)
    return out
