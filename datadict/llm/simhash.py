"""SimHash near-duplicates: fingerprints within a Hamming radius, found by BK-trees, joined to components.

A fingerprint has a bit for each place where more than half of the hashes of a text's word shingles have
it. Distinct fingerprints are dealt to shards by their bits: cut into four parts, two fingerprints that
differ in three bits or fewer agree in a whole part, so each goes to the four shards of its parts and
meets all its neighbours. A shard's members are put into a BK-tree, whose children are keyed by their
Hamming distance to the parent; a query at distance d from a node follows only the edges from d - radius
to d + radius. A shard of more than `SHARD` members is dealt again by four parts of the bits that its
members need not share, and so on at most `LEVELS` times; then its members agree in all but 16 bits, so
no tree grows with the corpus, and a large group of near copies is spread.
A shard gives only links that join two of its components, never all pairs.

A tree goes to the task that holds its shard's queries. Sending all trees from the driver to all
executors would gather every fingerprint there.

Defined results: a null text, or one without words, has the fingerprint zero and is linked like any
other; one with fewer words than a shingle is one shingle; rows of equal id are rows of their own; a null
id is larger than any other; other columns are left alone; an empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datadict.llm.components import components
from datadict.llm.tables import Scratch
from datadict.storage import store

RADIUS = 3
WORDS = 3
SEED = 42
SHARD = 512
LEVELS = 5
PIECE = 1 << 18

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_BLANK = re.compile(rb"[ \t-\r]")


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """The unsigned 64-bit fingerprint of a UTF-8 text, read in pieces that are cut between words."""
    import xxhash

    hashed, ones, total, held, at = xxhash.xxh64_intdigest, np.zeros(64, np.int64), 0, [], 0
    while at < len(text):
        cut = _BLANK.search(text, at + PIECE)
        end = cut.start() if cut else len(text)
        run = held + text[at:end].translate(_LOWER).split()
        at = end
        if len(run) < words:
            held = run
            continue
        held = run[len(run) - words + 1:]
        hashes = np.fromiter((hashed(b" ".join(s), SEED) for s in zip(*(run[i:] for i in range(words)))), np.uint64)
        ones += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        total += len(hashes)
    if total:
        return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")
    return hashed(b" ".join(held), SEED) if held else 0


class BKTree:
    """Numbers under Hamming distance; each node is [number, children by distance to it]."""

    def __init__(self) -> None:
        self.root: list | None = None

    def add(self, number: int) -> None:
        if self.root is None:
            self.root = [number, {}]
            return
        node = self.root
        while True:
            distance = (number ^ node[0]).bit_count()
            if distance not in node[1]:
                node[1][distance] = [number, {}]
                return
            node = node[1][distance]

    def near(self, number: int, radius: int) -> Iterator[int]:
        """The members at `radius` or less."""
        open_nodes = [self.root] if self.root else []
        while open_nodes:
            other, children = open_nodes.pop()
            distance = (number ^ other).bit_count()
            if distance <= radius:
                yield other
            if children:
                least, most = distance - radius, distance + radius
                open_nodes += [child for key, child in children.items() if least <= key <= most]


def spanning_links(members: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links of a shard that join its components: fewer than its members."""
    tree, root, out = BKTree(), {m: m for m in members}, []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for number in members:
        for other in tree.near(number, radius):
            a, b = find(number), find(other)
            if a != b:
                root[a] = b
                out.append((number, other))
        tree.add(number)
    return out


def _parts(used: int) -> list[int]:
    """`used` with each of RADIUS + 1 even parts of the other bits."""
    free = [b for b in range(64) if not used >> b & 1]
    n, count = len(free), RADIUS + 1
    cuts = [n * i // count for i in range(count + 1)]
    return [used | sum(1 << b for b in free[a:z]) for a, z in zip(cuts, cuts[1:])]


def _signed(number: int) -> int:
    return number - (1 << 64) if number >> 63 else number


def _dealt(rows: DataFrame, masks: list[int]) -> DataFrame:
    """`rows` (used, fp) in the shards of finer masks: (used, value, fp). `masks` are all that `used` takes."""
    finer = F.create_map(*[F.lit(v) for m in masks for v in (_signed(m), [_signed(p) for p in _parts(m)])])
    rows = rows.select(F.explode(F.element_at(finer, F.col("used"))).alias("used"), "fp")
    return rows.select("used", F.col("fp").bitwiseAND(F.col("used")).alias("value"), "fp").distinct()


def _links(shards: DataFrame) -> DataFrame:
    """Links of shards of bounded size; the members of a shard stand together."""

    def run(batches: Iterator) -> Iterator:
        def written(found: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], ["a", "b"])

        found, at, members = [], None, []
        for batch in batches:
            for used, value, fp in zip(*(c.to_pylist() for c in batch.columns)):
                if (used, value) != at:
                    found += _found(members)
                    at, members = (used, value), []
                members.append(fp & 0xFFFFFFFFFFFFFFFF)
            if found:
                yield written(found)
                found = []
        found += _found(members)
        if found:
            yield written(found)

    def _found(members: list[int]) -> list[tuple[int, int]]:
        return [(_signed(a), _signed(b)) for a, b in spanning_links(members)] if len(members) > 1 else []

    dealt = shards.repartition("used", "value").sortWithinPartitions("used", "value")
    return dealt.select("used", "value", "fp").mapInArrow(run, "a bigint, b bigint")


def links(fingerprints: DataFrame, scratch: Scratch) -> DataFrame:
    """Links between distinct fingerprints `fp` that join all components within the radius."""
    masks, rows, out = [0], fingerprints.select(F.lit(0).cast("bigint").alias("used"), "fp"), None
    for level in range(LEVELS):
        dealt = scratch.store(_dealt(rows, masks), "shards")
        masks = sorted({p for m in masks for p in _parts(m)})
        large = dealt.groupBy("used", "value").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > SHARD)
        large = scratch.store(large.select("used", "value"), "large")
        more = level + 1 < LEVELS and not large.isEmpty()
        here = scratch.store(_links(dealt.join(large, ["used", "value"], "left_anti") if more else dealt), "links")
        out = here if out is None else out.unionByName(here)
        if not more:
            break
        rows = dealt.join(large, ["used", "value"], "left_semi").select("used", "fp")
    return out


def fingerprinted(documents: DataFrame) -> DataFrame:
    """doc_id and its signed fingerprint `fp`."""

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            made = [fingerprint(t.as_py()) if t.is_valid else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_signed(m) for m in made], pa.int64())], ["doc_id", "fp"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    slim = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, f"doc_id {kind}, fp bigint")


def near_duplicates(documents: DataFrame) -> DataFrame:
    """Per document its fingerprint as hexadecimal text and its component's smallest doc_id."""
    scratch = Scratch(documents.sparkSession)
    rows = scratch.store(fingerprinted(documents), "fingerprints")
    classes = scratch.store(rows.groupBy("fp").agg(F.min("doc_id").alias("id")), "classes")
    found = scratch.store(components(links(classes, scratch), scratch), "found")
    smallest = found.join(classes.withColumnRenamed("fp", "node"), "node").groupBy("root").agg(F.min("id").alias("component_id"))
    named = found.join(smallest, "root").select(F.col("node").alias("of"), "component_id")
    named = classes.join(named, F.col("fp") == F.col("of"), "left").select(
        F.col("fp").alias("of"), F.coalesce("component_id", "id").alias("component_id"))
    out = rows.join(named, F.col("fp") == F.col("of")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
    out = store(out, "near_duplicates")
    scratch.clear()
    return out
