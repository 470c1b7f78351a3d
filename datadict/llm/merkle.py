"""Merkle manifest of a dataset: a hash tree per group, and one over the groups' roots.

Leaves are numbered inside their group over range partitions, so a hot group is spread over as many
tasks as its rows need. Aligned subtrees of 729 leaves are one row each: their members and their nodes,
stored in van Emde Boas order (see `veb_tree`). The roots of these blocks are the leaves of the next
tier, until a group is one block; ten billion leaves need four tiers. The roots of the groups are a tree
built alike. Paths come down the same way: a block's own siblings are read by address, and those above
it are one row for the block, joined once per tier.

Defined results: fields that are null are `-`, the null group comes first; a null id comes before all
others and is not tampered with; rows of equal id are ordered by their leaves; a group of one row is its
leaf; an empty table gives an empty one; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datadict.llm import veb_tree as veb
from datadict.operators.ordered import number_rows_by_range
from datadict.storage import store

HEIGHT = 6
BLOCK = veb.FANOUT ** HEIGHT
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_PATH = "array<struct<left:string,right:string>>"
_PATH_TYPE = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def field_text(value: Column) -> Column:
    """`-` for null, else bytes, colon, value."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_digest(values: Sequence[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*[field_text(v) for v in values]), 256))


class Tree(NamedTuple):
    tiers: list[DataFrame]  # group, block, size, members, nodes; the first has the leaves
    roots: DataFrame        # group, digest


def _above(size: int) -> int:
    """Levels of a block over its leaves, in a tier of `size` nodes: a block that is not alone has them all."""
    return min(HEIGHT, veb.height(size))


def _blocks(nodes: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Rows (group, size, position, digest) by aligned blocks, with their trees. A block has at most 729 members."""

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            trees, roots = [], []
            for size, members in zip(batch.column("size").to_pylist(), batch.column("members")):
                above = _above(size)
                tree = veb.built([m["digest"].as_py() for m in members.values], above)
                trees.append(tree)
                at = veb.DIGEST * veb.place(above + 1, 0, 0)
                roots.append(tree[at:at + veb.DIGEST])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(trees, pa.binary()), pa.array(roots, pa.binary())], names)

    at = F.col("position") - 1
    packed = nodes.groupBy("group", "size", F.floor(at / BLOCK).cast("bigint").alias("block")).agg(
        F.array_sort(F.collect_list(F.struct((at % BLOCK).cast("int").alias("at"), "digest", *keep))).alias("members"))
    names = [*packed.columns, "nodes", "digest"]
    schema = T.StructType([*packed.schema.fields, T.StructField("nodes", T.BinaryType()), T.StructField("digest", T.BinaryType())])
    return packed.mapInArrow(run, schema)


def tree(leaves: DataFrame, group: str, order: Sequence[str], digest: str = "digest", keep: Sequence[str] = ()) -> Tree:
    """The tree of every group. `leaves` should be stored; `group` is not null."""
    rows = leaves.select(F.col(group).alias("group"), *order, F.col(digest).alias("digest"), *[k for k in keep if k not in order])
    numbered = number_rows_by_range(rows, ["group"], [*order, "digest"], "position")
    sizes = rows.groupBy("group").agg(F.count(F.lit(1)).alias("size"))
    largest = sizes.agg(F.max("size")).first()[0] or 0
    nodes = numbered.join(sizes, "group")
    tiers, roots = [], None
    while True:
        tiers.append(store(_blocks(nodes, keep if not tiers else ()), "tier"))
        alone = tiers[-1].where(F.col("size") <= BLOCK).select("group", "digest")
        roots = alone if roots is None else roots.unionByName(alone)
        if largest <= BLOCK:
            return Tree(tiers, roots)
        largest = -(-largest // BLOCK)
        nodes = tiers[-1].where(F.col("size") > BLOCK).select(
            "group", F.ceil(F.col("size") / BLOCK).cast("bigint").alias("size"), (F.col("block") + 1).alias("position"), "digest")


def _own_paths(size: int, members: int, nodes: bytes) -> Iterator[list[tuple[bytes, bytes]]]:
    block = veb.Block(nodes, members, _above(size))
    return (block.path(i) for i in range(members))


def _as_rows(path: list[tuple[bytes, bytes]]) -> list[dict]:
    return [{"left": left.decode(), "right": right.decode()} for left, right in path]


def _as_path(rows: list[dict]) -> list[tuple[bytes, bytes]]:
    return [(r["left"].encode(), r["right"].encode()) for r in rows]


def _inner(tier: DataFrame, upper: DataFrame) -> DataFrame:
    """`upper` (group, block, path, carried columns) of the tier below: one row per node of the tier's blocks."""
    carried = [c for c in upper.columns if c not in ("group", "block", "path")]

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            groups, blocks, paths, index = [], [], [], []
            for i, (group, block, size, members, nodes, path) in enumerate(zip(*(batch.column(c).to_pylist() for c in (
                    "group", "block", "size", "count", "nodes", "path")))):
                for at, own in enumerate(_own_paths(size, members, nodes)):
                    groups.append(group)
                    blocks.append(BLOCK * block + at)
                    paths.append(_as_rows(own) + path)
                    index.append(i)
            taken = pa.array(index, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(groups, pa.string()), pa.array(blocks, pa.int64()), pa.array(paths, _PATH_TYPE),
                 *(batch.column(c).take(taken) for c in carried)], ["group", "block", "path", *carried])

    joined = tier.select("group", "block", "size", F.size("members").alias("count"), "nodes").join(upper, ["group", "block"])
    schema = T.StructType([upper.schema[c] for c in ("group", "block", "path", *carried)])
    return joined.mapInArrow(run, schema)


def with_paths(made: Tree, top: DataFrame) -> DataFrame:
    """The blocks of leaves with the siblings above each. `top`: group, path above its root, carried columns."""
    top = top.withColumn("block", F.lit(0).cast("bigint"))
    upper = None
    for tier in reversed(made.tiers):
        heads = tier.where(F.col("size") <= BLOCK).select("group").join(top, "group").select(*top.columns)
        here = heads if upper is None else heads.unionByName(upper)
        if tier is not made.tiers[0]:
            upper = _inner(tier, here)
    return made.tiers[0].join(here, ["group", "block"])


def manifest(leaves: DataFrame, group: str, order: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Blocks of leaves (group, block, size, members, nodes) with `path` above them, `subroot` and `root`."""
    name = F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit(""))  # null first
    trees = tree(leaves.withColumn("_group", name), "_group", order, keep=keep)
    subroots = store(trees.roots.select(F.lit("").alias("all"), F.col("group").alias("name"), "digest"), "subroots")
    every = tree(subroots, "all", ["name"], keep=["name"])
    empty = F.array().cast(_PATH)
    root = every.roots.select("group", F.col("digest").alias("root"), empty.alias("path"))
    above = with_paths(every, root)

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            names, digests, paths, index = [], [], [], []
            for i, (size, members, nodes, path) in enumerate(zip(*(batch.column(c).to_pylist() for c in (
                    "size", "members", "nodes", "path")))):
                for member, own in zip(members, _own_paths(size, len(members), nodes)):
                    names.append(member["name"])
                    digests.append(member["digest"])
                    paths.append(_as_rows(own) + path)
                    index.append(i)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array(paths, _PATH_TYPE), pa.array(digests, pa.binary()),
                 batch.column("root").take(pa.array(index, pa.int64()))], ["group", "path", "subroot", "root"])

    top = above.select("size", "members", "nodes", "path", "root").mapInArrow(
        run, f"group string, path {_PATH}, subroot binary, root binary")
    return with_paths(trees, store(top, "top"))


def proofs(blocks: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Per leaf the kept columns, its digest, subroot and root as text, and the whole path of siblings."""
    fields = {f.name: f for f in blocks.schema["members"].dataType.elementType.fields}

    def run(batches: Iterator) -> Iterator:
        from binascii import hexlify

        for batch in batches:
            for size, members, nodes, path, subroot, root in zip(*(batch.column(c).to_pylist() for c in (
                    "size", "members", "nodes", "path", "subroot", "root"))):
                n = len(members)
                yield pa.RecordBatch.from_arrays([
                    *(pa.array([m[k] for m in members], t) for k, t in zip(keep, kinds)),
                    pa.array([hexlify(m["digest"]).decode() for m in members]),
                    pa.array([hexlify(subroot).decode()] * n), pa.array([hexlify(root).decode()] * n),
                    pa.array([_as_rows(own) + path for own in _own_paths(size, n, nodes)], _PATH_TYPE),
                ], [*keep, "leaf", "subroot", "root", "path"])

    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(fields[k].dataType) for k in keep]
    schema = T.StructType([*(fields[k] for k in keep), *(T.StructField(c, T.StringType()) for c in ("leaf", "subroot", "root")),
                           T.StructField("path", T.ArrayType(T.StructType([T.StructField("left", T.StringType()), T.StructField("right", T.StringType())])))])
    return blocks.select("size", "members", "nodes", "path", "subroot", "root").mapInArrow(run, schema)


def checked(blocks: DataFrame, key: str, changed: str) -> DataFrame:
    """Per leaf the digest of its proof, and the root that its changed digest (its own, if null) folds to."""
    fields = {f.name: f for f in blocks.schema["members"].dataType.elementType.fields}

    def run(batches: Iterator) -> Iterator:
        import hashlib
        from binascii import hexlify

        for batch in batches:
            for size, members, nodes, path, subroot, root in zip(*(batch.column(c).to_pylist() for c in (
                    "size", "members", "nodes", "path", "subroot", "root"))):
                upper = _as_path(path)
                tail = b"".join(left + right for left, right in upper)
                proofs, roots = [], []
                for member, own in zip(members, _own_paths(size, len(members), nodes)):
                    proofs.append(hashlib.sha256(b"".join(left + right for left, right in own) + tail).hexdigest())
                    leaf = member["digest"] if member[changed] is None else member[changed]
                    roots.append(veb.folded(veb.folded(hexlify(leaf), own), upper).decode())
                n, root = len(members), hexlify(root).decode()
                yield pa.RecordBatch.from_arrays([
                    pa.array([m[key] for m in members], kind), pa.array([hexlify(m["digest"]).decode() for m in members]),
                    pa.array([hexlify(subroot).decode()] * n), pa.array([root] * n), pa.array(proofs), pa.array(roots),
                    pa.array([r == root for r in roots]),
                ], names)

    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(fields[key].dataType)
    names = [key, "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return blocks.select("size", "members", "nodes", "path", "subroot", "root").mapInArrow(
        run, f"{key} {fields[key].dataType.simpleString()}, leaf string, subroot string, root string, proof_sha256 string,"
             " folded_root string, verified boolean")


def verified_documents(documents: DataFrame) -> DataFrame:
    """The manifest of `documents` by source, checked against texts that lost their line breaks."""
    columns = [F.col(c) for c in FIELDS]
    without = [*columns[:-1], F.replace(F.col("text").cast("string"), F.lit("\n"), F.lit(""))]
    hit = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    leaves = store(documents.select(
        "doc_id", F.col("source").cast("string").alias("source"), leaf_digest(columns).alias("digest"),
        F.when(hit, leaf_digest(without)).alias("tampered")), "leaves")
    return checked(manifest(leaves, "source", ["doc_id"], keep=["doc_id", "tampered"]), "doc_id", "tampered")


def sql() -> str:
    """The same rows for DuckDB: levels by recursion, CRC-32 by its table."""
    fields = " || ".join(
        f"coalesce(strlen(cast({c} as varchar)) || ':' || cast({c} as varchar), '-')" for c in FIELDS[:-1])
    text = "coalesce(strlen({0}) || ':' || {0}, '-')"
    fold = """sha256(string_agg(case when u.idx = f.idx then f.digest else u.digest end, '' order by u.idx))"""
    return f"""
with recursive crc_table as (
  select list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k:
    case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i)) as t),
leaves as (
  select row_number() over () as row, doc_id, source, sha256({fields} || {text.format('text')}) as leaf,
    sha256({fields} || {text.format("replace(text, chr(10), '')")}) as without,
    xor(4294967295, list_reduce(string_split(cast(doc_id as varchar), ''),
      lambda c, d: xor(c >> 8, t[(xor(c, ascii(d)) & 255) + 1]), 4294967295)) % 2 = 0 as hit
  from documents, crc_table),
numbered as (
  select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as idx,
    count(*) over (partition by source) as n, case when hit then without else leaf end as given
  from leaves),
up as (
  select source, 0 as level, idx, leaf as digest, n from numbered
  union all
  select source, level + 1, idx // 3, sha256(string_agg(digest, '' order by idx)), (max(n) + 2) // 3
  from up where n > 1 group by source, level, idx // 3),
subroots as (
  select source, digest as subroot, row_number() over (order by source nulls first) - 1 as idx, count(*) over () as n
  from up where n = 1),
top as (
  select 0 as level, idx, subroot as digest, n from subroots
  union all
  select level + 1, idx // 3, sha256(string_agg(digest, '' order by idx)), (max(n) + 2) // 3
  from top where n > 1 group by level, idx // 3),
root as (select digest as root from top where n = 1),
heights as (select max(level) as high, source from up group by source),
own as (
  select row, string_agg(u.digest, '' order by u.level, u.idx) as proof
  from numbered d join up u on u.source is not distinct from d.source and u.n > 1
    and u.idx // 3 = d.idx // cast(pow(3, u.level + 1) as bigint) and u.idx <> d.idx // cast(pow(3, u.level) as bigint)
  group by row),
above as (
  select s.source, string_agg(u.digest, '' order by u.level, u.idx) as proof
  from subroots s join top u on u.n > 1
    and u.idx // 3 = s.idx // cast(pow(3, u.level + 1) as bigint) and u.idx <> s.idx // cast(pow(3, u.level) as bigint)
  group by s.source),
folds as (
  select row, source, 0 as level, idx, given as digest, n from numbered
  union all
  select f.row, f.source, f.level + 1, f.idx // 3, {fold}, (max(f.n) + 2) // 3
  from folds f join up u on u.source is not distinct from f.source and u.level = f.level and u.idx // 3 = f.idx // 3
  where f.n > 1 group by f.row, f.source, f.level, f.idx),
ends as (
  select f.row, 0 as level, s.idx, f.digest, s.n from folds f join subroots s on s.source is not distinct from f.source
  where f.n = 1
  union all
  select f.row, f.level + 1, f.idx // 3, {fold}, (max(f.n) + 2) // 3
  from ends f join top u on u.level = f.level and u.idx // 3 = f.idx // 3
  where f.n > 1 group by f.row, f.level, f.idx)
select d.doc_id, d.leaf, s.subroot, root, sha256(coalesce(o.proof, '') || coalesce(a.proof, '')) as proof_sha256,
  e.digest as folded_root, e.digest = root as verified
from numbered d join subroots s on s.source is not distinct from d.source cross join root
left join own o on o.row = d.row left join above a on a.source is not distinct from d.source
join ends e on e.row = d.row and e.n = 1"""
