"""The Merkle manifest against a tree built level by level, and its layout."""

import hashlib
import random
import zlib

import pytest

from datadict.llm import merkle
from datadict.llm import veb_tree as veb

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels(row):
    out = [row]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i:i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def siblings(tree, i):
    for row in tree[:-1]:
        first = i - i % 3
        yield row[first:i], row[i + 1:first + 3]
        i //= 3


def expected(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append((row[0], h(*map(field, row)), row))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        groups[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees[name] = levels([leaf for _, leaf, _ in groups[name]])
    top = levels([trees[n][-1][0] for n in names])
    out = []
    for k, name in enumerate(names):
        for i, (doc, leaf, row) in enumerate(groups[name]):
            path = [*siblings(trees[name], i), *siblings(top, k)]
            node = leaf
            if doc is not None and zlib.crc32(str(doc).encode()) % 2 == 0 and row[4] is not None:
                node = h(*map(field, (*row[:4], row[4].replace("\n", ""))))
            for left, right in path:
                node = h(*left, node, *right)
            proof = h(*(s for left, right in path for s in (*left, *right)))
            out.append((doc, leaf, trees[name][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("height", range(1, 7))
def test_layout(height):
    places = [veb.place(height, d, i) for d in range(height) for i in range(3 ** d)]
    assert sorted(places) == list(range(veb.nodes_of(height)))
    if height > 2:  # each subtree of the lower half stands in one piece
        upper = height // 2
        for root in range(3 ** upper):
            own = [veb.place(height, upper + d, root * 3 ** d + i) for d in range(height - upper) for i in range(3 ** d)]
            assert max(own) - min(own) == len(own) - 1


@pytest.mark.parametrize("leaves", [1, 2, 3, 4, 9, 10, 27, 28, 80, 82])
def test_block(leaves):
    digests = [hashlib.sha256(bytes([i])).digest() for i in range(leaves)]
    want = levels([d.hex() for d in digests])
    block = veb.Block(veb.built(digests, veb.height(leaves)), leaves, veb.height(leaves))
    assert block.node(0, 0).decode() == want[-1][0]
    for i in range(leaves):
        assert [(a.decode(), b.decode()) for a, b in block.path(i)] == [("".join(a), "".join(b)) for a, b in siblings(want, i)]
        assert veb.folded(digests[i].hex().encode(), block.path(i)).decode() == want[-1][0]


def corpus(n, sources, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        name = "hot" if i % 3 == 0 else rng.choice(sources)
        text = rng.choice([None, "", "a\nb", "ß\n\n漢", f"t {i}", f"t {i}\n"])
        rows.append((None if i == 5 else rng.choice([i, i, -i]), name, rng.choice(["en", None]), rng.choice([i, None]), text))
    return rows + rows[:7]


def got(spark, rows, schema=SCHEMA):
    df = merkle.verified_documents(spark.createDataFrame(rows, schema).repartition(4))
    return sorted((tuple(r) for r in df.select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


@pytest.mark.parametrize("height, n", [(1, 60), (2, 400), (6, 900)])
def test_manifest(spark, monkeypatch, height, n):
    monkeypatch.setattr(merkle, "HEIGHT", height)
    monkeypatch.setattr(merkle, "BLOCK", 3 ** height)
    rows = corpus(n, [None, "", "a", "b", "é", "Z", *[f"s{i}" for i in range(12)]])
    assert got(spark, rows) == expected(rows)


def test_edges(spark):
    assert got(spark, []) == []
    one = [(1, None, None, None, None)]
    assert got(spark, one) == expected(one)
    rows = [(1, "x", "en", 3, "a\n" * 500_000), (1, "x", "en", 3, "a\n" * 500_000), (2, "y", None, None, "")]
    assert got(spark, [(*r, "p", 7) for r in rows], SCHEMA + ", `position` string, `group` int") == expected(rows)


def test_proofs_lead_to_the_root(spark):
    rows = corpus(300, ["a", "b", None])
    df = spark.createDataFrame(rows, SCHEMA)
    leaves = df.select("doc_id", "source", merkle.leaf_digest([df[c] for c in merkle.FIELDS]).alias("digest"))
    for r in merkle.proofs(merkle.manifest(leaves, "source", ["doc_id"], keep=["doc_id"]), ["doc_id"]).collect():
        assert veb.folded(r["leaf"].encode(), [(p["left"].encode(), p["right"].encode()) for p in r["path"]]).decode() == r["root"]
