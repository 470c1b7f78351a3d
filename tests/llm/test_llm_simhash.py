"""SimHash components against all pairs."""

import random

import pytest
import xxhash

from datadict.llm import simhash
from datadict.llm.tables import Scratch

SCHEMA = "doc_id long, text string"


def plain(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in lowered + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    if not words:
        return 0
    runs = [words[i:i + 3] for i in range(len(words) - 2)] if len(words) >= 3 else [words]
    hashes = [xxhash.xxh64_intdigest(" ".join(r).encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(numbers):
    """Per distinct number the smallest one it can reach."""
    numbers = sorted(set(numbers))
    root = {n: n for n in numbers}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(numbers):
        for b in numbers[:i]:
            if (a ^ b).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in numbers}


def expected(rows):
    prints = [plain(t) for _, t in rows]
    root = roots(prints)
    least = {}
    for (doc, _), p in zip(rows, prints):
        if doc is not None:
            least[root[p]] = min(least.get(root[p], doc), doc)
    return sorted(((doc, f"{p:016x}", least.get(root[p])) for (doc, _), p in zip(rows, prints)), key=repr)


def got(df):
    return sorted((tuple(r) for r in simhash.near_duplicates(df).select("doc_id", "fingerprint", "component_id").collect()), key=repr)


def clustered(seed, n):
    """Numbers in chains, in dense balls, and alone."""
    rng = random.Random(seed)
    out = [rng.getrandbits(64) for _ in range(n)]
    for i in range(n):
        x = out[rng.randrange(8)] if i % 2 else out[-1]
        for _ in range(rng.randrange(1, 6)):
            x ^= 1 << rng.randrange(64)
        out.append(x)
    return out


@pytest.mark.parametrize("piece", [1, 7, 1 << 18])
def test_fingerprint(monkeypatch, piece):
    monkeypatch.setattr(simhash, "PIECE", piece)
    rng = random.Random(piece)
    for size in (0, 1, 2, 3, 4, 50, 400):
        text = "".join(rng.choice(["Ab", "ß", "漢字", "x9", "É"]) + rng.choice([" ", "\t\n", "\x0b", "  ", "\x85"]) for _ in range(size))
        assert simhash.fingerprint(text.encode()) == plain(text)


def test_tree():
    numbers = sorted(set(clustered(1, 300)))
    tree = simhash.BKTree()
    for n in numbers:
        tree.add(n)
    for q in numbers[::7] + [0]:
        assert sorted(tree.near(q, 3)) == [n for n in numbers if (n ^ q).bit_count() <= 3]


@pytest.mark.parametrize("shard", [512, 6])
def test_links(spark, monkeypatch, shard):
    monkeypatch.setattr(simhash, "SHARD", shard)
    numbers = set(clustered(2, 500)) | {x ^ 5 for x in range(300)}  # the last ones are all near each other
    df = spark.createDataFrame([(simhash._signed(n),) for n in numbers], "fp long")
    found = [(r["a"] & (1 << 64) - 1, r["b"] & (1 << 64) - 1) for r in simhash.links(df, Scratch(spark)).collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in found)
    root = {n: n for n in numbers}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in found:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert {n: find(n) for n in numbers} == roots(numbers)


def test_documents(spark):
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(400)}"
    base = [word() for _ in range(300)]
    rows = [(None, "a b c d"), (5, "A B C\td"), (5, "a b c d"), (7, None), (6, ""), (9, " \n"), (8, "One two"), (4, "one TWO")]
    for i in range(120):
        words = list(base) if i % 3 == 0 else [word() for _ in range(rng.randrange(1, 60))]
        if i % 3 == 0 and i:
            words[rng.randrange(len(words))] = "Other" + str(i)
        rows.append((100 + i, " ".join(words)))
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", fp string, id int").repartition(5)
    want = expected(rows)
    assert got(df) == want and len({c for _, _, c in want}) < len(rows) - 20


def test_edges(spark):
    assert got(spark.createDataFrame([], SCHEMA)) == []
    long = "tail Word " * 400_000
    rows = [(3, long), (2, long), (1, None), (None, "x")]
    assert [r[2] for r in got(spark.createDataFrame(rows, SCHEMA))] == [1, 2, 2, None]
