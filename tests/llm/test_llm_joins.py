"""The n-gram join, repeated passages and packing against brute force."""

import bisect
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from datadict.llm import ngram_join, packing, substring
from datadict.llm.components import components
from datadict.llm.tables import Scratch
from datadict.llm import words as words_module
from datadict.llm.tokens import default_tokenizer, id_encoder
from datadict.llm.words import text_slices, words_of


def corpus(seed, n=60):
    """Texts of a small vocabulary with copies, near copies and shared passages."""
    rng = random.Random(seed)
    word = lambda: rng.choice("ab") + str(rng.randrange(300))
    texts = [None, "", "  ", "One", "one", "two words"]
    base = [word() for _ in range(90)]
    passage = [word() for _ in range(60)]
    for i in range(n):
        w = [word() for _ in range(rng.randrange(1, 120))]
        if i % 3 == 0:
            w = list(base)
            for _ in range(rng.randrange(5)):
                w[rng.randrange(len(w))] = word()
        elif i % 5 == 0:
            w[len(w) // 2:len(w) // 2] = passage
        texts.append(" ".join(w))
    return [(i, t) for i, t in enumerate(texts + texts[8:14])]


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def linked(rows, k, percent):
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {(rows[i][0], len(sets[i]), rows[find(i)][0]) for i in range(len(rows))}


@pytest.mark.parametrize("seed, k, percent, block", [(1, 3, 90, 2048), (2, 5, 80, 5)])
def test_components(spark, monkeypatch, seed, k, percent, block):
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", block)
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = ngram_join.joined(df, ngram_join.Bound(k, percent))
    assert {(r["doc_id"], r["n"], r["component_id"]) for r in got.collect()} == linked(rows, k, percent)


def test_join_edges(spark):
    rows = [(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (5, None), (6, "x"), (7, "x y " * 9000)]
    got = ngram_join.joined(spark.createDataFrame(rows, "doc_id long, text string"), ngram_join.Bound(3, 90)).collect()
    assert Counter((r["doc_id"], r["n"], r["component_id"]) for r in got) == Counter(
        [(None, 2, 5), (5, 2, 5), (5, 2, 5), (5, 0, 5), (6, 1, 6), (7, 2, 7)])
    assert ngram_join.joined(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_links(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(2000 + rng.randrange(80), 2000 + rng.randrange(80)) for _ in range(60)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long"), Scratch(spark)).collect()}
    near = defaultdict(set)
    for a, b in links:
        near[a].add(b), near[b].add(a)
    for start in near:
        seen, todo = {start}, [start]
        while todo:
            for x in near[todo.pop()] - seen:
                seen.add(x), todo.append(x)
        if len(seen) > 1:
            assert got[start] == min(seen)


def test_passages_cover_shared_runs(spark):
    rows = corpus(3)
    got = substring.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    words = {i: (t or "").encode().lower().split() for i, t in rows}
    where = defaultdict(set)
    for i, w in words.items():
        for k in range(len(w) - 49):
            where[tuple(w[k:k + 50])].add(i)
    spans = defaultdict(list)
    for r in got:
        spans[r["doc_id"]].append((r["start_word"], r["start_word"] + r["n_words"]))
        spans[r["ref_doc_id"]].append((r["ref_start_word"], r["ref_start_word"] + r["ref_n_words"]))
        assert r["n_words"] >= 50 and r["identity"] >= 0.8 and r["doc_id"] != r["ref_doc_id"]
    shared = [(i, k) for i, w in words.items() for k in range(len(w) - 49) if len(where[tuple(w[k:k + 50])]) > 1]
    assert shared and all(any(a <= k + 2 and k + 48 <= b for a, b in spans[i]) for i, k in shared)
    unique = {i for i, w in words.items() if len(w) < 50}
    assert not unique & set(spans)


def test_seeds_against_their_definition():
    """Texts side by side in one array have the seeds that each has alone; equal hashes take the last."""
    rng = np.random.default_rng(7)
    for values in (4, 60, 1 << 40) * 10:
        ends = np.cumsum(rng.integers(0, 45, 30))
        begins = np.r_[0, ends[:-1]]
        ends = ends - rng.integers(0, 4, 30)  # what lies between two texts belongs to none
        grams = rng.integers(0, values, 2000).astype(np.uint64)
        wanted = []
        for i, (a, b) in enumerate(zip(begins.tolist(), ends.tolist())):
            text = grams[a:b].tolist() if b > a else []
            last, found = len(text) - substring.GRAM, set()
            for w in range(max(last - substring.NEAR + 1, 1) if last > 0 else 0):
                found.add(max(range(w, min(w + substring.NEAR, last)), key=lambda p: (-text[p], p)))
            for p in sorted(found):
                second = min(text[p + substring.GRAM:p + substring.GRAM + substring.REACH])
                wanted.append((int(words_module.mix64(words_module.mix64(np.array([text[p]], np.uint64)) + np.uint64(second))[0]), i, p))
        got = [x.tolist() for x in substring.paired_seeds(grams, begins, ends)]
        assert list(zip(*got)) == wanted


def test_passage_edges(spark):
    schema = "doc_id long, text string, `ref` string, `seed` string"
    rows = [(None, "w%d " % 1 * 60, "", ""), (1, None, "", ""), (2, "", "", ""), (2, "", "", "")]
    assert substring.repeated_passages(spark.createDataFrame(rows, schema)).count() == 0
    assert substring.repeated_passages(spark.createDataFrame([], schema)).count() == 0
    text = " ".join(f"w{i}" for i in range(70))
    got = substring.repeated_passages(spark.createDataFrame([(None, text, "", ""), (4, text, "", ""), (9, text, "", "")], schema)).collect()
    assert {(r["doc_id"], r["ref_doc_id"], r["n_words"]) for r in got} == {(None, 4, 70), (9, 4, 70)}


def test_chains_are_best():
    """The best chain's score against all increasing chains, tried one by one."""
    rng = random.Random(7)
    for _ in range(200):
        matches = list({(rng.randrange(60), rng.randrange(60)) for _ in range(rng.randrange(1, 9))})

        def score(chain):
            total = substring.SEED
            for (a, r), (b, s) in zip(chain, chain[1:]):
                total += substring.SEED - substring.GAP_COST * (b - a + s - r)
            return total

        best = [0.0]

        def grow(chain):
            best[0] = max(best[0], score(chain))
            for m in matches:
                if m[0] > chain[-1][0] and m[1] > chain[-1][1]:
                    grow([*chain, m])

        for m in matches:
            grow([m])
        found = substring.chains(matches)
        assert abs(max(map(score, found)) - best[0]) < 1e-9
        assert sorted(x for c in found for x in c) == sorted(matches)


# --- packing ------------------------------------------------------------------------------------

def naive(lengths, capacity):
    room = []
    for n in sorted(lengths, reverse=True):
        i = bisect.bisect_left(room, n)
        bisect.insort(room, (room.pop(i) if i < len(room) else capacity) - n)
    return room


def test_best_fit_decreasing_equals_one_by_one():
    rng = random.Random(1)
    for _ in range(200):
        capacity = rng.choice([8, 33, 64])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randrange(150))]
        filled = Counter()
        for s in packing.best_fit_decreasing(Counter(lengths), capacity):
            for i in range(s.items):
                at = s.bin + i // s.per_bin
                assert filled[at] == s.offset + i % s.per_bin * s.length
                filled[at] += s.length
        assert sorted(capacity - v for v in filled.values()) == naive(lengths, capacity)


def test_packed_documents(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(default_tokenizer())
    rows = [(1, "Hello, world."), (2, None), (2, ""), (None, "x"), (3, "many words " * 1500), (4, "a" * 5000), (4, "a" * 5000)]
    rows += [(i, "équal lengths here") for i in range(10, 60)]
    got = packing.packed_documents(spark.createDataFrame([(*r, 0, "") for r in rows], "doc_id long, text string, length int, rank string")).collect()
    want = Counter()
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            want[i, k // 2048, k, len(ids[k:k + 2048]), zlib.crc32(np.array(ids[k:k + 2048], "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    held = defaultdict(list)
    for r in got:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in held.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048
    assert packing.packed_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_other_tokenizers_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError, match="not a lower-casing tokenizer"):
        id_encoder(public_tokenizers.path("byte_bpe_50k.json"))


def test_words_of_long_texts(monkeypatch):
    """Pieces and cut words give the hashes that one piece gives."""
    import pyarrow as pa

    rng = random.Random(8)
    texts = ["".join(rng.choice("aB é\n") for _ in range(n)) + "x" * m for n, m in ((0, 0), (5, 0), (3000, 40), (900, 700), (0, 9))]
    for longest in (0, 7):
        for size in (64, 1 << 18):
            monkeypatch.setattr(words_module, "PIECE", size)
            made = [words_of(data, offsets, True, longest) for _, data, offsets in text_slices(pa.array(texts), 1 << 18)]
            assert len(made) == 1
            got = [made[0].hash[a:b].tolist() for a, b in zip(made[0].bounds, made[0].bounds[1:])]
            want = []
            for t in texts:
                raw = [w for w in t.encode().translate(bytes.maketrans(b"B", b"b")).split()]
                want.append([w[i:i + (longest or len(w))] for w in raw for i in range(0, len(w), longest or len(w))])
            assert [len(g) for g in got] == [len(w) for w in want]
            flat = {}
            for g, w in zip(sum(got, []), sum(want, [])):
                assert flat.setdefault(w, g) == g
            assert len(set(flat.values())) == len(flat)


def test_a_long_text_needs_little_memory():
    import tracemalloc

    import pyarrow as pa

    column = pa.array(["some words of a long text " * 400_000])  # 10 MB
    tracemalloc.start()
    for _, data, offsets in text_slices(column):
        words_of(data, offsets, True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30 * len(column[0].as_py())


def test_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    tokenizer, encode = Tokenizer.from_file(default_tokenizer()), id_encoder(None)
    rng = random.Random(2)
    bits = ["'", "'s", "s", "Bc", "É", "é", "T̈", "Σ", "İ", ".", ",", "...", ". ", " ", "\n", "\x1c", "\xa0", "12", "½",
            "<|", "<|endoftext|>", "<|EndOfText|>", "日本", "ﬁ", "ª", "̀", "x" * 70]
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(14)))
        assert encode([text])[0] == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text)


def edited(words, rng, kind):
    """A copy of a passage: exact, with a share of other words, or with words dropped and inserted."""
    out = []
    for i, w in enumerate(words):
        if kind == "indel" and i % 15 == 7:
            continue
        out.append(f"z{rng.randrange(10 ** 6)}" if isinstance(kind, float) and rng.random() < kind else w)
        if kind == "indel" and i % 15 == 14:
            out.append(f"z{rng.randrange(10 ** 6)}")
    return out


def test_recall_of_fuzzy_passages(spark):
    """Passages of 60 and 300 words, copied by several kinds of edits into other texts; clean texts stay out."""
    rng, rows, want = random.Random(11), [], {}
    common = [f"c{i}" for i in range(300)]
    words = lambda n: [rng.choice(common) if rng.random() < 0.5 else f"w{rng.randrange(20000)}" for _ in range(n)]
    for kind in ("exact", 0.05, 0.15, "indel"):
        for length in (60, 300):
            want[kind, length] = set()
            for _ in range(40):
                passage, at = words(length), len(rows)
                rows.append((at, " ".join(words(rng.randrange(200)) + passage + words(rng.randrange(200)))))
                rows.append((at + 1, " ".join(words(rng.randrange(200)) + edited(passage, rng, kind) + words(rng.randrange(200)))))
                want[kind, length].add((at, at + 1))
    clean = range(len(rows), len(rows) + 300)
    rows += [(i, " ".join(words(200))) for i in clean]
    got = substring.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    found = {tuple(sorted((r["doc_id"], r["ref_doc_id"]))): r for r in got}
    share = {k: sum(p in found for p in pairs) / len(pairs) for k, pairs in want.items()}
    assert set(found) <= set().union(*want.values())
    assert all(v == 1 for (kind, n), v in share.items() if kind == "exact" or n == 300), share
    assert share[0.05, 60] >= 0.9 and share["indel", 60] >= 0.8 and share[0.15, 60] >= 0.5, share  # few seeds are left
    for pair in want["exact", 300]:
        assert found[pair]["n_words"] >= 300 and found[pair]["identity"] > 0.9


def test_ends_of_any_length(spark, monkeypatch):
    """Chains cut out of one seed grow over the whole passage, whatever the words seen at first."""
    monkeypatch.setattr(substring, "FLANK", 4)
    monkeypatch.setattr(substring, "WIDER", 2)
    rng = random.Random(2)
    passage = [f"p{i}" for i in range(400)]
    rows = [(i, " ".join([f"x{i}{rng.randrange(10 ** 6)}" for _ in range(50)] + passage + [f"y{i}{rng.randrange(10 ** 6)}" for _ in range(50)])) for i in range(3)]
    got = substring.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["start_word"], r["n_words"], r["ref_start_word"], r["ref_n_words"], r["identity"]) for r in got} == {(50, 400, 50, 400, 1.0)}
    assert len(got) == 2


def test_stretches_against_a_table():
    rng = random.Random(5)
    for _ in range(500):
        x, y = ([rng.randrange(4) for _ in range(rng.randrange(12))] for _ in range(2))
        row = [0] * (len(y) + 1)
        for a in x:
            before = 0
            for j, b in enumerate(y, 1):
                before, row[j] = row[j], before + 1 if a == b else max(row[j], row[j - 1])
        assert substring.equal_between(x, y) == row[-1]
        i, j, equal, _ = substring.grown(x, y)
        assert equal <= substring.equal_between(x[:i], y[:j]) and i <= len(x) and j <= len(y)
