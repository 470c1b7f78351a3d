"""Passages that repeat across documents, exact or fuzzy, by seeds, chains and alignment.

* A seed is a pair of word runs with a gap between them: a run of `GRAM` words of smallest hash in a
  sliding window, and the run of smallest hash among the `REACH` after it. A word dropped or inserted between
  the two leaves the seed as it was; an equal run of `NEAR + REACH + 2 * GRAM` words always has one. Copies of
  a text are one text.
* Each seed names one reference, the text of smallest key that has it, found by a minimum per seed. All
  other texts with the seed meet the reference only, so the matches are as many as the seeds.
* The matches of a text with a reference are chained where both positions grow. A chain gains the
  length of a seed per match and pays for the words it skips in either text; the best predecessor comes
  from a Fenwick tree of prefix maxima over the reference's positions.
* A chain is aligned word by word along its diagonals, with a longest common subsequence where it changes
  diagonal, and extended at both ends, with gaps, while enough words agree. The extension first sees the words
  near the chain; chains that use them up are extended again with more, until none does. Passages of `min_words`
  or more that agree in `identity` of their words are kept.

Defined results: null and empty texts have no passages; a copy of a text is one passage over all its
words, if it has `min_words`, and has the passages of its text as well; rows of equal id and equal text
are one document; a null id is larger than any other; an empty table gives an empty one. Positions count
words, runs of other bytes than blank, tab, newline, vertical tab, form feed and return.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datadict.llm.tables import Scratch, bit_field, in_field, slot_of
from datadict.llm.words import mix64, text_slices, windows, words_of
from datadict.storage import store

GRAM = 3
SEED = 2 * GRAM
NEAR = 7
REACH = 12
GAP_COST = 0.05
FLANK, WIDER = 64, 8  # words seen at first on both sides of a chain, and how many times more in each further round
DROP = 12
APART = 16
MIN_WORDS = 50
IDENTITY = 0.8
PASSAGE_BATCH = 512


def _least(values: np.ndarray, size: int) -> np.ndarray:
    """Per window of `size` values the position of the smallest, the last of equal ones, by windows of doubled size."""
    at, width = np.arange(len(values)), 1
    while width < size:
        step = min(width, size - width)
        left, right = at[:-step], at[step:]
        at = np.where(values[right] <= values[left], right, left)
        width += step
    return at


def paired_seeds(grams: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Seeds, the number of their text and their position there, from the hashes of the texts' runs of `GRAM` words.

    The runs of a text are `grams[begin:end]`. All texts are laid out in one array with largest values after each,
    so that no window sees the next text.
    """
    kept = np.flatnonzero(ends - begins > GRAM)
    if not len(kept):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    sizes, pad, largest = (ends - begins)[kept], max(NEAR, REACH), np.iinfo(np.uint64).max
    place = np.cumsum(sizes + pad) - sizes - pad

    def spread(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return np.arange(counts.sum()) + np.repeat(first - np.cumsum(counts) + counts, counts)

    laid = np.full(int((sizes + pad).sum()), largest, np.uint64)
    laid[spread(place, sizes)] = grams[spread(begins[kept], sizes)]
    firsts = laid.copy()  # the last runs of a text have none after them
    for k in range(1, GRAM + 1):
        firsts[place + sizes - k] = largest
    seen = np.maximum(sizes - GRAM - NEAR + 1, 1)
    at = np.minimum(_least(firsts, NEAR)[spread(place, seen)], np.repeat(place + sizes - GRAM - 1, seen))
    at = at[np.r_[True, at[1:] != at[:-1]]]
    second = laid[_least(laid, REACH)[at + GRAM]]
    text = np.searchsorted(place, at, side="right") - 1
    return mix64(mix64(laid[at]) + second), kept[text], at - place[text]


def _seeds(texts: DataFrame) -> DataFrame:
    """`seed`, `key`, `at`. Equal texts of one task give their seeds once."""

    def run(batches: Iterator) -> Iterator:
        seen: set[int] = set()
        for batch in batches:
            keys = batch.column(0).to_numpy()
            fresh = np.zeros(len(keys), bool)
            for i, k in enumerate(keys.tolist()):
                if k not in seen:
                    seen.add(k)
                    fresh[i] = True
            batch, keys = batch.filter(pa.array(fresh)), keys[fresh]
            for first, data, offsets in text_slices(batch.column(1)):
                words = words_of(data, offsets, True)
                grams = windows(words.hash, GRAM)
                seed, text, at = paired_seeds(grams, words.bounds[:-1], words.bounds[1:] - GRAM + 1)
                yield pa.RecordBatch.from_arrays([
                    pa.array(seed.view(np.int64)), pa.array(keys[first + text]), pa.array(at.astype(np.int32))], ["seed", "key", "at"])

    return texts.select("key", "text").mapInArrow(run, "seed bigint, key bigint, at int")


class PrefixMaxima:
    """Fenwick tree: the largest value set at positions below a bound, with its owner."""

    def __init__(self, size: int) -> None:
        self.best = [(float("-inf"), -1)] * (size + 1)

    def put(self, at: int, value: float, owner: int) -> None:
        at += 1
        while at < len(self.best):
            if value > self.best[at][0]:
                self.best[at] = (value, owner)
            at += at & -at

    def below(self, at: int) -> tuple[float, int]:
        found = (float("-inf"), -1)
        while at:
            if self.best[at][0] > found[0]:
                found = self.best[at]
            at -= at & -at
        return found


def chains(matches: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """Disjoint collinear chains of (position, reference position), the best first.

    score(j) = SEED + max(0, max over i before j in both texts of score(i) - GAP_COST * words skipped).
    The cost is a difference of sums of positions, so the inner maximum is one prefix query. Matches of
    equal position are asked before any of them is entered.
    """
    matches = sorted(set(matches))
    ranks = {r: i for i, r in enumerate(sorted({m[1] for m in matches}))}
    tree, score, parent, waiting = PrefixMaxima(len(ranks)), [], [], []
    for j, (at, ref) in enumerate(matches):
        if waiting and matches[waiting[0]][0] != at:
            for i in waiting:
                a, r = matches[i]
                tree.put(ranks[r], score[i] + GAP_COST * (a + r), i)
            waiting = []
        value, owner = tree.below(ranks[ref])
        gain = value - GAP_COST * (at + ref)
        score.append(SEED + max(0.0, gain))
        parent.append(owner if gain > 0 else -1)
        waiting.append(j)
    used, out = [False] * len(matches), []
    for j in sorted(range(len(matches)), key=lambda i: -score[i]):
        chain = []
        while j >= 0 and not used[j]:
            used[j] = True
            chain.append(matches[j])
            j = parent[j]
        if chain:
            out.append(chain[::-1])
    return out


def runs_of(chain: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """A chain as runs of constant diagonal: position, reference position, words."""
    out: list[tuple[int, int, int]] = []
    for at, ref in chain:
        if out:
            a, r, n = out[-1]
            if at - a == ref - r:
                out[-1] = (a, r, at - a + GRAM)
                continue
            skip = max(0, a + n - at, r + n - ref)  # a seed that overlaps the run before it starts later
            if skip < GRAM:
                out.append((at + skip, ref + skip, GRAM - skip))
        else:
            out.append((at, ref, GRAM))
    return out


def _chained(matches: DataFrame) -> DataFrame:
    """One row per pair of texts: key, ref, the extent of all chains in both, and each chain's runs as flat numbers, the best first."""

    def run(batches: Iterator) -> Iterator:
        def written(key: int, ref: int, group: list) -> tuple:
            found = [runs_of(chain) for chain in chains(group)]
            return (key, ref, min(c[0][0] for c in found), max(c[-1][0] + c[-1][2] for c in found), min(c[0][1] for c in found),
                    max(c[-1][1] + c[-1][2] for c in found), [[v for run in c for v in run] for c in found])

        names = ["key", "ref", "a", "a_end", "b", "b_end", "runs"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.list_(pa.int32()))]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows) if rows else [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)

        pair, group, rows = None, [], []
        for batch in batches:
            for key, ref, at, ref_at in zip(*(batch.column(c).to_pylist() for c in ("key", "ref", "at", "ref_at"))):
                if pair != (key, ref):
                    if group:
                        rows.append(written(*pair, group))
                    pair, group = (key, ref), []
                group.append((at, ref_at))
            yield batch_of(rows)
            rows = []
        if group:
            yield batch_of([written(*pair, group)])

    dealt = matches.repartition("key", "ref").sortWithinPartitions("key", "ref")
    return dealt.mapInArrow(run, "key bigint, ref bigint, a int, a_end int, b int, b_end int, runs array<array<int>>")


# Words skipped in either text before two agree again, the cheapest first.
STEPS = sorted(((i, j) for i in range(5) for j in range(5) if i or j), key=lambda s: (max(s), s != (1, 1), sum(s), s))


def grown(x: list[int], y: list[int]) -> tuple[int, int, int, bool]:
    """How far an end grows into both texts, the words that agree there, and whether it used up a text.

    Up to the best sum of +1 per equal word and -2 per step over others, before it falls by more than DROP.
    """
    i = j = total = equal = 0
    best = (0, 0, 0, 0)
    last_x, last_y = len(x) - 1, len(y) - 1
    while i < len(x) and j < len(y):
        if x[i] == y[j]:
            i, j, total, equal = i + 1, j + 1, total + 1, equal + 1
            if total > best[0]:
                best = (total, i, j, equal)
            continue
        for dx, dy in STEPS:
            p, q = i + dx, j + dy
            if p < last_x and q < last_y and x[p] == y[q] and x[p + 1] == y[q + 1]:
                break
        else:
            dx = dy = 1
        i, j, total = i + dx, j + dy, total - 2 * max(dx, dy)
        if best[0] - total > DROP:
            return *best[1:], False
    return *best[1:], True


def equal_between(x: list[int], y: list[int]) -> int:
    """The most words of two stretches that can be equal in order, by rows of bits."""
    at: dict[int, int] = {}
    for j, w in enumerate(y):
        at[w] = at.get(w, 0) | 1 << j
    full = v = (1 << len(y)) - 1
    for w in x:
        u = v & at.get(w, 0)
        v = ((v + u) | (v - u)) & full
    return len(y) - v.bit_count()


def equal_along(x: np.ndarray, y: np.ndarray) -> int:
    """Equal words of two stretches on one diagonal. A part that leaves it and returns is aligned: from a differing
    word to the last one that has another within `APART` words before it."""
    other = np.flatnonzero(x != y)
    if not len(other):
        return len(x)
    cuts = np.flatnonzero(np.diff(other) > APART)
    equal = len(x)
    for a, z in zip(other[np.r_[0, cuts + 1]], other[np.r_[cuts, len(other) - 1]] + 1):
        equal -= z - a
        if z - a > 1:
            equal += equal_between(x[a:z].tolist(), y[a:z].tolist())
    return int(equal)


class Side(NamedTuple):
    """The words of a text that a chain sees: from which of the text's on, and how many the text has."""

    words: np.ndarray
    at: int
    total: int


def aligned(runs: list[tuple[int, int, int]], x: Side, y: Side) -> tuple[int, int, int, int, int, bool]:
    """Begin and end in both texts, the equal words, and whether an end needs words that the sides leave out."""
    equal, end = 0, None
    for a, r, n in runs:
        a, r = a - x.at, r - y.at
        equal += equal_along(x.words[a:a + n], y.words[r:r + n])
        if end:
            equal += equal_between(x.words[end[0]:a].tolist(), y.words[end[1]:r].tolist())
        end = (a + n, r + n)
    a, r = runs[0][0] - x.at, runs[0][1] - y.at
    back_x, back_y, more, used = grown(x.words[:a][::-1].tolist(), y.words[:r][::-1].tolist())
    equal += more
    short = used and ((x.at > 0 and a <= r + len(STEPS)) or (y.at > 0 and r <= a + len(STEPS)))
    on_x, on_y, more, used = grown(x.words[end[0]:].tolist(), y.words[end[1]:].tolist())
    equal += more
    left_x, left_y = x.total - x.at - len(x.words), y.total - y.at - len(y.words)
    rest_x, rest_y = len(x.words) - end[0], len(y.words) - end[1]
    short = short or (used and ((left_x > 0 and rest_x <= rest_y + len(STEPS)) or (left_y > 0 and rest_y <= rest_x + len(STEPS))))
    return a - back_x + x.at, end[0] + on_x + x.at, r - back_y + y.at, end[1] + on_y + y.at, equal, short


def _word_codes(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """`of`, `words`: 32-bit word hashes of the texts named by `keys` (of). Others are kept out by a filter of fixed size."""
    held = texts.sparkSession.sparkContext.broadcast(bit_field(keys, "of"))

    def run(batches: Iterator) -> Iterator:
        seen: set[int] = set()
        for batch in batches:
            wanted = in_field(held.value, batch.column(0).to_numpy())
            fresh = []
            for k, w in zip(batch.column(1).to_pylist(), wanted.tolist()):
                fresh.append(w and k not in seen)
                if w:
                    seen.add(k)
            batch = batch.filter(pa.array(fresh, pa.bool_()))
            for first, data, offsets in text_slices(batch.column(2)):
                words = words_of(data, offsets, True)
                codes = (words.hash >> np.uint64(32)).astype("<u4")
                count = len(offsets) - 1
                yield pa.RecordBatch.from_arrays([
                    batch.column(1).slice(first, count),
                    pa.array([codes[words.bounds[i]:words.bounds[i + 1]].tobytes() for i in range(count)], pa.binary()),
                ], ["of", "words"])

    made = texts.select(slot_of(F.col("key")).alias("slot"), "key", "text").mapInArrow(run, "of bigint, words binary")
    return made.join(keys, "of").dropDuplicates(["of"])


def _passages(chained: DataFrame, words: DataFrame, min_words: int, identity: float, flank: int) -> DataFrame:
    """Chains (stored) as aligned passages: key, ref, and begin and length in words in both texts.

    The best chain of a pair is aligned first, and chains that lie inside a passage of the pair are part of
    it. `short` is one row for a pair for which `flank` words were too few.
    """

    def cut(side: str, name: str) -> list:
        begin = f"greatest(0L, {side} - {flank}L)"
        return [F.expr(begin).alias(f"{name}_at"), F.expr("octet_length(words) div 4").alias(f"{name}_total"),
                F.expr(f"substring(words, int(4 * {begin} + 1), int(least(2147483647L, 4 * ({side}_end + {flank}L - {begin}))))").alias(name)]

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                x, y = (Side(np.frombuffer(row[n], "<u4"), row[f"{n}_at"], row[f"{n}_total"]) for n in ("x", "y"))
                spans, kept = [], []
                for flat in row["runs"]:
                    runs = [tuple(flat[i:i + 3]) for i in range(0, len(flat), 3)]
                    (first, ref_first, _), (last, ref_last, n) = runs[0], runs[-1]
                    if any(a <= first and last + n <= z and b <= ref_first and ref_last + n <= w for a, z, b, w in spans):
                        continue
                    a, a_end, b, b_end, equal, short = aligned(runs, x, y)
                    if short:
                        kept = [(row["key"], row["ref"], 0, 0, 0, 0, 0.0, True)]
                        break
                    longest = max(a_end - a, b_end - b)
                    if a_end - a >= min_words and equal >= identity * longest:
                        spans.append((a, a_end, b, b_end))
                        kept.append((row["key"], row["ref"], a, a_end - a, b, b_end - b, equal / longest, False))
                rows += kept
            columns = list(zip(*rows)) if rows else [[]] * 8
            kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 4, pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], [
                "key", "ref", "start_word", "n_words", "ref_start_word", "ref_n_words", "identity", "short"])

    kept = ["key", "ref", "runs"]
    left = chained.join(words, chained["key"] == words["of"]).select(*kept, "b", "b_end", *cut("a", "x"))
    both = left.join(words, left["ref"] == words["of"]).select(*kept, "x_at", "x_total", "x", *cut("b", "y"))
    return both.mapInArrow(run, """key bigint, ref bigint, start_word int, n_words int,
        ref_start_word int, ref_n_words int, identity double, short boolean""")


def repeated_passages(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS,
                      identity: float = IDENTITY) -> DataFrame:
    """One row per document and passage that it shares with a reference document."""
    spark = documents.sparkSession
    scratch = Scratch(spark)
    body = F.col(f"`{text}`").cast("string")
    texts = documents.select(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(body).alias("key"), body.alias("text")).where(
        F.col("text") != "")
    words_in = F.size(F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""))
    names = scratch.store(texts.select("doc_id", "key", words_in.alias("words")).distinct(), "names")
    first = names.groupBy("key").agg(F.min("doc_id").alias("first_id"), F.first("words").alias("words"))
    seeds = _seeds(texts)
    shared = seeds.groupBy("seed").agg(F.min(F.struct("key", "at")).alias("least"), F.max("key").alias("most")).where(
        "least.key <> most").select(F.col("seed").alias("of"), F.col("least.key").alias("ref"), F.col("least.at").alias("ref_at"))
    matches = seeds.join(shared, seeds["seed"] == shared["of"]).where("key <> ref").select("key", "ref", "at", "ref_at")
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    try:
        chained = scratch.store(_chained(matches), "chained")
        keys = scratch.store(chained.select(F.col("key").alias("of")).union(chained.select("ref")).distinct(), "keys")
        codes = scratch.store(_word_codes(texts, keys), "codes")
        spark.conf.set(setting, PASSAGE_BATCH)
        flank, left, rounds = FLANK, chained, []
        while True:
            made = scratch.store(_passages(left, codes, min_words, identity, flank), "found")
            rounds.append(made.where("not short").drop("short"))
            if made.where("short").isEmpty():
                break
            left = chained.join(made.where("short").select("key", "ref"), ["key", "ref"], "left_semi")
            flank *= WIDER
        found = reduce(DataFrame.unionByName, rounds)
    finally:
        spark.conf.set(setting, before)
    refs = first.select(F.col("key").alias("ref"), F.col("first_id").alias("ref_doc_id"))
    shown = found.join(refs, "ref")
    columns = ["start_word", "n_words", "ref_doc_id", "ref_start_word", "ref_n_words", "identity"]
    shown = shown.select(F.col("key").alias("of"), *columns)
    own = names.join(shown, names["key"] == shown["of"]).select("doc_id", *columns)
    copied = names.join(first.select(F.col("key").alias("of"), "first_id"), F.col("key") == F.col("of")).where(
        (F.col("words") >= min_words) & ~F.col("doc_id").eqNullSafe(F.col("first_id")))
    whole = copied.select("doc_id", F.lit(0).alias("start_word"), F.col("words").alias("n_words"), F.col("first_id").alias("ref_doc_id"),
                          F.lit(0).alias("ref_start_word"), F.col("words").alias("ref_n_words"), F.lit(1.0).alias("identity"))
    out = store(own.union(whole), "passages")
    scratch.clear()
    return out
