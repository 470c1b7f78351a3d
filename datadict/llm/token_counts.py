"""Token counts that follow edits: only text near an edit is encoded again.

A document keeps a segment tree. Its leaves are runs of pre-tokens with their characters and tokens, its
inner nodes the sums. Byte-pair merges never cross a pre-token, and the pattern that splits pre-tokens
looks ahead by three characters at most and never back. So an edit leaves every leaf that ends three
characters or more before it as it is; encoding starts at the first leaf after these, and stops at the
first old leaf boundary behind the edit that is a boundary again. The region becomes one leaf, the other
leaves in it become empty, and the sums above them are updated. A leaf that has grown past `LARGEST`
pre-tokens is split by building the tree anew from the leaves, without encoding.

Defined results: a null text is empty and has no tokens; edits outside a text are moved to its ends; a
document without edits keeps its count; rows of equal id are rows of their own; an empty table gives an
empty one; special tokens' strings are ordinary text.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datadict.llm.tokens import text_groups

RANKS = "byte_bpe_50k.tiktoken"
LEAF = 16
LARGEST = 256
LOOKAHEAD = 3
CACHED = 300_000

Counted = tuple[list[int], list[int]]


@functools.lru_cache(maxsize=1)
def pre_token_counter(path: str | None = None) -> tuple[Callable[[str, int], Iterator[str]], Callable[[str], int]]:
    """Functions that give the pre-tokens of a text from a position on, and the tokens of a pre-token.

    Made once in a worker process: it outlives its tasks, and keeps the encoder of each until its garbage is collected.
    """
    import base64

    import public_tokenizers
    import regex
    import tiktoken

    with open(path or public_tokenizers.path(RANKS), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    pattern = regex.compile(public_tokenizers.PATTERN)

    class Counts(dict):
        def __missing__(self, piece: str) -> int:
            if len(self) > CACHED:
                self.clear()
            n = len(encoding.encode_ordinary(piece))
            if len(piece) <= 64:
                self[piece] = n
            return n

    counts = Counts()
    return pattern, counts.__getitem__


class TokenTree:
    """Characters and tokens of the leaves of a text, under sums."""

    def __init__(self, chars: list[int], tokens: list[int]) -> None:
        self.leaves = 1
        while self.leaves < max(1, len(chars)):
            self.leaves *= 2
        self.chars = [0] * (2 * self.leaves)
        self.tokens = [0] * (2 * self.leaves)
        self.chars[self.leaves:self.leaves + len(chars)] = chars
        self.tokens[self.leaves:self.leaves + len(tokens)] = tokens
        for i in range(self.leaves - 1, 0, -1):
            self._sum(i)

    def _sum(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    def leaf_at(self, position: int) -> tuple[int, int]:
        """The leaf that holds a position, and where the leaf starts; the last one for the end of the text."""
        i, start = 1, 0
        while i < self.leaves:
            left = self.chars[2 * i]
            if position - start < left or not self.chars[2 * i + 1]:
                i = 2 * i
            else:
                start += left
                i = 2 * i + 1
        return i - self.leaves, start

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        i = leaf + self.leaves
        self.chars[i], self.tokens[i] = chars, tokens
        while i > 1:
            i //= 2
            self._sum(i)

    def leaf(self, leaf: int) -> tuple[int, int]:
        return self.chars[leaf + self.leaves], self.tokens[leaf + self.leaves]

    def counted(self) -> Counted:
        """The leaves that are not empty."""
        held = [(c, t) for c, t in zip(self.chars[self.leaves:], self.tokens[self.leaves:]) if c]
        return [c for c, _ in held], [t for _, t in held]


def leaves_of(text: str, pattern, count) -> Counted:
    pieces = pattern.findall(text)
    chars, tokens = list(map(len, pieces)), list(map(count, pieces))
    return ([sum(chars[i:i + LEAF]) for i in range(0, len(chars), LEAF)],
            [sum(tokens[i:i + LEAF]) for i in range(0, len(tokens), LEAF)])


def edit(tree: TokenTree, text: str, start: int, removed: int, inserted: str, pattern, count) -> tuple[TokenTree, str, int]:
    """The tree and the text after an edit, and how many characters were encoded again."""
    start = max(0, min(start, len(text)))
    removed = max(0, min(removed, len(text) - start))
    after = text[:start] + inserted + text[start + removed:]
    if not text:
        chars, tokens = leaves_of(after, pattern, count)
        return TokenTree(chars, tokens), after, len(after)
    shift = len(inserted) - removed
    first, begin = tree.leaf_at(max(0, start - LOOKAHEAD))
    # The old leaf boundary behind the edit at which the new text may fall into step again.
    last, boundary = first, begin + tree.leaf(first)[0]
    passed_edit = start + len(inserted)
    at, tokens, pieces, sizes = begin, 0, 0, []
    for m in pattern.finditer(after, begin):
        n = count(m[0])
        tokens, pieces, at = tokens + n, pieces + 1, m.end()
        sizes.append((m.end() - m.start(), n))
        while boundary < len(text) and (boundary + shift < at or boundary < start + removed):
            last += 1
            boundary += tree.leaf(last)[0]
        if at >= passed_edit and at - shift == boundary and boundary >= start + removed:
            break
    else:
        at = len(after)
        while boundary < len(text):
            last += 1
            boundary += tree.leaf(last)[0]
    if pieces > LARGEST:
        chars, found = tree.chars[tree.leaves:], tree.tokens[tree.leaves:]
        runs = [sizes[i:i + LEAF] for i in range(0, len(sizes), LEAF)]
        chars[first:last + 1] = [sum(c for c, _ in r) for r in runs]
        found[first:last + 1] = [sum(t for _, t in r) for r in runs]
        held = [(c, t) for c, t in zip(chars, found) if c]
        return TokenTree([c for c, _ in held], [t for _, t in held]), after, at - begin
    tree.put(first, at - begin, tokens)
    for leaf in range(first + 1, last + 1):
        tree.put(leaf, 0, 0)
    return tree, after, at - begin


def token_trees(documents: DataFrame, text: str = "text", ranks: str | None = None, prefix: str = "tree_") -> DataFrame:
    """`documents` with the leaves of their trees (`tree_chars`, `tree_tokens`) and the sum at the root (`tree_total`)."""
    own = documents.columns
    at = own.index(text)
    names = [f"{prefix}chars", f"{prefix}tokens", f"{prefix}total"]

    def run(batches: Iterator) -> Iterator:
        pattern, count = pre_token_counter(ranks)
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            for first, last in text_groups(texts):
                made = [leaves_of(t, pattern, count) for t in texts[first:last]]
                yield pa.RecordBatch.from_arrays([
                    *(c.slice(first, last - first) for c in batch.columns),
                    pa.array([m[0] for m in made], pa.list_(pa.int32())), pa.array([m[1] for m in made], pa.list_(pa.int32())),
                    pa.array([sum(m[1]) for m in made], pa.int64())], [*own, *names])

    schema = documents.select("*", *[F.array().cast("array<int>").alias(n) for n in names[:2]], F.lit(0).cast("long").alias(names[2])).schema
    return documents.mapInArrow(run, schema)


def recounted(trees: DataFrame, edits: str = "edits", text: str = "text", ranks: str | None = None, prefix: str = "tree_") -> DataFrame:
    """Trees and texts after the edits of each row: an array of (start, removed, inserted), done in its order.

    Adds `encoded_chars`: how much text was encoded again.
    """
    own = trees.columns
    place = {n: own.index(n) for n in (text, edits, f"{prefix}chars", f"{prefix}tokens", f"{prefix}total")}

    def run(batches: Iterator) -> Iterator:
        pattern, count = pre_token_counter(ranks)
        for batch in batches:
            texts, chars, tokens, totals, encoded = [], [], [], [], []
            for body, todo, c, t in zip(*(batch.column(place[n]).to_pylist() for n in (text, edits, f"{prefix}chars", f"{prefix}tokens"))):
                tree, body, work = TokenTree(c or [], t or []), body or "", 0
                for e in todo or ():
                    tree, body, n = edit(tree, body, e["start"] or 0, e["removed"] or 0, e["inserted"] or "", pattern, count)
                    work += n
                left = tree.counted()
                texts.append(body), chars.append(left[0]), tokens.append(left[1])
                totals.append(tree.n_tokens), encoded.append(work)
            columns = list(batch.columns)
            columns[place[text]] = pa.array(texts, pa.string())
            columns[place[f"{prefix}chars"]] = pa.array(chars, pa.list_(pa.int32()))
            columns[place[f"{prefix}tokens"]] = pa.array(tokens, pa.list_(pa.int32()))
            columns[place[f"{prefix}total"]] = pa.array(totals, pa.int64())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(encoded, pa.int64())], [*own, "encoded_chars"])

    return trees.mapInArrow(run, trees.select("*", F.lit(0).cast("long").alias("encoded_chars")).schema)


def edited_counts(documents: DataFrame) -> DataFrame:
    """Every document's tokens before and after three edits: a cut in the middle, an insertion, a new end.

    The cut takes ten characters, the insertion puts the first twenty in at a third, and the last five
    are replaced by the first seven.
    """
    n = F.char_length("text")
    first = n - F.least(F.lit(10), n - F.floor(n / 2))
    grown = first + F.least(F.lit(20), n)

    def one(start, removed, inserted):
        return F.struct(start.cast("int").alias("start"), F.lit(removed).alias("removed"), inserted.alias("inserted"))

    slim = documents.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    slim = slim.withColumn("edits", F.array(
        one(F.floor(n / 2), 10, F.lit("")), one(F.floor(n / 3), 0, F.substring("text", 1, 20)),
        one(F.greatest(F.lit(0), grown - 5), 5, F.substring("text", 1, 7))))
    before = token_trees(slim).withColumns({"n_chars": n.cast("long"), "n_tokens": F.col("tree_total")})
    after = recounted(before)
    return after.select("doc_id", "n_chars", "n_tokens", n.cast("long").alias("edited_n_chars"),
                        F.col("tree_total").alias("edited_n_tokens"), "encoded_chars", F.md5("text").alias("edited_md5"))
