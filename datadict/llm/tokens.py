"""Token ids of whole texts inside tasks, with a bounded cache of white-space separated parts."""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator

TOKENIZER = "word_bpe_49k.json"
CACHED_PARTS = 600_000
LONGEST_CACHED = 48


def default_tokenizer() -> str:
    """The path of the public word tokenizer on this machine."""
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


# Texts of these characters alone hold no combining marks, so lower case may come before composition;
# `<|` could become a special token's string.
_NOT_PLAIN = re.compile("[^\x00-\u012f\u0131-\u024f]|<\\|")


def id_encoder(path: str | None):
    """A function from texts to their ids as little-endian unsigned 32-bit bytes.

    The tokenizer drops white space and never merges across it, so the ids of a text are those of
    its parts between blanks. Parts are encoded once while they stay in the cache. A full stop or comma
    after a letter is a word of its own. Words of letters are encoded together, and told apart by the
    tokens that end a word.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import numpy as np
    from tokenizers import Tokenizer, pre_tokenizers

    path = path or default_tokenizer()
    tokenizer = Tokenizer.from_file(path)
    _check(tokenizer, path)
    # Lower-case words of letters between blanks need no normalizer, and are split by the blanks alone.
    split_only = Tokenizer(tokenizer.model)
    split_only.pre_tokenizer = pre_tokenizers.Sequence([
        pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    encode_all = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)
    encode_words = getattr(split_only, "encode_batch_fast", split_only.encode_batch)
    ends_word = np.zeros(tokenizer.get_vocab_size() + 1, bool)
    for token, i in tokenizer.get_vocab().items():
        ends_word[i] = token.endswith("</w>")
    cache: dict[str, bytes] = {}

    def one_by_one(parts: list[str]) -> Iterator[bytes]:
        for found in encode_all(parts, add_special_tokens=False):
            yield array("I", found.ids).tobytes()

    def together(words: list[str]) -> list[bytes]:
        ids = np.array(encode_words([" ".join(words)], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = 4 * (np.flatnonzero(ends_word[ids]) + 1)
        if len(ends) != len(words):
            return list(one_by_one(words))
        held, ends = ids.tobytes(), [0, *ends.tolist()]
        return [held[a:b] for a, b in zip(ends, ends[1:])]

    def parts_of(text: str, plain: bool) -> list[str]:
        if plain:
            text = text.lower()
        return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")

    def learn(missing: set[str], plain_parts: set[str]) -> None:
        words, others, stopped = set(), [], []
        for p in missing:
            plain = p in plain_parts or (p == p.lower() and not _NOT_PLAIN.search(p))
            if plain and p.isalpha():
                words.add(p)
            elif plain and p[-1:] in (".", ",") and p[:-1].isalpha():
                stopped.append(p)
            else:
                others.append(p)
        words.update(p[:-1] for p in stopped)
        words = list(words.difference(cache))
        cache.update(zip(words, together(words)))
        cache.update(zip(others, one_by_one(others)))
        for p in stopped:
            cache[p] = cache[p[:-1]] + cache[p[-1]]

    cache.update(zip((".", ","), one_by_one([".", ","])))
    marks = dict(cache)

    def encode(texts: list[str]) -> list[bytes]:
        plain = [not _NOT_PLAIN.search(t) for t in texts]
        split = [parts_of(t, p) for t, p in zip(texts, plain)]
        if len(cache) > CACHED_PARTS:
            cache.clear()
            cache.update(marks)
        plain_parts = set().union(*(parts for parts, p in zip(split, plain) if p)).difference(cache)
        missing = set().union(*(parts for parts, p in zip(split, plain) if not p)).difference(cache) | plain_parts
        learn(missing, plain_parts)
        out = [b"".join(map(cache.__getitem__, parts)) for parts in split]
        for p in missing:
            if len(p) > LONGEST_CACHED:
                cache.pop(p, None)
        return out

    return encode


def _check(tokenizer, path: str) -> None:
    """Only a tokenizer that drops white space, lower-cases and marks the ends of words can be cached by parts."""
    said = json.loads(tokenizer.to_str())
    steps = json.dumps(said.get("pre_tokenizer"))
    if said["model"].get("end_of_word_suffix") != "</w>" or "Lowercase" not in json.dumps(said.get("normalizer")) \
            or "ByteLevel" not in steps:
        raise ValueError(f"not a lower-casing tokenizer with word ends: {path}")


def text_groups(texts: list[str], chars: int = 1 << 20):
    """Consecutive (first, last) ranges of about so many characters, so that work on a batch stays small."""
    first, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= chars:
            yield first, i + 1
            first, held = i + 1, 0
    if first < len(texts):
        yield first, len(texts)
