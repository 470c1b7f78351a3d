"""Words and hashed word windows of Arrow text columns, by whole-array operations.

Words are runs of bytes other than blank, tab, newline, vertical tab, form feed and return. Their
64-bit hashes come from one running polynomial over the bytes, so the work per byte is constant.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

PIECE = 1 << 18

_P = 0x9E3779B97F4A7C15 | 1
_P_INVERSE = pow(_P, -1, 1 << 64)
_MULTIPLIERS = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB,
                0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F)


def give_back() -> None:
    """Return freed memory to the system at a task's end: a worker process waits for its next task and would keep it."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library
    if trim:
        trim(0)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_slices(column: pa.Array, size: int = PIECE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive rows of about `size` bytes; nulls are empty texts."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + size, side="left"))
        last = min(max(last, first + 1), len(column))
        yield first, data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first]
        first = last


class Words(NamedTuple):
    """Per word its hash, first byte, end, and text; `bounds` are the texts' first words."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    bounds: np.ndarray


def _running_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, tables: dict) -> np.ndarray:
    """Hashes of the words that lie in `data`, from one running polynomial over its bytes."""
    n = len(data)
    if len(tables.get("power", ())) <= n:
        for name, factor in (("power", _P), ("inverse", _P_INVERSE)):
            tables[name] = np.full(n + 1, factor, np.uint64)
            tables[name][0] = 1
            np.multiply.accumulate(tables[name], out=tables[name])
    running = np.zeros(n + 1, np.uint64)
    np.add(data, np.uint64(1), out=running[1:])
    running[1:] *= tables["power"][:n]
    np.cumsum(running[1:], out=running[1:])
    return mix64((running[end] - running[start]) * tables["inverse"][start] + (end - start).astype(np.uint64))


def words_of(data: np.ndarray, offsets: np.ndarray, lower: bool, longest: int = 0) -> Words:
    """`lower` maps A-Z; words longer than `longest` bytes, if given, are cut into parts of that length.

    Bytes are hashed in pieces of `PIECE` bytes that end with a word, so a long text needs little more
    memory than its words' numbers.
    """
    n, texts = len(data), len(offsets) - 1
    table = np.ones(256, bool)
    table[[9, 10, 11, 12, 13, 32]] = False
    solid = np.zeros(n + 2, bool)
    solid[1:-1] = table[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start = np.flatnonzero(solid[1:-1] & (~solid[:-2] | edge[:-1]))
    end = np.flatnonzero(solid[1:-1] & (~solid[2:] | edge[1:])) + 1
    if longest and len(start) and (end - start).max() > longest:
        parts = -(-(end - start) // longest)
        within = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        start = np.repeat(start, parts) + longest * within
        end = np.minimum(start + longest, np.repeat(end, parts))
    if lower:
        fold = np.arange(256, dtype=np.uint8)
        fold[65:91] += 32
        data = fold[data]
    code, tables, first = np.zeros(len(start), np.uint64), {}, 0
    while first < len(start):
        at = start[first]
        last = max(int(np.searchsorted(end, at + PIECE, side="right")), first + 1)
        piece = slice(first, last)
        code[piece] = _running_hashes(data[at:end[last - 1]], start[piece] - at, end[piece] - at, tables)
        first = last
    text = np.searchsorted(offsets, start, side="right") - 1
    return Words(code, start, end, text, np.searchsorted(text, np.arange(texts + 1)))


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of `k` words, across texts too; empty if there are fewer words."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = mix64(out * np.uint64(_MULTIPLIERS[i % 8]) + hashes[i:i + n])
    return out


def shingle_sets(words: Words, k: int) -> Iterator[np.ndarray]:
    """Per text the sorted distinct hashes of its k-word runs; of all its words where it has fewer."""
    runs = windows(words.hash, k)
    for i in range(len(words.bounds) - 1):
        a, b = words.bounds[i], words.bounds[i + 1]
        if b - a >= k:
            yield np.unique(runs[a:b - k + 1])
        elif b > a:
            yield windows(words.hash[a:b], int(b - a))
        else:
            yield np.zeros(0, np.uint64)
