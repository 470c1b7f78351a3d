"""Hash trees of three children in van Emde Boas order.

A tree of several levels is cut at half its height: first the upper half, then the lower subtrees from
left to right, each laid out alike. The place of a node follows from its depth and index alone; no
pointers are kept, and any cache line or page that holds a subtree holds a part of every path through it.

A tree may lack nodes on its right side; their places stay free. The nodes of a depth are numbered from
the left, and one with no sibling has a parent of its own, so the tree has the same height everywhere.
"""

from __future__ import annotations

import hashlib
from binascii import hexlify, unhexlify
from functools import lru_cache

FANOUT = 3
DIGEST = 32


def nodes_of(levels: int) -> int:
    """Places of a tree with that many levels."""
    return (FANOUT ** levels - 1) // (FANOUT - 1)


@lru_cache(maxsize=None)
def height(leaves: int) -> int:
    """Levels above the leaves until one node remains."""
    levels = 0
    while leaves > 1:
        leaves = -(-leaves // FANOUT)
        levels += 1
    return levels


def place(levels: int, depth: int, index: int) -> int:
    """Where the node of that depth (0 at the root) and index stands in a tree of `levels` levels."""
    at = 0
    while levels > 1:
        upper = levels // 2
        if depth < upper:
            levels = upper
            continue
        below = depth - upper
        subtree, index = divmod(index, FANOUT ** below)
        at += nodes_of(upper) + subtree * nodes_of(levels - upper)
        levels, depth = levels - upper, below
    return at


@lru_cache(maxsize=64)
def places(levels: int, depth: int) -> tuple[int, ...]:
    """`place` of all nodes of a depth, for blocks of one size."""
    return tuple(place(levels, depth, i) for i in range(FANOUT ** depth))


def joined(hexes: list[bytes]) -> bytes:
    """The node above a run of nodes; digests are concatenated as hexadecimal text."""
    return hashlib.sha256(b"".join(hexes)).hexdigest().encode()


def built(leaves: list[bytes], above: int) -> bytes:
    """The tree of `above` levels over the leaves' digests, as bytes in layout order."""
    levels = above + 1
    out = bytearray(DIGEST * nodes_of(levels))
    row = [hexlify(leaf) for leaf in leaves]
    for depth in range(above, -1, -1):
        for at, digest in zip(places(levels, depth), row):
            out[DIGEST * at:DIGEST * (at + 1)] = unhexlify(digest)
        row = [joined(row[i:i + FANOUT]) for i in range(0, len(row), FANOUT)]
    return bytes(out)


class Block:
    """A stored tree: its root and the siblings of each leaf's path, read by their places."""

    def __init__(self, nodes: bytes, leaves: int, above: int) -> None:
        self.nodes, self.levels, self.counts = nodes, above + 1, [leaves]
        for _ in range(above):
            self.counts.append(-(-self.counts[-1] // FANOUT))
        self.read: dict[tuple[int, int], tuple[bytes, ...]] = {}

    def node(self, depth: int, index: int) -> bytes:
        at = DIGEST * place(self.levels, depth, index) if depth == 0 else DIGEST * places(self.levels, depth)[index]
        return hexlify(self.nodes[at:at + DIGEST])

    def run(self, up: int, first: int) -> tuple[bytes, ...]:
        """The run of nodes that starts at `first`, `up` levels above the leaves. Read once for its members."""
        key = up, first
        if key not in self.read:
            last = min(first + FANOUT, self.counts[up])
            self.read[key] = tuple(self.node(self.levels - 1 - up, i) for i in range(first, last))
        return self.read[key]

    def path(self, leaf: int) -> list[tuple[bytes, bytes]]:
        """(siblings to the left, to the right) of the nodes from a leaf up to below the root."""
        out = []
        for up in range(self.levels - 1):
            first = leaf - leaf % FANOUT
            run = self.run(up, first)
            out.append((b"".join(run[:leaf - first]), b"".join(run[leaf - first + 1:])))
            leaf //= FANOUT
        return out


def folded(leaf: bytes, path: list[tuple[bytes, bytes]]) -> bytes:
    """The root that a leaf and its siblings lead to."""
    for left, right in path:
        leaf = hashlib.sha256(left + leaf + right).hexdigest().encode()
    return leaf
