"""A prefix tree of ordered sets, and the Jaccard join over it. Plain numpy: the work inside one Spark group."""

from __future__ import annotations

import sys

import numpy as np


class Links:
    """Disjoint sets of numbers; the smallest number of each is its root."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


class _Node:
    """tokens: what the sets below share after the parent's tokens; depth: the number of tokens with these."""

    __slots__ = ("children", "depth", "largest", "leaf", "same", "smallest", "tokens")

    def __init__(self, tokens: np.ndarray, depth: int, smallest: int, largest: int, leaf: int) -> None:
        self.tokens, self.depth, self.smallest, self.largest, self.leaf = tokens, depth, smallest, largest, leaf
        self.children: list[_Node] = []
        self.same = leaf  # a set of the one class that all sets below are known to be in; -1: not known


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    n = min(len(a), len(b))
    other = np.flatnonzero(a[:n] != b[:n])
    return int(other[0]) if len(other) else n


def build(sets: list[np.ndarray], names: list[int] | None = None) -> _Node:
    """The tree of ascending arrays of unsigned 64-bit tokens; runs of tokens without a branch are one node.

    names: the sets' numbers in the leaves, else their places.
    """
    names = names or list(range(len(sets)))
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 3 * len(sets) + 1000))  # a level for each set at most
    order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
    shared = [0] + [_shared(sets[a], sets[b]) for a, b in zip(order, order[1:])]
    sizes = [len(sets[i]) for i in order]

    def node(lo: int, hi: int, depth: int) -> _Node:
        if hi - lo == 1:
            s = sets[order[lo]]
            return _Node(s[depth:], len(s), len(s), len(s), names[order[lo]])
        to = min(shared[lo + 1 : hi])
        return _Node(sets[order[lo]][depth:to], to, min(sizes[lo:hi]), max(sizes[lo:hi]), -1)

    root = node(0, len(order), 0)
    todo = [(root, 0, len(order))]
    while todo:
        at, lo, hi = todo.pop()
        if hi - lo == 1:
            continue
        cuts = [lo, *(k for k in range(lo + 1, hi) if shared[k] == at.depth), hi]
        for a, b in zip(cuts, cuts[1:]):
            child = node(a, b, at.depth)
            at.children.append(child)
            todo.append((child, a, b))
    return root


def probe(root: _Node, x: np.ndarray, me: int, links: Links, before: int | None, percent: int) -> list[int]:
    """Joins ``me`` with every class that holds a set similar to x; returns one such set of each class.

    The overlap with a node's tokens is counted once for all sets below it. A subtree is left when even the most
    favourable size of its sets cannot reach the similarity with what remains of both, or when all its sets are in the
    class of ``me`` already. before: only sets with a smaller number (the others have their own turn).
    """
    size, have, found = len(x), set(x.tolist()), []
    full = 100 + percent

    def overlap(tokens: np.ndarray) -> int:
        if len(tokens) <= 6:
            return sum(t in have for t in tokens.tolist())
        k = np.searchsorted(x, tokens)
        k[k == size] = size - 1
        return int((x[k] == tokens).sum())

    def visit(node: _Node, shared: int) -> None:
        mine = links.root(me)
        if node.same >= 0 and links.root(node.same) == mine:
            return
        if node.leaf >= 0 and before is not None and node.leaf >= before:
            return
        # before counting: could the sizes alone do?
        if 100 * min(size, node.largest) < percent * max(size, node.smallest):
            return
        shared += overlap(node.tokens)
        if node.leaf >= 0:
            if full * shared >= percent * (size + node.largest):
                links.join(me, node.leaf)
                found.append(node.leaf)
            return
        left = size - int(np.searchsorted(x, node.tokens[-1], "right")) if len(node.tokens) else size - shared
        best = min(max(node.depth + left, node.smallest), node.largest)
        if full * (shared + min(left, best - node.depth)) < percent * (size + best):
            return
        for child in node.children:
            visit(child, shared)
        known = {links.root(c.same) if c.same >= 0 else -1 for c in node.children}
        if len(known) == 1 and -1 not in known:
            node.same = known.pop()

    visit(root, 0)
    return found


def join(sets: list[np.ndarray], percent: int, links: Links | None = None) -> Links:
    """The classes of sets that links of Jaccard similarity percent / 100 or more connect: each pair is linked, ruled out
    by a bound, or in one class already."""
    links = links or Links(len(sets))
    if len(sets) > 1:
        root = build(sets)
        for me, x in enumerate(sets):
            if me and len(x):
                probe(root, x, me, links, me, percent)
    return links
