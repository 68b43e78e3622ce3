"""Signature trees over token sets and their dual traversal (numpy, inside one task).

A leaf is a set with a bitmap of its tokens; an inner node holds the OR of its children's
bitmaps, the range of its sets' sizes and the largest number of tokens that share a bit with
another one of their set.  Two nodes can hold a linked pair only if their size ranges allow it
and ``popcount(a & b) + surplus``, the most tokens any two of their sets can have in common,
reaches what the smallest sizes need; other node pairs are pruned with all that is below.
Pairs of sets that are already connected are pruned too.  Survivors are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

FANOUT = 8
MAX_BITS = 1 << 15
#: Two sets link when NUM * intersection >= ... : 100 i >= 75 u is 7 i >= 3 (|x| + |y|).
_PAIRS = 8192


class Forest:
    """Union-find over positions; the smallest position of a tree is its root."""

    def __init__(self, parent: np.ndarray):
        self.parent = parent.tolist()

    def find(self, x: int) -> int:
        p = self.parent
        while p[x] != x:
            p[x] = x = p[p[x]]
        return x

    def union(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def roots(self) -> np.ndarray:
        return np.fromiter((self.find(i) for i in range(len(self.parent))), np.int64, len(self.parent))


class Tree:
    """``sets``: sorted token arrays (those tokens that other sets share); ``sizes``: full set sizes."""

    def __init__(self, members: np.ndarray, sets: list[np.ndarray], sizes: np.ndarray, bits: int):
        near = np.array([int(sets[i][0]) if len(sets[i]) else 0 for i in members], np.uint64)
        self.members = members[np.lexsort((sizes[members], near))]  # alike sets start with the same token
        k = len(members)
        flags = np.zeros((k, bits // 8), np.uint8)
        shift = np.uint64(64 - bits.bit_length() + 1)
        for row, i in enumerate(self.members.tolist()):
            one = np.zeros(bits, np.bool_)
            one[(sets[i] * np.uint64(0x9E3779B97F4A7C15)) >> shift] = True
            flags[row] = np.packbits(one)
        maps = flags.view(np.uint64)
        tokens = np.array([len(sets[i]) for i in self.members], np.int64)
        size = sizes[self.members]
        surplus = tokens - np.bitwise_count(maps).sum(1, dtype=np.int64)
        self.levels = [(maps, size, size, tokens, surplus)]
        while len(self.levels[-1][0]) > 1:
            maps, low, high, tokens, surplus = self.levels[-1]
            cut = np.arange(0, len(maps), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(maps, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), np.maximum.reduceat(tokens, cut), np.maximum.reduceat(surplus, cut)))

    def uniform(self, roots: np.ndarray) -> list[np.ndarray]:
        """Per level and node the one component of its sets, or -1."""
        low = high = roots[self.members]
        out = [low]
        for maps, *_ in self.levels[1:]:
            cut = np.arange(0, len(low), FANOUT)
            low, high = np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)
            out.append(np.where(low == high, low, -1))
        return out


def _may_link(x: tuple, y: tuple, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which node pairs (a of x's level, b of y's) can hold a linked pair."""
    (mx, lx, hx, tx, sx), (my, ly, hy, ty, sy) = x, y
    ok = (4 * hx[a] >= 3 * ly[b]) & (4 * hy[b] >= 3 * lx[a])
    need = 3 * (lx[a] + ly[b])
    ok &= 7 * np.minimum(tx[a], ty[b]) >= need
    at = np.flatnonzero(ok)
    step = max(64, (8 << 20) // (8 * mx.shape[1]))
    for k in range(0, len(at), step):
        part = at[k : k + step]
        common = np.bitwise_count(mx[a[part]] & my[b[part]]).sum(1, dtype=np.int64) + np.minimum(sx[a[part]], sy[b[part]])
        ok[part] = 7 * common >= need[part]
    return ok


def linked(x: np.ndarray, y: np.ndarray, nx: int, ny: int) -> bool:
    """Whether 100 * intersection >= 75 * union, exactly."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    i = int(np.count_nonzero(y[at] == x)) if len(y) else 0
    return 7 * i >= 3 * (nx + ny)


def join(one: Tree, two: Tree, sets: list[np.ndarray], sizes: np.ndarray, forest: Forest) -> Iterator[tuple[int, int]]:
    """Dual traversal of ``one`` and ``two`` (the same for a self join); connects ``forest`` and yields the links it needed."""
    own = one is two

    def compare(pairs: Iterator[tuple[int, int]]) -> Iterator[tuple[int, int]]:
        for i, k in pairs:
            if forest.find(i) != forest.find(k) and linked(sets[i], sets[k], int(sizes[i]), int(sizes[k])):
                forest.union(i, k)
                yield i, k

    if own:  # neighbours in the tree's order first: copies connect at once and are pruned as one from then on
        m = one.members.tolist()
        yield from compare(zip(m[:-1], m[1:]))
    top = max(len(one.levels), len(two.levels)) - 1
    state = [one.uniform(forest.roots()), None]
    state[1] = state[0] if own else two.uniform(forest.roots())
    stack = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        level, a, b = stack.pop()
        i, k = min(level, len(one.levels) - 1), min(level, len(two.levels) - 1)
        x, y = state[0][i][a], state[1][k][b]
        keep = (x != y) | (x < 0)
        a, b = a[keep], b[keep]
        keep = _may_link(one.levels[i], two.levels[k], a, b)
        a, b = a[keep], b[keep]
        if not len(a):
            continue
        if level == 0:
            if own:
                a, b = a[a < b], b[a < b]
            before = len(a)
            found = list(compare(zip(one.members[a].tolist(), two.members[b].tolist())))
            yield from found
            if found and before:
                roots = forest.roots()
                state[0] = one.uniform(roots)
                state[1] = state[0] if own else two.uniform(roots)
            continue
        a, b = _children(a, b, len(one.levels[i - 1][0]) if level <= len(one.levels) - 1 else 0, len(two.levels[k - 1][0]) if level <= len(two.levels) - 1 else 0)
        if own:
            a, b = a[a <= b], b[a <= b]
        for at in range(0, len(a), _PAIRS):
            stack.append((level - 1, a[at : at + _PAIRS], b[at : at + _PAIRS]))


def _children(a: np.ndarray, b: np.ndarray, na: int, nb: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of the pairs' children; a side whose tree is lower (n = 0) stays at its root."""
    ca = (a[:, None] * FANOUT + np.arange(FANOUT)) if na else a[:, None]
    cb = (b[:, None] * FANOUT + np.arange(FANOUT)) if nb else b[:, None]
    x = np.repeat(ca, cb.shape[1], axis=1).ravel()
    y = np.tile(cb, (1, ca.shape[1])).ravel()
    keep = ((x < na) if na else True) & ((y < nb) if nb else True)
    return x[keep], y[keep]


def bits_for(sets: list[np.ndarray]) -> int:
    longest = max((len(s) for s in sets), default=1)
    return min(MAX_BITS, max(256, 1 << (4 * max(1, longest) - 1).bit_length()))
