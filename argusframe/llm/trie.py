"""Binary trie self-join on integers: pairs that differ in few bits.

A sorted array of distinct values is a binary trie: a node is a range of it. Pairs of nodes are traversed together
from the root, bit by bit; a pair's differing bits add up, and it is dropped once they exceed the budget.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Pairs of nodes in hand at once, and pairs of values small enough to compare one by one.
FRONTIER, LEAF = 1 << 17, 6


def _pairs_of(alo, ahi, blo, bhi):
    """Every (i, j) of each pair of ranges."""
    na, nb = ahi - alo, bhi - blo
    n = na * nb
    own = np.repeat(np.arange(len(n)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return alo[own] + k // nb[own], blo[own] + k % nb[own]


def near_pairs(a: np.ndarray, b: np.ndarray | None, bits: int, budget: int, early: tuple[int, int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Batches of (i, j, distance) with at most budget bits between a[i] and b[j]; with b None, within a and i < j.

    a and b are sorted, distinct unsigned 64-bit integers below 2 to the power bits. early is (leading bits, budget): only pairs that
    differ in so many of the leading bits at most.
    """
    ahead, few = early or (0, budget)
    same = b is None
    b = a if same else b
    if not len(a) or not len(b):
        return
    one = lambda x: np.array([x], dtype=np.int64)
    stack = [(0, one(0), one(len(a)), one(0), one(len(b)), one(0))]
    while stack:
        depth, alo, ahi, blo, bhi, err = stack.pop()
        if len(alo) > FRONTIER:
            half = len(alo) // 2
            stack += [(depth, *(x[:half] for x in (alo, ahi, blo, bhi, err))), (depth, *(x[half:] for x in (alo, ahi, blo, bhi, err)))]
            continue
        small = ((ahi - alo) * (bhi - blo) <= LEAF) | (depth >= bits)
        if small.any():
            i, j = _pairs_of(alo[small], ahi[small], blo[small], bhi[small])
            if same:
                i, j = i[i < j], j[i < j]
            d = np.bitwise_count(a[i] ^ b[j]).astype(np.int64)
            hit = d <= budget
            if ahead:
                hit &= np.bitwise_count((a[i] ^ b[j]) >> np.uint64(bits - ahead)) <= few
            if hit.any():
                yield i[hit], j[hit], d[hit]
            alo, ahi, blo, bhi, err = (x[~small] for x in (alo, ahi, blo, bhi, err))
        if not len(alo):
            continue
        bit = np.uint64(bits - 1 - depth)

        def middle(v, lo, hi, bit=bit):
            up = v[lo] >> bit | np.uint64(1)
            return np.clip(np.searchsorted(v, up << bit), lo, hi)

        am, bm = middle(a, alo, ahi), middle(b, blo, bhi)
        own = (alo == blo) if same else np.zeros(len(alo), bool)
        out = [(alo, am, blo, bm, err), (am, ahi, bm, bhi, err), (alo, am, bm, bhi, err + 1), (am, ahi, blo, bm, np.where(own, budget + 1, err + 1))]
        alo, ahi, blo, bhi, err = (np.concatenate(x) for x in zip(*out, strict=True))
        keep = (ahi > alo) & (bhi > blo) & (err <= (few if depth < ahead else budget))
        stack.append((depth + 1, *(x[keep] for x in (alo, ahi, blo, bhi, err))))


def forest(n: int, i: np.ndarray, j: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Positions of the links of a minimum spanning forest over nodes 0 to n - 1: Borůvka's rounds, nearest links first."""
    order = np.lexsort((j, i, d))
    i, j = i[order], j[order]
    comp, chosen, rest = np.arange(n), [], np.arange(len(i))
    while len(rest):
        ci, cj = comp[i[rest]], comp[j[rest]]
        rest = rest[ci != cj]
        if not len(rest):
            break
        ci, cj = comp[i[rest]], comp[j[rest]]
        best = np.full(n, len(i))
        np.minimum.at(best, ci, rest)
        np.minimum.at(best, cj, rest)
        new = np.unique(best[best < len(i)])
        chosen.append(new)
        u, v = comp[i[new]], comp[j[new]]
        label = np.arange(n)
        while True:
            low = np.minimum(label[u], label[v])
            after = label.copy()
            np.minimum.at(after, u, low)
            np.minimum.at(after, v, low)
            after = after[after]
            if (after == label).all():
                break
            label = after
        comp = label[comp]
    return order[np.concatenate(chosen)] if chosen else np.empty(0, np.int64)


def linked(a: np.ndarray, b: np.ndarray | None, bits: int, budget: int, held: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links of near_pairs(), as positions in a followed by b; links are folded as they come."""
    n, shift = len(a) + (0 if b is None else len(b)), 0 if b is None else len(a)
    parts: list[tuple[np.ndarray, ...]] = []

    def fold():
        x = [np.concatenate(p) for p in zip(*parts, strict=True)]
        keep = forest(n, *x)
        parts[:] = [tuple(p[keep] for p in x)]

    count = 0
    for i, j, d in near_pairs(a, b, bits, budget):
        parts.append((i, j + shift, d))
        count += len(i)
        if count > held:
            fold()
            count = 0
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    fold()
    return parts[0][0], parts[0][1]
