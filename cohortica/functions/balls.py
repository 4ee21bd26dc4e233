"""Neighbours of the rows of a few columns that one task holds, by the max norm: distance to the k-th, and rows within a distance.

Distances are compared as they are computed: "within r" is |a - b| < r in every
column, or equal rows where r is 0.
"""

from __future__ import annotations

import numpy as np

LEAF = 64  # rows of a leaf at most, if k is not larger
AT_ONCE = 1 << 20  # distances that are in memory at once
TINY = 5e-324  # |a - b| < TINY: equal


def _leaves(x: list[np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of rows by equal leaves, (leaves, rows), halved along the widest column; some rows come twice to fill them, the second time not ``real``."""
    n, count = len(x[0]), 1
    while n > size * count:
        count *= 2
    more = -(-n // count) * count - n
    row = np.concatenate([np.arange(n), np.arange(more) * n // max(1, more)])
    at = np.arange(n + more).reshape(1, -1)
    while len(at) < count:
        held = np.stack([c[row[at]] for c in x])
        wide = (held.max(axis=2) - held.min(axis=2)).argmax(axis=0)
        half = at.shape[1] // 2
        order = np.argpartition(held[wide, np.arange(len(at))], half, axis=1)
        at = np.take_along_axis(at, order, axis=1).reshape(-1, half)
    return row[at], at < n


def _apart(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    out = np.abs(a[0] - b[0])
    for x, y in zip(a[1:], b[1:], strict=True):
        np.maximum(out, np.abs(x - y), out=out)
    return out


def radius(x: list[np.ndarray], k: int) -> np.ndarray:
    """The distance of each row to its k-th neighbour, for more than k rows.

    The k nearest of a row's own leaf bound the distance; the row then visits
    the leaves whose boxes are nearer than what it has so far.
    """
    row, real = _leaves(x, max(LEAF, 2 * (k + 1)))
    leaves, size = row.shape
    p = [c[row] for c in x]
    d = np.empty((leaves, size, size))
    step = max(1, AT_ONCE // (size * size))
    best = np.empty((leaves, size, k + 1))
    for a in range(0, leaves, step):
        part = [c[a : a + step] for c in p]
        d = _apart([c[:, :, None] for c in part], [c[:, None, :] for c in part])
        leaf, at = np.nonzero(~real[a : a + step])
        d[leaf, :, at] = np.inf
        best[a : a + step] = np.partition(d, k, axis=2)[:, :, : k + 1] if size > k else np.inf
    best = best.reshape(-1, k + 1)
    r = best.max(axis=1).reshape(leaves, size)
    lo, hi = [c.min(axis=1) for c in p], [c.max(axis=1) for c in p]
    most = np.where(real, r, 0.0).max(axis=1)
    asks, goes = [], []
    step = max(1, AT_ONCE // leaves)
    for a in range(0, leaves, step):
        near = np.ones((len(most[a : a + step]), leaves), bool)
        for l, h in zip(lo, hi, strict=True):
            near &= l[None, :] - h[a : a + step, None] < most[a : a + step, None]
            near &= l[a : a + step, None] - h[None, :] < most[a : a + step, None]
        one, two = np.nonzero(near)
        one += a
        one, two = one[one != two], two[one != two]
        for b in range(0, len(one), max(1, AT_ONCE // size)):
            f, t = one[b : b + AT_ONCE // size], two[b : b + AT_ONCE // size]
            ask = real[f]
            for c, l, h in zip(p, lo, hi, strict=True):
                ask &= l[t, None] - c[f] < r[f]
                ask &= c[f] - h[t, None] < r[f]
            i, j = np.nonzero(ask)
            asks.append(f[i] * size + j)
            goes.append(t[i])
    r = r.reshape(-1)
    if asks:
        ask, go = np.concatenate(asks), np.concatenate(goes)
        order = np.argsort(ask, kind="stable")
        ask, go = ask[order], go[order]
        turn = np.arange(len(ask)) - np.searchsorted(ask, ask, "left")
        order = np.argsort(turn, kind="stable")
        ask, go, ends = ask[order], go[order], np.cumsum(np.bincount(turn))
        flat = [c.reshape(-1) for c in p]
        begin = 0
        for end in ends.tolist():  # a row makes one visit a turn
            q, t = ask[begin:end], go[begin:end]
            ok = np.ones(len(q), bool)
            for c, l, h in zip(flat, lo, hi, strict=True):
                ok &= (l[t] - c[q] < r[q]) & (c[q] - h[t] < r[q])
            q, t = q[ok], t[ok]
            for b in range(0, len(q), max(1, AT_ONCE // size)):
                own, to = q[b : b + AT_ONCE // size], t[b : b + AT_ONCE // size]
                d = _apart([c[own, None] for c in flat], [c[to] for c in p])
                d[~real[to]] = np.inf
                both = np.partition(np.concatenate([best[own], d], axis=1), k, axis=1)[:, : k + 1]
                best[own] = both
                r[own] = both[:, k]
            begin = end
    out = np.empty(len(x[0]))
    out[row[real]] = r.reshape(leaves, size)[real]
    return out


class Line:
    """One column in order."""

    def __init__(self, x: np.ndarray):
        self.order = np.argsort(x, kind="stable")
        self.x = x[self.order]
        self.values, first = np.unique(self.x, return_index=True)
        self.start = np.append(first, len(x))

    def ends(self, x: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First place within r of each x, which is in the column, and the first one behind."""
        r, last = np.maximum(r, TINY), len(self.values) - 1
        lo, hi = np.searchsorted(self.values, x - r, "left"), np.searchsorted(self.values, x + r, "right")
        near = lambda i: np.abs(self.values[np.clip(i, 0, last)] - x) < r
        while (move := (lo < hi) & ~near(lo)).any():  # sums round, by a few values at most
            lo += move
        while (move := (lo > 0) & near(lo - 1)).any():
            lo -= move
        while (move := (lo < hi) & ~near(hi - 1)).any():
            hi -= move
        while (move := (hi <= last) & near(hi)).any():
            hi += move
        return self.start[lo], self.start[hi]


class Plane:
    """Two columns: how many rows of a range along the first lie in a range along the second, by halving the latter."""

    def __init__(self, a: Line, b: Line):
        n = len(a.x)
        place = np.empty(n, np.int64)
        place[b.order] = np.arange(n)
        v = place[a.order]
        self.size, self.next = n + 1, []  # at each bit, where a place goes among the rows without it, and then among those with it
        for bit in reversed(range(n.bit_length())):
            one = (v >> bit & 1).astype(bool)
            without = np.concatenate([[0], np.cumsum(~one)])
            self.next.append(np.concatenate([without, without[-1] + np.arange(n + 1) - without]))
            v = np.concatenate([v[~one], v[one]])

    def held(self, first: np.ndarray, end: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Rows at places first to end of the one, lo to hi of the other."""
        a, b, t = np.concatenate([first, first]), np.concatenate([end, end]), np.concatenate([lo, hi])
        out, wide = np.zeros(len(t), np.int64), b - a
        for i, to in enumerate(self.next):
            one = t >> (len(self.next) - 1 - i) & 1
            shift = one * self.size
            a, b = to[shift + a], to[shift + b]
            now = b - a
            out += one * (wide - now)
            wide = now
        return out[len(lo) :] - out[: len(lo)]


def held(x: list[np.ndarray], r: np.ndarray) -> np.ndarray:
    """Rows within r of each row, by all distances: for more columns than two."""
    n = len(r)
    out = np.empty(n, np.int64)
    for a in range(0, n, max(1, AT_ONCE // n)):
        b = a + max(1, AT_ONCE // n)
        out[a:b] = (_apart([c[a:b, None] for c in x], [c[None, :] for c in x]) < np.maximum(r[a:b], TINY)[:, None]).sum(axis=1)
    return out
