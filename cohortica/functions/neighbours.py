"""Ross's estimator on the values of one feature, for many labellings of a table that one task can hold.

No noise is added, so results repeat.  All digamma arguments are positive
integers, for which it is a harmonic number.
"""

from __future__ import annotations

import hashlib

import numpy as np

from cohortica.functions import balls

EULER = 0.57721566490153286061


def digamma(n: np.ndarray | int) -> np.ndarray:
    n = np.asarray(n, np.int64)
    table = np.concatenate([[np.nan, 0.0], np.cumsum(1.0 / np.arange(1, max(2, int(n.max(initial=1)) + 1)))])
    return table[n] - EULER


def radius(x: np.ndarray, k: int) -> np.ndarray:
    """Distance to the k-th neighbour along the line, self excluded."""
    n = len(x)
    order = np.argsort(x, kind="stable")
    v = x[order]
    pad = np.concatenate([np.full(k, -np.inf), v, np.full(k, np.inf)])
    near = np.abs(np.stack([pad[k + s : k + s + n] for s in range(-k, k + 1) if s]) - v)
    out = np.empty(n)
    out[order] = np.partition(near, k - 1, axis=0)[k - 1]
    return out


def within(x: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Points as close as r, self included.  Distances are compared as they are computed: the sorted ends are corrected where they round."""
    v = np.sort(x)
    lo = np.searchsorted(v, x - r, "left")
    hi = np.searchsorted(v, x + r, "right")

    def near(i: np.ndarray) -> np.ndarray:
        return np.abs(v[np.clip(i, 0, len(v) - 1)] - x)

    while (move := (lo < hi) & (near(lo) > r)).any():
        lo += move
    while (move := (lo < hi) & (near(hi - 1) > r)).any():
        hi -= move
    return hi - lo


def mi_ross(x: np.ndarray, y: np.ndarray, k: int = 3) -> float:
    """Continuous against discrete; classes of one point do not count; at least 0."""
    labels, counts = np.unique(y, return_counts=True)
    keep = np.isin(y, labels[counts > 1])
    x, y = x[keep], y[keep]
    if not len(x):
        return 0.0
    r, ks, size = np.empty(len(x)), np.empty(len(x), np.int64), np.empty(len(x), np.int64)
    for c in np.unique(y):
        own = y == c
        m = int(own.sum())
        ks[own], size[own] = min(k, m - 1), m
        r[own] = np.nextafter(radius(x[own], min(k, m - 1)), 0)
    m = within(x, r)
    return max(0.0, float(digamma(len(x)) + digamma(ks).mean() - digamma(size).mean() - digamma(m).mean()))


def md5_order(texts: list[bytes], end: bytes) -> np.ndarray:
    """The places of the texts in the order of the md5 of each with ``end`` behind it, equal ones as they come."""
    md5 = hashlib.md5
    high, low = np.frombuffer(b"".join([md5(t + end).digest() for t in texts]), ">u8").reshape(-1, 2).astype(np.uint64).T
    order = np.argsort(high, kind="stable")
    again = high[order]
    return order if (again[1:] != again[:-1]).all() else np.lexsort((low, high))


class Column:
    """The values of a feature, in order, for one labelling after another that has each label as often as ``y`` has."""

    def __init__(self, x: np.ndarray, y: np.ndarray, k: int):
        labels, counts = np.unique(y, return_counts=True)
        self.x, self.k, self.alone = x, k, bool((counts == 1).any())  # which point does not count hangs on the labelling
        self.labels, self.line, self.psi = labels, balls.Line(x), digamma(np.maximum(np.arange(len(x) + 1), 1))

    def mi(self, y: np.ndarray) -> float:
        """As ``mi_ross``."""
        if self.alone:
            return mi_ross(self.x, y, self.k)
        y, total = y[self.line.order], 0.0
        for c in self.labels:
            v = self.line.x[y == c]
            m, k = len(v), min(self.k, len(v) - 1)
            pad = np.concatenate([np.full(k, -np.inf), v, np.full(k, np.inf)])
            r = np.full(m, np.inf)
            for s in range(k + 1):  # s of the k neighbours lie below
                np.minimum(r, np.maximum(v - pad[k - s : k - s + m], pad[2 * k - s : 2 * k - s + m] - v), out=r)
            lo, hi = self.line.ends(v, r)
            total += m * (self.psi[k] - self.psi[m]) - self.psi[hi - lo].sum()
        return max(0.0, float(self.psi[len(y)] + total / len(y)))
