"""The estimators of information by all distances at once, written from their formulas: what the tests compare with."""

import math

import numpy as np


def psi(n):
    return sum(1 / i for i in range(1, int(n))) - 0.57721566490153286061


def mean_psi(counts):
    return float(np.mean([psi(c) for c in counts]))


def distances(*columns):
    return np.max([np.abs(c[:, None] - c[None, :]) for c in columns], axis=0)


def kth(d, k):
    return np.sort(d, axis=1)[:, k]


def held(d, r):
    return ((d < r[:, None]) | (d == 0)).sum(axis=1)


def ksg(x, y, k=3, scale=False):
    """x, y: lists of columns."""
    if scale:
        x, y = ([c / (c.std() or 1) for c in z] for z in (x, y))
    r = kth(distances(*x, *y), k)
    out = psi(len(r)) + psi(k) - mean_psi(held(distances(*x), r)) - mean_psi(held(distances(*y), r))
    return max(0.0, out) if scale else out


def cmi(x, y, z, k=3):
    r = kth(distances(x, y, z), k)
    return psi(k) - mean_psi(held(distances(x, z), r)) - mean_psi(held(distances(y, z), r)) + mean_psi(held(distances(z), r))


def entropy(x, k=3):
    """x: list of columns without equal rows."""
    r = kth(distances(*x), k)
    return psi(len(r)) - psi(k) + len(x) * (math.log(2) + float(np.mean(np.log(r))))


def class_entropy(x, y, k=3):
    h = entropy(x, k)
    return abs(h - sum((y == c).mean() * (entropy([v[y == c] for v in x], k) if (y == c).sum() > k else h) for c in set(y)))


def ross(x, y, k=3):
    keep = np.array([(y == c).sum() > 1 for c in y], bool)
    x, y = x[keep], y[keep]
    if not len(x):
        return 0.0
    m, ks, size = [], [], []
    for i, v in enumerate(x):
        own = np.abs(x[y == y[i]] - v)
        kk = min(k, len(own) - 1)
        r = np.sort(own)[kk]
        d = np.abs(x - v)
        m.append(((d < r) | (d == 0)).sum())
        ks.append(kk)
        size.append(len(own))
    return max(0.0, psi(len(x)) + mean_psi(ks) - mean_psi(size) - mean_psi(m))
