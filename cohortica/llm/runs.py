"""Periodic runs of words: stretches that repeat a period several times over.

A run's Lyndon root is the longest Lyndon word at its first letter, under the
order of the words or its reverse, so the next smaller and the next greater
suffix of every place are all the candidates there are.  Ukkonen's suffix tree
gives the order of the suffixes; its Euler tour with range minima over the
string depths gives, in constant time, how far two places agree to the right,
and the tree of the reversal how far they agree to the left.  A candidate
extended both ways is a run if it is long enough.

Trees are grown only where a run can be: in a run of four periods every pair of
neighbouring words occurs three times, so stretches between pairs that do not
are left out.  They hold no part of a run, and the result is exact.  Stretches
share trees, kept apart by symbols that occur once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortica.llm._text import CHUNK_BYTES, U, mix

LEAST = 6  # words of a run at least
TIMES = 4  # periods of a run at least
TREE_WORDS = 1 << 15  # words of stretches that share a tree; a longer stretch has one of its own
_A, _B, _C = U(0x9FB21C651E98DF25), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9)
_FIELD = 16  # places of the Euler tour that share a minimum


def suffix_tree(s: list[int], symbols: int) -> tuple[list[int], list[int], dict[int, int]]:
    """Ukkonen's tree of s, whose last symbol occurs nowhere else: start and end of each node's edge, and node * symbols + first symbol -> child."""
    n = len(s)
    start, end, link = [0], [0], [0]
    child: dict[int, int] = {}
    find = child.get
    node = edge = length = left = 0
    for i, c in enumerate(s):
        last = 0
        left += 1
        while left:
            if not length:
                edge = i
            key = node * symbols + s[edge]
            below = find(key)
            if below is None:
                child[key] = len(start)
                start.append(i)
                end.append(n)
                link.append(0)
                if last:
                    link[last] = node
                last = node
            else:
                a = start[below]
                size = end[below] - a
                if length >= size:  # walk down
                    edge += size
                    length -= size
                    node = below
                    continue
                if s[a + length] == c:
                    length += 1
                    if last:
                        link[last] = node
                    break
                split = len(start)
                start += (a, i)
                end += (a + length, n)
                link += (0, 0)
                child[key] = split
                child[split * symbols + c] = split + 1
                start[below] = a + length
                child[split * symbols + s[a + length]] = below
                if last:
                    link[last] = split
                last = split
            left -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                edge = i - left + 1
    return start, end, child


class Agreement:
    """How far any two suffixes of a sequence agree, by the lowest common ancestor of their leaves."""

    def __init__(self, s: list[int], symbols: int):
        """s holds symbols from 1; 0 is put at its end."""
        s = [*s, 0]
        n = len(s)
        start, end, child = suffix_tree(s, symbols)
        keys, nodes = np.fromiter(child.keys(), np.int64, len(child)), np.fromiter(child.values(), np.int64, len(child))
        order = np.argsort(keys)
        below = nodes[order].tolist()
        first = np.searchsorted(keys[order] // symbols, np.arange(len(start) + 1)).tolist()
        depth = [0] * len(start)
        tour: list[int] = []
        at = [0] * n
        leaves: list[int] = []
        todo = [0]
        while todo:
            u = todo.pop()
            if u < 0:  # back at a node from one of its children
                tour.append(depth[~u])
                continue
            d = depth[u]
            a, b = first[u], first[u + 1]
            if a == b:
                leaves.append(n - d)
                at[n - d] = len(tour)
            tour.append(d)
            for v in reversed(below[a:b]):
                depth[v] = d + end[v] - start[v]
                todo.append(~u)
                todo.append(v)
        self.leaves = leaves
        self.at = np.array(at, np.int64)
        size = -(-len(tour) // _FIELD) * _FIELD
        self.tour = np.full(size, np.iinfo(np.int32).max, np.int32)
        self.tour[: len(tour)] = tour
        fields = self.tour.reshape(-1, _FIELD)
        self.ahead = np.minimum.accumulate(fields, axis=1).ravel()
        self.behind = np.minimum.accumulate(fields[:, ::-1], axis=1)[:, ::-1].ravel()
        self.table = [fields.min(axis=1)]
        while len(self.table[-1]) > 1 << (len(self.table) - 1):
            t, half = self.table[-1], 1 << (len(self.table) - 1)
            self.table.append(np.minimum(t[:-half], t[half:]))

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = self.at[i], self.at[j]
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        out = np.minimum(self.behind[lo], self.ahead[hi])
        x, y = lo // _FIELD + 1, hi // _FIELD  # whole fields between
        level = np.frexp(np.maximum(y - x, 1))[1] - 1
        for k in np.unique(level[y > x]):
            own = (y > x) & (level == k)
            t = self.table[k]
            out[own] = np.minimum(out[own], np.minimum(t[x[own]], t[y[own] - (1 << int(k))]))
        near = np.flatnonzero(x > y)  # both in one field
        if len(near):
            low, high = lo[near], hi[near]
            least = self.tour[low]
            for d in range(1, _FIELD):
                at = np.minimum(low + d, high)
                least = np.minimum(least, self.tour[at])
            out[near] = least
        return out.astype(np.int64)


def _next(rank: list[int]) -> tuple[list[int], list[int]]:
    """Of each place, the next of smaller and of greater rank (or the end)."""
    n = len(rank)
    smaller, greater = [n] * n, [n] * n
    down: list[int] = []
    up: list[int] = []
    for i, r in enumerate(rank):
        while down and rank[down[-1]] > r:
            smaller[down.pop()] = i
        down.append(i)
        while up and rank[up[-1]] < r:
            greater[up.pop()] = i
        up.append(i)
    return smaller, greater


def runs_of(s: list[int], symbols: int, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """start, length, period of all runs of symbols 1 .. symbols - 1, by start, then period; times >= 2."""
    n = len(s)
    if n < max(least, times):
        return np.zeros((0, 3), np.int64)
    right, left = Agreement(s, symbols), Agreement(s[::-1], symbols)
    rank = np.empty(n + 1, np.int64)
    rank[right.leaves] = np.arange(n + 1)
    i = np.tile(np.arange(n), 2)
    j = np.concatenate([np.array(x, np.int64) for x in _next(rank[:n].tolist())])
    v = np.array(s)
    i, j = i[j < n], j[j < n]
    some = (v[i] == v[j]) | ((i > 0) & (v[i - 1] == v[j - 1]))
    i, j = i[some], j[some]
    after = right(i, j)
    before = np.where(i > 0, left(n - i, n - j), 0)
    p = j - i
    found = np.stack([i - before, before + p + after, p], axis=1)
    found = found[found[:, 1] >= np.maximum(least, times * p)]
    return np.unique(found[:, [0, 2, 1]], axis=0)[:, [0, 2, 1]] if len(found) else found


def _stretches(h: np.ndarray, group: np.ndarray, exact: bool) -> tuple[np.ndarray, np.ndarray]:
    """First words and ends of what is left where pairs of neighbours that occur less than TIMES - 1 times in their group are left out."""
    if len(h) < LEAST:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = mix(h[:-1] * _A + mix(h[1:] + group[1:].astype(U) * _C) * _B)
    if exact:
        _, inv, held = np.unique(key, return_inverse=True, return_counts=True)
    else:  # pairs that share a slot count for each other: more is kept, and nothing lost
        inv = (key >> U(44)).astype(np.int64)
        held = np.bincount(inv)
    ok = (held[inv] >= TIMES - 1) & (group[1:] == group[:-1])
    edge = np.flatnonzero(np.diff(np.concatenate([[False], ok, [False]]).astype(np.int8)))
    a, b = edge[::2], edge[1::2]
    keep = b - a >= LEAST - 1
    return a[keep], b[keep] + 1


def _within(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the ranges, and the range of each."""
    size = b - a
    of = np.repeat(np.arange(len(a)), size)
    return np.arange(int(size.sum())) + np.repeat(a - (np.cumsum(size) - size), size), of


def _find(docs: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs of each document."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in docs]
    sizes = np.array([len(w) for w in docs])
    first = np.cumsum(sizes) - sizes
    words = [w for d in docs for w in d]
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(U)
    a, b = _stretches(h, np.repeat(np.arange(len(docs)), sizes), False)
    while len(a):
        at, of = _within(a, b)
        x, y = _stretches(h[at], of, True)
        if int((y - x).sum()) == len(at):
            break
        a, b = at[x], at[y - 1] + 1
    g = 0
    while g < len(a):
        e = g + 1
        while e < len(a) and int((b[g : e + 1] - a[g : e + 1]).sum()) <= TREE_WORDS:
            e += 1
        names: dict[bytes, int] = {}
        s: list[int] = []
        places: list[int] = []
        for k in range(g, e):
            s += [names.setdefault(w, len(names) + 1) for w in words[a[k] : b[k]]]
            places += range(a[k], b[k])
            s.append(-(k - g) - 1)
            places.append(-1)
        symbols = len(names) + e - g + 1
        s = [c if c > 0 else len(names) - c for c in s]
        for start, length, period in runs_of(s, symbols).tolist():
            word = places[start]
            doc = int(np.searchsorted(first, word, side="right")) - 1
            out[doc].append((word - int(first[doc]), length, period))
        g = e
    return out


def _collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    if not found:
        return b" ".join(words)
    step = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        step[start + period] += 1
        step[start + length] -= 1
    return b" ".join([w for w, gone in zip(words, np.cumsum(step[:-1]).tolist(), strict=True) if not gone])


SCHEMA = "n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
_RUNS = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and collapsed, the text without what its runs repeat.

    Words are runs of other than ASCII white space.  A run is a stretch of
    words with smallest period q, of ``LEAST`` words and ``TIMES`` q at least,
    that no neighbouring word extends.  Words in a run after its first q go;
    those that stay are joined by one space.  A null or empty text has no
    words, no runs and an empty collapsed text; every row, repeated ones too,
    gives one row; an empty table gives none; columns besides doc_id and text
    are ignored, whatever their names.  A text is whole in one task, whose
    memory grows with its stretches that repeat pairs of words.  No shuffle.
    """

    def batch(ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        words = [[] if t is None else t.split() for t in texts.cast(pa.binary()).to_pylist()]  # bytes split at ASCII white space
        found = _find(words)
        runs = pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in f] for f in found], _RUNS)
        collapsed = pa.array(map(_collapsed, words, found), pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([ids, pa.array(map(len, words), pa.int64()), runs, collapsed], names=["doc_id", "n_words", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.large_string())
            size = np.cumsum([0 if v is None else v for v in pc.binary_length(texts).to_pylist()])
            a = 0
            while a < b.num_rows:
                before = int(size[a - 1]) if a else 0
                e = max(a + 1, int(np.searchsorted(size, before + CHUNK_BYTES, side="right")))
                yield batch(b.column(0).slice(a, e - a), texts.slice(a, e - a).cast(pa.string()))
                a = e

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {SCHEMA}")


def with_tails(docs: DataFrame, every: int = 10) -> DataFrame:
    """doc_id and text, where every ``every``-th document by crc32 of its id repeats from some word on.

    With h = crc32(doc_id), g = h div 10 and n words: where h mod ``every`` is 0,
    words from a = g mod n on repeat with period 1 + (n - a) div (3 + g mod 8).
    A document without doc_id or words stays as it is.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    tail = rows.select("doc_id", "text", h.alias("h"), F.when(h % every == 0, words).alias("w")).select("*", F.size("w").cast("bigint").alias("n"), F.floor(F.col("h") / 10).alias("g"))
    a = F.col("g") % F.col("n")
    p = 1 + F.floor((F.col("n") - a) / (3 + F.col("g") % 8))
    made = tail.select("doc_id", "text", "w", "n", F.when(F.col("n") > 0, a).alias("a"), F.when(F.col("n") > 0, p).alias("p"))
    at = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    again = F.array_join(F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1), lambda i: F.element_at("w", (at(i) + 1).cast("int"))), " ")
    return made.select("doc_id", F.when(F.col("n") > 0, again).otherwise(F.col("text")).alias("text"))
