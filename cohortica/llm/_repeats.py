"""From shared names to exact repeats.

An *instance* says: the windows of one text that start at units a .. b all
have the anchor ``name``, which depends on a window's content alone, and the
units a .. b + width of that text hash to (c1, c2).  Two equal windows have
equal names.  So only instances of names that occur twice can hold repeats:

* instances with an equal name and equal contexts: all their windows repeat;
* names with several different contexts: one instance of each context stands
  for it; its windows are compared in cells, by all that a cell's windows have
  in common, and in the end one by one, by 128-bit hashes.

Copies never form pairs: each step counts keys with map-side combining and
joins the counts back, so a group of any size costs its rows and no more.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortica.llm._store import discard, save
from cohortica.llm._text import BASE, Chunk, U, chunks, mix, powers, utf8

INSTANCE = "name bigint, c1 bigint, c2 bigint, k bigint, ab bigint"
SPAN = 1024  # ab = (a * SPAN + (b - a)) * SPAN + (place of the anchor - b)
GROUP = 64  # contexts of a name that are compared as they are
_BACK = tuple(U(pow(int(b), -1, 2**64)) for b in BASE)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, k, text.  k names a row's content: rows that share it are equal and get equal results."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", F.xxhash64("doc_id", text).alias("k"), text.alias("text"))


@lru_cache(maxsize=8)
def _table(base: int, n: int) -> np.ndarray:
    return powers(U(base), n)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return _table(int(base), 1 << max(1, n).bit_length())[:n] if n < 1 << 21 else powers(base, n)


class Hasher:
    """128-bit hashes of any ranges of a sequence of 64-bit units."""

    def __init__(self, units: np.ndarray):
        n = len(units)
        self.sums, self.back = [], []
        for j in range(2):
            v = (units if j == 0 else mix(units ^ U(0x5851F42D4C957F2D))) * _powers(BASE[j], n)
            self.sums.append(np.concatenate([np.zeros(1, U), np.cumsum(v, dtype=U)]))
            self.back.append(_powers(_BACK[j], n + 1))

    def of(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple(mix((s[b] - s[a]) * p[a] + (b - a).astype(U)) for s, p in zip(self.sums, self.back, strict=True))

    def grams(self, k: int) -> np.ndarray:
        """Hash of each run of k units."""
        s, n = self.sums[0], len(self.sums[0]) - k
        return mix((s[k:] - s[:-k]) * self.back[0][:n]) if n > 0 else np.zeros(0, U)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == U else x.astype(np.int64), pa.int64())


def emit(c: Chunk, keys: np.ndarray, first: np.ndarray, at: np.ndarray, row: np.ndarray, name: np.ndarray, place: np.ndarray, hasher: Hasher, width: int) -> pa.RecordBatch:
    """Instances of a chunk.  at: window starts, ascending; row, name, place: of each, its row, anchor's name and the unit where the anchor is; first: the rows' first units."""
    if not len(at):
        z = pa.array([], pa.int64())
        return pa.RecordBatch.from_arrays([z] * 5, names=["name", "c1", "c2", "k", "ab"])
    new = np.ones(len(at), bool)
    new[1:] = (place[1:] != place[:-1]) | (name[1:] != name[:-1]) | (at[1:] != at[:-1] + 1) | (row[1:] != row[:-1])
    s = np.flatnonzero(new)
    e = np.append(s[1:], len(at)) - 1
    a, b = at[s], at[e]
    c1, c2 = hasher.of(a, b + width)
    return pa.RecordBatch.from_arrays([signed(x) for x in (name[s], c1, c2, keys[c.rows[row[s]]], ((a - first[row[s]]) * SPAN + (b - a)) * SPAN + (place[s] - b))], names=["name", "c1", "c2", "k", "ab"])


def twice(rows: DataFrame, *by: str) -> DataFrame:
    """The keys that occur more than once."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")


def repeats(docs: DataFrame, instances: Callable[[Chunk, np.ndarray], pa.RecordBatch], windows: Callable[[Chunk], tuple[np.ndarray, Hasher]], width: int, cell: int, small: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """k, spans: of every text with repeats, the ranges [lo, hi) of units in repeated windows (may overlap).

    docs: as of ``keyed``.  windows: of a chunk, the rows' first units and the hasher of its units.
    small: compares the contexts of names with at most ``GROUP`` of them.  All others are cut into cells of ``cell`` windows with
    names of their own, and only windows of cells that still have several contexts are hashed one by one.
    """
    if not 0 < width < SPAN:
        raise ValueError(f"a window has 1 to {SPAN - 1} units")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column("k").to_numpy(zero_copy_only=False)
            for c in chunks(b.column("text")):
                yield instances(c, keys)

    made = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        made.append(save(df, name))
        return made[-1]

    a, more = f"ab div {SPAN * SPAN}", f"ab div {SPAN} % {SPAN}"

    def level(found: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Spans of the instances whose contexts recur; one instance of each context of the names with several."""
        # counts are tables of their own when they are joined back: only then can Spark split a frequent key of the join
        names = keep(twice(found, "name"), "names")
        shared = keep(found.join(names, "name"), "shared")
        discard(found)
        contexts = keep(shared.groupBy("name", "c1", "c2").agg(F.count(F.lit(1)).alias("n"), F.max("single").alias("single"), F.first("k").alias("k"), F.first("ab").alias("ab")), "contexts")
        whole = shared.where("single = 1").join(contexts.where("n > 1").select("name", "c1", "c2"), ["name", "c1", "c2"])
        sizes = keep(contexts.groupBy("name").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "sizes")
        # ab, twice over, plus 1 for a context that one instance has
        alone = (F.when(F.col("n") == 1, F.col("single")).otherwise(0)).cast("int")
        return whole.select("k", F.expr(a).alias("lo"), F.expr(f"{a} + {more} + {width}").alias("hi")), contexts.join(sizes, "name").select("name", "m", "k", (F.col("ab") * 2 + alone).alias("ab"))

    spans, open_ = level(save(docs.select("k", "text").mapInArrow(parse, INSTANCE).withColumn("single", F.lit(1)), "instances"))
    if small is not None:
        few = open_.where(F.col("m") <= GROUP)
        spans = spans.unionByName(small(docs.join(few.groupBy("k").agg(F.collect_list(F.struct("name", "ab")).alias("open")), "k")))
        open_ = open_.where(F.col("m") > GROUP)

    def opened(b: pa.RecordBatch) -> Iterator[tuple]:
        """Of each chunk: hasher, rows' first units, and of each open instance its row, single, a, b and anchor."""
        lists = b.column("abs")
        for c in chunks(b.column("text")):
            first, hasher = windows(c)
            packed = [np.array(lists[int(i)].as_py(), np.int64) for i in c.rows]
            p = np.concatenate(packed)
            row = np.repeat(np.arange(c.n), [len(x) for x in packed])
            ab = p >> 1
            lo = ab // (SPAN * SPAN)
            hi = lo + ab // SPAN % SPAN
            yield c, hasher, first[row], row, p & 1, lo, hi, hi + ab % SPAN

    def spread(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))

    def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Instances cut at multiples of ``cell`` units before the anchor, and named by all that the windows of a cell have in common."""
        for b in batches:
            keys = b.column("k").to_numpy(zero_copy_only=False)
            for c, hasher, first, row, single, lo, hi, anchor in opened(b):
                near, far = (anchor - hi) // cell, (anchor - lo) // cell
                n = far - near + 1
                at = spread(near, n)
                first, row, single, lo, hi, anchor = (np.repeat(x, n) for x in (first, row, single, lo, hi, anchor))
                x, y = np.maximum(lo, anchor - at * cell - cell + 1), np.minimum(hi, anchor - at * cell)
                g1, _ = hasher.of(first + anchor - at * cell, first + anchor - at * cell - cell + 1 + width)
                c1, c2 = hasher.of(first + x, first + y + width)
                yield pa.RecordBatch.from_arrays([signed(mix(g1 + at.astype(U))), signed(c1), signed(c2), signed(keys[c.rows[row]]), signed((x * SPAN + (y - x)) * SPAN + (anchor - y)), pa.array(single.astype(np.int32))], names=["name", "c1", "c2", "k", "ab", "single"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column("k").to_numpy(zero_copy_only=False)
            for c, hasher, first, row, single, lo, hi, _ in opened(b):
                n = hi - lo + 1
                at = spread(lo, n)
                first, row, single = (np.repeat(x, n) for x in (first, row, single))
                w1, w2 = hasher.of(first + at, first + at + width)
                yield pa.RecordBatch.from_arrays([signed(w1), signed(w2), signed(keys[c.rows[row]]), signed(at * 2 + single)], names=["w1", "w2", "k", "at"])

    def with_text(rows: DataFrame) -> DataFrame:
        return docs.join(rows.groupBy("k").agg(F.collect_list("ab").alias("abs")), "k").select("k", "abs", "text")

    more_spans, open_ = level(save(with_text(open_).mapInArrow(refine, INSTANCE + ", single int"), "cells"))
    # rows of equal content repeat each other, so that none of their windows is single
    tested = keep(with_text(open_).mapInArrow(compare, "w1 bigint, w2 bigint, k bigint, at bigint"), "windows")
    again = keep(twice(tested, "w1", "w2"), "again")
    edges = tested.where("at % 2 = 1").join(again, ["w1", "w2"]).select("k", F.expr("at div 2").alias("lo"), F.expr(f"at div 2 + {width}").alias("hi"))
    out = save(spans.unionByName(more_spans).unionByName(edges).groupBy("k").agg(F.collect_set(F.struct("lo", "hi")).alias("spans")), "spans")
    for used in made:
        discard(used)
    return out


def removed(spans: list, n: int) -> np.ndarray:
    """Mask of the n units that the spans cover."""
    edge = np.zeros(n + 1, np.int64)
    if spans:
        lo, hi = np.array([(s["lo"], s["hi"]) for s in spans], np.int64).T
        np.add.at(edge, lo, 1)
        np.add.at(edge, hi, -1)
    return np.cumsum(edge[:-1]) > 0


def kept(docs: DataFrame, found: DataFrame, cutter: Callable[[bytes, list], tuple]) -> DataFrame:
    """Every document with its spans applied: doc_id, n_units, n_removed, n_spans, kept (bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = utf8(b.column("text"))
            spans = b.column("spans")
            for i in range(b.num_rows):
                n, out, runs, rest = cutter(data[offs[i] : offs[i + 1]], spans[i].as_py() or [])
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(i, 1), *(pa.array([x], pa.int64()) for x in (n, out, runs)), pa.array([hashlib.sha256(rest).hexdigest()]), pa.array([rest], pa.binary())],
                    names=["doc_id", "n_units", "n_removed", "n_spans", "kept_sha256", "kept"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.join(found, "k", "left").select("doc_id", "text", "spans").mapInArrow(run, f"doc_id {kind}, n_units bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
