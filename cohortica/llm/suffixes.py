"""Exact dedup of long byte strings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cohortica.llm._repeats import SPAN, Hasher, emit, keyed, kept, removed, repeats
from cohortica.llm._text import BYTE, Chunk, U

GRAM = 24


def _window_least(key: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` neighbours."""
    out, have = key, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def anchors(c: Chunk, hasher: Hasher, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Window starts, their rows, and the name and place of each window's least gram (the leftmost of equals)."""
    n = len(c.data)
    gram = min(GRAM, width)
    z = np.zeros(0, np.int64)
    if n < width:
        return z, z, np.zeros(0, U), z
    g = hasher.grams(gram)
    bits = max(1, n.bit_length())
    low = U((1 << bits) - 1)
    best = (_window_least((g & ~low) | np.arange(len(g), dtype=U), width - gram + 1) & low).astype(np.int64)
    lens = np.diff(c.offs)
    starts = np.maximum(lens - width + 1, 0)
    row = np.repeat(np.arange(c.n), starts)
    at = np.arange(len(row)) - np.repeat(np.cumsum(starts) - starts, starts) + c.offs[row]
    place = best[at]
    return at, row, g[place], place


def instances(width: int):
    def run(c: Chunk, keys: np.ndarray):
        hasher = Hasher(BYTE[c.data])
        at, row, name, place = anchors(c, hasher, width)
        return emit(c, keys, c.offs[:-1], at, row, name, place, hasher, width)

    return run


def _common(m: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each row of m with ``one``."""
    differ = m != one
    return np.where(differ.any(axis=1), differ.argmax(axis=1), m.shape[1])


def compare_contexts(rows: list[tuple], width: int) -> list[tuple]:
    """Repeated spans of the contexts of one name.  rows: (single, k, a, b, anchor, bytes of a .. b + width)."""
    most_l = max(p - a for _, _, a, _, p, _ in rows)
    most_r = max(len(x) - (p - a) for _, _, a, _, p, x in rows)
    left = np.full((len(rows), most_l + 1), -1, np.int16)  # no byte is -1 or -2
    right = np.full((len(rows), most_r + 1), -1, np.int16)
    for i, (_, _, a, _, p, x) in enumerate(rows):
        d = np.frombuffer(x, np.uint8)
        left[i, : p - a] = d[: p - a][::-1]
        right[i, : len(d) - (p - a)] = d[p - a :]
    out = []
    for i, (single, k, a, b, p, _) in enumerate(rows):
        if single:
            mine_l, mine_r = left[i].copy(), right[i].copy()
            mine_l[mine_l < 0] = -2
            mine_r[mine_r < 0] = -2
            far = np.minimum(_common(left, mine_l), p - a)
            near = np.maximum(width - _common(right, mine_r), p - b)
            far[i], near[i] = 0, 1 + width
            for lo, hi in set(zip((p - far[far >= near]).tolist(), (p - near[far >= near]).tolist(), strict=True)):
                out.append((k, lo, hi + width))
    return out


def small_groups(width: int):
    """Contexts brought together by name and compared byte by byte: at most ``GROUP`` of a name, whatever the data."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, keys, opened = b.column("text").cast(pa.binary()), b.column("k").to_pylist(), b.column("open")
            for i in range(b.num_rows):
                data = texts[i].as_py()
                found = opened[i].as_py()
                spans = []
                for x in found:
                    ab = x["ab"] >> 1
                    a = ab // (SPAN * SPAN)
                    spans.append(data[a : a + ab // SPAN % SPAN + width])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x["name"] for x in found], pa.int64()), pa.array([keys[i]] * len(found), pa.int64()), pa.array([x["ab"] for x in found], pa.int64()), pa.array(spans, pa.binary())],
                    names=["name", "k", "ab", "bytes"],
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, rows, out = None, [], []

        def batch():
            cols = list(zip(*out, strict=True)) or [[], [], []]
            return pa.RecordBatch.from_arrays([pa.array(list(x), pa.int64()) for x in cols], names=["k", "lo", "hi"])

        for b in batches:
            for n, k, ab, x in zip(*(b.column(c).to_pylist() for c in ("name", "k", "ab", "bytes")), strict=True):
                if n != name:
                    if rows:
                        out += compare_contexts(rows, width)
                    name, rows = n, []
                    if len(out) > 10_000:
                        yield batch()
                        out = []
                single, ab = ab & 1, ab >> 1
                a, more, place = ab // (SPAN * SPAN), ab // SPAN % SPAN, ab % SPAN
                rows.append((single, k, a, a + more, a + more + place, x))
        if rows:
            out += compare_contexts(rows, width)
        yield batch()

    def made(rows: DataFrame) -> DataFrame:
        parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        split = rows.select("k", "open", "text").mapInArrow(cut, "name bigint, k bigint, ab bigint, bytes binary")
        return split.repartition(parts, "name").sortWithinPartitions("name").mapInArrow(run, "k bigint, lo bigint, hi bigint")

    return made


def dedup_bytes(docs: DataFrame, width: int = 400) -> DataFrame:
    """Remove every byte in a string of ``width`` bytes that also starts elsewhere.

    Texts are UTF-8 bytes, null is empty; strings lie within one row and are
    judged on the input; rows of equal content repeat each other.  Returns
    doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and
    kept (the bytes that stay); other columns of ``docs`` are ignored.
    """
    rows = keyed(docs)
    found = repeats(rows, instances(width), lambda c: (c.offs[:-1], Hasher(BYTE[c.data])), width, 16, small_groups(width))

    def cut(data: np.ndarray, spans: list) -> tuple:
        out = removed(spans, len(data))
        if not len(out):
            return 0, 0, 0, b""
        return len(out), int(out.sum()), int(out[0]) + int((out[1:] & ~out[:-1]).sum()), data[~out].tobytes()

    return kept(rows, found, cut).withColumnRenamed("n_units", "n_bytes")


