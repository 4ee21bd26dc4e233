"""Vectorised access to the texts of Arrow batches.

Everything works on a *chunk*: the UTF-8 bytes of some rows laid end to end
with the offsets of the rows.  Chunks are cut at about ``CHUNK_BYTES`` so that
the numpy temporaries of a Python worker stay small whatever the batch size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 20
U = np.uint64

_WS = np.zeros(256, bool)
_WS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
IS_WORD = ~_WS


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of SplitMix64."""
    h = h.astype(U, copy=True)
    h ^= h >> U(30)
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


BYTE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
BASE = (U(0xD6E8FEB86659FD93), U(0xA0761D6478BD642F))
LOW = np.array([(1 << (8 * i)) - 1 for i in range(9)], U)
WIDE = 64


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1), modulo 2**64."""
    out = np.full(max(n, 1), base, U)
    out[0] = 1
    return np.multiply.accumulate(out)


class Chunk:
    """``data``: bytes; ``offs``: row offsets (rows + 1); ``rows``: row numbers in the batch."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, rows: np.ndarray):
        self.data, self.offs, self.rows = data, offs, rows
        self.known: dict = {}

    @property
    def n(self) -> int:
        return len(self.rows)

    def narrow(self, keep: np.ndarray) -> Chunk:
        """The rows of the mask ``keep`` only."""
        if keep.all():
            return self
        lens = np.diff(self.offs)
        offs = np.concatenate([[0], np.cumsum(lens[keep])])
        out = Chunk(self.data[np.repeat(keep, lens)], offs, self.rows[keep])
        out.known = {f: x[keep] for f, x in self.known.items()}
        return out

    def count(self, f) -> np.ndarray:
        """f(self), a number for each row, worked out once and kept when rows are left out."""
        if f not in self.known:
            self.known[f] = f(self)
        return self.known[f]

    def per_row(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a per-byte array over each row."""
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[self.offs[1:]] - total[self.offs[:-1]]

    def spans(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maximal runs of ``inside`` that do not cross rows: starts, ends, rows (local)."""
        if not len(self.data):
            z = np.zeros(0, np.int64)
            return z, z, z
        lens = np.diff(self.offs)
        head, tail = self.offs[:-1][lens > 0], self.offs[1:][lens > 0] - 1
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        first[head] = inside[head]
        last[tail] = inside[tail]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        return s, e, np.repeat(np.arange(self.n), np.diff(np.searchsorted(s, self.offs)))

    def hashed(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """64-bit hash of each run's bytes; a function of the bytes alone.  Runs up to ``WIDE`` are read eight bytes at a time."""
        if not len(s):
            return np.zeros(0, U)
        lens = e - s
        eights = np.ndarray(len(self.data) + 1, "<u8", np.concatenate([self.data, np.zeros(8, np.uint8)]), strides=(1,))
        out = mix(lens.astype(U) * BASE[1] + (eights[s] & LOW[np.minimum(lens, 8)]))
        more, j = np.flatnonzero((lens > 8) & (lens <= WIDE)), 8
        while len(more):
            n = lens[more]
            out[more] = mix(out[more] + (eights[s[more] + j] & LOW[np.minimum(n - j, 8)]))
            j += 8
            more = more[n > j]
        tall = np.flatnonzero(lens > WIDE)
        if len(tall):
            n = lens[tall]
            at = np.cumsum(n) - n
            place = np.arange(int(n.sum())) - np.repeat(at, n)
            v = BYTE[self.data[np.repeat(s[tall], n) + place]] * powers(BASE[0], int(n.max()))[place]
            out[tall] = mix(np.add.reduceat(v, at) + n.astype(U))
        return out

    @cached_property
    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.spans(IS_WORD[self.data])

    @cached_property
    def word_hash(self) -> np.ndarray:
        return self.hashed(*self.words[:2])

    @cached_property
    def word_offs(self) -> np.ndarray:
        """Offsets of the rows in the words."""
        return np.concatenate([[0], np.cumsum(np.bincount(self.words[2], minlength=self.n))])

    def word_windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Start word and hash of every window of k words within a row."""
        h, row = self.word_hash, self.words[2]
        if len(h) < k:
            return np.zeros(0, np.int64), np.zeros(0, U)
        at = np.flatnonzero(row[k - 1 :] == row[: len(row) - k + 1])
        acc = h[: len(h) - k + 1]
        for j in range(1, k):
            acc = mix(acc) + h[j : j + len(acc)]
        return at, mix(acc[at])


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The rows of a column as chunks of about ``most`` bytes, a longer text as one chunk."""
    data, offs = utf8(column)
    a, n = 0, len(offs) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + most, side="right")) - 1)
        b = min(b, n)
        yield Chunk(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a], np.arange(a, b))
        a = b


def text_of(column: pa.Array, i: int) -> str | None:
    return column[i].as_py()


def named(docs: DataFrame, only_name: bool = False) -> DataFrame | Column:
    """doc_id, k, text.  k, 128 bits of md5, names doc_id and text: rows that share it are equal in both.  A null text is empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    k = F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(" "), text)))
    return k if only_name else docs.select("doc_id", k.alias("k"), text.alias("text"))
