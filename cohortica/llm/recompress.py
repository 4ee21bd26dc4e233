"""Substring dedup of words by recompression.

A text's words are renamed in rounds.  A round names runs of one symbol (in
``RUN_ROUNDS``) and then pairs: a random bit of a symbol's name says whether it
opens or closes a pair, so pairs never overlap and every occurrence of a pair
is named alike.  Names are hashes of what they stand for, which makes them
global without a dictionary to share.  Equal word sequences get equal symbols
except near their ends, where a symbol may join with what lies outside.  How
far in the ends reach follows from the window alone: one symbol a round and
side at most, and none where the outermost symbol cannot join outwards.

Every window takes as its anchor, among the symbols of the deepest round that
lie wholly within what its own words fix, the ``TOGETHER`` neighbours of
smallest joint name (all of them where they are fewer).  Equal windows
have equal anchors, so a Spark count of anchors reveals the long repeats, and
their contexts and windows verify them (see ``_repeats``).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from cohortica.llm._repeats import Hasher, emit, keyed, kept, removed, repeats
from cohortica.llm._text import Chunk, U, mix

ROUNDS = 4
TOGETHER = 3
RUN_ROUNDS = (0, 2)
_A, _B, _R = U(0x9FB21C651E98DF25), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9)


def _join(start: np.ndarray, sym: np.ndarray, row: np.ndarray, head: np.ndarray, name) -> tuple:
    """Symbols merged into those marked by ``head``; name(first, next of each merged, how many)."""
    at = np.flatnonzero(head)
    size = np.diff(np.append(at, len(sym)))
    out = sym[at]
    many = size > 1
    out[many] = name(sym[at[many]], sym[at[many] + size[many] - 1], size[many])
    return start[at], out, row[at]


def _inverse(start: np.ndarray, n: int) -> np.ndarray:
    """Number of the symbol that starts at each unit; only starts (and the end) are looked up."""
    out = np.zeros(n + 1, np.int64)
    out[start] = np.arange(len(start))
    out[n] = len(start)
    return out


def _smallest(sym: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Leftmost symbol of smallest name in each range [lo, hi) of symbols."""
    bits = max(1, int(len(sym)).bit_length())
    key = (sym >> U(bits) << U(bits)) | np.arange(len(sym), dtype=U)
    length = hi - lo
    out = np.zeros(len(lo), U)
    level, span = key, 1
    while len(lo):
        now = (length >= span) & (length < 2 * span)
        if now.any():
            out[now] = np.minimum(level[lo[now]], level[hi[now] - span])
        if not (length >= 2 * span).any():
            break
        level = np.minimum(level[:-span], level[span:])
        span *= 2
    return (out & U((1 << bits) - 1)).astype(np.int64)


def anchors(h: np.ndarray, row: np.ndarray, width: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window starts, and of each the anchor's name and its first unit.

    h: the units' names; row: the rows they belong to, ascending.
    """
    n = len(h)
    if n < width:
        z = np.zeros(0, np.int64)
        return z, np.zeros(0, U), z
    at = np.flatnonzero(row[width - 1 :] == row[: n - width + 1])
    start, sym, own = np.arange(n), mix(h), row
    left, right = at.copy(), at + width
    name = np.zeros(len(at), U)
    place = np.zeros(len(at), np.int64)
    live = np.arange(len(at))  # windows whose core is not empty yet

    def choose(level: int) -> None:
        inv = _inverse(start, n)
        lo, hi = inv[left], inv[right]
        joint = sym
        for j in range(1, TOGETHER + 1):
            if j > 1:
                joint = mix(joint[:-1] * _A + sym[j - 1 :] * _B)
            own = hi - lo >= j if j == TOGETHER else hi - lo == j
            if own.any():
                best = _smallest(joint, lo[own], hi[own] - j + 1)
                name[live[own]] = mix(joint[best] + U(level * int(_R) + j & (2**64 - 1)))
                place[live[own]] = start[best]

    choose(0)
    for r in range(rounds):
        if r in RUN_ROUNDS:
            head = np.ones(len(sym), bool)
            head[1:] = (sym[1:] != sym[:-1]) | (own[1:] != own[:-1])
            inv = _inverse(start, n)
            group = np.cumsum(head) - 1
            first = np.append(np.flatnonzero(head), len(sym))
            ends = np.append(start, n)
            left = ends[first[group[inv[left]] + 1]]  # a run at the edge may go on outside
            right = ends[first[group[inv[right] - 1]]]
            ok = left < right
            live, left, right = live[ok], left[ok], right[ok]
            start, sym, own = _join(start, sym, own, head, lambda a, _, size: mix(a * _A + size.astype(U) * _R + U(1)))
        opens = (mix(sym + U((r + 1) * int(_A) & (2**64 - 1))) & U(1)) == 1
        tail = np.zeros(len(sym), bool)
        tail[1:] = opens[:-1] & ~opens[1:] & (own[1:] == own[:-1])
        inv = _inverse(start, n)
        ends = np.append(start, n)
        if len(live):
            i, j = inv[left], inv[right] - 1
            left = np.where(opens[i], left, ends[i + 1])  # a closing symbol may belong to one outside
            right = np.where(opens[j], start[j], right)
            ok = left < right
            live, left, right = live[ok], left[ok], right[ok]
        start, sym, own = _join(start, sym, own, ~tail, lambda a, b, _, r=r: mix(a * _A + mix(b + U(r * int(_R) & (2**64 - 1))) * _B))
        if not len(live):
            break
        choose(r + 1)
    return at, name, place


def instances(width: int):
    def run(c: Chunk, keys: np.ndarray):
        h, row = c.word_hash, c.words[2]
        at, name, place = anchors(h, row, width)
        return emit(c, keys, c.word_offs[:-1], at, row[at], name, place, Hasher(h), width)

    return run


def dedup_words(docs: DataFrame, width: int = 35) -> DataFrame:
    """Remove every word in a window of ``width`` words that also starts elsewhere.

    Words are runs of other than ASCII white space.  Windows are judged on the
    input; they lie within one row, and rows of equal content repeat each
    other.  A null text has no words; texts shorter than a window keep all.
    Returns doc_id, n_words, n_removed, n_spans, kept_sha256 and kept (the
    words that stay, joined by one space, UTF-8 bytes); other columns of
    ``docs`` are ignored.
    """
    rows = keyed(docs)
    found = repeats(rows, instances(width), lambda c: (c.word_offs[:-1], Hasher(c.word_hash)), width, 8)

    def cut(data: np.ndarray, spans: list) -> tuple:
        c = Chunk(data, np.array([0, len(data)]), np.zeros(1, np.int64))
        n = len(c.words[0])
        if not n:
            return 0, 0, 0, b""
        out = removed(spans, n)
        runs = int(out[0]) + int((out[1:] & ~out[:-1]).sum())
        words = data.tobytes().split()
        return n, int(out.sum()), runs, b" ".join(words if not out.any() else [w for w, x in zip(words, out.tolist(), strict=True) if not x])

    return kept(rows, found, cut).withColumnRenamed("n_units", "n_words")


