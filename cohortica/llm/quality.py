"""Quality rules, as a short-circuit cascade.

Every rule names what it rejects.  ``plan_rules`` times each rule on a bounded
sample and measures what share it rejects; rules are then ordered by rejection
per cost, and each rule sees only the texts that every earlier rule let pass.
The order is a matter of cost alone: a text is kept when no rule rejects it.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortica.llm._store import smallest
from cohortica.llm._text import IS_WORD, Chunk, chunks

SYMBOLS = b"#*$%&|<>"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_POINT = (np.arange(256) & 0xC0) != 0x80
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[0xC0:] = True
REPEAT_WINDOW = 8


def n_words(c: Chunk) -> np.ndarray:
    return np.diff(c.word_offs)


def word_chars(c: Chunk) -> np.ndarray:
    """Code points in words."""
    return c.per_row(IS_WORD[c.data] & _POINT[c.data])


def n_symbols(c: Chunk) -> np.ndarray:
    return c.per_row(_SYMBOL[c.data])


def n_letters(c: Chunk) -> np.ndarray:
    """ASCII letters and first bytes of longer code points."""
    return c.per_row(_LETTER[c.data])


def repeated(row: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Masks: pairs (row, key) that occur more than once; those that equal an earlier one."""
    if not len(key):
        return np.zeros(0, bool), np.zeros(0, bool)
    order = np.lexsort((key, row))
    r, k = row[order], key[order]
    same = np.zeros(len(r), bool)
    same[1:] = (r[1:] == r[:-1]) & (k[1:] == k[:-1])
    twice = same.copy()
    twice[:-1] |= same[1:]
    many, later = np.zeros(len(r), bool), np.zeros(len(r), bool)
    many[order], later[order] = twice, same
    return many, later


def n_dup_lines(c: Chunk) -> np.ndarray:
    """Lines with a word that equal an earlier line of the text."""
    inside = c.data != 10
    s, e, row = c.spans(inside)
    ws = np.concatenate([c.words[0], [np.iinfo(np.int64).max]])
    full = ws[np.searchsorted(ws, s)] < e if len(s) else np.zeros(0, bool)
    later = repeated(row, c.hashed(s, e))[1]
    return np.bincount(row[later & full], minlength=c.n)


def n_repeat_words(c: Chunk, k: int = REPEAT_WINDOW) -> np.ndarray:
    """Words that lie in windows of k words found twice or more in the text."""
    at, key = c.word_windows(k)
    row = c.words[2]
    many = repeated(row[at], key)[0]
    edge = np.zeros(len(row) + 1, np.int64)
    np.add.at(edge, at[many], 1)
    np.add.at(edge, at[many] + k, -1)
    return np.bincount(row[np.cumsum(edge[:-1]) > 0], minlength=c.n)


BASE = (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)
BASE_COLUMNS = tuple(f.__name__ for f in BASE)


@dataclass(frozen=True)
class Rule:
    """``rejects``: from a chunk to a mask of its rows."""

    name: str
    rejects: Callable[[Chunk], np.ndarray]


def _mean_word(c: Chunk) -> np.ndarray:
    n, chars = c.count(n_words), c.count(word_chars)
    return (chars < 2 * n) | (chars > 20 * n)


def _symbol_share(c: Chunk) -> np.ndarray:
    return 2 * c.count(n_symbols) > c.count(n_words)


def _dup_lines(c: Chunk) -> np.ndarray:
    return 2 * c.count(n_dup_lines) > c.per_row(c.data == 10) + 1


def _shouting(c: Chunk) -> np.ndarray:
    return 10 * c.per_row(_UPPER[c.data]) > 7 * c.count(n_letters)


def _few_letters(c: Chunk) -> np.ndarray:
    return 2 * c.count(n_letters) < c.count(word_chars)


RULES = (
    Rule("mean_word_length", _mean_word),
    Rule("symbol_share", _symbol_share),
    Rule("duplicate_lines", _dup_lines),
    Rule("shouting", _shouting),
    Rule("few_letters", _few_letters),
)


def base(c: Chunk, min_words: int, most_repeated: int) -> np.ndarray:
    """Rows that fail the base; all base counts of the chunk are known then."""
    for f in BASE:
        c.count(f)
    return (c.count(n_words) < min_words) | (100 * c.count(n_repeat_words) > most_repeated * c.count(n_words))


def plan_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 500, max_chars: int = 50_000, min_words: int = 20, most_repeated: int = 30) -> list[tuple[Rule, float, float]]:
    """Rules by rejection per cost, with seconds a row and rejected share on at most ``sample_rows`` texts that pass the base.

    The sample is drawn from the rows with the smallest text hashes, of texts of
    up to ``max_chars`` characters.  Every rule is timed as it runs later: base
    counts are known, anything else that it counts is charged to it.
    """
    texts = [r[0] for r in smallest(docs.select("text").where("text is not null").where(F.length("text") <= max_chars), F.xxhash64("text"), sample_rows).collect()]
    passing = [c.narrow(~base(c, min_words, most_repeated)) for c in chunks(pa.array(texts, pa.large_string()))]
    n = max(1, sum(c.n for c in passing))
    measured = []
    for rule in rules:
        began, out = time.perf_counter(), 0
        for c in passing:
            again = c.narrow(np.ones(c.n, bool))
            known = dict(again.known)
            out += int(rule.rejects(again).sum())
            again.known = known
        measured.append((rule, max(1e-9, (time.perf_counter() - began) / n), out / n))
    return sorted(measured, key=lambda m: -m[2] / m[1])


def expected_cost(plan: list[tuple[Rule, float, float]]) -> float:
    """Seconds a row of the cascade in this order, were the rules independent: what an order saves is the difference of two."""
    left, total = 1.0, 0.0
    for _, cost, rejected in plan:
        total += left * cost
        left *= 1 - rejected
    return total


def cascade(c: Chunk, rules: list[Rule]) -> tuple[np.ndarray, np.ndarray]:
    """Mask of the rows that pass, and the number in ``rules`` of the rule that rejected each row (-1: none)."""
    by = np.full(c.n, -1)
    left, alive = c, np.arange(c.n)
    for i, rule in enumerate(rules):
        if not len(alive):
            break
        bad = rule.rejects(left)
        if bad.any():
            by[alive[bad]] = i
            left, alive = left.narrow(~bad), alive[~bad]
    return by < 0, by


def quality(docs: DataFrame, rules: list[Rule] | None = None, min_words: int = 20, most_repeated: int = 30) -> DataFrame:
    """Base counts and the cascade's verdict for every document.

    A null text has no words and fails the base.  Empty tables give no rows;
    other columns of ``docs`` are ignored.  Base: fewer than ``min_words``
    words, or over ``most_repeated`` per cent of them in repeated windows.
    Returns doc_id, the base counts, base_failed, kept and rejected_by.
    """
    order = rules if rules is not None else [m[0] for m in plan_rules(docs, min_words=min_words, most_repeated=most_repeated)]
    names = [r.name for r in order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in chunks(b.column("text")):
                failed = base(c, min_words, most_repeated)
                cols = [c.count(f) for f in BASE]
                passed, by = np.zeros(c.n, bool), np.full(c.n, -1)
                ok = ~failed
                passed[ok], by[ok] = cascade(c.narrow(ok), order)
                said = ["base" if f else names[i] if i >= 0 else None for f, i in zip(failed, by, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(int(c.rows[0]), c.n), *(pa.array(x.astype(np.int64)) for x in cols), pa.array(failed), pa.array(passed & ok), pa.array(said, pa.string())],
                    names=["doc_id", *BASE_COLUMNS, "base_failed", "kept", "rejected_by"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, " + ", ".join(f"{x} bigint" for x in BASE_COLUMNS) + ", base_failed boolean, kept boolean, rejected_by string"
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
