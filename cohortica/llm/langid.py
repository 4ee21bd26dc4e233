"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text is the average of the embeddings of its hashed byte 3- and 4-grams; a
linear layer and a softmax give the language.  Both are learnt together by
stochastic gradient descent in numpy, on a bounded sample of labelled rows.
Since the average and the layer are linear, prediction adds up one
precomputed row of class scores per n-gram.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortica.llm._store import smallest
from cohortica.llm._text import Chunk, chunks

BITS = 15
_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32
_ANY_LETTER = regex.compile(r"\p{L}")


def ngram_buckets(c: Chunk) -> list[tuple[np.ndarray, np.ndarray]]:
    """For n = 3 and 4: bucket of the n-gram at each byte, and which of them lie within a row."""
    b = _LOWER[c.data]
    out = []
    for n, times in ((3, 0x9E3779B1), (4, 0x85EBCA6B)):
        size = max(0, len(b) - n + 1)
        g = np.zeros(size, np.uint32)
        for j in range(n):
            g |= b[j : j + size] << np.uint32(8 * j)
        inside = np.ones(size, bool)
        for end in c.offs[1:-1]:
            inside[max(0, end - n + 1) : end] = False
        h = (g * np.uint32(times)) ^ np.uint32(n)
        out.append(((h >> np.uint32(32 - BITS)).astype(np.int32) + ((n - 3) << BITS), inside))
    return out


@dataclass(frozen=True)
class Model:
    """``scores``: class scores of each bucket; ``threshold``: reject a lower calibrated score."""

    langs: list[str]
    scores: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float

    def predict(self, c: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Class and calibrated probability of each row."""
        k = len(self.langs)
        total, count = np.zeros((c.n, k)), np.zeros(c.n)
        lens = np.diff(c.offs)
        for at, inside in ngram_buckets(c):
            starts = c.offs[:-1]
            ok = (lens > 0) & (starts < len(at))
            count[ok] += np.add.reduceat(inside, starts[ok], dtype=np.int64) if ok.any() else 0
            for j in range(k if ok.any() else 0):
                v = self.scores[j][at]
                v *= inside
                total[ok, j] += np.add.reduceat(v, starts[ok], dtype=np.float64)
        z = (total / np.maximum(count, 1)[:, None] + self.bias) / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        p = z / z.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        return best, p[np.arange(c.n), best]


def _bags(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Buckets and their shares, text by text."""
    out = []
    for text in texts:
        data = np.frombuffer(text.encode(), np.uint8)
        found = ngram_buckets(Chunk(data, np.array([0, len(data)]), np.zeros(1, int)))
        at, n = np.unique(np.concatenate([a[i] for a, i in found]), return_counts=True)
        out.append((at, (n / max(1, n.sum())).astype(np.float32)))
    return out


def train(texts: list[str], labels: list[str], dims: int = 16, epochs: int = 6, rate: float = 1.0, seed: int = 7, lost: float = 0.002) -> Model:
    """Learn from texts with labels; every fifth row calibrates and does not train.

    ``lost``: the share of rightly labelled calibration rows that may score
    below 10/9 of the rejection threshold.
    """
    langs = sorted(set(labels))
    if not langs:
        return Model([], np.zeros((0, 2 << BITS), np.float32), np.zeros(0), 1.0, 0.0)
    y = np.array([langs.index(x) for x in labels], int)
    k = len(langs)
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (2 << BITS, dims)).astype(np.float32)
    out, bias = np.zeros((dims, k), np.float32), np.zeros(k, np.float32)
    bags = _bags(texts)
    fit = [i for i in range(len(y)) if i % 5] or list(range(len(y)))
    hold = [i for i in range(len(y)) if i % 5 == 0] or fit
    steps, done = epochs * len(fit), 0
    for _ in range(epochs):
        for i in rng.permutation(fit):
            at, share = bags[i]
            x = share @ emb[at] if len(at) else np.zeros(dims, np.float32)
            z = x @ out + bias
            z = np.exp(z - z.max())
            g = z / z.sum()
            g[y[i]] -= 1
            lr = np.float32(rate * (1 - done / steps))
            back = out @ g
            out -= lr * np.outer(x, g)
            bias -= lr * np.float32(0.01) * g
            if len(at):
                emb[at] -= (lr * share / (share @ share))[:, None] * back[None, :]  # moves x by lr * back
            done += 1
    table = emb @ out
    z = np.array([share @ table[at] if len(at) else np.zeros(k) for at, share in (bags[i] for i in hold)]).reshape(-1, k) + bias
    truth = y[hold]

    def prob(t: float) -> np.ndarray:
        p = np.exp((z - z.max(axis=1, keepdims=True)) / t)
        return p / p.sum(axis=1, keepdims=True)

    loss = [(-np.log(prob(t)[np.arange(len(truth)), truth] + 1e-12).mean(), t) for t in (0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 4.0)]
    t = min(loss)[1] if len(truth) else 1.0
    p = prob(t)
    right = p.max(axis=1)[p.argmax(axis=1) == truth] if len(truth) else np.zeros(0)
    cut = float(np.quantile(right, lost)) if len(right) else 0.0
    return Model(langs, np.ascontiguousarray(table.T.astype(np.float32)), bias.astype(float), float(t), cut * 0.9)


def remainder():
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))


def fit(docs: DataFrame, max_rows: int = 2000, max_chars: int = 50_000) -> Model:
    """A model from at most ``max_rows`` labelled rows of up to ``max_chars`` characters (so 100 M in all), never of those held out.

    They are those of smallest hash.  Only learning is bounded: prediction reads every whole text.
    """
    learn = docs.where("text is not null and lang is not null and doc_id is not null").where(remainder() != 2).where(F.length("text") <= max_chars)
    rows = smallest(learn.select("doc_id", "text", "lang"), F.xxhash64("doc_id"), max_rows).collect()
    rows.sort(key=lambda r: (str(r["doc_id"]), r["text"], r["lang"]))  # an order of its own, whatever the partitions
    return train([r["text"] for r in rows], [r["lang"] for r in rows])


def _predict(column: pa.Array, c: Chunk, m: Model) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and whether it is rejected, of the rows of a chunk."""
    some = np.array([x is not None and _ANY_LETTER.search(x) is not None for x in column.slice(int(c.rows[0]), c.n).to_pylist()], bool)
    if m.langs:
        best, p = m.predict(c)
        said = [m.langs[j] if ok else "und" for j, ok in zip(best, some, strict=True)]
        p = np.where(some, p, 0.0)
    else:
        said, p = ["und"] * c.n, np.zeros(c.n)
    return said, p, (p < m.threshold) | np.array([x == "und" for x in said], bool)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every document.

    A text that is null or has no letter is ``und`` with score 0 and rejected,
    as is any text when no language was learnt.  A calibrated score under the
    model's threshold is rejected too.  A null doc_id is not held out.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # its size is fixed by BITS and the languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            column = b.column("text")
            for c in chunks(column):
                said, p, rejected = _predict(column, c, m)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(int(c.rows[0]), c.n), b.column("held_out").slice(int(c.rows[0]), c.n), pa.array(said, pa.string()), pa.array(p, pa.float64()), pa.array(rejected)],
                    names=["doc_id", "held_out", "lang_pred", "score", "rejected"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.coalesce(remainder() == 2, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, rejected boolean")


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` whose language is not rejected, as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed by BITS and the languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column("text")
            rejected = [_predict(column, c, shared.value)[2] for c in chunks(column)]
            if rejected:
                yield b.filter(pa.array(~np.concatenate(rejected)))

    return docs.mapInArrow(run, docs.schema)
