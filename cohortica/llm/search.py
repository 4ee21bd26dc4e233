"""Ranked lexical search: term at a time, with a limit on accumulators.

Documents are dealt over tasks, and a task searches its own.  It works off the
terms of an item from the rarest on.  While what the terms to come can add, at
the most, may still lift a new document among the k best, the documents that
hold the term get accumulators; from then on no document is taken up, and those
that have an accumulator are updated by all further terms, so their scores are
exact.  The k-th best score so far includes what the task found in earlier
blocks.  The k best of all tasks are merged.

Only terms of the items are indexed; statistics are those of all documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortica.llm._store import discard, save

ITEMS_AT_ONCE = 1000  # items whose terms every task holds at once; more are searched in turns
BLOCK_POSTINGS = 1 << 20  # of the documents that a task searches at once
SEPARATORS = bytes(b for b in range(128) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122))
_FOLD = bytes(32 if b in SEPARATORS else b + 32 if 65 <= b <= 90 else b for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of anything beyond ASCII; only A-Z lower-cased."""
    return [] if text is None else text.encode().translate(_FOLD).split()


def _items(batch: DataFrame) -> tuple[list[tuple[object, list[int]]], dict[bytes, int]]:
    """Items, each with its distinct terms by number, and the numbers."""
    names: dict[bytes, int] = {}
    found = [(r[0], [names.setdefault(t, len(names)) for t in dict.fromkeys(terms_of(r[1]))]) for r in batch.collect()]
    return found, names


def _postings(docs: DataFrame, names: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms of the document), t, tf (those of the names that it holds, how often); documents without terms go."""
    shared = docs.sparkSession.sparkContext.broadcast(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b in batches:
            n, ts, tfs = [], [], []
            for i in range(b.num_rows):
                words = terms_of(b.column(1)[i].as_py())
                count: dict[int, int] = {}
                for t in map(known.get, words):
                    if t is not None:
                        count[t] = count.get(t, 0) + 1
                n.append(len(words))
                ts.append(list(count))
                tfs.append(list(count.values()))
            out = pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ts, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))], names=["doc_id", "n", "t", "tf"])
            yield out.filter(pc.greater(out.column(1), 0))

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n bigint, t array<int>, tf array<bigint>")


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Block:
    """Postings of some documents, in the order of their ids, by term."""

    def __init__(self, rows: pa.Table, weights: np.ndarray, n_docs: int, n_terms: int):
        order = pc.sort_indices(rows, sort_keys=[("doc_id", "ascending")], null_placement="at_end")
        rows = rows.take(order).combine_chunks()
        self.ids = rows.column("doc_id").combine_chunks()
        t, tf = (rows.column(c).combine_chunks() for c in ("t", "tf"))
        held = np.asarray(pc.list_value_length(t))
        doc = np.repeat(np.arange(len(held)), held)
        n = np.asarray(rows.column("n").combine_chunks())
        m = 50 + 50 * n * n_docs // n_terms
        t, tf = np.asarray(t.flatten()), np.asarray(tf.flatten())
        gain = weights[t] * (1_000_000_000 * tf // (1000 * tf + 20 * m[doc]))
        by = np.argsort(t, kind="stable")
        self.doc, self.gain = doc[by], gain[by]
        self.first = np.searchsorted(t[by], np.arange(len(weights) + 1))
        some = np.flatnonzero(np.diff(self.first))
        self.most = np.zeros(len(weights), np.int64)
        if len(some):
            self.most[some] = np.maximum.reduceat(self.gain, self.first[:-1][some])

    def search(self, terms: list[int], k: int, known: list[int]) -> list[tuple[int, object]]:
        """(score, doc_id) of documents that may be among the k best, the k best of this block among them; known: best scores found elsewhere."""
        held = [t for t in terms if self.most[t]]
        rest = np.append(np.cumsum(self.most[held][::-1])[::-1], 0).tolist()
        score = np.zeros(len(self.ids), np.int64)
        taken = np.zeros(0, np.int64)  # documents with an accumulator
        adding = True
        for i, t in enumerate(held):
            doc, gain = self.doc[self.first[t] : self.first[t + 1]], self.gain[self.first[t] : self.first[t + 1]]
            if adding and (len(taken) >= k or known):
                adding = rest[i] >= _kth(score[taken], k, known)
            if adding:
                taken = np.concatenate([taken, doc[(score[doc] == 0) & (gain > 0)]])
            else:
                old = score[doc] > 0
                doc, gain = doc[old], gain[old]
            score[doc] += gain
        best = score[taken]
        least = _kth(best, k, known)
        over = taken[best > least]
        level = np.sort(taken[best == least])[:k] if least else taken[:0]  # of equals the first by id
        return [(int(score[d]), self.ids[int(d)].as_py()) for d in np.concatenate([over, level])]


def _kth(scores: np.ndarray, k: int, known: list[int]) -> int:
    """The k-th best of scores and known ones, 0 where they are fewer."""
    both = np.concatenate([scores, np.array(known, np.int64)])
    return int(np.partition(both, len(both) - k)[len(both) - k]) if len(both) >= k else 0


def _place(x: tuple[int, object]) -> tuple:
    """Best score first, then by id, nulls last."""
    return (-x[0], x[1] is None, x[1] if x[1] is not None else 0)


def _turn(docs: DataFrame, items: list[tuple[object, list[int]]], names: dict[bytes, int], k: int, block: int) -> DataFrame:
    """item (its number), doc_id, score: the k best of each task."""
    spark = docs.sparkSession
    rows = save(_postings(docs, names), "postings")
    n_docs, n_terms = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    weights = np.zeros(len(names), np.int64)
    for t, df in rows.select(F.explode("t").alias("t")).groupBy("t").agg(F.count(F.lit(1))).collect():  # a row for each term of the items
        weights[t] = weight(n_docs, df)
    terms = [sorted(ts, key=lambda t: (-weights[t], t)) for _, ts in items]  # rarest first
    shared = spark.sparkContext.broadcast((weights, terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, terms = shared.value
        best: list[list[tuple[int, object]]] = [[] for _ in terms]
        held: list[pa.RecordBatch] = []

        def searched() -> None:
            b = Block(pa.Table.from_batches(held), weights, n_docs, n_terms)
            held.clear()
            for i, ts in enumerate(terms):
                found = b.search(ts, k, [s for s, _ in best[i]])
                if found:
                    best[i] = sorted(best[i] + found, key=_place)[:k]

        kind, size = pa.int64(), 0
        for b in batches:
            kind = b.schema.field("doc_id").type
            for part in (b.slice(i, 4096) for i in range(0, b.num_rows, 4096)):
                held.append(part)
                size += len(part.column(2).flatten())
                if size >= block:
                    searched()
                    size = 0
        if held:
            searched()
        flat = [(i, d, s) for i, found in enumerate(best) for s, d in found]
        if flat:
            i, d, s = zip(*flat, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(d, kind), pa.array(s, pa.int64())], names=["item", "doc_id", "score"])

    out = save(rows.mapInArrow(run, f"item int, doc_id {rows.schema['doc_id'].dataType.simpleString()}, score bigint"), "found")
    discard(rows)
    return out


def search(docs: DataFrame, items: DataFrame, k: int = 50, items_at_once: int = ITEMS_AT_ONCE, block: int = BLOCK_POSTINGS) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of score above 0 for each item, equal scores by doc_id (nulls last).

    docs: doc_id, text; items: item_id, text; further columns are ignored.  A
    document's terms are those of its whole text, and a document without any, as a
    null or empty text, is none.  With N documents, L terms in all, n in the
    document, df documents that hold the term, tf times in this one:
    w = floor(1000 ln((2 N + 2) / (2 df + 1))), m = 50 + (50 n N) div L, and the
    score is the sum of w * (10^9 tf div (1000 tf + 20 m)) over the item's terms,
    once each.  Repeated rows of docs are documents of their own; repeated rows of
    items count once, and different texts of one item_id are items of their own.
    Items without terms, or without a document, give no row.  Items are hashed
    into turns of about ``items_at_once``, whose texts come to the driver.
    """
    spark = docs.sparkSession
    known = save(items.select("item_id", F.col("text").cast("string").alias("text")).distinct(), "items")
    turns = max(1, -(-known.count() // items_at_once))
    out = None
    for turn in range(turns):
        found, names = _items(known.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(turns)) == turn))
        if not names:
            continue
        best = _turn(docs, found, names, k, block)
        at = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        best = best.withColumn("rank", F.row_number().over(at)).where(F.col("rank") <= k)
        ids = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(found)], f"item int, item_id {known.schema['item_id'].dataType.simpleString()}")
        best = best.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score")  # the items of a turn
        out = best if out is None else out.unionByName(best)
    if out is None:
        kinds = known.schema["item_id"].dataType.simpleString(), docs.schema["doc_id"].dataType.simpleString()
        return spark.createDataFrame([], f"item_id {kinds[0]}, rank int, doc_id {kinds[1]}, score bigint")
    return out
