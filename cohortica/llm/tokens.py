"""Training-order materialisation of token sequences.

Documents become sequences of a fixed number of token ids.  A keyed Feistel
network over the sequence numbers, walked until it lands below their count, is
a permutation, so every sequence has one global slot and every slot one
sequence, with nothing to sort or to keep.  Range partitions on the slot write
shards of fixed-stride records: slot k is at byte (k mod per_shard) * stride of
shard k div per_shard, so a reader can resume anywhere.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortica.llm._store import save, small
from cohortica.llm._text import U, mix
from cohortica.operators.order import running

#: Pre-tokenisation of byte-level BPE with the 50k vocabulary (a fixed value of that tokenizer).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END = 50256
CACHE = 300_000


class Encoder:
    """Encodes texts in batches, each distinct piece once.

    A pre-token never spans a single space and what stands before it, so texts
    are cut there.  The pieces that a batch adds are joined and encoded in one
    call; a token that begins with a space begins the next piece.  Texts with
    runs of spaces are encoded as they are.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.spaced = np.zeros(END + 1, bool)
        self.spaced[[i for x, i in ranks.items() if x[:1] == b" "]] = True
        self.forget()

    def forget(self) -> None:
        self.at: dict = {}
        self.ids, self.first, self.len = np.zeros(0, np.uint16), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self, keys: set) -> None:
        """Adds pieces: strings stand after a space; a tuple holds a whole string, or None for the end of a text."""
        plain = [k for k in keys if type(k) is str]
        rest = [k for k in keys if type(k) is not str]
        parts, lens = [], []
        if plain:
            ids = np.array(self.bpe.encode_ordinary(" " + " ".join(plain)), np.uint16)
            starts = np.flatnonzero(self.spaced[ids])
            parts.append(ids)
            lens += np.diff(np.append(starts, len(ids))).tolist()
        for k in rest:
            ids = [END] if k[0] is None else self.bpe.encode_ordinary(k[0])
            parts.append(np.array(ids, np.uint16))
            lens.append(len(ids))
        self.at |= dict(zip(plain + rest, range(len(self.len), len(self.len) + len(lens)), strict=True))
        self.ids = np.concatenate([self.ids, *parts])
        self.len = np.concatenate([self.len, np.array(lens, np.int64)])
        self.first = np.cumsum(self.len) - self.len

    def batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, each closed by END, and the offsets of the texts."""
        keys, ends = [], []
        for text in texts:
            if text:
                if "  " in text:
                    keys.append((text,))
                else:
                    pieces = text.split(" ")
                    pieces[0] = (pieces[0],)
                    if not pieces[-1]:
                        pieces[-1] = (" ",)
                    keys += pieces
            keys.append((None,))
            ends.append(len(keys))
        if new := set(keys) - self.at.keys():
            if len(self.at) + len(new) > CACHE:
                self.forget()
                new = set(keys)
            self.learn(new)
        at = np.fromiter(map(self.at.__getitem__, keys), np.int64, len(keys))
        lens = self.len[at]
        upto = np.cumsum(lens)
        out = self.ids[np.repeat(self.first[at] - (upto - lens), lens) + np.arange(int(upto[-1]))]
        return out, np.concatenate([[0], upto[np.array(ends) - 1]])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def feistel(x: np.ndarray, n: int, key: int, rounds: int = 6) -> np.ndarray:
    """A keyed permutation of 0..n-1, applied to the numbers x."""
    half = max(1, (max(2, n) - 1).bit_length() + 1 >> 1)
    low = U((1 << half) - 1)

    def once(v: np.ndarray) -> np.ndarray:
        a, b = v >> U(half), v & low
        for r in range(rounds):
            a, b = b, a ^ (mix(b + U((key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) & (2**64 - 1))) & low)
        return (a << U(half)) | b

    v = once(x.astype(U))
    while (out := v >= U(n)).any():
        v[out] = once(v[out])
    return v.astype(np.int64)


def sequences(docs: DataFrame, vocabulary: str, length: int = 512) -> DataFrame:
    """Numbered sequences: seq (0 .. count - 1), doc_id, chunk, n_tokens, tokens (little-endian uint16, padded with END).

    Each document's ids end with END and are cut every ``length``; a null or
    empty text is the sequence of END alone.  Documents are numbered in the order
    of (doc_id, md5 of the text), nulls first, so a sequence's number hangs on the
    documents alone and not on files or partitions; repeated rows follow each
    other and are alike.  Of an empty table there are no sequences.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        for b in batches:
            ids_, texts = b.column("doc_id"), b.column("text").to_pylist()
            for a in range(0, b.num_rows, 256):
                stream, offs = encoder(vocabulary).batch(texts[a : a + 256])
                lens = np.diff(offs)
                many = -(-lens // length)
                first = np.cumsum(many) - many
                n = int(many.sum())
                out = np.full(n * length, END, "<u2")
                out[np.arange(len(stream)) + np.repeat(first * length - offs[:-1], lens)] = stream
                doc = np.repeat(np.arange(len(lens)), many)
                chunk = np.arange(n) - first[doc]
                records = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * 2 * length, 2 * length, dtype=np.int32)), pa.py_buffer(out)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, part, np.int32)), pa.array(made + doc), ids_.take(pa.array(a + doc)), b.column("digest").take(pa.array(a + doc)), pa.array(many[doc]), pa.array(chunk), pa.array(np.minimum(lens[doc] - chunk * length, length)), records],
                    names=["part", "at", "doc_id", "digest", "chunks", "chunk", "n_tokens", "tokens"],
                )
                made += len(lens)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.unhex(F.md5("text")).alias("digest"))
    table = save(rows.mapInArrow(run, "part int, at bigint, doc_id bigint, digest binary, chunks bigint, chunk bigint, n_tokens bigint, tokens binary"), "sequences")
    heads = table.where("chunk = 0").select("part", "at", "doc_id", "digest", "chunks")
    placed = save(running(heads, [], ["doc_id", "digest", "part", "at"], before=F.col("chunks")).select("part", "at", "before", "chunks"), "numbers")
    total = placed.agg(F.coalesce(F.sum("chunks"), F.lit(0))).first()[0]
    numbered = table.drop("chunks").join(small(placed.drop("chunks")), ["part", "at"])
    return numbered.select((F.col("before") + F.col("chunk")).alias("seq"), F.lit(total).cast("bigint").alias("total"), "doc_id", "chunk", "n_tokens", "tokens")


def training_order(numbered: DataFrame, key: int = 20240229) -> DataFrame:
    """Adds the global slot of every numbered sequence."""

    @F.pandas_udf("bigint")
    def slot(seq: pd.Series, total: pd.Series) -> pd.Series:
        return pd.Series(feistel(seq.to_numpy(), int(total.iloc[0]), key) if len(seq) else seq)

    return numbered.select(slot("seq", "total").alias("slot"), "seq", "total", "doc_id", "chunk", "n_tokens", "tokens")  # only the numbers go to Python


def shards(ordered: DataFrame, length: int = 512, per_shard: int = 1024) -> DataFrame:
    """One row per shard of ``per_shard`` slots: its records end to end, with stride 2 * length, and what they are.

    Slots are a permutation of 0 .. total - 1, so the ranges of shards are known
    and even without a sample; no shard spans two tasks.
    """
    spark = ordered.sparkSession
    stride = 2 * length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []

        def out():
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([now], pa.int64()),
                    pa.array([rows[0][0]], pa.int64()),
                    pa.array([len(rows)], pa.int64()),
                    pa.array([stride], pa.int64()),
                    *(pa.array([[r[j] for r in rows]], pa.list_(pa.int64())) for j in (1, 2, 3)),
                    pa.array([b"".join(r[4] for r in rows)], pa.binary()),
                ],
                names=["shard", "first_slot", "n_slots", "stride", "doc_ids", "chunks", "n_tokens", "payload"],
            )

        for b in batches:
            for row in zip(*(b.column(x).to_pylist() for x in ("shard", "slot", "doc_id", "chunk", "n_tokens", "tokens")), strict=True):
                if row[0] != now and rows:
                    yield out()
                    rows = []
                now = row[0]
                rows.append(row[1:])
        if rows:
            yield out()

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return (
        ordered.select(F.expr(f"slot div {per_shard}").alias("shard"), "slot", "doc_id", "chunk", "n_tokens", "tokens", F.expr(f"cast(slot div {per_shard} * {n} div ((total - 1) div {per_shard} + 1) as int)").alias("_range"))
        .repartitionById(n, "_range")
        .sortWithinPartitions("shard", "slot")
        .mapInArrow(run, "shard bigint, first_slot bigint, n_slots bigint, stride bigint, doc_ids array<bigint>, chunks array<bigint>, n_tokens array<bigint>, payload binary")
    )


def write_shards(table: DataFrame, path: str, waves: int = 8) -> None:
    """The shards, by number, as a table that ``read_slots`` reads; goes on where an earlier call was broken off.

    Ranges of shards are written one after the other, each committed by Spark
    as a whole or not at all.  A later call with the same table, made from the
    same files, leaves out the shards that are there.
    """
    spark = table.sparkSession
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
    if there:
        table = table.join(spark.read.parquet(path).select("shard"), "shard", "left_anti")
    for i in range(waves):
        table.where(F.pmod("shard", F.lit(waves)) == i).write.mode("append").parquet(path)


def read_slots(spark, path: str, first: int, count: int, per_shard: int = 1024) -> DataFrame:
    """Sequences of the slots first .. first + count - 1 in order: reads only their shards and cuts records by stride."""
    at = F.col("first_slot") + F.col("i")
    return (
        spark.read.parquet(path)
        .where(F.col("shard").between(first // per_shard, (first + count - 1) // per_shard))
        .select("*", F.posexplode("doc_ids").alias("i", "doc_id"))
        .where(at.between(first, first + count - 1))
        .select(at.alias("slot"), "doc_id", F.expr("chunks[i]").alias("chunk"), F.expr("n_tokens[i]").alias("n_tokens"), F.expr("substring(payload, cast(i * stride + 1 as int), cast(stride as int))").alias("tokens"))
        .orderBy("slot")
    )
