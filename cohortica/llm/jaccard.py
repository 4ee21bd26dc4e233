"""Jaccard join of documents on word n-grams, by token-combination prefixes.

A document is its set of hashed shingles; equal sets are one node.  Under any
one order of the tokens, two sets of similarity 0.9 share at least j tokens
among the first n - ceil(0.9 n) + j of each (its prefix extended by j - 1).
The order used: tokens of a fixed hash range first, by how many sets have them,
then all others by hash.  Tokens that only one set has fill most prefixes, and
are in no bucket with another document.

Buckets of single tokens of the prefix come first.  Those of rare tokens are
compared as they are, those of frequent ones with a few pivots (``connect``).
A frequent token whose bucket still is of many groups, without one that has
most members, is indexed by combinations with one more token of the prefix
extended by one, then by two, and so on, always later ones: of the first tokens
that two linked sets share one more is among these.  A bucket of one large group and some others is finished by comparing the others
with all members.  Sizes and the Hamming distance of 256-bit parity bitmaps
rule most pairs out before sets are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortica.llm._components import connect, of_pairs
from cohortica.llm._store import discard, fresh, save, small
from cohortica.llm._text import Chunk, U, chunks, mix, named

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
LEVELS = 3
_C = U(0x9E3779B97F4A7C15)


def shingles(c: Chunk, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, shingle) of a chunk in lower case, by row and then by hash; fewer words than k are one shingle."""
    at, name = c.word_windows(k)
    row = c.words[2][at] if len(at) else np.zeros(0, np.int64)
    n = np.diff(c.word_offs)
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        whole = []
        for i in short:
            acc = U(0)
            with np.errstate(over="ignore"):
                for h in c.word_hash[c.word_offs[i] : c.word_offs[i + 1]]:
                    acc = mix(np.array([acc]))[0] + h
                whole.append(mix(np.array([acc + U(int(n[i])) * _C]))[0])
        row, name = np.concatenate([row, short]), np.concatenate([name, np.array(whole, U)])
        order = np.argsort(row, kind="stable")
        row, name = row[order], name[order]
    ends = np.cumsum(np.bincount(row, minlength=c.n))
    for a, b in zip(ends - np.diff(ends, prepend=0), ends, strict=True):
        name[a:b].sort()
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (name[1:] != name[:-1])
    return row[new], name[new]


def need(n, percent: int):
    """Least size of an intersection with a set of size n, for similarity percent / 100."""
    return -(-n * percent // 100)


def _lists(values: np.ndarray, n: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(values.view(np.int64)))


def _names(*halves: np.ndarray) -> pa.Array:
    """16-byte names of two 64-bit hashes each."""
    data = np.ascontiguousarray(np.stack(halves, axis=1))
    return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer((np.arange(len(data) + 1) * 16).astype(np.int32)), pa.py_buffer(data)])


def _chunk_sets(c: Chunk, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Rows and shingles of a chunk, sizes of the sets, their names, and words of the rows."""
    c = Chunk(_LOWER[c.data], c.offs, c.rows)
    row, name = shingles(c, k)
    n = np.bincount(row, minlength=c.n)
    ends = np.cumsum(n)
    total = (np.concatenate([np.zeros(1, U), np.cumsum(mix(x), dtype=U)]) for x in (name ^ _C, name + _C))
    one, two = (t[ends] - t[ends - n] for t in total)
    return row, name, n, _names(mix(one + n.astype(U)), mix(two ^ n.astype(U))), np.diff(c.word_offs)


def sets(docs: DataFrame, k: int, percent: int, part: float) -> DataFrame:
    """doc_id, k, n, words (of the text), s (the set's name), first (its tokens of the first class), more (tokens of the prefix beyond them, extended by ``LEVELS``), g0 .. g3 (parity bitmap).

    Sets that can link with equal sets alone have no tokens.
    """
    top = U(min(int(part * 2**64), 2**64 - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in chunks(b.column("text")):
                row, name, n, s, words = _chunk_sets(c, k)
                social = 100 * n >= percent * (n + 1)
                reach = n - need(n, percent) + 1 + LEVELS
                low = name < top  # names are ascending within a row, so these come first
                rank = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                more = ~low & (rank < reach[row]) & social[row]
                low &= social[row]
                bits = np.bincount(row * 256 + (name >> U(40) & U(255)).astype(np.int64), minlength=256 * c.n) & 1
                map_ = np.packbits(bits.astype(np.uint8).reshape(c.n, 256), axis=1).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id").slice(int(c.rows[0]), c.n),
                        b.column("k").slice(int(c.rows[0]), c.n),
                        pa.array(n.astype(np.int64)),
                        pa.array(words, pa.int64()),
                        s,
                        _lists(name[low], np.bincount(row[low], minlength=c.n)),
                        _lists(name[more], np.bincount(row[more], minlength=c.n)),
                        *(pa.array(np.ascontiguousarray(map_[:, j])) for j in range(4)),
                    ],
                    names=["doc_id", "k", "n", "words", "s", "first", "more", "g0", "g1", "g2", "g3"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "k", "text").mapInArrow(run, f"doc_id {kind}, k binary, n bigint, words bigint, s binary, first array<bigint>, more array<bigint>, g0 bigint, g1 bigint, g2 bigint, g3 bigint")


def ordered(nodes: DataFrame, percent: int) -> DataFrame:
    """id, n, list, room: every set's tokens in order that more than one set may have, and how many of them the prefix has.

    list: first those of the first class that are in two sets or more, then ``more``.  room: of the prefix itself; one more token
    for each token that it is extended by.  It is negative where tokens of one set alone fill more than the prefix.
    """
    tokens = nodes.select("id", F.explode("first").alias("t"))
    often = save(tokens.groupBy("t").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "tokens")
    seen = tokens.join(often.hint("shuffle_hash"), "t")  # grows with the corpus, so it is joined alike at every size; the many tokens need no sort
    listed = seen.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("df", "t"))), lambda x: x["t"]).alias("shared"))
    both = nodes.select("id", "n", "more", F.size("first").alias("m")).where("m + size(more) > 0").join(listed, "id", "left").withColumn("shared", F.coalesce("shared", F.array().cast("array<bigint>")))
    prefix = F.expr(f"n - (n * {percent} + 99) div 100 + 1")
    out = save(both.select("id", "n", F.concat("shared", "more").alias("list"), (prefix - F.col("m") + F.size("shared")).cast("int").alias("room")), "lists")
    discard(often)
    return out


def may(percent: int):
    """Whether sizes and bitmaps leave room for a similarity of percent / 100."""

    def near(a, b):
        far = sum((F.bit_count(a(f"g{j}").bitwiseXOR(b(f"g{j}"))) for j in range(1, 4)), F.bit_count(a("g0").bitwiseXOR(b("g0"))))
        return (F.least(a("n"), b("n")) * 100 >= F.greatest(a("n"), b("n")) * percent) & (far * (100 + percent) <= (a("n") + b("n")) * (100 - percent))

    return near


def whole(rows: DataFrame, some: DataFrame, k: int) -> DataFrame:
    """s, tokens: the whole sets of keyed rows named in ``some`` (k)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in chunks(b.column("text")):
                _, name, n, s, _ = _chunk_sets(c, k)
                yield pa.RecordBatch.from_arrays([s, _lists(name, n)], names=["s", "tokens"])

    return rows.join(small(some), "k", "left_semi").select("text").mapInArrow(run, "s binary, tokens array<bigint>")


def _groups(rows: DataFrame, k: int, percent: int, part: float | None) -> tuple[DataFrame, DataFrame]:
    """Of named rows: doc_id, k, n, words, s of each, and s, root of each set with words."""
    part = part or min(1.0, 0.015 * (100 - percent))  # half as much again as the prefix, so that rare tokens can fill it
    found = save(sets(rows, k, percent, part), "sets")
    firsts = ("n", "first", "more", "g0", "g1", "g2", "g3")
    nodes = save(found.where("n > 0").groupBy("s").agg(*(F.first(c).alias(c) for c in firsts), F.min("k").alias("k")).withColumn("id", F.monotonically_increasing_id()), "nodes")
    attrs = nodes.select("id", "n", "g0", "g1", "g2", "g3")
    lists = ordered(nodes, percent)
    members = save(lists.where("room > 0").select("id", F.posexplode(F.slice("list", F.lit(1), F.col("room"))).alias("at", "b")).join(attrs, "id"), "members")
    many = save(members.groupBy("b").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("b"), "many")
    members, alone = save(members.join(small(many), "b"), "members"), members
    ids = save(members.select("id").distinct(), "ids")
    some = nodes.join(small(ids), "id").select("id", "s", "k")
    keys = save(some.select("k"), "keys")
    tokens = save(some.select("id", "s").join(whole(rows, keys, k).dropDuplicates(["s"]), "s").select("id", "tokens"), "tokens")
    discard(alone, many, ids, keys)

    def verify(pairs: DataFrame) -> DataFrame:
        some = of_pairs(tokens, pairs)
        of = lambda c: some.select(F.col("id").alias(c), F.col("tokens").alias(f"t{c}"))
        both = pairs.join(of("x"), "x").join(of("p"), "p").select("p", "x", F.size("tp").alias("n"), F.size("tx").alias("m"), F.size(F.array_intersect("tp", "tx")).alias("i"))
        return both.where(f"100L * i >= {percent} * (n + m - i)").select("p", "x")

    def deeper(open_: DataFrame, level: int) -> DataFrame | None:
        if level == LEVELS:
            return None
        reach = F.slice("list", F.lit(1), F.col("room") + level + 1)
        of = open_.join(lists.select("id", "list", "room"), "id").select(*open_.columns, F.posexplode(reach).alias("to", "t")).where("to > at")
        return of.withColumn("b", F.xxhash64("b", "t")).withColumn("at", F.col("to")).select(*open_.columns)

    label = connect(members, may(percent), verify, deeper)
    if label is None:
        roots = save(nodes.select("s", F.col("id").alias("root")), "groups")
    else:
        roots = save(nodes.select("s", "id").join(small(label).select(F.col("node").alias("id"), "root"), "id", "left").select("s", F.coalesce("root", "id").alias("root")), "groups")
        discard(label)
    slim = save(found.select("doc_id", "k", "n", "words", "s"), "found")
    discard(found, nodes, lists, members, tokens)
    return slim, roots


def near_copies(docs: DataFrame, k: int = 5, percent: int = 80, part: float | None = None) -> DataFrame:
    """Every document with n_shingles and component_id, the smallest doc_id reachable by links.

    Two documents link when their sets of k-word shingles (A-Z in lower case,
    words between ASCII white space) have a similarity of percent / 100; equal
    sets are one node.  A text with fewer than k words is one shingle.  A text
    without words, or null, links with nothing and is its own component.
    ``part``: share of the hash range whose tokens are counted to order them,
    by default half as much again as the prefix.
    Rows that share a doc_id are nodes of their own; a null doc_id never names
    a component of others.  Sets are named by 128-bit hashes of their shingles,
    shingles by 64 bits.  Other columns of ``docs`` are ignored.
    """
    found, groups = _groups(named(docs), k, percent, part)
    rooted = found.where("n > 0").groupBy("s").agg(F.min("doc_id").alias("doc")).join(groups, "s")
    least = save(rooted.groupBy("root").agg(F.min("doc").alias("least")), "least")
    doc_of = rooted.join(least, "root").select("s", "least")
    return found.select("doc_id", "n", "s").join(doc_of, "s", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("least", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def memberships(docs: DataFrame, k: int = 5, percent: int = 80, part: float | None = None) -> DataFrame:
    """k, cluster, words: by their names (see ``named``) the group of near copies, and the words, of all documents with words; one row for rows of equal doc_id and text."""
    found, groups = _groups(named(docs), k, percent, part)
    return found.where("n > 0").select("k", "s", "words").distinct().join(groups, "s").select("k", F.col("root").alias("cluster"), "words")


def with_clusters(docs: DataFrame, column: str = "cluster", k: int = 5, percent: int = 80, part: float | None = None) -> DataFrame:
    """``docs`` with a name of each row's group of near copies in ``column`` (in place of one of that name); null for texts without words."""
    key, root = fresh([*docs.columns, column], "k", "root")
    of = memberships(docs, k, percent, part).select(F.col("k").alias(key), F.col("cluster").alias(root))
    rows = docs.withColumn(key, named(docs, only_name=True))
    return rows.join(of, key, "left").withColumn(column, F.col(root)).drop(key, root)


def distinct_documents(docs: DataFrame, k: int = 5, percent: int = 80, part: float | None = None) -> DataFrame:
    """``docs`` with one row of each group of near copies: the one of smallest (doc_id, text hash).

    Rows of equal doc_id and text count as one; which of them stays is open if
    they differ in other columns.  Texts without words are in no group and stay.
    """
    found, groups = _groups(named(docs), k, percent, part)
    rooted = found.where("n > 0").select("doc_id", "k", "s").join(groups, "s")
    (key,) = fresh(docs.columns, "k")
    first = rooted.groupBy("root").agg(F.min(F.struct("doc_id", "k")).alias("f")).select(F.col("f.k").alias(key)).unionByName(found.where("n = 0").select(F.col("k").alias(key)).distinct())
    kept = docs.withColumn(key, named(docs, only_name=True)).join(first, key, "left_semi")
    return kept.dropDuplicates([key]).drop(key)
