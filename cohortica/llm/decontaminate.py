"""Benchmark decontamination by winnowing, in DataFrame functions only.

Of every ``WINDOW - GRAM + 1`` neighbouring k-grams of words the one of least
hash is kept, in documents and in benchmark items alike.  A shared span of
``WINDOW`` words therefore shares a kept hash.  Documents with a kept hash of
the benchmark are looked at again: each hit is extended to the windows around
it, word by word.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortica.llm._store import cut, fresh, save, small
from cohortica.llm._text import named

WINDOW, GRAM = 10, 8
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text):
    """Words of a text: letters and digits of ASCII, A-Z in lower case, and whatever is not ASCII."""
    return F.filter(F.split(F.translate(text, _UP, _LOW), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def let(value, f):
    """f(value) with the value worked out once, however often f names it."""
    return F.transform(F.array(value), f)[0]


def _doubled(x, size: int, op):
    """op over every run of ``size`` neighbours of x, by doubling."""

    def step(x, have: int):
        if have >= size:
            return x
        by = min(have, size - have)
        n = F.greatest(F.size(x) - by, F.lit(0))
        return let(F.zip_with(F.slice(x, F.lit(1), n), F.slice(x, F.lit(by + 1), n), op), lambda y: step(y, have + by))

    return step(x, 1)


def grams(w, size: int):
    """Hashes of all runs of ``size`` words."""
    return let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: _doubled(h, size, lambda a, b: F.xxhash64(a, b)))


def winnowed(g, width: int):
    """The distinct hashes that are least in some window of ``width`` of g."""
    return F.array_distinct(_doubled(g, width, lambda a, b: F.least(a, b)))


def _around(w, gram: int, window: int, sought):
    """Of each run of ``gram`` words with a hash in ``sought``: h, its place i, and the words ``around`` it, ``lead`` of them before it."""
    reach = window - gram

    def of(g):
        hits = F.filter(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))), lambda x: F.array_contains(sought, x["h"]))
        return F.transform(
            hits,
            lambda x: F.struct(
                x["h"].alias("h"),
                x["i"].alias("i"),
                F.least(x["i"], F.lit(reach)).alias("lead"),
                F.slice(w, F.greatest(x["i"] - reach, F.lit(0)) + 1, F.least(x["i"], F.lit(reach)) + gram + reach).alias("around"),
            ),
        )

    return let(grams(w, gram), of)


def _windows(docs: DataFrame, items: DataFrame, window: int, gram: int) -> DataFrame:
    """k, item_id, at, size: the windows of items that occur in documents.  docs: k, text; items: item_id, w."""
    reach = window - gram
    kept = cut(items.withColumn("f", let(F.col("w"), lambda w: let(grams(w, gram), lambda g: winnowed(g, reach + 1)))))
    sought = cut(kept.select(F.explode("f").alias("h")).distinct())
    marked = docs.select("k", F.explode_outer(let(words(F.col("text")), lambda w: let(grams(w, gram), lambda g: winnowed(g, reach + 1)))).alias("h"))
    hits = save(marked.join(small(sought), "h").groupBy("k").agg(F.collect_set("h").alias("hits")), "hits")  # at most the benchmark's hashes
    some = docs.join(small(hits.select("k")), "k", "left_semi")  # while documents with hits are few, no other text is shuffled
    found = some.join(hits, "k").groupBy("k").agg(F.first("text").alias("text"), F.first("hits").alias("hits"))
    d = found.select("k", F.explode(let(words(F.col("text")), lambda w: _around(w, gram, window, F.col("hits")))).alias("x"))
    d = d.select("k", F.col("x.h").alias("h"), F.col("x.i").alias("di"), F.col("x.lead").alias("dl"), F.col("x.around").alias("da"))
    b = kept.select("item_id", F.explode(_around(F.col("w"), gram, window, F.col("f"))).alias("x"))
    b = cut(b.select("item_id", F.col("x.h").alias("h"), F.col("x.lead").alias("bl"), F.col("x.around").alias("ba")).distinct())
    same = F.filter(
        F.sequence(F.lit(0), F.lit(reach)),
        lambda o: (o <= F.col("dl")) & (o <= F.col("bl")) & (F.size(F.slice("da", F.col("dl") - o + 1, window)) == window) & (F.slice("da", F.col("dl") - o + 1, window) == F.slice("ba", F.col("bl") - o + 1, window)),
    )
    return d.join(b, "h").select("k", "item_id", "di", F.explode(same).alias("o")).select("k", "item_id", (F.col("di") - F.col("o")).alias("at"), F.lit(window).alias("size"))


def occurrences(rows: DataFrame, benchmark: DataFrame) -> DataFrame | None:
    """k, item_id, at, size: all windows of items in keyed rows; None when no item has a word."""
    items = cut(benchmark.select("item_id", words(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("w")).where("size(w) > 0").dropDuplicates())
    sizes = {min(r[0], WINDOW) for r in items.select(F.least(F.size("w"), F.lit(WINDOW))).distinct().collect()}  # at most ten numbers
    parts = []
    for size in sorted(sizes):
        of = items.where(F.size("w") >= WINDOW) if size == WINDOW else items.where(F.size("w") == size)
        parts.append(_windows(rows.select("k", "text"), of, size, min(size, GRAM)))
    if not parts:
        return None
    spans = parts[0]
    for p in parts[1:]:
        spans = spans.unionByName(p)
    return cut(spans.distinct())


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Every document with what it holds of the benchmark.

    A window is 10 consecutive words of an item; an item of fewer words, but
    not none, is one window.  Returns doc_id, n_words, n_hit (words inside
    occurrences of windows), n_items, items_sha256 (of the item_ids as strings,
    sorted, comma-joined) and contaminated.  Null texts and items have no
    words; an item without an item_id counts for n_hit alone.
    """
    rows = named(docs)
    spans = occurrences(rows, benchmark)
    counted = rows.select("doc_id", "k", F.size(words(F.col("text"))).cast("long").alias("n_words"))
    empty = F.sha2(F.lit(""), 256)
    if spans is None:
        return counted.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), empty.alias("items_sha256"), F.lit(False).alias("contaminated"))
    covered = spans.select("k", "at", "size").distinct().select("k", F.explode(F.expr("sequence(at, at + size - 1)")).alias("p")).distinct().groupBy("k").agg(F.count(F.lit(1)).alias("n_hit"))
    of_items = spans.select("k", "item_id").distinct().groupBy("k").agg(F.sort_array(F.collect_list(F.col("item_id").cast("string"))).alias("ids"))
    return (
        counted.join(covered.join(of_items, "k"), "k", "left")
        .select(
            "doc_id",
            "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_items"),
            F.when(F.col("ids").isNull(), empty).otherwise(F.sha2(F.array_join("ids", ","), 256)).alias("items_sha256"),
            F.col("n_hit").isNotNull().alias("contaminated"),
        )
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no window of the benchmark, as they are; null texts stay."""
    spans = occurrences(named(docs), benchmark)
    if spans is None:
        return docs
    (key,) = fresh(docs.columns, "k")
    hit = save(spans.select(F.col("k").alias(key)).distinct(), "contaminated")
    return docs.withColumn(key, named(docs, only_name=True)).join(small(hit), key, "left_anti").drop(key)
