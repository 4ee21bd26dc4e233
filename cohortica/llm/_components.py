"""Connected components by contraction, and groups of links found bucket by bucket, in DataFrame operations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortica.llm._store import FEW_ROWS, SMALL_ROWS, discard, gathered, save, small

DOUBLINGS = 2
RARE, PIVOTS, BLOCK = 64, 64, 4096


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of edges (a, b); root is one node of the component.

    Each round hooks every node to its smallest neighbour, follows the hooks by
    ``DOUBLINGS`` pointer doublings and contracts the edges to where they lead.
    A round at least halves the nodes that still have edges, so the rounds grow
    with the logarithm of the nodes; all steps are counts and joins on nodes.
    """
    left = save(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    found: DataFrame | None = None
    while not left.isEmpty():
        near = gathered(left)
        both = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = save(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")), "hooks")
        hook = gathered(first)
        for _ in range(DOUBLINGS):
            up = hook.select(F.col("node").alias("root"), F.col("root").alias("top"))
            hook = hook.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
        hook = save(hook, "hooks")
        discard(first)
        to = gathered(hook)
        if found is None:
            found, old = hook, None
        else:
            old, up = found, to.select(F.col("node").alias("root"), F.col("root").alias("top"))
            found = save(gathered(found).join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "roots")
        a = to.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        b = to.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        done, left = left, save(near.join(a, "a").join(b, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
        discard(done, *([old, hook] if old is not None else []))
    if found is None:
        found = left.select(F.col("a").alias("node"), F.col("b").alias("root"))
        found._saved_at = left._saved_at
        return found
    discard(left)
    return found


def of_pairs(table: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows of a table whose id is in a pair (p, x), where pairs are so few that their ids may be broadcast; else all."""
    if 2 * pairs.count() > SMALL_ROWS:
        return table
    ids = pairs.select(F.explode(F.array("p", "x")).alias("id")).distinct()
    return table.join(F.broadcast(ids), "id", "left_semi")


def connect(members: DataFrame, near: Callable[[Callable[[str], Column], Callable[[str], Column]], Column], verify: Callable[[DataFrame], DataFrame], deeper: Callable[[DataFrame, int], DataFrame | None] | None = None, rare: int | None = None, pivots: int | None = None, stars: int = 2, alike: str = "true", parts: int = 1) -> DataFrame | None:
    """Groups of the nodes that links connect; a link lies between two members of a bucket.

    members: b (bucket), id and whatever ``near`` looks at, a cheap test that
    every link passes in one of its buckets at least; verify: the pairs (p, x)
    that are links.  -> node, root of every linked node, None if there is no
    link.  alike: of which members ``near`` says the same in all buckets.

    Pairs are compared only where their ends are in different groups so far.

    1. Buckets of up to ``rare`` members are compared as they are; in larger
       ones ``pivots`` / 8 pivots or so meet all members, each member in one
       bucket alone, and then ``pivots`` in those that hold several groups yet,
       and eight times as many if ``stars`` is 3.
    2. Where they do so even then, the members outside of a bucket's largest
       group meet all members, in blocks of ``BLOCK``.  Of buckets over
       ``BLOCK`` without a majority ``deeper`` gives finer ones, in which all
       their links lie, and 1 follows.  No link between groups is lost.
       With ``parts`` over 1 one in so many of these pairs is verified first,
       then three, then four times as many, and each time those alone whose
       ends are in different groups yet.
    """
    rare, pivots = rare or RARE, pivots or PIVOTS
    own = [c for c in members.columns if c not in ("b", "id")]
    label: DataFrame | None = None
    rows, turn, level = members, 0, 0
    met = [pivots // 8 or 1, pivots, pivots * 8][:stars]

    def pairs(one: DataFrame, two: DataFrame, on: list[str], apart: str) -> DataFrame:
        """Pairs of a bucket that may be linked; where ``bs``, first buckets of each, have some in common, in the first of these alone."""
        left = one.select(*on, *[F.col(c).alias("_" + c) for c in ("id", "c", "bs", *own)])
        both = left.join(two, on).where(f"_c <> c and {apart}").where(near(lambda c: F.col("_" + c), lambda c: F.col(c)))
        return both.where("bs is null or coalesce(b = array_min(array_intersect(_bs, bs)), true)").select(F.least("_id", "id").alias("p"), F.greatest("_id", "id").alias("x"))

    while True:
        named = rows.withColumn("c", F.col("id")) if label is None else rows.join(small(label).select(F.col("node").alias("id"), "root"), "id", "left").withColumn("c", F.coalesce("root", "id")).drop("root")
        sizes = save(named.groupBy("b").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("m")).where("lo <> hi").select("b", "m"), "sizes")
        named = save(named.join(small(sizes), "b"), "buckets")
        if named.isEmpty():
            discard(named, sizes, *([rows] if rows is not members else []))
            return label
        made = [named, sizes] + ([rows] if rows is not members else [])
        large = save(named.where(F.col("m") > rare), "large")
        made.append(large)
        none = F.lit(None).cast("array<bigint>")
        pivot = lambda n: f"pmod(xxhash64(id), shiftleft(1L, cast(greatest(ceil(log2(m / {n})), 0) as int))) = 0"
        if turn < stars:
            star = save(gathered(large).groupBy("id").agg(F.max_by(F.struct("b", "m", "c", *own), F.struct("m", "b")).alias("r")).select("id", "r.*").withColumn("bs", none), "stars")
            made.append(star)
            found = pairs(star.where(pivot(met[turn])), star, ["b"], f"(_id < id or not {pivot(met[turn])})")
        if turn == 0:
            few = named.where(F.col("m") <= rare).withColumn("bs", none)
            found = found.unionByName(pairs(few, few, ["b"], "_id < id"))
        if turn == stars:
            split = f"m > {BLOCK} and 2 * held <= m"
            most = save(large.groupBy("b", "c").agg(F.count(F.lit(1)).alias("held")).groupBy("b").agg(F.max(F.struct("held", "c")).alias("top")).select("b", "top.held", F.col("top.c").alias("main")), "majorities")
            of = save(large.join(small(most), "b"), "open")
            made += [most, of]
            finer = deeper(of.where(split).select("b", "id", *own), level) if deeper else None
            stay = of.where(f"not ({split})") if finer is not None else of
            stay = stay.join(stay.groupBy("id").agg(F.when(F.min(F.expr(alike)), F.slice(F.sort_array(F.collect_list("b")), 1, RARE)).alias("bs")), "id")
            blocks = F.ceil(F.col("m") / BLOCK).cast("int")
            open_ = stay.where("c <> main").withColumn("salt", F.explode(F.sequence(F.lit(0), blocks - 1)))
            # two members outside of the largest group meet once
            found = pairs(open_, stay.withColumn("salt", F.pmod(F.xxhash64("id"), blocks).cast("int")), ["b", "salt"], "(_id < id or c = main)")
        found = save(found.distinct(), "pairs")
        made.append(found)
        dealt = [(0, 1)]
        if turn == stars and parts > 1 and found.count() > FEW_ROWS:
            ends = [0, 1] + [4**i for i in range(1, parts) if 4**i < parts] + [parts]
            dealt = list(zip(ends, ends[1:]))
        for lo, hi in dealt:
            some = found
            if len(dealt) > 1:
                part = F.pmod(F.xxhash64("p", "x"), F.lit(parts))
                some = found.where((part >= lo) & (part < hi))
                for end in ("p", "x") if label is not None else ():
                    root = small(label).select(F.col("node").alias(end), F.col("root").alias("_" + end))
                    some = some.join(root, end, "left").withColumn("_" + end, F.coalesce("_" + end, end))
                if label is not None:
                    some = some.where("_p <> _x").select("p", "x")
                some = save(some, "part")
                made.append(some)
            new = save(verify(some), "links")
            made.append(new)
            all_ = new.select(F.col("p").alias("a"), F.col("x").alias("b"))
            if label is not None:  # what is known as edges to the roots
                all_ = all_.unionByName(label.select(F.col("node").alias("a"), F.col("root").alias("b")))
            before, label = label, components(all_)
            if before is not None:
                discard(before)
        if turn < stars:
            rows, turn = large.select("b", "id", *own), turn + 1
            rows = save(rows, "members")
        elif finer is not None:
            rows, turn, level = save(finer, "members"), 0, level + 1
        else:
            rows = None
        discard(*made)
        if rows is None:
            return label
