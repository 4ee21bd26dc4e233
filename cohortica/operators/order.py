"""Ranks, running sums and exact percentiles without a task that holds a whole group.

Rows are dealt by ranges of (group, order), the ranges are summed, and each
range adds what lies before it in its group.  The dealt rows are written once,
as ranges are drawn from a sample and would differ in a second run.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortica.functions.expressions import quoted


def spare(columns: Iterable[str], *names: str) -> list[str]:
    """The names, with underscores before them until no column has them."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


_scopes = threading.local()


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the folder that all executors share; lineage ends there.  See ``scratch`` for when it goes."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        folder = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    if getattr(_scopes, "made", None) is not None:
        _scopes.made.append((spark, path))
    return out


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables written within the block are deleted at its end, but for those handed to the function it gives, which then belong to the block around."""
    around = getattr(_scopes, "made", None)
    made: list[tuple] = []
    _scopes.made = made
    kept: set[str] = set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df._written_at)
        return df

    try:
        yield keep
    finally:
        _scopes.made = around
        for spark, path in made:
            if path in kept:
                if around is not None:
                    around.append((spark, path))
                continue
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def dealt(df: DataFrame, keys: list[str]) -> tuple[DataFrame, str]:
    """The rows by ranges of the keys, written once, and the name of the column that numbers the ranges."""
    (part,) = spare(df.columns, "range")
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(df.repartitionByRange(n, *[quoted(c) for c in keys]).withColumn(part, F.spark_partition_id()), "ranges"), part


def running(df: DataFrame, by: list[str], order: list[str], **sums: Column) -> DataFrame:
    """Adds for each of ``sums`` the sum over the rows that come before in the row's group; groups may be null.

    ``order`` decides between any two rows of a group, or they share a range.
    """
    names = list(sums)
    own = spare([*df.columns, *names, "range"], *(f"{n}_own" for n in names))
    rows, part = dealt(df.select("*", *(sums[c].alias(o) for c, o in zip(names, own, strict=True))), [*by, *order])
    ahead = spare(rows.columns, *(f"{n}_ahead" for n in names))
    group = [f"{c}_of" for c in by]
    groups = [quoted(c).alias(g) for c, g in zip(by, group, strict=True)]
    before = Window.partitionBy(*group).orderBy("range_of").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as there are ranges
    whole = rows.groupBy(*groups, F.col(part).alias("range_of")).agg(*(F.sum(o).alias(o) for o in own))
    whole = whole.select(*group, "range_of", *(F.coalesce(F.sum(o).over(before), F.lit(0)).alias(a) for o, a in zip(own, ahead, strict=True)))
    within = Window.partitionBy(part, *[quoted(c) for c in by]).orderBy(*[quoted(c) for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.select("*", *(F.coalesce(F.sum(o).over(within), F.lit(0)).alias(c) for o, c in zip(own, names, strict=True)))
    same = F.col(part) == F.col("range_of")
    for c, g in zip(by, group, strict=True):
        same = same & quoted(c).eqNullSafe(F.col(g))
    return inside.join(whole, same).select(*[quoted(c) for c in df.columns], *((F.col(c) + F.col(a)).alias(c) for c, a in zip(names, ahead, strict=True)))


def percentiles(df: DataFrame, by: list[str], value: str, shares: Iterable[float]) -> DataFrame:
    """by, n (values that are not null) and p0, p1, ...: exact percentiles by linear interpolation.

    Equal values are counted first, so that a frequent one is a row.
    """
    counts = df.where(quoted(value).isNotNull()).groupBy(*[quoted(c).alias(c) for c in by], quoted(value).alias("value")).agg(F.count(F.lit(1)).alias("held"))
    placed = running(counts, by, ["value"], before=F.col("held"))
    total = placed.groupBy(*[quoted(c).alias(f"{c}_of") for c in by]).agg(F.sum("held").alias("n"))  # of the table that the ranges are, not of the rows anew
    on = F.lit(True)
    for c in by:
        on = on & quoted(c).eqNullSafe(F.col(f"{c}_of"))
    both = placed.join(total, on) if by else placed.crossJoin(F.broadcast(total))  # without groups: one row
    at = lambda place: F.max(F.when((F.col("before") <= place) & (place < F.col("before") + F.col("held")), F.col("value")))
    out = []
    for i, p in enumerate(shares):
        place = F.lit(float(p)) * (F.col("n") - 1)
        lo = F.floor(place)
        out += [at(lo).alias(f"lo{i}"), at(F.ceil(place)).alias(f"hi{i}"), F.max(place - lo).alias(f"f{i}")]
    made = both.groupBy(*by).agg(F.max("n").alias("n"), *out)
    return made.select(*by, "n", *((F.col(f"lo{i}") * (1 - F.col(f"f{i}")) + F.col(f"hi{i}") * F.col(f"f{i}")).alias(f"p{i}") for i in range(len(out) // 3)))
