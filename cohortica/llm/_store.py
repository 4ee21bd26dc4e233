"""Intermediate tables that cut lineage, in the folder all executors share."""

from __future__ import annotations

import tempfile
import time
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a table of a few numbers that may be broadcast (tens of MB); a larger one is joined by a shuffle.
SMALL_ROWS = 1_000_000
#: Rows of such a table that one task may hold, which spares the exchanges between many steps.
FEW_ROWS = 20_000
_released = 0.0


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; one of our own only where none is set (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if found:
        if not sc._jsc.sc().getCheckpointDir().isDefined():
            sc.setCheckpointDir(found)
        return found
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: lineage ends here and the files survive lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def save(df: DataFrame, name: str) -> DataFrame:
    """As ``cut``, as compressed columns: for wide or long tables."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    release(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def release(spark: SparkSession) -> None:
    """Lets the driver's cleaner see which shuffles no one needs any more, so that their files go; at most every two seconds."""
    global _released
    if time.monotonic() - _released > 2:
        spark.sparkContext._jvm.System.gc()
        _released = time.monotonic()


def discard(*tables: DataFrame) -> None:
    """Removes the files of tables of ``save`` that are of no more use."""
    for df in tables:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._saved_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame) -> DataFrame:
    """A saved table of few columns for a join: broadcast if its counted rows are ``SMALL_ROWS`` at most."""
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df


def gathered(df: DataFrame) -> DataFrame:
    """A saved table of few columns in one task, if its counted rows are ``FEW_ROWS`` at most."""
    return df.coalesce(1) if df.count() <= FEW_ROWS else df


def fresh(columns: Iterable[str], *names: str) -> list[str]:
    """The names with underscores before them until no column has them, in upper or lower case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
        taken.add(name.lower())
    return out


def smallest(df: DataFrame, key, rows: int) -> DataFrame:
    """At most ``rows`` rows, those of the smallest key (a hash); only keys are sorted."""
    keyed = df.withColumn("_key", key)
    cut_at = keyed.select("_key").orderBy("_key").limit(rows).agg({"_key": "max"}).first()[0]
    return keyed.where(keyed["_key"] <= cut_at).limit(rows).drop("_key") if cut_at is not None else df.limit(0)
