"""The long feature matrix (row_id, y, feature, feat_ord, value), and wide tables of it."""

from __future__ import annotations

import hashlib
import re
from itertools import combinations, islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortica.functions.expressions import numeric, quoted
from cohortica.operators.order import percentiles


def features_by_prefix(columns: list[str], prefix: str = "seq.") -> list[str]:
    """In file order; an error when there are none."""
    found = [c for c in columns if c.startswith(prefix)]
    if not found:
        raise AssertionError(f"no column begins with {prefix!r}")
    return found


def features_by_pattern(columns: list[str], pattern: str = "^seq") -> list[str]:
    return [c for c in columns if re.search(pattern, c)]


def sample_features(names: list[str], n: int, seed: int = 42) -> list[str]:
    """At most n of the names, without replacement: those first in the order of md5 of 'seed|name'."""
    return sorted(names, key=lambda x: (hashlib.md5(f"{seed}|{x}".encode()).hexdigest(), x))[:n]


def feature_pairs(names: list[str], most: int = 15) -> list[tuple[str, str]]:
    """The first pairs of different names, in their order."""
    return list(islice(combinations(names, 2), most))


def to_long(df: DataFrame, features: list[str], row_id: str, y) -> DataFrame:
    """Only the columns needed are read; names come from a literal array, so wide tables stay one projection."""
    values = F.posexplode(F.array(*[numeric(quoted(c)) for c in features])).alias("feat_ord", "value")
    names = F.array(*[F.lit(c) for c in features])
    return df.select(quoted(row_id).alias("row_id"), y.cast("int").alias("y"), values).withColumn("feature", F.element_at(names, F.col("feat_ord") + 1))


def vectors_to_long(df: DataFrame, vector: str, row_id: str, y) -> DataFrame:
    """From an array column; features are named seq.<pos>.<pos>."""
    return df.select(quoted(row_id).alias("row_id"), y.cast("int").alias("y"), F.posexplode(F.col(vector)).alias("feat_ord", "v")).select(
        "row_id", "y", F.format_string("seq.%d.%d", "feat_ord", "feat_ord").alias("feature"), "feat_ord", numeric(F.col("v")).alias("value")
    )


def medians(long: DataFrame) -> DataFrame:
    """Exact, of each feature with a known value."""
    return percentiles(long, ["feature"], "value", (0.5,)).select("feature", F.col("p0").alias("median"))


def impute(long: DataFrame, fitted: DataFrame | None = None) -> DataFrame:
    """Missing values by the medians of ``fitted`` (of the same shape; by default the rows themselves); null where no value is known."""
    return long.join(medians(fitted if fitted is not None else long), "feature", "left").withColumn("value", F.coalesce("value", "median")).drop("median")


def standardise(long: DataFrame, fitted: DataFrame | None = None) -> DataFrame:
    """Mean 0, population standard deviation 1; a constant feature is only centred."""
    source = fitted if fitted is not None else long
    s = source.groupBy("feature").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    return long.join(s, "feature").withColumn("value", (F.col("value") - F.col("m")) / F.when(F.col("s") > 0, F.col("s")).otherwise(1.0)).drop("m", "s")


def row_means(long: DataFrame) -> DataFrame:
    return long.groupBy("row_id").agg(F.avg("value").alias("mean"))


def to_vectors(long: DataFrame, width: int | None = None) -> DataFrame:
    """row_id, y, features: the values of a row in feature order."""
    packed = long.groupBy("row_id", "y").agg(F.array_sort(F.collect_list(F.struct("feat_ord", "value"))).alias("v"))
    return packed.select("row_id", "y", F.transform("v", lambda x: x["value"]).alias("features"))
