"""Descriptive statistics over the long matrix and over tables, with exact aggregates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortica.functions.expressions import quoted
from cohortica.operators.order import percentiles, running, spare, written

LAST_PAIRS = 1 << 20  # distances of clusters that one task may hold
PANEL = 1 << 20  # pairs of features of which a task adds up sums


def describe(long: DataFrame, percents: tuple[float, ...] = (0.25, 0.5, 0.75, 0.9, 0.99)) -> DataFrame:
    """Count, mean, std, min, percentiles (linear) and max of all values, as one row."""
    whole = long.agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    p = percentiles(long, [], "value", percents).drop("n")
    return whole.crossJoin(F.broadcast(p)).select("n", "mean", "std", "min", *[F.col(f"p{i}").alias(f"p{round(x * 100)}") for i, x in enumerate(percents)], "max")  # a row each


def group_means(long: DataFrame) -> DataFrame:
    """Means of labels 1 and 0 by feature, in one pass."""
    return long.groupBy("feature", "feat_ord").agg(F.avg(F.when(F.col("y") == 1, F.col("value"))).alias("mean_pos"), F.avg(F.when(F.col("y") == 0, F.col("value"))).alias("mean_neg"))


def ranked_difference(long: DataFrame, k: int = 6) -> DataFrame:
    """rank (from 1), feature, abs_diff of the k features whose group means differ most."""
    out = group_means(long).withColumn("abs_diff", F.abs(F.col("mean_pos") - F.col("mean_neg")))
    order = [F.desc_nulls_last(F.round("abs_diff", 9)), F.col("feat_ord")]
    return out.orderBy(*order).limit(k).select(F.row_number().over(Window.orderBy(*order)).alias("rank"), "feature", "abs_diff")  # k rows


def top_difference(long: DataFrame, k: int = 6) -> DataFrame:
    return ranked_difference(long, k).select("feature", "abs_diff")


def correlations(imputed: DataFrame, features: list[str] | None = None) -> DataFrame:
    """Pearson r of all pairs f1 <= f2 of features over the rows that have both; null for a constant one.

    A row's features meet in one array, and a task adds up products of whole
    batches of rows as matrices; what leaves it are sums, a row per feature, so
    nothing of the size of pairs times rows is ever made.  Features are centred
    by their least value first.  A task holds a panel of the matrix of sums: all
    of it up to about a thousand features, and else the rows are sent to each panel.
    """
    d = imputed if features is None else imputed.where(F.col("feature").isin(features))
    d = d.where("value is not null")
    known = d.groupBy("feature", "feat_ord").agg(F.min("value").alias("least"))
    known = known.withColumn("at", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("feat_ord", "feature")) - 1)  # a row a feature
    known = written(known, "features")
    n = known.count()
    if not n:
        return d.sparkSession.createDataFrame([], "f1 string, f2 string, r double")
    panels = -(-(n * n) // PANEL)
    rows = d.join(F.broadcast(known), ["feature", "feat_ord"]).groupBy("row_id").agg(F.collect_list("at").alias("at"), F.collect_list(F.col("value") - F.col("least")).alias("v"))  # features are metadata
    rows = rows.select("at", "v", F.explode(F.sequence(F.lit(0), F.lit(panels - 1))).alias("panel"))
    if panels > 1:
        rows = rows.repartition("panel", F.spark_partition_id()).sortWithinPartitions("panel")
    width = -(-n // panels)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, panel = None, -1

        def made() -> pd.DataFrame:
            return pd.DataFrame({"i": range(panel * width, panel * width + sums.shape[1]), "sums": [x.ravel() for x in sums.transpose(1, 0, 2)]})

        for b in batches:
            for p in b["panel"].unique():
                own = b[b["panel"] == p]
                if p != panel:
                    if sums is not None:
                        yield made()
                    panel = int(p)
                    sums = np.zeros((6, min(width, n - panel * width), n))
                x, has = np.zeros((len(own), n)), np.zeros((len(own), n))
                at = np.repeat(np.arange(len(own)), own["at"].map(len)), np.concatenate(own["at"].to_numpy())
                x[at], has[at] = np.concatenate(own["v"].to_numpy()), 1
                mine = slice(panel * width, panel * width + sums.shape[1])
                # of pairs: rows that have both, products, sums and squares of either over these rows
                for j, (a, c) in enumerate(((has, has), (x, x), (x, has), (has, x), (x * x, has), (has, x * x))):
                    sums[j] += a[:, mine].T @ c
        if sums is not None:
            yield made()

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        i = int(pdf["i"].iloc[0])
        m, xy, sx, sy, xx, yy = np.sum(np.stack(pdf["sums"].to_numpy()), axis=0).reshape(6, n)[:, i:]
        vx, vy = m * xx - sx * sx, m * yy - sy * sy
        ok = (m > 0) & (vx > 0) & (vy > 0)
        r = (m * xy - sx * sy) / np.sqrt(np.where(ok, vx, 1)) / np.sqrt(np.where(ok, vy, 1))
        return pd.DataFrame({"i": i, "j": np.arange(i, n), "r": pd.Series(r, dtype="Float64").mask(~ok)}).loc[m > 0]

    sums = rows.mapInPandas(run, "i int, sums array<double>")
    found = sums.groupBy("i").applyInPandas(added, "i int, j int, r double")  # as many rows as tasks made sums
    names = [F.broadcast(known.select(F.col("at").alias(c), F.col("feature").alias(f))) for c, f in (("i", "f1"), ("j", "f2"))]
    return found.join(names[0], "i").join(names[1], "j").select("f1", "f2", F.when(F.col("r").isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("r")))).alias("r"))


def correlation_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.withColumnRenamed("r", "_r"), ["f1", "f2"]).select("f1", "f2", (F.col("r") - F.col("_r")).alias("diff"))


def frequencies(df: DataFrame, column: str) -> DataFrame:
    n = df.where(quoted(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("all")))).select(column, "n", (F.col("n") / F.col("all")).alias("share"))  # one row


def crosstab(df: DataFrame, by: str, label: str) -> DataFrame:
    """Counts of label 0 and 1, their total and the percentage of 1, largest first."""
    out = df.where(quoted(by).isNotNull()).groupBy(by).agg(F.count_if(quoted(label) == 0).alias("n_neg"), F.count_if(quoted(label) == 1).alias("n_pos"))
    out = out.withColumn("total", F.col("n_neg") + F.col("n_pos")).where("total > 0")
    return out.withColumn("pct_pos", F.bround(100.0 * F.col("n_pos") / F.col("total"), 1)).orderBy(F.desc("total"), by)


def cube_counts(df: DataFrame, a: str, b: str) -> DataFrame:
    """A two-way table with its margins."""
    return df.cube(a, b).agg(F.count(F.lit(1)).alias("n"))


def histogram(df: DataFrame, value: str, lo: float | None, hi: float | None, bins: int, *by: str) -> DataFrame:
    """Counts and densities of equal bins over [lo, hi]; the last bin is closed, values outside are left out.

    An end that is None is that of the data, the same for all groups, so that
    their bins are comparable.  Where all values are equal they are in bin 0, and
    the density is null.
    """
    v = quoted(value).cast("double")
    known = df.select(*[quoted(c) for c in by], v.alias("v")).where("v is not null and not isnan(v)")
    (low, high) = spare(known.columns, "lo", "hi")
    ends = known.agg(*[(f("v") if x is None else F.max(F.lit(float(x)))).alias(n) for x, f, n in ((lo, F.min, low), (hi, F.max, high))])
    rows = known.crossJoin(F.broadcast(ends))  # one row
    width = (F.col(high) - F.col(low)) / bins
    at = F.when(width > 0, F.least(F.floor((F.col("v") - F.col(low)) / width), F.lit(bins - 1))).otherwise(0).cast("int")
    counted = rows.where(F.col("v").between(F.col(low), F.col(high))).groupBy(*by, at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.first(width).alias("_w"))
    total = F.sum("n").over(Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0)))  # as many rows as bins
    return counted.select(*by, "bin", "n", F.when(F.col("_w") > 0, F.col("n") / (total * F.col("_w"))).alias("density"))


def edge_histogram(df: DataFrame, value: str, edges: list[float]) -> DataFrame:
    """Counts between given edges (last bin closed), and in bin -1 the values that no bin takes."""
    v = quoted(value)
    at = F.lit(-1)
    for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        at = F.when((v >= a) & ((v < b) | (F.lit(i == len(edges) - 2) & (v == b))), i).otherwise(at)
    return df.where(v.isNotNull()).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def boxplot(df: DataFrame, value: str, by: str) -> DataFrame:
    """Quartiles, and whiskers at the outermost values within 1.5 interquartile ranges."""
    q = percentiles(df, [by], value, (0.25, 0.5, 0.75)).select(quoted(by).alias("of"), F.array("p0", "p1", "p2").alias("q"))
    reach = 1.5 * (F.col("q")[2] - F.col("q")[0])
    inside = df.select(quoted(by).alias(by), quoted(value).alias("value")).join(q, F.col(by).eqNullSafe(F.col("of"))).where((F.col("value") >= F.col("q")[0] - reach) & (F.col("value") <= F.col("q")[2] + reach))
    return inside.groupBy(by).agg(F.first("q").alias("q"), F.min("value").alias("low"), F.max("value").alias("high")).select(by, F.col("q")[0].alias("q1"), F.col("q")[1].alias("med"), F.col("q")[2].alias("q3"), "low", "high")


def leaf_order(correlation: DataFrame) -> DataFrame:
    """f, i: features and their places (from 0) as leaves of average linkage on 1 - r (1 where r is missing).

    All reciprocal nearest neighbours merge in a round, which for average linkage
    gives the tree of merging one pair at a time; of equal distances the pair
    named first counts as nearer.  Distances to a merged pair are the means of
    those to its two, weighted by their sizes.  The branch that holds the earlier
    feature (by the numbers in its name) comes first.  The number of distances
    left comes to the driver, once a round; up to ``LAST_PAIRS`` of them are
    merged in one task.
    """
    digits = F.transform(F.filter(F.split("f", r"\."), lambda x: x.rlike("^[0-9]+$")), lambda x: x.cast("bigint"))
    names = correlation.select(F.col("f1").alias("f")).union(correlation.select("f2")).distinct()
    leaves = written(running(names.withColumn("digits", digits), [], ["digits", "f"], at=F.lit(1)).select("f", F.col("at").alias("c"), F.lit(0).cast("bigint").alias("i")), "leaves")
    ends = [leaves.select(F.col("f").alias(f), F.col("c").alias(c)) for f, c in (("f1", "a"), ("f2", "b"))]
    d = correlation.where("f1 <> f2").join(ends[0], "f1").join(ends[1], "f2").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg((1 - F.coalesce(F.max("r"), F.lit(0.0))).alias("d"))
    both = lambda x: x.select("a", "b", "d").unionByName(x.select(F.col("b").alias("a"), F.col("a").alias("b"), "d"))
    # a pair that the table lacks is 1 apart, as one without r
    every = leaves.where("c > 0").select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("c") - 1)).alias("a"), F.col("c").alias("b"))
    d = written(every.join(d, ["a", "b"], "left").select("a", "b", F.coalesce("d", F.lit(1.0)).alias("d")), "distances")
    size = leaves.select("c", F.lit(1).cast("bigint").alias("n"))
    while d.count() > LAST_PAIRS:
        near = both(d).groupBy("a").agg(F.min(F.struct(F.round("d", 12), F.least("a", "b"), F.greatest("a", "b"))).alias("m"))
        pairs = near.groupBy(F.col("m.col2").alias("into"), F.col("m.col3").alias("c")).agg(F.count(F.lit(1)).alias("k")).where("k = 2").select("into", "c")
        pairs = pairs.join(size.withColumnRenamed("n", "added"), "c").join(size.select(F.col("c").alias("into"), F.col("n").alias("before")), "into")
        moved = written(size.join(pairs, "c", "left").select("c", "n", F.coalesce("into", "c").alias("to"), F.coalesce("before", F.lit(0)).alias("ahead")), "moved")
        leaves = written(leaves.join(moved, "c").select("f", F.col("to").alias("c"), (F.col("i") + F.col("ahead")).alias("i")), "leaves")
        size = moved.groupBy(F.col("to").alias("c")).agg(F.sum("n").alias("n"))
        a, b = (moved.select(F.col("c").alias(c), F.col("to").alias(f"to_{c}"), F.col("n").alias(f"n_{c}")) for c in ("a", "b"))
        w = F.col("n_a") * F.col("n_b")
        part = d.join(a, "a").join(b, "b").where("to_a <> to_b").groupBy(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b"))
        d = written(part.agg((F.sum(w * F.col("d")) / F.sum(w)).alias("d")), "distances")
    rest = size.select(F.col("c").alias("a"), F.lit(None).cast("bigint").alias("b"), F.col("n").cast("double").alias("d")).unionByName(d).groupBy()
    placed = rest.applyInPandas(_merged, "c bigint, ahead bigint")
    return leaves.join(placed, "c").select("f", (F.col("i") + F.col("ahead")).cast("int").alias("i"))


def _merged(pdf: pd.DataFrame) -> pd.DataFrame:
    """c, ahead (leaves that come before it) of clusters a with d leaves (where b is missing), given their distances."""
    own = pdf["b"].isna()
    ids = np.sort(pdf.loc[own, "a"].to_numpy(np.int64))
    n = len(ids)
    leaves = pdf[own].set_index("a")["d"].loc[ids].to_numpy()
    d = np.full((n, n), np.inf)
    a, b = (np.searchsorted(ids, pdf.loc[~own, c].to_numpy(np.int64)) for c in ("a", "b"))
    d[a, b] = d[b, a] = pdf.loc[~own, "d"]
    size, groups = leaves.copy(), [[i] for i in range(n)]
    for _ in range(n - 1):
        a, b = divmod(int(np.argmin(np.round(d, 12))), n)
        groups[a] += groups[b]
        d[a] = (size[a] * d[a] + size[b] * d[b]) / (size[a] + size[b])
        d[:, a] = d[a]
        d[b] = d[:, b] = np.inf
        d[a, a] = np.inf
        size[a] += size[b]
    order = groups[0] if n else []
    return pd.DataFrame({"c": ids[order], "ahead": np.concatenate([[0], np.cumsum(leaves[order])[:-1]]).astype(np.int64) if n else []})


def heatmap(correlation: DataFrame) -> DataFrame:
    """(i, j, f1, f2, r) for both halves, in the order of the leaves."""
    correlation = written(correlation, "correlation")
    names = leaf_order(correlation)
    both = correlation.unionByName(correlation.where("f1 <> f2").select(F.col("f2").alias("f1"), F.col("f1").alias("f2"), "r"))
    return both.join(names.select("i", F.col("f").alias("f1")), "f1").join(names.select(F.col("i").alias("j"), F.col("f").alias("f2")), "f2").select("i", "j", "f1", "f2", "r")
