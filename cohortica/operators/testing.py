"""Welch tests, corrections for multiple testing, permutation tests, annotation of their results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortica.functions.expressions import label_or, minus_log10, probe_id, quoted, t_pvalue
from cohortica.operators.order import dealt


def welch_stats(long: DataFrame) -> DataFrame:
    """One grouped pass: n, means, t and degrees of freedom per feature with two values or more per label."""
    agg = [f(F.when(F.col("y") == y, F.col("value"))).alias(f"{n}{y}") for y in (1, 0) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))]
    s = long.groupBy("feature", "feat_ord").agg(*agg).where("n1 >= 2 and n0 >= 2")
    e1, e0 = F.col("v1") / F.col("n1"), F.col("v0") / F.col("n0")
    diff = F.col("m1") - F.col("m0")
    se = F.sqrt(e1 + e0)
    t = F.when(se > 0, diff / se).when(diff != 0, F.signum(diff) * F.lit(float("inf")))
    df = F.when(se > 0, (e1 + e0) ** 2 / (e1**2 / (F.col("n1") - 1) + e0**2 / (F.col("n0") - 1))).otherwise(F.lit(1.0))
    return s.select("feature", "feat_ord", F.col("n1").alias("n_pos"), F.col("n0").alias("n_neg"), diff.alias("mean_diff"), t.alias("t"), df.alias("df"))


def welch(long: DataFrame) -> DataFrame:
    """Adds the two-sided p; features whose p is not finite go."""
    return welch_stats(long).withColumn("pval", t_pvalue("t", "df")).where("pval is not null and not isnan(pval)")


def correct(results: DataFrame, method: str = "fdr", p: str = "pval", family: tuple[str, ...] = (), tie: tuple[str, ...] = ()) -> DataFrame:
    """Adds adj_p by Benjamini-Hochberg ('fdr') or 'bonferroni', within each family (null is a family too).

    ``tie`` orders equal p; they get equal adj_p in any case.  Rows are dealt by
    ranges of (family, p), so a family of any size spreads: a row's rank is its
    place within its range and what lies before that, and its minimum over larger
    p that of the rest of its range and of the ranges behind.
    """
    if method not in ("fdr", "bonferroni"):
        raise ValueError(f"unknown correction {method!r}")
    if method == "bonferroni":
        n = results.groupBy(*[quoted(c).alias(f"{c}_of") for c in family]).agg(F.count(F.lit(1)).alias("_m"))
        rows = results.crossJoin(F.broadcast(n)) if not family else results.join(n, _same(family))  # without a family: one row
        return rows.select(*[quoted(c) for c in results.columns], F.least(F.lit(1.0), F.col(p) * F.col("_m")).alias("adj_p"))
    rows, part = dealt(results, [*family, p, *tie])
    of = [f"{c}_of" for c in family]
    ranges = Window.partitionBy(F.lit(0), *of).orderBy("_at")  # as many rows as there are ranges
    counts = rows.groupBy(*[quoted(c).alias(o) for c, o in zip(family, of, strict=True)], F.col(part).alias("_at")).agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.select("*", F.coalesce(F.sum("_n").over(ranges.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"), F.sum("_n").over(Window.partitionBy(F.lit(0), *of)).alias("_m"))
    line = Window.partitionBy(part, *[quoted(c) for c in family]).orderBy(p, *tie)
    both = (F.col(part) == F.col("_at")) & _same(family)
    q = rows.join(counts, both).withColumn("_r", F.col("_ahead") + F.row_number().over(line)).withColumn("_q", F.col(p) * F.col("_m") / F.col("_r"))
    behind = q.groupBy(*of, "_at").agg(F.min("_q").alias("_least"))
    behind = behind.select(*[F.col(o).alias(f"{o}_b") for o in of], F.col("_at").alias("_at_b"), F.min("_least").over(ranges.rowsBetween(1, Window.unboundedFollowing)).alias("_behind"))
    on = F.col("_at") == F.col("_at_b")
    for o in of:
        on = on & F.col(o).eqNullSafe(F.col(f"{o}_b"))
    rest = Window.partitionBy(part, *[quoted(c) for c in family]).orderBy("_r").rowsBetween(0, Window.unboundedFollowing)
    return q.join(behind, on).select(*[quoted(c) for c in results.columns], F.least(F.lit(1.0), F.min("_q").over(rest), F.col("_behind")).alias("adj_p"))


def _same(family: tuple[str, ...]) -> Column:
    on = F.lit(True)
    for c in family:
        on = on & quoted(c).eqNullSafe(F.col(f"{c}_of"))
    return on


def ttest_order(results: DataFrame, script_order: bool = True) -> DataFrame:
    """By adj_p, and among equals by pval: the larger first as in the scripts, or the smaller."""
    return results.orderBy("adj_p", F.desc("pval") if script_order else F.asc("pval"), "feat_ord")


def information_order(results: DataFrame) -> DataFrame:
    """By adj_p, and among equals by mi, the largest first."""
    return results.orderBy("adj_p", F.desc("mi"), "feat_ord")


def top_features(results: DataFrame, k: int = 10) -> DataFrame:
    """The feature list: column protein."""
    return ttest_order(results).limit(k).select(F.col("feature").alias("protein"))


def annotate(results: DataFrame, annotation: DataFrame, order: str = "PROBEID") -> DataFrame:
    """Left join by probe id, the first annotation of each probe (by ``order``, then symbol)."""
    w = Window.partitionBy("PROBEID").orderBy(*dict.fromkeys([order, "SYMBOL"]))
    first = annotation.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    return results.withColumn("PROBEID", probe_id(F.col("feature"))).join(first, "PROBEID", "left")


def volcano(annotated: DataFrame, alpha: float = 0.05) -> DataFrame:
    """The relation behind a volcano plot."""
    return annotated.select(
        "feature", "PROBEID", "SYMBOL", label_or(F.col("SYMBOL"), F.col("PROBEID")).alias("label"), "mean_diff", "adj_p", minus_log10(F.col("adj_p")).alias("y"), (F.col("adj_p") < alpha).alias("is_sig")
    )


def top_hits(points: DataFrame, n: int = 20) -> DataFrame:
    """The n best significant points, or the n best of all where none is."""
    some = F.max("is_sig").over(Window.partitionBy())  # a row per feature
    return points.withColumn("_any", some).where("is_sig or not _any").orderBy("adj_p", "feature").limit(n).drop("_any")


def permutation_p(observed: DataFrame, permuted: DataFrame, rounds: int) -> DataFrame:
    """(exceedances + 1) / (rounds + 1) per feature.  observed: feature, mi; permuted: feature, mi of each round."""
    both = permuted.withColumnRenamed("mi", "_m").join(observed, "feature")
    return both.groupBy("feature").agg(F.first("mi").alias("mi"), ((F.count_if(F.col("_m") >= F.col("mi")) + 1) / F.lit(rounds + 1)).alias("p_perm"))
