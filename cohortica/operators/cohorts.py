"""Cohort filters, and splits whose members every engine can work out: by md5 order within quotas."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortica.functions.expressions import hash_order, not_mild, quoted, truth
from cohortica.operators.order import running, spare


class Subsets(NamedTuple):
    pos: DataFrame
    neg: DataFrame


def split_by_label(df: DataFrame, label: str) -> Subsets:
    """Rows without a label are in neither part."""
    y = truth(quoted(label))
    return Subsets(df.where(y == 1), df.where(y == 0))


def with_verdict(df: DataFrame, severity: str, mild: str, notmild: str) -> DataFrame:
    return df.withColumn("not_mild", not_mild(quoted(severity), truth(quoted(mild)) == 1, truth(quoted(notmild)) == 1))


def cohort(df: DataFrame, condition: str, case: str, severity: str, mild: str, notmild: str) -> DataFrame:
    """Rows with the condition that are either no case, or a case that is not mild: one predicate, no union."""
    have, is_case = truth(quoted(condition)) == 1, truth(quoted(case))
    return with_verdict(df, severity, mild, notmild).where(have & ((is_case == 0) | ((is_case == 1) & F.col("not_mild"))))


def _ranked(df: DataFrame, id_: str, label: str, seed: int) -> tuple[DataFrame, str]:
    """With the rows that come before within the label in hash order, and the name of that column."""
    hash_, place = spare(df.columns, "hash", "place")
    return running(df.withColumn(hash_, hash_order(seed, id_)), [label], [hash_, id_], **{place: F.lit(1)}).drop(hash_), place


def quotas(df: DataFrame, label: str, share: float) -> DataFrame:
    """Held-out rows per label: ceil(n * share) in all, in proportion, remainders to the largest fractions."""
    n = df.where(quoted(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    everything = Window.partitionBy()  # a row per label
    total = F.sum("n").over(everything)
    n = n.withColumn("held", F.ceil(total * share)).withColumn("exact", F.col("n") * F.col("held") / total)
    n = n.withColumn("base", F.floor("exact"))
    extra = F.col("held") - F.sum("base").over(everything)
    rank = F.row_number().over(everything.orderBy(F.desc(F.round(F.col("exact") - F.col("base"), 9)), quoted(label)))
    return n.withColumn("quota", F.col("base") + F.when(rank <= extra, 1).otherwise(0)).select(label, "quota")


def stratified(df: DataFrame, id_: str, label: str, share: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds part: 'unseen' for the held-out rows, 'seen' for the others."""
    ranked, place = _ranked(df.where(quoted(label).isNotNull()), id_, label, seed)
    of, quota = spare(ranked.columns, "of", "quota")
    held = quotas(df, label, share).select(quoted(label).alias(of), F.col("quota").alias(quota))
    return ranked.join(held, quoted(label) == F.col(of)).select(*[quoted(c) for c in df.columns], F.when(F.col(place) < F.col(quota), "unseen").otherwise("seen").alias("part"))


def balanced(df: DataFrame, id_: str, label: str, share: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds part: 'val' for as many rows of each of labels 1 and 0, 'train' for the others.

    Each label gives half of round(n * share), half to even, or all that the scarcer one has.
    """
    n = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(quoted(label) == 1).alias("pos"), F.count_if(quoted(label) == 0).alias("neg"))
    ranked, place = _ranked(df, id_, label, seed)
    (most,) = spare(ranked.columns, "most")
    each = n.select(F.least(F.expr(f"cast(bround(n * {share}) as bigint) div 2"), "pos", "neg").alias(most))  # one row
    val = (F.col(place) < F.col(most)) & quoted(label).isin(0, 1)
    return ranked.crossJoin(F.broadcast(each)).select(*[quoted(c) for c in df.columns], F.when(val, "val").otherwise("train").alias("part"))


def sample_per_group(df: DataFrame, id_: str, label: str, rows: int, seed: int = 42) -> DataFrame:
    ranked, place = _ranked(df, id_, label, seed)
    return ranked.where(F.col(place) < rows).drop(place)


def rest(df: DataFrame, taken: DataFrame, id_: str) -> DataFrame:
    """Rows whose id is not among those taken."""
    return df.join(taken.select(id_), id_, "left_anti")


def leaks(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that two tables share, by all the columns both have; nulls match nulls."""
    shared = [c for c in a.columns if c in b.columns]
    return a.select(*map(quoted, shared)).intersectAll(b.select(*map(quoted, shared)))


def split_report(parts: DataFrame, label: str, share: float, seed: int) -> DataFrame:
    """One row of what a split gave."""
    seen, unseen = F.col("part") == "seen", F.col("part") == "unseen"
    return parts.agg(
        F.lit(share).alias("test_size"),
        F.lit(seed).alias("random_state"),
        F.count_if(seen).alias("n_seen"),
        F.count_if(unseen).alias("n_unseen"),
        F.count_if(seen & (quoted(label) == 1)).alias("n_pos_seen"),
        F.count_if(unseen & (quoted(label) == 1)).alias("n_pos_unseen"),
    )
