"""Exact classification metrics from (label, score) and (label, pred) tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortica.operators.order import running


def auc(scored: DataFrame, *by: str) -> DataFrame:
    """ROC-AUC as a rank statistic, ties at half.

    Rows are first counted by score; the running counts of negatives go over the
    distinct scores.
    """
    counts = scored.where("label is not null and score is not null").groupBy(*by, "score").agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))
    wins = running(counts, list(by), ["score"], below=F.col("neg")).withColumn("w", F.col("pos") * (F.col("below") + F.col("neg") / 2))
    total = F.sum("pos") * F.sum("neg")
    return wins.groupBy(*by).agg(F.when(total > 0, F.sum("w") / F.when(total > 0, total)).alias("auc"))


def accuracy(predicted: DataFrame, *by: str) -> DataFrame:
    return predicted.groupBy(*by).agg(F.avg((F.col("label") == F.col("pred")).cast("int")).alias("accuracy"))


def confusion(predicted: DataFrame) -> DataFrame:
    """A row per true label, a column per prediction."""
    return predicted.groupBy("label").agg(F.count_if(F.col("pred") == 0).alias("pred_0"), F.count_if(F.col("pred") == 1).alias("pred_1"))


def report(predicted: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support by class, and their macro and weighted means; 0 where undefined."""
    cells = predicted.agg(*[F.count_if((F.col("label") == a) & (F.col("pred") == b)).alias(f"c{a}{b}") for a in (0, 1) for b in (0, 1)])
    ratio = lambda a, b: F.when(b > 0, a / F.when(b > 0, b)).otherwise(F.lit(0.0))
    rows = []
    for k in (0, 1):
        tp, support, said = F.col(f"c{k}{k}"), F.col(f"c{k}0") + F.col(f"c{k}1"), F.col(f"c0{k}") + F.col(f"c1{k}")
        p, r = ratio(tp, said), ratio(tp, support)
        rows.append(F.struct(F.lit(str(k)).alias("class"), p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"), support.alias("support")))
    one = cells.select(F.array(*rows).alias("x"), *cells.columns)
    all_ = F.col("x")[0]["support"] + F.col("x")[1]["support"]

    def mean(name: str, weight) -> F.Column:
        return F.struct(F.lit(name).alias("class"), *[(F.col("x")[0][c] * weight(0) + F.col("x")[1][c] * weight(1)).alias(c) for c in ("precision", "recall", "f1")], all_.alias("support"))

    macro = mean("macro avg", lambda k: F.lit(0.5))
    weighted = mean("weighted avg", lambda k: ratio(F.col("x")[k]["support"], all_))
    acc = ratio(F.col("c00") + F.col("c11"), all_)
    accuracy_row = F.struct(F.lit("accuracy").alias("class"), acc.alias("precision"), acc.alias("recall"), acc.alias("f1"), all_.alias("support"))
    return one.select(F.explode(F.concat("x", F.array(accuracy_row, macro, weighted))).alias("r")).select("r.*")
