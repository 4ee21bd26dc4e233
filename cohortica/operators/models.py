"""Model selection on a predefined split: logistic regression, random forest, boosted trees."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from itertools import product

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortica.operators import forests, matrix, metrics

#: Grids of the full search (fixed values); a depth of None has no bound.
LR_GRID = {"C": [10.0, 15.0, 18.0, 21.0]}
RF_GRID = {"numTrees": [300, 600], "maxDepth": [None, 5, 10], "minSplit": [2, 5, 8, 10], "minInstancesPerNode": [2, 5], "featureSubsetStrategy": ["sqrt", 0.5]}
GBT_GRID = {"maxIter": [300, 600], "stepSize": [0.03, 0.1], "maxDepth": [2, 3, 4], "subsamplingRate": [0.8, 1.0], "colsampleByTree": [0.8, 1.0], "regLambda": [1.0, 10.0], "minChildWeight": [1, 3, 5, 10], "balance": [False, True]}
#: The parameter that says how many trees a family grows.
TREES = {"rf": "numTrees", "gbt": "maxIter"}
ROWS_PER_TASK = 20_000


def candidates(grid: dict[str, list]) -> list[dict]:
    """Every combination, keys sorted, the last key fastest."""
    keys = sorted(grid)
    return [dict(zip(keys, v, strict=True)) for v in product(*(grid[k] for k in keys))]


def prepared(fit_on: DataFrame, to: DataFrame, scale: bool) -> DataFrame:
    """(row_id, y, x array<double>) of long rows ``to``: medians, and scales, are those of ``fit_on``."""
    filled = matrix.impute(to, fit_on)
    if scale:
        filled = matrix.standardise(filled, matrix.impute(fit_on))
    return matrix.to_vectors(filled).select("row_id", "y", F.col("features").alias("x"))


def kept(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows in memory, in a task for every ``ROWS_PER_TASK``, as trees are many small jobs over them; and what to unpersist."""
    rows = rows.persist()
    return rows.coalesce(max(1, -(-rows.count() // ROWS_PER_TASK))), rows


def weighted(rows: DataFrame) -> tuple[DataFrame, int]:
    """Adds w, which lets both classes weigh alike, and the number of rows."""
    n = {r[0]: r[1] for r in rows.groupBy("y").agg(F.count(F.lit(1))).collect()}
    total = sum(n.values())
    w = F.lit(1.0)
    for y, c in n.items():
        w = F.when(F.col("y") == y, total / (len(n) * c)).otherwise(w)
    return rows.withColumn("w", w), total


def fit(family: str, params: dict, train: DataFrame, seed: int = 42):
    if family != "lr":
        grow = forests.fit_small if forests.small(train) else forests.fit_tall
        return grow(family, params, TREES[family], train, seed)
    rows, total = weighted(train.withColumn("x", array_to_vector("x")))
    return LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", regParam=1 / (params["C"] * total), elasticNetParam=0.0, standardization=False, maxIter=10000).fit(rows)


def scored(model, rows: DataFrame) -> DataFrame:
    """row_id, label, score (of label 1) and pred."""
    if isinstance(model, forests.Model):
        return forests.scored(model, rows)
    p = vector_to_array("probability")[1]
    return model.transform(rows.withColumn("x", array_to_vector("x"))).select("row_id", F.col("y").alias("label"), p.alias("score"), (p >= 0.5).cast("int").alias("pred"))


def evaluate(model, rows: DataFrame) -> tuple[float, float]:
    s = scored(model, rows).persist()
    out = metrics.auc(s).first()[0], metrics.accuracy(s).first()[0]
    s.unpersist()
    return out


def search(family: str, grid: dict[str, list], train: DataFrame, val: DataFrame, seed: int = 42, threads: int = 8) -> dict:
    """A candidate of greatest AUC on the validation rows, the first of equals; every candidate is fitted in full.

    Trees of small tables are fitted a task each, and candidates that differ in
    their number of trees alone share a fit; of taller tables, and of logistic
    regressions, several fits of distributed jobs go on at a time.
    """
    tried = candidates(grid)
    if family != "lr" and forests.small(train) and forests.small(val):
        got = forests.grid_scores(family, tried, TREES[family], train, val, seed)
    else:
        with ThreadPoolExecutor(threads) as pool:
            got = list(pool.map(lambda params: evaluate(fit(family, params, train, seed), val)[0] or 0.0, tried))
    return tried[max(range(len(tried)), key=lambda i: (got[i], -i))]


def train_and_evaluate(train: DataFrame, val: DataFrame, test: DataFrame, grids: dict[str, dict[str, list]], seed: int = 42) -> DataFrame:
    """(model, split, auc, accuracy): the validation model learns from train, the test model anew from train and val.

    The inputs are long rows.
    """
    spark = train.sparkSession
    both = train.unionByName(val)
    out = []
    for family, grid in grids.items():
        scale = family == "lr"
        (a, a_), (b, b_) = kept(prepared(train, train, scale)), kept(prepared(train, val, scale))
        params = search(family, grid, a, b, seed)
        out.append((family, "val", *evaluate(fit(family, params, a, seed), b)))
        (c, c_), d = kept(prepared(both, both, scale)), prepared(both, test, scale)
        out.append((family, "test", *evaluate(fit(family, params, c, seed), d)))
        for x in (a_, b_, c_):
            x.unpersist()
    return spark.createDataFrame(out, "model string, split string, auc double, accuracy double")
