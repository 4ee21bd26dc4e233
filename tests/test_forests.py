import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortica.operators import forests, models


def table(spark, n=150, w=4, seed=1):
    g = np.random.default_rng(seed)
    x = np.round(g.normal(size=(n, w)), 1)
    x[:, w - 1] = 3.0
    y = ((x[:, 0] * x[:, 1] > 0) ^ (g.random(n) < 0.1)).astype(int)
    rows = [(i, int(y[i]), [float(v) for v in x[i]]) for i in range(n)]
    return spark.createDataFrame(rows, "row_id bigint, y int, x array<double>").repartition(3), x, y


GBT = {"maxIter": 6, "stepSize": 0.3, "maxDepth": 3, "subsamplingRate": 0.8, "colsampleByTree": 0.8, "regLambda": 1.0, "minChildWeight": 1, "balance": True}
RF = {"numTrees": 6, "maxDepth": None, "minSplit": 5, "minInstancesPerNode": 2, "featureSubsetStrategy": 0.5}


def brute_tree(rule, x, y, key, margin, seed, number):
    """Value of each row by trying every split of every node, with the rows and features that are drawn for the tree."""
    rows, g, h = forests._drawn(rule, key, y, margin, seed, number)
    g, h = dict(zip(rows.tolist(), g)), dict(zip(rows.tolist(), h))
    if not rule.boosting:
        held = {c: sum(h[i] for i in rows if y[i] == c) for c in (0, 1)}
        h = {i: h[i] * sum(held.values()) / (2 * held[y[i]]) for i in h}
        g = {i: -h[i] * y[i] for i in h}
    out = np.zeros(len(x))
    ids = [0]  # node numbers go breadth first, two for each node that is split
    level, depth = [(0, rows.tolist(), np.arange(len(x)))], 0
    while level:
        after = []
        for node, own, all_ in level:
            total = sum(g[i] for i in own), sum(h[i] for i in own)
            score = lambda part: sum(g[i] for i in part) ** 2 / (sum(h[i] for i in part) + rule.lam)
            best = None
            if (rule.depth is None or depth < rule.depth) and (rule.boosting or 0 < sum(y[i] for i in own) < len(own)):
                varies = np.array([[len({x[i, f] for i in own}) > 1 for f in range(x.shape[1])]])
                allowed = forests._candidates(rule, seed, number, [node], x.shape[1], varies)[0]
                for f in np.flatnonzero(allowed):
                    for v in sorted({x[i, f] for i in own})[:-1]:
                        left, right = [i for i in own if x[i, f] <= v], [i for i in own if x[i, f] > v]
                        if rule.boosting and min(sum(h[i] for i in p) for p in (left, right)) < rule.child:
                            continue
                        if not rule.boosting and (min(len(left), len(right)) < rule.leaf or len(own) < rule.split):
                            continue
                        gain = round(score(left) + score(right) - score(own), 10)
                        if (gain > 1e-6 or not rule.boosting) and (best is None or gain > best[0]):
                            best = gain, f, v, left, right
            if best:
                _, f, v, left, right = best
                a = len(ids)
                ids += [a, a + 1]
                after += [(a, left, all_[x[all_, f] <= v]), (a + 1, right, all_[x[all_, f] > v])]
            else:
                out[all_] = -total[0] / (total[1] + rule.lam) * rule.rate
        level, depth = after, depth + 1
    return out


@pytest.mark.parametrize("family,params", [("gbt", GBT), ("gbt", GBT | {"minChildWeight": 5, "regLambda": 10.0, "balance": False}), ("rf", RF), ("rf", RF | {"maxDepth": 2, "featureSubsetStrategy": "sqrt"})])
def test_trees_against_every_split(spark, family, params):
    df, x, y = table(spark)
    key = np.array([r[0] for r in df.orderBy("row_id").select(F.xxhash64("row_id")).collect()])
    rule = forests.rules(family, params, int((y == 0).sum()), int((y == 1).sum()))
    margin, total = np.zeros(len(y)), np.zeros(len(y))
    for t in range(6):
        add = brute_tree(rule, x, y, key, margin, 42, t)
        total += add
        margin += add if rule.boosting else 0
    want = 1 / (1 + np.exp(-total)) if rule.boosting else total / 6
    model = models.fit(family, params, df, 42)
    got = {r["row_id"]: r["score"] for r in models.scored(model, df).collect()}
    assert np.allclose([got[i] for i in range(len(y))], want, atol=1e-9)
    assert len({len(t.feature) for t in model.trees} - {1}) and 0.6 < forests.auc(y, want) <= 1


@pytest.mark.parametrize("family,params", [("gbt", GBT | {"maxIter": 3}), ("rf", RF | {"numTrees": 2, "maxDepth": 4})])
def test_tall_tables_grow_the_same_trees(spark, monkeypatch, family, params):
    df, x, _ = table(spark, 120)
    near = models.fit(family, params, df, 7)
    monkeypatch.setattr(forests, "SMALL_CELLS", 0)
    far = models.fit(family, params, df, 7)
    assert [t.feature for t in near.trees] == [t.feature for t in far.trees] and [t.bin for t in near.trees] == [t.bin for t in far.trees]
    assert np.allclose(near.scores(x), far.scores(x), atol=1e-9)


def test_many_values_are_cut_into_bins(spark, monkeypatch):
    monkeypatch.setattr(forests, "BINS", 16)
    df = spark.range(1000).select(F.col("id").alias("row_id"), F.array(F.col("id").cast("double"), F.floor(F.col("id") / 900).cast("double")).alias("x"))
    edges = forests.edges_of(df)
    assert len(edges[0]) == 16 and edges[1].tolist() == [0.0, 1.0]
    assert np.bincount(forests.binned(np.arange(1000.0)[:, None], edges[:1])[:, 0]).max() <= 64


def test_grids_are_searched_in_full(spark):
    assert [len(models.candidates(g)) for g in (models.LR_GRID, models.RF_GRID, models.GBT_GRID)] == [4, 96, 768]
    df, _, _ = table(spark, 200)
    train, val = df.where("row_id % 4 <> 0").cache(), df.where("row_id % 4 = 0").cache()
    grid = {k: [v] for k, v in GBT.items()} | {"maxIter": [2, 5], "maxDepth": [1, 3], "regLambda": [1.0, 10.0]}
    tried = models.candidates(grid)
    scores = forests.grid_scores("gbt", tried, "maxIter", train, val, 42)
    own = [models.evaluate(models.fit("gbt", c, train), val)[0] for c in tried[:4]]
    assert len(scores) == 8 and np.allclose(scores[:4], own, atol=1e-6)
    assert models.search("gbt", grid, train, val) == tried[max(range(8), key=lambda i: (scores[i], -i))]
    none = train.where("y = 0")
    assert models.scored(models.fit("rf", RF, none), none).where("score <> 0").count() == 0
