import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortica.operators import stats, testing


def long_of(spark, x):
    rows = [(i, 0, f"f{j}", j, None if np.isnan(v) else float(v)) for i, r in enumerate(x) for j, v in enumerate(r)]
    return spark.createDataFrame(rows, "row_id bigint, y int, feature string, feat_ord int, value double").repartition(5, "row_id")


@pytest.mark.parametrize("panel", [1 << 20, 20])
def test_correlations(spark, monkeypatch, panel):
    monkeypatch.setattr(stats, "PANEL", panel)
    g = np.random.default_rng(1)
    x = g.normal(size=(90, 9)) + 1e6
    x[:, 3], x[:, 4] = 7.0, x[:, 0] * -2
    x[g.random(x.shape) < 0.1] = np.nan
    x[:, 8] = np.nan
    got = {(r["f1"], r["f2"]): r["r"] for r in stats.correlations(long_of(spark, x)).collect()}
    for a in range(8):
        for b in range(a, 8):
            both = ~np.isnan(x[:, a]) & ~np.isnan(x[:, b])
            want = np.corrcoef(x[both, a], x[both, b])[0, 1] if 3 not in (a, b) else None
            assert got[f"f{a}", f"f{b}"] == (pytest.approx(want, abs=1e-9) if want is not None else None)
    assert len(got) == 36
    assert stats.correlations(long_of(spark, x).limit(0)).count() == 0


def brute_bh(p):
    """adj_p of one family, in the order given."""
    order = sorted(range(len(p)), key=lambda i: p[i])
    q = [p[i] * len(p) / (r + 1) for r, i in enumerate(order)]
    best = [min([1.0, *q[r:]]) for r in range(len(q))]
    return {i: best[r] for r, i in enumerate(order)}


@pytest.mark.parametrize("family", [(), ("g",)])
def test_corrections_by_ranges(spark, family):
    g = np.random.default_rng(2)
    rows = [(i, ["a", "b", None][i % 3], float(np.round(g.random() ** 3, 2))) for i in range(400)] + [(400, "c", 0.5)]
    df = spark.createDataFrame(rows, "id int, g string, pval double").repartition(7)
    got = {r["id"]: r["adj_p"] for r in testing.correct(df, "fdr", family=family, tie=("id",)).collect()}
    flat = {r["id"]: r["adj_p"] for r in testing.correct(df, "bonferroni", family=family).collect()}
    for name in {r[1] for r in rows} if family else {0}:
        own = [r for r in rows if not family or r[1] == name]
        want = brute_bh([r[2] for r in own])
        assert all(got[r[0]] == pytest.approx(want[i]) and flat[r[0]] == pytest.approx(min(1.0, r[2] * len(own))) for i, r in enumerate(own))
    assert len(got) == len(flat) == 401
    assert testing.correct(df.limit(0), family=family).count() == 0
    plan = testing.correct(df, "fdr", tie=("id",))._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and df.columns + ["adj_p"] == testing.correct(df).columns


def test_equal_p_have_equal_adj_p(spark):
    df = spark.range(1000).select(F.col("id").cast("int").alias("id"), F.when(F.col("id") < 900, 0.01).otherwise(0.9).alias("pval"))
    got = testing.correct(df, tie=("id",)).groupBy("pval", F.round("adj_p", 12).alias("q")).count().collect()
    assert sorted((r["pval"], r["count"]) for r in got) == [(0.01, 900), (0.9, 100)]


def brute_leaves(names, d):
    """Merge the nearest two clusters, one pair at a time."""
    groups = {i: [i] for i in range(len(names))}
    while len(groups) > 1:
        ids = sorted(groups)
        _, a, b = min((round(d[np.ix_(groups[x], groups[y])].mean(), 12), x, y) for i, x in enumerate(ids) for y in ids[i + 1 :])
        groups[a] = groups[a] + groups.pop(b)
    return [names[i] for g in groups.values() for i in g]


@pytest.mark.parametrize("f,last", [(2, 1 << 20), (64, 1 << 20), (25, 30)])
def test_leaf_order_against_merging_one_pair_at_a_time(spark, monkeypatch, f, last):
    monkeypatch.setattr(stats, "LAST_PAIRS", last)
    g = np.random.default_rng(f)
    x = g.normal(size=(40, f)) + g.normal(size=(40, 1)) * (np.arange(f) % 5)
    r = np.corrcoef(x.T)
    names = [f"seq.{i}.{i % 3}" for i in range(f)]
    rows = [(names[a], names[b], float(r[a, b]) if (a, b) != (0, 1) or f == 2 else None) for a in range(f) for b in range(a, f)]
    d = 1 - r
    if f > 2:
        d[0, 1] = d[1, 0] = 1.0
    frame = spark.createDataFrame(rows, "f1 string, f2 string, r double")
    assert [x["f"] for x in stats.leaf_order(frame).orderBy("i").collect()] == brute_leaves(names, d)


def test_heatmap_of_one_feature(spark):
    one = spark.createDataFrame([("seq.1.1", "seq.1.1", 1.0)], "f1 string, f2 string, r double")
    assert [tuple(r) for r in stats.heatmap(one).collect()] == [(0, 0, "seq.1.1", "seq.1.1", 1.0)]
    assert stats.heatmap(one.limit(0)).count() == 0
