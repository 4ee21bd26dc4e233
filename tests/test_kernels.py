import numpy as np
import pytest
from pyspark.sql import functions as F
from tests import dense

from cohortica import kernels
from cohortica.functions import balls, neighbours
from cohortica.operators import forests, information, models, nearest, tiles


def _asked(n, kind):
    g = np.random.default_rng(n)
    x = g.normal(size=(5, n))
    if kind == "ties":
        x = np.round(x, 1)
    if kind == "uneven":
        x[0], x[1], x[2, : n // 2] = (x[0] > 0) * 1.0, x[1] * 1e6, 0.25
        x[3, 0] = 1e9
    return x


@pytest.mark.parametrize("kind", ["plain", "ties", "uneven"])
@pytest.mark.parametrize("n", [4, 60, 900])
def test_sums_of_sets_are_those_of_numpy(spark, n, kind):
    assert kernels.ready(spark, "Sets")
    x, size = _asked(n, kind), 8
    sets = [(0, 1), (1, 0), (2,), (0, 1, 2), (0, 2, 1), (4, 3, 1), (0, 1, 2, 3), (4, 2, 3, 1)]
    sets.sort(key=lambda s: (sorted(s), s))
    for scale in (False, True):
        for marginals, own in (((), sets), (((0,), (1,)), [s for s in sets if len(s) == 2]), (((0, 2), (1, 2), (2,)), [s for s in sets if len(s) == 3]), (((0, 1, 2), (3,)), [s for s in sets if len(s) == 4])):
            want = tiles._tile_sums(dict(enumerate(x)), own, 3, marginals, scale)
            data = np.array([size, n, len(x)], "<i4").tobytes() + x.tobytes()
            row = spark.createDataFrame([([data], b"", b"", tiles._asked(own, [0], 3, marginals, scale))], "held array<binary>, grp binary, shift binary, asked binary")
            got = np.frombuffer(row.select(kernels.call("Sets", "held", "grp", "shift", "asked")).first()[0], "<i8")
            assert got[:3].tolist() == [1, 0, n]
            with np.errstate(invalid="ignore"):
                assert got[3:].view("<f8").reshape(want.shape) == pytest.approx(want, rel=1e-12, abs=1e-9, nan_ok=True)


def test_sums_without_a_compiler_are_the_same(spark, monkeypatch):
    v = spark.range(300).select(F.col("id").alias("row_id"), (F.col("id") % 3).cast("int").alias("y"), F.array(*[F.round(F.randn(i), 1 + i) for i in range(10)]).alias("features")).cache()
    ask = [dict(sets=[(0, 9), (9, 0), (2, 3)], marginals=((0,), (1,)), by_label=True), dict(sets=[(0, 9, 4), (4, 0, 9)], marginals=((0, 2), (1, 2), (2,))), dict(sets=[(1,), (1, 8)], jitter=True, by_label=True)]
    found = []
    for fast in (True, False):
        if not fast:
            monkeypatch.setattr(kernels, "ready", lambda *_: False)
        found.append([sorted(map(tuple, tiles.sums(v, **a).collect())) for a in ask])
    for a, b in zip(*found, strict=True):
        assert len(a) and [r[:3] for r in a] == [r[:3] for r in b]
        assert np.array([r[3:] for r in a]) == pytest.approx(np.array([r[3:] for r in b]), rel=1e-9)


@pytest.mark.parametrize("family,params,vary", [("gbt", {"stepSize": 0.3, "maxDepth": 4, "subsamplingRate": 0.8, "colsampleByTree": 0.8, "regLambda": 1.0, "minChildWeight": 1, "balance": True, "maxIter": 7}, {"maxIter": [3, 7], "subsamplingRate": [0.8, 1.0]}), ("rf", {"maxDepth": None, "minSplit": 5, "minInstancesPerNode": 2, "featureSubsetStrategy": "sqrt", "numTrees": 30}, {"numTrees": [4, 9], "maxDepth": [None, 5]})])
def test_trees_are_those_of_numpy(spark, monkeypatch, family, params, vary):
    g = np.random.default_rng(5)
    x = np.round(g.normal(size=(1500, 6)), 2)
    x[:, 5], x[:, 4] = 1.0, x[:, 4] > 0
    y = ((x[:, 0] * x[:, 1] > 0) ^ (g.random(len(x)) < 0.2)).astype(int)
    df = spark.createDataFrame([(i, int(y[i]), [float(v) for v in x[i]]) for i in range(len(x))], "row_id bigint, y int, x array<double>").cache()
    train, val = df.where("row_id % 3 > 0"), df.where("row_id % 3 = 0")
    grid = models.candidates({k: [v] for k, v in params.items()} | vary)
    assert forests._fast(spark, forests.edges_of(train))
    model, scores = forests.fit_small(family, params, models.TREES[family], train, 42), forests.grid_scores(family, grid, models.TREES[family], train, val, 42)
    monkeypatch.setattr(forests, "_fast", lambda *_: False)
    want = forests.fit_small(family, params, models.TREES[family], train, 42)
    assert scores == pytest.approx(forests.grid_scores(family, grid, models.TREES[family], train, val, 42), abs=1e-9) and len(set(scores)) == 4
    assert [(t.feature, t.bin) for t in model.trees] == [(t.feature, t.bin) for t in want.trees] and len(want.trees) in (7, 30)
    assert model.scores(x) == pytest.approx(want.scores(x), abs=1e-9)


@pytest.mark.parametrize("labels", [2, 40])
def test_labellings_of_features_with_missing_values_and_ties(spark, labels):
    g = np.random.default_rng(labels)
    n, x = 70, g.normal(size=(3, 70))
    x[1] = np.round(x[1], 1)
    x[2, :30] = 0.5
    y = np.arange(n) % labels  # of 40, ten stand alone
    has = [g.random(n) < 0.8, np.ones(n, bool), np.ones(n, bool)]
    rows = [(1000 - 7 * i, int(y[i]), f"f{f}", f, float(x[f, i])) for f in range(3) for i in range(n) if has[f][i]]
    got = {(r["feature"], r["round"]): r["mi"] for r in information.permuted_information(spark.createDataFrame(rows, "row_id bigint, y int, feature string, feat_ord int, value double"), 70, 3).collect()}
    assert len(got) == 210
    by_id = np.arange(n)[::-1]
    texts = [f"{1000 - 7 * i}|42|".encode() for i in by_id]
    for f in range(3):
        own = has[f][by_id]
        for r in (0, 9, 63, 64, 69):
            order = neighbours.md5_order(texts, str(r).encode())
            want = dense.ross(x[f][by_id][own], y[by_id][order[own[order]]], 3)
            assert got[f"f{f}", r] == pytest.approx(want, abs=1e-9)


def test_tables_of_more_rows_need_neither_cells_nor_lines(spark, monkeypatch):
    def tall(*_, **__):
        raise AssertionError("set by set, or along the line")

    monkeypatch.setattr(tiles, "_by_cells", tall)
    monkeypatch.setattr(nearest, "line_radius", tall)
    n = 140_000
    v = spark.range(n).select(F.col("id").alias("row_id"), (F.col("id") % 2).cast("int").alias("y"), F.array(F.randn(1), F.round(F.randn(2), 2)).alias("features")).cache()
    rows = v.orderBy("row_id").select("features").collect()
    x = np.array([r[0] for r in rows]).T
    r = balls.radius([x[0], x[1]], 3)
    counts = [a[1] - a[0] for a in (balls.Line(c).ends(c, r) for c in x)]
    got = information.pair_information(v, [(0, 1)]).first()["mi"]
    assert got == pytest.approx(float(neighbours.digamma(n) + neighbours.digamma(3) - sum(neighbours.digamma(c).mean() for c in counts)), abs=1e-8)
    assert information.interaction_ccd(v, [(0, 1)], 3, "npeet_3").count() == information.interactions(v, [(0, 1)]).count() == 1
    long = v.select("row_id", "y", F.lit("a").alias("feature"), F.lit(0).alias("feat_ord"), F.col("features")[1].alias("value"))
    found = {p["round"]: p["mi"] for p in information.permuted_information(long, 2).collect()}
    y, texts = np.arange(n) % 2, [f"{i}|42|".encode() for i in range(n)]
    for i in (0, 1):
        assert found[i] == pytest.approx(neighbours.mi_ross(x[1], y[neighbours.md5_order(texts, str(i).encode())], 3), abs=1e-9)
