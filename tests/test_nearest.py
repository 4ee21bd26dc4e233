import hashlib
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests import dense

from cohortica.functions.expressions import spare_double
from cohortica.operators import information, nearest, tiles


def test_digamma(spark):
    got = [r[0] for r in spark.range(1, 400).select(nearest.digamma(F.col("id"))).collect()]
    assert np.allclose(got, [dense.psi(n) for n in range(1, 400)], atol=1e-13, rtol=0)


def test_intervals_hold_what_the_difference_says():
    g = np.random.default_rng(0)
    x = np.concatenate([g.normal(size=200), g.normal(size=50) * 1e-12, [-1.0, 0.0, 1e300, -1e300, 5e-324]])
    r = np.concatenate([np.abs(g.normal(size=200)), np.full(50, 1.0), [1.0, 0.0, 1e290, 1e-3, 1.0]])
    lo, hi = nearest.interval(x, r)
    least = np.maximum(r, 5e-324)
    assert ((hi - x < least) & (x - lo < least)).all()
    assert ((np.nextafter(hi, np.inf) - x >= least) & (x - np.nextafter(lo, -np.inf) >= least)).all()


def line(seed=1, n=300):
    """Ties, a value that a third of all rows hold, a label with one row, two features and nulls."""
    g = np.random.default_rng(seed)
    x = np.round(g.normal(size=(n, 2)), 1)
    x[g.random(n) < 0.33, 1] = 0.5
    y = g.integers(0, 2, n)
    y[7] = 2
    return [(int(i), int(y[i]), f"f{j}", j, float(x[i, j]) if (i + j) % 11 else None) for i in range(n) for j in range(2)] + [(n, None, "f0", 0, 1.0), (n + 1, 1, "f9", 9, 1.0)]


def test_line_blocks_ties_and_frequent_values(spark, monkeypatch):
    monkeypatch.setattr(nearest, "LINE_ROWS", 16)
    rows = line()
    long = spark.createDataFrame(rows, "row_id bigint, y int, feature string, feat_ord int, value double")
    for k in (1, 3):
        got = {r["feature"]: (r["feat_ord"], r["mi"]) for r in information.mutual_information(long, k).collect()}
        for j in range(2):
            own = [(v, y) for _, y, f, _, v in rows if f == f"f{j}" and v is not None and y is not None]
            assert got[f"f{j}"] == (j, pytest.approx(dense.ross(np.array([v for v, _ in own]), np.array([y for _, y in own]), k), abs=1e-9))
        assert got["f9"] == (9, 0.0)
    assert information.mutual_information(long.limit(0)).count() == 0
    jit = {r[0]: r[1] for r in long.select("row_id", spare_double("row_id")).collect()}
    got = {r["feature"]: r["mi"] for r in information.mutual_information(long, 3, "npeet").collect()}
    own = [(v + 1e-10 * jit[i], y) for i, y, f, _, v in rows if f == "f0" and v is not None and y is not None]
    assert got["f0"] == pytest.approx(dense.class_entropy([np.array([v for v, _ in own])], np.array([y for _, y in own])), abs=1e-6)
    assert got["f9"] is None


def test_a_hundred_thousand_equal_values(spark):
    long = spark.range(100_000).select(F.col("id").alias("row_id"), (F.col("id") % 2).cast("int").alias("y"), F.lit("f").alias("feature"), F.lit(0).alias("feat_ord"), F.lit(1.0).alias("value"))
    assert information.mutual_information(long).first()["mi"] == 0.0


def table(seed=2, n=260, w=10):
    """Normal, tied, constant, two-valued and far-off columns; row 3 lacks a value."""
    g = np.random.default_rng(seed)
    x = np.round(g.normal(size=(n, w)), 3)
    x[:, 1] = np.round(x[:, 1], 0)
    x[:, 2] = 4.0
    x[:, 3] = x[:, 3] > 0
    x[:5, 4] *= 1e6
    x[:, 9] = x[:, 0] + np.round(g.normal(size=n) * 0.1, 3)
    y = (x[:, 0] + g.normal(size=n) > 0).astype(int)
    y[11] = 5
    return x, y


def frame(spark, x, y):
    rows = [(i, int(y[i]), [float(v) for v in x[i]]) for i in range(len(x))] + [(-1, 1, [None] * x.shape[1]), (-2, 0, [float("nan")] * x.shape[1])]
    return spark.createDataFrame(rows, "row_id bigint, y int, features array<double>").repartition(3)


@pytest.mark.parametrize("way", ["tiles", "cells"])
def test_sets_of_features_against_all_distances(spark, monkeypatch, way):
    x, y = table()
    if way == "tiles":
        monkeypatch.setattr(tiles, "TILE", 4)
        monkeypatch.setattr(tiles, "_PLANE", 1 << 12)
        monkeypatch.setattr(tiles, "SETS", 7)
        pairs = list(combinations(range(10), 2))
        triples = [(0, 1, 2), (0, 9, 5), (9, 4, 0), (5, 6, 7), (1, 3, 2), (3, 4, 8)]
    else:
        monkeypatch.setattr(tiles, "TILE_ROWS", 0)
        monkeypatch.setattr(nearest, "CELL_ROWS", 20)
        monkeypatch.setattr(nearest, "VISITORS", 16)
        monkeypatch.setattr(nearest, "LINE_ROWS", 16)
        x, y = x[:120], y[:120]
        pairs = [(0, 9), (2, 3), (4, 1)]
        triples = [(0, 9, 5), (1, 3, 2)]
    v = frame(spark, x, y)
    c = lambda *s: [x[:, i] for i in s]

    def same(df, want):
        got = {tuple(r)[:-1]: tuple(r)[-1] for r in df.collect()}
        assert got.keys() == want.keys()
        for s, m in want.items():
            assert got[s] == pytest.approx(m, abs=1e-8), s

    same(information.pair_information(v, pairs), {p: dense.ksg(c(p[0]), c(p[1])) for p in pairs})
    z = np.random.default_rng(8).normal(size=(150, 4)) * [1, 50, 1e-3, 0]  # scaled ties would hang on the last bit of the deviation
    want = {p: dense.ksg([z[:, p[0]]], [z[:, p[1]]], 2, scale=True) for p in [(0, 1), (1, 2), (2, 3)]}
    same(information.pair_information(frame(spark, z, np.arange(150) % 2), list(want), 2, "sklearn"), want)
    name = lambda t: ("+".join(map(str, t)),)
    inner = {p: sum((y == g).mean() * dense.ksg([x[y == g, p[0]]], [x[y == g, p[1]]]) for g in (0, 1)) for p in pairs}
    same(information.class_conditional_information(v, pairs), inner)
    same(information.joint_information_cc(v, triples), {name(t): dense.ksg(c(*t[:2]), c(t[2])) for t in triples})
    cmi = {t: dense.cmi(*c(*t)) for t in triples}
    same(information.conditional_information(v, triples), {name(t): m for t, m in cmi.items()})
    jit = {r[0]: r[1] for r in v.select("row_id", spare_double("row_id")).collect()}
    moved = x + 1e-10 * np.array([jit[i] for i in range(len(x))])[:, None]
    sets = [(2,), (0, 1), (0, 4, 9)]
    m = lambda s: [moved[:, i] for i in s]
    assert all(r["mi"] == pytest.approx(dense.class_entropy(m([int(i) for i in r["fs"].split("+")]), y), abs=1e-5) for r in information.joint_information(v, sets).collect())
    if way == "cells":  # the rest is arithmetic on the same sums
        return
    assert all(r["mi"] == pytest.approx(dense.entropy(m([int(i) for i in r["fs"].split("+")])), abs=1e-5) for r in information.entropies(v, sets).collect())
    same(information.interaction_ccd(v, pairs), {p: dense.ksg(c(p[0]), c(p[1])) - inner[p] for p in pairs})
    same(information.interaction_ccd(v, pairs, method="npeet_2"), {p: dense.ksg(c(p[0]), c(p[1])) - dense.cmi(*c(*p), y.astype(float)) for p in pairs})
    same(information.interaction_ccc(v, triples), {name(t): dense.ksg(c(t[0]), c(t[1])) - cmi[t] for t in triples})
    same(information.interaction_ccc(v, triples, method="npeet_2"), {name(t): dense.ksg(c(t[0]), c(t[2])) + dense.ksg(c(t[1]), c(t[2])) - dense.ksg(c(*t[:2]), c(t[2])) for t in triples})


def test_few_rows_and_no_rows(spark, monkeypatch):
    for rows in (tiles.TILE_ROWS, 0):
        monkeypatch.setattr(tiles, "TILE_ROWS", rows)
        v = frame(spark, np.arange(6.0).reshape(3, 2), np.array([0, 1, 1]))
        assert [tuple(r) for r in information.pair_information(v, [(0, 1)]).collect()] == [(0, 1, None)]
        assert information.pair_information(v.limit(0), [(0, 1)]).count() == 0


def test_tall_tables_need_no_larger_task(spark, monkeypatch):
    monkeypatch.setattr(tiles, "TILE_ROWS", 0)
    seen = []
    for n in (2_000, 20_000):
        g = spark.range(n).select(F.col("id").alias("row_id"), F.lit(0).alias("y"), F.array(F.randn(1), F.randn(2)).alias("features")).cache()
        points = g.select(F.lit(0).alias("job"), F.col("row_id").alias("key"), F.col("features").alias("x"))
        celled = nearest.cells(points, ["job"], 2, "key").groupBy("cell").count().agg(F.max("count"), F.count(F.lit(1))).first()
        assert celled[0] <= nearest.CELL_ROWS
        seen.append(celled[1])
        if n == 20_000:
            x = np.array([r[0] for r in g.orderBy("row_id").select("features").collect()])
            got = {r["key"]: r["radius"] for r in nearest.cell_radius(points, ["job"], 2, 3).collect()}
            some = np.arange(0, n, 97)
            want = [np.sort(np.abs(x - x[i]).max(axis=1))[3] for i in some]
            assert len(got) == n and np.array_equal([got[i] for i in some], want)
    assert seen[1] > 4 * seen[0]


def test_permutations_along_the_line_are_those_of_the_tables(spark, monkeypatch):
    rows = line(4, 60)
    long = spark.createDataFrame(rows, "row_id bigint, y int, feature string, feat_ord int, value double")
    by_table = {(r["feature"], r["round"]): r["mi"] for r in information.permuted_information(long, 3).collect()}
    monkeypatch.setattr(information, "PERMUTED_ROWS", 0)
    by_line = {(r["feature"], r["round"]): r["mi"] for r in information.permuted_information(long, 3).collect()}
    own = sorted((i, y, v) for i, y, f, _, v in rows if f == "f1" and v is not None and y is not None)
    for b in range(3):
        order = sorted(own, key=lambda t: (hashlib.md5(f"{t[0]}|42|{b}".encode()).hexdigest(), t[0]))
        want = dense.ross(np.array([v for _, _, v in own]), np.array([y for _, y, _ in order]))
        assert by_table["f1", b] == pytest.approx(want, abs=1e-9) and by_line["f1", b] == pytest.approx(want, abs=1e-9)
    assert {x: v for x, v in by_table.items() if x[0] != "f9"}.keys() == by_line.keys()
