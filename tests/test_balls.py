import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests import dense

from cohortica.functions import balls, neighbours
from cohortica.operators import information, tiles


@pytest.mark.parametrize("n", [5, 40, 131, 700])
def test_radius_and_counts_against_all_distances(n, monkeypatch):
    g = np.random.default_rng(n)
    monkeypatch.setattr(balls, "AT_ONCE", 1 << 12)
    for d in (1, 2, 3):
        for kind in range(4):
            x = [g.normal(size=n) for _ in range(d)]
            if kind == 1:
                x = [np.round(c, 1) for c in x]
            if kind == 2:
                x[0][:] = 4.0
            if kind == 3:
                x[0], x[-1][:5] = (x[0] > 0) * 1.0, x[-1][:5] * 1e6
            for k in (1, 3, 70):
                if n <= k:
                    continue
                r = balls.radius(x, k)
                assert np.array_equal(r, dense.kth(dense.distances(*x), k))
                lines = [balls.Line(c) for c in x]
                ends = [line.ends(c, r) for line, c in zip(lines, x, strict=True)]
                assert np.array_equal(ends[0][1] - ends[0][0], dense.held(dense.distances(x[0]), r))
                if d > 1:
                    assert np.array_equal(balls.Plane(*lines[:2]).held(*ends[0], *ends[1]), dense.held(dense.distances(*x[:2]), r))


def test_nine_thousand_rows_need_no_cells(spark, monkeypatch):
    def cells(*_):
        raise AssertionError("set by set through cells")

    monkeypatch.setattr(tiles, "_by_cells", cells)
    v = spark.range(9_000).select(F.col("id").alias("row_id"), F.lit(0).alias("y"), F.array(F.randn(1), F.randn(2), F.round(F.randn(3), 1)).alias("features")).cache()
    x = np.array([r[0] for r in v.select("features").collect()]).T
    got = {(r["f1"], r["f2"]): r["mi"] for r in information.pair_information(v, [(0, 1), (0, 2)]).collect()}
    for a, b in got:
        r = balls.radius([x[a], x[b]], 3)
        some = [balls.held([x[f]], r) for f in (a, b)]
        assert got[a, b] == pytest.approx(dense.psi(9000) + dense.psi(3) - sum(tiles._psi(9000)[m].mean() for m in some), abs=1e-8)
    assert len(got) == 2


def test_labellings_of_a_sorted_feature():
    g = np.random.default_rng(3)
    for n in (8, 50, 300):
        x, y = np.round(g.normal(size=n), 1), np.arange(n) % 2  # tenths: distances that are equal on paper differ as they are computed
        column = neighbours.Column(x, y, 5)
        for _ in range(5):
            z = g.permutation(y)
            assert column.mi(z) == pytest.approx(dense.ross(x, z, 5), abs=1e-9)
    texts = [f"{i}|42|".encode() for i in range(500)]
    want = sorted(range(500), key=lambda i: hashlib.md5(texts[i] + b"7").hexdigest())
    assert neighbours.md5_order(texts, b"7").tolist() == want
    assert neighbours.md5_order([b"a", b"b", b"a"], b"").tolist() == sorted(range(3), key=lambda i: (hashlib.md5([b"a", b"b", b"a"][i]).digest(), i))
