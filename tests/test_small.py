import numpy as np
import pytest
from pyspark.sql import functions as F
from tests import dense

import cohortica
from cohortica.functions import colors, synthetic
from cohortica.operators import information, order, stats
from cohortica.plans import cli
from cohortica.sources import tables


def test_metric_estimates_against_truths(spark):
    t = synthetic.truths()
    g = np.random.default_rng(4)
    n = 1500
    y = g.integers(0, 2, n)
    a = g.normal(size=n)
    b = np.where((y == 1) == (a > 0), 1, -1) * np.abs(g.normal(size=n))
    c = g.normal(size=n) + 1.5 * y
    x = np.stack([a, b, c], axis=1)
    v = spark.createDataFrame([(i, int(y[i]), [float(z) for z in x[i]]) for i in range(n)], "row_id bigint, y int, features array<double>")
    got = {r["fs"]: (r["h"], r["mi"]) for r in information.decomposed_information(v, [(0,), (2,), (0, 1)]).collect()}
    assert got["0"][0] == pytest.approx(0.5 * np.log(2 * np.pi * np.e), abs=0.1) and abs(got["0"][1]) < 0.06
    assert got["2"][1] == pytest.approx(t["shift 1.5"], abs=0.08) and got["0+1"][1] == pytest.approx(np.log(2), abs=0.12)
    yy = y.astype(float)
    for f, want in ((information.information_given_label, dense.cmi(a, b, yy)), (information.label_information_given, dense.cmi(a, yy, b))):
        r = f(v, [(0, 1)]).first()
        assert (r["f1"], r["f2"]) == (0, 1) and r["mi"] == pytest.approx(want, abs=1e-8)


def test_inputs_and_missing_features(spark, tmp_path):
    for name in ("seen", "unseen"):
        (tmp_path / f"{name}.csv").write_text("ards,seq.1.1,seq.2.2\nTrue,1.0,2.0\nFalse,,NaN\n")
    (tmp_path / "f.csv").write_text("protein\nseq.1.1\nseq.9.9\n")
    paths = [str(tmp_path / f) for f in ("seen.csv", "unseen.csv", "f.csv")]
    with pytest.raises(ValueError, match="seq.9.9"):
        tables.read_inputs(spark, *paths)
    a, b, names = tables.read_inputs(spark, *paths, validate=False)
    assert names == ["seq.1.1", "seq.9.9"] and a.count() == b.count() == 2
    assert [tuple(r) for r in tables.info(a).orderBy("at").collect()] == [(0, "ards", "boolean", 2, 2), (1, "seq.1.1", "double", 2, 1), (2, "seq.2.2", "double", 2, 1)]


def test_histogram_of_the_data_s_range(spark):
    d = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 5.0), ("b", None), ("b", float("nan"))], "lo string, v double")
    assert sorted(tuple(r)[:3] for r in stats.histogram(d, "v", None, None, 4, "lo").collect()) == [("a", 0, 1), ("a", 1, 1), ("b", 3, 1)]
    same = stats.histogram(d.where("v = 5"), "v", None, None, 4).collect()
    assert [tuple(r) for r in same] == [(0, 1, None)]


def test_palettes_and_exports(spark):
    got = spark.createDataFrame([("binary",), ("nothing",), (None,)], "c string").select("c", colors.palette(F.col("c")).alias("p")).collect()
    assert all(r["p"] == colors.get_colors(r["c"]) for r in got)
    assert all(callable(getattr(cohortica, name)) for name in cohortica.__all__)


def test_scratch_tables_go(spark):
    seen = []
    with order.scratch() as keep:
        seen.append(order.written(spark.range(3), "a"))
        with order.scratch() as inner:
            seen += [order.written(spark.range(3), "b"), inner(order.written(spark.range(3), "c"))]
        assert seen[2].count() == 3
        seen.append(keep(order.written(spark.range(3), "d")))
    path = lambda df: spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._written_at)
    there = [path(df).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path(df)) for df in seen]
    assert there == [False, False, False, True]


def test_from_table_to_scores_in_one_command(spark, tmp_path):
    g = np.random.default_rng(2)
    lines = ["ards,seq.1.1,seq.2.2,seq.3.3"] + [f"{i % 2 == 0},{g.normal() + 3 * (i % 2 == 0):.4f},{g.normal():.4f},{g.normal():.4f}" for i in range(160)]
    (tmp_path / "d.csv").write_text("\n".join(lines))
    out = str(tmp_path / "out")
    cli.main(["run", "--data-path", str(tmp_path / "d.csv"), "--results-dir", out, "--save-results", "--log-dir", str(tmp_path / "logs"), "--k", "1", "--families", "lr", "--test-size", "0.1"], spark)
    assert tables.read_features(spark, f"{out}/selected_features_k1") == ["seq.1.1"]
    scores = tables.read_csv(spark, f"{out}/classification_results").collect()
    assert sorted(r["split"] for r in scores) == ["test", "val"] and all(r["auc"] > 0.9 for r in scores)
