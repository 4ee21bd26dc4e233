import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests import dense

from cohortica.functions import colors, neighbours, synthetic
from cohortica.functions.expressions import label_or, not_mild, probe_id, t_tail
from cohortica.operators import cohorts, information, matrix, metrics, stats, testing
from cohortica.plans import cli, queries
from cohortica.sources import tables


def long_of(spark, rows):
    return spark.createDataFrame([(i, y, f"seq.{j}.1", j, v) for i, (y, vs) in enumerate(rows) for j, v in enumerate(vs)], "row_id bigint, y int, feature string, feat_ord int, value double")


def test_votes(spark):
    rows = [("mild", None, None, False), (" MILD\t", None, None, False), ("severe", None, None, True), (None, True, None, False), (None, False, None, True), (None, None, True, True), ("severe", True, None, None), ("moderate", False, True, True), (None, None, None, None)]
    d = spark.createDataFrame(rows, "s string, m boolean, n boolean, want boolean")
    assert d.where(~not_mild(F.col("s"), F.col("m"), F.col("n")).eqNullSafe(F.col("want"))).count() == 0


def test_probe_ids_and_labels(spark):
    rows = [("seq.1234.56", "1234-56"), ("seq1234.56", "1234-56"), ("seq.1234.56.3", "1234-56.3"), ("seq.1.2_3.4", "1-2_3-4"), ("age", "age")]
    assert all(r[1] == r[2] for r in spark.createDataFrame(rows, "a string, b string").select("a", "b", probe_id(F.col("a"))).collect())
    out = spark.createDataFrame([("x", "p"), (" ", "p"), ("nan", "p"), (None, "p")], "s string, p string").select(label_or(F.col("s"), F.col("p"))).collect()
    assert [r[0] for r in out] == ["x", "p", "p", "p"]


def test_welch(spark):
    rows = [(1, [v, 1.0, 5.0]) for v in (1.0, 2.0, 3.0, 4.0)] + [(0, [v, 1.0, None if v > 2 else 7.0]) for v in (2.0, 4.0, 6.0, 8.0, 10.0)]
    out = {r["feature"]: r for r in testing.welch(long_of(spark, rows)).collect()}
    r = out["seq.0.1"]
    assert (r["n_pos"], r["n_neg"]) == (4, 5)
    assert [r["mean_diff"], r["t"], r["df"], r["pval"]] == pytest.approx([-3.5, -2.251436323, 5.520787746, 0.069133593], abs=1e-8)
    assert set(out) == {"seq.0.1"}  # equal constants have no p, one value in a group no test


def test_t_tail():
    assert t_tail(np.array([2.0, 2.0, 2.0, 0.0, np.inf]), np.array([1.0, 2.0, 10.0, 5.0, 5.0])) == pytest.approx([1 - 2 / math.pi * math.atan(2), 1 - 2 / math.sqrt(6), 0.0733880348, 1.0, 0.0], abs=1e-9)


def test_t_tail_far_out():
    # by integration of the density with 50 digits: 1 - integral would lose all of these
    t, df = np.array([7.915147526410022, 6.662803653649559, 5.516187743110638]), np.array([48241.90057348251, 48241.570570780474, 48151.59290881554])
    assert np.allclose(t_tail(t, df), [2.5219269671e-15, 2.7153220051e-11, 3.4820936168e-08], rtol=1e-7, atol=0)


def test_corrections(spark):
    d = spark.createDataFrame([(f"f{i}", i, p) for i, p in enumerate([0.01, 0.04, 0.03, 0.5, 0.04])], "feature string, feat_ord int, pval double")
    fdr = testing.correct(d, "fdr", tie=("feat_ord",))
    assert [r["adj_p"] for r in fdr.orderBy("feat_ord").collect()] == pytest.approx([0.05, 0.05, 0.05, 0.5, 0.05])
    assert [r["pval"] for r in testing.ttest_order(fdr).collect()] == [0.04, 0.04, 0.03, 0.01, 0.5]
    assert [r["adj_p"] for r in testing.correct(d, "bonferroni").orderBy("feat_ord").collect()] == pytest.approx([0.05, 0.2, 0.15, 1, 0.2])
    with pytest.raises(ValueError):
        testing.correct(d, "none")


def test_metrics(spark):
    d = spark.createDataFrame(list(zip([0, 0, 1, 1, 1], [0.1, 0.4, 0.4, 0.8, 0.35])), "label int, score double")
    assert metrics.auc(d).first()[0] == pytest.approx(0.75)
    assert metrics.auc(d.where("label = 1")).first()[0] is None
    assert metrics.auc(d.limit(0)).first()[0] is None


def test_splits(spark):
    def made(n, pos):
        return spark.createDataFrame([(i, int(i < pos)) for i in range(n)], "row_id bigint, y int")

    held = cohorts.stratified(made(50, 10), "row_id", "y")
    assert held.where("part = 'unseen'").count() == 10 and held.where("part = 'unseen' and y = 1").count() == 2 and held.count() == 50
    for n, pos, each in ((100, 30, 10), (100, 4, 4)):
        b = cohorts.balanced(made(n, pos), "row_id", "y")
        assert sorted((r["y"], r["count"]) for r in b.where("part = 'val'").groupBy("y").count().collect()) == [(0, each), (1, each)]
        assert b.count() == n
    parts = cohorts.split_by_label(spark.createDataFrame([(1, True), (2, False), (3, None)], "i int, ards boolean"), "ards")
    assert parts.pos.count() == parts.neg.count() == 1


def test_statistics(spark):
    d = spark.createDataFrame([(v,) for v in (1.0, 2.0, 3.0, 4.0, 10.0, None)], "value double")
    r = stats.describe(d).first()
    assert [r["p25"], r["p50"], r["p75"], r["p90"], r["p99"], r["std"]] == pytest.approx([2, 3, 4, 7.6, 9.76, 3.535533906])
    x = long_of(spark, [(1, [1.0, 5.0, None]), (0, [2.0, 5.0, None]), (1, [3.0, 5.0, None]), (0, [None, 5.0, None])])
    assert {r["feature"]: r["value"] for r in matrix.impute(x).where("row_id = 3").collect()} == {"seq.0.1": 2.0, "seq.1.1": 5.0, "seq.2.1": None}
    c = {(r["f1"], r["f2"]): r["r"] for r in stats.correlations(matrix.impute(x.where("feat_ord < 2"))).collect()}
    assert c["seq.0.1", "seq.0.1"] == pytest.approx(1) and c["seq.0.1", "seq.1.1"] is None
    with pytest.raises(AssertionError):
        matrix.features_by_prefix(["a"], "seq.")


def test_leaf_order_by_brute_force(spark):
    r = {(0, 1): 0.9, (0, 2): 0.1, (0, 3): 0.2, (1, 2): 0.0, (1, 3): 0.3, (2, 3): 0.8}
    d = spark.createDataFrame([(f"seq.{a}.{a}", f"seq.{b}.{b}", v) for (a, b), v in r.items()], "f1 string, f2 string, r double")
    assert [r["f"] for r in stats.leaf_order(d).orderBy("i").collect()] == [f"seq.{i}.{i}" for i in range(4)]
    assert stats.heatmap(d).count() == 12


def test_estimators_against_dense_versions():
    g = np.random.default_rng(1)
    x = np.round(g.normal(size=120), 1)  # many ties
    for k in (1, 3):
        d = np.abs(x[:, None] - x[None, :])
        r = neighbours.radius(x, k)
        assert (r == np.sort(d, axis=1)[:, k]).all()
        assert (neighbours.within(x, r) == (d <= r[:, None]).sum(axis=1)).all()
        y = g.integers(0, 3, 120)
        assert neighbours.mi_ross(x, y, k) == pytest.approx(dense.ross(x, y, k))
    assert neighbours.digamma(np.array([1, 2, 10])) == pytest.approx([-0.5772156649, 0.4227843351, 2.2517525890])


def test_information_against_truths(spark):
    t = synthetic.truths()
    assert [t["shift 1.5"], t["shift 1"], t["shift 1.5 pair"], t["shift 1.5 interaction"]] == pytest.approx([0.221171, 0.111421, 0.363737, 0.078605], abs=1e-5)
    d = synthetic.paired(spark, 2000).persist()
    names = [f"X{i}" for i in range(1, 11)]
    x = matrix.to_long(d, names, "row_id", F.col("Y"))
    v = d.select("row_id", F.col("Y").alias("y"), F.array(*names).alias("features"))
    for method in ("sklearn", "npeet"):
        mi = {r["feature"]: r["mi"] for r in information.mutual_information(x, 5, method).collect()}
        assert mi["X3"] == pytest.approx(t["shift 1.5"], abs=0.06) and mi["X9"] == pytest.approx(t["shift 1"], abs=0.06) and mi["X5"] < 0.05
    assert information.interaction_ccd(v, [(0, 1)], 5).first()["mi"] == pytest.approx(t["xor interaction"], abs=0.1)
    assert information.joint_information(v, [(0, 1)], 5).first()["mi"] == pytest.approx(t["xor joint"], abs=0.1)
    assert information.interaction(v, (2, 3), 5).first()["ii"] == pytest.approx(t["shift 1.5 interaction"], abs=0.1)
    for bad in (information.joint_information, information.joint_information_cc):
        with pytest.raises(NotImplementedError):
            bad(v, [(0, 1)], method="sklearn")
    with pytest.raises(ValueError):
        information.interaction_ccd(v, [(0, 1)], method="x")
    with pytest.raises(ValueError):
        information.interaction(v, (0,), with_label=False)


def test_errors_shrink_with_n(spark):
    g, t = np.random.default_rng(3), synthetic.truths()["shift 1.5"]
    err = []
    for n in (200, 8000):
        y = g.integers(0, 2, n)
        err.append(np.mean([abs(neighbours.mi_ross(g.normal(size=n) + 1.5 * y, y, 5) - t) for _ in range(5)]))
    assert err[1] < err[0]


def test_permutation(spark):
    x = long_of(spark, [(i % 2, [float(i % 2) + i / 1000, float((i * 37) % 50)]) for i in range(60)])
    obs = information.mutual_information(x)
    out = {r["feature"]: r["p_perm"] for r in testing.permutation_p(obs, information.permuted_information(x, 9), 9).collect()}
    assert out["seq.0.1"] == pytest.approx(0.1)
    none = spark.createDataFrame([("f", 0.0)], "feature string, mi double")
    perm = spark.createDataFrame([("f", b, 0.1 * b) for b in range(9)], "feature string, round int, mi double")
    assert testing.permutation_p(none, perm, 9).first()["p_perm"] == 1.0


def test_files(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("seq.1.2,b,ards\n1.5,NA,True\nNaN,x,False\n,,\n")
    d = tables.read_csv(spark, str(p))
    assert [tuple(r) for r in d.collect()] == [(1.5, None, True), (None, "x", False), (None, None, None)]
    assert tables.read_annotation(spark, str(tmp_path / "none.csv")).count() == 0
    n = tables.with_row_id(spark.range(100).select((F.col("id") * 7 % 100).alias("v")), "v").collect()
    assert all(r["v"] == r["row_id"] for r in n)
    assert colors.get_colors("sequential") == colors.get_colors("categorical")


def test_command_line(spark, tmp_path):
    g = np.random.default_rng(2)
    lines = ["Sepsis,ards,ards_severity,ards_mild,ards_notmild,seq.1.1,seq.2.2"]
    for i in range(120):
        ards = i % 2 == 0
        lines.append(f"{i % 10 != 0},{ards},{'severe' if ards and i % 4 else 'mild' if ards else ''},,,{g.normal() + 3 * ards:.4f},{g.normal():.4f}")
    (tmp_path / "raw.csv").write_text("\n".join(lines))
    cli.main(["preprocess", "--raw-path", str(tmp_path / "raw.csv"), "--processed-dir", str(tmp_path), "--log-dir", str(tmp_path / "logs")], spark)
    seen = tables.read_csv(spark, str(tmp_path / "seen"))
    assert seen.where("not Sepsis").count() == 0 and seen.count() > 40
    out = str(tmp_path / "out")
    cli.main(["ttest", "--data-path", str(tmp_path / "seen"), "--results-dir", out, "--save-results", "--log-dir", str(tmp_path / "logs"), "--k", "1"], spark)
    assert tables.read_features(spark, f"{out}/selected_features_k1") == ["seq.1.1"]
    cli.main(["mi", "--data-path", str(tmp_path / "seen"), "--results-dir", out, "--save-results", "--log-dir", str(tmp_path / "logs"), "--k", "1", "--n-perm", "9"], spark)
    assert tables.read_csv(spark, f"{out}/results_mi_uni_test").count() == 2


def test_whole_queries_against_brute_force(spark, tmp_path, monkeypatch):
    from itertools import combinations

    r = np.random.default_rng(5)
    n, w = 40, 4
    x = np.round(r.normal(size=(n, w)), 4)
    labels = np.arange(n) % 10
    rows = [(i, [float(v) for v in x[i]], int(labels[i])) for i in range(n)]
    d = str(tmp_path)
    spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").write.parquet(f"{d}/embeddings.parquet")
    y, k = (labels < 5).astype(int), queries.K
    cols = lambda s: [x[:, i] for i in s]

    def got(name, *keys):
        return {tuple(row[c] for c in keys): row[-1] for row in queries.QUERIES[name](spark, d).collect()}

    def same(found, want):
        assert found.keys() == want.keys()
        assert all(abs(found[i] - want[i]) < 1e-5 for i in want)

    pairs = list(combinations(range(w), 2))
    third = [(a, b, c) for a, b in pairs for c in range(w) if c not in (a, b)]
    name = lambda s: ("+".join(map(str, s)),)
    seen = [(np.arange(n) % 17) != j for j in range(w)]
    same(got("mi_cd_ross_all", "feature"), {(f"seq.{j}.{j}",): dense.ross(x[seen[j], j], y[seen[j]], k) for j in range(w)})
    same(got("mi_cd_kl_all", "feature"), {(f"seq.{j}.{j}",): dense.class_entropy([x[:, j]], y, k) for j in range(w)})
    same(got("mi_cc_ksg_all", "f1", "f2"), {p: dense.ksg(cols(p[:1]), cols(p[1:]), k) for p in pairs})
    joint = {p: dense.class_entropy(cols(p), y, k) for r in (1, 2) for p in combinations(range(w), r)}
    same(got("joint_mi_cd_all", "fs"), {name(p): joint[p] for p in pairs})
    same(got("joint_mi_cc_all", "fs"), {name(t): dense.ksg(cols(t[:2]), cols(t[2:]), k) for t in third})
    cmi = {t: dense.cmi(*cols(t), k) for t in third}
    same(got("cmi_all", "fs"), {name(t): cmi[t] for t in third})
    inside = {p: sum((y == c).mean() * dense.ksg([x[y == c, p[0]]], [x[y == c, p[1]]], k) for c in (0, 1)) for p in pairs}
    same(got("ii_ccd_all", "f1", "f2"), {p: dense.ksg(cols(p[:1]), cols(p[1:]), k) - inside[p] for p in pairs})
    marginals = {p: joint[p[:1]] + joint[p[1:]] - joint[p] for p in pairs}
    same(got("ii_ccd_marginals_all", "f1", "f2"), marginals)
    same(got("ii_general_all", "fs"), {name(p): v for p, v in marginals.items()})
    h = {p: dense.entropy(cols(p), k) for r in (1, 2) for p in combinations(range(w), r)}
    same(got("ii_entropies_all", "fs"), {name(p): h[p[:1]] + h[p[1:]] - h[p] for p in pairs})
    same(got("ii_ccc_all", "fs"), {name(t): dense.ksg(cols(t[:1]), cols(t[1:2]), k) - cmi[t] for t in third})
    out = queries.QUERIES["perm_test_all"](spark, d).collect()
    assert queries.ALL_ROUNDS == 1000 and len(out) == w
    for row in out:
        j = int(row["feature"].split(".")[1])
        ids = np.flatnonzero(seen[j])
        at = dense.ross(x[ids, j], y[ids], k)
        orders = (sorted(ids.tolist(), key=lambda i, b=b: (hashlib.md5(f"{i}|42|{b}".encode()).hexdigest(), i)) for b in range(1000))
        exceed = sum(dense.ross(x[ids, j], y[o], k) >= at - 1e-12 for o in orders)
        assert row["mi"] == pytest.approx(at, abs=1e-6) and row["p_perm"] == pytest.approx((exceed + 1) / 1001, abs=2e-6)
    filled = [np.where(seen[j], x[:, j], np.median(x[seen[j], j])) for j in range(w)]
    same(got("corr_pairs_all", "f1", "f2"), {(f"seq.{a}.{a}", f"seq.{b}.{b}"): np.corrcoef(filled[a], filled[b])[0, 1] for a in range(w) for b in range(a, w)})
    assert len(got("corr_diff_all", "f1", "f2")) == w * (w + 1) // 2
    grids = []
    monkeypatch.setattr(queries, "_parts", lambda spark, d: ())
    monkeypatch.setattr(queries.models, "train_and_evaluate", grids.append)
    for q in ("rf_grid", "gbt_grid"):
        queries.QUERIES[q](spark, d)
    assert grids == [{"rf": queries.models.RF_GRID}, {"gbt": queries.models.GBT_GRID}]


def test_percentiles_and_running_sums(spark):
    import numpy as np

    from cohortica.operators import order

    r = np.random.default_rng(4)
    rows = [(g, None if r.random() < 0.1 else float(r.integers(0, 9))) for g in ("a", "b", None) for _ in range(200)] + [("c", 1.5), ("d", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {x["g"]: tuple(x)[1:] for x in order.percentiles(df, ["g"], "v", (0.25, 0.5, 0.9)).collect()}
    for g in ("a", "b", None, "c"):
        v = [x for h, x in rows if h == g and x is not None]
        assert got[g][0] == len(v) and np.allclose(got[g][1:], np.percentile(v, [25, 50, 90]))
    assert "d" not in got
    one = order.percentiles(df, [], "v", (0.5,)).first()
    assert one["p0"] == np.median([x for _, x in rows if x is not None])
    assert order.percentiles(df.limit(0), [], "v", (0.5,)).collect() in ([], [(None, None)])
    ids = spark.createDataFrame([(i, "x" if i % 3 else None, "y") for i in range(100)], "id bigint, g string, Range string")
    placed = order.running(ids, ["g"], ["id"], place=F.lit(1)).collect()
    assert {(x["id"], x["place"], x["Range"]) for x in placed} == {(i, (i // 3 if i % 3 == 0 else i - i // 3 - 1), "y") for i in range(100)}


def test_splits_keep_columns_of_any_name(spark):
    from cohortica.operators import cohorts

    df = spark.createDataFrame([(i, i % 4 == 0, "h", "p", "q") for i in range(40)], "id bigint, y boolean, hash string, place string, quota string").withColumn("y", F.col("y").cast("int"))
    for made in (cohorts.stratified(df, "id", "y"), cohorts.balanced(df, "id", "y")):
        rows = made.collect()
        assert len(rows) == 40 and all((x["hash"], x["place"], x["quota"]) == ("h", "p", "q") for x in rows)
    assert cohorts.stratified(df, "id", "y").where("part = 'unseen'").groupBy("y").count().orderBy("y").collect() == [(0, 6), (1, 2)]
    assert cohorts.sample_per_group(df, "id", "y", 3).columns == df.columns


def test_information_from_marginals_and_within_classes(spark):
    r = np.random.default_rng(3)
    rows = [(i, int(a * b > 0), [float(a), float(b), float(c)]) for i, (a, b, c) in enumerate(r.normal(size=(300, 3)))]
    vectors = spark.createDataFrame(rows, "row_id bigint, y int, features array<double>").cache()
    pairs = [(0, 1), (0, 2)]
    single = information.joint_information(vectors, [(0,), (1,), (2,)]).selectExpr("int(fs) f", "mi")
    got = {(x["f1"], x["f2"]): x["mi"] for x in information.by_marginals(single, information.joint_information(vectors, pairs)).collect()}
    want = {(x["f1"], x["f2"]): x["mi"] for x in information.interaction_ccd(vectors, pairs, method="npeet_3").collect()}
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 for p in want)
    inside = {(x["f1"], x["f2"]): x["mi"] for x in information.class_conditional_information(vectors, pairs).collect()}
    plain = {(x["f1"], x["f2"]): x["mi"] for x in information.pair_information(vectors, pairs, method="metric").collect()}
    ii = {(x["f1"], x["f2"]): x["mi"] for x in information.interaction_ccd(vectors, pairs).collect()}
    assert all(abs(plain[p] - inside[p] - ii[p]) < 1e-9 for p in pairs) and inside[0, 1] > 0.4
    with pytest.raises(ValueError):
        information.joint_information_cc(vectors, pairs, method="other")
    vectors.unpersist()


def test_samples_ranks_truths_and_index(spark, tmp_path):
    names = [f"seq.{i}.1" for i in range(40)]
    some = matrix.sample_features(names, 10)
    assert len(set(some)) == 10 and set(some) < set(names) and some != matrix.sample_features(names, 10, seed=1) and matrix.sample_features(names, 99) != names
    assert matrix.feature_pairs(names) == [(names[0], names[j]) for j in range(1, 16)]
    long = long_of(spark, [(i % 2, [float(i % 2), 5.0 * (i % 2), 1.0]) for i in range(10)])
    assert [tuple(x) for x in stats.ranked_difference(long, 2).collect()] == [(1, "seq.1.1", 5.0), (2, "seq.0.1", 1.0)]
    a, b = synthetic.xor_nuisance_truths(), synthetic.paired_truths()
    assert (len(a), len(b)) == (13, 18)
    assert a["I(X3;X4)"] == pytest.approx(1.163951, abs=1e-5) and b["I(X9,X10;Y)"] == pytest.approx(0.201345, abs=1e-4) and b["II(X3;X4;Y)"] == pytest.approx(0.078605, abs=1e-4)
    (tmp_path / "i.csv").write_text(",a\nr1,1\nr2,2\n")
    assert [tuple(x) for x in tables.read_csv(spark, str(tmp_path / "i.csv"), index="name").collect()] == [("r1", 1), ("r2", 2)]
