"""python -m cohortica.plans.cli preprocess | ttest | mi | classify | run: the analyses from and to CSV files."""

from __future__ import annotations

import argparse
import logging
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortica.functions.expressions import quoted, truth
from cohortica.operators import cohorts, information, matrix, models, testing
from cohortica.operators.order import scratch, written
from cohortica.sources import tables

LABEL = "ards"
GRIDS = {"lr": models.LR_GRID, "rf": models.RF_GRID, "gbt": models.GBT_GRID}
log = logging.getLogger("cohortica")


def long_of(df: DataFrame, features: list[str] | None = None, prefix: str = "seq.") -> DataFrame:
    names = features or matrix.features_by_prefix(df.columns, prefix)
    numbered = df if "row_id" in df.columns else tables.with_row_id(df.withColumn("_h", F.xxhash64(*[quoted(c) for c in df.columns])), "_h")
    return matrix.to_long(numbered, names, "row_id", truth(quoted(LABEL)))


def preprocess(spark: SparkSession, a: argparse.Namespace) -> None:
    """Cohort filter and stratified hold-out of a raw table."""
    raw = tables.read_csv(spark, a.raw_path)
    kept = cohorts.cohort(raw, "Sepsis", LABEL, "ards_severity", "ards_mild", "ards_notmild").drop("not_mild")
    kept = tables.with_row_id(kept.withColumn("_h", F.xxhash64(*[quoted(c) for c in kept.columns])), "_h").drop("_h").withColumn("_y", truth(quoted(LABEL)))
    parts = cohorts.stratified(kept, "row_id", "_y", a.test_size, a.random_state).persist()
    plain = parts.drop("row_id", "_y", "part")
    tables.write_csv(plain, f"{a.processed_dir}/filtered_data")
    for part in ("seen", "unseen"):
        tables.write_csv(parts.where(F.col("part") == part).drop("row_id", "_y", "part"), f"{a.processed_dir}/{part}")
    tables.write_report(cohorts.split_report(parts, "_y", a.test_size, a.random_state), f"{a.processed_dir}/split_info")


def _save(results: DataFrame, a: argparse.Namespace, name: str, order) -> None:
    results = results.persist()
    log.info("%d of %d features under alpha", results.where(F.col("adj_p") < a.alpha).count(), results.count())
    results.show(20, False)
    if a.save_results:
        tables.write_csv(order(results).coalesce(1), f"{a.results_dir}/{name}")
        tables.write_csv(order(results).limit(a.k).select(F.col("feature").alias("protein")).coalesce(1), f"{a.results_dir}/selected_features_k{a.k}")


def ttest(spark: SparkSession, a: argparse.Namespace) -> None:
    """Welch tests, correction, annotation and the feature list."""
    results = testing.correct(testing.welch(long_of(tables.read_csv(spark, a.data_path))), a.correction_method, tie=("feat_ord",)).persist()
    points = testing.volcano(testing.annotate(results, tables.read_annotation(spark, a.annot_path)), a.alpha)
    testing.top_hits(points).show(20, False)
    _save(results, a, "results_ttest", testing.ttest_order)
    if a.save_results:
        tables.write_csv(points, f"{a.results_dir}/volcano")


def mi(spark: SparkSession, a: argparse.Namespace) -> None:
    """Mutual information with a permutation test."""
    x = matrix.impute(long_of(tables.read_csv(spark, a.data_path))).persist()
    observed = information.mutual_information(x, a.n_neighbors).persist()
    p = testing.permutation_p(observed.select("feature", "mi"), information.permuted_information(x, a.n_perm, a.n_neighbors, a.random_state), a.n_perm)
    results = testing.correct(p.join(observed.select("feature", "feat_ord"), "feature"), a.correction_method, p="p_perm", tie=("feat_ord",))
    _save(results, a, "results_mi_uni_test", testing.information_order)


def classify(spark: SparkSession, a: argparse.Namespace) -> None:
    """The three model families on a feature list."""
    seen, unseen, names = tables.read_inputs(spark, a.data_path, a.unseen_path, a.features_path)
    seen = tables.with_row_id(seen.withColumn("_h", F.xxhash64(*[quoted(c) for c in seen.columns])), "_h").withColumn("_y", truth(quoted(LABEL)))
    parts = cohorts.balanced(seen, "row_id", "_y", a.val_frac, a.random_state)
    train, val = (long_of(parts.where(F.col("part") == p), names) for p in ("train", "val"))
    out = models.train_and_evaluate(train, val, long_of(unseen, names), {f: g for f, g in GRIDS.items() if f in a.families}, a.random_state)
    out.show(10, False)
    if a.save_results:
        tables.write_csv(out.coalesce(1), f"{a.results_dir}/classification_results")


def run(spark: SparkSession, a: argparse.Namespace) -> None:
    """From a filtered table to scores: hold-out, validation, feature selection on the training rows alone, annotation, the three families."""
    data = tables.read_csv(spark, a.data_path)
    tables.info(data).orderBy("at").show(20, False)
    data = tables.with_row_id(data.withColumn("_h", F.xxhash64(*[quoted(c) for c in data.columns])), "_h").drop("_h").withColumn("_y", truth(quoted(LABEL)))
    held = cohorts.stratified(data, "row_id", "_y", a.test_size, a.random_state)
    seen, test = written(held.where("part = 'seen'").drop("part"), "seen"), written(held.where("part = 'unseen'").drop("part"), "unseen")
    parts = written(cohorts.balanced(seen, "row_id", "_y", a.val_frac, a.random_state), "parts")
    results = written(testing.correct(testing.welch(long_of(parts.where("part = 'train'"))), a.correction_method, tie=("feat_ord",)), "results")
    points = testing.volcano(testing.annotate(results, tables.read_annotation(spark, a.annot_path)), a.alpha)
    testing.top_hits(points).show(20, False)
    _save(results, a, "results_ttest", testing.ttest_order)
    names = [r["protein"] for r in testing.top_features(results, a.k).collect()]  # k names
    train, val = (long_of(parts.where(F.col("part") == p), names) for p in ("train", "val"))
    out = models.train_and_evaluate(train, val, long_of(test, names), {f: g for f, g in GRIDS.items() if f in a.families}, a.random_state)
    out.show(10, False)
    if a.save_results:
        tables.write_csv(points, f"{a.results_dir}/volcano")
        tables.write_csv(out.coalesce(1), f"{a.results_dir}/classification_results")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    one = sub.add_parser("preprocess")
    one.add_argument("--raw-path", required=True)
    one.add_argument("--processed-dir", required=True)
    one.add_argument("--test-size", type=float, default=0.20)
    one.add_argument("--random-state", type=int, default=42)
    one.add_argument("--log-dir", default="logs")
    one.add_argument("--log-subdir", default="")
    for name in ("ttest", "mi", "classify", "run"):
        c = sub.add_parser(name)
        c.add_argument("--data-path", required=True)
        c.add_argument("--results-dir", default="results")
        c.add_argument("--results-subdir", default="")
        c.add_argument("--save-results", action="store_true")
        c.add_argument("--random-state", type=int, default=42)
        c.add_argument("--log-dir", default="logs")
        c.add_argument("--log-subdir", default="")
        if name in ("classify", "run"):
            c.add_argument("--val-frac", type=float, default=0.20)
            c.add_argument("--families", nargs="+", choices=list(GRIDS), default=list(GRIDS))
        if name == "run":
            c.add_argument("--test-size", type=float, default=0.05)
        if name == "classify":
            c.add_argument("--unseen-path", required=True)
            c.add_argument("--features-path", required=True)
        else:
            c.add_argument("--correction-method", choices=["fdr", "bonferroni"], default="fdr")
            c.add_argument("--alpha", type=float, default=0.05)
            c.add_argument("--k", type=int, default=10)
        if name in ("ttest", "run"):
            c.add_argument("--annot-path")
        if name == "mi":
            c.add_argument("--n-perm", type=int, default=1000)
            c.add_argument("--n-neighbors", type=int, default=3)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    if getattr(a, "results_subdir", ""):
        a.results_dir = f"{a.results_dir}/{a.results_subdir}"
    folder = Path(a.log_dir, a.log_subdir)  # the driver's own log
    folder.mkdir(parents=True, exist_ok=True)
    logging.basicConfig(level=logging.INFO)
    file = logging.FileHandler(folder / f"{a.command}.log")
    file.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
    log.addHandler(file)
    try:
        with scratch():
            {"preprocess": preprocess, "ttest": ttest, "mi": mi, "classify": classify, "run": run}[a.command](spark or SparkSession.builder.appName("cohortica").getOrCreate(), a)
    finally:
        log.removeHandler(file)
        file.close()


if __name__ == "__main__":
    main()
