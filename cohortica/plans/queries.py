"""The registered queries, each with the SQL that gives the same rows.

``embeddings`` stands for the table of samples: row_id = vec_id, label
y = (label < 5), features the 64 places of the vector, with values missing
where vec_id and place agree modulo 17.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortica.functions.colors import palette
from cohortica.functions.expressions import label_or, numeric, probe_id, safe_ratio, text_or_blank, truth, zero_if_missing
from cohortica.operators import cohorts, information, matrix, metrics, models, stats, testing
from cohortica.operators.order import written
from cohortica.sources.tables import info, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLE[key] = sql
        return f

    return add


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.select(*[(F.round(c, places) if c in columns else F.col(c)).alias(c) for c in df.columns])


# -- the sample table -------------------------------------------------------

LONG = """long AS (
  SELECT row_id, y, pos, 'seq.' || pos || '.' || pos AS feature,
         CASE WHEN row_id % 17 = pos % 17 THEN NULL ELSE CAST(v AS DOUBLE) END AS value
  FROM (SELECT vec_id AS row_id, CASE WHEN label < 5 THEN 1 ELSE 0 END AS y,
               generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding) AS v FROM embeddings))"""
SAMPLES = "samples AS (SELECT vec_id AS row_id, CASE WHEN label < 5 THEN 1 ELSE 0 END AS y FROM embeddings)"


def long_matrix(spark: SparkSession, d: str, dims: int | None = None, missing: bool = True) -> DataFrame:
    e = table(spark, d, "embeddings")
    if dims is not None:
        e = e.withColumn("embedding", F.slice("embedding", 1, dims))
    out = matrix.vectors_to_long(e, "embedding", "vec_id", F.col("label") < 5)
    if missing:
        out = out.withColumn("value", F.when(F.col("row_id") % 17 != F.col("feat_ord") % 17, F.col("value")))
    return out


def samples(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), (F.col("label") < 5).cast("int").alias("y"))


def vectors(spark: SparkSession, d: str, dims: int = 4) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("row_id"), (F.col("label") < 5).cast("int").alias("y"), F.slice("embedding", 1, dims).cast("array<double>").alias("features"))


# -- tests and corrections --------------------------------------------------

WELCH = f"""{LONG}, agg AS (
  SELECT feature, pos, count(value) FILTER (y = 1) AS n1, count(value) FILTER (y = 0) AS n0,
         avg(value) FILTER (y = 1) AS m1, avg(value) FILTER (y = 0) AS m0,
         var_samp(value) FILTER (y = 1) AS v1, var_samp(value) FILTER (y = 0) AS v0
  FROM long GROUP BY 1, 2),
welch AS (
  SELECT feature, pos, n1 AS n_pos, n0 AS n_neg, m1 - m0 AS mean_diff, (m1 - m0) / sqrt(v1 / n1 + v0 / n0) AS t,
         pow(v1 / n1 + v0 / n0, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v0 / n0, 2) / (n0 - 1)) AS df
  FROM agg WHERE n1 >= 2 AND n0 >= 2)"""
# p by Simpson's rule over the angle atan(t / sqrt(df))
PVALUE = f"""{WELCH}, angle AS (SELECT *, atan(abs(t) / sqrt(df)) AS th FROM welch),
tested AS (
  SELECT feature, pos, mean_diff, greatest(0, 1 - 2 * exp(lgamma((df + 1) / 2) - lgamma(df / 2) - lgamma(0.5)) * th / 1200 *
    list_sum(list_transform(range(0, 401), lambda i: (CASE WHEN i = 0 OR i = 400 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * pow(cos(th * i / 400.0), df - 1)))) AS pval
  FROM angle),
ranked AS (SELECT *, row_number() OVER (ORDER BY pval, pos) AS r, count(*) OVER () AS m FROM tested),
adjusted AS (SELECT *, least(1.0, min(pval * m / r) OVER (ORDER BY r DESC ROWS UNBOUNDED PRECEDING)) AS adj_p FROM ranked)"""


@query(f"WITH {WELCH} SELECT feature, n_pos, n_neg, round(mean_diff, 6) AS mean_diff, round(t, 6) AS t, round(df, 6) AS df FROM welch")
def welch_stats(spark, d):
    return rounded(testing.welch_stats(long_matrix(spark, d)).drop("feat_ord"), "mean_diff", "t", "df")


def tested(spark, d):
    return testing.correct(testing.welch(long_matrix(spark, d)), "fdr", tie=("feat_ord",))


@query(f"WITH {PVALUE} SELECT feature, round(mean_diff, 6) AS mean_diff, round(pval, 6) AS pval, round(adj_p, 6) AS adj_p FROM adjusted ORDER BY adj_p, adjusted.pval DESC, pos LIMIT 10")
def welch_pvalue_bh_topk(spark, d):
    top = testing.ttest_order(tested(spark, d)).limit(10)
    return rounded(top.select("feature", "mean_diff", "pval", "adj_p"), "mean_diff", "pval", "adj_p")


@query(f"WITH {PVALUE} SELECT feature AS protein FROM adjusted ORDER BY adj_p, pval DESC, pos LIMIT 10")
def feature_list(spark, d):
    return testing.top_features(tested(spark, d), 10)


@query(f"WITH {PVALUE} SELECT count(*) AS n_tested, count(*) FILTER (adj_p < 0.05) AS n_sig, count(*) FILTER (pval * m < 0.05) AS n_bonferroni FROM adjusted")
def significant_counts(spark, d):
    both = testing.correct(tested(spark, d).withColumnRenamed("adj_p", "fdr"), "bonferroni")
    return both.agg(F.count(F.lit(1)).alias("n_tested"), F.count_if(F.col("fdr") < 0.05).alias("n_sig"), F.count_if(F.col("adj_p") < 0.05).alias("n_bonferroni"))


P_LIKE = "p AS (SELECT p_partkey, p_brand, ((p_partkey * 7919) % 1000 + 1) / 1001.0 AS pval FROM part)"


def p_like(spark, d):
    return table(spark, d, "part").select("p_partkey", "p_brand", ((F.col("p_partkey") * 7919 % 1000 + 1) / 1001.0).alias("pval"))


@query(f"""WITH {P_LIKE}, r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY pval, p_partkey) AS r, count(*) OVER (PARTITION BY p_brand) AS m FROM p)
SELECT p_partkey, p_brand, round(pval, 6) AS pval, round(least(1.0, min(pval * m / r) OVER (PARTITION BY p_brand ORDER BY r DESC ROWS UNBOUNDED PRECEDING)), 6) AS adj_p FROM r""")
def bh_adjust(spark, d):
    return rounded(testing.correct(p_like(spark, d), "fdr", family=("p_brand",), tie=("p_partkey",)), "pval", "adj_p")


@query(f"WITH {P_LIKE} SELECT p_partkey, p_brand, round(pval, 6) AS pval, round(least(1.0, pval * count(*) OVER (PARTITION BY p_brand)), 6) AS adj_p FROM p")
def bonferroni_adjust(spark, d):
    return rounded(testing.correct(p_like(spark, d), "bonferroni", family=("p_brand",)), "pval", "adj_p")


# -- cohorts and splits -----------------------------------------------------

CASES = """o_orderkey, o_custkey,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN '  Mild ' WHEN '2' THEN 'severe' WHEN '3' THEN 'mild' WHEN '4' THEN 'Moderate' END AS severity,
  CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus = 'F' END AS mild,
  CASE WHEN o_orderkey % 5 < 2 THEN o_orderstatus = 'O' END AS notmild,
  CASE WHEN o_custkey % 13 = 0 THEN NULL ELSE o_orderkey % 7 <> 0 END AS sepsis,
  CASE WHEN o_custkey % 11 = 0 THEN NULL ELSE o_custkey % 4 < 2 END AS ards"""
VOTES = f"""cases AS (SELECT {CASES} FROM orders),
votes AS (SELECT *, list_filter([lower(trim(severity)) <> 'mild', NOT mild, notmild], lambda v: v IS NOT NULL) AS v FROM cases),
voted AS (SELECT *, CASE WHEN len(list_distinct(v)) = 1 THEN v[1] END AS not_mild FROM votes),
kept AS (SELECT * FROM voted WHERE sepsis AND (NOT ards OR (ards AND not_mild)))"""


def cases(spark, d):
    return table(spark, d, "orders").selectExpr(*[x.strip() for x in _split(CASES)])


def _split(text: str) -> list[str]:
    out, depth, now = [], 0, ""
    for ch in text:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and not depth:
            out.append(now)
            now = ""
        else:
            now += ch
    return [*out, now]


def kept_cases(spark, d):
    return cohorts.cohort(cases(spark, d), "sepsis", "ards", "severity", "mild", "notmild")


@query(f"WITH {VOTES} SELECT o_orderkey, severity, mild, notmild, not_mild FROM voted")
def cohort_vote(spark, d):
    return cohorts.with_verdict(cases(spark, d), "severity", "mild", "notmild").select("o_orderkey", "severity", "mild", "notmild", "not_mild")


@query(f"WITH {VOTES} SELECT o_orderkey, sepsis, ards, not_mild FROM kept")
def cohort_filter(spark, d):
    return kept_cases(spark, d).select("o_orderkey", "sepsis", "ards", "not_mild")


@query(f"WITH {VOTES} SELECT 'pos' AS part, count(*) AS n FROM kept WHERE ards UNION ALL SELECT 'neg', count(*) FROM kept WHERE NOT ards")
def cohort_split(spark, d):
    parts = cohorts.split_by_label(kept_cases(spark, d), "ards")
    return parts.pos.agg(F.lit("pos").alias("part"), F.count(F.lit(1)).alias("n")).unionByName(parts.neg.agg(F.lit("neg").alias("part"), F.count(F.lit(1)).alias("n")))


@query(f"WITH {VOTES} SELECT count(*) AS n, count(*) FILTER (sepsis IS NULL OR ards IS NULL) AS n_missing, count(*) FILTER (not_mild IS NULL) AS n_undecided FROM voted")
def cohort_losses(spark, d):
    v = cohorts.with_verdict(cases(spark, d), "severity", "mild", "notmild")
    return v.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("sepsis").isNull() | F.col("ards").isNull()).alias("n_missing"), F.count_if(F.col("not_mild").isNull()).alias("n_undecided"))


STRATIFIED = f"""{SAMPLES}, byy AS (SELECT y, count(*) AS n FROM samples GROUP BY 1), tot AS (SELECT *, ceil(sum(n) OVER () * 0.2) AS held, sum(n) OVER () AS total FROM byy),
ex AS (SELECT *, n * held / total AS exact, floor(n * held / total) AS base FROM tot),
quota AS (SELECT y, base + CASE WHEN row_number() OVER (ORDER BY round(exact - base, 9) DESC, y) <= held - sum(base) OVER () THEN 1 ELSE 0 END AS quota FROM ex),
ranked AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5(row_id || '|42'), row_id) AS r FROM samples),
parts AS (SELECT row_id, y, CASE WHEN r <= quota THEN 'unseen' ELSE 'seen' END AS part FROM ranked JOIN quota USING (y))"""


@query(f"WITH {STRATIFIED} SELECT * FROM parts")
def stratified_holdout(spark, d):
    return cohorts.stratified(samples(spark, d), "row_id", "y").select("row_id", "y", "part")


@query(f"""WITH {STRATIFIED} SELECT CAST(0.2 AS DOUBLE) AS test_size, CAST(42 AS INTEGER) AS random_state, count(*) FILTER (part = 'seen') AS n_seen, count(*) FILTER (part = 'unseen') AS n_unseen,
count(*) FILTER (part = 'seen' AND y = 1) AS n_pos_seen, count(*) FILTER (part = 'unseen' AND y = 1) AS n_pos_unseen FROM parts""")
def split_report(spark, d):
    return cohorts.split_report(cohorts.stratified(samples(spark, d), "row_id", "y"), "y", 0.2, 42)


BALANCED = f"""{SAMPLES}, each AS (SELECT least(CAST(round_even(count(*) * 0.2, 0) AS BIGINT) // 2, count(*) FILTER (y = 1), count(*) FILTER (y = 0)) AS k FROM samples),
ranked AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5(row_id || '|42'), row_id) AS r FROM samples),
parts AS (SELECT row_id, y, CASE WHEN r <= k THEN 'val' ELSE 'train' END AS part FROM ranked, each)"""


@query(f"WITH {BALANCED} SELECT * FROM parts")
def balanced_val(spark, d):
    return cohorts.balanced(samples(spark, d), "row_id", "y").select("row_id", "y", "part")


@query(f"WITH {BALANCED} SELECT s.row_id, s.y FROM samples s WHERE s.row_id NOT IN (SELECT row_id FROM parts WHERE part = 'val')")
def train_anti(spark, d):
    s = samples(spark, d)
    return cohorts.rest(s, cohorts.balanced(s, "row_id", "y").where("part = 'val'"), "row_id").select("row_id", "y")


@query(f"WITH {BALANCED} SELECT row_id, y, CAST(CASE part WHEN 'val' THEN 0 ELSE -1 END AS INTEGER) AS fold FROM parts")
def fold_markers(spark, d):
    b = cohorts.balanced(samples(spark, d), "row_id", "y")
    train, val = (b.where(F.col("part") == p).select("row_id", "y", F.lit(f).cast("int").alias("fold")) for p, f in (("train", -1), ("val", 0)))
    return train.unionByName(val)


@query("WITH r AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5(o_orderkey || '|7'), o_orderkey) AS r FROM orders) SELECT o_orderpriority, o_orderkey FROM r WHERE r <= 5")
def sample_per_group(spark, d):
    return cohorts.sample_per_group(table(spark, d, "orders"), "o_orderkey", "o_orderpriority", 5, seed=7).select("o_orderpriority", "o_orderkey")


@query("""SELECT o_custkey, o_orderstatus, count(*) AS n FROM (SELECT o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 3 = 0
INTERSECT ALL SELECT o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 2 = 0) GROUP BY 1, 2""")
def leak_check(spark, d):
    o = table(spark, d, "orders")
    a, b = o.where("o_orderkey % 3 = 0").select("o_custkey", "o_orderstatus"), o.where("o_orderkey % 2 = 0").select("o_orderstatus", "o_custkey")
    return cohorts.leaks(a, b).groupBy("o_custkey", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


# -- names, annotation, volcano ---------------------------------------------

NAMES = "names AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'seq.' WHEN 1 THEN 'seq' WHEN 2 THEN 'age_' ELSE 'seq.1.' END || p_partkey || '.' || p_size || '.3' AS name FROM part)"


@query(f"WITH {NAMES} SELECT name, regexp_replace(regexp_replace(regexp_replace(name, '^seq\\.', ''), '^seq', ''), '([0-9]+)\\.([0-9]+)', '\\1-\\2', 'g') AS probe, starts_with(name, 'seq.') AS by_prefix, regexp_matches(name, '^seq') AS by_pattern FROM names")
def probe_ids(spark, d):
    kind = F.element_at(F.array(*map(F.lit, ("seq.", "seq", "age_", "seq.1."))), (F.col("p_partkey") % 4).cast("int") + 1)
    n = table(spark, d, "part").select(F.concat(kind, F.col("p_partkey"), F.lit("."), F.col("p_size"), F.lit(".3")).alias("name"))
    return n.select("name", probe_id(F.col("name")).alias("probe"), F.col("name").startswith("seq.").alias("by_prefix"), F.col("name").rlike("^seq").alias("by_pattern"))


ANNOTATED = """res AS (SELECT l_partkey, 'seq.' || l_partkey || '.1' AS feature, avg(l_quantity) AS mean_diff FROM lineitem GROUP BY 1),
ann AS (SELECT p_partkey || '-1' AS PROBEID, CASE p_partkey % 5 WHEN 0 THEN 'nan' WHEN 1 THEN ' ' ELSE p_name END AS SYMBOL, 1 AS ord FROM part WHERE p_partkey % 3 <> 0
  UNION ALL SELECT p_partkey || '-1', p_brand, 2 FROM part WHERE p_partkey % 6 < 2),
one AS (SELECT PROBEID, SYMBOL FROM (SELECT *, row_number() OVER (PARTITION BY PROBEID ORDER BY ord, SYMBOL) AS r FROM ann) WHERE r = 1)"""


def annotation(spark, d):
    p = table(spark, d, "part")
    key = F.concat(F.col("p_partkey"), F.lit("-1")).alias("PROBEID")
    kind = F.col("p_partkey") % 5
    a = p.where("p_partkey % 3 <> 0").select(key, F.when(kind == 0, "nan").when(kind == 1, " ").otherwise(F.col("p_name")).alias("SYMBOL"), F.lit(1).alias("ord"))
    return a.unionByName(p.where("p_partkey % 6 < 2").select(key, F.col("p_brand").alias("SYMBOL"), F.lit(2).alias("ord")))


@query(f"""WITH {ANNOTATED} SELECT feature, l_partkey || '-1' AS PROBEID, SYMBOL, CASE WHEN SYMBOL IS NULL OR SYMBOL = 'nan' THEN '' ELSE SYMBOL END AS symbol_text,
CASE WHEN SYMBOL IS NOT NULL AND trim(SYMBOL) <> '' AND SYMBOL <> 'nan' THEN SYMBOL ELSE l_partkey || '-1' END AS label, round(mean_diff, 6) AS mean_diff
FROM res LEFT JOIN one ON one.PROBEID = l_partkey || '-1'""")
def annotate_left_dedup_label(spark, d):
    r = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.avg("l_quantity").alias("mean_diff"))
    r = r.select(F.concat(F.lit("seq."), F.col("l_partkey"), F.lit(".1")).alias("feature"), "mean_diff")
    a = testing.annotate(r, annotation(spark, d), order="ord")
    return a.select("feature", "PROBEID", "SYMBOL", text_or_blank(F.col("SYMBOL")).alias("symbol_text"), label_or(F.col("SYMBOL"), F.col("PROBEID")).alias("label"), F.round("mean_diff", 6).alias("mean_diff"))


VOLCANO = f"""{PVALUE}, points AS (
  SELECT feature, pos || '-' || pos AS PROBEID, n_name AS SYMBOL, coalesce(n_name, pos || '-' || pos) AS label, mean_diff, adj_p, -log10(greatest(1e-300, least(1.0, adj_p))) AS yy, adj_p < 0.05 AS is_sig
  FROM adjusted LEFT JOIN nation ON n_nationkey = pos)"""


def points(spark, d):
    names = table(spark, d, "nation").select(F.concat(F.col("n_nationkey"), F.lit("-"), F.col("n_nationkey")).alias("PROBEID"), F.col("n_name").alias("SYMBOL"))
    return testing.volcano(testing.annotate(tested(spark, d), names))


@query(f"WITH {VOLCANO} SELECT feature, PROBEID, SYMBOL, label, round(mean_diff, 6) AS mean_diff, round(adj_p, 6) AS adj_p, round(yy, 4) AS y, is_sig FROM points")
def volcano_relation(spark, d):
    return rounded(rounded(points(spark, d), "mean_diff", "adj_p"), "y", places=4)


@query(f"WITH {VOLCANO}, hits AS (SELECT *, max(CAST(is_sig AS INT)) OVER () AS has_sig FROM points) SELECT feature, label, is_sig FROM hits WHERE is_sig OR has_sig = 0 ORDER BY adj_p, feature LIMIT 20")
def top_hits(spark, d):
    return testing.top_hits(points(spark, d)).select("feature", "label", "is_sig")


# -- descriptive statistics -------------------------------------------------


@query(f"WITH {LONG}, m AS (SELECT feature, pos, abs(avg(value) FILTER (y = 1) - avg(value) FILTER (y = 0)) AS d FROM long GROUP BY 1, 2) SELECT feature, round(d, 6) AS abs_diff FROM m ORDER BY round(d, 9) DESC, pos LIMIT 6")
def top_diff_features(spark, d):
    return rounded(stats.top_difference(long_matrix(spark, d)), "abs_diff")


@query(f"""WITH {LONG} SELECT count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(min(value), 6) AS min, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS p50,
round(quantile_cont(value, 0.75), 6) AS p75, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.99), 6) AS p99, round(max(value), 6) AS max FROM long""")
def describe_matrix(spark, d):
    out = stats.describe(long_matrix(spark, d))
    return rounded(out, *[c for c in out.columns if c != "n"])


@query(f"WITH {LONG} SELECT feature, round(avg(value) FILTER (y = 1), 6) AS mean_pos, round(avg(value) FILTER (y = 0), 6) AS mean_neg FROM long GROUP BY 1")
def group_means(spark, d):
    return rounded(stats.group_means(long_matrix(spark, d)).drop("feat_ord"), "mean_pos", "mean_neg")


@query(f"WITH {LONG} SELECT row_id, round(avg(value), 6) AS mean FROM long GROUP BY 1")
def row_mean(spark, d):
    return rounded(stats_row_means(spark, d), "mean")


def stats_row_means(spark, d):
    return matrix.row_means(long_matrix(spark, d))


@query("""WITH b AS (SELECT o_orderstatus, least(CAST(floor(o_totalprice / 25000.0) AS INTEGER), 19) AS bin FROM orders WHERE o_totalprice BETWEEN 0 AND 500000), c AS (SELECT o_orderstatus, bin, count(*) AS n FROM b GROUP BY 1, 2)
SELECT o_orderstatus, bin, n, round(n / (sum(n) OVER (PARTITION BY o_orderstatus) * 25000.0) * 1e6, 6) AS density FROM c""")
def group_hist(spark, d):
    h = stats.histogram(table(spark, d, "orders"), "o_totalprice", 0.0, 500000.0, 20, "o_orderstatus")
    return h.select("o_orderstatus", "bin", "n", F.round(F.col("density") * 1e6, 6).alias("density"))


@query("SELECT CAST(CASE WHEN p_size BETWEEN 2 AND 49 AND NOT p_size >= 48 THEN (p_size - 2) // 2 WHEN p_size = 48 THEN 22 ELSE -1 END AS INTEGER) AS bin, count(*) AS n FROM part GROUP BY 1")
def edge_hist(spark, d):
    return stats.edge_histogram(table(spark, d, "part"), "p_size", list(range(2, 49, 2)))


@query("""WITH q AS (SELECT o_orderpriority, quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.5) AS med, quantile_cont(o_totalprice, 0.75) AS q3 FROM orders GROUP BY 1)
SELECT o_orderpriority, round(any_value(q1), 4) AS q1, round(any_value(med), 4) AS med, round(any_value(q3), 4) AS q3, round(min(o_totalprice), 4) AS low, round(max(o_totalprice), 4) AS high
FROM orders JOIN q USING (o_orderpriority) WHERE o_totalprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY 1""")
def boxplot_stats(spark, d):
    return rounded(stats.boxplot(table(spark, d, "orders"), "o_totalprice", "o_orderpriority"), "q1", "med", "q3", "low", "high", places=4)


@query("""SELECT c_mktsegment, count(*) FILTER (NOT c_acctbal > 0) AS n_neg, count(*) FILTER (c_acctbal > 0) AS n_pos, count(*) AS total, round_even(100.0 * count(*) FILTER (c_acctbal > 0) / count(*), 1) AS pct_pos FROM customer GROUP BY 1""")
def ward_crosstab(spark, d):
    c = table(spark, d, "customer").withColumn("y", (F.col("c_acctbal") > 0).cast("int"))
    return stats.crosstab(c, "c_mktsegment", "y")


@query("SELECT event_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM events GROUP BY 1")
def value_freq(spark, d):
    return rounded(stats.frequencies(table(spark, d, "events"), "event_type"), "share")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_counts(spark, d):
    return stats.cube_counts(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus")


@query("SELECT count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS n_pos, count(*) FILTER (l_returnflag <> 'R') AS n_neg, count(DISTINCT l_linestatus) AS n_status, avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END) AS share FROM lineitem")
def label_counts(spark, d):
    pos = F.col("l_returnflag") == "R"
    return table(spark, d, "lineitem").agg(F.count(F.lit(1)).alias("n"), F.count_if(pos).alias("n_pos"), F.count_if(~pos).alias("n_neg"), F.count_distinct("l_linestatus").alias("n_status"), F.avg(pos.cast("int")).alias("share"))


# -- cleaning and reshaping -------------------------------------------------


@query("""SELECT p_partkey, try_cast(CASE p_partkey % 4 WHEN 0 THEN 'n/a' WHEN 1 THEN NULL ELSE CAST(p_size AS VARCHAR) END AS DOUBLE) AS value, CASE WHEN p_size % 3 > 0 THEN p_size * 1.0 / (p_size % 3) ELSE 1.0 END AS ratio FROM part""")
def coerce_numeric(spark, d):
    p = table(spark, d, "part")
    kind = F.col("p_partkey") % 4
    raw = F.when(kind == 0, "n/a").when(kind == 1, None).otherwise(F.col("p_size").cast("string"))
    return p.select("p_partkey", numeric(raw).alias("value"), safe_ratio(F.col("p_size"), F.col("p_size") % 3).alias("ratio"))


IMPUTED = f"{LONG}, med AS (SELECT feature, median(value) AS md FROM long GROUP BY 1), imp AS (SELECT row_id, y, pos, feature, coalesce(value, md) AS value FROM long JOIN med USING (feature))"


@query(f"WITH {IMPUTED} SELECT row_id, feature, round(value, 6) AS value FROM imp")
def median_impute(spark, d):
    return rounded(matrix.impute(long_matrix(spark, d)).select("row_id", "feature", "value"), "value")


@query(f"""WITH {IMPUTED}, fitm AS (SELECT feature, median(value) AS md FROM long WHERE row_id % 5 <> 0 GROUP BY 1), f AS (SELECT row_id, feature, coalesce(value, md) AS value FROM long JOIN fitm USING (feature)),
s AS (SELECT feature, avg(value) AS m, stddev_pop(value) AS sd FROM f WHERE row_id % 5 <> 0 GROUP BY 1) SELECT row_id, feature, round((value - m) / sd, 6) AS value FROM f JOIN s USING (feature) WHERE row_id % 5 = 0""")
def fitted_scaling(spark, d):
    x = long_matrix(spark, d)
    fit_on, to = x.where("row_id % 5 <> 0"), x.where("row_id % 5 = 0")
    return rounded(matrix.standardise(matrix.impute(to, fit_on), matrix.impute(fit_on)).select("row_id", "feature", "value"), "value")


@query(f"WITH {IMPUTED}, i8 AS (SELECT * FROM imp WHERE pos < 8) SELECT a.feature AS f1, b.feature AS f2, round(corr(a.value, b.value), 6) AS r FROM i8 a JOIN i8 b ON a.row_id = b.row_id AND a.pos <= b.pos GROUP BY 1, 2")
def corr_pairs(spark, d):
    return rounded(stats.correlations(matrix.impute(long_matrix(spark, d, 8))), "r")


@query(f"""WITH {IMPUTED}, i4 AS (SELECT * FROM imp WHERE pos < 4), c AS (SELECT a.y, a.feature AS f1, b.feature AS f2, corr(a.value, b.value) AS r FROM i4 a JOIN i4 b ON a.row_id = b.row_id AND a.pos <= b.pos GROUP BY 1, 2, 3)
SELECT p.f1, p.f2, round(p.r - n.r, 6) + 0.0 AS diff FROM c p JOIN c n ON p.f1 = n.f1 AND p.f2 = n.f2 AND p.y = 1 AND n.y = 0""")
def corr_diff(spark, d):
    x = matrix.impute(long_matrix(spark, d, 4))
    out = stats.correlation_difference(stats.correlations(x.where("y = 1")), stats.correlations(x.where("y = 0")))
    return out.select("f1", "f2", (F.round("diff", 6) + 0.0).alias("diff"))


@query(ORACLE["corr_pairs"].replace(" WHERE pos < 8", ""))
def corr_pairs_all(spark, d):
    return rounded(stats.correlations(matrix.impute(long_matrix(spark, d))), "r")


@query(ORACLE["corr_diff"].replace(" WHERE pos < 4", ""))
def corr_diff_all(spark, d):
    x = matrix.impute(long_matrix(spark, d))
    out = stats.correlation_difference(stats.correlations(x.where("y = 1")), stats.correlations(x.where("y = 0")))
    return out.select("f1", "f2", (F.round("diff", 6) + 0.0).alias("diff"))


@query()
def heatmap_order(spark, d):
    """Leaf order is a convention of its own: tested against a brute-force version."""
    return rounded(stats.heatmap(stats.correlations(matrix.impute(long_matrix(spark, d)))), "r")


# -- metrics ----------------------------------------------------------------

PREDICTED = "p AS (SELECT event_id, user_id, CAST(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS INTEGER) AS label, floor(value) AS score, CAST(CASE WHEN value > 60 THEN 1 ELSE 0 END AS INTEGER) AS pred FROM events)"


def predicted(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", "user_id", (F.col("event_type") == "purchase").cast("int").alias("label"), F.floor("value").alias("score"), (F.col("value") > 60).cast("int").alias("pred"))


@query(f"""WITH {PREDICTED}, r AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM p)
SELECT round((sum(rk) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0) / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0)), 6) AS auc FROM r""")
def auc(spark, d):
    return rounded(metrics.auc(predicted(spark, d)), "auc")


@query(f"WITH {PREDICTED} SELECT round(avg(CASE WHEN label = pred THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM p")
def accuracy(spark, d):
    return rounded(metrics.accuracy(predicted(spark, d)), "accuracy")


@query(f"WITH {PREDICTED} SELECT label, count(*) FILTER (pred = 0) AS pred_0, count(*) FILTER (pred = 1) AS pred_1 FROM p GROUP BY 1")
def confusion(spark, d):
    return metrics.confusion(predicted(spark, d))


@query(f"""WITH {PREDICTED}, k AS (SELECT CAST(c AS VARCHAR) AS class, count(*) FILTER (label = c AND pred = c) AS tp, count(*) FILTER (pred = c) AS said, count(*) FILTER (label = c) AS support FROM p, (VALUES (0), (1)) v(c) GROUP BY c),
s AS (SELECT class, tp / said AS precision, tp / support AS recall, 2.0 * tp / (said + support) AS f1, support, tp FROM k),
a AS (SELECT sum(tp) / sum(support) AS acc, CAST(sum(support) AS BIGINT) AS n FROM s)
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM s
UNION ALL SELECT 'accuracy', round(acc, 6), round(acc, 6), round(acc, 6), n FROM a
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM s
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM s""")
def class_report(spark, d):
    return rounded(metrics.report(predicted(spark, d)), "precision", "recall", "f1")


# -- orders, peeks, flags, palettes, bins of the data ------------------------


@query(f"WITH {PVALUE} SELECT feature, row_number() OVER (ORDER BY adj_p, pval, pos) AS place FROM adjusted QUALIFY place <= 10")
def ttest_notebook_order(spark, d):
    """The ten first features by adj_p and then pval, both ascending."""
    top = testing.ttest_order(tested(spark, d), script_order=False).limit(10)
    return top.select("feature", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("adj_p", "pval", "feat_ord")).cast("bigint").alias("place"))


@query("""WITH r AS (SELECT p_partkey, p_size, least(1.0, ((p_partkey * 7919) % 1000 + 1) / 1001.0 / 100 * count(*) OVER ()) AS adj_p FROM part)
SELECT p_partkey, p_size, row_number() OVER (ORDER BY adj_p, p_size DESC, p_partkey) AS place FROM r QUALIFY place <= 25""")
def information_order_top(spark, d):
    """adj_p ascending, mi descending: 25 first parts, their size standing for mi."""
    r = testing.correct(p_like(spark, d).withColumn("pval", F.col("pval") / 100), "bonferroni").join(table(spark, d, "part").select("p_partkey", F.col("p_size").alias("mi")), "p_partkey")
    top = testing.information_order(r.withColumn("feat_ord", F.col("p_partkey"))).limit(25)
    return top.select("p_partkey", F.col("mi").alias("p_size"), F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("adj_p", F.desc("mi"), "p_partkey")).cast("bigint").alias("place"))


@query("""WITH c AS (SELECT count(*) AS n, count(doc_id) AS a, count(text) AS b, count(lang) AS c, count(source) AS d, count(n_chars) AS e FROM documents)
SELECT CAST(i AS INTEGER) AS at, ['doc_id', 'text', 'lang', 'source', 'n_chars'][i + 1] AS column, ['bigint', 'string', 'string', 'string', 'bigint'][i + 1] AS type, n AS n_rows, [a, b, c, d, e][i + 1] AS n_known FROM c, range(5) t(i)""")
def table_info(spark, d):
    return info(table(spark, d, "documents"))


FLAGS = "CASE o_orderkey % 7 WHEN 0 THEN ' True ' WHEN 1 THEN 'FALSE' WHEN 2 THEN '1' WHEN 3 THEN '0.0' WHEN 4 THEN 'yes' WHEN 5 THEN '' END"


@query(f"SELECT o_orderkey, CASE WHEN lower(trim({FLAGS})) IN ('true', '1', '1.0') THEN 1 WHEN lower(trim({FLAGS})) IN ('false', '0', '0.0') THEN 0 END AS flag FROM orders")
def truth_flags(spark, d):
    """Flags spelt in many ways; what is neither is missing, and not true as any text would be."""
    return table(spark, d, "orders").select("o_orderkey", truth(F.expr(FLAGS)).alias("flag"))


@query("SELECT n_nationkey, CASE n_regionkey WHEN 0 THEN 'binary' WHEN 1 THEN 'diverging' WHEN 2 THEN 'sequential_teal' ELSE n_name END AS context, CASE n_regionkey WHEN 0 THEN 2 WHEN 1 THEN 5 WHEN 2 THEN 5 ELSE 6 END AS n_colors, CASE n_regionkey WHEN 1 THEN '#0c4a46' WHEN 2 THEN '#e3f4f2' ELSE '#1b7f79' END AS first_color FROM nation")
def palette_lookup(spark, d):
    r = F.col("n_regionkey")
    n = table(spark, d, "nation").select("n_nationkey", F.when(r == 0, "binary").when(r == 1, "diverging").when(r == 2, "sequential_teal").otherwise(F.col("n_name")).alias("context"))
    return n.select("n_nationkey", "context", F.size(palette(F.col("context"))).alias("n_colors"), palette(F.col("context"))[0].alias("first_color"))


@query("""WITH e AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
b AS (SELECT l_linestatus, least(floor((l_extendedprice - lo) / ((hi - lo) / 12)), 11) AS bin, (hi - lo) / 12 AS w FROM lineitem, e)
SELECT l_linestatus, CAST(bin AS INTEGER) AS bin, count(*) AS n, round(count(*) / (sum(count(*)) OVER (PARTITION BY l_linestatus) * any_value(w)), 9) AS density FROM b GROUP BY 1, 2""")
def shared_hist(spark, d):
    """Bins over the range of all the data, the same in each group."""
    return rounded(stats.histogram(table(spark, d, "lineitem"), "l_extendedprice", None, None, 12, "l_linestatus"), "density", places=9)


@query("SELECT f1, f2, coalesce(r, 0) AS r FROM (" + ORACLE["corr_pairs_all"] + ")")
def corr_zero_filled(spark, d):
    """As the heat map's distances take it: 0 where there is no correlation."""
    return rounded(stats.correlations(matrix.impute(long_matrix(spark, d))), "r").withColumn("r", zero_if_missing(F.col("r")))


# -- joins and unions of results --------------------------------------------


@query("SELECT s_suppkey, s_name, n_name, r_name, round(s_acctbal, 2) AS s_acctbal FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA'")
def chained_inner(spark, d):
    s, n, r = (table(spark, d, t) for t in ("supplier", "nation", "region"))
    out = s.join(n, s.s_nationkey == n.n_nationkey).join(r.where("r_name <> 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    return out.select("s_suppkey", "s_name", "n_name", "r_name", F.round("s_acctbal", 2).alias("s_acctbal"))


ERRORS = """e AS (SELECT l_shipmode AS q, m, v FROM (SELECT l_linestatus AS l_shipmode, 'mean' AS m, avg(l_discount) AS v FROM lineitem GROUP BY 1
UNION ALL SELECT l_linestatus, 'median', median(l_discount) FROM lineitem GROUP BY 1))"""


def estimates(spark, d):
    x = table(spark, d, "lineitem").groupBy("l_linestatus")
    a = x.agg(F.avg("l_discount").alias("v")).select(F.col("l_linestatus").alias("q"), F.lit("mean").alias("m"), "v")
    return a.unionByName(x.agg(F.median("l_discount").alias("v")).select(F.col("l_linestatus").alias("q"), F.lit("median").alias("m"), "v"))


@query(f"WITH {ERRORS} SELECT q, m, round(v, 6) AS v, round(abs(v - 0.05), 6) AS abs_error FROM e")
def result_union(spark, d):
    return rounded(estimates(spark, d).withColumn("abs_error", F.abs(F.col("v") - 0.05)), "v", "abs_error")


@query(f"WITH {ERRORS} SELECT q, round(max(v) FILTER (m = 'mean'), 4) AS mean, round(max(v) FILTER (m = 'median'), 4) AS median FROM e GROUP BY 1")
def error_pivot(spark, d):
    return rounded(estimates(spark, d).groupBy("q").pivot("m", ["mean", "median"]).agg(F.first("v")), "mean", "median", places=4)


# -- information ------------------------------------------------------------

K = 3
PSI = "(list_sum(list_transform(range(1, {n}), lambda i: 1.0 / i)) - 0.57721566490153286061)"


def psi(n: str) -> str:
    return f"coalesce(list_sum(list_transform(range(1, CAST({n} AS BIGINT)), lambda i: 1.0 / i)), 0.0) - 0.57721566490153286061"


def wide_sql(dims: int = 4) -> str:
    return "w AS (SELECT vec_id AS row_id, CASE WHEN label < 5 THEN 1 ELSE 0 END AS y, " + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS x{i}" for i in range(dims)) + " FROM embeddings)"


def distance(dims: list[int]) -> str:
    return "greatest(" + ", ".join(f"abs(a.x{i} - b.x{i})" for i in dims) + ")" if len(dims) > 1 else f"abs(a.x{dims[0]} - b.x{dims[0]})"


def ksg_sql(x: list[int], y: list[int], where: str = "true") -> str:
    """Scalar subquery over w: the first KSG estimator."""
    d = distance(x + y)
    return f"""(SELECT {psi("max(n)")} + {psi(str(K))} - avg({psi("nx")}) - avg({psi("ny")}) FROM (
      SELECT a.row_id, any_value(a.n) AS n, count(*) FILTER ({distance(x)} < a.r OR {distance(x)} = 0) AS nx, count(*) FILTER ({distance(y)} < a.r OR {distance(y)} = 0) AS ny
      FROM (SELECT c.*, count(*) OVER () AS n FROM (SELECT a.*, (SELECT list_sort(list({d}))[{K + 1}] FROM w b WHERE {where}) AS r FROM w a WHERE {where.replace("b.", "a.")}) c) a, w b WHERE {where} GROUP BY 1))"""


def cmi_sql(x: int, y: int, z: int) -> str:
    c = lambda dims: f"count(*) FILTER ({distance(dims)} < a.r OR {distance(dims)} = 0)"
    return f"""(SELECT {psi(str(K))} - avg({psi("nxz")}) - avg({psi("nyz")}) + avg({psi("nz")}) FROM (
      SELECT a.row_id, {c([x, z])} AS nxz, {c([y, z])} AS nyz, {c([z])} AS nz
      FROM (SELECT a.*, (SELECT list_sort(list({distance([x, y, z])}))[{K + 1}] FROM w b) AS r FROM w a) a, w b GROUP BY 1))"""


def entropy_sql(dims: list[int], where: str = "true") -> str:
    return f"""(SELECT {psi("count(*)")} - ({psi(str(K))}) + {len(dims)} * ln(2) + {len(dims)} * avg(ln(r)) FROM (
      SELECT (SELECT list_sort(list({distance(dims)}))[{K + 1}] FROM w b WHERE {where}) AS r FROM w a WHERE {where.replace("b.", "a.")}))"""


def micd_sql(dims: list[int]) -> str:
    share = lambda y: f"(SELECT avg(CASE WHEN y = {y} THEN 1.0 ELSE 0.0 END) FROM w)"
    return f"abs({entropy_sql(dims)} - {share(0)} * {entropy_sql(dims, 'b.y = 0')} - {share(1)} * {entropy_sql(dims, 'b.y = 1')})"


ROSS = """SELECT g, greatest(0.0, {psi_n} + avg({psi_k}) - avg({psi_c}) - avg({psi_m})) AS mi FROM (
  SELECT a.g, a.row_id, any_value(a.c) AS c, count(*) AS n, least({k}, any_value(a.c) - 1) AS kk, count(*) FILTER (abs(a.x - b.x) < a.r OR a.x = b.x) AS m
  FROM (SELECT g, row_id, x, c, dist[least({k}, c - 1) + 1] AS r FROM (
    SELECT a.g, a.row_id, any_value(a.x) AS x, count(*) AS c, list_sort(list(abs(a.x - b.x))) AS dist FROM pts a JOIN pts b ON a.g = b.g AND a.y = b.y GROUP BY 1, 2)) a
  JOIN pts b ON a.g = b.g GROUP BY 1, 2) GROUP BY 1"""


def ross_sql() -> str:
    return ROSS.format(k=K, psi_n=psi("max(n)"), psi_k=psi("kk"), psi_c=psi("c"), psi_m=psi("m"))


@query(f"WITH {LONG}, pts AS (SELECT feature AS g, row_id, y, value AS x FROM long WHERE pos < 2 AND value IS NOT NULL) SELECT g AS feature, round(mi, 6) + 0.0 AS mi FROM ({ross_sql()})", name="mi_cd_ross")
def mi_cd_ross(spark, d):
    return rounded(information.mutual_information(long_matrix(spark, d, 2), K).drop("feat_ord"), "mi")


@query(f"WITH {IMPUTED}, pts AS (SELECT feature AS g, row_id, y, value AS x FROM imp) SELECT g AS feature, round(mi, 6) + 0.0 AS mi FROM ({ross_sql()})")
def mi_all_features(spark, d):
    """All 64 features after imputation, best first."""
    out = information.mutual_information(matrix.impute(long_matrix(spark, d)), K)
    return rounded(out.orderBy(F.desc("mi"), "feat_ord").select("feature", "mi"), "mi")


@query(f"WITH {wide_sql()} SELECT 'seq.0.0' AS feature, round({micd_sql([0])}, 6) AS mi UNION ALL SELECT 'seq.1.1', round({micd_sql([1])}, 6)")
def mi_cd_kl(spark, d):
    return rounded(information.mutual_information(long_matrix(spark, d, 2, missing=False), K, "npeet").drop("feat_ord"), "mi")


@query(f"WITH {wide_sql()} SELECT CAST(0 AS INTEGER) AS f1, CAST(1 AS INTEGER) AS f2, round({ksg_sql([0], [1])}, 6) AS mi")
def mi_cc_ksg(spark, d):
    return rounded(information.pair_information(vectors(spark, d), [(0, 1)], K), "mi")


@query(f"WITH {wide_sql()} SELECT '0+1' AS fs, round({micd_sql([0, 1])}, 6) AS mi")
def joint_mi_cd(spark, d):
    return rounded(information.joint_information(vectors(spark, d), [(0, 1)], K), "mi")


@query(f"WITH {wide_sql()} SELECT '0+1+2' AS fs, round({ksg_sql([0, 1], [2])}, 6) AS mi")
def joint_mi_cc(spark, d):
    return rounded(information.joint_information_cc(vectors(spark, d), [(0, 1, 2)], K), "mi")


@query(f"WITH {wide_sql()} SELECT '0+1+2' AS fs, round({cmi_sql(0, 1, 2)}, 6) AS mi")
def cmi(spark, d):
    return rounded(information.conditional_information(vectors(spark, d), [(0, 1, 2)], K), "mi")


@query(f"""WITH {wide_sql()} SELECT CAST(0 AS INTEGER) AS f1, CAST(1 AS INTEGER) AS f2, round({ksg_sql([0], [1])} - (SELECT avg(CASE WHEN y = 0 THEN 1.0 ELSE 0.0 END) FROM w) * {ksg_sql([0], [1], "b.y = 0")}
 - (SELECT avg(CASE WHEN y = 1 THEN 1.0 ELSE 0.0 END) FROM w) * {ksg_sql([0], [1], "b.y = 1")}, 6) AS mi""")
def ii_ccd(spark, d):
    return rounded(information.interaction_ccd(vectors(spark, d), [(0, 1)], K), "mi")


@query(f"WITH {wide_sql()} SELECT CAST(0 AS INTEGER) AS f1, CAST(1 AS INTEGER) AS f2, round({micd_sql([0])} + {micd_sql([1])} - {micd_sql([0, 1])}, 6) AS mi")
def ii_ccd_marginals(spark, d):
    return rounded(information.interaction_ccd(vectors(spark, d), [(0, 1)], K, "npeet_3"), "mi")


@query(f"WITH {wide_sql()} SELECT '0+1+2' AS fs, round({ksg_sql([0], [1])} - {cmi_sql(0, 1, 2)}, 6) AS mi")
def ii_ccc(spark, d):
    return rounded(information.interaction_ccc(vectors(spark, d), [(0, 1, 2)], K), "mi")


@query(f"WITH {wide_sql()} SELECT '0+1' AS fs, round({micd_sql([0])} + {micd_sql([1])} - {micd_sql([0, 1])}, 6) AS ii")
def ii_general(spark, d):
    return rounded(information.interaction(vectors(spark, d), (0, 1), K), "ii")


@query(f"WITH {wide_sql()} SELECT '0+1' AS fs, round({entropy_sql([0])} + {entropy_sql([1])} - {entropy_sql([0, 1])}, 6) AS ii")
def ii_entropies(spark, d):
    return rounded(information.interaction(vectors(spark, d), (0, 1), K, with_label=False), "ii")


ROUNDS = 9


@query(f"""WITH {LONG}, f AS (SELECT row_id, y, value AS x FROM long WHERE pos = 0 AND value IS NOT NULL), ids AS (SELECT *, row_number() OVER (ORDER BY row_id) AS i FROM f),
shuffled AS (SELECT b, y, row_number() OVER (PARTITION BY b ORDER BY md5(row_id || '|42|' || b), row_id) AS i FROM f, range({ROUNDS}) t(b)),
pts AS (SELECT b AS g, row_id, s.y AS y, x FROM ids JOIN shuffled s USING (i) UNION ALL SELECT -1, row_id, y, x FROM f),
mi AS ({ross_sql()})
SELECT 'seq.0.0' AS feature, round(o.mi, 6) + 0.0 AS mi, round((count(*) FILTER (p.mi >= o.mi) + 1) / {ROUNDS + 1}.0, 6) AS p_perm FROM mi p, (SELECT mi FROM mi WHERE g = -1) o WHERE p.g >= 0 GROUP BY o.mi""")
def perm_test(spark, d):
    x = long_matrix(spark, d, 1).where("value is not null")
    out = testing.permutation_p(information.mutual_information(x, K), information.permuted_information(x, ROUNDS, K), ROUNDS)
    return rounded(out, "mi", "p_perm")


# -- information, whole: all features, pairs and triples, without SQL where it is too slow --


def width(spark: SparkSession, d: str) -> int:
    return table(spark, d, "embeddings").agg(F.max(F.size("embedding"))).first()[0]


def pairs(spark: SparkSession, d: str) -> list[tuple[int, int]]:
    return list(combinations(range(width(spark, d)), 2))


def targets(spark: SparkSession, d: str) -> list[tuple[int, int, int]]:
    """Every pair with every third feature, which comes last."""
    n = width(spark, d)
    return [(a, b, c) for a, b in combinations(range(n), 2) for c in range(n) if c not in (a, b)]


def all_vectors(spark: SparkSession, d: str) -> DataFrame:
    return vectors(spark, d, width(spark, d))


@query(ORACLE["mi_cd_ross"].replace("pos < 2 AND ", ""))
def mi_cd_ross_all(spark, d):
    return rounded(information.mutual_information(long_matrix(spark, d), K).drop("feat_ord"), "mi")


@query()
def mi_cd_kl_all(spark, d):
    return rounded(information.mutual_information(long_matrix(spark, d, missing=False), K, "npeet").drop("feat_ord"), "mi")


def _metric_sql(width: int) -> str:
    one = lambda i: f"SELECT '{i}' AS fs, round({entropy_sql([i])}, 5) AS h, round({entropy_sql([i])} - (SELECT avg(CASE WHEN y = 0 THEN 1.0 ELSE 0.0 END) FROM w) * {entropy_sql([i], 'b.y = 0')} - (SELECT avg(CASE WHEN y = 1 THEN 1.0 ELSE 0.0 END) FROM w) * {entropy_sql([i], 'b.y = 1')}, 5) + 0.0 AS mi"
    return f"WITH {wide_sql(width)} " + " UNION ALL ".join(map(one, range(width)))


@query(_metric_sql(64))
def metric_information(spark, d):
    """Entropy of each feature, and what it loses within the labels, with its sign."""
    out = information.decomposed_information(all_vectors(spark, d), [(i,) for i in range(width(spark, d))], K)
    return rounded(out, "h", "mi", places=5).withColumn("mi", F.col("mi") + 0.0)


@query()
def mi_cc_ksg_all(spark, d):
    return rounded(information.pair_information(all_vectors(spark, d), pairs(spark, d), K), "mi")


@query()
def joint_mi_cd_all(spark, d):
    return rounded(information.joint_information(all_vectors(spark, d), pairs(spark, d), K), "mi")


@query()
def joint_mi_cc_all(spark, d):
    return rounded(information.joint_information_cc(all_vectors(spark, d), targets(spark, d), K), "mi")


@query()
def cmi_all(spark, d):
    return rounded(information.conditional_information(all_vectors(spark, d), targets(spark, d), K), "mi")


@query()
def ii_ccd_all(spark, d):
    return rounded(information.interaction_ccd(all_vectors(spark, d), pairs(spark, d), K), "mi")


@query()
def ii_ccd_marginals_all(spark, d):
    return rounded(information.interaction_ccd(all_vectors(spark, d), pairs(spark, d), K, "npeet_3"), "mi")


@query()
def ii_ccc_all(spark, d):
    return rounded(information.interaction_ccc(all_vectors(spark, d), targets(spark, d), K), "mi")


@query()
def ii_general_all(spark, d):
    return rounded(information.interactions(all_vectors(spark, d), pairs(spark, d), K), "ii")


@query()
def ii_entropies_all(spark, d):
    return rounded(information.interactions(all_vectors(spark, d), pairs(spark, d), K, with_label=False), "ii")


ALL_ROUNDS = 1000


@query()
def perm_test_all(spark, d):
    x = long_matrix(spark, d).where("value is not null")
    out = testing.permutation_p(information.mutual_information(x, K), information.permuted_information(x, ALL_ROUNDS, K), ALL_ROUNDS)
    return rounded(out, "mi", "p_perm")


# -- models -----------------------------------------------------------------


def _parts(spark, d):
    """Balanced validation and stratified test rows of the eight best features, chosen on the training rows."""
    x = long_matrix(spark, d)
    held = cohorts.stratified(samples(spark, d), "row_id", "y")
    seen = cohorts.balanced(held.where("part = 'seen'").select("row_id", "y"), "row_id", "y")
    ids = seen.select("row_id", "part").unionByName(held.where("part = 'unseen'").select("row_id", F.lit("test").alias("part")))
    all_ = x.join(ids, "row_id")
    best = testing.top_features(testing.correct(testing.welch(all_.where("part = 'train'")), tie=("feat_ord",)), 8)
    all_ = written(all_.join(F.broadcast(best.withColumnRenamed("protein", "feature")), "feature"), "parts")  # a list of features
    return tuple(all_.where(F.col("part") == p).drop("part") for p in ("train", "val", "test"))


def _model(family: str, grid: dict):
    def run(spark, d):
        return models.train_and_evaluate(*_parts(spark, d), {family: grid})

    return run


QUERIES["lr_grid"] = _model("lr", models.LR_GRID)
QUERIES["rf_grid"] = _model("rf", models.RF_GRID)
QUERIES["gbt_grid"] = _model("gbt", models.GBT_GRID)
