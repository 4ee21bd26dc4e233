"""Information-theoretic scores of features, from sums over their neighbours.

Single features with the label go along the line (``nearest``), sets of
features through tiles or cells (``tiles``); what is left here are the
estimators, as arithmetic on a row per feature or set.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortica import kernels
from cohortica.functions import neighbours as nn
from cohortica.functions.expressions import spare_double
from cohortica.operators import nearest, tiles
from cohortica.operators.order import running, written

PERMUTED_ROWS = 1 << 20  # rows of which a task may hold COLUMNS features and the order of a round
COLUMNS = 16  # features of a task, for
ROUNDS = 64  # rounds
NUMPY_ROWS = 1 << 17  # rows of which a task may hold one feature and the orders of some rounds without the kernel
ROUNDS_AT_ONCE = 25


def _ross(points: DataFrame, by: list[str], k: int) -> DataFrame:
    """by, mi of points (by, row_id, y, value): Ross's estimator; a label with one row does not count."""
    near = written(nearest.line_radius(points, [*by, "y"], "value", "row_id", k).where("kk > 0"), "near")
    # the radius is just below the distance to the neighbour: that one is not within
    held = nearest.line_counts(near, near, by, "value", ["y", "place"])
    m = held.groupBy(*by).agg(F.avg(nearest.digamma(F.col("held"))).alias("m"))
    label = near.groupBy(*by, "y").agg(F.count(F.lit(1)).alias("c"), F.sum(nearest.digamma(F.col("kk"))).alias("k"))
    whole = label.groupBy(*by).agg(F.sum("c").alias("n"), F.sum("k").alias("k"), F.sum(F.col("c") * nearest.digamma(F.col("c"))).alias("c"))
    mi = nearest.digamma(F.col("n")) + (F.col("k") - F.col("c")) / F.col("n") - F.col("m")
    return whole.join(m, by).select(*by, F.greatest(F.lit(0.0), mi).alias("mi"))


def _line_entropy(points: DataFrame, by: list[str], k: int) -> DataFrame:
    """by, n, h: Kozachenko-Leonenko; null for k rows or fewer."""
    near = nearest.line_radius(points, by, "value", "row_id", k)
    h = nearest.digamma(F.col("n")) - nearest.digamma(F.lit(k)) + F.log(F.lit(2.0)) + F.col("l") / F.col("n")
    return near.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.log("radius")).alias("l")).select(*by, "n", F.when(F.col("n") > k, h).alias("h"))


def _within_classes(whole: DataFrame, classes: DataFrame, by: list[str]) -> DataFrame:
    """|H(X) - sum p H(X | label)|; a label of k rows or fewer gives no information."""
    both = classes.withColumnRenamed("h", "inner").withColumnRenamed("n", "c").join(whole, by)
    inner = F.sum(F.col("c") * F.coalesce("inner", "h")) / F.max("n")
    return both.groupBy(*by).agg(F.abs(F.max("h") - inner).alias("mi"))


def mutual_information(long: DataFrame, k: int = 3, method: str = "sklearn") -> DataFrame:
    """feature, feat_ord, mi of every feature with the label: 'sklearn' (Ross) or 'npeet' (class entropies, null for k values or fewer).

    Missing values and labels are left out; a feature of which no two rows share
    a label has mi 0 ('sklearn').
    """
    if method not in ("sklearn", "npeet"):
        raise ValueError(f"unknown method {method!r}")
    points = long.where("value is not null and y is not null").select("row_id", "y", "feature", "feat_ord", F.col("value").cast("double").alias("value"))
    names = points.groupBy("feature").agg(F.min("feat_ord").alias("feat_ord"))
    points = points.drop("feat_ord")
    if method == "sklearn":
        found = _ross(points, ["feature"], k).withColumnRenamed("feature", "of")
        return names.join(found, F.col("feature") == F.col("of"), "left").select("feature", "feat_ord", F.coalesce("mi", F.lit(0.0)).alias("mi"))
    points = points.withColumn("value", F.col("value") + tiles.JITTER * spare_double("row_id"))
    found = _within_classes(_line_entropy(points, ["feature"], k), _line_entropy(points, ["feature", "y"], k), ["feature"])
    return names.join(found, "feature").select("feature", "feat_ord", "mi")


def _labellings(x: DataFrame, number: DataFrame, n: int, rounds: int, k: int, seed: int) -> DataFrame:
    """feature, round, mi by the kernel ``Labellings``, of x (at, y, feature, value) and the numbered rows (row_id, at)."""
    spark = x.sparkSession

    def column(table: pa.Table) -> pa.Table:
        at, y, value = (table[c].to_numpy() for c in ("at", "y", "value"))
        has = np.zeros(n, bool)
        has[at] = True
        if has.sum() < len(at):
            raise ValueError("a row has a feature twice")
        order = np.argsort(at)
        labels, codes = np.unique(y[order], return_inverse=True)
        codes = codes.astype(np.uint8 if len(labels) <= 256 else "<i4")
        with np.errstate(over="ignore"):
            short = value[order].astype("<f4")
        value = short if (short == value[order]).all() else value[order].astype("<f8")
        head = np.array([len(at), codes.itemsize, value.itemsize, len(labels)], "<i4")
        data = b"".join(v.tobytes() for v in (head, np.packbits(has, bitorder="little"), codes, value))
        return pa.table({"feature": table["feature"][:1], "data": pa.array([data], pa.binary())})

    def ids(table: pa.Table) -> pa.Table:
        text = [t.encode() for t in table.sort_by("at")["text"].to_pylist()]
        begin = np.cumsum([0, *map(len, text)]).astype("<i4")
        return pa.table({"texts": pa.array([b"".join([np.array([len(text)], "<i4").tobytes(), begin.tobytes(), *text])], pa.binary())})

    columns = written(x.groupBy("feature").applyInArrow(column, "feature string, data binary"), "columns")
    text = F.concat_ws("|", F.col("row_id").cast("string"), F.lit(str(seed)), F.lit(""))
    texts = written(number.select("at", text.alias("text")).groupBy(F.lit(0).alias("all")).applyInArrow(ids, "texts binary"), "texts")
    names = [r[0] for r in columns.select("feature").collect()]
    parts = [(names[i : i + COLUMNS], a, min(a + ROUNDS, rounds)) for i in range(0, len(names), COLUMNS) for a in range(0, rounds, ROUNDS)]
    made = spark.createDataFrame([(i, own, np.array([a, b, k], "<i4").tobytes()) for i, (own, a, b) in enumerate(parts)], "task int, own array<string>, asked binary")  # features and rounds are metadata
    of = made.select("task", "asked", F.explode("own").alias("feature"))
    every = columns.join(F.broadcast(of), "feature").select("task", "asked", "feature", "data").unionByName(texts.crossJoin(F.broadcast(made.select("task", "asked"))).select("task", "asked", F.lit(None).cast("string").alias("feature"), F.col("texts").alias("data")))
    held = every.repartition(max(1, 4 * len(parts)), "task").groupBy("task", "asked").agg(F.array_sort(F.collect_list(F.struct(F.col("feature").isNotNull(), "feature", "data"))).alias("v"))  # the texts come first
    own = F.slice("v", 2, F.size("v") - 1)
    found = held.select("asked", own["feature"].alias("features"), kernels.call("Labellings", F.col("v")[0]["data"], own["data"], "asked").alias("found"))

    def run(batches):
        for b in batches:
            for r in b.itertuples(index=False):
                first, end, _ = np.frombuffer(r.asked, "<i4")
                for name, mi in zip(r.features, np.frombuffer(r.found, "<f8").reshape(-1, end - first), strict=True):
                    yield pd.DataFrame({"feature": name, "round": np.arange(first, end), "mi": mi})

    return found.mapInPandas(run, "feature string, round int, mi double")


def permuted_information(long: DataFrame, rounds: int = 1000, k: int = 3, seed: int = 42) -> DataFrame:
    """feature, round, mi (Ross): each round shuffles the labels, alike for all features.

    A round's order is that of md5 of (row_id, seed, round), worked out once for
    all features; of the rows that have the feature, the i-th by row_id gets the
    label of the i-th in that order.  row_id is unique within a feature.  Up to
    ``PERMUTED_ROWS`` rows a task takes ``COLUMNS`` features, each sorted once,
    and works out the orders of ``ROUNDS`` rounds one after the other; a taller
    table goes along the line, as the observed scores do.
    """
    x = written(long.where("value is not null and y is not null").select("row_id", F.col("y").cast("int").alias("y"), "feature", F.col("value").cast("double").alias("value")), "values")
    rows = x.select("row_id").distinct()
    n, fast = rows.count(), kernels.ready(x.sparkSession, "Labellings")
    if n > (PERMUTED_ROWS if fast else min(PERMUTED_ROWS, NUMPY_ROWS)):
        digest = F.md5(F.concat_ws("|", F.col("row_id").cast("string"), F.lit(str(seed)), F.col("round").cast("string")))
        every = F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("round")
        shuffled = x.select("*", every).withColumn("digest", digest)
        to = running(shuffled, ["feature", "round"], ["row_id"], i=F.lit(1)).select("feature", "round", "i", "row_id", "value")
        of = running(shuffled, ["feature", "round"], ["digest", "row_id"], i=F.lit(1)).select("feature", "round", "i", "y")
        return _ross(to.join(of, ["feature", "round", "i"]), ["feature", "round"], k)
    number = written(running(rows, [], ["row_id"], at=F.lit(1)), "numbers")
    if fast:
        return _labellings(x.join(number, "row_id"), number, n, rounds, k, seed)
    column = x.join(number, "row_id").groupBy("feature").agg(F.array_sort(F.collect_list(F.struct("at", "y", "value"))).alias("v"))
    column = written(column.select("feature", *[F.col("v")[c].alias(c) for c in ("at", "y", "value")]), "columns")
    text = F.concat_ws("|", F.col("row_id").cast("string"), F.lit(str(seed)), F.lit(""))
    texts = number.agg(F.array_sort(F.collect_list(F.struct("at", text.alias("text")))).alias("v")).select(F.col("v")["text"].alias("texts"))
    blocks = F.explode(F.sequence(F.lit(0), F.lit((rounds - 1) // ROUNDS_AT_ONCE))).alias("block")
    asked = written(texts, "texts").select(blocks, "texts").unionByName(column.select(blocks, "feature", "at", "y", "value"), allowMissingColumns=True)
    asked = asked.repartition(4 * (1 + (rounds - 1) // ROUNDS_AT_ONCE), "block").sortWithinPartitions("block", F.col("texts").isNull())  # the texts of a block come first
    at_once = ROUNDS_AT_ONCE

    def run(batches):
        for b in batches:
            for r in b.itertuples(index=False):
                own = range(r.block * at_once, min((r.block + 1) * at_once, rounds))
                if r.texts is not None:
                    ids = [t.encode() for t in r.texts]
                    orders = [nn.md5_order(ids, str(i).encode()) for i in own]
                    continue
                at, y, has = np.asarray(r.at, np.int64), np.asarray(r.y), np.zeros(len(ids), bool)
                has[at] = True
                label = np.empty(len(ids), np.int64)
                label[at] = y
                column = nn.Column(np.asarray(r.value, float), y, k)
                mi = [column.mi(label[order[has[order]]]) for order in orders]
                yield pd.DataFrame({"feature": r.feature, "round": list(own), "mi": mi})

    return asked.mapInPandas(run, "feature string, round int, mi double")


def _name() -> Column:
    return F.array_join(F.col("dims").cast("array<string>"), "+").alias("fs")


def _pair() -> list[Column]:
    return [F.col("dims")[0].alias("f1"), F.col("dims")[1].alias("f2")]


def _ksg(vectors: DataFrame, sets: list[tuple[int, ...]], marginals: tuple, k: int, scale: bool = False, by_label: bool = False) -> DataFrame:
    """dims, grp, n, mi: Kraskov, Stoegbauer and Grassberger's first estimator; at least 0 where features are scaled."""
    s = tiles.sums(vectors, sets, marginals, k, by_label=by_label, scale=scale)
    mi = nearest.digamma(F.col("n")) + nearest.digamma(F.lit(k)) - (F.col("s0") + F.col("s1")) / F.col("n")
    return s.select("dims", "grp", "n", (F.when(mi < 0, 0.0).otherwise(mi) if scale else mi).alias("mi"))


def _cmi(vectors: DataFrame, sets: list[tuple[int, ...]], k: int) -> DataFrame:
    s = tiles.sums(vectors, sets, ((0, 2), (1, 2), (2,)), k)
    return s.select("dims", (nearest.digamma(F.lit(k)) - (F.col("s0") + F.col("s1") - F.col("s2")) / F.col("n")).alias("mi"))


def _entropy(vectors: DataFrame, sets: list[tuple[int, ...]], k: int, by_label: bool = False) -> DataFrame:
    s = tiles.sums(vectors, sets, (), k, by_label=by_label, jitter=True)
    d = F.size("dims")
    return s.select("dims", "grp", "n", (nearest.digamma(F.col("n")) - nearest.digamma(F.lit(k)) + d * F.log(F.lit(2.0)) + d * F.col("s0") / F.col("n")).alias("h"))


def _class_entropy(vectors: DataFrame, sets: list[tuple[int, ...]], k: int) -> DataFrame:
    """dims, mi: |H - sum p H within a label| of sets of any sizes."""
    vectors = vectors.where("y is not null")
    return _within_classes(_entropy(vectors, sets, k).drop("grp"), _entropy(vectors, sets, k, by_label=True), ["dims"])


def _by_class(vectors: DataFrame, pairs: list[tuple[int, int]], k: int, scale: bool) -> DataFrame:
    """dims, mi: I(a; b) within labels, each by its share of the rows; a label of k rows or fewer adds nothing."""
    s = _ksg(vectors, pairs, ((0,), (1,)), k, scale, by_label=True)
    return s.groupBy("dims").agg((F.sum(F.col("n") * F.coalesce("mi", F.lit(0.0))) / F.sum("n")).alias("mi"))


def _minus(a: DataFrame, b: DataFrame) -> DataFrame:
    """dims, mi of a less that of b."""
    return a.select("dims", "mi").join(b.select("dims", F.col("mi").alias("less")), "dims").select("dims", (F.col("mi") - F.col("less")).alias("mi"))


def _like(wanted: list[tuple[int, ...]], of: DataFrame, places: tuple[int, ...], name: str) -> DataFrame:
    """dims of each wanted set, and the mi of what stands at some of its places, as ``name``."""
    spark = of.sparkSession
    rows = [(list(s), [s[i] for i in places]) for s in wanted]
    table = spark.createDataFrame(rows, "dims array<int>, part array<int>")  # sets of features are metadata
    return table.join(of.select(F.col("dims").alias("part"), F.col("mi").alias(name)), "part").select("dims", name)


def _methods(method: str, *known: str, sklearn: bool = False) -> None:
    if method == "sklearn" and not sklearn:
        raise NotImplementedError("there is no such estimator")
    if method not in known:
        raise ValueError(f"unknown method {method!r}")


def pair_information(vectors: DataFrame, pairs: list[tuple[int, int]], k: int = 3, method: str = "npeet") -> DataFrame:
    """f1, f2, mi between continuous features; 'metric' is another name of the nearest-neighbour estimator of 'npeet'."""
    _methods(method, "npeet", "sklearn", "metric", sklearn=True)
    return _ksg(vectors, pairs, ((0,), (1,)), k, method == "sklearn").select(*_pair(), "mi")


def joint_information(vectors: DataFrame, sets: list[tuple[int, ...]], k: int = 3, method: str = "npeet") -> DataFrame:
    """fs, mi of sets of features with the label."""
    _methods(method, "npeet", "metric")
    return _class_entropy(vectors, sets, k).select(_name(), "mi")


def joint_information_cc(vectors: DataFrame, sets: list[tuple[int, ...]], k: int = 3, method: str = "npeet") -> DataFrame:
    """fs, mi of sets of features with the last one of each, continuous."""
    _methods(method, "npeet", "metric")
    out = None
    for size in sorted({len(s) for s in sets}):
        some = _ksg(vectors, [s for s in sets if len(s) == size], (tuple(range(size - 1)), (size - 1,)), k).select(_name(), "mi")
        out = some if out is None else out.unionByName(some)
    return out


def conditional_information(vectors: DataFrame, triples: list[tuple[int, int, int]], k: int = 3) -> DataFrame:
    """fs, mi: I(a; b | c)."""
    return _cmi(vectors, triples, k).select(_name(), "mi")


def entropies(vectors: DataFrame, sets: list[tuple[int, ...]], k: int = 3) -> DataFrame:
    """fs, mi: the entropy of each set."""
    return _entropy(vectors, sets, k).select(_name(), F.col("h").alias("mi"))


def decomposed_information(vectors: DataFrame, sets: list[tuple[int, ...]], k: int = 3) -> DataFrame:
    """fs, h, mi: the entropy of each set, and H(X) - sum p H(X | label) with its sign; null where a label has k rows or fewer."""
    vectors = vectors.where("y is not null")
    inner = _entropy(vectors, sets, k, by_label=True).groupBy("dims").agg((F.sum(F.col("n") * F.col("h")) / F.sum("n")).alias("inner"), F.count_if(F.col("h").isNull()).alias("unknown"))
    both = _entropy(vectors, sets, k).join(inner, "dims")
    return both.select(_name(), "h", F.when(F.col("unknown") == 0, F.col("h") - F.col("inner")).alias("mi"))


def _with_label(vectors: DataFrame) -> tuple[DataFrame, int]:
    """The label as one more feature, a number, and its place."""
    vectors = vectors.where("y is not null")
    width = vectors.agg(F.coalesce(F.max(F.size("features")), F.lit(0))).first()[0]
    return vectors.withColumn("features", F.concat("features", F.array(F.col("y").cast("double")))), width


def information_given_label(vectors: DataFrame, pairs: list[tuple[int, int]], k: int = 3) -> DataFrame:
    """f1, f2, mi: I(a; b | label), the label taken as a number."""
    vectors, y = _with_label(vectors)
    return _cmi(vectors, [(*p, y) for p in pairs], k).select(*_pair(), "mi")


def label_information_given(vectors: DataFrame, pairs: list[tuple[int, int]], k: int = 3) -> DataFrame:
    """f1, f2, mi: I(a; label | b), the label taken as a number."""
    vectors, y = _with_label(vectors)
    return _cmi(vectors, [(a, y, b) for a, b in pairs], k).select(F.col("dims")[0].alias("f1"), F.col("dims")[2].alias("f2"), "mi")


def class_conditional_information(vectors: DataFrame, pairs: list[tuple[int, int]], k: int = 3, method: str = "npeet") -> DataFrame:
    """I(a; b | label) of pairs of continuous features: the mean over the classes, each by its share."""
    _methods(method, "npeet", "sklearn", "metric", sklearn=True)
    return _by_class(vectors, pairs, k, method == "sklearn").select(*_pair(), "mi")


def by_marginals(marginals: DataFrame, joint: DataFrame) -> DataFrame:
    """f1, f2, mi: interaction information from what is known.

    marginals: f, mi, the information of single features with the target, worked
    out once for all pairs; joint: fs ('a+b', or 'a+b+c' with the target last),
    mi, that of the pairs.
    """
    a, b = (marginals.select(F.col("f").cast("int").alias(c), F.col("mi").alias(f"mi_{c}")) for c in ("f1", "f2"))
    parts = F.split("fs", r"\+")
    pairs = joint.select(parts[0].cast("int").alias("f1"), parts[1].cast("int").alias("f2"), "mi")
    return pairs.join(a, "f1").join(b, "f2").select("f1", "f2", (F.col("mi_f1") + F.col("mi_f2") - F.col("mi")).alias("mi"))


def interaction_ccd(vectors: DataFrame, pairs: list[tuple[int, int]], k: int = 3, method: str = "npeet") -> DataFrame:
    """f1, f2, mi: interaction information of two features and the label; synergy is negative.

    'npeet' and 'sklearn': I(a; b) less its mean within classes.  'npeet_2'
    takes the label as continuous, and is biased.  'npeet_3': the two marginals
    with the label less the joint one.
    """
    _methods(method, "npeet", "sklearn", "npeet_2", "npeet_3", sklearn=True)
    vectors = vectors.where("y is not null")
    if method == "npeet_3":
        singles = list(dict.fromkeys((f,) for p in pairs for f in p))
        found = _class_entropy(vectors, [*singles, *pairs], k)
        marginals = found.where("size(dims) = 1").select(F.col("dims")[0].alias("f"), "mi")
        return by_marginals(marginals, found.where("size(dims) = 2").select(_name(), "mi"))
    scale = method == "sklearn"
    plain = _ksg(vectors, pairs, ((0,), (1,)), k, scale)
    if method == "npeet_2":
        labelled, place = _with_label(vectors)
        given = _cmi(labelled, [(*p, place) for p in pairs], k)
        return _minus(plain, given.withColumn("dims", F.slice("dims", 1, 2))).select(*_pair(), "mi")
    return _minus(plain, _by_class(vectors, pairs, k, scale)).select(*_pair(), "mi")


def interaction_ccc(vectors: DataFrame, triples: list[tuple[int, int, int]], k: int = 3, method: str = "npeet") -> DataFrame:
    """fs, mi of three continuous features: 'npeet' I(a; b) - I(a; b | c), 'npeet_2' by marginals with c.  What triples share is worked out once."""
    _methods(method, "npeet", "npeet_2")
    ksg = lambda places: _like(triples, _ksg(vectors, [tuple(t[i] for i in places) for t in triples], ((0,), (1,)), k), places, f"mi{places[0]}")
    if method == "npeet":
        return _minus(ksg((0, 1)).withColumnRenamed("mi0", "mi"), _cmi(vectors, triples, k)).select(_name(), "mi")
    joint = _ksg(vectors, triples, ((0, 1), (2,)), k)
    return joint.join(ksg((0, 2)), "dims").join(ksg((1, 2)), "dims").select(_name(), (F.col("mi0") + F.col("mi1") - F.col("mi")).alias("mi"))


def interactions(vectors: DataFrame, sets: list[tuple[int, ...]], k: int = 3, with_label: bool = True) -> DataFrame:
    """fs, ii of every set: signed sum over all its subsets.  A subset that sets share is worked out once."""
    if not with_label and min(map(len, sets)) < 2:
        raise ValueError("needs two features or more")
    parts = [(s, p) for s in sets for r in range(1, len(s) + 1) for p in combinations(s, r)]
    subsets = list(dict.fromkeys(p for _, p in parts))
    terms = joint_information(vectors, subsets, k) if with_label else entropies(vectors, subsets, k)
    name = lambda s: "+".join(map(str, s))
    uses = vectors.sparkSession.createDataFrame([(name(s), name(p), 1.0 if len(p) % 2 else -1.0) for s, p in parts], "ii_of string, fs string, sign double")
    return terms.join(F.broadcast(uses), "fs").groupBy(F.col("ii_of").alias("fs")).agg(F.sum(F.col("sign") * F.col("mi")).alias("ii"))


def interaction(vectors: DataFrame, features: tuple[int, ...], k: int = 3, with_label: bool = True) -> DataFrame:
    """General interaction information: signed sum over all subsets."""
    return interactions(vectors, [features], k, with_label)
