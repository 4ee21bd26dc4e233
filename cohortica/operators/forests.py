"""Trees over binned features: random forests and second-order boosting.

A feature's values are cut into at most ``BINS`` bins.  A level of a tree is
grown from sums of gradients, Hessians and rows by (node, feature, bin): a
split's gain is score(left) + score(right) - score(node), with score G^2 /
(H + lambda).  For a forest the gradient is -w y and the Hessian w, which makes
the gain that of the weighted Gini index.

What is drawn (rows of a tree, features of a tree or of a node) hangs on hashes
of the row, the tree and the node alone, so a tree is the same wherever it is
grown.  Two ways to grow:

* a table of up to ``SMALL_CELLS`` values: every fit of a grid is a task of its
  own, which has the whole table.  Trees are scored as they come, so candidates
  that differ in their number of trees share a fit.
* a taller table: rows stay where they are, the sums are a groupBy per level,
  and the best split of each node is all that comes to the driver.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortica import kernels
from cohortica.operators.order import running, scratch, written

BINS = 256
SMALL_CELLS = 1 << 23  # values of the training rows that one task may hold
TREES_PER_TASK = 25  # of a forest
LEAST_GAIN = 1e-6  # of a boosted split
DEEPEST = 64  # levels of a forest's tree, if it has no bound of its own
_U = np.uint64
_POISSON = np.cumsum([np.exp(-1.0) / np.prod(range(1, i + 1), dtype=float) for i in range(12)])


def mixed(*parts: object) -> np.ndarray:
    """A hash of 64 bits of whole numbers or arrays of them."""
    h = np.zeros(1, _U)
    for p in parts:
        h = h * _U(0x9E3779B97F4A7C15) + np.asarray(p, np.int64).astype(_U) + _U(0xD1B54A32D192ED03)
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> _U(shift))) * _U(by)
        h = h ^ (h >> _U(31))
    return h


def uniform(*parts: object) -> np.ndarray:
    return (mixed(*parts) >> _U(11)).astype(float) / (1 << 53)


@dataclass(frozen=True)
class Rules:
    """What a family's parameters mean for growing; None is no bound."""

    boosting: bool
    depth: int | None
    rate: float = 1.0  # what a boosted tree adds
    lam: float = 0.0
    child: float = 0.0  # least Hessian of a child (boosting)
    leaf: int = 1  # least rows of a child (forest)
    split: int = 2  # least rows of a node that is split (forest)
    rows: float = 1.0  # share of rows of a boosted tree
    columns: float = 1.0  # share of features of a boosted tree
    at_node: str | float = 1.0  # features of a node (forest): 'sqrt' or a share
    positive: float = 1.0  # weight of label 1 (boosting)


def rules(family: str, params: dict, negatives: int, positives: int) -> Rules:
    if family == "rf":
        return Rules(False, params["maxDepth"], leaf=params["minInstancesPerNode"], split=params["minSplit"], at_node=params["featureSubsetStrategy"])
    weight = negatives / positives if params["balance"] and positives else 1.0
    return Rules(True, params["maxDepth"], params["stepSize"], params["regLambda"], params["minChildWeight"], rows=params["subsamplingRate"], columns=params["colsampleByTree"], positive=weight)


class _Walked:
    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        return self._walk(bins, *self.nodes()[:3])

    def predict(self, bins: np.ndarray) -> np.ndarray:
        feature, at, left, value = self.nodes()
        return value[self._walk(bins, feature, at, left)]

    @staticmethod
    def _walk(bins: np.ndarray, feature: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
        node = np.zeros(len(bins), np.int64)
        rows = np.arange(len(bins))
        while len(rows):
            rows = rows[feature[node[rows]] >= 0]
            n = node[rows]
            node[rows] = left[n] + (bins[rows, feature[n]] > at[n])
        return node


@dataclass
class Tree(_Walked):
    """Nodes: a row goes left where its bin of ``feature`` is at most ``bin``; leaves (feature -1) have values."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def divide(self, node: int, feature: int, at: int) -> int:
        """Makes two leaves of a leaf; the right one follows the left one."""
        self.feature[node], self.bin[node], self.left[node] = feature, at, len(self.feature)
        for part, new in ((self.feature, -1), (self.bin, 0), (self.left, 0), (self.value, 0.0)):
            part += [new, new]
        return self.left[node]

    def nodes(self) -> tuple[np.ndarray, ...]:
        return tuple(np.array(x) for x in (self.feature, self.bin, self.left, self.value))


@dataclass
class Packed(_Walked):
    """A tree as the kernel gives it: a byte a node for the feature (255: a leaf) and for the bin, and the leaves' values."""

    features: bytes
    bins: bytes
    values: bytes

    @property
    def feature(self) -> list[int]:
        return self.nodes()[0].tolist()

    @property
    def bin(self) -> list[int]:
        return self.nodes()[1].tolist()

    def nodes(self) -> tuple[np.ndarray, ...]:
        feature, at = (np.frombuffer(x, np.uint8).astype(np.int64) for x in (self.features, self.bins))
        leaf = feature == 255
        feature[leaf], value = -1, np.zeros(len(leaf))
        value[leaf] = np.frombuffer(self.values, "<f8")
        return feature, at, np.where(leaf, 0, 2 * np.cumsum(~leaf) - 1), value


@dataclass
class Model:
    boosting: bool
    edges: list[np.ndarray]
    trees: list[Tree | Packed]

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1."""
        total = np.zeros(len(x))
        bins = binned(x, self.edges)
        for t in self.trees:
            total += t.predict(bins)
        return 1 / (1 + np.exp(-total)) if self.boosting else total / max(1, len(self.trees))


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """edges: the greatest value of each bin; what is greater than all belongs to the last."""
    out = np.zeros(x.shape, np.int64)
    for j, e in enumerate(edges):
        out[:, j] = np.minimum(np.searchsorted(e, x[:, j], "left"), max(0, len(e) - 1))
    return out


def edges_of(train: DataFrame) -> list[np.ndarray]:
    """Of (x array): each value is a bin if a feature has ``BINS`` at most, and else as many values as have alike many rows before them."""
    values = train.select(F.posexplode("x").alias("f", "v")).groupBy("f", "v").agg(F.count(F.lit(1)).alias("n"))
    placed = running(values, ["f"], ["v"], before=F.col("n"), rank=F.lit(1))
    total = placed.groupBy("f").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("distinct"))
    b = F.when(F.col("distinct") <= BINS, F.col("rank")).otherwise(F.floor(F.col("before") * BINS / F.col("rows")))
    cut = placed.join(F.broadcast(total), "f").groupBy("f", b.alias("b")).agg(F.max("v").alias("v"))  # a row a feature
    found = {r["f"]: np.array(r["e"], float) for r in cut.groupBy("f").agg(F.array_sort(F.collect_list("v")).alias("e")).collect()}  # BINS numbers a feature at most
    return [found[f] for f in range(len(found))]


def _drawn(rule: Rules, key: np.ndarray, y: np.ndarray, margin: np.ndarray, seed: int, tree: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of a tree, and their gradients and Hessians.  A forest's rows are drawn with Poisson weights, the labels balanced among them by ``_balance``."""
    u = uniform(seed, tree, key)
    if rule.boosting:
        rows = np.flatnonzero(u < rule.rows)
        p = 1 / (1 + np.exp(-margin[rows]))
        w = np.where(y[rows] == 1, rule.positive, 1.0)
        return rows, w * (p - y[rows]), w * p * (1 - p)
    times = np.searchsorted(_POISSON, u, "right")
    rows = np.flatnonzero(times)
    return rows, times[rows].astype(float), times[rows].astype(float)


def _balance(count: dict[int, float]) -> dict[int, float]:
    total = sum(count.values())
    return {c: total / (len(count) * n) for c, n in count.items() if n}


def _candidates(rule: Rules, seed: int, tree: int, nodes: list[int], width: int, varies: np.ndarray) -> np.ndarray:
    """(nodes, features): what may be split; varies: features that differ within a node, of which alone a forest draws."""
    if rule.boosting:
        few = max(1, int(rule.columns * width))
        chosen = np.zeros(width, bool)
        chosen[np.argsort(mixed(seed, tree, -1, np.arange(width)), kind="stable")[:few]] = True
        return np.broadcast_to(chosen, varies.shape)
    few = max(1, int(np.sqrt(width)) if rule.at_node == "sqrt" else int(float(rule.at_node) * width))
    order = mixed(seed, tree, np.array(nodes)[:, None], np.arange(width)[None, :])
    order = np.where(varies, order, np.iinfo(_U).max)
    kth = np.sort(order, axis=1)[:, min(few, width) - 1][:, None]
    return varies & (order <= kth)


def _sums(keys: np.ndarray, size: int, *weights: np.ndarray) -> tuple[np.ndarray, ...]:
    """The keys (below ``size``) that occur, in order, how often, and the sums of each weight."""
    if size <= 8 * len(keys):
        count = np.bincount(keys, minlength=size)
        held = np.flatnonzero(count)
        return held, count[held], *(np.bincount(keys, w, size)[held] for w in weights)
    held, inv, count = np.unique(keys, return_inverse=True, return_counts=True)
    return held, count, *(np.bincount(inv, w) for w in weights)


def _splits(rule: Rules, node: np.ndarray, feature: np.ndarray, keys: np.ndarray, size: int, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes worth a split, and feature and bin of the best one of each, the first of equals.

    node, feature: of each pair that may be split, in this order; keys: pair * size
    + bin of each row and pair; g, h: its gradient and Hessian.
    """
    held, c, g, h = _sums(keys, len(node) * size, g, h)
    pair = held // size
    first = np.searchsorted(pair, np.arange(len(node)))
    parts = []
    for x in (g, h, c):
        up = np.cumsum(x)
        before = np.concatenate([[0], up])[first]
        total = np.diff(np.append(before, up[-1]))[pair]
        parts.append((up - before[pair], total))
    (gl, g), (hl, h), (cl, c) = parts
    gr, hr, cr = g - gl, h - hl, c - cl
    ok = cr > 0
    if rule.boosting:
        ok &= (hl >= rule.child) & (hr >= rule.child)
    else:
        ok &= (cl >= rule.leaf) & (cr >= rule.leaf) & (c >= rule.split)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = gl * gl / (hl + rule.lam) + gr * gr / (hr + rule.lam) - g * g / (h + rule.lam)
    ok &= ~np.isnan(gain)
    at = np.flatnonzero(ok)
    if not len(at):
        return at, at, at
    gain, of = np.round(gain[at], 10), node[pair[at]]
    nodes, start = np.unique(of, return_index=True)
    best = np.maximum.reduceat(gain, start)
    hit = np.flatnonzero(gain == np.repeat(best, np.diff(np.append(start, len(of)))))
    hit = hit[np.unique(of[hit], return_index=True)[1]]
    worth = best > (LEAST_GAIN if rule.boosting else -1.0)
    at = at[hit][worth]
    return nodes[worth], feature[pair[at]], held[at] % size


def _leaf(rule: Rules, g: float, h: float) -> float:
    return (-g / (h + rule.lam) if h + rule.lam > 0 else 0.0) * (rule.rate if rule.boosting else 1.0)


def grow(rule: Rules, bins: np.ndarray, y: np.ndarray, key: np.ndarray, margin: np.ndarray, seed: int, number: int, size: int) -> Tree:
    """A tree of a table in memory."""
    rows, g, h = _drawn(rule, key, y, margin, seed, number)
    if not rule.boosting:
        weights = _balance({c: h[y[rows] == c].sum() for c in (0, 1)})
        h = h * np.array([weights.get(c, 0.0) for c in (0, 1)])[y[rows]]
        g = -h * y[rows]
    tree, width = Tree(), bins.shape[1]
    tree.value[0] = _leaf(rule, g.sum(), h.sum())
    active, slot, depth = [0], np.zeros(len(rows), np.int64), 0
    chosen = _candidates(rule, seed, number, [0], width, np.ones((1, width), bool))[0]
    while active and len(rows) and depth < (rule.depth or DEEPEST):
        a, own = len(active), bins[rows]
        if rule.boosting:
            allowed = np.broadcast_to(chosen, (a, width))
        else:  # what differs within nodes of both labels
            order = np.argsort(slot, kind="stable")
            start = np.searchsorted(slot[order], np.arange(a))
            varies = np.minimum.reduceat(own[order], start) < np.maximum.reduceat(own[order], start)
            gs, hs = np.bincount(slot, g, a), np.bincount(slot, h, a)
            allowed = varies & _candidates(rule, seed, number, active, width, varies) & ((np.abs(gs) > 1e-9) & (np.abs(gs + hs) > 1e-9))[:, None]
        node, feature = np.nonzero(allowed)
        if not len(node):
            break
        number_of = np.full((a, width), -1)
        number_of[node, feature] = np.arange(len(node))
        pair = number_of[slot]
        i, j = np.nonzero(pair >= 0)
        split, f, b = _splits(rule, node, feature, pair[i, j] * size + own[i, j], size, g[i], h[i])
        new, at_f, at_b, fresh = np.full(a, -1), np.zeros(a, np.int64), np.zeros(a, np.int64), []
        new[split], at_f[split], at_b[split] = 2 * np.arange(len(split)), f, b
        for n, x, y_ in zip(split.tolist(), f.tolist(), b.tolist(), strict=True):
            left = tree.divide(active[n], x, y_)
            fresh += [left, left + 1]
        keep = new[slot] >= 0
        rows, g, h, slot, own = rows[keep], g[keep], h[keep], slot[keep], own[keep]
        slot = new[slot] + (own[np.arange(len(rows)), at_f[slot]] > at_b[slot])
        gs, hs = np.bincount(slot, g, len(fresh)), np.bincount(slot, h, len(fresh))
        for n, x, y_ in zip(fresh, gs.tolist(), hs.tolist(), strict=True):
            tree.value[n] = _leaf(rule, x, y_)
        active, depth = fresh, depth + 1
    return tree


def auc(y: np.ndarray, score: np.ndarray) -> float:
    """By ranks, equal scores sharing theirs; 0 where a label is missing."""
    pos = int((y == 1).sum())
    if not pos or pos == len(y):
        return 0.0
    _, inv, count = np.unique(score, return_inverse=True, return_counts=True)
    rank = (np.cumsum(count) - (count - 1) / 2)[inv]
    return float((rank[y == 1].sum() - pos * (pos + 1) / 2) / (pos * (len(y) - pos)))


def _staged(rule: Rules, x: tuple, edges: list[np.ndarray], trees: int, seed: int) -> Iterator[tuple[int, Tree]]:
    values, y, key = x
    bins, margin = binned(values, edges), np.zeros(len(y))
    size = max([len(e) for e in edges], default=1)
    for t in range(trees):
        tree = grow(rule, bins, y, key, margin, seed, t, size)
        if rule.boosting:
            margin += tree.predict(bins)
        yield t + 1, tree


def _held(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values, labels and keys of rows (row_id, y, x) whose number of cells was checked, in an order of their own."""
    pdf = rows.select("y", "x", F.xxhash64("row_id").alias("key")).toPandas().sort_values("key")
    return np.array(pdf["x"].tolist(), float).reshape(len(pdf), -1), pdf["y"].to_numpy(np.int64), pdf["key"].to_numpy(np.int64)


def small(rows: DataFrame) -> bool:
    n, width = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("x")), F.lit(0))).first()
    return n * width <= SMALL_CELLS


def _fast(spark: SparkSession, edges: list[np.ndarray]) -> bool:
    """Whether the kernel ``Trees`` can grow them: it has a byte for a feature and for a bin."""
    return 0 < len(edges) < 255 and max(map(len, edges)) <= 256 and kernels.ready(spark, "Trees")


def _table(spark: SparkSession, edges: list[np.ndarray], t: tuple, v: tuple | None = None) -> DataFrame:
    """The one row that the kernel has of a table, and of the rows that it scores; see there."""
    v = v or (np.zeros((0, len(edges))), np.zeros(0, np.int64), None)
    head = np.array([len(t[1]), len(edges), max(map(len, edges)), len(v[1])], "<i4")
    held = b"".join(x.tobytes() for x in (head, binned(t[0], edges).astype(np.uint8), t[1].astype(np.uint8), t[2].astype("<i8"), binned(v[0], edges).astype(np.uint8), v[1].astype(np.uint8)))
    return F.broadcast(spark.createDataFrame([(held,)], "held binary"))


def _job(rule: Rules, width: int, seed: int, trees: range, stages: Iterable[int] = ()) -> bytes:
    few = rule.columns * width if rule.boosting else np.sqrt(width) if rule.at_node == "sqrt" else float(rule.at_node) * width
    whole = [trees.start, trees.stop, int(rule.boosting), rule.depth or 0, rule.leaf, rule.split, max(1, int(few))]
    real = [rule.rate, rule.lam, rule.child, rule.rows, rule.positive, LEAST_GAIN if rule.boosting else -1.0, *_POISSON]
    return b"".join(np.array(x, kind).tobytes() for x, kind in (([seed], "<i8"), (whole, "<i4"), (real, "<f8"), ([len(stages), *stages], "<i4")))


def _read(found: bytes) -> Iterator[Packed]:
    at = 0
    while at < len(found):
        n = int.from_bytes(found[at : at + 4], "little")
        features, bins = found[at + 4 : at + 4 + n], found[at + 4 + n : at + 4 + 2 * n]
        at += 4 + 2 * n
        yield Packed(features, bins, found[at : (at := at + 8 * features.count(b"\xff"))])


def grid_scores(family: str, grid: list[dict], trees: str, train: DataFrame, val: DataFrame, seed: int) -> list[float]:
    """AUC on the validation rows of every candidate, in full; ``trees``: the parameter that says how many trees.  Small tables."""
    spark = train.sparkSession
    edges = edges_of(train)
    t, v = _held(train), _held(val)
    fits: dict[tuple, dict[int, list[int]]] = {}
    for i, c in enumerate(grid):
        fits.setdefault(tuple((k, x) for k, x in c.items() if k != trees), {}).setdefault(c[trees], []).append(i)
    ruled = [(i, rules(family, dict(p), int((t[1] == 0).sum()), int((t[1] == 1).sum())), stages) for i, (p, stages) in enumerate(fits.items())]

    if _fast(spark, edges):
        asked = [(i, _job(rule, len(edges), seed, range(max(stages)), sorted(stages))) for i, rule, stages in ruled]
        jobs = spark.createDataFrame(spark.sparkContext.parallelize(asked, len(asked)), "fit int, job binary")  # candidates are metadata; a fit a task
        found = jobs.crossJoin(_table(spark, edges, t, v)).select("fit", kernels.call("Trees", "held", "job").alias("found")).collect()
        scores = {c: s for r in found for n, s in zip(sorted(ruled[r["fit"]][2]), np.frombuffer(r["found"], "<f8"), strict=True) for c in ruled[r["fit"]][2][n]}
        return [float(scores[i]) for i in range(len(grid))]

    shared = spark.sparkContext.broadcast((t, v, edges))
    jobs = spark.createDataFrame([(i, pickle.dumps((rule, stages))) for i, rule, stages in ruled], "fit int, job binary")  # candidates are metadata

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t, v, edges = shared.value
        ahead = binned(v[0], edges)
        for b in batches:
            for job in b["job"]:
                rule, stages = pickle.loads(job)
                total, out = np.zeros(len(ahead)), []
                for n, tree in _staged(rule, t, edges, max(stages), seed):
                    total += tree.predict(ahead)
                    out += [(i, auc(v[1], np.round(total, 12))) for i in stages.get(n, ())]
                yield pd.DataFrame(out, columns=["candidate", "auc"])

    found = jobs.repartition(len(fits), "fit").mapInPandas(run, "candidate int, auc double").collect()
    return [s for _, s in sorted((r["candidate"], r["auc"]) for r in found)]


def fit_small(family: str, params: dict, trees: str, train: DataFrame, seed: int) -> Model:
    """One task grows a boosted model; a forest's trees are dealt over tasks."""
    spark = train.sparkSession
    edges = edges_of(train)
    t = _held(train)
    rule, count = rules(family, params, int((t[1] == 0).sum()), int((t[1] == 1).sum())), params[trees]
    if _fast(spark, edges):
        step = count if rule.boosting else TREES_PER_TASK
        parts = [range(a, min(a + step, count)) for a in range(0, count, step)]
        asked = [(a.start, _job(rule, len(edges), seed, a)) for a in parts]
        jobs = spark.createDataFrame(spark.sparkContext.parallelize(asked, max(1, len(asked))), "first int, job binary")
        grown = jobs.crossJoin(_table(spark, edges, t)).select("first", kernels.call("Trees", "held", "job").alias("grown")).collect()
        return Model(rule.boosting, edges, [tree for r in sorted(grown, key=lambda r: r["first"]) for tree in _read(r["grown"])])

    shared = spark.sparkContext.broadcast((t, edges))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _ in batches:
            t, edges = shared.value
            yield pd.DataFrame({"model": [pickle.dumps([x for _, x in _staged(rule, t, edges, count, seed)])]})

    grown = spark.range(0, 1, 1, 1).mapInPandas(run, "model binary").first()[0]
    return Model(rule.boosting, edges, pickle.loads(grown))


# -- tall tables ------------------------------------------------------------


def _tall_splits(rule: Rules, state: DataFrame, active: list[int], seed: int, number: int, width: int) -> list:
    """node, f, b, worth of each active node, by sums of (node, feature, bin) and running sums over the bins."""
    sums = state.where(F.col("node").isin(active)).select("node", "g", "h", F.posexplode("bins").alias("f", "b")).groupBy("node", "f", "b")
    sums = sums.agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.count(F.lit(1)).alias("c"))
    whole = Window.partitionBy("node", "f")
    line = whole.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)  # BINS rows at most
    own = sums.select("node", "f", "b", *[F.sum(x).over(w).alias(f"{x}{s}") for x in "ghc" for s, w in (("l", line), ("t", whole))], F.count(F.lit(1)).over(whole).alias("held"))
    if rule.boosting:
        chosen = _candidates(rule, seed, number, [0], width, np.ones((1, width), bool))[0]
        own = own.where(F.col("f").isin(np.flatnonzero(chosen).tolist()))
    else:
        few = max(1, int(np.sqrt(width)) if rule.at_node == "sqrt" else int(float(rule.at_node) * width))

        def order(node: pd.Series, f: pd.Series) -> pd.Series:
            return pd.Series((mixed(seed, number, node.to_numpy(), f.to_numpy()) ^ _U(1 << 63)).view(np.int64))  # signed, in the same order

        varying = own.where("held > 1")
        drawn = varying.select("node", "f").distinct().withColumn("o", F.pandas_udf(order, "bigint")("node", "f"))
        drawn = drawn.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy("o"))).where(F.col("r") <= few).select("node", "f")  # features of a node
        own = varying.join(drawn, ["node", "f"])
    lam = F.lit(float(rule.lam))
    gr, hr, cr = (F.col(f"{x}t") - F.col(f"{x}l") for x in "ghc")
    per = lambda g, h: F.when(h + lam != 0, g * g / (h + lam))
    gain = F.round(per(F.col("gl"), F.col("hl")) + per(gr, hr) - per(F.col("gt"), F.col("ht")), 10)
    ok = cr > 0
    ok = ok & (F.col("hl") >= rule.child) & (hr >= rule.child) if rule.boosting else ok & (F.col("cl") >= rule.leaf) & (cr >= rule.leaf) & (F.col("ct") >= rule.split) & (F.abs("gt") > 1e-9) & (F.abs(F.col("gt") + F.col("ht")) > 1e-9)
    best = own.where(ok).select("node", F.struct(gain.alias("gain"), (-F.col("f")).alias("f"), (-F.col("b")).alias("b")).alias("s")).groupBy("node").agg(F.max("s").alias("s"))
    return best.select("node", (-F.col("s.f")).alias("f"), (-F.col("s.b")).alias("b")).where(F.col("s.gain") > (LEAST_GAIN if rule.boosting else -1.0)).collect()  # a row a node


def grow_tall(rule: Rules, rows: DataFrame, seed: int, number: int, width: int) -> Tree:
    """A tree of rows (key, y, margin, bins): a job per level, whose result is a split a node."""

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at, g, h = _drawn(rule, b["key"].to_numpy(np.int64), b["y"].to_numpy(np.int64), b["margin"].to_numpy(float), seed, number)
            yield pd.DataFrame({"key": b["key"].iloc[at], "y": b["y"].iloc[at], "g": g, "h": h, "bins": b["bins"].iloc[at]})

    drawn = rows.select("key", "y", "margin", "bins").mapInPandas(draw, "key bigint, y int, g double, h double, bins array<int>")
    if not rule.boosting:
        weights = _balance({r["y"]: r["n"] for r in drawn.groupBy("y").agg(F.sum("h").alias("n")).collect()})  # two rows
        weight = F.coalesce(*[F.when(F.col("y") == c, w) for c, w in weights.items()], F.lit(0.0)) * F.col("h")
        drawn = drawn.select("key", "y", (-weight * F.col("y")).alias("g"), weight.alias("h"), "bins")
    drawn = written(drawn, "drawn")
    tree = Tree()
    active, depth = [0], 0
    while active and depth < (rule.depth or DEEPEST):
        found = _tall_splits(rule, drawn.withColumn("node", _of_bins(tree.leaves, "int")), active, seed, number, width)
        active = [n for s in sorted(found, key=lambda s: s["node"]) for left in [tree.divide(s["node"], s["f"], s["b"])] for n in (left, left + 1)]
        depth += 1
    ends = drawn.groupBy(_of_bins(tree.leaves, "int").alias("leaf")).agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()  # leaves
    for r in ends:
        tree.value[r["leaf"]] = _leaf(rule, r["g"], r["h"])
    return tree


def _of_bins(f, kind: str) -> Column:
    """f of the rows' bins."""

    def run(bins: pd.Series) -> pd.Series:
        return pd.Series(f(np.array(bins.tolist(), np.int64).reshape(len(bins), -1)))

    return F.pandas_udf(run, kind)("bins")


def fit_tall(family: str, params: dict, trees: str, train: DataFrame, seed: int) -> Model:
    """Rows (row_id, y, x) stay distributed; the margins of boosting are written anew every ten trees."""
    edges = edges_of(train)
    count = {r["y"]: r["n"] for r in train.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    rule = rules(family, params, count.get(0, 0), count.get(1, 0))

    def bins(x: pd.Series) -> pd.Series:
        return pd.Series(list(binned(np.array(x.tolist(), float).reshape(len(x), -1), edges)))

    rows = written(train.select(F.xxhash64("row_id").alias("key"), F.col("y").cast("int").alias("y"), F.lit(0.0).alias("margin"), F.pandas_udf(bins, "array<int>")("x").alias("bins")), "binned")
    model = Model(rule.boosting, edges, [])
    for t in range(params[trees]):
        with scratch():
            tree = grow_tall(rule, rows, seed, t, len(edges))
        model.trees.append(tree)
        if rule.boosting:
            rows = rows.withColumn("margin", F.col("margin") + _of_bins(tree.predict, "double"))
            if t % 10 == 9:
                rows = written(rows, "binned")
    return model


def scored(model: Model, rows: DataFrame) -> DataFrame:
    """row_id, label, score, pred of rows (row_id, y, x)."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(x: pd.Series) -> pd.Series:
        return pd.Series(shared.value.scores(np.array(x.tolist(), float).reshape(len(x), -1)))

    score = F.pandas_udf(run, "double")("x")
    return rows.select("row_id", F.col("y").alias("label"), score.alias("score")).withColumn("pred", (F.col("score") >= 0.5).cast("int"))
