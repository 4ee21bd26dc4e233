"""Distances to the k-th neighbour, and counts of points within a distance, by the max norm, exact, for tables of any height.

In one dimension rows are numbered along the line and cut into blocks that also
hold the k rows beyond each end, so neighbours are lag and lead within a block;
counts are running sums over points and the ends of all intervals, sorted
together.

In more dimensions the points of a group are dealt to cells: equal parts along
the first dimension, each of these in equal parts along the second, and so on.
As parts go by place and not by value, a cell never holds more than
``CELL_ROWS`` points, ties included.  A point's distance within its own cell
bounds its true one; it then visits the cells that its ball touches.  For
counts, cells that lie wholly in the ball add the number of their points, and
only those that it cuts are visited.  A cell that many visit is copied, and its
visitors are dealt over the copies.

Distances are compared as they are computed, so ties count alike everywhere:
"within r" is |a - b| < r in every dimension, or equal points where r is 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortica.operators.order import running, scratch, written

LINE_ROWS = 4096  # rows of a block of a line, besides its ends
CELL_ROWS = 1024  # points of a cell at most
VISITORS = 4096  # visitors of one copy of a cell, about
_DENSE = 1 << 21  # distances that are in memory at once
_TINY = 5e-324  # |a - b| < _TINY: equal


def digamma(n: Column) -> Column:
    """Of positive whole numbers, by its series from n + 8 on."""
    m = n + F.lit(8.0)
    back = F.lit(0.0)
    for i in range(8):
        back = back + 1 / (n + F.lit(float(i)))
    s = 1 / (m * m)
    return F.log(m) - 1 / (2 * m) - s * (1 / 12.0 - s * (1 / 120.0 - s * (1 / 252.0 - s * (1 / 240.0 - s / 132.0)))) - back


def line_radius(points: DataFrame, by: list[str], value: str, ident: str, k: int) -> DataFrame:
    """Adds place (number along the line), radius (distance to the kk-th neighbour) and kk, the lesser of k and the other rows of the group.

    ``ident`` orders equal values.  A row alone in its group has kk = 0 and no radius.
    """
    size = max(LINE_ROWS, 2 * k)
    placed = running(points, by, [value, ident], place=F.lit(1))
    at = F.col("place") % size
    own = F.floor(F.col("place") / size)
    blocks = F.array_compact(F.array(own, F.when((at < k) & (own > 0), own - 1), F.when(at >= size - k, own + 1)))
    line = Window.partitionBy(*by, "block").orderBy("place")
    rows = placed.select("*", own.alias("own_block"), F.explode(blocks).alias("block"))
    near = [F.col(value) - F.lag(value, i).over(line) for i in range(1, k + 1)] + [F.lead(value, i).over(line) - F.col(value) for i in range(1, k + 1)]
    rows = rows.withColumn("near", F.array_sort(F.array_compact(F.array(*near)))).where("block = own_block").drop("block", "own_block")
    kk = F.least(F.lit(k), F.size("near"))
    return rows.withColumn("kk", kk).withColumn("radius", F.when(F.col("kk") > 0, F.element_at("near", F.greatest("kk", F.lit(1))))).drop("near")


def _as_integers(x: np.ndarray) -> np.ndarray:
    """Doubles as integers of the same order."""
    i = (x + 0.0).view(np.int64)
    return np.where(i < 0, np.int64(-(2**63)) - i, i)


def _as_doubles(i: np.ndarray) -> np.ndarray:
    return np.where(i < 0, np.int64(-(2**63)) - i, i).view(np.float64)


def interval(x: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest double v with |v - x| < r (at r = 0: = x), as the difference is computed."""
    r = np.maximum(r, _TINY)
    lo_in, hi_in = _as_integers(x), _as_integers(x)
    lo_out, hi_out = np.full(len(x), _as_integers(np.array([-np.inf]))[0]), np.full(len(x), _as_integers(np.array([np.inf]))[0])
    with np.errstate(invalid="ignore", over="ignore"):
        for _ in range(64):
            mid = (hi_in >> 1) + (hi_out >> 1) + (hi_in & hi_out & 1)
            ok = _as_doubles(mid) - x < r
            hi_in, hi_out = np.where(ok, mid, hi_in), np.where(ok, hi_out, mid)
            mid = (lo_in >> 1) + (lo_out >> 1) + (lo_in & lo_out & 1)
            ok = x - _as_doubles(mid) < r
            lo_in, lo_out = np.where(ok, mid, lo_in), np.where(ok, lo_out, mid)
    return _as_doubles(lo_in), _as_doubles(hi_in)


def _ends(value: Column, r: Column) -> Column:
    def run(x: pd.Series, r: pd.Series) -> pd.DataFrame:
        lo, hi = interval(x.to_numpy(float), r.to_numpy(float))
        return pd.DataFrame({"lo": lo, "hi": hi})

    return F.pandas_udf(run, "lo double, hi double")(value, r)


def line_counts(points: DataFrame, queries: DataFrame, by: list[str], value: str, keys: list[str]) -> DataFrame:
    """by, keys, held: points of the query's group within its radius, the query's own point among them.

    points: by, value; queries: by, keys, value, radius (never null), keys unique within a group.
    """
    named = [F.col(c) for c in by]
    ids = [F.col(c) for c in keys]
    counted = points.groupBy(*by, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("one"))  # a frequent value is a row
    ends = queries.select(*named, *ids, _ends(F.col(value), F.col("radius")).alias("e"))
    ends = ends.select(*named, *ids, F.explode(F.array(F.struct(F.col("e.lo").alias("v"), F.lit(0).alias("kind")), F.struct(F.col("e.hi").alias("v"), F.lit(2).alias("kind")))).alias("p"))
    ends = ends.select(*named, *ids, "p.v", "p.kind", F.lit(0).cast("bigint").alias("one"))
    line = counted.withColumn("kind", F.lit(1)).unionByName(ends, allowMissingColumns=True)  # at one place: lower ends, points, upper ends
    placed = running(line, by, ["v", "kind", *keys], ahead=F.col("one")).where("kind <> 1")
    return placed.groupBy(*by, *keys).agg(F.sum(F.when(F.col("kind") == 2, F.col("ahead")).otherwise(-F.col("ahead"))).cast("bigint").alias("held"))


# -- more dimensions --------------------------------------------------------


def _part(n: Column, dims: int) -> Column:
    """Equal parts along each dimension, so that a cell has no more than CELL_ROWS of n points."""
    return F.greatest(F.lit(1), F.ceil(F.pow(F.ceil(n / F.lit(CELL_ROWS)), F.lit(1.0 / dims)) - 1e-9)).cast("bigint")


def cells(points: DataFrame, by: list[str], dims: int, ident: str) -> DataFrame:
    """points (by, ident, x array<double>) with cell, unique within the group, and slab, the part along the first dimension."""
    with scratch() as keep:
        out = points.withColumn("cell", F.lit(0).cast("bigint"))
        sizes = points.groupBy(*by).agg(_part(F.count(F.lit(1)), dims).alias("parts"))
        total = sizes.withColumnsRenamed({c: f"{c}_g" for c in by})
        for d in range(dims):
            out = running(out.withColumn("v", F.col("x")[d]), [*by, "cell"], ["v", ident], place=F.lit(1))
            held = out.groupBy(*by, "cell").agg(F.count(F.lit(1)).alias("n")).withColumnsRenamed({c: f"{c}_h" for c in [*by, "cell"]})  # a row a cell
            out = out.join(held, [F.col(c).eqNullSafe(F.col(f"{c}_h")) for c in [*by, "cell"]]).join(total, [F.col(c).eqNullSafe(F.col(f"{c}_g")) for c in by])
            cell = F.col("cell") * F.col("parts") + F.floor(F.col("place") * F.col("parts") / F.col("n"))
            out = out.select(*by, ident, "x", cell.alias("cell"), (cell if d == 0 else F.col("slab")).alias("slab"))
        return keep(written(out, "cells"))


def _slabs(celled: DataFrame, by: list[str], dims: int) -> DataFrame:
    """A row per slab: by, slab, lo and hi of its first dimension, and its cells with their boxes and numbers of points."""
    ends = [f(F.col("x")[d]).alias(f"{n}{d}") for d in range(dims) for n, f in (("lo", F.min), ("hi", F.max))]
    boxes = celled.groupBy(*by, "slab", "cell").agg(F.count(F.lit(1)).alias("n"), *ends)
    box = F.struct("cell", "n", F.array(*[F.col(f"lo{d}") for d in range(dims)]).alias("lo"), F.array(*[F.col(f"hi{d}") for d in range(dims)]).alias("hi"))
    return boxes.groupBy(*by, "slab").agg(F.min("lo0").alias("lo"), F.max("hi0").alias("hi"), F.collect_list(box).alias("cells"))  # sqrt of the cells in two dimensions, and not more than CELL_ROWS until there are a billion points


def _met(queries: DataFrame, celled: DataFrame, by: list[str], dims: int) -> DataFrame:
    """Queries (by, key, x, radius) with a row per slab that their ball touches, and the slab's cells that it touches."""
    slabs = written(_slabs(celled, by, dims), "slabs").withColumnsRenamed({c: f"{c}_s" for c in [*by, "slab"]})
    r = F.greatest(F.col("radius"), F.lit(_TINY))
    group = slabs.groupBy(*[f"{c}_s" for c in by]).agg(F.collect_list(F.struct("slab_s", "lo", "hi")).alias("all"))
    group = group.withColumnsRenamed({f"{c}_s": f"{c}_q" for c in by})
    near = F.filter("all", lambda s: (s["lo"] - F.col("x")[0] < r) & (F.col("x")[0] - s["hi"] < r))
    q = queries.join(group, [F.col(c).eqNullSafe(F.col(f"{c}_q")) for c in by]).select(*queries.columns, F.explode(F.transform(near, lambda s: s["slab_s"])).alias("in_slab"))
    q = q.join(slabs, [F.col("in_slab") == F.col("slab_s"), *(F.col(c).eqNullSafe(F.col(f"{c}_s")) for c in by)])

    def touches(c: Column) -> Column:
        out = F.lit(True)
        for d in range(dims):
            out = out & (c["lo"][d] - F.col("x")[d] < r) & (F.col("x")[d] - c["hi"][d] < r)
        return out

    return q.select(*queries.columns, F.filter("cells", touches).alias("cells"))


def _visited(visits: DataFrame, celled: DataFrame, by: list[str], run, schema: str) -> DataFrame:
    """run(visitors, points) for each copy of a cell; visits: by, cell, key, x, radius."""
    copies = visits.groupBy(*by, "cell").agg(F.ceil(F.count(F.lit(1)) / VISITORS).alias("copies"))
    copies = written(copies, "copies").withColumnsRenamed({c: f"{c}_c" for c in [*by, "cell"]})
    on = [F.col(c).eqNullSafe(F.col(f"{c}_c")) for c in [*by, "cell"]]
    to = visits.join(copies, on).select(*by, "cell", F.pmod(F.xxhash64("key"), F.col("copies")).alias("copy"), "key", "x", "radius")
    of = celled.join(copies, on).select(*by, "cell", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1)).alias("copy"), F.lit(None).cast("bigint").alias("key"), "x", F.lit(None).cast("double").alias("radius"))

    def both(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf["key"].isna().to_numpy()
        ask = pdf[~own]
        points = np.array(pdf.loc[own, "x"].tolist(), float)
        out = run(np.array(ask["x"].tolist(), float).reshape(len(ask), points.shape[1]), ask["radius"].to_numpy(float), points)
        made = pd.DataFrame({c: [pdf[c].iloc[0]] * len(ask) for c in by})
        made["key"] = ask["key"].to_numpy(np.int64)
        made["found"] = out
        return made

    kinds = ", ".join(f"{c} {celled.schema[c].dataType.simpleString()}" for c in by)
    return to.unionByName(of).groupBy(*by, "cell", "copy").applyInPandas(both, f"{kinds}, key bigint, found {schema}")


def _distances(q: np.ndarray, p: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    step = max(1, _DENSE // max(1, len(p)))
    for a in range(0, len(q), step):
        d = np.abs(q[a : a + step, None, 0] - p[None, :, 0])
        for j in range(1, q.shape[1]):
            np.maximum(d, np.abs(q[a : a + step, None, j] - p[None, :, j]), out=d)
        yield a, d


def _nearest_k(q: np.ndarray, p: np.ndarray, k: int) -> np.ndarray:
    out = np.full((len(q), k), np.inf)
    m = min(k, len(p))
    for a, d in _distances(q, p):
        out[a : a + len(d), :m] = np.sort(np.partition(d, m - 1, axis=1)[:, :m], axis=1)
    return out


def cell_radius(points: DataFrame, by: list[str], dims: int, k: int) -> DataFrame:
    """by, key, x, radius: the distance to the k-th neighbour of each of points (by, key bigint, unique within the group, x array<double>).

    A group of k points or fewer has no radius (null).
    """
    celled = cells(points, by, dims, "key")
    kinds = ", ".join(f"{c} {celled.schema[c].dataType.simpleString()}" for c in by)

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.array(pdf["x"].tolist(), float)
        pdf = pdf[[*by, "key", "x"]].copy()
        pdf["near"] = list(_nearest_k(x, x, k + 1)[:, 1:])  # without the point itself
        return pdf

    first = written(celled.groupBy(*by, "cell").applyInPandas(lambda pdf: inside(pdf).assign(cell=pdf["cell"]), f"{kinds}, key bigint, x array<double>, near array<double>, cell bigint"), "near")
    ask = first.select(*by, "key", "x", F.col("cell").alias("home"), F.element_at("near", -1).alias("radius"))
    visits = _met(ask, celled, by, dims).select(*by, "key", "x", "radius", "home", F.explode("cells.cell").alias("cell")).where("cell <> home").drop("home")
    more = _visited(written(visits, "visits"), celled, by, lambda q, r, p: list(_nearest_k(q, p, k)), "array<double>")
    all_ = first.select(*by, "key", F.col("near").alias("found")).unionByName(more)
    best = all_.groupBy(*by, "key").agg(F.element_at(F.array_sort(F.flatten(F.collect_list("found"))), k).alias("radius"))  # k for each cell that a ball touches
    return points.join(best.withColumnsRenamed({c: f"{c}_b" for c in [*by, "key"]}), [F.col(c).eqNullSafe(F.col(f"{c}_b")) for c in [*by, "key"]]).select(*by, "key", "x", F.when(F.col("radius") < float("inf"), F.col("radius")).alias("radius"))


def cell_counts(points: DataFrame, queries: DataFrame, by: list[str], dims: int) -> DataFrame:
    """by, key, held: points within the radius of each query (by, key, x, radius), its own among them; see ``cell_radius``."""
    celled = cells(points.select(*by, "key", "x"), by, dims, "key")
    met = _met(queries, celled, by, dims)
    r = F.greatest(F.col("radius"), F.lit(_TINY))

    def whole(c: Column) -> Column:
        out = F.lit(True)
        for d in range(dims):
            x = F.col("x")[d]
            out = out & (F.abs(x - c["lo"][d]) < r) & (F.abs(c["hi"][d] - x) < r)
        return out

    held = F.aggregate(F.filter("cells", whole), F.lit(0).cast("bigint"), lambda a, c: a + c["n"])
    met = written(met.select(*by, "key", "x", "radius", held.alias("held"), F.filter("cells", lambda c: ~whole(c)).alias("cells")), "met")
    visits = met.select(*by, "key", "x", "radius", F.explode("cells.cell").alias("cell"))

    def run(q: np.ndarray, r: np.ndarray, p: np.ndarray) -> np.ndarray:
        out = np.empty(len(q), np.int64)
        for a, d in _distances(q, p):
            out[a : a + len(d)] = (d < np.maximum(r[a : a + len(d), None], _TINY)).sum(axis=1)
        return out

    cut = _visited(visits, celled, by, run, "bigint").withColumnRenamed("found", "held")
    return met.select(*by, "key", "held").unionByName(cut).groupBy(*by, "key").agg(F.sum("held").alias("held"))
