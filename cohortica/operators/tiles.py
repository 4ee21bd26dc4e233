"""Neighbour statistics of many sets of features at once.

A *shape* says what is asked of a set of features: the distance to the k-th
neighbour among all of them, and then, for each of its *marginals* (places in
the set), how many points lie within that distance when only those features
count.  ``sums`` gives, for each set, the sums that the estimators need.

Tables of up to ``TILE_ROWS`` rows are cut into tiles of ``TILE`` features.  A
task gets the tiles of its sets, so a row is copied once for each combination
of tiles and not for each set.  Its rows are dealt to leaves, so a set takes
n log n steps and not n * n (``kernels``; ``functions.balls`` where there is no
compiler), and sets of the same features in another order share radius and
counts.  Taller tables go through ``nearest``, set by set, whose tasks hold a
cell or a block of a line each.  All count alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortica import kernels
from cohortica.functions import balls
from cohortica.functions.expressions import spare_double
from cohortica.operators import nearest
from cohortica.operators.order import scratch, written

TILE_ROWS = 1 << 20  # rows of which one task may hold TILE features
NUMPY_ROWS = 1 << 17  # the same without the kernel
DENSE_ROWS = 1 << 13  # rows whose distances are all worked out without the kernel, where a marginal has more than two features
TILE = 8
SETS = 512  # sets of a task
_PLANE = 1 << 23  # numbers of the planes that a task keeps
JITTER = 1e-10  # what moves equal points apart where a logarithm of their distance is needed


def _known(vectors: DataFrame, by_label: bool) -> DataFrame:
    """key (unique), grp, jit, features of the rows without a missing feature (or label, if it matters)."""
    rows = vectors.where(F.forall("features", lambda v: v.isNotNull() & ~F.isnan(v)))
    if by_label:
        rows = rows.where("y is not null")
    grp = F.col("y").cast("bigint") if by_label else F.lit(0).cast("bigint")
    jit = spare_double("row_id")
    return rows.select(F.monotonically_increasing_id().alias("key"), grp.alias("grp"), jit.alias("jit"), F.col("features").cast("array<double>").alias("features"))


def _psi(n: int) -> np.ndarray:
    table = np.concatenate([[np.nan, 0.0], np.cumsum(1.0 / np.arange(1, max(n, 1) + 1))])
    return table - 0.57721566490153286061


def _tile_sums(columns: dict[int, np.ndarray], sets: list[tuple[int, ...]], k: int, marginals: tuple, scale: bool) -> np.ndarray:
    """The sums of each set; those of the same features follow each other."""
    n = len(next(iter(columns.values())))
    out = np.zeros((len(sets), max(1, len(marginals))))
    if n <= k:
        return out
    if scale:
        columns = {f: x / (x.std() if x.std() > 0 else 1.0) for f, x in columns.items()}
    psi = _psi(n)
    lines: dict[int, balls.Line] = {}
    planes: dict[tuple[int, ...], balls.Plane] = {}
    kept = max(2, _PLANE // (2 * (n + 1) * n.bit_length()))
    now = None
    for i, dims in enumerate(sets):
        if tuple(sorted(dims)) != now:
            now, known, ends = tuple(sorted(dims)), {}, {}
            r = balls.radius([columns[f] for f in now], k)
        if not marginals:
            out[i, 0] = np.log(r).sum()
        for j, m in enumerate(marginals):
            of = tuple(sorted({dims[p] for p in m}))
            if of not in known:
                for f in of if len(of) < 3 else ():
                    if f not in lines:
                        lines[f] = balls.Line(columns[f])
                    if f not in ends:
                        ends[f] = lines[f].ends(columns[f], r)
                if len(of) == 1:
                    held = ends[of[0]][1] - ends[of[0]][0]
                elif len(of) == 2:
                    plane = planes.pop(of, None) or balls.Plane(lines[of[0]], lines[of[1]])
                    while len(planes) >= kept:
                        del planes[next(iter(planes))]
                    planes[of] = plane  # the latest used
                    held = plane.held(*ends[of[0]], *ends[of[1]])
                else:
                    held = balls.held([columns[f] for f in of], r)
                known[of] = psi[held].sum()
            out[i, j] = known[of]
    return out


def _asked(own: list[tuple[int, ...]], held: list[int], k: int, marginals: tuple, scale: bool) -> bytes:
    """What the kernel ``Sets`` is asked, by places in the tiles that it holds."""
    out = [k, int(scale), max(1, len(marginals)), TILE, len(own)]
    for s in own:
        out += [len(s), *(held.index(f // TILE) * TILE + f % TILE for f in s), len(marginals)]
        for m in marginals:
            out += [len(m), *m]
    return np.array(out, "<i4").tobytes()


def _by_tiles(rows: DataFrame, sets: list[tuple[int, ...]], width: int, k: int, marginals: tuple, jitter: bool, scale: bool, by_label: bool, schema: str) -> DataFrame:
    spark = rows.sparkSession
    sums = max(1, len(marginals))

    def pack(table: pa.Table) -> pa.Table:
        """A tile's columns as [8 or 4, rows, columns, values], of 4 bytes where these hold the same values; with the first one what rows have besides, as tiles -1 and -2."""
        order = np.argsort(table["key"].to_numpy())
        part = table["part"].combine_chunks()
        if len(set(pc.list_value_length(part).to_pylist())) > 1:
            raise ValueError("rows have different numbers of features")
        block = np.ascontiguousarray(part.flatten().to_numpy(zero_copy_only=False).reshape(len(order), -1)[order].T)
        with np.errstate(over="ignore"):
            short = block.astype("<f4")
        values = short if (short == block).all() else block.astype("<f8")
        out = [(table["tile"][0].as_py(), np.array([values.itemsize, len(order), len(block)], "<i4").tobytes() + values.tobytes())]
        if out[0][0] == 0:
            out += [(-1, table["grp"].to_numpy()[order].astype("<i8").tobytes() if by_label else b""), (-2, (JITTER * table["jit"].to_numpy()[order]).astype("<f8").tobytes() if jitter else b"")]
        return pa.table({"tile": pa.array([t for t, _ in out], pa.int32()), "data": pa.array([d for _, d in out], pa.binary())})

    cut = F.transform(F.sequence(F.lit(0), F.lit((width - 1) // TILE)), lambda t: F.slice("features", t * TILE + 1, F.lit(TILE)))
    tiles = rows.select("key", "grp", "jit", F.posexplode(cut).alias("tile", "part")).groupBy("tile").applyInArrow(pack, "tile int, data binary")
    tiles = written(tiles, "tiles")

    jobs: dict[tuple[int, ...], list[tuple[int, ...]]] = {}
    for s in sets:
        jobs.setdefault(tuple(sorted({d // TILE for d in s})), []).append(s)
    tasks = []
    for at, own in jobs.items():
        own.sort(key=lambda s: (sorted(s), s))  # sets of the same features, and those that share planes
        tasks += [(list(at), own[i : i + SETS]) for i in range(0, len(own), SETS)]
    asked = [(i, [-2, -1, *at], [list(s) for s in own], _asked(own, list(at), k, marginals, scale)) for i, (at, own) in enumerate(tasks)]
    made = spark.createDataFrame(asked, "task int, tiles array<int>, sets array<array<int>>, asked binary")  # sets of features are metadata
    places = max(1, min(4 * len(tasks), 10_000))
    held = F.broadcast(made.select("task", F.explode("tiles").alias("tile"))).join(tiles, "tile").repartition(places, "task").groupBy("task")
    held = held.agg(F.transform(F.array_sort(F.collect_list(F.struct("tile", "data"))), lambda t: t["data"]).alias("held"))  # as many tiles as a set has features
    held = held.join(F.broadcast(made.select("task", "sets", "asked")), "task")

    def parts(found: bytes, count: int) -> Iterator[tuple[int, int, np.ndarray]]:
        """Number, rows and sums of each group."""
        words = np.frombuffer(found, "<i8")
        values = words.view("<f8")
        for at in range(1, len(words), 2 + count * sums):
            yield int(words[at]), int(words[at + 1]), values[at + 2 : at + 2 + count * sums].reshape(count, sums)

    def in_numpy(held: list[bytes], asked: list[tuple[int, ...]], tiles: list[int]) -> Iterator[tuple[int, int, np.ndarray]]:
        shift, grp, columns = np.frombuffer(held[0], "<f8"), np.frombuffer(held[1], "<i8"), {}
        for t, data in zip(tiles, held[2:], strict=True):
            size, n, _ = np.frombuffer(data, "<i4", 3)
            for j, x in enumerate(np.frombuffer(data, f"<f{size}", -1, 12).astype(float).reshape(-1, n)):
                columns[t * TILE + j] = x + shift if len(shift) else x
        grp = grp if len(grp) else np.zeros(n, np.int64)
        for g in np.unique(grp):
            yield int(g), int((grp == g).sum()), _tile_sums({f: np.ascontiguousarray(x[grp == g]) for f, x in columns.items()}, asked, k, marginals, scale)

    fast = kernels.ready(spark, "Sets")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples(index=False):
                own = [tuple(int(x) for x in s) for s in row.sets]
                for g, n, found in parts(row.found, len(own)) if fast else in_numpy(list(row.held), own, sorted({d // TILE for s in own for d in s})):
                    yield pd.DataFrame({"dims": [list(s) for s in own], "grp": g, "n": n, **{f"s{j}": found[:, j] for j in range(sums)}})

    if fast:
        held = held.select("sets", kernels.call("Sets", F.slice("held", 3, F.size("held")), F.col("held")[1], F.col("held")[0], F.col("asked")).alias("found"))
    return held.mapInPandas(run, schema)


def _by_cells(rows: DataFrame, sets: list[tuple[int, ...]], k: int, marginals: tuple, jitter: bool, scale: bool) -> DataFrame:
    """A group of k rows or fewer has no sums (null)."""
    spark = rows.sparkSession
    if scale:
        stds = rows.select("grp", F.posexplode("features").alias("f", "v")).groupBy("grp", "f").agg(F.stddev_pop("v").alias("s"))
        stds = stds.groupBy("grp").agg(F.transform(F.array_sort(F.collect_list(F.struct("f", "s"))), lambda x: F.when(x["s"] > 0, x["s"]).otherwise(1.0)).alias("stds"))
        rows = written(rows.join(F.broadcast(stds), "grp").select("key", "grp", "jit", F.zip_with("features", "stds", lambda x, s: x / s).alias("features")), "scaled")  # a row a label
    out = None
    for size in {len(s) for s in sets}:
        own = [s for s in sets if len(s) == size]
        table = F.broadcast(spark.createDataFrame([(i, list(s)) for i, s in enumerate(own)], "job int, dims array<int>"))  # sets of features are metadata
        jobs = F.explode(F.sequence(F.lit(0), F.lit(len(own) - 1))).alias("job")
        shift = F.col("jit") * F.lit(JITTER if jitter else 0.0)
        points = rows.select("key", "grp", "jit", "features", jobs).join(table, "job").select("job", "grp", "key", F.transform("dims", lambda d: F.element_at("features", d + 1) + shift).alias("x"))
        by = ["job", "grp"]
        with scratch() as keep:
            if size == 1:
                at = nearest.line_radius(points.select(*by, "key", F.col("x")[0].alias("v")), by, "v", "key", k)
                found = at.select(*by, "key", F.array("v").alias("x"), F.when(F.col("kk") == k, F.col("radius")).alias("radius"))
            else:
                found = nearest.cell_radius(points, by, size, k)
            found = keep(written(found, "radius"))
        sums = found.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *([] if marginals else [F.sum(F.log("radius")).alias("s0")]))
        for j, m in enumerate(marginals):
            some = found.where("radius is not null").select(*by, "key", F.array(*[F.col("x")[i] for i in m]).alias("x"), "radius")
            with scratch() as keep:
                if len(m) == 1:
                    some = some.withColumn("v", F.col("x")[0])
                    held = nearest.line_counts(some.select(*by, "v"), some, by, "v", ["key"])
                else:
                    held = nearest.cell_counts(some, some, by, len(m))
                held = keep(written(held.groupBy(*by).agg(F.sum(nearest.digamma(F.col("held"))).alias(f"s{j}")), "sums"))
            sums = sums.join(held, by, "left")
        sums = sums.join(table, "job").drop("job")
        out = sums if out is None else out.unionByName(sums)
    return out


def sums(vectors: DataFrame, sets: list[tuple[int, ...]], marginals: tuple[tuple[int, ...], ...] = (), k: int = 3, by_label: bool = False, jitter: bool = False, scale: bool = False) -> DataFrame:
    """dims, grp, n, s0, s1, ...: for each set, the number of rows and the sums of digamma(points within the radius) in each marginal.

    vectors: row_id, y, features.  Without marginals s0 is the sum of the
    logarithms of the radius.  grp is the label, or 0 where labels do not matter.
    Rows with a missing feature are left out.  ``jitter`` moves equal points
    apart by a hash of row_id; ``scale`` divides features by their population
    standard deviation within the group.
    """
    sets = list(dict.fromkeys(sets))
    rows = written(_known(vectors, by_label), "known")  # from here on a row has one key
    n, width = vectors.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("features")), F.lit(0))).first()
    names = [f"s{j}" for j in range(max(1, len(marginals)))]
    most = TILE_ROWS if kernels.ready(vectors.sparkSession, "Sets") else min(TILE_ROWS, NUMPY_ROWS if max(map(len, marginals), default=0) < 3 else DENSE_ROWS)
    if n > most:
        out = _by_cells(rows, sets, k, marginals, jitter, scale)
    else:
        out = _by_tiles(rows, sets, max(1, width), k, marginals, jitter, scale, by_label, "dims array<int>, grp bigint, n bigint, " + ", ".join(f"{c} double" for c in names))
    return out.select("dims", "grp", "n", *[F.when(F.col("n") > k, F.col(c)).alias(c) for c in names])
