"""Data sets with known information, and the closed forms they are checked against (nats)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def xor_nuisance(spark: SparkSession, n: int = 2000, seed: int = 42, rho: float = 0.95, shift: float = 1.5) -> DataFrame:
    """X1, X2 decide Y by the sign of their product; X3, X4 correlate; X5 is noise; X6 shifts with Y."""
    z = [F.randn(seed + i) for i in range(6)]
    d = spark.range(n).select(F.col("id").alias("row_id"), *[c.alias(f"z{i}") for i, c in enumerate(z)])
    y = (F.col("z0") * F.col("z1") > 0).cast("int")
    x = [F.col("z0"), F.col("z1"), F.col("z2"), rho * F.col("z2") + float(np.sqrt(1 - rho**2)) * F.col("z3"), F.col("z4"), F.col("z5") + shift * y]
    return d.select("row_id", *[c.alias(f"X{i + 1}") for i, c in enumerate(x)], y.alias("Y"))


def paired(spark: SparkSession, n: int = 2000, seed: int = 42) -> DataFrame:
    """Two XOR pairs with Y (X1, X2) and (X7, X8), pairs shifted by 1.5 (X3, X4) and 1.0 (X9, X10), noise X5, X6."""
    d = spark.range(n).select(F.col("id").alias("row_id"), (F.rand(seed) < 0.5).cast("int").alias("Y"), *[F.randn(seed + 1 + i).alias(f"z{i}") for i in range(10)])
    sign = 2 * F.col("Y") - 1

    def xor(a: str, b: str):
        return F.col(a), F.abs(F.col(b)) * sign * F.signum(F.col(a))

    x1, x2 = xor("z0", "z1")
    x7, x8 = xor("z6", "z7")
    shift = lambda i, m: F.col(f"z{i}") + m * F.col("Y")
    cols = [x1, x2, shift(2, 1.5), shift(3, 1.5), F.col("z4"), F.col("z5"), x7, x8, shift(8, 1.0), shift(9, 1.0)]
    return d.select("row_id", "Y", *[c.alias(f"X{i + 1}") for i, c in enumerate(cols)])


def shifted_information(shift: float) -> float:
    """I(X; Y) for X = N(0, 1) + shift Y with Y a fair coin: entropy of the mixture by quadrature, less that of N(0, 1)."""
    x = np.linspace(-12, 12 + shift, 40_001)
    p = 0.5 * (np.exp(-0.5 * x**2) + np.exp(-0.5 * (x - shift) ** 2)) / np.sqrt(2 * np.pi)
    h = -np.trapezoid(np.where(p > 0, p * np.log(np.maximum(p, 1e-300)), 0), x)
    return float(h - 0.5 * np.log(2 * np.pi * np.e))


def truths(rho: float = 0.95, shifts: tuple[float, ...] = (1.5, 1.0)) -> dict[str, float]:
    """Named quantities.  A pair of equal shifts is one coordinate at shift * sqrt(2), by rotation."""
    out = {"xor marginal": 0.0, "xor joint": float(np.log(2)), "xor interaction": -float(np.log(2)), "correlated": float(-0.5 * np.log(1 - rho**2))}
    for s in shifts:
        one, two = shifted_information(s), shifted_information(s * np.sqrt(2))
        out |= {f"shift {s:g}": one, f"shift {s:g} pair": two, f"shift {s:g} interaction": 2 * one - two}
    return out


def xor_nuisance_truths(rho: float = 0.95, shift: float = 1.5) -> dict[str, float]:
    """The 13 quantities of ``xor_nuisance``."""
    t = truths(rho, (shift,))
    none = dict.fromkeys(("I(X1;Y)", "I(X2;Y)", "I(X1;X2)", "I(X3;Y)", "I(X4;Y)", "I(X5;Y)"), 0.0)
    joint = dict.fromkeys(("I(X1,X2;Y)", "I(X1;X2|Y)", "I(X1;Y|X2)"), t["xor joint"])
    return none | joint | dict.fromkeys(("I(X3;X4)", "I(X3;X4|Y)"), t["correlated"]) | {"I(X6;Y)": t[f"shift {shift:g}"], "II(X1;X2;Y)": t["xor interaction"]}


def paired_truths(shifts: tuple[float, float] = (1.5, 1.0)) -> dict[str, float]:
    """The 18 quantities of ``paired``."""
    t = truths(0.0, shifts)
    out = {f"I(X{i};Y)": 0.0 for i in (1, 2, 5, 6, 7, 8)} | {"I(X1,X2;Y)": t["xor joint"], "II(X5;X6;Y)": 0.0}
    out |= {f"II(X{i};X{i + 1};Y)": t["xor interaction"] for i in (1, 7)}
    for s, i in zip(shifts, (3, 9), strict=True):
        out |= {f"I(X{i};Y)": t[f"shift {s:g}"], f"I(X{i + 1};Y)": t[f"shift {s:g}"], f"I(X{i},X{i + 1};Y)": t[f"shift {s:g} pair"], f"II(X{i};X{i + 1};Y)": t[f"shift {s:g} interaction"]}
    return out


def errors(estimates: DataFrame, truth: dict[str, float]) -> DataFrame:
    """(quantity, estimate) with the truth and the absolute error; null where there is no truth."""
    spark = estimates.sparkSession
    t = spark.createDataFrame(list(truth.items()), "quantity string, truth double")
    return estimates.join(F.broadcast(t), "quantity", "left").withColumn("abs_error", F.abs(F.col("estimate") - F.col("truth")))  # a row per quantity
