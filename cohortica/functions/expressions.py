"""Column expressions: no UDF but the Student-t tail, which Spark has no function for."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def quoted(name: str) -> Column:
    """A column whose name may have dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def numeric(c: Column) -> Column:
    """As a double; text that is no number, NaN and nulls are null, so that aggregates skip them."""
    v = c.try_cast("double")
    return F.when(~F.isnan(v), v)


def truth(c: Column) -> Column:
    """0/1 from booleans, numbers or their texts; anything else is null."""
    t = F.lower(F.trim(c.cast("string")))
    return F.when(t.isin("true", "1", "1.0"), 1).when(t.isin("false", "0", "0.0"), 0)


def not_mild(severity: Column, mild: Column, notmild: Column) -> Column:
    """Up to three votes that a case is not mild; null without a vote or without agreement."""
    stripped = F.regexp_replace(severity, r"^\s+|\s+$", "")
    votes = F.filter(F.array(F.lower(stripped) != "mild", ~mild, notmild), lambda v: v.isNotNull())
    distinct = F.array_distinct(votes)
    return F.when(F.size(distinct) == 1, F.element_at(distinct, 1))


def probe_id(name: Column) -> Column:
    """seq.1234.56 -> 1234-56: the prefix goes, every digits.digits is joined by a dash."""
    bare = F.regexp_replace(F.regexp_replace(name, r"^seq\.", ""), "^seq", "")
    return F.regexp_replace(bare, r"(\d+)\.(\d+)", "$1-$2")


def text_or_blank(c: Column) -> Column:
    """Missing values, also those spelt nan, as empty text."""
    return F.when(c.isNull() | (c == "nan"), "").otherwise(c.cast("string"))


def label_or(symbol: Column, fallback: Column) -> Column:
    ok = symbol.isNotNull() & (F.trim(symbol) != "") & (symbol != "nan")
    return F.when(ok, symbol).otherwise(fallback)


def zero_if_missing(c: Column) -> Column:
    """0 for null and NaN."""
    return F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0))


def minus_log10(p: Column) -> Column:
    return -F.log10(F.greatest(F.lit(1e-300), F.least(F.lit(1.0), p)))


def safe_ratio(a: Column, b: Column, default: float = 1.0) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(default))


def hash_order(seed: int, *cols: str) -> Column:
    """An order that every engine with md5 gives alike: by md5 of the columns and the seed."""
    return F.md5(F.concat_ws("|", *[quoted(c).cast("string") for c in cols], F.lit(str(seed))))


def _beta_fraction(a: np.ndarray, b: float, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            c = 1 + num / c
            d = 1 / np.where(abs(d) < tiny, tiny, d)
            c = np.where(abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(abs(d * c - 1) < 1e-15):
            break
    return h


def t_tail(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Two-sided p of Student's t: the regularised incomplete beta at df / (df + t^2)."""
    t, df = np.abs(np.asarray(t, float)), np.asarray(df, float)
    out = np.full(t.shape, np.nan)
    out[np.isinf(t)] = 0.0
    ok = np.isfinite(t) & np.isfinite(df) & (df > 0)
    a, b, x = df[ok] / 2, 0.5, df[ok] / (df[ok] + t[ok] ** 2)
    lg = np.array([math.lgamma(v + b) - math.lgamma(v) - math.lgamma(b) for v in a])
    with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
        front = np.exp(lg + a * np.log(x) + b * np.log1p(-x))
        low = front * _beta_fraction(a, b, x) / a
        swapped = np.exp(lg + a * np.log(x) + b * np.log1p(-x))
        high = 1 - swapped * _beta_fraction(np.full_like(a, b), a, 1 - x) / b if len(a) else low
    out[ok] = np.where(x < (a + 1) / (a + b + 2), low, high)
    out[ok & (t == 0)] = 1.0
    return out


def t_pvalue(t: Column | str, df: Column | str) -> Column:
    """Two-sided p, a batch at a time."""

    def run(t: pd.Series, df: pd.Series) -> pd.Series:
        p = t_tail(t.to_numpy(float, na_value=np.nan), df.to_numpy(float, na_value=np.nan))
        return pd.Series(p).where(~np.isnan(p), None)

    return F.pandas_udf(run, "double")(t, df)


def spare_double(name: str) -> Column:
    """A double of (0, 1] that a row's value of the column decides, by hash."""
    return (F.shiftrightunsigned(F.xxhash64(quoted(name)), 40) + 1) / F.lit(float(1 << 24))
