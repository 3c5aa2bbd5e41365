"""Soft, hard and half thresholds of arrays and frames."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hardthreshold(x, t):
    return np.where(np.abs(x) <= np.sqrt(2 * t), 0, x)


def softthreshold(x, t):
    size = np.abs(x)
    return np.where(size > t, x * (1 - t / np.where(size > 0, size, 1)), 0)


def halfthreshold(x, t):
    size = np.abs(x)
    with np.errstate(divide="ignore", invalid="ignore"):
        arg = np.clip((t / 8) * np.where(size > 0, size / 3, 1) ** -1.5, -1, 1)
    phi = 2 / 3 * np.arccos(arg)
    return np.where(size <= 54 ** (1 / 3) / 4 * t ** (2 / 3), 0, 2 / 3 * x * (1 + np.cos(2 / 3 * np.pi - phi)))


def hard_level(p):
    """Threshold whose cut is at size p."""
    return 0.5 * p**2


def soft_level(p):
    return p


def half_level(p):
    return (4 / 54 ** (1 / 3) * p) ** 1.5


def column(v: Column, kind: str, t: float | Column) -> Column:
    t = F.lit(float(t)) if not isinstance(t, Column) else t
    size = F.abs(v)
    if kind == "hard":
        return F.when(size <= F.sqrt(2 * t), 0.0).otherwise(v)
    if kind == "soft":
        return F.greatest(size - t, F.lit(0.0)) * F.signum(v)
    arg = F.least(F.lit(1.0), t / 8 * F.pow(size / 3, F.lit(-1.5)))
    third = F.lit(2.0) / F.lit(3.0)
    return F.when(size <= F.lit(54 ** (1 / 3) / 4) * F.pow(t, third), 0.0).otherwise(third * v * (1 + F.cos(third * F.lit(np.pi) - third * F.acos(arg))))


def frame(df: DataFrame, kind: str, t: float) -> DataFrame:
    """Thresholds the moduli of a frame's values; complex ones keep their phase."""
    if "v" in df.columns:
        return df.withColumn("v", column(F.col("v"), kind, t)).where("v <> 0")
    size = F.hypot("re", "im")
    scale = F.when(size > 0, column(size, kind, t) / size).otherwise(0.0)
    return df.withColumn("_s", scale).where("_s <> 0").select(*[c for c in df.columns if c not in ("re", "im")], (F.col("_s") * F.col("re")).alias("re"), (F.col("_s") * F.col("im")).alias("im"))


def _kth(df: DataFrame, k: int, bins: int = 4096, few: int = 20_000) -> float:
    """The k-th smallest x of a frame, from 0: passes count equal parts of the range that holds it, until few are left."""
    low, high, below, n = (*df.agg(F.min("x"), F.max("x")).first(), 0, df.count())
    while n > few and low < high:
        width = (high - low) / bins
        part = F.least(F.floor((F.col("x") - F.lit(low)) / F.lit(width)), F.lit(bins - 1)) if width > 0 else F.lit(0)
        counts = df.where(F.col("x").between(low, high)).groupBy(part.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).orderBy("b").collect()
        for c in counts:
            if below + c["n"] > k:
                low, high, n = c["low"], c["high"], c["n"]
                break
            below += c["n"]
        if len(counts) == 1:  # the range can't be parted any further
            break
    if low == high:
        return float(low)
    return float(sorted(r["x"] for r in df.where(F.col("x").between(low, high)).collect())[k - below])


def percentile(df: DataFrame, q: float, size: int | None = None) -> float:
    """Exact percentile q (0 to 100) of column x, between two neighbours by their distance; of ``size`` values, those
    without a row being 0 and none less. No task or driver holds more than some thousand values."""
    n = df.count()
    size = n if size is None else size
    at = (size - 1) * q / 100
    ranks = [int(np.floor(at)), min(int(np.floor(at)) + 1, size - 1)]
    a, b = (0.0 if k < size - n else _kth(df, k - (size - n)) for k in ranks)
    return a + (b - a) * (at - ranks[0])
