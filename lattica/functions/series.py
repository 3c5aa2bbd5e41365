"""Stencils over ragged series: rows of a key in an order, without a grid. Missing neighbours count as 0 or give 0."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def over(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def first_derivative(v: str, w, kind: str = "centered", sampling: float = 1.0) -> Column:
    x, after, before = F.col(v), F.lead(v).over(w), F.lag(v).over(w)
    y = {"forward": after - x, "backward": x - before, "centered": F.lit(0.5) * (after - before)}[kind]
    return F.coalesce(y / F.lit(float(sampling)), F.lit(0.0))


def second_derivative(v: str, w, sampling: float = 1.0) -> Column:
    return F.coalesce((F.lead(v).over(w) - F.lit(2.0) * F.col(v) + F.lag(v).over(w)) / F.lit(float(sampling) ** 2), F.lit(0.0))


def running_sum(v: str, w, kind: str = "full", sampling: float = 1.0) -> Column:
    total = F.sum(v).over(w.rowsBetween(Window.unboundedPreceding, 0))
    if kind != "full":
        total = total - F.col(v) / 2
    if kind == "trapezoidal":
        total = F.when(F.row_number().over(w) == 1, F.lit(0.0)).otherwise(total - F.first(v).over(w) / 2)
    return F.lit(float(sampling)) * total


def moving_mean(v: str, w, n: int) -> Column:
    n += 1 - n % 2
    return F.sum(v).over(w.rowsBetween(-(n // 2), n // 2)) / F.lit(float(n))
