"""Synthetic sections: events deposited between two time samples and convolved with a wavelet."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators.core import totalled
from lattica.operators.signal import Convolve1D


def _line(par: dict, name: str) -> np.ndarray:
    return par[f"o{name}"] + par[f"d{name}"] * np.arange(par[f"n{name}"])


def makeaxis(par: dict):
    """(t, t2, x, y) of a dictionary of origins, steps and numbers: t2 has 2 nt - 1 times around 0, y is None without ny."""
    two_sided = par["dt"] * (np.arange(2 * par["nt"] - 1) - (par["nt"] - 1))
    return _line(par, "t"), two_sided, _line(par, "x"), _line(par, "y") if "ny" in par else None


def axis_frame(spark: SparkSession, o: float, n: int, d: float) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("i"), (F.lit(float(o)) + F.col("id") * F.lit(float(d))).alias("x"))


def _events(spark: SparkSession, axes: list[np.ndarray], t: np.ndarray, curves: list[Callable[..., Column]], amps, wav) -> tuple[DataFrame, DataFrame]:
    """(section, section with the wavelet), both (k, v): each trace and event gives two samples, which the wavelet spreads.

    Events up to half a wavelet past the last sample count: the part of the wavelet that reaches back is in the section.
    """
    nt, dt, center = len(t), t[1] - t[0], len(wav) // 2
    long = nt + center
    n = int(np.prod([len(a) for a in axes]))
    traces = spark.range(n)
    at, rest = [], F.col("id")
    for a in reversed(axes):
        i = rest % len(a)
        at.insert(0, F.element_at(F.array(*[F.lit(float(v)) for v in a]), (i + 1).cast("int")))
        rest = ((rest - i) / len(a)).cast("long")
    hits = F.array(*[F.struct(((f(*at) - F.lit(float(t[0]))) / F.lit(float(dt))).alias("s"), F.lit(float(c)).alias("c")) for f, c in zip(curves, amps, strict=True)])
    spikes = traces.select("id", F.explode(hits).alias("e")).select("id", F.floor("e.s").cast("long").alias("i"), (F.col("e.s") - F.floor("e.s")).alias("d"), F.col("e.c").alias("c")).where(F.col("i").between(0, long - 2))
    two = F.explode(F.array(F.struct(F.col("i").alias("i"), ((1 - F.col("d")) * F.col("c")).alias("v")), F.struct((F.col("i") + 1).alias("i"), (F.col("d") * F.col("c")).alias("v"))))
    spikes = totalled(spikes.select("id", two.alias("p")).select((F.col("id") * long + F.col("p.i")).alias("k"), "p.v"))

    def crop(df):
        i = F.col("k") % long
        return df.where(i < nt).select((((F.col("k") - i) / long).cast("long") * nt + i).alias("k"), "v")

    return crop(spikes), crop(Convolve1D((n, long), wav, center).forward(spikes))


def _each(*values):
    n = max(np.size(v) for v in values)
    return list(zip(*[np.broadcast_to(v, n) for v in values], strict=True))


def linear2d(spark, x, t, v, t0, theta, amp, wav):
    c = [lambda x, t0=a, p=np.sin(np.deg2rad(b)) / v: F.lit(float(t0)) + x * F.lit(float(p)) for a, b in _each(t0, theta)]
    return _events(spark, [x], t, c, np.atleast_1d(amp), wav)


def parabolic2d(spark, x, t, t0, px, pxx, amp, wav):
    c = [lambda x, a=a, b=b, q=q: F.lit(float(a)) + x * F.lit(float(b)) + x * x * F.lit(float(q)) for a, b, q in _each(t0, px, pxx)]
    return _events(spark, [x], t, c, np.atleast_1d(amp), wav)


def hyperbolic2d(spark, x, t, t0, vrms, amp, wav):
    c = [lambda x, a=a, v=v: F.sqrt(F.lit(float(a * a)) + x * x / F.lit(float(v * v))) for a, v in _each(t0, vrms)]
    return _events(spark, [x], t, c, np.atleast_1d(amp), wav)


def linear3d(spark, x, y, t, v, t0, theta, phi, amp, wav):
    slopes = [(a, np.sin(np.deg2rad(b)) * np.sin(np.deg2rad(q)) / v, np.sin(np.deg2rad(b)) * np.cos(np.deg2rad(q)) / v) for a, b, q in _each(t0, theta, phi)]
    c = [lambda y, x, a=a, p=p, q=q: F.lit(float(a)) + y * F.lit(float(p)) + x * F.lit(float(q)) for a, p, q in slopes]
    return _events(spark, [y, x], t, c, np.atleast_1d(amp), wav)


def parabolic3d(spark, x, y, t, t0, px, py, pxx, pyy, amp, wav):
    c = [lambda y, x, a=a, b=b, q=q, e=e, g=g: F.lit(float(a)) + x * F.lit(float(b)) + y * F.lit(float(q)) + x * x * F.lit(float(e)) + y * y * F.lit(float(g)) for a, b, q, e, g in _each(t0, px, py, pxx, pyy)]
    return _events(spark, [y, x], t, c, np.atleast_1d(amp), wav)


def hyperbolic3d(spark, x, y, t, t0, vrms_x, vrms_y, amp, wav):
    c = [lambda y, x, a=a, v=v, w=w: F.sqrt(F.lit(float(a * a)) + x * x / F.lit(float(v * v)) + y * y / F.lit(float(w * w))) for a, v, w in _each(t0, vrms_x, vrms_y)]
    return _events(spark, [y, x], t, c, np.atleast_1d(amp), wav)
