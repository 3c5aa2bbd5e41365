"""Matrices of convolutions, and local slopes and dips from the structure tensor."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lattica.operators.basic import FirstDerivative, Smoothing2D
from lattica.operators.core import collected, session, vector


def convmtx(h, n: int, offset: int = 0) -> np.ndarray:
    """(n, n) matrix of the convolution of n samples with h, whose sample at ``offset`` is at time 0."""
    out = np.zeros((n, n), np.asarray(h).dtype)
    for k, c in enumerate(h):
        i = np.arange(max(0, k - offset), min(n, n + k - offset))
        out[i, i - k + offset] = c
    return out


def nonstationary_convmtx(H, n: int, hc: int = 0, pad=(0, 0)) -> np.ndarray:  # noqa: N803
    """Matrix whose row i holds filter i around sample i; pad widens the filters with zeros."""
    H = np.pad(np.asarray(H, float), ((0, 0), tuple(pad)))  # noqa: N806
    return np.stack([np.roll(row, i)[hc : hc + n] for i, row in enumerate(H[:, :])]) if H.shape[1] >= hc + n else np.stack([np.roll(np.pad(row, (0, hc + n - len(row))), i)[hc : hc + n] for i, row in enumerate(H)])


def structure_tensor(d: np.ndarray, dz: float = 1.0, dx: float = 1.0, smooth: int = 5):
    """Smoothed products gzz, gxx, gzx of the gradients, in one plan."""
    d = np.asarray(d, float)
    frame = vector(session(), d)
    gz = FirstDerivative(d.shape, 0, dz, edge=True).forward(frame).withColumnRenamed("v", "z")
    gx = FirstDerivative(d.shape, 1, dx, edge=True).forward(frame).withColumnRenamed("v", "x")
    both = gz.join(gx, "k", "full").fillna(0.0, ["z", "x"])
    smoother = Smoothing2D((smooth, smooth), d.shape)
    products = both.select("k", F.explode(F.array(*[F.struct(F.lit(i).alias("which"), e.alias("v")) for i, e in enumerate((F.col("z") * F.col("z"), F.col("x") * F.col("x"), F.col("z") * F.col("x")))])).alias("p")).select("k", "p.which", "p.v")
    out = smoother.forward(products).cache()
    parts = [collected(out.where(f"which = {i}").drop("which"), d.size).reshape(d.shape) for i in range(3)]
    out.unpersist()
    return parts


def slope_estimate(d, dz: float = 1.0, dx: float = 1.0, smooth: int = 5, eps: float = 0.0, dips: bool = False):
    """(slopes, anisotropies) of the structure tensor's smaller eigenvector; slopes flatter than eps of anisotropy are 0."""
    gzz, gxx, gzx = structure_tensor(d, dz, dx, smooth)
    half = np.sqrt(np.maximum(0.25 * (gzz - gxx) ** 2 + gzx**2, 0))
    l1, l2 = (gzz + gxx) / 2 + half, (gzz + gxx) / 2 - half
    with np.errstate(divide="ignore", invalid="ignore"):
        anisotropy = np.where(l1 != 0, 1 - l2 / l1, 0.0)
        slopes = np.where(np.abs(gzx) > 0, (l1 - gzz) / gzx, 0.0)
    slopes = np.where(anisotropy < eps, 0.0, slopes)
    return (np.arctan(slopes) if dips else slopes), anisotropy


def dip_estimate(d, dz: float = 1.0, dx: float = 1.0, smooth: int = 5, eps: float = 0.0):
    gzz, gxx, gzx = structure_tensor(d, dz, dx, smooth)
    slopes, anisotropy = slope_estimate(d, dz, dx, smooth, eps)
    return 0.5 * np.arctan2(2 * gzx, gzz - gxx), anisotropy
