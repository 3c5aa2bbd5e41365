"""Tapers: ramps of ``ntap`` samples at both ends of a window of ``nmask``."""

from __future__ import annotations

import numpy as np


def _window(nmask: int, ntap: int, ramp: np.ndarray) -> np.ndarray:
    out = np.ones(nmask)
    ntap = min(ntap, nmask // 2 if 2 * ntap > nmask else ntap)
    if ntap > 0:
        out[:ntap] = ramp[:ntap]
        out[nmask - ntap :] = ramp[:ntap][::-1]
    return out


def cosinetaper(nmask: int, ntap: int, square: bool = False, exponent: float | None = None) -> np.ndarray:
    """Raised cosine to a power: 1, or 2 if ``square``, or ``exponent``."""
    power = exponent if exponent is not None else 2 if square else 1
    ramp = np.ones(1) if ntap <= 1 else 0.5 - 0.5 * np.cos(np.pi * np.arange(ntap) / (ntap - 1))
    return _window(nmask, ntap, ramp**power)


def hanningtaper(nmask: int, ntap: int) -> np.ndarray:
    return cosinetaper(nmask, ntap)


def taper(nmask: int, ntap: int, tapertype: str | None = "hanning") -> np.ndarray:
    kinds = {"hanning": 1, "cosine": 1, "cosinesquare": 2, "cosinesqrt": 0.5}
    return np.ones(nmask) if tapertype is None else cosinetaper(nmask, ntap, exponent=kinds[tapertype])


def tapernd(nmask, ntap, tapertype: str | None = "hanning") -> np.ndarray:
    """Product of the tapers of the axes."""
    out = np.ones(())
    for n, t in zip(nmask, ntap, strict=True):
        out = np.multiply.outer(out, taper(n, t, tapertype))
    return out


def taper2d(nt: int, nmask: int, ntap: int, tapertype: str | None = "hanning") -> np.ndarray:
    """(nmask, nt) with the taper along the first axis."""
    return np.repeat(taper(nmask, ntap, tapertype)[:, None], nt, axis=1)


def taper3d(nt: int, nmask, ntap, tapertype: str | None = "hanning") -> np.ndarray:
    return np.repeat(tapernd(nmask, ntap, tapertype)[..., None], nt, axis=2)
