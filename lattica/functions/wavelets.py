"""Wavelets on a symmetric axis of odd length: (samples, times, index of the centre)."""

from __future__ import annotations

import numpy as np


def _axis(t) -> np.ndarray:
    t = np.asarray(t, float)
    t = t if len(t) % 2 else t[:-1]
    return np.concatenate([-t[1:][::-1], t])


def _made(w, t, taper):
    return (w if taper is None else w * taper(len(t))), t, len(t) // 2


def gaussian(t, std: float = 1.0):
    t = _axis(t)
    return _made(np.exp(-(t**2) / (2 * std**2)), t, None)


def ricker(t, f0: float = 10, taper=None):
    t = _axis(t)
    a = (np.pi * f0 * t) ** 2
    return _made((1 - 2 * a) * np.exp(-a), t, taper)


def ormsby(t, f=(5.0, 10.0, 45.0, 50.0), taper=None):
    t = _axis(t)
    ramp = lambda a, b: (np.pi * b) ** 2 / (np.pi * b - np.pi * a) * np.sinc(b * t) ** 2 - (np.pi * a) ** 2 / (np.pi * b - np.pi * a) * np.sinc(a * t) ** 2
    w = ramp(f[2], f[3]) - ramp(f[0], f[1])
    return _made(w / np.abs(w).max(), t, taper)


def klauder(t, f=(5.0, 20.0), taper=None):
    """Autocorrelation of a sweep whose frequency is the mean of f at time 0 and the higher one at the end."""
    t = _axis(t)
    start = (f[0] + f[1]) / 2
    sweep = np.cos(2 * np.pi * (start * t + 0.5 * (f[1] - start) / t[-1] * t**2))
    w = np.correlate(sweep, sweep, mode="same")
    return _made(w / w.max(), t, taper)
