"""Misfits of a vector against another."""

from __future__ import annotations

import numpy as np


def mae(xref, xcmp) -> float:
    return float(np.mean(np.abs(xref - xcmp)))


def mse(xref, xcmp) -> float:
    return float(np.mean(np.abs(xref - xcmp) ** 2))


def snr(xref, xcmp) -> float:
    return float(10 * np.log10(np.mean(np.abs(xref) ** 2) / mse(xref, xcmp)))


def psnr(xref, xcmp, xmax=None, xmin=0.0) -> float:
    top = np.max(xref) if xmax is None else xmax
    low = np.min(xref) if xmin is None else xmin
    return float(10 * np.log10((top - low) ** 2 / mse(xref, xcmp)))
