"""Estimates of an operator's trace from products with random vectors, all in one job each."""

from __future__ import annotations

import numpy as np


def sample(kind: str, n: int, m: int, rng: np.random.Generator) -> np.ndarray:
    if kind == "rademacher":
        return rng.choice([-1.0, 1.0], (n, m))
    z = rng.normal(size=(n, m))
    return z if kind == "gaussian" else z / np.linalg.norm(z, axis=0) * np.sqrt(n)


def trace_hutchinson(op, neval=None, sampler="rademacher", batch_size=None, seed=1) -> float:
    n = op.shape[1]
    neval = neval or max(1, int(np.round(n * 0.1)))
    rng = np.random.default_rng(seed)
    if sampler == "unitvector":
        cols = rng.permutation(n)[: min(n, neval)]
        z = np.zeros((n, len(cols)))
        z[cols, np.arange(len(cols))] = np.sqrt(n)
    else:
        z = sample(sampler, n, neval, rng)
    return float(np.mean(np.sum(z * np.real(op.matmat(z)), axis=0)))


def trace_hutchpp(op, neval=None, sampler="rademacher", seed=1) -> float:
    n = op.shape[1]
    m = max(1, (neval or int(np.round(n * 0.1))) // 3)
    rng = np.random.default_rng(seed)
    q, _ = np.linalg.qr(op.matmat(sample(sampler, n, min(m, n), rng)))
    g = sample(sampler, n, m, rng)
    g = g - q @ (q.T @ g)
    return float(np.trace(q.T @ op.matmat(q)) + np.trace(g.T @ op.matmat(g)) / m)


def trace_nahutchpp(op, neval=None, sampler="rademacher", c1=1 / 6, c2=1 / 3, seed=1) -> float:
    n = op.shape[1]
    m = neval or max(6, int(np.round(n * 0.1)))
    rng = np.random.default_rng(seed)
    s, r = sample(sampler, n, max(1, int(c1 * m)), rng), sample(sampler, n, max(1, int(c2 * m)), rng)
    g = sample(sampler, n, max(1, m - s.shape[1] - r.shape[1]), rng)
    z, w = op.matmat(r), op.matmat(s)
    inner = np.linalg.pinv(s.T @ z)
    low = np.trace(inner @ (w.T @ z))
    rest = np.trace(g.T @ op.matmat(g)) - np.trace((g.T @ z) @ inner @ (w.T @ g))
    return float(low + rest / g.shape[1])
