"""Solvers against numpy, with vectors on the driver and distributed."""

import numpy as np
import pytest
from lattica.operators.basic import Diagonal, FirstDerivative, Identity, MatrixMult, SecondDerivative
from lattica.operators.core import collected, vector
from lattica.functions import thresholds
from lattica.plans import solvers, storage
from lattica.plans.solvers import Frame

rng = np.random.default_rng(1)
A = rng.normal(size=(8, 5))
X = rng.normal(size=5)
Y = A @ X


def test_least_squares(spark):
    m = MatrixMult(A)
    assert np.allclose(solvers.cg(MatrixMult(A.T @ A), A.T @ Y, niter=20, tol=1e-20)[0], X)
    assert np.allclose(solvers.cgls(m, Y, niter=20, tol=1e-20)[0], X)
    x, istop, *_ = solvers.lsqr(m, Y, niter=20)
    assert np.allclose(x, X) and istop in (1, 2, 4, 5)
    assert np.allclose(m / Y, X)
    damped = np.linalg.solve(A.T @ A + 0.25 * np.eye(5), A.T @ Y)
    assert np.allclose(solvers.lsqr(m, Y, damp=0.5, niter=20)[0], damped) and np.allclose(solvers.cgls(m, Y, damp=0.5, niter=20, tol=1e-20)[0], damped)
    d = SecondDerivative(5).todense()
    want = np.linalg.solve(A.T @ A + 4 * d.T @ d, A.T @ Y)
    assert np.allclose(solvers.regularized_inversion(m, Y, [SecondDerivative(5)], epsRs=[2.0], niter=30)[0], want, atol=1e-6)
    assert np.allclose(solvers.normal_equations_inversion(m, Y, [SecondDerivative(5)], epsRs=[2.0], niter=30)[0], want, atol=1e-6)
    assert np.allclose(solvers.preconditioned_inversion(m, Y, Diagonal(np.arange(1, 6.0)), niter=30)[0], X)
    with pytest.raises(ValueError):
        solvers.regularized_inversion(m, Y, [Identity(5)], epsRs=[1.0, 2.0])


def test_distributed_vectors(spark):
    m = MatrixMult(A)
    for f in (solvers.lsqr, solvers.cgls):
        x = f(m, Frame(vector(spark, Y), 8), niter=6)[0]
        assert np.allclose(collected(x.df, 5), X, atol=1e-3)
    a, b = Frame(vector(spark, X), 5), Frame(vector(spark, X[::-1]), 5)
    assert np.isclose(a.dot(b), X @ X[::-1]) and np.isclose((a - b).norm(), np.linalg.norm(X - X[::-1]))


def test_sparse(spark):
    b = MatrixMult(rng.normal(size=(15, 30)))
    x = np.zeros(30)
    x[[3, 15, 26]] = [1, 1, -1.0]
    y = b @ x
    assert np.allclose(solvers.omp(b, y, niter_outer=5)[0], x)
    assert np.abs(solvers.spgl1(b, y, niter=60, roots=6)[0] - x).max() < 0.2
    got = solvers.fista(MatrixMult(np.eye(5)), np.array([2.0, 0.01, 0, -1, 0.02]), niter=5, eps=0.2, alpha=1.0)[0]
    assert np.allclose(got, [1.9, 0, 0, -0.9, 0])
    assert np.allclose(solvers.ista(MatrixMult(np.eye(5)), np.array([2.0, 0.01, 0, -1, 0.02]), niter=5, eps=0.2, alpha=1.0)[0], got)
    with pytest.raises(NotImplementedError):
        solvers.ista(b, y, threshkind="none")
    with pytest.raises(ValueError):
        solvers.ista(b, y, threshkind="soft-percentile")


def test_sparse_distributed(spark):
    """The same results from distributed vectors as from arrays, percentiles included; old iterates are deleted."""
    b = MatrixMult(np.eye(6)[::-1] * 1.0)
    y = np.array([2.0, 0.01, 0, -1, 0.02, 0.5])
    frame = Frame(vector(spark, y), 6)
    before = len(storage.written)
    for f, kw in ((solvers.ista, {"eps": 0.2}), (solvers.fista, {"threshkind": "hard-percentile", "perc": 40}), (solvers.ista, {"threshkind": "soft-percentile", "perc": 50}), (solvers.ista, {"threshkind": "half-percentile", "perc": 70})):
        want = f(b, y, niter=3, alpha=1.0, **kw)[0]
        assert np.allclose(collected(f(b, frame, niter=3, alpha=1.0, **kw)[0].df, 6), want)
    assert len(storage.written) - before <= 4
    for kw in ({}, {"niter_inner": 0}, {"normalizecols": True}, {"niter_inner": 0, "normalizecols": True, "optimal_coeff": True}):
        want = solvers.omp(b, y, niter_outer=2, **kw)
        got = solvers.omp(b, frame, niter_outer=2, **kw)
        assert np.allclose(collected(got[0].df, 6), want[0]) and np.allclose(got[2], want[2])
    big = Frame(vector(spark, np.arange(-50.0, 51)), 200)
    values = np.abs(np.concatenate([np.arange(-50.0, 51), np.zeros(99)]))
    assert all(np.isclose(big.percentile(q), np.percentile(values, q)) for q in (0, 10, 49.7, 50, 77.7, 100))
    assert np.isclose(thresholds._kth(big.df.selectExpr("v as x"), 30, bins=4, few=3), -20)
    for tau in (0.5, 300.0, 1e9):
        assert np.allclose(collected(solvers.l1_project(big, tau).df, 200)[:101], solvers.l1_project(np.arange(-50.0, 51), tau))


def test_weighted_and_blocky_distributed(spark):
    m = MatrixMult(A[:5] + 3 * np.eye(5))
    y = m @ X
    y[2] += 5
    frame = Frame(vector(spark, y), 5)
    for kind in ("data", "model"):
        want = solvers.irls(m, y, nouter=2, epsR=1e-3, kind=kind, niter=6)[0]
        assert np.allclose(collected(solvers.irls(m, frame, nouter=2, epsR=1e-3, kind=kind, niter=6)[0].df, 5), want, atol=1e-5)
    args = ([FirstDerivative(5)],)
    kw = {"niter_outer": 2, "niter_inner": 1, "epsRL1s": [0.1], "niter": 4}
    want, _, cost = solvers.splitbregman(m, y, *args, **kw)
    got = solvers.splitbregman(m, frame, *args, **kw)
    assert np.allclose(collected(got[0].df, 5), want, atol=1e-6) and np.allclose(got[2], cost)
    want = solvers.spgl1(m, y, tau=1.0, niter=3)[0]
    assert np.allclose(collected(solvers.spgl1(m, frame, tau=1.0, niter=3)[0].df, 5), want, atol=1e-6)


def test_inversion_classes(spark):
    m = MatrixMult(A)
    assert np.allclose(solvers.RegularizedInversion(m).solve(Y, niter=30, Regs=[SecondDerivative(5)], epsRs=[2.0]), solvers.regularized_inversion(m, Y, [SecondDerivative(5)], epsRs=[2.0], niter=30)[0])
    assert np.allclose(solvers.NormalEquationsInversion(m).solve(Y, niter=30, Regs=[], epsI=0.1), solvers.normal_equations_inversion(m, Y, epsI=0.1, niter=30)[0])
    assert np.allclose(solvers.PreconditionedInversion(m).solve(Y, niter=30, P=Diagonal(np.arange(1, 6.0))), X)
    with pytest.raises(NotImplementedError):
        solvers.RegularizedInversion(m).step(Y)


def test_robust_and_blocky(spark):
    m = MatrixMult(A)
    y = Y.copy()
    y[2] += 5
    x = solvers.irls(m, y, nouter=6, epsR=1e-3, tolIRLS=1e-6)[0]
    assert np.abs(x - X).max() < np.abs(np.linalg.lstsq(A, y, rcond=None)[0] - X).max()
    x, n, cost = solvers.splitbregman(m, Y, [FirstDerivative(5)], niter_outer=2, niter_inner=1, epsRL1s=[1e-6], niter=8)
    assert np.abs(x - X).max() < 0.1 and n == 2 and len(cost) == 2


def test_callbacks(spark):
    c = solvers.MetricsCallback(X, which=("mse",))
    solvers.lsqr(MatrixMult(A), Y, niter=4, callback=[c])
    assert len(c.metrics["mse"]) == 4 and c.metrics["mse"][-1] < c.metrics["mse"][0]
    assert np.isclose(abs(solvers.power_iteration(MatrixMult(A.T @ A), 60, 1e-9)[0]), np.linalg.eigvalsh(A.T @ A)[-1], rtol=1e-3)
