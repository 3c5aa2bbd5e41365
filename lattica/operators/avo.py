"""Reflection coefficients, and modelling and inversion of post-stack and pre-stack data."""

from __future__ import annotations

import numpy as np

from lattica.operators.basic import FirstDerivative, Laplacian, MatrixMult, SecondDerivative, _Composite, relation_frame
from lattica.operators.core import LinOp, Relation, Traces, as_dims, size
from lattica.operators.signal import Convolve1D


def _rows(*values):
    return np.broadcast_arrays(*[np.atleast_1d(np.asarray(v, float)) for v in values])


def zoeppritz_scattering(vp1, vs1, rho1, vp0, vs0, rho0, theta1) -> np.ndarray:
    """(4, 4, angles): amplitudes of the waves that leave an interface for each wave that meets it. Angles in degrees;
    beyond the critical angle the values are NaN."""
    t1 = np.deg2rad(np.atleast_1d(np.asarray(theta1, float)))
    p = np.sin(t1) / vp1
    with np.errstate(invalid="ignore"):
        t0, f1, f0 = np.arcsin(p * vp0), np.arcsin(p * vs1), np.arcsin(p * vs0)
    one = np.ones_like(t1)
    left = np.array(
        [
            [-np.sin(t1), -np.cos(f1), np.sin(t0), np.cos(f0)],
            [np.cos(t1), -np.sin(f1), np.cos(t0), -np.sin(f0)],
            [2 * rho1 * vs1 * np.sin(f1) * np.cos(t1), rho1 * vs1 * (1 - 2 * np.sin(f1) ** 2), 2 * rho0 * vs0 * np.sin(f0) * np.cos(t0), rho0 * vs0 * (1 - 2 * np.sin(f0) ** 2)],
            [-rho1 * vp1 * (1 - 2 * np.sin(f1) ** 2), rho1 * vs1 * np.sin(2 * f1), rho0 * vp0 * (1 - 2 * np.sin(f0) ** 2) * one, -rho0 * vs0 * np.sin(2 * f0)],
        ]
    )
    sign = np.array([[-1, -1, -1, -1], [1, 1, 1, 1], [1, 1, 1, 1], [-1, -1, -1, -1]])[:, :, None]
    right = left * sign
    bad = np.isnan(left).any(axis=(0, 1))
    out = np.full(left.shape, np.nan)
    if not bad.all():
        m = np.moveaxis(left[:, :, ~bad], -1, 0)
        out[:, :, ~bad] = np.moveaxis(np.linalg.solve(m, np.moveaxis(right[:, :, ~bad], -1, 0)), 0, -1)
    return out


def zoeppritz_element(vp1, vs1, rho1, vp0, vs0, rho0, theta1, element: str = "PdPu") -> np.ndarray:
    """One of the 16: incident wave (Pd, Sd, Pu, Su), then the wave that leaves (Pu, Su, Pd, Sd)."""
    into, out = ["Pd", "Sd", "Pu", "Su"], ["Pu", "Su", "Pd", "Sd"]
    if element[:2] not in into or element[2:] not in out:
        raise ValueError("element must be a pair of waves as in PdPu")
    return zoeppritz_scattering(vp1, vs1, rho1, vp0, vs0, rho0, theta1)[out.index(element[2:]), into.index(element[:2])]


def zoeppritz_pp(vp1, vs1, rho1, vp0, vs0, rho0, theta1) -> np.ndarray:
    return zoeppritz_element(vp1, vs1, rho1, vp0, vs0, rho0, theta1)


def approx_zoeppritz_pp(vp1, vs1, rho1, vp0, vs0, rho0, theta1) -> np.ndarray:
    """Closed form of the PP coefficient."""
    vp1, vs1, rho1, vp0, vs0, rho0 = (np.asarray(x, float)[..., None] for x in (vp1, vs1, rho1, vp0, vs0, rho0))
    p = np.sin(np.deg2rad(np.atleast_1d(theta1))) / vp1
    c = lambda v: np.sqrt(1 - (p * v) ** 2)
    ct1, ct0, cf1, cf0 = c(vp1), c(vp0), c(vs1), c(vs0)
    a = rho0 * (1 - 2 * (p * vs0) ** 2) - rho1 * (1 - 2 * (p * vs1) ** 2)
    b = rho0 * (1 - 2 * (p * vs0) ** 2) + 2 * rho1 * (p * vs1) ** 2
    cc = rho1 * (1 - 2 * (p * vs1) ** 2) + 2 * rho0 * (p * vs0) ** 2
    d = 2 * (rho0 * vs0**2 - rho1 * vs1**2)
    e, f = b * ct1 / vp1 + cc * ct0 / vp0, b * cf1 / vs1 + cc * cf0 / vs0
    g, h = a - d * ct1 / vp1 * cf0 / vs0, a - d * ct0 / vp0 * cf1 / vs1
    return ((b * ct1 / vp1 - cc * ct0 / vp0) * f - (a + d * ct1 / vp1 * cf0 / vs0) * h * p**2) / (e * f + g * h * p**2)


def _angles(theta, vsvp, n):
    t = np.deg2rad(np.atleast_1d(np.asarray(theta, float)))[:, None]
    r = np.broadcast_to(np.atleast_1d(np.asarray(vsvp, float)), (n if np.ndim(vsvp) == 0 else np.size(vsvp),))[None, :]
    return t, r


def akirichards(theta, vsvp, n: int = 1):
    """Coefficients of log velocities and density, each (angles, samples)."""
    t, r = _angles(theta, vsvp, n)
    s2 = np.sin(t) ** 2
    return 1 / (2 * np.cos(t) ** 2) + 0 * r, -4 * r**2 * s2, 0.5 - 2 * r**2 * s2


def fatti(theta, vsvp, n: int = 1):
    """Coefficients of log impedances and density."""
    t, r = _angles(theta, vsvp, n)
    s2, tan2 = np.sin(t) ** 2, np.tan(t) ** 2
    return 0.5 * (1 + tan2) + 0 * r, -4 * r**2 * s2, 0.5 * (4 * r**2 * s2 - tan2)


def ps(theta, vsvp, n: int = 1):
    """Coefficients of converted waves."""
    t, r = _angles(theta, vsvp, n)
    s = np.sin(t)
    cp = np.sqrt(1 - r**2 * s**2)
    factor = -s / (2 * cp)
    tail = np.cos(t) * cp
    return 0 * factor * r, factor / r * (4 * r**2 * s**2 - 4 * r * tail), factor / r * (1 + 2 * r**2 * s**2 - 2 * r * tail) if np.all(r) else factor


LINEARIZATIONS = {"akirich": akirichards, "fatti": fatti, "PS": ps, "ps": ps}


class AVOLinearModelling(Relation):
    """y[t, angle] = sum over parameters of G[t, parameter, angle] m[t, parameter], for each place."""

    def __init__(self, theta, vsvp=0.5, nt0: int = 1, spatdims=None, linearization="akirich"):
        f = linearization if callable(linearization) else LINEARIZATIONS.get(linearization)
        if f is None:
            raise NotImplementedError(f"{linearization} is not an available linearization")
        nt0 = np.size(vsvp) if np.ndim(vsvp) else nt0
        g = np.stack([np.broadcast_to(c, (np.size(theta), nt0)) for c in f(theta, vsvp, nt0)])
        g = g[[1, 2]] if linearization in ("PS", "ps") else g
        npar, na, _ = g.shape
        space = as_dims(spatdims) if spatdims is not None else ()
        ns = size(space) if space else 1
        p, a, t, s = np.meshgrid(*[np.arange(n) for n in (npar, na, nt0, ns)], indexing="ij")
        r, c, w = (t * na + a) * ns + s, (t * npar + p) * ns + s, np.broadcast_to(g[..., None], p.shape)
        super().__init__((nt0, npar, *space), (nt0, na, *space), lambda spark: relation_frame(spark, r.ravel(), c.ravel(), w.ravel()), name="AVOLinearModelling")


def _derivative(n: int, kind: str) -> np.ndarray:
    """Matrix of the derivative along an axis of n samples."""
    out = np.zeros((n, n))
    low, high = {"forward": (0, 1), "backward": (-1, 0), "centered": (-1, 1)}[kind]
    at = np.arange(-low, n - high)
    out[at, at + low] -= 1 / (high - low)
    out[at, at + high] += 1 / (high - low)
    return out


def _wavelets(wav: np.ndarray, nt0: int) -> np.ndarray:
    """Matrix of the convolution with a wavelet, or with one for each time."""
    rows = np.broadcast_to(wav, (nt0, wav.shape[-1]))
    m, half = np.zeros((nt0, nt0)), wav.shape[-1] // 2
    for i, row in enumerate(rows):
        for j in range(max(0, i - (wav.shape[-1] - 1 - half)), min(nt0, i + half + 1)):
            m[i, j] = row[i - j + half]
    return m


def poststack_matrix(wav, nt0: int, kind: str = "centered") -> np.ndarray:
    return 0.5 * _wavelets(np.asarray(wav, float), nt0) @ _derivative(nt0, kind)


class PoststackLinearModelling(_Composite):
    """Half the derivative of log impedance, convolved with a wavelet, or with one for each time if wav is a matrix. With
    ``explicit`` the matrix of a trace is built and applied to all of them."""

    def __init__(self, wav, nt0: int, spatdims=None, kind: str = "centered", explicit: bool = False):
        dims = (nt0, *(as_dims(spatdims) if spatdims is not None else ()))
        wav = np.asarray(wav, float)
        if explicit:
            op = MatrixMult(poststack_matrix(wav, nt0, kind), dims[1:] or None)
        else:
            w = Convolve1D(dims, 0.5 * wav, len(wav) // 2, 0) if wav.ndim == 1 else MatrixMult(0.5 * _wavelets(wav, nt0), dims[1:] or None)
            op = w @ FirstDerivative(dims, 0, 1.0, kind)
        super().__init__(op, "PoststackLinearModelling", dims, dims)
        self.explicit = explicit and len(dims) == 1


class PrestackLinearModelling(_Composite):
    """Derivative, linearised coefficients and wavelet: from (t, parameters, space) to (t, angles, space)."""

    def __init__(self, wav, theta, vsvp=0.5, nt0: int = 1, spatdims=None, linearization="akirich", kind: str = "centered"):
        avo = AVOLinearModelling(theta, vsvp, nt0, spatdims, linearization)
        super().__init__(Convolve1D(avo.dimsd, wav, len(wav) // 2, 0) @ avo @ FirstDerivative(avo.dims, 0, 1.0, kind), "PrestackLinearModelling", avo.dims, avo.dimsd)


class PrestackWaveletModelling(_Composite):
    """Convolution of the coefficients of a known model with an unknown wavelet: (t, angles) from the wavelet."""

    def __init__(self, m, theta, nwav: int, wavc: int | None = None, vsvp=0.5, linearization="akirich"):
        m = np.asarray(m, float)
        nt0 = len(m)
        f = linearization if callable(linearization) else LINEARIZATIONS[linearization]
        g = np.stack([np.broadcast_to(c, (np.size(theta), nt0)) for c in f(theta, vsvp, nt0)], axis=1)
        d = np.zeros_like(m)
        d[1:-1] = (m[2:] - m[:-2]) / 2
        coef = np.einsum("apt,tp->ta", g[:, : m.shape[1]], d)
        wavc = nwav // 2 if wavc is None else wavc
        a = np.zeros((nt0, coef.shape[1], nwav))
        for i in range(nt0):
            for k in range(nwav):
                if 0 <= i - k + wavc < nt0:
                    a[i, :, k] = coef[i - k + wavc]
        super().__init__(MatrixMult(a.reshape(-1, nwav)), "PrestackWaveletModelling", nwav, (nt0, coef.shape[1]))


def _inversion(op: LinOp, data, m0, epsI, epsR, epsRL1, space: bool, niter: int):  # noqa: N803
    from lattica.plans.solvers import lsqr, normal_equations_inversion, regularized_inversion, splitbregman

    y, start = np.ravel(data), None if m0 is None else np.ravel(m0)
    if epsRL1 is not None:
        d = FirstDerivative(op.dims, 0)
        smooth = [Laplacian(op.dims, axes=(-2, -1) if space else (0, 0), weights=(1, 1) if space else (1, 0))] if epsR is not None else []
        return splitbregman(op, y, [d], start, RegsL2=smooth, epsRL1s=[epsRL1], epsRL2s=[epsR] if smooth else None, niter=niter)[0]
    if epsR is not None:
        return regularized_inversion(op, y, [Laplacian(op.dims) if space else SecondDerivative(op.dims, 0)], start, epsRs=[epsR], niter=niter)[0]
    if epsI is not None:
        return normal_equations_inversion(op, y, epsI=epsI, x0=start, niter=niter)[0]
    return lsqr(op, y, start, niter=niter)[0]


def _by_trace(matrix: np.ndarray, data: np.ndarray, m0, epsI) -> np.ndarray:  # noqa: N803
    """Damped least squares of each trace (first axis) by one factorised matrix, the traces spread over tasks."""
    start = np.zeros((matrix.shape[1], *data.shape[1:])) if m0 is None else np.asarray(m0, float)
    eps = 0.0 if epsI is None else epsI
    inverse = np.linalg.pinv(matrix) if not eps else np.linalg.solve(matrix.T @ matrix + eps**2 * np.eye(matrix.shape[1]), matrix.T)
    residual = data - np.tensordot(matrix, start, axes=1)
    solve = Traces(data.shape, 0, matrix.shape[1], lambda x: x @ inverse.T, lambda y: y @ inverse, False, None, "Solve")
    return start + solve.matvec(residual.ravel()).reshape(start.shape)


def PoststackInversion(data, wav, m0=None, explicit: bool = False, simultaneous: bool = False, epsI=None, epsR=None, epsRL1=None, niter: int = 50):  # noqa: N802, N803
    """(model, residual) of log impedance: least squares, damped, smooth in space, or blocky (epsRL1).

    ``explicit`` uses the matrix of a trace: unless ``simultaneous`` or regularised in space, each trace is solved directly.
    """
    data = np.asarray(data, float)
    op = PoststackLinearModelling(wav, data.shape[0], data.shape[1:] or None, explicit=explicit)
    if explicit and not simultaneous and epsR is None and epsRL1 is None:
        m = _by_trace(poststack_matrix(wav, data.shape[0]), data, m0, epsI)
    else:
        m = _inversion(op, data, m0, epsI, epsR, epsRL1, data.ndim > 1, niter)
    return m.reshape(op.dims), data - (op @ m.reshape(op.dims)).reshape(data.shape)


def prestack_matrix(wav, theta, nt0: int, vsvp=0.5, linearization="akirich", kind: str = "centered") -> np.ndarray:
    """(nt0 * angles, nt0 * parameters): derivative, coefficients and wavelet of a place."""
    f = linearization if callable(linearization) else LINEARIZATIONS[linearization]
    g = np.stack([np.broadcast_to(c, (np.size(theta), nt0)) for c in f(theta, vsvp, nt0)])
    g = g[[1, 2]] if linearization in ("PS", "ps") else g
    w, d = _wavelets(np.asarray(wav, float), nt0), _derivative(nt0, kind)
    return np.einsum("ij,paj,jk->iakp", w, g, d).reshape(nt0 * g.shape[1], nt0 * g.shape[0])


def PrestackInversion(data, theta, wav, m0=None, linearization="akirich", explicit: bool = False, simultaneous: bool = False, epsI=None, epsR=None, epsRL1=None, vsvp=0.5, kind="centered", niter: int = 50):  # noqa: N802, N803
    """(model, residual) of the elastic parameters of data (t, angles, space); explicit and simultaneous as post-stack."""
    data = np.asarray(data, float)
    op = PrestackLinearModelling(wav, theta, vsvp, data.shape[0], data.shape[2:] or None, linearization, kind)
    if explicit and not simultaneous and epsR is None and epsRL1 is None:
        matrix = prestack_matrix(wav, theta, data.shape[0], vsvp, linearization, kind)
        flat = data.reshape(data.shape[0] * data.shape[1], *data.shape[2:])
        start = None if m0 is None else np.reshape(m0, (matrix.shape[1], *data.shape[2:]))
        m = _by_trace(matrix, flat, start, epsI)
    else:
        m = _inversion(op, data, m0, epsI, epsR, epsRL1, data.ndim > 2, niter)
    return m.reshape(op.dims), data - (op @ m.reshape(op.dims)).reshape(data.shape)
