"""Wave-equation procedures and inversions against plain formulas."""

import numpy as np
import pytest
from lattica.functions.wavelets import ricker
from lattica.operators import avo, basic, wave

rng = np.random.default_rng(3)


def test_marchenko_operators_convolve_and_correlate(spark):
    ns = nr = 2
    nt, dt, dr = 4, 0.5, 2.0
    r = rng.normal(size=(ns, nr, nt))
    m = wave.Marchenko(r, dt, dr=dr, nsmooth=0)
    conv, corr = m.operators()
    f = np.zeros((m.nt2, nr))
    f[nt - 3 : nt + 1] = rng.normal(size=(4, nr))  # times -2 to 1
    want, back = np.zeros((m.nt2, ns)), np.zeros((m.nt2, ns))
    for s in range(ns):
        for q in range(nr):
            for t in range(m.nt2):
                for tau in range(nt):
                    want[t, s] += dt * dr * r[s, q, tau] * f[(t - tau) % m.nt2, q]
                    back[t, s] += dt * dr * r[s, q, tau] * f[(t + tau) % m.nt2, q]
    assert np.allclose(conv.matvec(f.ravel()).reshape(m.nt2, ns), want)
    assert np.allclose(corr.matvec(f.ravel()).reshape(m.nt2, ns), back)
    w = m.window(np.array([[1.0], [1.5]]))
    assert w[:, :, 0].T.tolist() == [[0, 0, 1, 1, 1, 0, 0], [0, 1, 1, 1, 1, 1, 0]]


def test_marchenko_solves_its_system(spark):
    r = 0.2 * rng.normal(size=(2, 2, 4))
    m = wave.Marchenko(r, 1.0, nsmooth=0)
    trav, g0 = np.array([2.0, 3.0]), rng.normal(size=(2, 4))
    minus, plus, p0, gm, gp = m.apply_onepoint(trav, g0, rtm=True, greens=True, niter=40)
    conv, corr = (op.todense() for op in m.operators())
    w = m.window(trav[:, None]).ravel()
    direct = np.concatenate([g0.T[::-1], np.zeros((3, 2))]).ravel()
    eye = np.eye(len(w))
    big = np.block([[eye, -w[:, None] * conv], [-w[:, None] * corr, eye]]) * np.concatenate([w, w])
    f = np.linalg.lstsq(big, np.concatenate([w * (conv @ direct), 0 * w]), rcond=None)[0]
    f[len(w) :] += direct
    shape = lambda x: x.reshape(7, 2).T
    assert np.allclose(minus, shape(f[:14]), atol=1e-6) and np.allclose(plus, shape(f[14:]), atol=1e-6) and np.allclose(p0, shape(conv @ direct))
    assert np.allclose(gm, -shape(f[:14] - conv @ f[14:]), atol=1e-6) and np.allclose(gp, shape(f[14:] - corr @ f[:14])[:, ::-1], atol=1e-6)
    two = m.apply_multiplepoints(np.stack([trav, trav], axis=1), np.stack([g0, g0], axis=1), niter=40)
    assert np.allclose(two[0][:, 1], minus, atol=1e-6) and two[1].shape == (2, 2, 7)
    with pytest.raises(ValueError):
        m.apply_onepoint(trav)


def test_smoothing_has_no_delay():
    x = np.zeros(31)
    x[15] = 1
    y = wave.smoothed(x, 3)
    assert np.allclose(y[13:18], np.array([1, 2, 3, 2, 1]) / 9) and np.isclose(y.sum(), 1) and np.allclose(wave.smoothed(np.ones(20), 5), 1)


def test_hankel():
    assert np.allclose(wave.hankel2(np.array([1.0, 10.0])), [0.765197687 - 0.088256964j, -0.245935764 - 0.055671167j], atol=1e-5)
    assert np.isclose(abs(wave.hankel2(np.array([200.0]))[0]), np.sqrt(2 / np.pi / 200), rtol=1e-3)


@pytest.mark.parametrize("more", [{"npad": 3, "ntaper": 2}])
def test_deghosting(spark, more):
    nt, nr = 16, 8
    up = np.zeros((nt, nr))
    up[5, 2:6] = 1.0
    args = (nt, nr, 0.004, 10.0, 1500.0, 5.0)  # no notch on a frequency but 0
    ks = np.fft.fftfreq(nr + 2 * more.get("npad", 0), 10.0)
    shift = wave.PhaseShift(1500.0, 10.0, nt, np.fft.rfftfreq(nt, 0.004), ks)
    pad = basic.Pad((nt, nr), ((0, 0), (3, 3))) if "npad" in more else basic.Identity(nt * nr)
    edge = wave.tapernd((nr,), (more.get("ntaper", 0),))
    for kind, sign in (("p", -1), ("vz", 1)):
        total = up + sign * (pad.H @ shift @ pad).matvec((up * edge).ravel()).reshape(nt, nr)
        kw = dict(more)
        if "win" in kw:
            kw["win"] = np.ones((nt, nr))
        pd = 0.1 * rng.normal(size=(nt, nr))
        got, down = wave.Deghosting(total + pd, *args, kind=kind, pd=pd, niter=60, **kw)
        # The mean of all is the same in both parts, so nothing tells it.
        assert np.allclose(got - got.mean(), up - up.mean(), atol=0.05) and np.allclose(got + down, total + pd)


def test_decomposition(spark):
    nr, nt = 6, 8
    args = (nt, nr, 0.004, 10.0, 1000.0, 1500.0)
    p = rng.normal(size=(nr, nt))
    vz = 1e-6 * rng.normal(size=(nr, nt))
    up, down = wave.WavefieldDecomposition(p, vz, *args, ntaper=0, kind="analytical")
    assert np.allclose(up + down, p)
    scaled = wave.PressureToVelocity(*args, ntaper=0, topressure=True).matvec(vz.ravel()).real.reshape(nr, nt)
    assert np.allclose(down - up, scaled)


def test_deconvolution_of_a_spike(spark):
    g = np.zeros((3, 3, 5))
    g[np.arange(3), np.arange(3), 0] = 1.0
    d = rng.normal(size=(3, 1, 5))
    model = wave.MDD(g, d, dt=1.0, dr=1.0, niter=12)
    assert np.allclose(model.reshape(3, 9)[:, 4:], d[:, 0], atol=1e-4) and np.allclose(model.reshape(3, 9)[:, :4], 0, atol=1e-4)


def test_interpolation_of_straight_lines(spark):
    full = np.add.outer(np.arange(9.0), np.arange(4.0))
    got, _ = wave.SeismicInterpolation(full[[0, 2, 3, 6, 8]], 9, [0, 2, 3, 6, 8], kind="spatial", niter=60, epsR=0.01)
    assert np.abs(got - full).max() < 0.01


def test_migration_and_inversions(spark):
    wav = ricker(np.arange(5) * 0.004, 25)[0]
    lsm = wave.LSM(np.arange(4) * 5.0, np.arange(3) * 5.0, np.arange(40) * 0.004, np.array([[0, 10.0], [0, 0]]), np.array([[0, 5.0, 10.0], [0, 0, 0]]), 1000.0, wav, 4, mode="analytic")
    image = np.zeros((3, 4))
    image[1, 2] = 1
    d = lsm.Demop @ image
    assert np.allclose(lsm.solve(d, niter=40), image, atol=0.05)
    m = np.cumsum(rng.normal(size=12)) * 0.1
    data = avo.PoststackLinearModelling(wav, 12) @ m
    inv, res = avo.PoststackInversion(data, wav, m0=m, niter=10)
    assert np.allclose(res, 0, atol=1e-6) and np.allclose(inv, m, atol=1e-6)
    op = avo.PrestackLinearModelling(wav, [5.0, 15.0, 25.0], 0.5, 12)
    model = rng.normal(size=(12, 3))
    _, res = avo.PrestackInversion(op @ model, [5.0, 15.0, 25.0], wav, m0=model, niter=5)
    assert np.allclose(res, 0, atol=1e-6)


def test_explicit_inversions(spark):
    """The matrix of a trace is that of the operator, and each trace is solved by it."""
    wav = np.array([0.2, 1.0, -0.5, 0.1])
    for kind in ("forward", "backward", "centered"):
        assert np.allclose(avo.poststack_matrix(wav, 9, kind), avo.PoststackLinearModelling(wav, 9, kind=kind).todense())
    assert np.allclose(avo.prestack_matrix(wav, [5.0, 25.0], 8), avo.PrestackLinearModelling(wav, [5.0, 25.0], 0.5, 8).todense())
    data = rng.normal(size=(9, 2))
    a = avo.poststack_matrix(wav, 9)
    got, res = avo.PoststackInversion(data, wav, explicit=True, epsI=0.3)
    want = np.linalg.solve(a.T @ a + 0.09 * np.eye(9), a.T @ data)
    assert np.allclose(got, want) and np.allclose(res, data - a @ want)
    together, _ = avo.PoststackInversion(data, wav, explicit=True, simultaneous=True, epsI=0.3, niter=40)
    assert np.allclose(together, want, atol=1e-5)
    data = rng.normal(size=(8, 2, 2))
    b = avo.prestack_matrix(wav, [5.0, 25.0], 8)
    got, _ = avo.PrestackInversion(data, [5.0, 25.0], wav, explicit=True, epsI=0.5)
    want = np.linalg.solve(b.T @ b + 0.25 * np.eye(24), b.T @ data.reshape(16, 2))
    assert np.allclose(got.reshape(24, 2), want)


def test_modelling_of_one_shot(spark):
    op = wave.LSM(np.full((6, 6), 1000.0), 5.0, [[2, 1]], [[1, 2], [4, 3]], 8, 0.002, kind="twoway").Demop
    a = op.todense()
    x = rng.normal(size=36)
    assert np.allclose(a @ x, op.matvec(x)) and np.allclose(a.T @ (a @ x), op.rmatvec(op.matvec(x)))
