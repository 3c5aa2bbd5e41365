"""Operators: dot tests, dense probes against numpy, and inverses."""

import numpy as np
import pytest
from lattica import config
from lattica.functions import estimates, estimators, tapers, thresholds
from lattica.functions.wavelets import gaussian, klauder, ormsby, ricker
from lattica.operators import avo, basic, signal, wave
from lattica.operators.core import FunctionOperator, MemoizeOperator, collected, common_dtype, dottest, need_dtype, scaled, vector
from lattica.plans import storage

rng = np.random.default_rng(0)
A = rng.normal(size=(4, 6))
X = rng.normal(size=6)
T, HX, P = np.arange(9) * 0.1, np.arange(5) * 2.0, np.linspace(-0.05, 0.05, 4)
WAV = ricker(np.arange(5) * 0.004, 25)[0]

REAL = {
    "matrix": lambda: basic.MatrixMult(A),
    "matrix otherdims": lambda: basic.MatrixMult(A, (3,)),
    "identity crop": lambda: basic.Identity((3, 2), (2, 4)),
    "zero": lambda: basic.Zero(3, 4),
    "diagonal": lambda: basic.Diagonal(np.arange(1, 4.0), (3, 2), 0),
    "transpose": lambda: basic.Transpose((2, 3, 4), (1, 2, 0)),
    "flip": lambda: basic.Flip((3, 4), 0),
    "roll": lambda: basic.Roll((3, 4), 1, 2),
    "pad": lambda: basic.Pad((2, 3), ((1, 0), (2, 2))),
    "sum": lambda: basic.Sum((3, 4), 0),
    "symmetrize": lambda: basic.Symmetrize((3, 4), 0),
    "restriction": lambda: basic.Restriction((4, 3), [2, 0], 0),
    "regression": lambda: basic.Regression(np.arange(5.0), 2),
    "integration": lambda: basic.CausalIntegration((5, 2), 0, 0.5, "half"),
    "integration in blocks": lambda: basic.CausalIntegration((2, 11), kind="trapezoidal", block=3),
    "integration in blocks, half": lambda: basic.CausalIntegration((11, 2), 0, 0.5, "half", True, block=4),
    "integration first removed": lambda: basic.CausalIntegration((2, 5), kind="trapezoidal", removefirst=True),
    "first derivative": lambda: basic.FirstDerivative((3, 7), 0),
    "first derivative 5 edge": lambda: basic.FirstDerivative(9, edge=True, order=5, sampling=2.0),
    "first derivative n=1": lambda: basic.FirstDerivative((3, 1)),
    "second derivative": lambda: basic.SecondDerivative((2, 7), kind="forward"),
    "laplacian": lambda: basic.Laplacian((5, 6), edge=True),
    "gradient": lambda: basic.Gradient((4, 5)),
    "directional": lambda: basic.SecondDirectionalDerivative((4, 5), [0.5, 0.5]),
    "smoothing": lambda: basic.Smoothing2D((3, 4), (6, 7)),
    "spread": lambda: basic.Spread((2, 3), (4, 5), table=np.where(rng.random((2, 3, 4)) < 0.2, np.nan, 1.0), dtable=rng.random((2, 3, 4))),
    "vstack": lambda: basic.VStack([basic.MatrixMult(A), basic.Diagonal(X)]),
    "hstack": lambda: basic.HStack([basic.MatrixMult(A), basic.Identity(4)]),
    "block": lambda: basic.Block([[basic.MatrixMult(A), basic.Identity(4)], [basic.MatrixMult(A), basic.Zero(4)]]),
    "blockdiag": lambda: basic.BlockDiag([basic.MatrixMult(A), basic.Diagonal(X)]),
    "kronecker": lambda: basic.Kronecker(basic.MatrixMult(A), basic.MatrixMult(A[:2, :3])),
    "columns": lambda: basic.MatrixMult(A).apply_columns([4, 1]),
    "convolve1d": lambda: signal.Convolve1D((3, 8), [1, 2, 3.0], 2),
    "convolve1d long": lambda: signal.Convolve1D(3, [1, 2, 3.0, 4, 5], 2),
    "convolve1d blocks": lambda: signal.LongConvolve1D((3, 23), rng.normal(size=9), 4, block=5),
    "convolve1d blocks, axis 0, longer": lambda: signal.LongConvolve1D((7, 2), rng.normal(size=11), 2, 0, 11, 4),
    "convolvend": lambda: signal.ConvolveND((4, 4, 4), rng.normal(size=(2, 3, 2)), (0, 1, 1), (0, 1, 2)),
    "nonstationary1d": lambda: signal.NonStationaryConvolve1D(12, rng.normal(size=(3, 5)), (2, 5, 8)),
    "nonstationary1d axis": lambda: signal.NonStationaryConvolve1D((12, 2), rng.normal(size=(3, 5)), (2, 5, 8), 0),
    "nonstationary3d": lambda: signal.NonStationaryConvolve3D((4, 4, 5), rng.normal(size=(2, 2, 2, 3, 3, 1)), (1, 3), (0, 2), (1, 4)),
    "nonstationary2d": lambda: signal.NonStationaryConvolve2D((6, 7), rng.normal(size=(2, 3, 3, 3)), (1, 4), (1, 3, 5)),
    "nonstationary filters": lambda: signal.NonStationaryFilters2D(rng.normal(size=(6, 7)), (3, 3), (1, 4), (1, 3, 5)),
    "real fft": lambda: signal.FFT(9, nfft=12, real=True, norm="1/n"),
    "shift": lambda: signal.Shift((3, 10), np.array([1.0, 2.5, 3.0]), real=True),
    "dct": lambda: signal.DCT((4, 5), 4, [1]),
    "dwt": lambda: signal.DWT2D((6, 8), wavelet="db3", level=2),
    "interp": lambda: signal.Interp((4, 6), [0.5, 2.25, 4.9], 1)[0],
    "interp sinc": lambda: signal.Interp(8, [0.6, 3.2], kind="sinc")[0],
    "bilinear": lambda: signal.Bilinear(np.array([[0.5, 2.2], [1.1, 3.3]]), (4, 5, 2)),
    "fredholm": lambda: signal.Fredholm1(rng.normal(size=(3, 4, 2)), 2),
    "radon2d": lambda: signal.Radon2D(T, HX, P, "hyperbolic", interp=False),
    "radon3d": lambda: signal.Radon3D(T, HX[:3], HX[:4], P[:2], P[:3], "parabolic"),
    "fourier radon": lambda: signal.FourierRadon3D(T, HX[:2], HX[:3], P[:2], P[:2], 16),
    "chirp radon": lambda: signal.ChirpRadon2D(T, HX, 1.0),
    "seislet": lambda: signal.Seislet(rng.normal(size=(8, 5)) * 0.1),
    "sliding": lambda: signal.Sliding1D(basic.MatrixMult(A[:, :3]), None, 13, 4, 1),
    "patch": lambda: signal.Patch2D(basic.Identity(16), None, (10, 10), (4, 4), (2, 2), scalings=np.arange(1, 17.0)),
    "blending": lambda: wave.BlendingContinuous(10, 2, 3, 0.004, [0, 0.013, 0.05]),
    "blending group": lambda: wave.BlendingGroup(8, 2, 4, 0.004, rng.random(4) * 0.01, 2, 2),
    "kirchhoff": lambda: wave.Kirchhoff(np.arange(5) * 5.0, np.arange(4) * 5.0, np.arange(40) * 0.004, np.array([[0, 5.0], [0, 0.0]]), np.array([[0, 10.0], [0, 0]]), 1000.0, WAV, len(WAV) // 2),
    "mdc": lambda: wave.MDC(rng.normal(size=(4, 2, 3)) + 1j, 9, 2),
    "phase shift": lambda: wave.PhaseShift(1500.0, 10.0, 8, np.fft.rfftfreq(8, 0.004), np.fft.fftfreq(6, 10.0)),
    "acoustic": lambda: wave.AcousticWave2D(np.full((8, 9), 1000.0), 5.0, [[2, 1], [5, 1]], [[1, 2], [6, 2]], 12, 0.002),
    "avo": lambda: avo.AVOLinearModelling([5, 15, 25.0], 0.5, 6, 3),
    "poststack": lambda: avo.PoststackLinearModelling(WAV, 12, 3),
    "poststack explicit": lambda: avo.PoststackLinearModelling(rng.normal(size=(12, 5)), 12, 3, explicit=True),
    "prestack": lambda: avo.PrestackLinearModelling(WAV, [5, 15, 25.0], 0.5, 12, 2, "fatti"),
    "wavelet": lambda: avo.PrestackWaveletModelling(rng.normal(size=(12, 3)), [5, 15.0], 5),
}


@pytest.mark.parametrize("name", REAL)
def test_adjoint(spark, name):
    assert dottest(REAL[name]())


def test_adjoint_complex(spark):
    for op, flag in ((basic.MatrixMult(A + 1j * A[::-1]), 3), (signal.FFT((3, 8)), 3), (signal.FFT(8, nfft=6, ifftshift_before=True, fftshift_after=True, norm="none"), 3), (basic.Real(5), 1), (basic.Imag(5), 1), (basic.Conj(5), 3), (wave.PressureToVelocity(8, 6, 0.004, 10.0, 1000.0, 1500.0, ntaper=3), 3)):
        assert dottest(op, complexflag=flag)


def test_algebra(spark):
    m, c = basic.MatrixMult(A), A + 1j * A[::-1]
    assert np.allclose((m.H @ m).todense(), A.T @ A)
    assert np.allclose((2 * m - m * 3.0).todense(), -A)
    assert np.allclose((m * (2 + 1j)).H.todense(), (A * (2 + 1j)).conj().T)
    assert np.allclose(basic.MatrixMult(c).T.todense(), c.T) and np.allclose(basic.MatrixMult(c).conj().todense(), c.conj())
    assert np.allclose((basic.Diagonal(X) ** 3).todense(), np.diag(X**3)) and np.allclose(m.matmat(A.T), A @ A.T)
    assert np.allclose(basic.MatrixMult(c).toreal().matvec(X), (c @ X).real)
    assert np.allclose(basic.Kronecker(m, m).todense(), np.kron(A, A))
    with pytest.raises(ValueError):
        m + basic.Identity(4)
    with pytest.raises(ValueError):
        m @ m
    with pytest.raises(ValueError):
        m.matvec(np.ones(3))
    assert "MatrixMult" in (m.H @ m).describe()
    f = FunctionOperator(lambda df: scaled(df, 2.0), lambda df: scaled(df, 2.0), 4)
    assert dottest(f)
    with pytest.raises(NotImplementedError):
        FunctionOperator(lambda df: df, 4).rmatvec(np.ones(4))


def test_memoize(spark):
    """Results are known by values: another plan of the same values gives what is kept, and old ones are forgotten."""
    op = MemoizeOperator(basic.MatrixMult(A), 1)
    before = len(storage.written)
    first = op.forward(vector(spark, X))
    assert op.forward(vector(spark, X).repartition(3)) is first and np.allclose(collected(first, 4), A @ X)
    assert np.allclose(collected(op.forward(vector(spark, X + 1)), 4), A @ (X + 1)) and op.forward(vector(spark, X)) is not first
    assert len(op.kept) == 1 and len(storage.written) == before + 1
    assert np.allclose(op.rmatvec(np.ones(4)), A.T @ np.ones(4))


def test_settings_and_types():
    m = basic.MatrixMult(A)
    with config.disabled_ndarray_multiplication(), pytest.raises(TypeError):
        m @ X
    assert config.get_ndarray_multiplication()
    assert m.dtype == float and basic.MatrixMult(A * 1j).dtype == complex and common_dtype([m, signal.FFT(4)], [np.float32]) == complex
    need_dtype(X, float, "x")
    with pytest.raises(TypeError):
        need_dtype(X * 1j, float, "x")


def test_dense_probes(spark):
    x = rng.normal(size=(5, 6))
    want = np.zeros((5, 6))
    want[1:-1] += x[2:] - 2 * x[1:-1] + x[:-2]
    want[:, 1:-1] += x[:, 2:] - 2 * x[:, 1:-1] + x[:, :-2]
    assert np.allclose(basic.Laplacian((5, 6)) @ x, want)
    assert np.allclose(basic.CausalIntegration((5, 6), 0) @ x, np.cumsum(x, axis=0))
    for kind in ("full", "half", "trapezoidal"):
        whole, cut = basic.CausalIntegration((5, 6), 1, 2.0, kind), basic.CausalIntegration((5, 6), 1, 2.0, kind, block=4)
        assert np.allclose(whole @ x, cut @ x) and np.allclose(whole.rmatvec(x), cut.rmatvec(x))
    h = rng.normal(size=3)
    assert np.allclose(signal.Convolve1D(6, h, 1) @ X, np.convolve(X, h, "same"))
    long = rng.normal(size=9)
    for dims, axis, offset in (((5, 6), 1, 0), ((5, 6), 1, 8), ((30,), 0, 3)):
        few, blocks = signal.Convolve1D(dims, long, offset, axis), signal.LongConvolve1D(dims, long, offset, axis, max(dims[axis], 9), 4)
        z = rng.normal(size=few.shape[1])
        assert np.allclose(few.matvec(z), blocks.matvec(z)) and np.allclose(few.rmatvec(few.matvec(z)), blocks.rmatvec(few.matvec(z)))
    assert np.allclose(signal.LongConvolve1D(30, long * 1j, 3, block=7).matvec(z), 1j * signal.Convolve1D(30, long, 3).matvec(z))
    assert np.allclose(signal.FFT2D((5, 6)) @ x, np.fft.fft2(x) / np.sqrt(30))
    f = signal.FFT(9, norm="none")
    z = rng.normal(size=9) + 0j
    assert np.allclose(f / (f @ z), z)
    w = signal.DWT(16, wavelet="db4", level=2).todense()
    assert np.allclose(w @ w.T, np.eye(16))
    for kind in (1, 2, 3, 4):
        d = signal.dct_matrix(7, kind)
        assert np.allclose(d @ d.T, np.eye(7))
    s = signal.Seislet(rng.normal(size=(8, 5)) * 0.1)
    y = rng.normal(size=40)
    assert np.allclose(s.inverse(s.matvec(y)), y)
    shifted = signal.Shift(16, 3, real=True) @ np.eye(16)[2]
    assert np.allclose(shifted, np.eye(16)[5])
    whole = signal.Windows(64, 16, 4, None)
    assert np.allclose(whole.matvec(np.ones(whole.shape[1])), (whole @ whole.H).matvec(np.ones(64)))
    assert np.allclose(estimates.convmtx(h, 6, 1), signal.Convolve1D(6, h, 1).todense())


@pytest.mark.parametrize("wavelet", ["haar", "db5", "sym4", "sym7", "bior1.3", "bior2.2", "bior2.6", "bior3.3", "rbio2.4", "rbio3.1"])
def test_wavelets_put_together_what_they_take_apart(wavelet):
    """Perfect reconstruction, and as many vanishing moments of what is taken apart as the name says."""
    low, high, dual_low, dual_high = signal.wavelet_filters(wavelet)
    n = 64
    periodic = lambda f: sum(c * np.eye(n)[(2 * np.arange(n // 2) + t) % n] for t, c in enumerate(f))
    apart, back = np.vstack([periodic(low), periodic(high)]), np.vstack([periodic(dual_low), periodic(dual_high)])
    assert np.allclose(back.T @ apart, np.eye(n), atol=1e-9)
    moments = {"h": 1, "d": 5, "s": int(wavelet[3:4] or 1) if wavelet.startswith("sym") else 0, "b": int(wavelet[4:5] or 0) if "bior" in wavelet else 0, "r": int(wavelet[-1]) if wavelet[-1].isdigit() else 0}[wavelet[0]]
    assert all(abs(high @ np.arange(len(high)) ** p) < 1e-6 * len(high) ** p for p in range(moments))


def test_wavelet_inverse(spark):
    x = rng.normal(size=24)
    for wavelet in ("sym3", "bior2.2"):
        op = signal.DWT(24, wavelet=wavelet, level=2)
        assert np.allclose(op.inverse(op.matvec(x)), x) and dottest(op)
    with pytest.raises(ValueError):
        signal.DWT(8, wavelet="coif9")


def test_reflection_and_wavelets():
    args = (2000, 1000, 2.0, 2300, 1200, 2.2, [0, 10, 20])
    assert np.allclose(avo.approx_zoeppritz_pp(*args), avo.zoeppritz_pp(*args))
    assert np.isclose(avo.zoeppritz_pp(*args)[0], (2300 * 2.2 - 2000 * 2) / (2300 * 2.2 + 2000 * 2))
    t = np.arange(20) * 0.004
    for make in (gaussian, ricker, ormsby, klauder):
        w, axis, mid = make(t) if make is not gaussian else make(t, 0.01)
        assert len(w) == len(axis) and np.isclose(w[mid], 1) and np.allclose(w, w[::-1])
    assert np.allclose(tapers.taper2d(3, 11, 3)[:, 0], tapers.hanningtaper(11, 3)) and tapers.taper3d(4, (5, 6), (2, 2)).shape == (5, 6, 4)


def test_eikonal_is_distance_in_a_constant_medium():
    t = wave.eikonal(np.full((12, 9), 0.5), 1.0, (3, 4), 3)
    want = 0.5 * np.hypot(*np.meshgrid(np.arange(12) - 3, np.arange(9) - 4, indexing="ij"))
    assert np.abs(t - want).max() < 0.35


def test_thresholds():
    x = np.array([-3.0, -0.5, 0.0, 0.4, 2.0])
    assert np.allclose(thresholds.softthreshold(x, 0.5), [-2.5, 0, 0, 0, 1.5])
    assert np.allclose(thresholds.hardthreshold(x, 0.5), [-3, 0, 0, 0, 2])
    assert np.allclose(thresholds.softthreshold(x * 1j, 0.5), np.array([-2.5, 0, 0, 0, 1.5]) * 1j)


def test_traces_and_eigenvalues(spark):
    m = A.T @ A
    op = basic.MatrixMult(m)
    assert np.isclose(op.trace(), np.trace(m)) and np.allclose(op.eigs(symmetric=True), np.linalg.eigvalsh(m)[::-1][np.argsort(-np.abs(np.linalg.eigvalsh(m)[::-1]), kind="stable")], atol=1e-8)
    assert abs(estimators.trace_hutchpp(op, 12) - np.trace(m)) < 0.5 * np.trace(m)
    assert np.isclose(estimators.trace_hutchinson(op, 6, "unitvector"), np.trace(m))
    assert np.isclose(basic.Diagonal(np.arange(1.0, 6)).cond(), 5)


def test_multi_batch_keys(spark):
    df = vector(spark, X).selectExpr("1 as who", "k", "v").union(vector(spark, 2 * X).selectExpr("2 as who", "k", "v"))
    out = basic.MatrixMult(A).forward(df)
    assert np.allclose(collected(out.where("who = 2").drop("who"), 4), 2 * A @ X)
