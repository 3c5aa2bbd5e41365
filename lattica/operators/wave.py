"""Wave-equation operators: blending, Kirchhoff modelling, multi-dimensional convolution, phase shifts, decomposition."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import functions as F

from lattica.functions.tapers import tapernd
from lattica.operators.basic import Block, BlockDiag, Diagonal, HStack, Identity, MatrixMult, Pad, Roll, VStack, _Composite
from lattica.operators.core import LinOp, Relation, Stencil, as_dims, batch, coordinate, size, totalled
from lattica.operators.signal import FFT, FFTND, Convolve1D, Fredholm1, Shift


class BlendingContinuous(_Composite):
    """Records (ns, nr, nt) of shots fired at times overlap in one record (nr, nttot); whole samples by moving rows, the
    rest by a Fourier shift."""

    def __init__(self, nt: int, nr: int, ns: int, dt: float, times, shiftall: bool = False):
        times = np.asarray(times, float)
        at = np.floor(times / dt).astype(int)
        part = times - at * dt
        self.nttot = int(times.max() / dt + nt + 1)
        ops = []
        for i in range(ns):
            pad = _Place(nr, nt, self.nttot, 0 if shiftall else int(at[i]), nt)
            if shiftall:
                ops.append(Shift((nr, self.nttot), float(times[i]), 1, sampling=dt, real=True) @ pad)
            elif part[i] > 1e-12:
                ops.append(pad @ Shift((nr, nt), float(part[i]), 1, sampling=dt, real=True))
            else:
                ops.append(pad)
        super().__init__(HStack(ops), "BlendingContinuous", (ns, nr, nt), (nr, self.nttot))


class _Place(Stencil):
    """Lines of nt samples from sample ``at`` of lines of n on."""

    def __init__(self, nr: int, nt: int, n: int, at: int, _length: int):
        super().__init__((nr, nt), 1, [(-at, 1.0, at, min(n, at + nt) - 1)], n, "Place")


def BlendingGroup(nt, nr, ns, dt, times, group_size, n_groups):  # noqa: N802
    """Shots of one group fire together: group by group, the sum of its shifted shots."""
    times = np.reshape(times, (group_size, n_groups))
    groups = [HStack([Shift((nr, nt), float(times[i, g]), 1, sampling=dt, real=True) for i in range(group_size)]) for g in range(n_groups)]
    return _Composite(BlockDiag(groups), "BlendingGroup", (ns, nr, nt), (n_groups, nr, nt))


def BlendingHalf(nt, nr, ns, dt, times, group_size, n_groups):  # noqa: N802
    """Shots of equal place in the groups fire together."""
    times = np.reshape(times, (group_size, n_groups))
    parts = [BlockDiag([Shift((nr, nt), float(times[i, g]), 1, sampling=dt, real=True) for g in range(n_groups)]) for i in range(group_size)]
    return _Composite(HStack(parts), "BlendingHalf", (ns, nr, nt), (n_groups, nr, nt))


def eikonal(slowness: np.ndarray, spacing, source, sweeps: int = 8) -> np.ndarray:
    """First-arrival times on a grid by fast sweeping of the upwind eikonal equation."""
    s, h = np.asarray(slowness, float), np.broadcast_to(np.asarray(spacing, float), np.ndim(slowness))
    t = np.full(s.shape, np.inf)
    for near in np.ndindex(*[3] * s.ndim):
        at = tuple(int(np.clip(int(round(c)) + d - 1, 0, n - 1)) for c, d, n in zip(source, near, s.shape, strict=True))
        t[at] = np.linalg.norm((np.array(at) - np.asarray(source)) * h) * s[at]
    fixed = np.isfinite(t)
    for sweep in range(sweeps * 2**s.ndim):
        order = [range(n) if sweep >> a & 1 else range(n - 1, -1, -1) for a, n in enumerate(s.shape)]
        for at in np.ndindex(*s.shape):
            at = tuple(o[i] for o, i in zip(order, at, strict=True))
            if fixed[at]:
                continue
            low = sorted((min(t[at[:a] + (at[a] - 1,) + at[a + 1 :]] if at[a] else np.inf, t[at[:a] + (at[a] + 1,) + at[a + 1 :]] if at[a] + 1 < s.shape[a] else np.inf), h[a]) for a in range(s.ndim))
            new = np.inf
            for m in range(1, s.ndim + 1):
                w = np.array([1 / b**2 for _, b in low[:m]])
                a = np.array([x for x, _ in low[:m]])
                if not np.isfinite(a).all():
                    break
                q = (w @ a) ** 2 - w.sum() * (w @ a**2 - s[at] ** 2)
                if q < 0:
                    break
                new = (w @ a + np.sqrt(q)) / w.sum()
                if m == s.ndim or new <= low[m][0]:
                    break
            t[at] = min(t[at], new)
    return t


class Kirchhoff(_Composite):
    """Data (ns, nr, nt) of an image (nx, nz), or (ny, nx, nz): each point sends its value to the time from source to
    point to receiver, split between two samples, and a wavelet follows. Modes: analytic (constant velocity), eikonal,
    byot (times of your own, (points, ns) and (points, nr)). ``aperture`` bounds |x - midpoint| by aperture times depth;
    ``dynamic`` weighs by the amplitudes of geometrical spreading.
    """

    def __init__(self, z, x, t, srcs, recs, vel, wav, wavcenter: int, y=None, mode: str = "eikonal", dynamic: bool = False, trav=None, aperture: float | None = None):
        axes = [np.asarray(a, float) for a in ([y, x, z] if y is not None else [x, z])]
        dims = tuple(len(a) for a in axes)
        srcs, recs = np.asarray(srcs, float), np.asarray(recs, float)
        ns, nr, nt, dt = srcs.shape[1], recs.shape[1], len(t), t[1] - t[0]
        self.dims_image = dims
        if mode == "byot":
            ts, tr = (np.asarray(a, float).reshape(size(dims), -1) for a in trav)
        elif mode == "eikonal":
            spacing = [a[1] - a[0] for a in axes]
            grid = lambda p: eikonal(1 / np.broadcast_to(vel, dims), spacing, [(c - a[0]) / d for c, a, d in zip(p, axes, spacing, strict=True)]).ravel()
            ts, tr = (np.stack([grid(p) for p in pts.T], axis=1) for pts in (srcs, recs))
        elif mode == "analytic":
            mesh = np.stack([m.ravel() for m in np.meshgrid(*axes, indexing="ij")], axis=1)
            ts, tr = (np.linalg.norm(mesh[:, None, :] - pts.T[None], axis=2) / vel for pts in (srcs, recs))
        else:
            raise NotImplementedError(f"{mode} is no mode: analytic, eikonal and byot are")
        n = size(dims)

        def make(spark):
            def frame(times, name):
                p, i = np.meshgrid(np.arange(n), np.arange(times.shape[1]), indexing="ij")
                import pyarrow as pa

                return spark.createDataFrame(pa.table({"p": p.ravel(), name: i.ravel(), "t" + name: times.ravel()}))

            both = frame(ts, "s").join(frame(tr, "r"), "p")
            if aperture is not None:
                values = lambda a: F.array(*[F.lit(float(v)) for v in a])
                px = F.element_at(values(axes[-2]), (coordinate(F.col("p"), dims, len(dims) - 2) + 1).cast("int"))
                pz = F.element_at(values(axes[-1]), (coordinate(F.col("p"), dims, len(dims) - 1) + 1).cast("int"))
                mid = (F.element_at(values(srcs[-2]), (F.col("s") + 1).cast("int")) + F.element_at(values(recs[-2]), (F.col("r") + 1).cast("int"))) / 2
                both = both.where(F.abs(px - mid) <= F.lit(float(aperture)) * pz)
            tau = (F.col("ts") + F.col("tr")) / F.lit(float(dt))
            both = both.select("p", ((F.col("s") * nr + F.col("r")) * nt).alias("at"), F.floor(tau).cast("long").alias("i"), (tau - F.floor(tau)).alias("d"), (F.lit(1.0) / F.greatest(F.sqrt(F.col("ts") * F.col("tr")), F.lit(float(dt))) if dynamic else F.lit(1.0)).alias("w")).where(F.col("i").between(0, nt - 2))
            two = F.explode(F.array(F.struct(F.col("i").alias("i"), ((1 - F.col("d")) * F.col("w")).alias("a")), F.struct((F.col("i") + 1).alias("i"), (F.col("d") * F.col("w")).alias("a"))))
            return both.select("p", "at", two.alias("x")).select((F.col("at") + F.col("x.i")).alias("r"), F.col("p").alias("c"), F.col("x.a").alias("a"))

        spray = Relation(dims, (ns, nr, nt), make, name="Spray")
        super().__init__(Convolve1D((ns, nr, nt), wav, wavcenter, -1) @ spray, "Kirchhoff", dims, (ns, nr, nt))


class LSM:
    """Least-squares migration: a modelling operator and its inversion. kirchhoff takes what Kirchhoff does; twoway takes
    what AcousticWave2D does: velocities, spacing, sources and receivers as grid points, nt, dt and f0."""

    def __init__(self, *args, kind: str = "kirchhoff", **kwargs):
        engines = {"kirchhoff": Kirchhoff, "twoway": AcousticWave2D}
        if kind not in engines:
            raise NotImplementedError(f"no engine is called {kind}")
        self.Demop = engines[kind](*args, **kwargs)

    def solve(self, d, solver: Callable | None = None, **kwargs) -> np.ndarray:
        from lattica.plans.solvers import lsqr

        out = (solver or lsqr)(self.Demop, np.ravel(d), **kwargs)
        return np.reshape(out[0] if isinstance(out, tuple) else out, self.Demop.dims)


def MDC(G, nt: int, nv: int, dt: float = 1.0, dr: float = 1.0, twosided: bool = True, conj: bool = False, prescaled: bool = False):  # noqa: N802, N803
    """Multi-dimensional convolution F^H G F of data (nt, nr, nv) with a kernel (nf, ns, nr) of frequencies."""
    G = np.asarray(G)  # noqa: N806
    if twosided and nt % 2 == 0:
        raise ValueError(f"a two-sided model has an odd number of times, not {nt}")
    nf, ns, nr = G.shape
    nfft = nt // 2 + 1
    if nf > nfft:
        nf, G = nfft, G[:nfft]  # noqa: N806
    scale = 1.0 if prescaled else dr * dt * np.sqrt(nt)
    into = FFT((nt, nr, nv) if nv > 1 else (nt, nr), 0, real=True, ifftshift_before=twosided)
    out = FFT((nt, ns, nv) if nv > 1 else (nt, ns), 0, real=True)
    cut = lambda rows: Identity((nf * rows,), (nfft * rows,))
    kernel = Fredholm1(scale * G, nv)
    kernel = kernel.conj() if conj else kernel
    op = out.H @ cut(ns * nv).H @ kernel @ cut(nr * nv) @ into
    return _Composite(op, "MDC", into.dims, out.dims)


def MDD(G, d, dt=0.004, dr=1.0, nfmax=None, wav=None, twosided=True, adjoint=False, psf=False, niter: int = 20, **kwargs):  # noqa: N802, N803
    """Deconvolution of data d (ns, nv, nt) by a kernel G (ns, nr, nt): the model (nr, nv, nt2), and if asked the adjoint's
    and the point-spread function."""
    from lattica.plans.solvers import lsqr

    G, d = np.asarray(G, float), np.asarray(d, float)  # noqa: N806
    d = d if d.ndim == 3 else d[:, None, :]
    ns, nr, nt = G.shape
    nv = d.shape[1]
    nt2 = 2 * nt - 1 if twosided else nt
    kernel = np.fft.rfft(G, nt2, axis=-1) / np.sqrt(nt2)
    nf = min(nfmax or kernel.shape[-1], kernel.shape[-1])
    if wav is not None:
        kernel = kernel * np.abs(np.fft.rfft(wav, nt2))
    op = MDC(np.moveaxis(kernel[..., :nf], -1, 0), nt2, nv, dt, dr, twosided)
    # G and d start at time 0; a two-sided model is centred.
    y = np.zeros((nt2, ns, nv))
    y[:nt] = np.moveaxis(d, -1, 0)
    model, *_ = lsqr(op, y.ravel(), niter=niter, **kwargs)
    shape = lambda x: np.squeeze(np.moveaxis(np.reshape(x, (nt2, nr, nv)), 0, -1))
    out = [shape(model)]
    if adjoint:
        out.append(shape(op.H.matvec(y.ravel())))
    if psf:
        op2 = MDC(np.moveaxis(kernel[..., :nf], -1, 0), nt2, nr, dt, dr, twosided)
        y2 = np.zeros((nt2, ns, nr))
        y2[:nt] = np.moveaxis(G, -1, 0)
        out.append(np.moveaxis(op2.H.matvec(y2.ravel()).reshape(nt2, nr, nr), 0, -1))
    return out[0] if len(out) == 1 else tuple(out)


def _vertical(vel, freq, kx, ky=None) -> np.ndarray:
    """Vertical wavenumber (freq, [ky,] kx); evanescent parts decay."""
    f = np.asarray(freq, float).reshape(-1, *[1] * (1 if ky is None else 2))
    k2 = np.asarray(kx, float) ** 2 if ky is None else np.asarray(ky, float)[:, None] ** 2 + np.asarray(kx, float)[None, :] ** 2
    q = (f / vel) ** 2 - k2
    return np.where(q >= 0, np.sqrt(np.abs(q)) * np.sign(f), 0) - 1j * np.where(q < 0, np.sqrt(np.abs(q)), 0)


class PhaseShift(_Composite):
    """Extrapolation of a wavefield (nt, [ny,] nx) over a depth dz in a constant medium."""

    def __init__(self, vel: float, dz: float, nt: int, freq, kx, ky=None):
        space = (len(kx),) if ky is None else (len(ky), len(kx))
        kz = _vertical(vel, freq, kx, ky)
        ft = FFT((nt, *space), 0, real=True)
        kz = kz[: ft.dimsd[0]]
        op = Diagonal(np.exp(-2j * np.pi * dz * kz.real) * np.exp(-2 * np.pi * abs(dz) * np.abs(kz.imag)))
        fx = FFTND(ft.dimsd, tuple(range(1, len(space) + 1)))
        super().__init__(ft.H @ fx.H @ op @ fx @ ft, "PhaseShift", ft.dims, ft.dims)


def Deghosting(p, nt, nr, dt, dr, vel, zrec, kind="p", pd=None, win=None, npad=0, ntaper=0, restriction=None, sptransf=None, solver=None, niter=20, **kwargs):  # noqa: N802
    """(up-going, down-going) parts of pressure or velocity (nt, [nry,] nrx) below a free surface.

    The ghost is the up-going part, tapered by ``ntaper`` traces at the edges and padded by ``npad``, moved over twice the
    depth, of opposite sign for pressure. pd, the direct wave, is taken off first and counts as down-going; win is a window
    that data and model of them share; restriction says which traces there are, and sptransf the domain that is solved for.
    """
    from lattica.plans.solvers import lsqr

    if kind not in ("p", "vz"):
        raise ValueError(f"{kind} is no kind of data: p and vz are")
    nr = as_dims(nr)
    npad, ntaper = (np.broadcast_to(x, len(nr)) for x in (npad, ntaper))
    wide = [n + 2 * int(q) for n, q in zip(nr, npad, strict=True)]
    ks = [np.fft.fftfreq(n, d) for n, d in zip(wide, np.broadcast_to(dr, len(nr)), strict=True)]
    shift = PhaseShift(vel, 2 * zrec, nt, np.fft.rfftfreq(nt, dt), ks[-1], ks[0] if len(nr) == 2 else None)
    if npad.any():
        pad = Pad((nt, *nr), [(0, 0), *[(int(q), int(q)) for q in npad]])
        shift = pad.H @ shift @ pad
    if ntaper.any():
        edge = tapernd(nr, [int(x) for x in ntaper])
        shift = shift @ Diagonal(np.broadcast_to(edge, (nt, *nr)).ravel())
    ghost = Identity(shift.shape[0]) + (-1.0 if kind == "p" else 1.0) * shift
    data = np.ravel(p) - (0.0 if pd is None else np.ravel(pd) if restriction is None else restriction.matvec(np.ravel(pd)))
    op = ghost if restriction is None else restriction @ ghost
    if win is not None:
        w = np.broadcast_to(win, np.shape(p)).ravel().astype(float)
        op, data = Diagonal(w) @ op, w * data
    if sptransf is not None:
        op = op @ sptransf
    up = (solver or lsqr)(op, data, niter=niter, **kwargs)[0]
    up = np.real(up if sptransf is None else sptransf.matvec(up))
    down = np.ravel(ghost.matvec(up)).real - up + (0.0 if pd is None else np.ravel(pd)) if restriction is not None else np.ravel(p) - up
    return up.reshape(nt, *nr), down.reshape(nt, *nr)


def _obliquity(nt, nr, dt, dr, rho, vel, critical=100.0, ntaper=10, composition=True):
    """(FFT, Diagonal): the scaling between pressure and vertical velocity of plane waves."""
    nr, dr = as_dims(nr), np.broadcast_to(np.atleast_1d(dr), len(as_dims(nr)))
    fft = FFTND((*nr, nt), tuple(range(len(nr) + 1)), sampling=(*[float(d) for d in dr], dt))
    k = np.meshgrid(*fft.fs[:-1], indexing="ij")
    w = fft.fs[-1]
    k2 = sum(x**2 for x in k)[..., None]
    kz = np.sqrt(np.maximum((w / vel) ** 2 - k2, 0))
    inside = np.sqrt(k2) < critical / 100 * np.abs(w) / vel
    if composition:
        obl = rho * np.abs(w) / np.where(kz > 0, kz, 1) * (kz > 0)
    else:
        obl = kz / (rho * np.where(w != 0, np.abs(w), 1)) * (w != 0)
    mask = inside.astype(float)
    if ntaper > 1:
        ramp = np.hanning(ntaper + 2)[1:-1]
        ramp = ramp / ramp.sum()
        for a in range(len(nr)):
            mask = np.apply_along_axis(lambda m: np.convolve(m, ramp, "same"), a, mask)
    return fft, Diagonal((obl * mask).astype(complex))


class PressureToVelocity(_Composite):
    def __init__(self, nt, nr, dt, dr, rho, vel, critical=100.0, ntaper=10, topressure=False):
        fft, obl = _obliquity(nt, nr, dt, dr, rho, vel, critical, ntaper, topressure)
        super().__init__(fft.H @ obl @ fft, "PressureToVelocity", fft.dims, fft.dims)


class UpDownComposition2D(_Composite):
    """Pressure and scaled velocity of the down-going and up-going pressure."""

    def __init__(self, nt, nr, dt, dr, rho, vel, critical=100.0, ntaper=10, scaling=1.0):
        fft, obl = _obliquity(nt, nr, dt, dr, rho, vel, critical, ntaper, False)
        one = Identity(fft.shape[0])
        op = BlockDiag([fft.H, scaling * fft.H]) @ Block([[one, one], [obl, -obl]]) @ BlockDiag([fft, fft])
        super().__init__(op, type(self).__name__, (2, *fft.dims), (2, *fft.dims))


class UpDownComposition3D(UpDownComposition2D):
    pass


def WavefieldDecomposition(p, vz, nt, nr, dt, dr, rho, vel, critical=100.0, ntaper=10, scaling=1.0, kind="inverse", niter=20, **kwargs):  # noqa: N802
    """(up-going, down-going) pressure of pressure and vertical velocity (nr, nt)."""
    from lattica.plans.solvers import lsqr

    p, vz = np.asarray(p), np.asarray(vz)
    if kind == "analytical":
        scaled = PressureToVelocity(nt, nr, dt, dr, rho, vel, critical, ntaper, True).matvec(vz.ravel()).reshape(p.shape).real
        return (p - scaled) / 2, (p + scaled) / 2
    if kind != "inverse":
        raise KeyError(f"{kind} is no way to decompose: analytical and inverse are")
    op = UpDownComposition2D(nt, nr, dt, dr, rho, vel, critical, ntaper, scaling)
    x = lsqr(op, np.concatenate([p.ravel(), scaling * vz.ravel()]).astype(complex), niter=niter, **kwargs)[0]
    down, up = x.reshape(2, *p.shape).real
    return up, down


def smoothed(x: np.ndarray, n: int) -> np.ndarray:
    """Moving mean of n along the last axis, forwards and then backwards, so without a delay; beyond its ends a line goes on
    by reflection through its end points, and before that as the last value."""
    far = min(3 * n, x.shape[-1] - 1)
    x = np.concatenate([2 * x[..., :1] - x[..., far:0:-1], x, 2 * x[..., -1:] - x[..., -2 : -far - 2 : -1]], axis=-1)
    for _ in range(2):
        x = np.concatenate([np.repeat(x[..., :1], n, axis=-1), x], axis=-1)
        sums = np.cumsum(x, axis=-1)
        x = ((sums[..., n:] - sums[..., :-n]) / n)[..., ::-1]
    return x[..., far : x.shape[-1] - far]


class Marchenko:
    """Focusing functions by inversion of coupled reflection responses R (ns, nr, nt), or their spectra with nt.

    Times run from -(nt - 1) to nt - 1. With W the window between the direct wave and its mirror, R the convolution with
    the responses and R* the correlation, f solves [1, -W R; -W R*, 1] [W, 0; 0, W] f = [W R fd; 0], fd being the direct
    wave reversed in time.
    """

    def __init__(self, R, dt=0.004, nt=None, dr=1.0, nfmax=None, wav=None, toff=0.0, nsmooth=10, prescaled=False):  # noqa: N803
        R = np.asarray(R)  # noqa: N806
        if np.iscomplexobj(R) and nt is None:
            raise ValueError("responses by frequency need nt")
        self.ns, self.nr = R.shape[:2]
        self.nt = nt if np.iscomplexobj(R) else R.shape[2]
        self.dt, self.dr, self.wav, self.toff, self.nsmooth, self.prescaled = dt, dr, wav, toff, nsmooth, prescaled
        self.nt2 = 2 * self.nt - 1
        if not np.iscomplexobj(R):
            # Responses begin in the middle of the two-sided times.
            R = np.fft.rfft(np.pad(R, ((0, 0), (0, 0), (self.nt - 1, 0))), axis=-1) / np.sqrt(self.nt2)  # noqa: N806
        nf = min(nfmax or R.shape[-1], (self.nt2 + 1) // 2, R.shape[-1])
        self.kernel = np.moveaxis(R[..., :nf], -1, 0)

    def window(self, trav) -> np.ndarray:
        """(nt2, receivers, points): 1 before the direct wave and after its mirror, smooth at the edges."""
        last = np.round((np.asarray(trav, float) - self.toff) / self.dt).astype(int)[..., None]
        w = (np.abs(np.arange(self.nt2) - self.nt + 1) < last).astype(float)
        return np.moveaxis(smoothed(w, self.nsmooth) if self.nsmooth > 0 else w, -1, 0)

    def operators(self, nv: int = 1) -> tuple[LinOp, LinOp]:
        """(R, R*) on (nt2, receivers, points): convolution with the responses, and correlation."""
        make = lambda conj: MDC(self.kernel, self.nt2, nv, self.dt, self.dr, True, conj, self.prescaled)
        # The correlation's time 0 falls one sample late on an axis of odd length.
        return make(False), Roll((self.nt2, self.ns * nv), 0, -1) @ make(True)

    def apply_multiplepoints(self, trav, G0=None, nfft=None, rtm: bool = False, greens: bool = False, niter: int = 10, **kwargs):  # noqa: N803
        """(f1 minus, f1 plus[, p0 minus][, green minus, green plus]) for points with travel times trav (nr, points) and
        direct waves G0 (nr, points, nt), each (nr, points, nt2)."""
        from lattica.plans.solvers import lsqr

        trav = np.asarray(trav, float)
        nv = trav.shape[1]
        if G0 is None:
            if self.wav is None or nfft is None:
                raise ValueError("without G0, wav and nfft are needed")
            G0 = np.stack([directwave(self.wav, trav[:, v], self.nt, self.dt, nfft=nfft, derivative=True).T for v in range(nv)], axis=1)  # noqa: N806
        n = self.nt2 * self.nr * nv
        direct = np.concatenate([np.moveaxis(np.asarray(G0), -1, 0)[::-1], np.zeros((self.nt - 1, self.nr, nv))]).ravel()
        r, back = self.operators(nv)
        w, one = Diagonal(self.window(trav).ravel()), Identity(n)
        p0 = r.matvec(direct)
        m = Block([[one, -1.0 * (w @ r)], [-1.0 * (w @ back), one]]) @ BlockDiag([w, w])
        f = lsqr(m, np.concatenate([self.window(trav).ravel() * p0, np.zeros(n)]), niter=niter, **kwargs)[0]
        f[n:] += direct
        shape = lambda x: np.moveaxis(x.reshape(self.nt2, -1, nv), 0, -1)
        out = [shape(f[:n]), shape(f[n:])]
        if rtm:
            out.append(shape(p0))
        if greens:
            out += [-shape(f[:n] - r.matvec(f[n:])), shape(f[n:] - back.matvec(f[:n]))[..., ::-1]]
        return tuple(out)

    def apply_onepoint(self, trav, G0=None, nfft=None, rtm: bool = False, greens: bool = False, niter: int = 10, **kwargs):  # noqa: N803
        """apply_multiplepoints() for one point: trav (nr,), G0 (nr, nt), results (nr, nt2)."""
        many = self.apply_multiplepoints(np.asarray(trav).reshape(-1, 1), None if G0 is None else np.asarray(G0)[:, None], nfft, rtm, greens, niter, **kwargs)
        return tuple(x[:, 0] for x in many)


def directwave(wav, trav, nt, dt, nfft=None, dist=None, kind="2d", derivative=True) -> np.ndarray:
    """(nt, nr): analytic direct arrival, from the far form of the Hankel function in 2-D and exactly in 3-D."""
    nfft = nfft or nt
    trav = np.asarray(trav, float)
    w = 2 * np.pi * np.fft.rfftfreq(nfft, dt)[:, None]
    spectrum = np.fft.rfft(wav, nfft)[:, None]
    phase = w * trav[None, :]
    if kind == "2d":
        h = hankel2(np.maximum(phase, 1e-30))
        out = -0.25j * spectrum * h
        out[0] = 0
    else:
        out = spectrum * np.exp(-1j * phase) / (4 * np.pi * np.asarray(dist)[None, :])
    if derivative:
        out = out * 1j * w
    return np.fft.irfft(out, nfft, axis=0)[:nt]


def hankel2(x: np.ndarray) -> np.ndarray:
    """H0 of the second kind, J0 - i Y0, from their integrals, or far out from its asymptotic form."""
    x = np.asarray(x, float)
    flat = x.ravel()
    out = np.sqrt(2 / (np.pi * np.maximum(flat, 1e-300))) * np.exp(-1j * (flat - np.pi / 4))
    sine = np.sin((np.arange(2000) + 0.5) * np.pi / 2000)
    sinh = np.sinh((np.arange(4000) + 0.5) * 12.0 / 4000)
    near = np.flatnonzero(flat <= 50)
    for at in np.split(near, range(256, len(near), 256)):
        v = flat[at][:, None]
        out[at] = np.cos(v * sine).mean(axis=1) - 1j * (np.sin(v * sine).mean(axis=1) - 2 / np.pi * np.exp(-v * sinh).sum(axis=1) * (12.0 / 4000))
    return out.reshape(x.shape)


def SeismicInterpolation(data, nrec, iava, kind="fk", niter=50, eps=0.1, nffts=None, paxis=None, taxis=None, spataxis=None, epsR=0.1, nwin=None, nover=None, nop=None, **kwargs):  # noqa: N802, N803
    """Traces (nrec, nt) of those at iava: smooth in space, or sparse in the f-k, Radon, or windowed Radon domain."""
    from lattica.operators.basic import Restriction, SecondDerivative
    from lattica.operators.signal import FFT2D, ChirpRadon2D, Radon2D, Sliding2D
    from lattica.plans.solvers import fista, regularized_inversion

    data = np.asarray(data)
    nt = data.shape[-1]
    r = Restriction((nrec, nt), iava, 0)
    if kind == "spatial":
        x = regularized_inversion(r, data.ravel(), [SecondDerivative((nrec, nt), 0)], epsRs=[epsR], niter=niter)[0]
        return x.reshape(nrec, nt), x.reshape(nrec, nt)
    if kind == "fk":
        p = FFT2D((nrec, nt), nffts=nffts).H
    elif kind.startswith("radon-"):
        p = Radon2D(taxis, spataxis, paxis, kind[6:])
    elif kind == "chirpradon-linear":
        p = ChirpRadon2D(taxis, spataxis, paxis).H
    elif kind == "sliding":
        inner = Radon2D(taxis, np.asarray(spataxis)[:nwin], paxis, "linear")
        p = Sliding2D(inner, None, (nrec, nt), nwin, nover)
    else:
        raise KeyError("kind must be spatial, fk, radon-linear, radon-parabolic, radon-hyperbolic, chirpradon-linear or sliding")
    coef = fista(r @ p, data.ravel().astype(complex if p.is_complex else float), niter=niter, eps=eps, **kwargs)[0]
    return np.real(p.matvec(coef)).reshape(nrec, nt), coef.reshape(p.dims)


class AcousticWave2D(LinOp):
    """Born modelling of a model update (nx, nz) to data (ns, nr, nt): second-order waves in a constant-density medium,
    one Spark task for each shot. The adjoint runs the same recurrence backwards."""

    def __init__(self, vp, spacing, src, rec, nt: int, dt: float, f0: float = 20.0):
        vp = np.asarray(vp, float)
        self.src, self.rec = np.asarray(src, int), np.asarray(rec, int)
        super().__init__(vp.shape, (len(self.src), len(self.rec), nt))
        h = float(np.ravel(spacing)[0])
        if (vp.max() * dt / h) > 0.7:
            raise ValueError("the time step is too long for the grid")
        t = np.arange(nt) * dt - 1.0 / f0
        a = (np.pi * f0 * t) ** 2
        self.wavelet, self.c2 = (1 - 2 * a) * np.exp(-a), (vp * dt / h) ** 2
        self.nt = nt

    @staticmethod
    def _laplacian(u):
        out = -4 * u
        out[1:] += u[:-1]
        out[:-1] += u[1:]
        out[:, 1:] += u[:, :-1]
        out[:, :-1] += u[:, 1:]
        return out

    def _background(self, s):
        """Second time differences of the shot's wavefield, the Born sources."""
        u0, u1 = np.zeros_like(self.c2), np.zeros_like(self.c2)
        out = []
        for it in range(self.nt):
            u2 = 2 * u1 - u0 + self.c2 * self._laplacian(u1)
            u2[tuple(self.src[s])] += self.wavelet[it]
            out.append(u2 - 2 * u1 + u0)
            u0, u1 = u1, u2
        return out

    def _shot(self, s, m):
        u0, u1 = np.zeros_like(m), np.zeros_like(m)
        out = np.zeros((len(self.rec), self.nt))
        for it, q in enumerate(self._background(s)):
            u0, u1 = u1, 2 * u1 - u0 + self.c2 * self._laplacian(u1) + m * q
            out[:, it] = u1[self.rec[:, 0], self.rec[:, 1]]
        return out

    def _unshot(self, s, d):
        p0, p1 = np.zeros_like(self.c2), np.zeros_like(self.c2)
        image = np.zeros_like(self.c2)
        fields = self._background(s)
        for it in reversed(range(self.nt)):
            p2 = 2 * p1 - p0 + self._laplacian(self.c2 * p1)
            np.add.at(p2, (self.rec[:, 0], self.rec[:, 1]), d[:, it])
            image += p2 * fields[it]
            p0, p1 = p1, p2
        return image

    def _run(self, df, adjoint):
        import pandas as pd

        n, per = len(self.src), len(self.rec) * self.nt
        me, keys = self, batch(df)
        if adjoint:
            df = df.withColumn("_s", ((F.col("k") - F.col("k") % per) / per).cast("int")).withColumn("k", F.col("k") % per)
        else:
            df = df.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))

        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            s = int(pdf["_s"].iloc[0])
            x = np.zeros(per if adjoint else me.c2.size)
            np.add.at(x, pdf["k"].to_numpy(), pdf["v"].to_numpy())
            out = me._unshot(s, x.reshape(len(me.rec), me.nt)) if adjoint else me._shot(s, x.reshape(me.c2.shape))
            return pd.DataFrame({**{c: pdf[c].iloc[0] for c in keys}, "k": np.arange(out.size) + (0 if adjoint else s * per), "v": out.ravel()})

        kinds = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keys), "k long", "v double"])
        return totalled(df.groupBy(*keys, "_s").applyInPandas(one, kinds))

    def _forward(self, df):
        return self._run(df, False)

    def _adjoint(self, df):
        return self._run(df, True)


__all__ = ["AcousticWave2D", "BlendingContinuous", "BlendingGroup", "BlendingHalf", "Deghosting", "Kirchhoff", "LSM", "MDC", "MDD", "Marchenko", "PhaseShift", "PressureToVelocity", "SeismicInterpolation", "UpDownComposition2D", "UpDownComposition3D", "WavefieldDecomposition", "directwave", "eikonal", "hankel2", "MatrixMult", "VStack"]
