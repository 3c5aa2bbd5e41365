"""Iterative solvers. A solver asks its operator for products only, and its vectors for sums, multiples and dot products.

Vectors are numpy arrays, or Frames: then they stay distributed, and each new iterate is written to the folder of
``spark.checkpoint.dir`` so that lineage doesn't grow and lost executors cost nothing but their tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions import metrics, thresholds
from lattica.operators.basic import Diagonal, Identity, VStack
from lattica.operators.core import LinOp, batch, collected, complexed, filled, is_complex, parts, scaled, totalled, union, vector
from lattica.plans import storage


class Frame:
    """Distributed vector; path is where it is written, if it is."""

    def __init__(self, df: DataFrame, size: int, path: str | None = None):
        self.df, self.size, self.path = df, size, path

    def through(self, f: Callable) -> Frame:
        return Frame(f(self.df), self.size)

    def __add__(self, other: Frame) -> Frame:
        return Frame(totalled(union([self.df, other.df])), self.size)

    def __sub__(self, other: Frame) -> Frame:
        return self + -1.0 * other

    def __rmul__(self, alpha) -> Frame:
        return Frame(scaled(self.df, alpha), self.size)

    def __truediv__(self, alpha) -> Frame:
        return (1.0 / alpha) * self

    def dot(self, other: Frame) -> complex:
        a, b = (complexed(self.df), complexed(other.df)) if is_complex(self.df) or is_complex(other.df) else (self.df, other.df)
        both = a.alias("a").join(b.alias("b"), "k")
        if is_complex(a):
            x = both.agg(F.sum(F.expr("a.re * b.re + a.im * b.im")), F.sum(F.expr("a.re * b.im - a.im * b.re"))).first()
            return complex(x[0] or 0, x[1] or 0)
        return both.agg(F.sum(F.expr("a.v * b.v"))).first()[0] or 0.0

    def sizes(self) -> Column:
        """Modulus of each entry."""
        return F.abs("v") if "v" in self.df.columns else F.hypot("re", "im")

    def norm(self) -> float:
        return float(np.sqrt(self.df.agg(F.sum(sum((F.col(p) * F.col(p) for p in parts(self.df)), F.lit(0.0)))).first()[0] or 0.0))

    def norm1(self) -> float:
        return float(self.df.agg(F.sum(self.sizes())).first()[0] or 0.0)

    def percentile(self, q: float) -> float:
        """Exact percentile of the entries' moduli, those that are 0 and have no row included."""
        return thresholds.percentile(self.df.select(self.sizes().alias("x")), q, self.size)

    def largest(self) -> int:
        """Place of the largest modulus, the first of equal ones to a relative 1e-12."""
        top = self.df.agg(F.max(self.sizes())).first()[0] or 0.0
        return int(self.df.where(self.sizes() >= top * (1 - 1e-12)).agg(F.min("k")).first()[0] or 0)

    def kept(self) -> Frame:
        df, path = storage.write(self.df)
        return Frame(df, self.size, path)


class FrameDiagonal(LinOp):
    """Multiplies by a distributed vector; where it has no row, by ``rest``."""

    def __init__(self, d: Frame, rest: float = 0.0):
        super().__init__(d.size)
        self.d, self.rest = d, float(rest)

    def _forward(self, df):
        d = self.d.df.select(F.col("k").alias("_k"), F.col("v").alias("_d"))
        hit = df.join(d, F.col("k") == F.col("_k"), "left" if self.rest else "inner")
        return hit.select(*batch(df), "k", *[(F.coalesce("_d", F.lit(self.rest)) * F.col(p)).alias(p) for p in parts(df)])

    _adjoint = _forward


def dot(a, b):
    """<a, b>, conjugated in a."""
    return a.dot(b) if isinstance(a, Frame) else np.vdot(a, b)


def norm(a) -> float:
    return a.norm() if isinstance(a, Frame) else float(np.linalg.norm(a))


def keep(a):
    return a.kept() if isinstance(a, Frame) else a


def _real(x):
    return x.real if isinstance(x, complex) or np.iscomplexobj(x) else x


class Callbacks:
    """Hooks of a solver; those at the end of a phase run in reverse order."""

    def on_setup_begin(self, solver, x0):
        pass

    def on_setup_end(self, solver, x):
        pass

    def on_step_begin(self, solver, x):
        pass

    def on_step_end(self, solver, x):
        pass

    def on_run_begin(self, solver, x):
        pass

    def on_run_end(self, solver, x):
        pass


class MetricsCallback(Callbacks):
    """Metrics of each iterate against the truth, before Op if given."""

    def __init__(self, xtrue, Op: LinOp | None = None, which: Sequence[str] = ("mae", "mse", "snr", "psnr")):  # noqa: N803
        self.xtrue, self.op, self.which = xtrue, Op, which
        self.metrics: dict[str, list[float]] = {w: [] for w in which}

    def on_step_end(self, solver, x):
        x = self.op.matvec(x) if self.op is not None else x
        for w in self.which:
            self.metrics[w].append(getattr(metrics, w)(self.xtrue, x))


class Solver:
    """setup, then step until run has had niter steps or stop() says so."""

    def __init__(self, Op: LinOp, callbacks: Sequence[Callbacks] = ()):  # noqa: N803
        self.op, self.callbacks = Op, list(callbacks)
        self.iiter, self.cost = 0, []

    def _tell(self, event: str, x) -> None:
        for c in reversed(self.callbacks) if event.endswith("end") else self.callbacks:
            getattr(c, f"on_{event}")(self, x)

    def setup(self, y, x0=None, **kwargs):
        raise NotImplementedError

    def step(self, x):
        raise NotImplementedError

    def stop(self) -> bool:
        return False

    def memory_usage(self, vectors: int = 4) -> int:
        """Bytes of the vectors that a solver holds on the driver."""
        return 8 * vectors * max(self.op.shape)

    def run(self, x, niter: int):
        """Steps; the vectors that a step leaves behind are deleted after it."""
        self._tell("run_begin", x)
        since = getattr(self, "since", len(storage.written))
        while self.iiter < niter and not self.stop():
            self._tell("step_begin", x)
            x = self.step(x)
            self.iiter += 1
            self._tell("step_end", x)
            storage.sweep(since, self._live(x, self))
        self._tell("run_end", x)
        return x

    def _live(self, x, *holders) -> set[str]:
        held = [x, *(v for h in (*holders, *self.callbacks) for v in vars(h).values())]
        return {f.path for h in held for f in (h if isinstance(h, list) else [h]) if isinstance(f, Frame)}

    def solve(self, y, x0=None, niter: int = 10, **kwargs):
        """setup() and run(); of distributed vectors only the solution (and what callbacks hold) stays written."""
        self.since = len(storage.written)
        self._tell("setup_begin", x0)
        x = self.setup(y, x0, **kwargs)
        self._tell("setup_end", x)
        x = self.run(x, niter)
        storage.sweep(self.since, self._live(x))
        return x

    def _zero(self, y):
        if isinstance(y, Frame):
            return Frame(y.df.limit(0), self.op.shape[1])
        return np.zeros(self.op.shape[1], complex if np.iscomplexobj(y) or self.op.is_complex else float)


class CG(Solver):
    """Positive definite systems; ends when the squared norm of the residual is below tol."""

    def setup(self, y, x0=None, tol: float = 1e-4):
        self.tol = tol
        x = self._zero(y) if x0 is None else x0
        self.r = keep(y if x0 is None else y - self.op @ x)
        self.c, self.kold = self.r, _real(dot(self.r, self.r))
        self.cost = [self.kold**0.5]
        return x

    def stop(self):
        return self.kold <= self.tol

    def step(self, x):
        a = self.op @ self.c
        alpha = self.kold / _real(dot(self.c, a))
        x = keep(x + alpha * self.c)
        self.r = keep(self.r - alpha * a)
        k = _real(dot(self.r, self.r))
        self.c = keep(self.r + (k / self.kold) * self.c)
        self.kold = k
        self.cost.append(k**0.5)
        return x


class CGLS(Solver):
    """Least squares with damping."""

    def setup(self, y, x0=None, damp: float = 0.0, tol: float = 1e-4):
        self.damp, self.tol = damp**2, tol
        x = self._zero(y) if x0 is None else x0
        self.s = keep(y if x0 is None else y - self.op @ x)
        r = self.op.H @ self.s
        if x0 is not None and damp:
            r = r - self.damp * x
        self.c = keep(r)
        self.kold = _real(dot(self.c, self.c))
        self.q = keep(self.op @ self.c)
        self.cost = [norm(self.s)]
        return x

    def stop(self):
        return self.kold <= self.tol

    def step(self, x):
        alpha = self.kold / (_real(dot(self.q, self.q)) + (self.damp * _real(dot(self.c, self.c)) if self.damp else 0.0))
        x = keep(x + alpha * self.c)
        self.s = keep(self.s - alpha * self.q)
        r = self.op.H @ self.s
        r = keep(r - self.damp * x if self.damp else r)
        k = _real(dot(r, r))
        self.c = keep(r + (k / self.kold) * self.c)
        self.q = keep(self.op @ self.c)
        self.kold = k
        self.cost.append(norm(self.s))
        return x


class LSQR(Solver):
    """Paige and Saunders' bidiagonalisation with damping; istop says which test ended it."""

    def setup(self, y, x0=None, damp: float = 0.0, atol: float = 1e-8, btol: float = 1e-8, conlim: float = 1e8, calc_var: bool = False):
        self.damp, self.atol, self.btol = damp, atol, btol
        self.ctol = 1 / conlim if conlim > 0 else 0.0
        x = self._zero(y) if x0 is None else x0
        u = y if x0 is None else y - self.op @ x
        self.beta = norm(u)
        self.istop, self.anorm, self.acond, self.ddnorm, self.res2, self.xnorm, self.xxnorm = 0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0
        self.z, self.cs2, self.sn2 = 0.0, -1.0, 0.0
        self.u = keep(u / self.beta) if self.beta > 0 else u
        v = self.op.H @ self.u
        self.alfa = norm(v)
        self.v = keep(v / self.alfa) if self.alfa > 0 else v
        self.w = self.v
        self.var = np.zeros(self.op.shape[1]) if calc_var and not isinstance(y, Frame) else None
        self.rhobar, self.phibar, self.bnorm = self.alfa, self.beta, self.beta
        self.r1norm = self.r2norm = self.beta
        self.arnorm = self.alfa * self.beta
        if self.arnorm == 0:
            self.istop = 1
        self.cost = [self.beta]
        return x

    def stop(self):
        return self.istop > 0

    def step(self, x):
        u = keep(self.op @ self.v - self.alfa * self.u)
        self.beta = norm(u)
        if self.beta > 0:
            self.u = keep(u / self.beta)
            self.anorm = float(np.linalg.norm([self.anorm, self.alfa, self.beta, self.damp]))
            v = keep(self.op.H @ self.u - self.beta * self.v)
            self.alfa = norm(v)
            if self.alfa > 0:
                self.v = keep(v / self.alfa)
        rhobar1 = np.hypot(self.rhobar, self.damp)
        psi = self.damp / rhobar1 * self.phibar
        self.phibar *= self.rhobar / rhobar1
        rho = np.hypot(rhobar1, self.beta)
        cs, sn = rhobar1 / rho, self.beta / rho
        theta, self.rhobar = sn * self.alfa, -cs * self.alfa
        phi = cs * self.phibar
        self.phibar *= sn
        tau = sn * phi
        self.ddnorm += (norm(self.w) / rho) ** 2
        if self.var is not None:
            self.var = self.var + np.abs(self.w / rho) ** 2
        x = keep(x + (phi / rho) * self.w)
        self.w = keep(self.v - (theta / rho) * self.w)
        delta, gambar = self.sn2 * rho, -self.cs2 * rho
        rhs = phi - delta * self.z
        self.xnorm = float(np.sqrt(self.xxnorm + (rhs / gambar) ** 2))
        gamma = np.hypot(gambar, theta)
        self.cs2, self.sn2, self.z = gambar / gamma, theta / gamma, rhs / gamma
        self.xxnorm += self.z**2
        self.acond = self.anorm * np.sqrt(self.ddnorm)
        self.res2 += psi**2
        self.r2norm = float(np.sqrt(self.phibar**2 + self.res2))
        self.arnorm = self.alfa * abs(tau)
        r1sq = self.r2norm**2 - self.damp**2 * self.xxnorm
        self.r1norm = float(np.sign(r1sq) * np.sqrt(abs(r1sq)))
        self.cost.append(self.r1norm)
        test1 = self.r2norm / self.bnorm
        test2 = self.arnorm / (self.anorm * self.r2norm) if self.anorm * self.r2norm else 0.0
        test3 = 1 / self.acond if self.acond else np.inf
        t1 = test1 / (1 + self.anorm * self.xnorm / self.bnorm)
        rtol = self.btol + self.atol * self.anorm * self.xnorm / self.bnorm
        for hit, code in ((1 + test3 <= 1, 6), (1 + test2 <= 1, 5), (1 + t1 <= 1, 4), (test3 <= self.ctol, 3), (test2 <= self.atol, 2), (test1 <= rtol, 1)):
            if hit:
                self.istop = code
        return x


def cg(Op, y, x0=None, niter=10, tol=1e-4, callback=()):  # noqa: N803
    """(x, iterations, cost)."""
    s = CG(Op, callback)
    x = s.solve(y, x0, niter, tol=tol)
    return x, s.iiter, np.array(s.cost)


def cgls(Op, y, x0=None, niter=10, damp=0.0, tol=1e-4, callback=()):  # noqa: N803
    """(x, istop, iterations, r1norm, r2norm, cost)."""
    s = CGLS(Op, callback)
    x = s.solve(y, x0, niter, damp=damp, tol=tol)
    return x, 1 if s.kold < tol else 2, s.iiter, s.kold, float(np.sqrt(s.cost[-1] ** 2 + (damp * norm(x)) ** 2)), np.array(s.cost)


def lsqr(Op, y, x0=None, damp=0.0, atol=1e-8, btol=1e-8, conlim=1e8, niter=10, calc_var=False, callback=()):  # noqa: N803
    """(x, istop, iterations, r1norm, r2norm, anorm, acond, arnorm, xnorm, var, cost)."""
    s = LSQR(Op, callback)
    x = s.solve(y, x0, niter, damp=damp, atol=atol, btol=btol, conlim=conlim, calc_var=calc_var)
    if s.istop == 0:
        s.istop = 7
    return x, s.istop, s.iiter, s.r1norm, s.r2norm, s.anorm, s.acond, s.arnorm, s.xnorm, s.var, np.array(s.cost)


def _same_number(regs, dataregs, eps):
    dataregs = [None] * len(regs) if dataregs is None else list(dataregs)
    eps = [1.0] * len(regs) if eps is None else list(eps)
    if not len(regs) == len(dataregs) == len(eps):
        raise ValueError(f"{len(regs)} regularisations, but {len(dataregs)} data and {len(eps)} weights for them")
    return dataregs, eps


def normal_equations_inversion(Op, y, Regs=(), x0=None, Weight=None, dataregs=None, epsI=0.0, epsRs=None, NRegs=(), epsNRs=None, niter=100, tol=1e-10):  # noqa: N803
    """Solve (A^H W A + epsI^2 I + sum eps^2 R^H R + sum epsN^2 N) x = A^H W y + sum eps^2 R^H d by conjugate gradients."""
    dataregs, eps = _same_number(Regs, dataregs, epsRs)
    _, eps_n = _same_number(NRegs, None, epsNRs)
    w = Weight @ Op if Weight is not None else Op
    op = Op.H @ w
    rhs = Op.H @ (Weight @ y if Weight is not None else y)
    if epsI:
        op = op + epsI**2 * Identity(Op.shape[1])
    for r, d, e in zip(Regs, dataregs, eps, strict=True):
        op = op + e**2 * (r.H @ r)
        if d is not None:
            rhs = rhs + e**2 * (r.H @ d)
    for n, e in zip(NRegs, eps_n, strict=True):
        op = op + e**2 * n
    return cg(op, keep(rhs), x0, niter, tol)


def RegularizedOperator(Op, Regs, epsRs=(1,)):  # noqa: N802, N803
    return VStack([Op, *[e * r for r, e in zip(Regs, epsRs, strict=True)]])


def regularized_inversion(Op, y, Regs=(), x0=None, Weight=None, dataregs=None, epsRs=None, niter=10, engine="lsqr", **kwargs):  # noqa: N803
    """Least squares of the stack of W A and eps R against W y and eps d."""
    dataregs, eps = _same_number(Regs, dataregs, epsRs)
    op = RegularizedOperator(Weight @ Op if Weight is not None else Op, Regs, eps)
    y = Weight @ y if Weight is not None else y
    if isinstance(y, Frame):
        frames, at = [y.df], op.op.at if hasattr(op, "op") else op.at
        for d, e, low in zip(dataregs, eps, at[1:], strict=False):
            if d is not None:
                frames.append(scaled(d.df, e).withColumn("k", F.col("k") + low))
        rhs = Frame(union(frames), op.shape[0])
    else:
        rhs = np.concatenate([y, *[np.zeros(r.shape[0]) if d is None else e * np.ravel(d) for r, d, e in zip(Regs, dataregs, eps, strict=True)]])
    return {"lsqr": lsqr, "cgls": cgls}[engine](op, rhs, x0, niter=niter, **kwargs)


def preconditioned_inversion(Op, y, P, x0=None, niter=10, **kwargs):  # noqa: N803
    """Solve A P p = y and return P p first."""
    p, *rest = lsqr(Op @ P, y, x0, niter=niter, **kwargs)
    return (P @ p, *rest)


def power_iteration(Op, niter=10, tol=1e-5, seed=42):  # noqa: N803
    """(largest eigenvalue, its vector, iterations)."""
    b = np.random.default_rng(seed).normal(size=Op.shape[1])
    b = b / np.linalg.norm(b)
    old, i = 0.0, 0
    for i in range(1, niter + 1):  # noqa: B007
        new = Op.matvec(b)
        value = np.vdot(b, new)
        value = value if np.iscomplexobj(value) and abs(value.imag) > 1e-12 else value.real
        b = new / np.linalg.norm(new)
        if abs(value - old) < tol * abs(value):
            break
        old = value
    return value, b, i


class ISTA(Solver):
    """x <- T(x + alpha A^H (y - A x)) with a threshold T of the coefficients, or of their transform SOp^H x."""

    momentum = False

    def setup(self, y, x0=None, SOp=None, eps=0.1, alpha=None, tol=1e-10, threshkind="soft", perc=None, decay=None, monitorres=False):  # noqa: N803
        if threshkind not in ("soft", "hard", "half", *(f"{k}-percentile" for k in ("soft", "hard", "half"))):
            raise NotImplementedError(f"no threshold is called {threshkind}: soft, hard and half are known, alone or followed by -percentile")
        if threshkind.endswith("percentile") and perc is None:
            raise ValueError("a threshold by percentile needs perc")
        self.y, self.sop, self.tol, self.kind, self.perc, self.decay, self.monitor = y, SOp, tol, threshkind, perc, decay, monitorres
        if alpha is None:
            value = power_iteration(self.op.H @ self.op, 20, 1e-5)[0] if self.op.shape[1] > 1 else self.op.H.matvec(self.op.matvec(np.ones(1)))[0]
            alpha = 1.0 / float(abs(value) * 1.01)
        self.alpha, self.thresh, self.update = alpha, eps * alpha * 0.5, np.inf
        x = self._zero(y) if x0 is None else x0
        self.z, self.t, self.residual = x, 1.0, np.inf
        return x

    def stop(self):
        return self.update <= self.tol

    def _shrink(self, x):
        t = self.thresh * (1.0 if self.decay is None else self.decay[self.iiter])
        kind = self.kind.split("-")[0]
        f = getattr(thresholds, f"{kind}threshold")
        if self.perc is not None:
            level = x.percentile(100 - self.perc) if isinstance(x, Frame) else np.percentile(np.abs(x), 100 - self.perc)
            t = getattr(thresholds, f"{kind}_level")(level)
        if isinstance(x, Frame):
            return x.through(lambda df: thresholds.frame(df, kind, t))
        return f(x, t)

    def step(self, x):
        at = self.z if self.momentum else x
        res = self.y - self.op @ at
        size = norm(res)
        if self.monitor and size > self.residual:
            raise ValueError(f"the residual grew in step {self.iiter}: a smaller alpha or another eps is needed")
        self.residual = size
        new = at + self.alpha * (self.op.H @ res)
        new = self._shrink(new) if self.sop is None else self.sop @ self._shrink(self.sop.H @ new)
        new = keep(new)
        self.update = norm(new - x)
        if self.momentum:
            t = (1 + np.sqrt(1 + 4 * self.t**2)) / 2
            self.z = keep(new + ((self.t - 1) / t) * (new - x))
            self.t = t
        self.cost.append(0.5 * size**2)
        return new


class FISTA(ISTA):
    """ISTA with Nesterov's momentum."""

    momentum = True


def _sparse(kind, Op, y, x0=None, niter=10, SOp=None, eps=0.1, alpha=None, tol=1e-10, threshkind="soft", perc=None, decay=None, monitorres=False, callback=()):  # noqa: N803
    s = kind(Op, callback)
    x = s.solve(y, x0, niter, SOp=SOp, eps=eps, alpha=alpha, tol=tol, threshkind=threshkind, perc=perc, decay=decay, monitorres=monitorres)
    return x, s.iiter, np.array(s.cost)


def ista(Op, y, x0=None, niter=10, **kwargs):  # noqa: N803
    """(x, iterations, cost)."""
    return _sparse(ISTA, Op, y, x0, niter, **kwargs)


def fista(Op, y, x0=None, niter=10, **kwargs):  # noqa: N803
    return _sparse(FISTA, Op, y, x0, niter, **kwargs)


def _diagonal(w) -> LinOp:
    return FrameDiagonal(w) if isinstance(w, Frame) else Diagonal(w)


def _dense(x):
    """All entries of a vector as rows."""
    return Frame(filled(x.df, x.size), x.size) if isinstance(x, Frame) else x


def _each(x, on_frame: Callable[[Column], Column], on_array: Callable):
    """A real function of the entries' moduli."""
    if isinstance(x, Frame):
        return Frame(x.df.select("k", on_frame(x.sizes()).alias("v")), x.size)
    return on_array(np.abs(x))


def _top(x) -> float:
    return float(x.df.agg(F.max("v")).first()[0] or 0.0) if isinstance(x, Frame) else float(np.max(x))


def _nothing(like, n: int):
    return Frame(like.df.limit(0), n) if isinstance(like, Frame) else np.zeros(n, complex if np.iscomplexobj(like) else float)


class IRLS(Solver):
    """Weights 1/(|r| + eps), or 1/max(|r|, eps) with threshR, on the data, or |x| on the model, or both; a step solves the
    weighted system. Vectors may be distributed."""

    def setup(self, y, x0=None, threshR=False, epsR=1e-10, epsI=1e-10, tolIRLS=1e-10, kind="data", warm=False, inner=50):  # noqa: N803
        if kind not in ("data", "model", "datamodel"):
            raise NotImplementedError(f"{kind} is no kind of weights: data, model and datamodel are")
        self.y, self.thresh, self.eps_r, self.eps_i, self.tol, self.kind, self.warm, self.inner = y, threshR, epsR, epsI, tolIRLS, kind, warm, inner
        self.first, self.change = x0 is None, np.inf
        return _nothing(y, self.op.shape[1]) if x0 is None else x0 if isinstance(x0, Frame) else np.ravel(x0)

    def stop(self):
        return self.change < self.tol

    def step(self, x):
        op, y = self.op, self.y
        if not (self.first or self.kind == "model"):
            eps = self.eps_r
            weigh = (lambda r: 1.0 / F.greatest(r, F.lit(eps)), lambda r: 1.0 / np.maximum(r, eps)) if self.thresh else (lambda r: 1.0 / (r + F.lit(eps)), lambda r: 1.0 / (r + eps))
            w = keep(_each(_dense(y - op @ x), *weigh))
            top = _top(w)
            root = _diagonal(keep(_each(w, lambda v: F.sqrt(v / F.lit(top)), lambda v: np.sqrt(v / top))))
            op, y = root @ op, root @ y
        if self.kind == "data":
            new = normal_equations_inversion(op, y, epsI=self.eps_i, x0=x if self.warm else None, niter=self.inner, tol=1e-14)[0]
        elif self.first:
            new = lsqr(op, y, damp=self.eps_i, niter=self.inner)[0]
        else:
            size = _each(x, lambda v: v, lambda v: v)
            top = _top(size) or 1.0
            p = _diagonal(keep((1.0 / top) * size))
            new = p @ lsqr(op @ p, y, damp=self.eps_i, niter=self.inner)[0]
        new = keep(new)
        self.first, self.change = False, norm(new - x)
        return new


def irls(Op, y, x0=None, nouter=10, threshR=False, epsR=1e-10, epsI=1e-10, tolIRLS=1e-10, kind="data", warm=False, niter=50, callback=()):  # noqa: N803
    """(x, outer iterations): see IRLS."""
    s = IRLS(Op, callback)
    x = s.solve(y, x0, nouter, threshR=threshR, epsR=epsR, epsI=epsI, tolIRLS=tolIRLS, kind=kind, warm=warm, inner=niter)
    return x, s.iiter


class OMP(Solver):
    """Matching pursuit, orthogonal if niter_inner > 0: a step takes the column of the largest correlation, the first of equal
    ones. The columns chosen are held by the driver; data and correlations may be distributed. Norms of all columns (for
    normalizecols and optimal_coeff) take the dense matrix."""

    def setup(self, y, x0=None, niter_inner=40, sigma=1e-4, normalizecols=False, optimal_coeff=False):
        self.y, self.res, self.inner, self.sigma = y, y, niter_inner, sigma
        self.normalise, self.optimal = normalizecols, optimal_coeff
        self.cols: list[int] = []
        self.lengths = np.linalg.norm(self.op.todense(), axis=0) if normalizecols or optimal_coeff else None
        self.cost = [norm(y)]
        return _nothing(y, self.op.shape[1])

    def stop(self):
        return self.cost[-1] < self.sigma

    def _put(self, values: dict[int, complex], like):
        if isinstance(like, Frame):
            out = np.array([values[k] for k in sorted(values)])
            unit = vector(like.df.sparkSession, out)
            at = like.df.sparkSession.createDataFrame(list(enumerate(sorted(values))), "k long, _to long")
            return Frame(unit.join(F.broadcast(at), "k").select(F.col("_to").alias("k"), *parts(unit)), self.op.shape[1])
        x = np.zeros(self.op.shape[1], complex if np.iscomplexobj(list(values.values())) else float)
        x[list(values)] = list(values.values())
        return x

    def step(self, x):
        c = keep(self.op.H @ self.res)
        if isinstance(c, Frame):
            inverse = FrameDiagonal(Frame(vector(c.df.sparkSession, 1.0 / self.lengths), c.size)) if self.normalise else None
            best = (inverse @ c if self.normalise else c).largest()
        else:
            score = np.abs(c) / self.lengths if self.normalise else np.abs(c)
            best = int(np.argmax(score >= score.max() * (1 - 1e-12)))
        if self.inner == 0:
            if isinstance(c, Frame):
                at = c.df.where(F.col("k") == best).first()
                step = complex(at["re"], at["im"]) if is_complex(c.df) else at["v"]
            else:
                step = c[best]
            unit = self._put({best: step / self.lengths[best] ** 2 if self.optimal else step}, self.y)
            x, self.res = keep(x + unit), keep(self.res - self.op @ unit)
        else:
            if best not in self.cols:
                self.cols.append(best)
            part = lsqr(self.op.apply_columns(self.cols), self.y, niter=self.inner)[0]
            part = collected(part.df, len(self.cols)) if isinstance(part, Frame) else part
            x = keep(self._put(dict(zip(self.cols, part.tolist(), strict=True)), self.y))
            self.res = keep(self.y - self.op @ x)
        self.cost.append(norm(self.res))
        return x


def omp(Op, y, niter_outer=10, niter_inner=40, sigma=1e-4, normalizecols=False, optimal_coeff=False, callback=()):  # noqa: N803
    """(x, outer iterations, cost): see OMP."""
    s = OMP(Op, callback)
    x = s.solve(y, None, niter_outer, niter_inner=niter_inner, sigma=sigma, normalizecols=normalizecols, optimal_coeff=optimal_coeff)
    return x, s.iiter, np.array(s.cost)


def soft(x, t: float):
    return x.through(lambda df: thresholds.frame(df, "soft", t)) if isinstance(x, Frame) else thresholds.softthreshold(x, t)


class SplitBregman(Solver):
    """Sparse in each R x of RegsL1, with squared terms of RegsL2; vectors may be distributed."""

    def setup(self, y, x0=None, RegsL1=(), niter_inner=5, RegsL2=(), dataregsL2=None, mu=1.0, epsRL1s=None, epsRL2s=None, tol=1e-10, tau=1.0, restart=False, niter_lsqr=20):  # noqa: N803
        self.y, self.regs1, self.regs2, self.inner, self.niter = y, list(RegsL1), list(RegsL2), niter_inner, niter_lsqr
        self.mu, self.tol, self.tau, self.restart, self.change = mu, tol, tau, restart, np.inf
        self.eps1 = [1.0] * len(self.regs1) if epsRL1s is None else list(epsRL1s)
        self.data2, eps2 = _same_number(self.regs2, dataregsL2, epsRL2s)
        self.weights = [np.sqrt(e / 2) / np.sqrt(mu / 2) for e in eps2] + [np.sqrt(e / 2) / np.sqrt(mu / 2) for e in self.eps1]
        self.b, self.d = [_nothing(y, r.shape[0]) for r in self.regs1], [_nothing(y, r.shape[0]) for r in self.regs1]
        return _nothing(y, self.op.shape[1]) if x0 is None else x0 if isinstance(x0, Frame) else np.ravel(x0)

    def stop(self):
        return self.change < self.tol

    def step(self, x):
        old, rx = x, []
        for _ in range(self.inner):
            data = [*self.data2, *[p - q for p, q in zip(self.d, self.b, strict=True)]]
            x = regularized_inversion(self.op, self.y, [*self.regs2, *self.regs1], x0=None if self.restart else x, dataregs=data, epsRs=self.weights, niter=self.niter)[0]
            rx = [keep(r @ x) for r in self.regs1]
            self.d = [keep(soft(v + q, e)) for v, q, e in zip(rx, self.b, self.eps1, strict=True)]
        self.b = [keep(q + self.tau * (v - p)) for q, v, p in zip(self.b, rx, self.d, strict=True)]
        self.cost.append(0.5 * self.mu * norm(self.y - self.op @ x) ** 2 + sum(e * (v.norm1() if isinstance(v, Frame) else np.abs(v).sum()) for e, v in zip(self.eps1, rx, strict=True)))
        self.change = norm(x - old)
        return x


def splitbregman(Op, y, RegsL1, x0=None, niter_outer=3, niter_inner=5, RegsL2=(), dataregsL2=None, mu=1.0, epsRL1s=None, epsRL2s=None, tol=1e-10, tau=1.0, restart=False, niter=20, callback=()):  # noqa: N803
    """(x, outer iterations, cost): see SplitBregman."""
    s = SplitBregman(Op, callback)
    x = s.solve(y, x0, niter_outer, RegsL1=RegsL1, niter_inner=niter_inner, RegsL2=RegsL2, dataregsL2=dataregsL2, mu=mu, epsRL1s=epsRL1s, epsRL2s=epsRL2s, tol=tol, tau=tau, restart=restart, niter_lsqr=niter)
    return x, s.iiter, np.array(s.cost)


def l1_project(x, tau: float):
    """Nearest point of the L1 ball of radius tau. A distributed vector is cut by sums over what is above the level so far,
    which rises to its place in some steps."""
    if isinstance(x, Frame):
        if x.norm1() <= tau:
            return x
        level, n = 0.0, -1
        while True:
            total, count = x.df.where(x.sizes() > level).agg(F.sum(x.sizes()), F.count(F.lit(1))).first()
            if count == n or not count:
                return soft(x, level)
            level, n = (total - tau) / count, count
    a = np.abs(x)
    if a.sum() <= tau:
        return x
    u = np.sort(a)[::-1]
    at = np.flatnonzero(u - (np.cumsum(u) - tau) / np.arange(1, len(u) + 1) > 0)[-1]
    return thresholds.softthreshold(x, (np.cumsum(u)[at] - tau) / (at + 1))


class SPGL1(Solver):
    """Least squares in an L1 ball; a step solves for one radius, which grows by Newton steps until the residual is sigma.
    Vectors may be distributed."""

    def setup(self, y, x0=None, SOp=None, tau=0.0, sigma=0.0, inner=200, tol=1e-6):  # noqa: N803
        self.y, self.sop, self.tau, self.sigma, self.inner, self.tol = y, SOp, tau, sigma, inner, tol
        self.all = self.op @ SOp.H if SOp is not None else self.op
        self.alpha = 1.0 / abs(power_iteration(self.all.H @ self.all, 30)[0]) / 1.01
        self.history: list[tuple[float, float]] = []
        self.done = False
        return _nothing(y, self.all.shape[1]) if x0 is None else x0

    def stop(self):
        return self.done

    def step(self, p):
        op = self.all
        res = keep(self.y - op @ p)
        if not self.tau or self.history:
            back = op.H @ res
            g = float(back.df.agg(F.max(back.sizes())).first()[0] or 0.0) if isinstance(back, Frame) else np.abs(back).max()
            if norm(res) <= self.sigma * (1 + self.tol) + self.tol or g == 0:
                self.done = True
                return p
            radius = (self.history[-1][0] if self.history else 0.0) + (norm(res) - self.sigma) * norm(res) / g
        else:
            radius, self.done = self.tau, True
        z, t = p, 1.0
        for _ in range(self.inner):
            new = keep(l1_project(keep(z + self.alpha * (op.H @ (self.y - op @ z))), radius))
            t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
            z, change, p, t = keep(new + ((t - 1) / t_new) * (new - p)), norm(new - p), new, t_new
            if change < self.tol * max(1.0, norm(p)):
                break
        self.history.append((radius, norm(self.y - op @ p)))
        return p


def spgl1(Op, y, x0=None, SOp=None, tau=0.0, sigma=0.0, niter=200, roots=12, tol=1e-6, callback=()):  # noqa: N803
    """(x, p, info): see SPGL1."""
    s = SPGL1(Op, callback)
    p = s.solve(y, x0, 1 if tau else roots, SOp=SOp, tau=tau, sigma=sigma, inner=niter, tol=tol)
    return (SOp.H @ p if SOp is not None else p), p, {"tau": s.history[-1][0] if s.history else 0.0, "rnorm": s.history[-1][1] if s.history else norm(y), "history": s.history}


class _Inversion(Solver):
    """Inversion that another solver carries out: setup() makes its system, run() solves it; it has no steps of its own."""

    def step(self, x):
        raise NotImplementedError("the system's solver takes the steps: use run()")

    def run(self, x, niter: int):
        self._tell("run_begin", x)
        self.result = self._solve(x, niter)
        self._tell("run_end", self.result[0])
        return self.result[0]


class NormalEquationsInversion(_Inversion):
    def setup(self, y, x0=None, Regs=(), **kwargs):  # noqa: N803
        self.of = (y, Regs, kwargs)
        return x0

    def _solve(self, x, niter):
        y, regs, kwargs = self.of
        return normal_equations_inversion(self.op, y, regs, x, niter=niter, **kwargs)


class RegularizedInversion(_Inversion):
    def setup(self, y, x0=None, Regs=(), **kwargs):  # noqa: N803
        self.of = (y, Regs, kwargs)
        return x0

    def _solve(self, x, niter):
        y, regs, kwargs = self.of
        return regularized_inversion(self.op, y, regs, x, niter=niter, **kwargs)


class PreconditionedInversion(_Inversion):
    def setup(self, y, x0=None, P=None, **kwargs):  # noqa: N803
        self.of = (y, P, kwargs)
        return x0

    def _solve(self, x, niter):
        y, p, kwargs = self.of
        return preconditioned_inversion(self.op, y, p, x, niter=niter, **kwargs)
