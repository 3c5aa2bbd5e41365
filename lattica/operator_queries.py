"""Queries of operators in both directions over all vectors of the embeddings, and their matrices in SQL.

Each vector of 64 is a batch key; an operator's matrix is told in SQL as rows (r, c, a[, ai]), from the operator's definition.
A query gives y = A x, A^H x, A^H A x or A A^H x, whichever take vectors of 64; values that round to 0 are left out.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lattica.operators import avo, basic, core, signal, wave
from lattica.operators.core import batch, parts

QUERIES: dict = {}
SQL: dict[str, str] = {}

EMB = "with emb as (select vec_id::bigint i0, (generate_subscripts(embedding, 1) - 1)::bigint i1, unnest(embedding)::double v from embeddings)"
ALL = "select r, c, {} from range(64) s(r), range(64) t(c)"


def vectors(spark, sf_dir):
    """One vector of 64 for each vec_id, which is a batch key."""
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return df.select(F.col("vec_id").alias("i0"), F.posexplode("embedding").alias("j", "x")).select("i0", F.col("j").cast("long").alias("k"), F.col("x").cast("double").alias("v"))


def shown(df):
    """(i0, i1, values): rounded, without zeros."""
    out = df.select(*batch(df), F.col("k").alias("i1"), *[(F.round(p, 6) + F.lit(0.0)).alias(p) for p in parts(df)])
    return out.where(" or ".join(f"{p} <> 0" for p in parts(df)))


def _ask(name, f, sql):
    def query(spark, sf_dir):
        return shown(f(vectors(spark, sf_dir)))

    query.__name__ = name
    QUERIES[name] = query
    SQL[name] = sql


def _last(names):
    values = ", ".join(f"round({p}, 6) + 0e0 {p}" for p in names)
    return f"select i0, i1::bigint i1, {values} from y where " + " or ".join(f"round({p}, 6) <> 0" for p in names)


def matrix(name, make, sql, m=64, n=64, is_complex=False, real_back=False):
    """Queries of an operator of shape (m, n) whose entries are the rows of sql: (r, c, a), with ai if it is complex.

    real_back: the adjoint gives real parts, as that of a real Fourier transform.
    """
    mat = f"{EMB}, mat as ({sql}), "
    out = ["re", "im"] if is_complex else ["v"]
    sums = lambda a, frm, at, to: f"select i0, {to} i1, {a} from {frm} join mat on i1 = {at} group by i0, {to}"
    go = "sum(a * v) re, sum(ai * v) im" if is_complex else "sum(a * v) v"
    back = ("sum(a * v) re, -sum(ai * v) im" if not real_back else "sum(a * v) v") if is_complex else "sum(a * v) v"
    again_back = ("sum(a * re + ai * im) re, sum(a * im - ai * re) im" if not real_back else "sum(a * re + ai * im) v") if is_complex else "sum(a * v) v"
    again_go = ("sum(a * re - ai * im) re, sum(a * im + ai * re) im" if not real_back else go) if is_complex else "sum(a * v) v"
    back_out = ["v"] if real_back else out
    if n == 64:
        _ask(name, lambda df: make().forward(df), f"{mat}y as ({sums(go, 'emb', 'c', 'r')}) {_last(out)}")
        if m != 64:
            _ask(f"{name}_normal", lambda df: (lambda op: op.adjoint(op.forward(df)))(make()), f"{mat}x as ({sums(go, 'emb', 'c', 'r')}), y as ({sums(again_back, 'x', 'r', 'c')}) {_last(back_out)}")
    if m == 64:
        _ask(f"{name}_adjoint", lambda df: make().adjoint(df), f"{mat}y as ({sums(back, 'emb', 'r', 'c')}) {_last(back_out)}")
        if n != 64:
            _ask(f"{name}_conormal", lambda df: (lambda op: op.forward(op.adjoint(df)))(make()), f"{mat}x as ({sums(back, 'emb', 'r', 'c')}), y as ({sums(again_go, 'x', 'c', 'r')}) {_last(out)}")


# Algebra
matrix("minus", lambda: 2.0 * basic.Flip(64) - basic.Roll(64), "select 63 - c r, c, 2e0 a from range(64) t(c) union all select (c + 1) % 64, c, -1e0 from range(64) t(c)")
matrix("negative", lambda: -basic.Roll(64), "select (c + 1) % 64 r, c, -1e0 a from range(64) t(c)")
matrix("power", lambda: basic.Roll(64) ** 3, "select (c + 3) % 64 r, c, 1e0 a from range(64) t(c)")
_R, _C = np.meshgrid(np.arange(64), np.arange(64), indexing="ij")
_CM = np.cos(_R * _C / 10) + 1j * np.sin(_R + 2 * _C)
_PARTS = "cos(r * c / 10e0) a, sin(r + 2 * c) ai"
matrix("matrix_complex", lambda: basic.MatrixMult(_CM), ALL.format(_PARTS), is_complex=True)
matrix("matrix_conj", lambda: basic.MatrixMult(_CM).conj(), ALL.format("cos(r * c / 10e0) a, -sin(r + 2 * c) ai"), is_complex=True)
matrix("matrix_transpose", lambda: basic.MatrixMult(_CM).T, ALL.format("cos(r * c / 10e0) a, sin(c + 2 * r) ai"), is_complex=True)
matrix("matrix_hermitian", lambda: basic.MatrixMult(_CM).H, ALL.format("cos(r * c / 10e0) a, -sin(c + 2 * r) ai"), is_complex=True)
matrix("matrix_toreal", lambda: basic.MatrixMult(_CM).toreal(), ALL.format("cos(r * c / 10e0) a"))
matrix("matrix_toimag", lambda: basic.MatrixMult(_CM).toimag(), ALL.format("sin(r + 2 * c) a"))
matrix("scaled_complex", lambda: (2.0 - 1.0j) * basic.Flip(64), "select 63 - c r, c, 2e0 a, -1e0 ai from range(64) t(c)", is_complex=True)
matrix("apply_columns", lambda: basic.MatrixMult(_CM.real).apply_columns(list(range(63, -1, -1))), ALL.format("cos(r * (63 - c) / 10e0) a"))
_ask("matmat", lambda df: basic.MatrixMult(_CM.real).matmat(df), f"{EMB}, mat as ({ALL.format(_PARTS)}), y as (select i0, r i1, sum(a * v) v from emb join mat on i1 = c group by i0, r) {_last(['v'])}")
_ask("rmatmat", lambda df: basic.MatrixMult(_CM.real).rmatmat(df), f"{EMB}, mat as ({ALL.format(_PARTS)}), y as (select i0, c i1, sum(a * v) v from emb join mat on i1 = r group by i0, c) {_last(['v'])}")
matrix("function_operator", lambda: core.FunctionOperator(lambda df: core.scaled(df, 3.0), lambda df: core.scaled(df, 3.0), 64), "select c r, c, 3e0 a from range(64) t(c)")


class _Foreign:
    """Something with a shape and products, but no operator."""

    shape = (64, 64)
    _op = basic.Flip(64)

    def matvec(self, df):
        return self._op.forward(df)

    def rmatvec(self, df):
        return self._op.adjoint(df)


matrix("aslinearoperator", lambda: core.aslinearoperator(_Foreign()), "select 63 - c r, c, 1e0 a from range(64) t(c)")
matrix("memoize", lambda: core.MemoizeOperator(basic.Roll(64, shift=5)), "select (c + 5) % 64 r, c, 1e0 a from range(64) t(c)")

# Basic operators
_TAPS = lambda taps: " union all ".join(f"select r, r + ({o}) c, {a} a from range(64) s(r) where r between {lo} and {hi}" for o, a, lo, hi in taps)
matrix("derivative_backward5", lambda: basic.FirstDerivative(64, order=5, edge=True, sampling=2.0), _TAPS([(-2, "1e0 / 24", 2, 61), (-1, "-1e0 / 3", 2, 61), (1, "1e0 / 3", 2, 61), (2, "-1e0 / 24", 2, 61), (0, "-0.5e0", 0, 0), (1, "0.5e0", 0, 0), (-1, "-0.5e0", 63, 63), (0, "0.5e0", 63, 63), (-1, "-0.25e0", 1, 1), (1, "0.25e0", 1, 1), (-1, "-0.25e0", 62, 62), (1, "0.25e0", 62, 62)]))
matrix("second_derivative_forward", lambda: basic.SecondDerivative(64, kind="forward"), _TAPS([(0, "1e0", 0, 61), (1, "-2e0", 0, 61), (2, "1e0", 0, 61)]))
matrix("second_derivative_backward", lambda: basic.SecondDerivative(64, kind="backward"), _TAPS([(-2, "1e0", 2, 63), (-1, "-2e0", 2, 63), (0, "1e0", 2, 63)]))
matrix("second_derivative_edge", lambda: basic.SecondDerivative(64, edge=True, sampling=0.5), _TAPS([(-1, "4e0", 1, 62), (0, "-8e0", 1, 62), (1, "4e0", 1, 62), (0, "4e0", 0, 0), (1, "-8e0", 0, 0), (2, "4e0", 0, 0), (-2, "4e0", 63, 63), (-1, "-8e0", 63, 63), (0, "4e0", 63, 63)]))
_D2 = "select p r, p + 8 * d c, 0.125e0 * d a from range(64) s(p), (values (-1), (1)) t(d) where p // 8 between 1 and 6 union all select p, p + d, 0.375e0 * d from range(64) s(p), (values (-1), (1)) t(d) where p % 8 between 1 and 6"
matrix("first_directional", lambda: basic.FirstDirectionalDerivative((8, 8), [0.25, 0.75]), _D2)
matrix("second_directional", lambda: basic.SecondDirectionalDerivative((8, 8), [0.25, 0.75]), f"with d as ({_D2}) select p.c r, q.c c, -sum(p.a * q.a) a from d p join d q on p.r = q.r group by 1, 2")
matrix("gradient_square", lambda: basic.Gradient((8, 8), sampling=2.0), "select p r, p + 8 * d c, 0.25e0 * d a from range(64) s(p), (values (-1), (1)) t(d) where p // 8 between 1 and 6 union all select 64 + p, p + d, 0.25e0 * d from range(64) s(p), (values (-1), (1)) t(d) where p % 8 between 1 and 6", m=128)
matrix("laplacian_square", lambda: basic.Laplacian((8, 8), weights=(1, 2)), "select p r, p + 8 * d c, w a from range(64) s(p), (values (-1, 1e0), (0, -2e0), (1, 1e0)) t(d, w) where p // 8 between 1 and 6 union all select p, p + d, 2 * w from range(64) s(p), (values (-1, 1e0), (0, -2e0), (1, 1e0)) t(d, w) where p % 8 between 1 and 6")
matrix("smoothing2d_square", lambda: basic.Smoothing2D((3, 5), (8, 8)), "select r, c, 1e0 / 15 a from range(64) s(r), range(64) t(c) where abs(r // 8 - c // 8) <= 1 and abs(r % 8 - c % 8) <= 2")
matrix("smoothing1d_axis0", lambda: basic.Smoothing1D(3, (16, 4), 0), "select r, c, 1e0 / 3 a from range(64) s(r), range(64) t(c) where abs(r // 4 - c // 4) <= 1 and r % 4 = c % 4")
matrix("linear_regression", lambda: basic.LinearRegression(np.arange(64) / 64), "select r, c, pow(r / 64e0, c) a from range(64) s(r), range(2) t(c)", n=2)
matrix("regression_cubic", lambda: basic.Regression(np.arange(64) / 64, 3), "select r, c, pow(r / 64e0, c) a from range(64) s(r), range(4) t(c)", n=4)
matrix("integration_axis0", lambda: basic.CausalIntegration((8, 8), 0, 0.5), "select r, c, 0.5e0 a from range(64) s(r), range(64) t(c) where r % 8 = c % 8 and c <= r")
matrix("integration_half", lambda: basic.CausalIntegration(64, kind="half"), ALL.format("case when c = r then 0.5e0 else 1e0 end a") + " where c <= r")
matrix("integration_trapezoidal", lambda: basic.CausalIntegration(64, kind="trapezoidal"), ALL.format("case when c = r then 0.5e0 else 1e0 end - case when c = 0 then 0.5e0 else 0e0 end a") + " where c <= r and r > 0")
matrix("integration_removefirst", lambda: basic.CausalIntegration(64, removefirst=True), "select r, c, 1e0 a from range(63) s(r), range(64) t(c) where c <= r + 1", m=63)
matrix("flip_axis0", lambda: basic.Flip((8, 8), 0), "select (7 - c // 8) * 8 + c % 8 r, c, 1e0 a from range(64) t(c)")
matrix("roll_axis0", lambda: basic.Roll((8, 8), 0, -2), "select ((c // 8 + 6) % 8) * 8 + c % 8 r, c, 1e0 a from range(64) t(c)")
matrix("transpose3", lambda: basic.Transpose((4, 2, 8), (2, 0, 1)), "select (c % 8 * 4 + c // 16) * 2 + c // 8 % 2 r, c, 1e0 a from range(64) t(c)")
matrix("pad_square", lambda: basic.Pad((8, 8), ((1, 2), (0, 3))), "select (c // 8 + 1) * 11 + c % 8 r, c, 1e0 a from range(64) t(c)", m=121)
matrix("sum_axis0", lambda: basic.Sum((8, 8), 0), "select c % 8 r, c, 1e0 a from range(64) t(c)", m=8)
matrix("sum_all", lambda: basic.Sum(64), "select 0::bigint r, c, 1e0 a from range(64) t(c)", m=1)
matrix("symmetrize_axis0", lambda: basic.Symmetrize((8, 8), 0), "select distinct (7 + d * (c // 8)) * 8 + c % 8 r, c, 1e0 a from range(64) t(c), (values (-1), (1)) u(d)", m=120)
matrix("restriction_axis0", lambda: basic.Restriction((8, 8), [6, 1, 3], 0), "select j * 8 + x r, p * 8 + x c, 1e0 a from (values (0, 6), (1, 1), (2, 3)) t(j, p), range(8) u(x)", m=24)
matrix("identity_wide", lambda: basic.Identity(80, 64), "select c r, c, 1e0 a from range(64) t(c)", m=80)
matrix("diagonal_axis0", lambda: basic.Diagonal(np.arange(1.0, 9.0), (8, 8), 0), "select c r, c, (c // 8 + 1)::double a from range(64) t(c)")
matrix("diagonal_complex", lambda: basic.Diagonal(np.arange(64) + 1j), "select c r, c, c::double a, 1e0 ai from range(64) t(c)", is_complex=True)
matrix("spread_split", lambda: basic.Spread((8, 8), (8, 8), table=np.fromfunction(lambda a, b, x: (a + b) % 7, (8, 8, 8)), dtable=np.fromfunction(lambda a, b, x: x / 8, (8, 8, 8))), "select x * 8 + (c // 8 + c % 8) % 7 + e r, c, case when e = 0 then 1 - x / 8e0 else x / 8e0 end a from range(64) t(c), range(8) u(x), range(2) w(e)")
matrix("block", lambda: basic.Block([[basic.Flip(32), 2.0 * basic.Identity(32)], [basic.Zero(32), basic.Roll(32)]]), "select 31 - c r, c, 1e0 a from range(32) t(c) union all select c, c + 32, 2e0 from range(32) t(c) union all select 32 + (c + 1) % 32, 32 + c, 1e0 from range(32) t(c)")
matrix("vstack_two", lambda: basic.VStack([basic.Flip(64), 3.0 * basic.Identity(64)]), "select 63 - c r, c, 1e0 a from range(64) t(c) union all select 64 + c, c, 3e0 from range(64) t(c)", m=128)
matrix("hstack_two", lambda: basic.HStack([basic.Flip(64), 3.0 * basic.Identity(64)]), "select 63 - c r, c, 1e0 a from range(64) t(c) union all select c r, 64 + c, 3e0 from range(64) t(c)", n=128)
matrix("blockdiag_mixed", lambda: basic.BlockDiag([basic.Flip(24), basic.Roll(40)]), "select 23 - c r, c, 1e0 a from range(24) t(c) union all select 24 + (c + 1) % 40, 24 + c, 1e0 from range(40) t(c)")
matrix("kronecker_square", lambda: basic.Kronecker(basic.MatrixMult(np.fromfunction(lambda i, j: i + j + 1.0, (8, 8))), basic.FirstDerivative(8, kind="forward")), "select i * 8 + x r, j * 8 + x + d c, (i + j + 1e0) * case when d = 0 then -1 else 1 end a from range(8) s(i), range(8) t(j), range(7) u(x), range(2) w(d)")


def _on_complex(name, make, adjoint, values):
    """Over x + i (j - 31.5) x."""

    def f(df):
        df = df.select("i0", "k", F.col("v").alias("re"), (F.col("v") * (F.col("k") - 31.5)).alias("im"))
        return make().adjoint(df) if adjoint else make().forward(df)

    names = [v.split()[-1] for v in values.split(",")]
    _ask(name, f, f"{EMB}, x as (select i0, i1, v re, v * (i1 - 31.5e0) im from emb), y as (select i0, i1, {values} from x) {_last(names)}")


_on_complex("real_part", lambda: basic.Real(64), False, "re v")
_on_complex("real_part_adjoint", lambda: basic.Real(64), True, "re v")
_on_complex("imag_part", lambda: basic.Imag(64), False, "im v")
_on_complex("imag_part_adjoint", lambda: basic.Imag(64), True, "0e0 * re re, re im")
_on_complex("conjugate", lambda: basic.Conj(64), False, "re re, -im im")
_on_complex("conjugate_adjoint", lambda: basic.Conj(64), True, "re re, -im im")

# Convolutions
matrix("convolve1d_long", lambda: signal.Convolve1D(64, 1.0 / np.arange(1, 81), 10), "select r, c, 1e0 / (r - c + 11) a from range(80) s(r), range(64) t(c) where r - c + 10 between 0 and 79", m=80)
matrix("convolve1d_axis0", lambda: signal.Convolve1D((16, 4), [1.0, -2.0, 0.5], 1, 0), "select r, c, case r // 4 - c // 4 when -1 then 1e0 when 0 then -2e0 else 0.5e0 end a from range(64) s(r), range(64) t(c) where r % 4 = c % 4 and abs(r // 4 - c // 4) <= 1")
matrix("convolve2d_square", lambda: signal.Convolve2D((8, 8), [[1.0, 2.0, 3.0], [4.0, 5.0, 6.0]], (1, 1)), "select r, c, (3 * (r // 8 - c // 8 + 1) + (r % 8 - c % 8 + 1) + 1)::double a from range(64) s(r), range(64) t(c) where r // 8 - c // 8 between -1 and 0 and abs(r % 8 - c % 8) <= 1")
_H3 = np.fromfunction(lambda a, b, c: 1 + a + 2 * b + 4 * c, (2, 2, 2))
matrix("convolve_nd", lambda: signal.ConvolveND((4, 4, 4), _H3, (1, 0, 1), (0, 1, 2)), "select r, c, (1 + a + 2 * b + 4 * d)::double a from (select r, c, r // 16 - c // 16 + 1 a, r // 4 % 4 - c // 4 % 4 b, r % 4 - c % 4 + 1 d from range(64) s(r), range(64) t(c)) where a between 0 and 1 and b between 0 and 1 and d between 0 and 1")


def _near(n, o, d, m):
    """(i, j, w): filter j's weight at sample i, with m centres from o on every d samples."""
    return f"select i, j, w from (select i, j, case when q <= 0 then case when j = 0 then 1e0 else 0e0 end when q >= {m - 1} then case when j = {m - 1} then 1e0 else 0e0 end else greatest(1e0 - abs(q - j), 0e0) end w from (select i, (i - {o}) / {d}e0 q from range({n}) a(i)), range({m}) b(j)) where w > 0"


_HS2 = np.fromfunction(lambda a, b, s, t: (a + 1) / (b + 2) + s / 2 + t, (2, 2, 3, 3))
matrix("nonstationary_convolve2d", lambda: signal.NonStationaryConvolve2D((8, 8), _HS2, (2, 5), (1, 6)), f"select (x.i + s - 1) * 8 + z.i + t - 1 r, x.i * 8 + z.i c, sum(x.w * z.w * ((x.j + 1e0) / (z.j + 2) + s / 2e0 + t)) a from ({_near(8, 2, 3, 2)}) x, ({_near(8, 1, 5, 2)}) z, range(3) u(s), range(3) w(t) where x.i + s - 1 between 0 and 7 and z.i + t - 1 between 0 and 7 group by 1, 2")
_HS3 = np.fromfunction(lambda a, b, c, s, t, u: 1 + a + 2 * b + 3 * c + s + t / 2, (2, 2, 2, 3, 3, 1))
matrix(
    "nonstationary_convolve3d",
    lambda: signal.NonStationaryConvolve3D((4, 4, 4), _HS3, (0, 2), (1, 3), (1, 2)),
    f"select ((x.i + s - 1) * 4 + y.i + t - 1) * 4 + z.i r, (x.i * 4 + y.i) * 4 + z.i c, sum(x.w * y.w * z.w * (1 + x.j + 2 * y.j + 3 * z.j + s + t / 2e0)) a from ({_near(4, 0, 2, 2)}) x, ({_near(4, 1, 2, 2)}) y, ({_near(4, 1, 1, 2)}) z, range(3) u(s), range(3) w(t) where x.i + s - 1 between 0 and 3 and y.i + t - 1 between 0 and 3 group by 1, 2",
)
matrix("nonstationary_filters1d", lambda: signal.NonStationaryFilters1D(np.arange(64) / 8 - 3, 3, (10, 30, 50)), f"select i + t - 1 r, j * 3 + t c, sum(w * (i / 8e0 - 3)) a from ({_near(64, 10, 20, 3)}) x, range(3) u(t) where i + t - 1 between 0 and 63 group by 1, 2", n=9)
matrix("nonstationary_filters2d", lambda: signal.NonStationaryFilters2D(np.arange(64).reshape(8, 8) / 8 - 3, (3, 1), (2, 5), (1, 6)), f"select (x.i + s - 1) * 8 + z.i r, (x.j * 2 + z.j) * 3 + s c, sum(x.w * z.w * ((x.i * 8 + z.i) / 8e0 - 3)) a from ({_near(8, 2, 3, 2)}) x, ({_near(8, 1, 5, 2)}) z, range(3) u(s) where x.i + s - 1 between 0 and 7 group by 1, 2", n=12)

# Fourier and other transforms
_TURN = "2 * pi() * r * c / 64e0"
matrix("fft_none", lambda: signal.FFT(64, norm="none"), ALL.format(f"cos({_TURN}) a, -sin({_TURN}) ai"), is_complex=True)
matrix("fft_scaled", lambda: signal.FFT(64, norm="1/n"), ALL.format(f"cos({_TURN}) / 64 a, -sin({_TURN}) / 64 ai"), is_complex=True)
matrix("fft_shifted", lambda: signal.FFT(64, fftshift_after=True, ifftshift_before=True), ALL.format("cos(2 * pi() * (r - 32) * (c - 32) / 64e0) / 8 a, -sin(2 * pi() * (r - 32) * (c - 32) / 64e0) / 8 ai"), is_complex=True)
matrix("fft_padded", lambda: signal.FFT(64, nfft=80), "select r, c, cos(2 * pi() * r * c / 80e0) / sqrt(80e0) a, -sin(2 * pi() * r * c / 80e0) / sqrt(80e0) ai from range(80) s(r), range(64) t(c)", m=80, is_complex=True)
matrix("rfft", lambda: signal.FFT(64, real=True), f"select r, c, w * cos({_TURN}) / 8 a, -w * sin({_TURN}) / 8 ai from (select r, c, case when r between 1 and 31 then sqrt(2e0) else 1e0 end w from range(33) s(r), range(64) t(c))", m=33, is_complex=True, real_back=True)
matrix("fft2d", lambda: signal.FFT2D((8, 8)), ALL.format("cos(2 * pi() * (r // 8 * (c // 8) + r % 8 * (c % 8)) / 8e0) / 8 a, -sin(2 * pi() * (r // 8 * (c // 8) + r % 8 * (c % 8)) / 8e0) / 8 ai"), is_complex=True)
matrix("fft2d_scaled", lambda: signal.FFT2D((4, 16), norm="1/n"), ALL.format("cos(2 * pi() * (r // 16 * (c // 16) / 4e0 + r % 16 * (c % 16) / 16e0)) / 64 a, -sin(2 * pi() * (r // 16 * (c // 16) / 4e0 + r % 16 * (c % 16) / 16e0)) / 64 ai"), is_complex=True)
matrix("rfft2d", lambda: signal.FFT2D((8, 8), real=True), "select r, c, w * cos(q) / 8 a, -w * sin(q) / 8 ai from (select r, c, case when r % 5 between 1 and 3 then sqrt(2e0) else 1e0 end w, 2 * pi() * (r // 5 * (c // 8) + r % 5 * (c % 8)) / 8e0 q from range(40) s(r), range(64) t(c))", m=40, is_complex=True, real_back=True)
matrix("fftnd", lambda: signal.FFTND((4, 4, 4), norm="none"), ALL.format("cos(pi() / 2 * (r // 16 * (c // 16) + r // 4 % 4 * (c // 4 % 4) + r % 4 * (c % 4))) a, -sin(pi() / 2 * (r // 16 * (c // 16) + r // 4 % 4 * (c // 4 % 4) + r % 4 * (c % 4))) ai"), is_complex=True)
_SHIFT = "select r, c, (1 + 2 * sum(cos(2 * pi() * f * (r - c - {s}) / {n}e0)) + cos(pi() * {s}) * cos(pi() * (r - c))) / {n} a from range({n}) s(r), range({n}) t(c), range(1, {h}) u(f) group by r, c"
matrix("shift", lambda: signal.Shift(64, 2.5, real=True), _SHIFT.format(s="2.5e0", n=64, h=32))
matrix("shift_lines", lambda: signal.Shift((4, 16), np.array([0.0, 1.5, -2.25, 3.0]), real=True), "select l * 16 + r r, l * 16 + c c, (1 + 2 * sum(cos(2 * pi() * f * (r - c - s) / 16)) + cos(pi() * s) * cos(pi() * (r - c))) / 16 a from (values (0, 0e0), (1, 1.5e0), (2, -2.25e0), (3, 3e0)) x(l, s), range(16) y(r), range(16) z(c), range(1, 8) u(f) group by l, r, c, s")
matrix("dct3", lambda: signal.DCT(64, 3), ALL.format("sqrt(2e0 / 64) * cos(pi() * (2 * r + 1) * c / 128e0) * case when c = 0 then sqrt(0.5e0) else 1e0 end a"))
matrix("dct1", lambda: signal.DCT(64, 1), ALL.format("sqrt(2e0 / 63) * cos(pi() * r * c / 63e0) * case when r in (0, 63) then sqrt(0.5e0) else 1e0 end * case when c in (0, 63) then sqrt(0.5e0) else 1e0 end a"))
matrix("dct4_square", lambda: signal.DCT((8, 8), 4), ALL.format("0.25e0 * cos(pi() * (2 * (r // 8) + 1) * (2 * (c // 8) + 1) / 32e0) * cos(pi() * (2 * (r % 8) + 1) * (2 * (c % 8) + 1) / 32e0) a"))
#: Scaling filter of four taps, and the wavelet's: its mirror with alternating signs.
_DB2 = "(values (0, (1 + sqrt(3e0)) / (4 * sqrt(2e0)), (1 - sqrt(3e0)) / (4 * sqrt(2e0))), (1, (3 + sqrt(3e0)) / (4 * sqrt(2e0)), -(3 - sqrt(3e0)) / (4 * sqrt(2e0))), (2, (3 - sqrt(3e0)) / (4 * sqrt(2e0)), (3 + sqrt(3e0)) / (4 * sqrt(2e0))), (3, (1 - sqrt(3e0)) / (4 * sqrt(2e0)), -(1 + sqrt(3e0)) / (4 * sqrt(2e0)))) h(t, low, high)"
matrix("dwt_db2", lambda: signal.DWT(64, wavelet="db2"), f"select r, (2 * r + t) % 64 c, low a from range(32) s(r), {_DB2} union all select 32 + r, (2 * r + t) % 64, high from range(32) s(r), {_DB2}")
_HAAR = "select i + {h} * d r, 2 * i + e c, case when d = 1 and e = 1 then -1e0 else 1e0 end / sqrt(2e0) a from range({h}) s(i), range(2) t(d), range(2) u(e)"
matrix("dwt2d", lambda: signal.DWT2D((8, 8)), f"select x.r * 8 + y.r r, x.c * 8 + y.c c, x.a * y.a a from ({_HAAR.format(h=4)}) x, ({_HAAR.format(h=4)}) y")
matrix("dwtnd", lambda: signal.DWTND((4, 4, 4)), f"select (x.r * 4 + y.r) * 4 + z.r r, (x.c * 4 + y.c) * 4 + z.c c, x.a * y.a * z.a a from ({_HAAR.format(h=2)}) x, ({_HAAR.format(h=2)}) y, ({_HAAR.format(h=2)}) z")
matrix("interp_sinc", lambda: signal.Interp(64, [0.5, 10.25, 40.75], kind="sinc")[0], "select j r, c, sin(pi() * (p - c)) / (pi() * (p - c)) a from (values (0, 0.5e0), (1, 10.25e0), (2, 40.75e0)) t(j, p), range(64) u(c)", m=3)
matrix("interp_axis0", lambda: signal.Interp((8, 8), [0.5, 6.25], 0)[0], "select j * 8 + x r, i * 8 + x c, 1 - abs(p - i) a from (values (0, 0.5e0), (1, 6.25e0)) t(j, p), range(8) u(i), range(8) w(x) where abs(p - i) < 1", m=16)
matrix("bilinear_square", lambda: signal.Bilinear(np.array([[0.5, 3.25], [1.25, 6.5]]), (8, 8)), "select j r, c, (1 - abs(c // 8 - a)) * (1 - abs(c % 8 - b)) a from (values (0, 0.5e0, 1.25e0), (1, 3.25e0, 6.5e0)) t(j, a, b), range(64) u(c) where abs(c // 8 - a) < 1 and abs(c % 8 - b) < 1", m=2)
matrix("fredholm1_square", lambda: signal.Fredholm1(np.fromfunction(lambda s, i, j: s + i + 2 * j + 1.0, (4, 4, 4)), 4), "select (s * 4 + i) * 4 + z r, (s * 4 + j) * 4 + z c, s + i + 2 * j + 1e0 a from range(4) x(s), range(4) y(i), range(4) w(j), range(4) v(z)")
_SPLIT = "select h * {nt} + (floor(tau) + e)::bigint r, c, case when e = 0 then 1 - (tau - floor(tau)) else tau - floor(tau) end a from (select h, c, {tau} tau from range({nh}) x(h), range(64) t(c)), range(2) u(e) where tau >= 0 and tau < {nt} - 1"
_P8 = (np.arange(8) - 4) * 0.125
matrix("radon2d_linear", lambda: signal.Radon2D(np.arange(8.0), np.arange(8.0), _P8), _SPLIT.format(nt=8, nh=8, tau="c % 8 + (c // 8 - 4) * 0.125e0 * (h - 3.5e0)"))
matrix("radon2d_parabolic", lambda: signal.Radon2D(np.arange(8.0), np.arange(8.0), _P8 / 4, "parabolic"), _SPLIT.format(nt=8, nh=8, tau="c % 8 + (c // 8 - 4) * 0.03125e0 * (h - 3.5e0) * (h - 3.5e0)"))
matrix("radon2d_hyperbolic", lambda: signal.Radon2D(np.arange(8.0), np.arange(8.0), 1.0 + np.arange(8) / 8, "hyperbolic"), _SPLIT.format(nt=8, nh=8, tau="sqrt(c % 8 * (c % 8) + pow((h - 3.5e0) / (1 + (c // 8) / 8e0), 2))"))
matrix("radon2d_nearest", lambda: signal.Radon2D(np.arange(8.0), np.arange(8.0), _P8, interp=False), "select h * 8 + floor(tau)::bigint r, c, 1e0 a from (select h, c, c % 8 + (c // 8 - 4) * 0.125e0 * (h - 3.5e0) tau from range(8) x(h), range(64) t(c)) where tau >= 0 and tau < 8")
matrix("radon3d", lambda: signal.Radon3D(np.arange(16.0), np.arange(2.0), np.arange(2.0), [-0.75, 0.5], [0.25, 1.25]), _SPLIT.format(nt=16, nh=4, tau="c % 16 + case when c // 32 = 0 then -0.75e0 else 0.5e0 end * (h // 2 - 0.5e0) + case when c // 16 % 2 = 0 then 0.25e0 else 1.25e0 end * (h % 2 - 0.5e0)"))
_FREQ = "case when f < 4 then f else f - 8 end / 8e0"
matrix("chirp_radon2d", lambda: signal.ChirpRadon2D(np.arange(8.0), np.arange(8.0), 0.5), f"select r, c, sum(cos(2 * pi() * f * (r % 8 - c % 8) / 8 + 2 * pi() * 0.125e0 * {_FREQ} * (r // 8 - 4) * (c // 8 - 4))) / 8 a from range(64) s(r), range(64) t(c), range(8) u(f) group by r, c")
matrix("chirp_radon3d", lambda: signal.ChirpRadon3D(np.arange(8.0), np.arange(2.0), np.arange(4.0), (0.5, 0.25)), f"select r, c, sum(cos(2 * pi() * f * (r % 8 - c % 8) / 8 + 2 * pi() * {_FREQ} * (0.5e0 * (r // 32 - 1) * (c // 32 - 1) + 0.125e0 * (r // 8 % 4 - 2) * (c // 8 % 4 - 2)))) / 8 a from range(64) s(r), range(64) t(c), range(8) u(f) group by r, c")
_REAL8 = "case when f in (0, 4) then 1 else 2 end"
matrix("fourier_radon2d", lambda: signal.FourierRadon2D(np.arange(8.0), np.arange(8.0), np.arange(8) / 8, 8), f"select r, c, sum({_REAL8} * cos(2 * pi() * f * (r % 8 - c % 8) / 8 - 2 * pi() * f / 8e0 * (r // 8) * (c // 8) / 8e0)) / 8 a from range(64) s(r), range(64) t(c), range(5) u(f) group by r, c")
matrix("fourier_radon2d_parabolic", lambda: signal.FourierRadon2D(np.arange(8.0), np.arange(8.0), np.arange(8) / 8, 8, kind="parabolic"), f"select r, c, sum({_REAL8} * cos(2 * pi() * f * (r % 8 - c % 8) / 8 - 2 * pi() * f / 8e0 * (r // 8) * (r // 8) * (c // 8) / 8e0)) / 8 a from range(64) s(r), range(64) t(c), range(5) u(f) group by r, c")
matrix("fourier_radon3d", lambda: signal.FourierRadon3D(np.arange(8.0), np.arange(2.0), np.arange(4.0), np.arange(2) / 4, np.arange(4) / 8, 8, kind=("linear", "parabolic")), f"select r, c, sum({_REAL8} * cos(2 * pi() * f * (r % 8 - c % 8) / 8 - 2 * pi() * f / 8e0 * (r // 32 * (c // 32) / 4e0 + (r // 8 % 4) * (r // 8 % 4) * (c // 8 % 4) / 8e0))) / 8 a from range(64) s(r), range(64) t(c), range(5) u(f) group by r, c")
_SINC = "case when {x} = 0 then 1e0 else sin(pi() * ({x})) / (pi() * ({x})) end"
_MOVE = _SINC.format(x="t - 0.25e0 - s")  # a trace moved by a quarter sample, at sample t from sample s
_BACK = _SINC.format(x="t + 0.25e0 - s")
matrix(
    "seislet",
    lambda: signal.Seislet(np.full((8, 8), 0.25), level=1),
    f"""with m as (select s, t, {_MOVE} a, {_BACK} b from range(8) x(s), range(8) y(t)), res as (select i * 8 + t r, (2 * i + 1) * 8 + t c, 1e0 a from range(4) w(i), range(8) y(t) union all select i * 8 + t, 2 * i * 8 + s, -a from range(4) w(i), m)
    select r, c, a from res union all select 32 + i * 8 + t, 2 * i * 8 + t, 1e0 from range(4) w(i), range(8) y(t) union all select 32 + i * 8 + m.t, res.c, 0.5e0 * sum(m.b * res.a) from range(4) w(i), m, res where res.r = i * 8 + m.s group by i, m.t, res.c""",
)
matrix("sliding1d_flat", lambda: signal.Sliding1D(basic.Identity(4), None, 64, 4, 0, None), "select c r, c, 1e0 a from range(64) t(c)")
#: Ramps of a Hanning taper of two samples: 0 and 1.
matrix("sliding2d", lambda: signal.Sliding2D(basic.Identity((4, 8)), None, (8, 8), 4, 2, None), "select (2 * (c // 32) + c // 8 % 4) * 8 + c % 8 r, c, 1e0 a from range(96) t(c)", n=96)
matrix("sliding3d", lambda: signal.Sliding3D(basic.Identity((2, 2, 4)), None, (4, 4, 4), (2, 2), (1, 1), tapertype=None), "select ((c // 48 + c // 8 % 2) * 4 + c // 16 % 3 + c // 4 % 2) * 4 + c % 4 r, c, 1e0 a from range(144) t(c)", n=144)
matrix("patch2d_flat", lambda: signal.Patch2D(basic.Identity((4, 4)), None, (8, 8), (4, 4), (2, 2), tapertype=None), "select (2 * (c // 48) + c // 4 % 4) * 8 + 2 * (c // 16 % 3) + c % 4 r, c, 1e0 a from range(144) t(c)", n=144)
matrix("patch3d", lambda: signal.Patch3D(basic.Identity((2, 2, 2)), None, (4, 4, 4), (2, 2, 2), (1, 1, 1), tapertype=None), "select ((c // 72 + c // 4 % 2) * 4 + c // 24 % 3 + c // 2 % 2) * 4 + c // 8 % 3 + c % 2 r, c, 1e0 a from range(216) t(c)", n=216)
_HANN4 = "case when i < 4 and w > 0 then 0.5e0 - 0.5e0 * cos(pi() * i / 3e0) when i >= 12 and w < 4 then 0.5e0 - 0.5e0 * cos(pi() * (15 - i) / 3e0) else 1e0 end"
matrix("sliding1d_tapered", lambda: signal.Sliding1D(basic.Identity(16), None, 64, 16, 4), f"select 12 * w + i r, w * 16 + i c, {_HANN4} a from range(5) s(w), range(16) t(i)", n=80)

# Wave equation
matrix("blending_continuous", lambda: wave.BlendingContinuous(16, 2, 2, 0.004, [0.0, 0.02]), "select c // 16 % 2 * 22 + c % 16 + 5 * (c // 32) r, c, 1e0 a from range(64) t(c)", m=44)
matrix("blending_group", lambda: wave.BlendingGroup(8, 2, 4, 0.004, [[0.0, 0.004], [0.008, 0.012]], 2, 2), "select (c // 32 * 2 + c // 8 % 2) * 8 + (c % 8 + 2 * (c // 16 % 2) + c // 32) % 8 r, c, 1e0 a from range(64) t(c)", m=32)
matrix("blending_half", lambda: wave.BlendingHalf(8, 2, 4, 0.004, [[0.0, 0.004], [0.008, 0.012]], 2, 2), "select (c // 16 % 2 * 2 + c // 8 % 2) * 8 + (c % 8 + 2 * (c // 32) + c // 16 % 2) % 8 r, c, 1e0 a from range(64) t(c)", m=32)
_KIRCHHOFF = (np.arange(8) * 10.0, np.arange(8) * 10.0, np.arange(32) * 0.01, [[25.0], [0.0]], [[5.0, 55.0], [0.0, 3.0]], 1000.0, [0.25, 1.0, 0.5], 1)
_TIMES = "with p as (select c, q, (sqrt(pow(c // 8 * 10 - 25e0, 2) + pow(c % 8 * 10e0, 2)) + sqrt(pow(c // 8 * 10 - x, 2) + pow(c % 8 * 10 - z, 2))) / 10e0 tau from range(64) t(c), (values (0, 5e0, 0e0), (1, 55e0, 3e0)) u(q, x, z)), s as (select c, q, floor(tau)::bigint + e i, case when e = 0 then 1 - (tau - floor(tau)) else tau - floor(tau) end a from p, range(2) w(e) where floor(tau) between 0 and 30)"
_KSQL = f"{_TIMES} select q * 32 + i + k - 1 r, c, sum(a * h) a from s, (values (0, 0.25e0), (1, 1e0), (2, 0.5e0)) v(k, h) where i + k - 1 between 0 and 31 group by 1, 2"
matrix("kirchhoff", lambda: wave.Kirchhoff(*_KIRCHHOFF, mode="analytic"), _KSQL)
matrix("kirchhoff_aperture", lambda: wave.Kirchhoff(*_KIRCHHOFF, mode="analytic", aperture=0.8), _KSQL.replace("from s,", "from (select * from s where abs(c // 8 * 10 - case when q = 0 then 15e0 else 40e0 end) <= 0.8e0 * (c % 8 * 10)) s,"))
matrix("lsm", lambda: wave.LSM(*_KIRCHHOFF, mode="analytic").Demop, _KSQL)
_F5 = "case when f in (0, 4) then 1 else 2 end"
_MDC = np.fromfunction(lambda f, s, r: np.cos(f + s * r) + 1j * np.sin(f * s - r), (5, 8, 8))
_MDC_SQL = f"select r, c, 2e0 * 0.5e0 * sqrt(8e0) / 8 * sum({_F5} * (cos(f + (r % 8) * (c % 8)) * cos(q) - {{sign}} sin(f * (r % 8) - c % 8) * sin(q))) a from (select r, c, f, 2 * pi() * f * (r // 8 - c // 8) / 8e0 q from range(64) s(r), range(64) t(c), range(5) u(f)) group by r, c"
matrix("mdc", lambda: wave.MDC(_MDC, 8, 1, 0.5, 2.0, twosided=False), _MDC_SQL.format(sign=""))
matrix("mdc_conj", lambda: wave.MDC(_MDC, 8, 1, 0.5, 2.0, twosided=False, conj=True), _MDC_SQL.format(sign="-1e0 *"))
_KX = "case when k < 4 then k else k - 8 end / 80e0"
_PHASE = f"select f, k, case when q >= 0 then cos(-2 * pi() * 10 * sqrt(greatest(q, 0e0))) else exp(-2 * pi() * 10 * sqrt(abs(q))) end a, case when q >= 0 and f > 0 then sin(-2 * pi() * 10 * sqrt(greatest(q, 0e0))) else 0e0 end b from (select f, k, pow(f / (8 * 0.004e0) / 1500, 2) - pow({_KX}, 2) q from range(5) x(f), range(8) y(k))"
matrix("phase_shift", lambda: wave.PhaseShift(1500.0, 10.0, 8, np.fft.rfftfreq(8, 0.004), np.fft.fftfreq(8, 10.0)), f"with d as ({_PHASE}) select r, c, sum({_F5} * (a * cos(q) - b * sin(q))) / 64 a from (select r, c, f, a, b, 2 * pi() * (f * (r // 8 - c // 8) + k * (r % 8 - c % 8)) / 8e0 q from range(64) s(r), range(64) t(c), d) group by r, c")
_W8 = "case when f < 4 then f else f - 8 end / 0.032e0"
_OBL = f"select f, k, case when abs({_KX}) < abs({_W8}) / 1500 and pow({_W8} / 1500, 2) > pow({_KX}, 2) then {{}} else 0e0 end a from range(8) x(f), range(8) y(k)"
_KZ = f"sqrt(greatest(pow({_W8} / 1500, 2) - pow({_KX}, 2), 0e0))"
_TO_P, _TO_V = _OBL.format(f"1000 * abs({_W8}) / {_KZ}"), _OBL.format(f"{_KZ} / (1000 * abs({_W8}))")
_PLANE = "select r, c, sum(a * cos(q)) / 64 a, sum(a * sin(q)) / 64 ai from (select r, c, a, 2 * pi() * (k * (r // 8 - c // 8) + f * (r % 8 - c % 8)) / 8e0 q from range(64) s(r), range(64) t(c), d) group by r, c"
matrix("pressure_to_velocity", lambda: 1e6 * wave.PressureToVelocity(8, 8, 0.004, 10.0, 1000.0, 1500.0, ntaper=0), f"with d as ({_TO_V}) select r, c, 1e6 * a a, 1e6 * ai ai from ({_PLANE})", is_complex=True)
matrix("velocity_to_pressure", lambda: 1e-6 * wave.PressureToVelocity(8, 8, 0.004, 10.0, 1000.0, 1500.0, ntaper=0, topressure=True), f"with d as ({_TO_P}) select r, c, 1e-6 * a a, 1e-6 * ai ai from ({_PLANE})", is_complex=True)
_KX4 = "case when k < 2 then k else k - 4 end / 40e0"
_UP = _TO_V.replace(_KX, _KX4).replace("range(8) y(k)", "range(4) y(k)")
_UPDOWN = "with d as ({d}), b as (select r, c, sum(a * cos(q)) / 32 a from (select r, c, a, 2 * pi() * ({k} + f * (r % 8 - c % 8) / 8e0) q from range(32) s(r), range(32) t(c), d) group by r, c) select c r, c, 1e0 a, 0e0 ai from range(32) t(c) union all select c, 32 + c, 1e0, 0e0 from range(32) t(c) union all select 32 + r, c, 1e6 * a, 0e0 from b union all select 32 + r, 32 + c, -1e6 * a, 0e0 from b"
matrix("updown2d", lambda: wave.UpDownComposition2D(8, 4, 0.004, 10.0, 1000.0, 1500.0, ntaper=0, scaling=1e6), _UPDOWN.format(d=_UP, k="k * (r // 8 - c // 8) / 4e0"), is_complex=True)
_K3 = "sqrt(pow(case when k < 1 then k else k - 2 end / 20e0, 2) + pow(case when l < 1 then l else l - 2 end / 20e0, 2))"
_UP3 = _TO_V.replace(_KX, _K3).replace("select f, k,", "select f, k, l,").replace("range(8) y(k)", "range(2) y(k), range(2) z(l)")
matrix("updown3d", lambda: wave.UpDownComposition3D(8, (2, 2), 0.004, (10.0, 10.0), 1000.0, 1500.0, ntaper=0, scaling=1e6), _UPDOWN.format(d=_UP3, k="(k * (r // 16 - c // 16) + l * (r // 8 % 2 - c // 8 % 2)) / 2e0"), is_complex=True)

#: Two time steps of a shot at (2, 1), at the source itself and beside it.
_ACOUSTIC = (np.full((8, 8), 1000.0), 5.0, [[2, 1]], [[2, 1], [3, 1]], 2, 0.002, 100.0)
_WAVE2 = "(select (1 - 2 * q0) * exp(-q0) w0, (1 - 2 * q1) * exp(-q1) w1, 0.16e0 c2 from (select pow(pi(), 2) q0, pow(pi() * 0.8e0, 2) q1))"
matrix("acoustic", lambda: 1000.0 * wave.AcousticWave2D(*_ACOUSTIC), f"select 0::bigint r, 17::bigint c, 1000 * w0 a from {_WAVE2} union all select 1, 17, 1000 * (2 * w0 - 8 * c2 * w0 + w1) from {_WAVE2} union all select 3, c, 1000 * c2 * w0 from {_WAVE2}, (values (17), (25)) t(c)", m=4)

# Reflectivity
_TH = "(values (0, radians(10e0)), (1, radians(30e0))) x(i, th)"
matrix("avo_fatti", lambda: avo.AVOLinearModelling([10.0, 30.0], 0.5, 32, None, "fatti"), f"select t * 2 + i r, t * 3 + p c, case p when 0 then 0.5e0 * (1 + pow(tan(th), 2)) when 1 then -pow(sin(th), 2) else 0.5e0 * (pow(sin(th), 2) - pow(tan(th), 2)) end a from range(32) s(t), range(3) u(p), {_TH}", n=96)
_CP = "sqrt(1 - 0.25e0 * pow(sin(th), 2))"
matrix("avo_ps", lambda: avo.AVOLinearModelling([10.0, 30.0], 0.5, 32, None, "PS"), f"select t * 2 + i r, t * 2 + p c, -sin(th) / {_CP} * case p when 0 then pow(sin(th), 2) - 2 * cos(th) * {_CP} else 1 + 0.5e0 * pow(sin(th), 2) - cos(th) * {_CP} end a from range(32) s(t), range(2) u(p), {_TH}")
_WAV = "(values (0, 0.25e0), (1, 1e0), (2, 0.5e0)) w(k, h)"
matrix("poststack", lambda: avo.PoststackLinearModelling([0.25, 1.0, 0.5], 64), f"select j + k - 1 r, j + d c, sum(0.25e0 * d * h) a from range(1, 63) s(j), (values (-1), (1)) t(d), {_WAV} where j + k - 1 between 0 and 63 group by 1, 2")
matrix("prestack", lambda: avo.PrestackLinearModelling([0.25, 1.0, 0.5], [10.0, 30.0], 0.5, 32), f"select (j + k - 1) * 2 + i r, (j + d) * 3 + p c, sum(0.5e0 * d * h * case p when 0 then 1 / (2 * pow(cos(th), 2)) when 1 then -pow(sin(th), 2) else 0.5e0 - 0.5e0 * pow(sin(th), 2) end) a from range(1, 31) s(j), (values (-1), (1)) t(d), {_WAV}, range(3) u(p), {_TH} where j + k - 1 between 0 and 31 group by 1, 2", n=96)
matrix("prestack_wavelet", lambda: avo.PrestackWaveletModelling(np.stack([np.arange(32) ** 2 / 100, np.arange(32) / 10, np.cos(np.arange(32))], axis=1), [10.0, 30.0], 5), f"select t * 2 + i r, k c, (1 / (2 * pow(cos(th), 2))) * j / 50e0 - pow(sin(th), 2) * 0.1e0 + (0.5e0 - 0.5e0 * pow(sin(th), 2)) * (cos(j + 1) - cos(j - 1)) / 2 a from (select t, k, t - k + 2 j from range(32) s(t), range(5) u(k)), {_TH} where j between 1 and 30", n=5)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


__all__ = ["oracle_sql", "queries"]
