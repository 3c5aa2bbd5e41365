"""Queries of solvers, generators, tapers, wavelets, coefficients, estimators and numerical methods, with what they give in SQL."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from lattica import operator_queries
from lattica.functions import estimates, estimators, tapers, thresholds
from lattica.functions.wavelets import gaussian, klauder, ormsby
from lattica.operators import avo, basic, core, signal, wave
from lattica.operators.core import LinOp, parts
from lattica.operators.wave import directwave
from lattica.plans import solvers, storage
from lattica.plans.solvers import Frame
from lattica.sources import generators
from lattica.streaming import fir

QUERIES: dict = {}
SQL: dict[str, str] = {}
EMB = "with emb as (select vec_id::bigint * 64 + generate_subscripts(embedding, 1) - 1 k, unnest(embedding)::double v from embeddings)"


def _add(name, f, sql):
    f.__name__ = name
    QUERIES[name] = f
    SQL[name] = sql


# Solvers: the whole embeddings as one distributed vector, and diagonal operators of two values, which two steps solve.
def _vector(spark, sf_dir) -> Frame:
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    n = (int(df.agg(F.max("vec_id")).first()[0]) + 1) * 64
    return Frame(df.select("vec_id", F.posexplode("embedding").alias("j", "x")).select((F.col("vec_id").cast("long") * 64 + F.col("j")).alias("k"), F.col("x").cast("double").alias("v")), n)


def _two(n: int, a: float, b: float) -> LinOp:
    return basic.Diagonal(lambda k: F.when(k % 2 == 0, F.lit(a)).otherwise(F.lit(b)), (n,))


def _solve(name, f, sql, digits=4):
    def query(spark, sf_dir):
        y = _vector(spark, sf_dir)
        out = f(y, _two(y.size, 1.0, 3.0))
        return out.df.select("k", *[(F.round(p, digits) + F.lit(0.0)).alias(p) for p in parts(out.df)]).where("v <> 0")

    _add(name, query, f"{EMB}, d as (select k, v, case when k % 2 = 0 then 1e0 else 3e0 end d from emb), x as ({sql}) select k, round(v, {digits}) + 0e0 v from x where round(v, {digits}) <> 0")


_solve("solve_cg", lambda y, op: solvers.cg(op, y, niter=2, tol=1e-30)[0], "select k, v / d v from d")
_solve("solve_cgls", lambda y, op: solvers.cgls(op, y, niter=2, tol=1e-30)[0], "select k, v / d v from d")
_solve("solve_cgls_damped", lambda y, op: solvers.cgls(op, y, niter=2, damp=0.5, tol=1e-30)[0], "select k, v * d / (d * d + 0.25e0) v from d")
_solve("solve_lsqr", lambda y, op: solvers.lsqr(op, y, niter=2)[0], "select k, v / d v from d")
_solve("solve_lsqr_damped", lambda y, op: solvers.lsqr(op, y, niter=2, damp=0.5)[0], "select k, v * d / (d * d + 0.25e0) v from d")
_solve("solve_lsqr_class", lambda y, op: solvers.LSQR(op).solve(y, niter=2), "select k, v / d v from d")
_solve("normal_equations_inversion", lambda y, op: solvers.normal_equations_inversion(op, y, [_two(y.size, 2.0, 1.0)], epsI=0.5, epsRs=[3.0], niter=2, tol=1e-30)[0], "select k, v * d / (d * d + 0.25e0 + 9 * case when k % 2 = 0 then 4e0 else 1e0 end) v from d")
_solve("regularized_inversion", lambda y, op: solvers.regularized_inversion(op, y, [_two(y.size, 2.0, 1.0)], epsRs=[0.5], niter=2)[0], "select k, v * d / (d * d + 0.25e0 * case when k % 2 = 0 then 4e0 else 1e0 end) v from d")
_solve("regularized_inversion_data", lambda y, op: solvers.RegularizedInversion(op).solve(y, niter=2, Regs=[basic.Identity(y.size)], dataregs=[y], epsRs=[2.0]), "select k, (v * d + 4 * v) / (d * d + 4) v from d")
_solve("preconditioned_inversion", lambda y, op: solvers.preconditioned_inversion(op, y, _two(y.size, 2.0, 5.0), niter=2)[0], "select k, v / d v from d")
_solve("solve_ista", lambda y, op: solvers.ista(basic.Identity(y.size), y, niter=2, eps=0.4, alpha=1.0)[0], "select k, greatest(abs(v) - 0.2e0, 0e0) * sign(v) v from emb")
_solve("solve_fista", lambda y, op: solvers.fista(basic.Identity(y.size), y, niter=2, eps=0.4, alpha=1.0)[0], "select k, greatest(abs(v) - 0.2e0, 0e0) * sign(v) v from emb")
_solve("solve_ista_hard", lambda y, op: solvers.ista(basic.Identity(y.size), y, niter=1, eps=0.02, alpha=1.0, threshkind="hard")[0], "select k, case when abs(v) <= sqrt(0.02e0) then 0e0 else v end v from emb")
_solve("solve_ista_percentile", lambda y, op: solvers.ista(basic.Identity(y.size), y, niter=1, alpha=1.0, threshkind="soft-percentile", perc=30)[0], "select k, greatest(abs(v) - l, 0e0) * sign(v) v from emb, (select quantile_cont(abs(v), 0.7) l from emb)")
_solve("solve_irls", lambda y, op: solvers.irls(op, y, nouter=1, niter=2)[0], "select k, v / d v from d")
_solve("solve_irls_model", lambda y, op: solvers.irls(op, y, nouter=1, niter=2, kind="model")[0], "select k, v / d v from d")
_solve("solve_omp", lambda y, op: solvers.omp(basic.Identity(y.size), y, niter_outer=3, niter_inner=0)[0], "select k, v from emb order by abs(v) desc, k limit 3")
_solve("solve_omp_orthogonal", lambda y, op: solvers.omp(op, y, niter_outer=2, niter_inner=2)[0], "select k, v / d v from d order by abs(v * d) desc, k limit 2")
_solve("l1_projection", lambda y, op: solvers.l1_project(y, 50.0), "select k, greatest(abs(v) - l, 0e0) * sign(v) v from emb, (select max((s - 50) / n) l from (select sum(abs(v)) over w s, row_number() over w n from emb window w as (order by abs(v) desc, k rows unbounded preceding)))")
_solve("splitbregman_step", lambda y, op: solvers.splitbregman(op, y, [basic.Identity(y.size)], niter_outer=1, niter_inner=1, epsRL1s=[0.5], niter=2)[0], "select k, v * d / (d * d + 0.5e0) v from d")


def _power(spark, sf_dir):
    value, b, _ = solvers.power_iteration(basic.Diagonal(np.concatenate([np.arange(1.0, 9.0), [100.0]])), niter=30, tol=1e-12)
    return spark.createDataFrame([(float(round(value, 4)), float(round(abs(b[-1]), 4)))], "value double, top double")


_add("power_iteration", _power, "select 100e0 as value, 1e0 top")
_RANK2 = np.outer(np.arange(1.0, 9.0), np.ones(8)) + np.outer(np.ones(8), np.arange(8.0))


def _traces(spark, sf_dir):
    diagonal, low = basic.Diagonal(np.arange(1.0, 9.0)), basic.MatrixMult(_RANK2)
    found = {
        "hutchinson": estimators.trace_hutchinson(diagonal, 4), "hutchinson, unit vectors": estimators.trace_hutchinson(low, 8, "unitvector"), "hutch++": estimators.trace_hutchpp(low, 12), "na-hutch++": estimators.trace_nahutchpp(low, 24), "explicit": low.trace("explicit"), "default": low.trace(),
    }
    return spark.createDataFrame([(k, float(round(v, 4)) + 0.0) for k, v in found.items()], "method string, trace double")


_add("trace_estimates", _traces, "select unnest(['hutchinson', 'hutchinson, unit vectors', 'hutch++', 'na-hutch++', 'explicit', 'default']) as method, unnest([36e0, 64e0, 64e0, 64e0, 64e0, 64e0]) as trace")


def _samples(spark, sf_dir):
    rng = np.random.default_rng(1)
    rows = []
    for kind in ("rademacher", "rayleigh", "gaussian"):
        z = estimators.sample(kind, 400, 500, rng)
        rows.append((kind, bool(np.all(np.abs(z) == 1)), bool(np.allclose(np.linalg.norm(z, axis=0), 20)), bool(abs(z.mean()) < 0.02 and abs(z.std() - 1) < 0.02)))
    return spark.createDataFrame(rows, "kind string, signs boolean, unit_length boolean, standard boolean")


_add("samplers", _samples, "select * from (values ('rademacher', true, true, true), ('rayleigh', false, true, true), ('gaussian', false, false, true)) t(kind, signs, unit_length, standard)")


def _numbers(spark, sf_dir):
    d = basic.Diagonal(np.arange(1.0, 7.0))
    op = d + basic.Zero(6)
    op.matvec(np.ones(6))
    op.matvec(np.ones(6))
    op.rmatvec(np.ones(6))
    counts = (op.matvec_count, op.rmatvec_count)
    op.reset_count()
    rows = [("eig", i, float(round(x, 6))) for i, x in enumerate(d.eigs(symmetric=True))]
    rows += [("cond", 0, float(round(d.cond(), 6)))] + [("count", i, float(c)) for i, c in enumerate((*counts, op.matvec_count))]
    rows += [("div", i, float(round(x, 6))) for i, x in enumerate(d / np.arange(1.0, 7.0) ** 2)]
    rows += [("dense", i * 6 + j, float(x)) for i, row in enumerate(d.todense()) for j, x in enumerate(row) if x]
    return spark.createDataFrame(rows, "what string, i long, x double")


_add("numerical_methods", _numbers, "select 'eig' what, (6 - i)::bigint i, i::double x from range(1, 7) t(i) union all select 'cond', 0, 6e0 union all select 'count', * from (values (0, 2e0), (1, 1e0), (2, 0e0)) union all select 'div', i, i + 1e0 from range(6) t(i) union all select 'dense', i * 7, i + 1e0 from range(6) t(i)")


def _sparse(spark, sf_dir):
    return basic.SecondDerivative(200).tosparse().select("r", "c", "v")


_add("tosparse", _sparse, "select r::bigint r, (r + d)::bigint c, a v from range(1, 199) t(r), (values (-1, 1e0), (0, -2e0), (1, 1e0)) u(d, a)")


def _dots(spark, sf_dir):
    ops = {"gradient": basic.Gradient((4, 5)), "fft": signal.FFT((2, 8)), "real fft": signal.FFT(9, real=True), "real": basic.Real(5), "mdc": wave.MDC(np.ones((3, 2, 2)) + 1j, 5, 1)}
    return spark.createDataFrame([(k, bool(core.dottest(op, complexflag=0 if k in ("gradient", "real fft", "mdc") else 1))) for k, op in ops.items()], "operator string, ok boolean")


_add("dottest", _dots, "select unnest(['gradient', 'fft', 'real fft', 'real', 'mdc']) as operator, true ok")


def _tree(spark, sf_dir):
    op = 2.0 * basic.Flip(4) @ basic.Roll(4)
    return spark.createDataFrame([(i, line) for i, line in enumerate(op.describe().split("\n"))], "i long, line string")


_add("describe", _tree, "select * from (values (0::bigint, 'Product(4, 4)'), (1, '  Scaled(4, 4)'), (2, '    Flip(4, 4)'), (3, '  Roll(4, 4)')) t(i, line)")

# Tapers and wavelets
_RAMP = "(0.5e0 - 0.5e0 * cos(pi() * least(i, {n} - 1 - i) / ({t} - 1e0)))"
_TAPER = "case when least(i, {n} - 1 - i) < {t} then " + _RAMP + " else 1e0 end"


def _array(name, make, sql, digits=6):
    def query(spark, sf_dir):
        a = np.asarray(make())
        at = np.indices(a.shape).reshape(a.ndim, -1).T.tolist()
        return spark.createDataFrame([(*i, float(round(x, digits)) + 0.0) for i, x in zip(at, a.ravel().tolist(), strict=True)], ", ".join(f"i{k} long" for k in range(a.ndim)) + ", v double")

    _add(name, query, sql)


def _one(n, t, power="1e0"):
    return f"select i::bigint i0, round(pow({_TAPER.format(n=n, t=t)}, {power}), 6) + 0e0 v from range({n}) r(i)"


_array("taper_cosine", lambda: tapers.cosinetaper(31, 8), _one(31, 8))
_array("taper_cosine_square", lambda: tapers.cosinetaper(31, 8, True), _one(31, 8, "2e0"))
_array("taper_cosine_sqrt", lambda: tapers.taper(31, 8, "cosinesqrt"), _one(31, 8, "0.5e0"))
_array("taper2d", lambda: tapers.taper2d(5, 12, 4), f"select i::bigint i0, j::bigint i1, round({_TAPER.format(n=12, t=4)}, 6) + 0e0 v from range(12) r(i), range(5) s(j)")
_T2 = "with a as (select i, {} v from range(12) r(i)), b as (select i, {} v from range(10) r(i))".format(_TAPER.format(n=12, t=4), _TAPER.format(n=10, t=3))
_array("taper3d", lambda: tapers.taper3d(3, (12, 10), (4, 3)), f"{_T2} select a.i::bigint i0, b.i::bigint i1, j::bigint i2, round(a.v * b.v, 6) + 0e0 v from a, b, range(3) s(j)")
_array("tapernd", lambda: tapers.tapernd((12, 10), (4, 3)), f"{_T2} select a.i::bigint i0, b.i::bigint i1, round(a.v * b.v, 6) + 0e0 v from a, b")
_TIME = "select i::bigint i, (i - 30) * 0.004e0 t from range(61) r(i)"
_array("wavelet_gaussian", lambda: gaussian(np.arange(31) * 0.004, 0.02)[0], f"select i i0, round(exp(-t * t / 0.0008e0), 6) + 0e0 v from ({_TIME})")
_array("wavelet_even", lambda: gaussian(np.arange(32) * 0.004, 0.02)[0], f"select i i0, round(exp(-t * t / 0.0008e0), 6) + 0e0 v from ({_TIME})")
_SQ = "pow(case when t = 0 then 1e0 else sin(pi() * {f} * t) / (pi() * {f} * t) end, 2)"
_ORM = "pi() * (2500e0 / 5 * {d} - 2025e0 / 5 * {c} - 100e0 / 5 * {b} + 25e0 / 5 * {a})".format(**{k: _SQ.format(f=f) for k, f in zip("abcd", (5, 10, 45, 50), strict=True)})
_array("wavelet_ormsby", lambda: ormsby(np.arange(31) * 0.004)[0], f"select i i0, round(w / max(abs(w)) over (), 6) + 0e0 v from (select i, {_ORM} w from ({_TIME}))")
_array("wavelet_klauder", lambda: klauder(np.arange(31) * 0.004)[0], f"with s as (select i, cos(2 * pi() * (12.5e0 * t + 0.5e0 * 7.5e0 / 0.12e0 * t * t)) x from ({_TIME})), w as (select d, sum(a.x * b.x) w from range(-30, 31) q(d) join s a on true join s b on b.i = a.i + d group by d) select (d + 30)::bigint i0, round(w / max(w) over (), 6) + 0e0 v from w")

# Coefficients
_ANGLE = "with a as (select i::bigint i0, radians(i * 5e0) th from range(7) r(i))"
_R = "0.4e0"
_array("coefficients_akirichards", lambda: np.stack([c[:, 0] for c in avo.akirichards(np.arange(7) * 5.0, 0.4)], 1), f"{_ANGLE} select i0, p::bigint i1, round(case p when 0 then 1 / (2 * pow(cos(th), 2)) when 1 then -4 * {_R} * {_R} * pow(sin(th), 2) else 0.5e0 - 2 * {_R} * {_R} * pow(sin(th), 2) end, 6) + 0e0 v from a, range(3) s(p)")
_array("coefficients_fatti", lambda: np.stack([c[:, 0] for c in avo.fatti(np.arange(7) * 5.0, 0.4)], 1), f"{_ANGLE} select i0, p::bigint i1, round(case p when 0 then 0.5e0 * (1 + pow(tan(th), 2)) when 1 then -4 * {_R} * {_R} * pow(sin(th), 2) else 0.5e0 * (4 * {_R} * {_R} * pow(sin(th), 2) - pow(tan(th), 2)) end, 6) + 0e0 v from a, range(3) s(p)")
_CP = f"sqrt(1 - {_R} * {_R} * pow(sin(th), 2))"
_array("coefficients_ps", lambda: np.stack([c[:, 0] for c in avo.ps(np.arange(7) * 5.0, 0.4)], 1), f"{_ANGLE} select i0, p::bigint i1, round(-sin(th) / (2 * {_CP} * {_R}) * case p when 0 then 0e0 when 1 then 4 * {_R} * {_R} * pow(sin(th), 2) - 4 * {_R} * cos(th) * {_CP} else 1 + 2 * {_R} * {_R} * pow(sin(th), 2) - 2 * {_R} * cos(th) * {_CP} end, 6) + 0e0 v from a, range(3) s(p)")
_MEDIA = (2000.0, 1000.0, 2.0, 2300.0, 1200.0, 2.2, np.arange(7) * 5.0)
_PP = f"""{_ANGLE}, p as (select i0, sin(th) / 2000 p from a),
c as (select i0, p, sqrt(1 - pow(p * 2000, 2)) ct1, sqrt(1 - pow(p * 2300, 2)) ct0, sqrt(1 - pow(p * 1000, 2)) cf1, sqrt(1 - pow(p * 1200, 2)) cf0, pow(p * 1000, 2) s1, pow(p * 1200, 2) s0 from p),
k as (select *, 2.2e0 * (1 - 2 * s0) - 2 * (1 - 2 * s1) a, 2.2e0 * (1 - 2 * s0) + 4 * s1 b, 2 * (1 - 2 * s1) + 4.4e0 * s0 c, 2 * (2.2e0 * 1200 * 1200 - 2e0 * 1000 * 1000) d from c),
e as (select *, b * ct1 / 2000 + c * ct0 / 2300 e, b * cf1 / 1000 + c * cf0 / 1200 f, a - d * ct1 / 2000 * cf0 / 1200 g, a - d * ct0 / 2300 * cf1 / 1000 h from k)
select i0, round(((b * ct1 / 2000 - c * ct0 / 2300) * f - (a + d * ct1 / 2000 * cf0 / 1200) * h * p * p) / (e * f + g * h * p * p), 6) + 0e0 v from e"""
_array("zoeppritz_pp", lambda: avo.zoeppritz_pp(*_MEDIA), _PP)
_array("zoeppritz_element", lambda: avo.zoeppritz_element(*_MEDIA, element="PdPu"), _PP)
_array("zoeppritz_scattering", lambda: avo.zoeppritz_scattering(*_MEDIA)[0, 0], _PP)
_array("approx_zoeppritz_pp", lambda: avo.approx_zoeppritz_pp(*_MEDIA), _PP)

# Matrices of convolutions, slopes, axes and sections
_array("convmtx", lambda: estimates.convmtx([1.0, 2.0, 4.0], 6, 1), "select r::bigint i0, c::bigint i1, case r - c when -1 then 1e0 when 0 then 2e0 when 1 then 4e0 else 0e0 end v from range(6) s(r), range(6) t(c)")


def _plane():
    return np.add.outer(2.0 * np.arange(12), 3.0 * np.arange(10))


_array("slope_estimate", lambda: estimates.slope_estimate(_plane())[0], "select i::bigint i0, j::bigint i1, 1.5e0 v from range(12) r(i), range(10) s(j)")
_array("slope_anisotropy", lambda: estimates.slope_estimate(_plane())[1], "select i::bigint i0, j::bigint i1, 1e0 v from range(12) r(i), range(10) s(j)")
_array("dip_estimate", lambda: estimates.dip_estimate(_plane())[0], "select i::bigint i0, j::bigint i1, round(atan(1.5e0), 6) v from range(12) r(i), range(10) s(j)")
_array("makeaxis", lambda: np.concatenate([a for a in generators.makeaxis({"ot": 1, "dt": 0.5, "nt": 4, "ox": -2, "dx": 2, "nx": 3, "oy": 0, "dy": 1, "ny": 2})]), "select row_number() over (order by which, i) - 1 i0, v from (select 0 which, i, 1 + i * 0.5e0 v from range(4) r(i) union all select 1, i, (i - 3) * 0.5e0 from range(7) r(i) union all select 2, i, i * 2 - 2e0 from range(3) r(i) union all select 3, i, i::double from range(2) r(i))")
_array("directwave", lambda: directwave([1.0, 0.5], [0.004, 0.012], 8, 0.004, dist=[10.0, 20.0], kind="3d", derivative=False), "select i::bigint i0, j::bigint i1, round(coalesce(w, 0e0), 6) + 0e0 v from range(8) r(i) cross join range(2) s(j) left join (values (0, 1, 1 / (40 * pi())), (0, 2, 0.5e0 / (40 * pi())), (1, 3, 1 / (80 * pi())), (1, 4, 0.5e0 / (80 * pi()))) t(b, a, w) on a = i and b = j")
_array("threshold_percentiles", lambda: [thresholds.hard_level(0.5), thresholds.soft_level(0.5), thresholds.half_level(0.5)], "select * from (values (0::bigint, 0.125e0), (1, 0.5e0), (2, round(pow(4 / pow(54e0, 1e0 / 3) * 0.5e0, 1.5e0), 6))) t(i0, v)")
_W3 = [0.25, 1.0, 0.5]


def _section(name, make, events, nt=40, dt=0.004):
    """events in SQL: (id, tau, amp), the time in seconds of each trace and event."""
    for which, taps in (("", "(0, 0.25e0), (1, 1e0), (2, 0.5e0)"), ("_plain", "(1, 1e0)")):

        def query(spark, sf_dir, which=which):
            out = make(spark)[0 if which else 1]
            return out.select("k", (F.round("v", 6) + F.lit(0.0)).alias("v")).where("v <> 0")

        sql = f"with e as ({events}), s as (select id, amp, tau / {dt}e0 s from e), f as (select id, floor(s)::bigint + x i, amp * case when x = 0 then 1 - (s - floor(s)) else s - floor(s) end a from s, range(2) u(x) where floor(s) between 0 and {nt} - 1), y as (select id * {nt} + i + j - 1 k, sum(a * h) v from f, (values {taps}) w(j, h) where i + j - 1 between 0 and {nt} - 1 group by 1) select k, round(v, 6) + 0e0 v from y where round(v, 6) <> 0"
        _add(name + which, query, sql)


_T40 = np.arange(40) * 0.004
_X = np.arange(12) * 10.0
_section("section_linear2d", lambda s: generators.linear2d(s, _X, _T40, 1500.0, [0.03, 0.1], [10.0, -20.0], [1.0, -0.5], _W3), "select x id, t0 + sin(radians(th)) / 1500 * x * 10 tau, a amp from range(12) r(x), (values (0.03e0, 10e0, 1e0), (0.1e0, -20e0, -0.5e0)) e(t0, th, a)")
_section("section_parabolic2d", lambda s: generators.parabolic2d(s, _X, _T40, [0.03, 0.1], 1e-4, [1e-6, 2e-6], [1.0, -0.5], _W3), "select x id, t0 + 1e-4 * x * 10 + q * x * x * 100 tau, a amp from range(12) r(x), (values (0.03e0, 1e-6, 1e0), (0.1e0, 2e-6, -0.5e0)) e(t0, q, a)")
_section("section_hyperbolic2d", lambda s: generators.hyperbolic2d(s, _X, _T40, [0.03, 0.15], [1500.0, 1800.0], [1.0, -0.5], _W3), "select x id, sqrt(t0 * t0 + x * x * 100 / (v * v)) tau, a amp from range(12) r(x), (values (0.03e0, 1500e0, 1e0), (0.15e0, 1800e0, -0.5e0)) e(t0, v, a)")
_Y = np.arange(3) * 20.0
_section("section_linear3d", lambda s: generators.linear3d(s, _X[:5], _Y, _T40, 1500.0, 0.05, 30.0, 60.0, 2.0, _W3), "select y * 5 + x id, 0.05e0 + sin(radians(30e0)) * sin(radians(60e0)) / 1500 * y * 20 + sin(radians(30e0)) * cos(radians(60e0)) / 1500 * x * 10 tau, 2e0 amp from range(3) r(y), range(5) s(x)")
_section("section_parabolic3d", lambda s: generators.parabolic3d(s, _X[:5], _Y, _T40, 0.05, 1e-4, 2e-4, 1e-6, 2e-6, 1.0, _W3), "select y * 5 + x id, 0.05e0 + 1e-4 * x * 10 + 2e-4 * y * 20 + 1e-6 * x * x * 100 + 2e-6 * y * y * 400 tau, 1e0 amp from range(3) r(y), range(5) s(x)")
_section("section_hyperbolic3d", lambda s: generators.hyperbolic3d(s, _X[:5], _Y, _T40, 0.05, 1500.0, 1200.0, 1.0, _W3), "select y * 5 + x id, sqrt(0.0025e0 + x * x * 100 / (1500e0 * 1500) + y * y * 400 / (1200e0 * 1200)) tau, 1e0 amp from range(3) r(y), range(5) s(x)")
_array("sliding_design", lambda: np.stack([*signal.sliding1d_design(64, 16, 4, 8)[2], *signal.sliding1d_design(64, 16, 4, 8)[3]]), "select j::bigint i0, i::bigint i1, (12 * i + 16 * j)::double v from range(5) r(i), range(2) s(j)")
_array("patch_design", lambda: [float(x) for d in signal.patch2d_design((8, 10), (4, 4), (2, 2), (3, 5))[:2] for x in d], "select * from (values (0::bigint, 3e0), (1, 4e0), (2, 9e0), (3, 20e0)) t(i0, v)")




# Procedures
_UPSQL = operator_queries._PLANE
_array(
    "decomposition_up",
    lambda: wave.WavefieldDecomposition(np.cos(np.arange(64.0)).reshape(8, 8), 1e-6 * np.sin(np.arange(64.0)).reshape(8, 8), 8, 8, 0.004, 10.0, 1000.0, 1500.0, ntaper=0, kind="analytical")[0],
    f"with d as ({operator_queries._TO_P}) select r // 8 i0, r % 8 i1, round((cos(r) - sum(a * 1e-6 * sin(c))) / 2, 6) + 0e0 v from ({_UPSQL}) group by r",
)


def _spike():
    g = np.zeros((3, 3, 5))
    g[np.arange(3), np.arange(3), 0] = 2.0
    return wave.MDD(g, np.arange(15.0).reshape(3, 1, 5), dt=1.0, dr=1.0, niter=8).real.reshape(3, 9)


_array("mdd", _spike, "select s::bigint i0, t::bigint i1, case when t < 4 then 0e0 else (s * 5 + t - 4) / 2e0 end v from range(3) r(s), range(9) q(t)", 3)


def _marchenko():
    r = np.fromfunction(lambda s, q, t: 1.0 + s + 2 * q + t, (2, 2, 4))
    g0 = np.fromfunction(lambda q, t: 1.0 + q + t * t, (2, 4))
    return np.stack(wave.Marchenko(r, 0.5, dr=2.0, nsmooth=0).apply_onepoint(np.zeros(2), g0, greens=True, niter=1)).real


_array(
    "marchenko",
    _marchenko,
    """with direct as (select q, t, case when t < 4 then 1e0 + q + (3 - t) * (3 - t) else 0e0 end v from range(2) x(q), range(7) y(t)),
    r as (select s, q, u, 1e0 + s + 2 * q + u a from range(2) x(s), range(2) y(q), range(4) z(u)),
    g as (select s, (t + u) % 7 t, sum(a * v) v from r join direct using (q) group by 1, 2)
    select 0::bigint i0, q::bigint i1, t::bigint i2, 0e0 v from direct union all select 1, q, t, v from direct union all select 2, s, t, v from g union all select 3, q, 6 - t, v from direct""",
    4,
)
_array("deghosting", lambda: wave.Deghosting(np.add.outer(np.arange(8.0), np.arange(4.0) ** 2), 8, 4, 0.004, 10.0, 1500.0, 0.0, kind="vz", niter=4)[0], "select t::bigint i0, x::bigint i1, (t + x * x) / 2e0 v from range(8) r(t), range(4) s(x)", 3)
_array("seismic_interpolation", lambda: wave.SeismicInterpolation(np.add.outer(np.array([0.0, 2, 3, 6, 8]), np.arange(3.0)), 9, [0, 2, 3, 6, 8], kind="spatial", niter=40, epsR=0.1)[0], "select x::bigint i0, t::bigint i1, (x + t)::double v from range(9) r(x), range(3) s(t)", 2)
_WAVELET = [0.25, 1.0, 0.5]


def _poststack():
    m = np.cos(np.arange(20.0))
    return avo.PoststackInversion(avo.PoststackLinearModelling(_WAVELET, 20) @ m, _WAVELET, m0=m, niter=2)[0]


def _prestack():
    m = np.cos(np.arange(36.0)).reshape(12, 3)
    return avo.PrestackInversion(avo.PrestackLinearModelling(_WAVELET, [5.0, 15.0, 25.0], 0.5, 12) @ m, [5.0, 15.0, 25.0], _WAVELET, m0=m, niter=2)[0]


_array("poststack_inversion", _poststack, "select i::bigint i0, round(cos(i), 6) + 0e0 v from range(20) r(i)")
_array("prestack_inversion", _prestack, "select (i // 3)::bigint i0, (i % 3)::bigint i1, round(cos(i), 6) + 0e0 v from range(36) r(i)")
_array("nonstationary_convmtx", lambda: estimates.nonstationary_convmtx(np.fromfunction(lambda i, t: 1.0 + 3 * i + t, (5, 3)), 5, 1, (0, 5)), "select i::bigint i0, c::bigint i1, case when (c + 1 - i + 8) % 8 < 3 then 1e0 + 3 * i + (c + 1 - i + 8) % 8 else 0e0 end v from range(5) r(i), range(5) s(c)")


def _mean_vector(spark, sf_dir) -> Frame:
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.posexplode("embedding").alias("j", "x"))
    return Frame(df.groupBy(F.col("j").cast("long").alias("k")).agg(F.avg("x").alias("v")), 64)


def _spgl1(spark, sf_dir):
    y = _mean_vector(spark, sf_dir)
    out = solvers.spgl1(basic.Identity(64), y, tau=0.2, niter=8)[0]
    return out.df.select("k", (F.round("v", 4) + F.lit(0.0)).alias("v")).where("v <> 0")


_add(
    "solve_spgl1",
    _spgl1,
    """with y as (select j - 1 k, avg(x) v from (select generate_subscripts(embedding, 1) j, unnest(embedding)::double x from embeddings) group by 1),
    l as (select max((s - 0.2e0) / n) l from (select sum(abs(v)) over w s, row_number() over w n from y window w as (order by abs(v) desc, k rows unbounded preceding)))
    select k::bigint k, round(greatest(abs(v) - l, 0e0) * sign(v), 4) + 0e0 v from y, l where round(greatest(abs(v) - l, 0e0), 4) <> 0""",
)


def _callbacks(spark, sf_dir):
    truth = np.arange(1.0, 5.0)
    seen = solvers.MetricsCallback(truth, which=("mse", "mae"))
    solvers.cg(basic.Diagonal(np.array([1.0, 2.0, 1.0, 2.0])), truth * np.array([1.0, 2.0, 1.0, 2.0]), niter=2, tol=1e-30, callback=[seen])
    return spark.createDataFrame([(k, len(v), bool(v[-1] < 1e-10)) for k, v in seen.metrics.items()], "metric string, steps long, solved boolean")


_add("callbacks", _callbacks, "select * from (values ('mse', 2::bigint, true), ('mae', 2, true)) t(metric, steps, solved)")


# Streams
def _fir(spark, sf_dir):
    """Differences of each user's events, read as a stream in one trigger."""
    source = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    at = f"{storage.folder(spark)}/lattica-stream-{uuid.uuid4().hex}"
    storage.written.append((spark, at))
    query = fir.fir(source, "user_id", "ts", "value", [1.0, -1.0]).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{at}/out").select("user_id", F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)").alias("us"), (F.round("y", 6) + F.lit(0.0)).alias("y"))


def _hours(spark, sf_dir):
    out = fir.windowed_sum(spark.read.parquet(f"{sf_dir}/events.parquet"), "ts", "value", "1 hour", keys=["event_type"])
    return out.select("event_type", F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', window.start)").alias("start"), (F.round("y", 4) + F.lit(0.0)).alias("y"))


_add("stream_fir", _fir, "select user_id, epoch_us(ts) us, round(value - coalesce(lag(value) over w, 0e0), 6) + 0e0 y from events window w as (partition by user_id order by ts)")
_add("windowed_sum", _hours, "select event_type, epoch(date_trunc('hour', ts))::bigint as start, round(sum(value), 4) + 0e0 y from events group by 1, 2")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


__all__ = ["oracle_sql", "queries"]
