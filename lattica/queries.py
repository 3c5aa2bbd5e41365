"""Registry of the queries: operators over whole tables, and the SQL that says what they give."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lattica import function_queries, operator_queries
from lattica.functions import series, thresholds
from lattica.functions.tapers import hanningtaper
from lattica.functions.wavelets import ricker
from lattica.operators import avo, basic, signal
from lattica.operators.core import batch, coordinate, parts
from lattica.plans import solvers, storage

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: Vectors of the embeddings as a grid (vector, component) in SQL.
EMB = "with emb as (select vec_id::bigint i0, (generate_subscripts(embedding, 1) - 1)::bigint i1, unnest(embedding)::double v from embeddings)"
SPM = "with m as (select l_suppkey r, l_partkey c, sum(l_quantity) a from lineitem group by 1, 2)"


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def emb(spark, sf_dir):
    """(frame, number of vectors): k is vec_id * 64 + component."""
    df = _read(spark, sf_dir, "embeddings")
    n = int(df.agg(F.max("vec_id")).first()[0]) + 1
    return df.select("vec_id", F.posexplode("embedding").alias("j", "v")).select((F.col("vec_id") * 64 + F.col("j")).alias("k"), F.col("v").cast("double").alias("v")), n


def vectors(spark, sf_dir):
    """One vector of 64 for each vec_id, which is a batch key."""
    df = _read(spark, sf_dir, "embeddings")
    return df.select(F.col("vec_id").alias("i0"), F.posexplode("embedding").alias("j", "x")).select("i0", F.col("j").cast("long").alias("k"), F.col("x").cast("double").alias("v"))


def rounded(c, digits=6):
    return F.round(c, digits) + F.lit(0.0)


def grid(df, dims, digits=6):
    """Coordinates i0, i1, ... and values rounded, batch keys first."""
    keys = batch(df)
    cols = [coordinate(F.col("k"), dims, a).cast("long").alias(f"i{a + len(keys)}") for a in range(len(dims))]
    return df.select(*keys, *cols, *[rounded(F.col(p), digits).alias(p) for p in parts(df)])


def _on_emb(name, make, sql, adjoint=False, dims=None):
    def query(spark, sf_dir):
        df, n = emb(spark, sf_dir)
        op = make(n)
        out = op.adjoint(df) if adjoint else op.forward(df)
        return grid(out, dims(n) if dims else op.dims if adjoint else op.dimsd)

    query.__name__ = name
    QUERIES[name] = query
    SQL[name] = f"{EMB} {sql}"


def _on_vectors(name, make, sql, adjoint=False):
    def query(spark, sf_dir):
        op = make()
        df = vectors(spark, sf_dir)
        return grid(op.adjoint(df) if adjoint else op.forward(df), op.dims if adjoint else op.dimsd)

    query.__name__ = name
    QUERIES[name] = query
    SQL[name] = f"{EMB} {sql}"


R = "round(v, 6) + 0e0 v"
RS = "round(sum(v), 6) + 0e0 v"


def _taps(taps, low=None, n=64):
    """Scatter of taps (o, c, lo, hi) along i1 in SQL."""
    return " union all ".join(f"select i0, i1 - ({o}) i1, ({c!r}) * v v from emb where i1 - ({o}) between {max(lo, 0)} and {min(hi, n - 1)}" for o, c, lo, hi in taps)


def _stencil(name, make, taps):
    _on_emb(name, make, f"select i0, i1::bigint i1, {RS} from ({_taps(taps)}) t group by i0, i1")


_on_emb("flip", lambda n: basic.Flip((n, 64)), f"select i0, 63 - i1 i1, {R} from emb")
_on_emb("roll", lambda n: basic.Roll((n, 64), 1, 3), f"select i0, (i1 + 3) % 64 i1, {R} from emb")
_on_emb("transpose", lambda n: basic.Transpose((n, 64), (1, 0)), f"select i1 i0, i0 i1, {R} from emb")
_on_emb("pad", lambda n: basic.Pad((n, 64), ((1, 2), (3, 4))), f"select i0 + 1 i0, i1 + 3 i1, {R} from emb")
_on_emb("pad_adjoint", lambda n: basic.Pad((n - 3, 57), ((1, 2), (3, 4))), f"select i0 - 1 i0, i1 - 3 i1, {R} from emb where i1 between 3 and 59 and i0 between 1 and (select max(i0) - 2 from emb)", True)
_on_emb("symmetrize", lambda n: basic.Symmetrize((n, 64)), f"select i0, i1 + 63 i1, {R} from emb union all select i0, 63 - i1, round(v, 6) + 0e0 from emb where i1 > 0")
_on_emb("restriction", lambda n: basic.Restriction((n, 64), [3, 1, 40]), f"select i0, j::bigint i1, {R} from emb join (values (0, 3), (1, 1), (2, 40)) t(j, p) on i1 = p")
_on_emb("sum_axis", lambda n: basic.Sum((n, 64)), f"select i0, {RS} from emb group by 1")
_on_emb("identity_crop", lambda n: basic.Identity((n, 32), (n, 64)), f"select i0, i1, {R} from emb where i1 < 32")
_on_emb("zero", lambda n: basic.Zero((n, 64)), f"select i0, i1, {R} from emb where false")
_on_emb("diagonal", lambda n: basic.Diagonal(np.arange(1.0, 65.0), (n, 64), 1), "select i0, i1, round((i1 + 1) * v, 6) + 0e0 v from emb")
_stencil("first_derivative_forward", lambda n: basic.FirstDerivative((n, 64), kind="forward"), [(0, -1.0, 0, 62), (1, 1.0, 0, 62)])
_stencil("first_derivative_backward", lambda n: basic.FirstDerivative((n, 64), kind="backward"), [(-1, -1.0, 1, 63), (0, 1.0, 1, 63)])
_stencil("first_derivative_centered", lambda n: basic.FirstDerivative((n, 64)), [(-1, -0.5, 1, 62), (1, 0.5, 1, 62)])
_stencil("first_derivative_centered5", lambda n: basic.FirstDerivative((n, 64), order=5), [(-2, 1 / 12, 2, 61), (-1, -2 / 3, 2, 61), (1, 2 / 3, 2, 61), (2, -1 / 12, 2, 61)])
_stencil("first_derivative_edge", lambda n: basic.FirstDerivative((n, 64), edge=True), [(-1, -0.5, 1, 62), (1, 0.5, 1, 62), (0, -1.0, 0, 0), (1, 1.0, 0, 0), (-1, -1.0, 63, 63), (0, 1.0, 63, 63)])
_stencil("second_derivative", lambda n: basic.SecondDerivative((n, 64)), [(-1, 1.0, 1, 62), (0, -2.0, 1, 62), (1, 1.0, 1, 62)])
_stencil("smoothing1d", lambda n: basic.Smoothing1D(5, (n, 64)), [(o, 0.2, 0, 63) for o in range(-2, 3)])
_stencil("convolve1d", lambda n: signal.Convolve1D((n, 64), [0.25, 0.5, 0.25, 0.1], 1), [(1 - k, c, 0, 63) for k, c in enumerate([0.25, 0.5, 0.25, 0.1])])
_on_emb("first_derivative_adjoint", lambda n: basic.FirstDerivative((n, 64)), f"select i0, i1::bigint i1, {RS} from (select i0, i1 - 1 i1, -0.5e0 * v v from emb where i1 between 1 and 62 union all select i0, i1 + 1, 0.5e0 * v from emb where i1 between 1 and 62) t group by 1, 2", True)
LAST = "(select max(i0) from emb)"
_on_emb(
    "laplacian",
    lambda n: basic.Laplacian((n, 64)),
    f"select i0, i1, {RS} from (select i0 + d i0, i1, c * v v from emb, (values (-1, 1e0), (0, -2e0), (1, 1e0)) t(d, c) where i0 + d between 1 and {LAST} - 1 union all select i0, i1 + d, c * v from emb, (values (-1, 1e0), (0, -2e0), (1, 1e0)) t(d, c) where i1 + d between 1 and 62) t group by 1, 2",
)
_on_emb(
    "gradient",
    lambda n: basic.Gradient((n, 64)),
    f"select g::bigint i0, i1, i2, {RS} from (select 0 g, i0 - d i1, i1 i2, 0.5e0 * d * v v from emb, (values (-1), (1)) t(d) where i0 - d between 1 and {LAST} - 1 union all select 1, i0, i1 - d, 0.5e0 * d * v from emb, (values (-1), (1)) t(d) where i1 - d between 1 and 62) t group by 1, 2, 3",
)
_on_emb(
    "directional_derivative",
    lambda n: basic.FirstDirectionalDerivative((n, 64), [0.25, 0.75]),
    f"select i0, i1, {RS} from (select i0 - d i0, i1, 0.25e0 * 0.5e0 * d * v v from emb, (values (-1), (1)) t(d) where i0 - d between 1 and {LAST} - 1 union all select i0, i1 - d, 0.75e0 * 0.5e0 * d * v from emb, (values (-1), (1)) t(d) where i1 - d between 1 and 62) t group by 1, 2",
)
_on_emb("causal_integration_full", lambda n: basic.CausalIntegration((n, 64)), "select i0, i1, round(sum(v) over w, 6) + 0e0 v from emb window w as (partition by i0 order by i1)")
_on_emb("causal_integration_half", lambda n: basic.CausalIntegration((n, 64), kind="half", sampling=0.5), "select i0, i1, round(0.5e0 * (sum(v) over w - v / 2), 6) + 0e0 v from emb window w as (partition by i0 order by i1)")
_on_emb("causal_integration_trapezoidal", lambda n: basic.CausalIntegration((n, 64), kind="trapezoidal"), "select i0, i1, round(case when i1 = 0 then 0e0 else sum(v) over w - v / 2 - first_value(v) over w / 2 end, 6) + 0e0 v from emb window w as (partition by i0 order by i1)")
_on_emb("causal_integration_adjoint", lambda n: basic.CausalIntegration((n, 64)), "select i0, i1, round(sum(v) over w, 6) + 0e0 v from emb window w as (partition by i0 order by i1 desc)", True)
_on_emb("smoothing2d", lambda n: basic.Smoothing2D((3, 3), (n, 64)), f"select i0, i1, {RS} from (select i0 + a i0, i1 + b i1, v / 9e0 v from emb, (values (-1), (0), (1)) s(a), (values (-1), (0), (1)) t(b)) t where i0 between 0 and {LAST} and i1 between 0 and 63 group by 1, 2")
_on_emb("convolve2d", lambda n: signal.Convolve2D((n, 64), [[1.0, 2.0], [3.0, 4.0]], (0, 1)), f"select i0, i1, {RS} from (select i0 + a i0, i1 + b - 1 i1, c * v v from emb, (values (0, 0, 1e0), (0, 1, 2e0), (1, 0, 3e0), (1, 1, 4e0)) h(a, b, c)) t where i0 between 0 and {LAST} and i1 between 0 and 63 group by 1, 2")
_on_vectors(
    "nonstationary_convolve1d",
    lambda: signal.NonStationaryConvolve1D(64, np.array([[(j + 1) / (t + 2) for t in range(3)] for j in range(3)]), (10, 30, 50)),
    f"""select i0, i1, {RS} from (select i0, i1 + t - 1 i1, w * (j + 1) / (t + 2e0) * v v from (
      select i0, i1, v, j, case when q <= 0 then case when j = 0 then 1e0 else 0e0 end when q >= 2 then case when j = 2 then 1e0 else 0e0 end else greatest(1 - abs(q - j), 0e0) end w
      from (select *, (i1 - 10) / 20e0 q from emb), (values (0), (1), (2)) f(j)) x, (values (0), (1), (2)) k(t) where w > 0) y where i1 between 0 and 63 group by 1, 2""",
)
_on_vectors("interp_linear", lambda: signal.Interp(64, [0.5, 10.25, 62.75])[0], f"select i0, j::bigint i1, {RS} from (select i0, j, (1 - abs(i1 - p)) * v v from emb, (values (0, 0.5e0), (1, 10.25e0), (2, 62.75e0)) t(j, p) where abs(i1 - p) < 1) t group by 1, 2")
_on_vectors("interp_nearest", lambda: signal.Interp(64, [0.6, 10.25, 62.75], kind="nearest")[0], f"select i0, j::bigint i1, {R} from emb join (values (0, 1), (1, 10), (2, 63)) t(j, p) on i1 = p")
_on_vectors("bilinear", lambda: signal.Bilinear(np.array([[0.5, 3.25], [1.25, 6.5]]), (8, 8)), f"select i0, j::bigint i1, {RS} from (select i0, j, (1 - abs(i1 // 8 - a)) * (1 - abs(i1 % 8 - b)) * v v from emb, (values (0, 0.5e0, 1.25e0), (1, 3.25e0, 6.5e0)) t(j, a, b) where abs(i1 // 8 - a) < 1 and abs(i1 % 8 - b) < 1) t group by 1, 2")
_P = (np.arange(8) - 4) * 0.125
_on_vectors(
    "radon2d",
    lambda: signal.Radon2D(np.arange(8.0), np.arange(8.0), _P),
    f"""select i0, h::bigint i1, (f + e)::bigint i2, {RS} from (select i0, h, f, e, case when e = 0 then 1 - (tau - f) else tau - f end * v v from (
      select *, floor(tau) f from (select i0, h, v, i1 % 8 + (i1 // 8 - 4) * 0.125e0 * (h - 3.5e0) tau from emb, range(8) r(h)) where tau >= 0 and tau < 7), (values (0), (1)) s(e)) t group by 1, 2, 3""",
)
_on_vectors("spread_adjoint", lambda: basic.Spread((8, 8), (8, 8), table=np.fromfunction(lambda a, b, x: (a + b + x) % 8, (8, 8, 8))), f"select i0, (p // 8)::bigint i1, (p % 8)::bigint i2, {RS} from emb, range(64) r(p) where i1 % 8 = (p // 8 + p % 8 + i1 // 8) % 8 group by 1, 2, 3", True)
_on_vectors("sliding1d_adjoint", lambda: signal.Sliding1D(basic.Identity(16), None, 64, 16, 4, None), f"select i0, (w // 12)::bigint i1, (i1 - w)::bigint i2, {R} from emb join (select unnest(range(0, 49, 12)) w) on i1 between w and w + 15", True)
_on_vectors("sliding1d_normal", lambda: signal.Windows(64, 16, 4, None) @ signal.Windows(64, 16, 4, None).H, f"select i0, i1, {RS} from emb join (select unnest(range(0, 49, 12)) w) on i1 between w and w + 15 group by 1, 2")
_on_vectors("patch2d_adjoint", lambda: signal.Patch2D(basic.Identity((4, 4)), None, (8, 8), (4, 4), (2, 2), tapertype=None), f"select i0, (a // 2)::bigint i1, (b // 2)::bigint i2, (i1 // 8 - a)::bigint i3, (i1 % 8 - b)::bigint i4, {R} from emb, (select unnest(range(0, 5, 2)) a), (select unnest(range(0, 5, 2)) b) where i1 // 8 between a and a + 3 and i1 % 8 between b and b + 3", True)
_on_vectors("dct2", lambda: signal.DCT(64), f"select i0, k::bigint i1, {RS} from (select i0, k, v * cos(pi() * (2 * i1 + 1) * k / 128e0) * sqrt(2e0 / 64) * case when k = 0 then sqrt(0.5e0) else 1e0 end v from emb, range(64) r(k)) t group by 1, 2")
_on_vectors("dft", lambda: signal.FFT(64), "select i0, k::bigint i1, round(sum(v * cos(2 * pi() * i1 * k / 64e0)) / 8e0, 6) + 0e0 re, round(sum(-v * sin(2 * pi() * i1 * k / 64e0)) / 8e0, 6) + 0e0 im from emb, range(64) r(k) group by 1, 2")
_on_vectors("dwt_haar", lambda: signal.DWT(64), f"select i0, (i1 // 2 + 32 * d)::bigint i1, {RS} from (select i0, i1, d, v * case when d = 1 and i1 % 2 = 1 then -1 else 1 end / sqrt(2e0) v from emb, (values (0), (1)) t(d)) t group by 1, 2")
_on_vectors("regression_adjoint", lambda: basic.Regression(np.arange(64) / 64, 2), f"select i0, o::bigint i1, {RS} from (select i0, o, v * pow(i1 / 64e0, o) v from emb, range(3) r(o)) t group by 1, 2", True)
_on_vectors("scaled_sum", lambda: basic.Flip(64) * 2.0 + basic.Roll(64, shift=1) * 3.0, f"select i0, i1, {RS} from (select i0, 63 - i1 i1, 2e0 * v v from emb union all select i0, (i1 + 1) % 64, 3e0 * v from emb) t group by 1, 2")
_on_vectors("product", lambda: basic.FirstDerivative(64, kind="forward") @ basic.Flip(64), f"select i0, i1, {RS} from (select i0, 63 - i1 i1, -v v from emb where 63 - i1 <= 62 union all select i0, 62 - i1, v from emb where 62 - i1 between 0 and 62) t group by 1, 2")
_on_vectors("vstack", lambda: basic.VStack([basic.Flip(64), basic.Restriction(64, [5, 7])]), f"select i0, 63 - i1 i1, {R} from emb union all select i0, 64 + j, round(v, 6) + 0e0 from emb join (values (0, 5), (1, 7)) t(j, p) on i1 = p")
_on_vectors("hstack", lambda: basic.HStack([basic.Identity(32), 2.0 * basic.Identity(32)]), f"select i0, i1 % 32 i1, {RS} from (select i0, i1, case when i1 < 32 then v else 2e0 * v end v from emb) t group by 1, 2")
_on_vectors("blockdiag", lambda: basic.BlockDiag([basic.Flip(8)] * 8), f"select i0, i1 // 8 i1, 7 - i1 % 8 i2, {R} from emb")
_K1, _K2 = np.array([[1.0, 2.0, 0, 0, 0, 0, 0, 0], [0, 0, 0, 0, 0, 0, 3.0, 4.0]]), np.array([[0.5, 0, 0, 0, 0, 0, 0, -1.0]])
_on_vectors("kronecker", lambda: basic.Kronecker(basic.MatrixMult(_K1), basic.MatrixMult(_K2)), f"select i0, r::bigint i1, {RS} from (select i0, r, a * b * v v from emb join (values (0, 0, 1e0), (0, 1, 2e0), (1, 6, 3e0), (1, 7, 4e0)) k(r, c, a) on i1 // 8 = c join (values (0, 0.5e0), (7, -1e0)) l(c2, b) on i1 % 8 = c2) t group by 1, 2")
_on_vectors("matrix_otherdims", lambda: basic.MatrixMult(_K1, (8,)), f"select i0, r::bigint i1, i1 % 8 i2, {RS} from (select i0, i1, r, a * v v from emb join (values (0, 0, 1e0), (0, 1, 2e0), (1, 6, 3e0), (1, 7, 4e0)) k(r, c, a) on i1 // 8 = c) t group by i0, r, i1 % 8")
_on_vectors("fredholm1", lambda: signal.Fredholm1(np.fromfunction(lambda s, i, j: s + i + j + 1.0, (2, 3, 32))), f"select i0, i1 // 32 i1, i::bigint i2, {RS} from (select i0, i1, i, (i1 // 32 + i + i1 % 32 + 1e0) * v v from emb, range(3) r(i)) t group by i0, i1 // 32, i")
_on_vectors(
    "avo_akirichards",
    lambda: avo.AVOLinearModelling([10.0, 30.0], 0.5, 32),
    f"""select i0, i1 // 2 i1, p::bigint i2, {RS} from (select i0, i1, p, v * case p when 0 then 1 / (2 * cos(th) * cos(th)) when 1 then -1e0 * sin(th) * sin(th) else 0.5e0 - 0.5e0 * sin(th) * sin(th) end v
      from emb join (values (0, radians(10e0)), (1, radians(30e0))) x(a, th) on i1 % 2 = a, range(3) s(p)) t group by i0, i1 // 2, p""",
    True,
)


def _events(name, f, sql):
    def query(spark, sf_dir):
        w = series.over(["user_id"], ["ts", "event_id"])
        return _read(spark, sf_dir, "events").select("user_id", "event_id", rounded(f(w)).alias("d"))

    query.__name__ = name
    QUERIES[name] = query
    SQL[name] = f"select user_id, event_id, round({sql}, 6) + 0e0 d from events window w as (partition by user_id order by ts, event_id)"


_events("events_derivative_forward", lambda w: series.first_derivative("value", w, "forward"), "coalesce(lead(value) over w - value, 0e0)")
_events("events_derivative_backward", lambda w: series.first_derivative("value", w, "backward"), "coalesce(value - lag(value) over w, 0e0)")
_events("events_derivative_centered", lambda w: series.first_derivative("value", w), "coalesce(0.5e0 * (lead(value) over w - lag(value) over w), 0e0)")
_events("events_second_derivative", lambda w: series.second_derivative("value", w), "coalesce(lead(value) over w - 2e0 * value + lag(value) over w, 0e0)")
_events("events_running_sum", lambda w: series.running_sum("value", w), "sum(value) over (partition by user_id order by ts, event_id rows unbounded preceding)")
_events("events_running_trapezoid", lambda w: series.running_sum("value", w, "trapezoidal"), "case when row_number() over w = 1 then 0e0 else sum(value) over (partition by user_id order by ts, event_id rows unbounded preceding) - value / 2 - first_value(value) over w / 2 end")
_events("events_moving_mean", lambda w: series.moving_mean("value", w, 5), "sum(value) over (partition by user_id order by ts, event_id rows between 2 preceding and 2 following) / 5e0")
for _kind, _sql in (
    ("soft", "greatest(abs(value) - 20e0, 0e0) * sign(value)"),
    ("hard", "case when abs(value) <= sqrt(2 * 200e0) then 0e0 else value end"),
    ("half", "case when abs(value) <= pow(54e0, 1e0 / 3) / 4 * pow(200e0, 2e0 / 3) then 0e0 else 2e0 / 3 * value * (1 + cos(2e0 / 3 * pi() - 2e0 / 3 * acos(least(1e0, 200e0 / 8 * pow(abs(value) / 3, -1.5e0))))) end"),
):
    _level = 20.0 if _kind == "soft" else 200.0
    _events(f"{_kind}_threshold", lambda w, k=_kind, t=_level: thresholds.column(F.col("value"), k, t), _sql)


def first_derivative_smoothed(spark, sf_dir):
    """Centered derivative of the moving mean of each user's events."""
    w = series.over(["user_id"], ["ts", "event_id"])
    df = _read(spark, sf_dir, "events").select("user_id", "event_id", "ts", series.moving_mean("value", w, 5).alias("m"))
    return df.select("user_id", "event_id", rounded(series.first_derivative("m", w)).alias("d"))


SQL["first_derivative_smoothed"] = """with s as (select user_id, event_id, ts, sum(value) over (partition by user_id order by ts, event_id rows between 2 preceding and 2 following) / 5e0 m from events)
select user_id, event_id, round(coalesce(0.5e0 * (lead(m) over w - lag(m) over w), 0e0), 6) + 0e0 d from s window w as (partition by user_id order by ts, event_id)"""


def percentile_threshold(spark, sf_dir):
    """Soft threshold of all event values at their 75th percentile of size, found exactly by counting passes."""
    df = _read(spark, sf_dir, "events").select("event_id", "value")
    level = thresholds.percentile(df.select(F.abs("value").alias("x")), 75)
    return df.select("event_id", rounded(thresholds.column(F.col("value"), "soft", level)).alias("v"))


SQL["percentile_threshold"] = "select event_id, round(greatest(abs(value) - l, 0e0) * sign(value), 6) + 0e0 v from events, (select quantile_cont(abs(value), 0.75) l from events)"


def matrix(spark, sf_dir, keep=False):
    """Supplier by part quantities as a matrix in coordinates; written once if it is to be used more than once."""
    lines = _read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("r"), F.col("l_partkey").alias("c")).agg(F.sum("l_quantity").alias("a"))
    if keep:
        lines, _ = storage.write(lines)
    rows, cols = (int(_read(spark, sf_dir, t).agg(F.max(k)).first()[0]) + 1 for t, k in (("supplier", "s_suppkey"), ("part", "p_partkey")))
    return basic.MatrixMult(lines, shape=(rows, cols))


def spmv(spark, sf_dir):
    x = _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_retailprice").alias("v"))
    return matrix(spark, sf_dir).forward(x).select("k", rounded(F.col("v"), 2).alias("v"))


def spmv_adjoint(spark, sf_dir):
    y = _read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v"))
    return matrix(spark, sf_dir).adjoint(y).select("k", rounded(F.col("v"), 2).alias("v"))


def normal_matvec(spark, sf_dir):
    x = _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), (F.col("p_retailprice") / 1000).alias("v"))
    op = matrix(spark, sf_dir, keep=True)
    return (op.H @ op).forward(x).select("k", rounded(F.col("v"), 5).alias("v"))


SQL["spmv"] = f"{SPM} select r k, round(sum(a * p_retailprice), 2) + 0e0 v from m join part on c = p_partkey group by 1"
SQL["spmv_adjoint"] = f"{SPM} select c k, round(sum(a * s_acctbal), 2) + 0e0 v from m join supplier on r = s_suppkey group by 1"
SQL["normal_matvec"] = f"{SPM}, y as (select r, sum(a * p_retailprice / 1000) y from m join part on c = p_partkey group by 1) select c k, round(sum(a * y), 5) + 0e0 v from m join y using (r) group by 1"


def metrics_smoothed(spark, sf_dir):
    """mae, mse, snr and psnr of the smoothed embeddings against the plain ones, in one aggregation."""
    df, n = emb(spark, sf_dir)
    both = df.join(basic.Smoothing1D(5, (n, 64)).forward(df).withColumnRenamed("v", "s"), "k", "left")
    d = F.col("v") - F.coalesce("s", F.lit(0.0))
    out = both.agg(F.avg(F.abs(d)).alias("mae"), F.avg(d * d).alias("mse"), F.avg(F.col("v") * F.col("v")).alias("power"), F.max("v").alias("top"))
    return out.select(rounded(F.col("mae")).alias("mae"), rounded(F.col("mse")).alias("mse"), rounded(10 * F.log10(F.col("power") / F.col("mse"))).alias("snr"), rounded(10 * F.log10(F.col("top") * F.col("top") / F.col("mse"))).alias("psnr"))


SQL["metrics_smoothed"] = f"""{EMB}, s as (select v, sum(v) over (partition by i0 order by i1 rows between 2 preceding and 2 following) / 5e0 s from emb)
select round(avg(abs(v - s)), 6) + 0e0 mae, round(avg((v - s) * (v - s)), 6) + 0e0 mse, round(10 * log10(avg(v * v) / avg((v - s) * (v - s))), 6) + 0e0 snr, round(10 * log10(max(v) * max(v) / avg((v - s) * (v - s))), 6) + 0e0 psnr from s"""


def taper_hanning(spark, sf_dir):
    """Embeddings under a taper of 8 samples at both ends."""
    df, n = emb(spark, sf_dir)
    return grid(basic.Diagonal(hanningtaper(64, 8), (n, 64), 1).forward(df), (n, 64))


SQL["taper_hanning"] = f"{EMB} select i0, i1, round(v * case when least(i1, 63 - i1) < 8 then 0.5e0 - 0.5e0 * cos(pi() * least(i1, 63 - i1) / 7e0) else 1e0 end, 6) + 0e0 v from emb"


def ricker_wavelet(spark, sf_dir):
    w, t, _ = ricker(np.arange(31) * 0.004, 25)
    return spark.createDataFrame([(i, float(round(x, 6)) + 0.0) for i, x in enumerate(w)], "i long, v double")


SQL["ricker_wavelet"] = "select i::bigint i, round((1 - 2 * a) * exp(-a), 6) + 0e0 v from (select i, pow(pi() * 25 * (i - 30) * 0.004e0, 2) a from range(61) r(i))"


def _solved(spark, sf_dir, solve):
    """The solution of the supplier-by-part system for the suppliers' balances, rounded and without zeros."""
    y = _read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), (F.col("s_acctbal") / 1000).alias("v"))
    op = matrix(spark, sf_dir, keep=True)
    x = solve(op, solvers.Frame(y, op.shape[0]))[0]
    return x.df.select("k", rounded(F.col("v")).alias("v")).where("v <> 0")


def lsqr_distributed(spark, sf_dir):
    """Three LSQR steps with vectors that stay distributed."""
    return _solved(spark, sf_dir, lambda op, y: solvers.lsqr(op, y, niter=3, damp=10.0))


def cgls_distributed(spark, sf_dir):
    return _solved(spark, sf_dir, lambda op, y: solvers.cgls(op, y, niter=3))


def cg_distributed(spark, sf_dir):
    """Two conjugate-gradient steps for A^H A + 100, in the space of parts."""
    return _solved(spark, sf_dir, lambda op, y: solvers.normal_equations_inversion(op, y, epsI=10.0, niter=2))


def ista_distributed(spark, sf_dir):
    return _solved(spark, sf_dir, lambda op, y: solvers.ista(op, y, niter=2, eps=200.0, alpha=1e-6))


def fista_distributed(spark, sf_dir):
    return _solved(spark, sf_dir, lambda op, y: solvers.fista(op, y, niter=2, eps=200.0, alpha=1e-6))


def _conjugate_gradients(steps: int, damp: float) -> str:
    """Least squares in SQL, one CTE for each vector of each step; LSQR and the normal equations take the same steps."""
    d = f"{damp * damp!r}"
    ctes = ["y as (select s_suppkey r, s_acctbal / 1000 v from supplier)", "s0 as (select * from y)", "c0 as (select c, sum(a * v) v from m join s0 using (r) group by c)", "k0 as (select sum(v * v) k from c0)", "x0 as (select c, 0e0 v from c0)"]
    for i in range(steps):
        j = i + 1
        ctes += [
            f"q{i} as (select r, sum(a * v) v from m join c{i} using (c) group by r)",
            f"a{i} as (select (select k from k{i}) / ((select sum(v * v) from q{i}) + {d} * (select sum(v * v) from c{i})) a)",
            f"x{j} as (select c, x{i}.v + (select a from a{i}) * c{i}.v v from x{i} join c{i} using (c))",
            f"s{j} as (select r, s{i}.v - (select a from a{i}) * coalesce(q{i}.v, 0e0) v from s{i} left join q{i} using (r))",
            f"r{j} as (select c, g.v - {d} * x{j}.v v from (select c, sum(a * v) v from m join s{j} using (r) group by c) g join x{j} using (c))",
            f"k{j} as (select sum(v * v) k from r{j})",
            f"c{j} as (select c, r{j}.v + (select k from k{j}) / (select k from k{i}) * c{i}.v v from r{j} join c{i} using (c))",
        ]
    return f"{SPM}, {', '.join(ctes)} select c k, round(v, 6) + 0e0 v from x{steps} where round(v, 6) <> 0"


def _shrinkage() -> str:
    """Two steps of ISTA or FISTA in SQL. The momentum of FISTA's first step is 0, so two steps are alike."""
    soft = "select c, greatest(abs(v) - 1e-4, 0e0) * sign(v) v from {}"
    return f"""{SPM}, y as (select s_suppkey r, s_acctbal / 1000 v from supplier), g1 as (select c, 1e-6 * sum(a * v) v from m join y using (r) group by c), x1 as ({soft.format("g1")}),
    e as (select y.r, y.v - coalesce(q.v, 0e0) v from y left join (select r, sum(a * v) v from m join x1 using (c) group by r) q on y.r = q.r), g2 as (select c, x1.v + 1e-6 * g.v v from (select c, sum(a * v) v from m join e using (r) group by c) g join x1 using (c)), x2 as ({soft.format("g2")})
    select c k, round(v, 6) + 0e0 v from x2 where round(v, 6) <> 0"""


SQL["lsqr_distributed"] = _conjugate_gradients(3, 10.0)
SQL["cgls_distributed"] = _conjugate_gradients(3, 0.0)
SQL["cg_distributed"] = _conjugate_gradients(2, 10.0)
SQL["ista_distributed"] = SQL["fista_distributed"] = _shrinkage()


def shift_fractional(spark, sf_dir):
    df, n = emb(spark, sf_dir)
    return grid(signal.Shift((n, 64), 2.5, real=True).forward(df), (n, 64))


SQL["shift_fractional"] = f"""{EMB}, h as (select d, (1 + 2 * sum(cos(2 * pi() * f * (d - 2.5e0) / 64)) + cos(pi() * 2.5e0) * cos(pi() * d)) / 64 h from range(-63, 64) t(d), range(1, 32) u(f) group by d)
select i0, r::bigint i1, round(sum(h * v), 6) + 0e0 v from emb join range(64) t(r) on true join h on d = r - i1 group by 1, 2"""


def seismic_events(spark, sf_dir):
    """Two hyperbolic events whose wavelet is a Ricker, the ends of the traces included."""
    from lattica.sources.generators import hyperbolic2d

    w = ricker(np.arange(15) * 0.004, 25)[0]
    out = hyperbolic2d(spark, np.arange(40) * 10.0, np.arange(100) * 0.004, [0.1, 0.38], [1500.0, 1800.0], [1.0, -0.5], w)[1]
    return out.select("k", rounded(F.col("v")).alias("v")).where("v <> 0")


SQL["seismic_events"] = """with e as (select x, sqrt(t0 * t0 + x * x * 100 / (v * v)) / 0.004e0 s, a from range(40) r(x), (values (0.1e0, 1500e0, 1e0), (0.38e0, 1800e0, -0.5e0)) t(t0, v, a)),
f as (select x, floor(s)::bigint + d i, a * case when d = 0 then 1 - (s - floor(s)) else s - floor(s) end a from e, range(2) u(d) where floor(s) between 0 and 112),
w as (select j, (1 - 2 * q) * exp(-q) w from (select j, pow(pi() * 25 * j * 0.004e0, 2) q from range(-14, 15) r(j))),
y as (select x * 100 + i + j k, sum(a * w) v from f, w where i + j between 0 and 99 group by 1)
select k, round(v, 6) + 0e0 v from y where round(v, 6) <> 0"""


for _f in (first_derivative_smoothed, percentile_threshold, spmv, spmv_adjoint, normal_matvec, metrics_smoothed, taper_hanning, ricker_wavelet, lsqr_distributed, cgls_distributed, cg_distributed, ista_distributed, fista_distributed, shift_fractional, seismic_events):
    QUERIES[_f.__name__] = _f


def queries() -> dict:
    return QUERIES | operator_queries.queries() | function_queries.queries()


def oracle_sql() -> dict[str, str]:
    return SQL | operator_queries.oracle_sql() | function_queries.oracle_sql()


__all__ = ["oracle_sql", "queries"]
