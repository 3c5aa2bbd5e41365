"""Basic operators: matrices, key moves, sums, derivatives, integration, smoothing, stacks."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.operators.core import Adjoint, FunctionOperator, LinOp, MemoizeOperator, Relation, Remap, Stencil, _Node, as_dims, batch, complexed, coordinate, is_complex, moved, parts, position, scaled, size, strides, totalled, union


def relation_frame(spark, r, c, a) -> DataFrame:
    cols = {"r": pa.array(np.asarray(r, np.int64)), "c": pa.array(np.asarray(c, np.int64)), "a": pa.array(np.real(a).astype(float))}
    if np.iscomplexobj(a):
        cols["ai"] = pa.array(np.imag(a).astype(float))
    return spark.createDataFrame(pa.table(cols))


#: Frames of up to so many rows, made from arrays of the driver, are broadcast.
FEW = 200_000


class AxisMatrix(LinOp):
    """A small matrix, as triples, applied along one axis. Each row reaches the rows its column has; no frame of the
    whole operator is built."""

    def __init__(self, dims, axis: int, n_out: int, triples, name=None):
        dims = as_dims(dims)
        self.axis = axis % len(dims)
        super().__init__(dims, (*dims[: self.axis], n_out, *dims[self.axis + 1 :]), name)
        self.n, self.n_out = dims[self.axis], n_out
        self.triples = tuple(np.asarray(x) for x in triples)
        self.is_complex = np.iscomplexobj(self.triples[2])

    def _send(self, df, dims, n_to, by, to, sign):
        r, c, a = self.triples
        rel = relation_frame(df.sparkSession, r, c, a)
        df = complexed(df) if self.is_complex else df
        rel = rel.select(*[F.col(x).alias("_" + x) for x in rel.columns])
        rel = F.broadcast(rel) if len(r) <= FEW else rel
        hit = df.withColumn("_at", coordinate(F.col("k"), dims, self.axis)).join(rel, F.col("_at") == F.col("_" + by))
        if self.is_complex:
            values = [(F.col("_a") * F.col("re") - F.lit(sign) * F.col("_ai") * F.col("im")).alias("re"), (F.col("_a") * F.col("im") + F.lit(sign) * F.col("_ai") * F.col("re")).alias("im")]
        else:
            values = [(F.col("_a") * F.col(p)).alias(p) for p in parts(df)]
        return totalled(hit.select(*batch(df), moved(F.col("k"), dims, self.axis, F.col("_" + to), n_to).alias("k"), *values))

    def _forward(self, df):
        return self._send(df, self.dims, self.n_out, "c", "r", 1.0)

    def _adjoint(self, df):
        return self._send(df, self.dimsd, self.n, "r", "c", -1.0)


class MatrixMult(Relation):
    """y = A x, over otherdims if given: A acts on the first axis. A is an array or a frame (r, c, a[, ai])."""

    explicit = True

    def __init__(self, A, otherdims=None, shape=None):  # noqa: N803
        other = as_dims(otherdims) if otherdims is not None else ()
        n_other = size(other) if other else 1
        self.matrix = None if isinstance(A, DataFrame) else np.asarray(A)
        m, n = shape if self.matrix is None else self.matrix.shape
        is_complex_ = "ai" in A.columns if self.matrix is None else np.iscomplexobj(self.matrix)

        def make(spark):
            if self.matrix is None:
                return A
            r, c = np.nonzero(self.matrix)
            return relation_frame(spark, r, c, self.matrix[r, c])

        super().__init__((n, *other), (m, *other), make, is_complex_, "MatrixMult", n_other)

    def inv(self) -> np.ndarray:
        return np.linalg.inv(self.todense())

    def todense(self):
        return super().todense() if self.matrix is None or self.dims != (self.matrix.shape[1],) else self.matrix


class Identity(LinOp):
    """Copy; from fewer to more rows the rest is 0, from more to fewer the rest is cropped. Shapes may be tuples."""

    def __init__(self, N, M=None):  # noqa: N803
        n, m = as_dims(N), as_dims(N if M is None else M)
        super().__init__(m, n)
        self.low = tuple(min(a, b) for a, b in zip(n, m, strict=True))

    def _crop(self, df, dims, to):
        if dims == to:
            return df
        at = [coordinate(F.col("k"), dims, a) for a in range(len(dims))]
        ok = F.lit(True)
        for i, n in zip(at, self.low, strict=True):
            ok &= i < n
        return df.where(ok).withColumn("k", position(at, to))

    def _forward(self, df):
        return self._crop(df, self.dims, self.dimsd)

    def _adjoint(self, df):
        return self._crop(df, self.dimsd, self.dims)


class Zero(LinOp):
    def __init__(self, N, M=None):  # noqa: N803
        super().__init__(N if M is None else M, N)

    def _forward(self, df):
        return df.where(F.lit(False))

    _adjoint = _forward


class Diagonal(LinOp):
    """d x along ``axis`` if dims is given, else of all positions. d is an array, or a function from coordinate to column."""

    def __init__(self, diag, dims=None, axis: int = -1):
        self.diag = diag if callable(diag) else np.asarray(diag)
        dims = as_dims(dims) if dims is not None else self.diag.shape
        super().__init__(dims)
        self.axis = None if not callable(diag) and self.diag.ndim == len(dims) and self.diag.shape == dims else axis
        self.is_complex = not callable(diag) and np.iscomplexobj(self.diag)
        self.explicit = False

    def _times(self, df, sign):
        at = F.col("k") if self.axis is None or callable(self.diag) and len(self.dims) == 1 else coordinate(F.col("k"), self.dims, self.axis)
        if callable(self.diag):
            return df.select(*batch(df), "k", *[(self.diag(at) * F.col(p)).alias(p) for p in parts(df)])
        flat = self.diag.ravel()
        d = relation_frame(df.sparkSession, np.arange(len(flat)), np.arange(len(flat)), flat).drop("r").withColumnsRenamed({"c": "_c", "a": "_a", "ai": "_ai"})
        if len(flat) <= 100_000:
            d = F.broadcast(d)
        df = complexed(df) if self.is_complex else df
        hit = df.withColumn("_at", at).join(d, F.col("_at") == F.col("_c"))
        if self.is_complex:
            s = F.lit(sign) * F.col("_ai")
            return hit.select(*batch(df), "k", (F.col("_a") * F.col("re") - s * F.col("im")).alias("re"), (F.col("_a") * F.col("im") + s * F.col("re")).alias("im"))
        return hit.select(*batch(df), "k", *[(F.col("_a") * F.col(p)).alias(p) for p in parts(df)])

    def _forward(self, df):
        return self._times(df, 1.0)

    def _adjoint(self, df):
        return self._times(df, -1.0)

    def matrix(self) -> np.ndarray:
        return self.todense()


class Transpose(Remap):
    def __init__(self, dims, axes: Sequence[int]):
        dims = as_dims(dims)
        axes = [a % len(dims) for a in axes]
        if sorted(axes) != list(range(len(dims))):
            raise ValueError(f"{list(axes)} isn't an order of all {len(dims)} axes")
        dimsd = [dims[a] for a in axes]
        back = np.argsort(axes)
        super().__init__(dims, dimsd, lambda k: position([coordinate(k, dims, a) for a in axes], dimsd), lambda k: position([coordinate(k, dimsd, int(b)) for b in back], dims), "Transpose")


class Flip(Remap):
    def __init__(self, dims, axis: int = -1):
        dims = as_dims(dims)
        n = dims[axis]
        f = lambda k: moved(k, dims, axis, F.lit(n - 1) - coordinate(k, dims, axis), n)
        super().__init__(dims, dims, f, f, "Flip")


class Roll(Remap):
    def __init__(self, dims, axis: int = -1, shift: int = 1):
        dims = as_dims(dims)
        n = dims[axis]
        f = lambda s: lambda k: moved(k, dims, axis, F.pmod(coordinate(k, dims, axis) + F.lit(s), F.lit(n)), n)
        super().__init__(dims, dims, f(shift), f(-shift), "Roll")


class Pad(Remap):
    """Zeros before and after each axis; the adjoint crops."""

    def __init__(self, dims, pad):
        dims = as_dims(dims)
        pad = [pad] if len(dims) == 1 and np.ndim(pad) == 1 else list(pad)
        if any(x < 0 for p in pad for x in p):
            raise ValueError(f"negative padding: {pad}")
        dimsd = [n + a + b for n, (a, b) in zip(dims, pad, strict=True)]

        def back(k):
            at = [coordinate(k, dimsd, x) - F.lit(p[0]) for x, p in enumerate(pad)]
            ok = F.lit(True)
            for i, n in zip(at, dims, strict=True):
                ok &= i.between(0, n - 1)
            return F.when(ok, position(at, dims))

        super().__init__(dims, dimsd, lambda k: position([coordinate(k, dims, x) + F.lit(p[0]) for x, p in enumerate(pad)], dimsd), back, "Pad")


class Sum(LinOp):
    """Sum over an axis; the adjoint repeats along it. A one-dimensional array has one sum."""

    def __init__(self, dims, axis: int = -1):
        dims = as_dims(dims)
        self.axis = axis % len(dims)
        super().__init__(dims, [d for a, d in enumerate(dims) if a != self.axis] or [1])
        self.n = dims[self.axis]

    def _forward(self, df):
        return totalled(df.withColumn("k", moved(F.col("k"), self.dims, self.axis, F.lit(0), 1)))

    def _adjoint(self, df):
        short = [*self.dims[: self.axis], 1, *self.dims[self.axis + 1 :]]
        return df.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(self.n - 1)))).withColumn("k", moved(F.col("k"), short, self.axis, F.col("_i"), self.n)).drop("_i")


class Symmetrize(LinOp):
    """Mirror an axis of n to 2n - 1 around its first sample; the adjoint folds and adds."""

    def __init__(self, dims, axis: int = -1):
        dims = as_dims(dims)
        self.axis, self.n = axis % len(dims), dims[axis]
        super().__init__(dims, [2 * d - 1 if a == self.axis else d for a, d in enumerate(dims)])

    def _forward(self, df):
        i = coordinate(F.col("k"), self.dims, self.axis)
        both = F.array_distinct(F.array(F.lit(self.n - 1) + i, F.lit(self.n - 1) - i))
        return df.withColumn("_i", F.explode(both)).withColumn("k", moved(F.col("k"), self.dims, self.axis, F.col("_i"), 2 * self.n - 1)).drop("_i")

    def _adjoint(self, df):
        i = coordinate(F.col("k"), self.dimsd, self.axis)
        return totalled(df.withColumn("k", moved(F.col("k"), self.dimsd, self.axis, F.abs(i - F.lit(self.n - 1)), self.n)))


class Restriction(AxisMatrix):
    """Samples at indices of an axis, each index once; the adjoint puts them back among zeros."""

    def __init__(self, dims, iava, axis: int = -1):
        dims = as_dims(dims)
        iava = np.asarray(iava, np.int64)
        if len(np.unique(iava)) != len(iava):
            raise ValueError("each index of iava may stand once")
        if len(iava) and (iava.min() < -dims[axis] or iava.max() >= dims[axis]):
            raise IndexError("index outside the axis")
        super().__init__(dims, axis, len(iava), (np.arange(len(iava)), iava % dims[axis], np.ones(len(iava))), "Restriction")

    def mask(self, df: DataFrame) -> DataFrame:
        """All positions, null where the samples aren't taken."""
        kept = df.where(coordinate(F.col("k"), self.dims, self.axis).isin([int(x) for x in self.triples[1]]))
        return df.sparkSession.range(self.shape[1]).select(F.col("id").alias("k")).join(kept, "k", "left")


class Regression(LinOp):
    """Polynomial of the given order at the points of taxis; the adjoint takes the moments."""

    def __init__(self, taxis, order: int):
        self.t, self.order = np.asarray(taxis, float), order
        super().__init__(order + 1, len(self.t))

    def _axis(self, df):
        rel = relation_frame(df.sparkSession, np.arange(len(self.t)), np.arange(len(self.t)), self.t)
        return rel.select(F.col("r").alias("_r"), F.col("a").alias("_t"))

    def _forward(self, df):
        # A batch's coefficients in one row, then the axis.
        p, keys = parts(df), batch(df)
        coefficients = df.groupBy(*keys).agg(*[F.map_from_entries(F.collect_list(F.struct(F.col("k").cast("int"), x))).alias(x) for x in p])
        axis = self._axis(df)
        axis = F.broadcast(axis) if len(self.t) <= FEW else axis
        power = [F.lit(1.0), *[F.pow("_t", F.lit(float(o))) for o in range(1, self.order + 1)]]
        values = [sum((F.coalesce(F.element_at(x, F.lit(o)), F.lit(0.0)) * q for o, q in enumerate(power)), F.lit(0.0)).alias(x) for x in p]
        return coefficients.crossJoin(axis).select(*keys, F.col("_r").alias("k"), *values)

    def _adjoint(self, df):
        axis = self._axis(df)
        hit = df.join(F.broadcast(axis) if len(self.t) <= FEW else axis, F.col("k") == F.col("_r")).withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(self.order))))
        power = F.when(F.col("_o") == 0, F.lit(1.0)).otherwise(F.pow("_t", F.col("_o")))
        return totalled(hit.select(*batch(df), F.col("_o").cast("long").alias("k"), *[(power * F.col(p)).alias(p) for p in parts(df)]))

    def apply(self, t, x) -> np.ndarray:
        return np.vander(np.asarray(t, float), self.order + 1, increasing=True) @ np.asarray(x)


class LinearRegression(Regression):
    def __init__(self, taxis):
        super().__init__(taxis, 1)


class CausalIntegration(LinOp):
    """Running sum times sampling along an axis: full, half (less half the sample) or trapezoidal (less half the first
    sample too). Missing samples count as 0.

    A line is cut into blocks of ``block`` samples: sums run inside blocks, and the blocks' sums, one row each, say where
    each begins. So a long line is many tasks.
    """

    def __init__(self, dims, axis: int = -1, sampling: float = 1.0, kind: str = "full", removefirst: bool = False, block: int = 1 << 16):
        dims = as_dims(dims)
        if kind not in ("full", "half", "trapezoidal"):
            raise NotImplementedError(f"{kind} is no kind of integration: full, half and trapezoidal are")
        self.axis, self.sampling, self.kind, self.block = axis % len(dims), sampling, kind, block
        self.first = int(removefirst)
        super().__init__(dims, [d - self.first if a == self.axis else d for a, d in enumerate(dims)])
        self.n = dims[self.axis]

    def _run(self, df, backwards: bool):
        """Rows (keys, _line, _i, values, sum_ of each value up to the sample, or from it on, first_ of the line)."""
        keys, p = batch(df), parts(df)
        i = coordinate(F.col("k"), self.dims, self.axis)
        line = [*keys, "_line"]
        blocks = (self.n - 1) // self.block + 1
        own = df.select(*keys, (F.col("k") - i * F.lit(strides(self.dims)[self.axis])).alias("_line"), i.alias("_i"), F.floor(i / self.block).cast("long").alias("_b"), *p)
        every = own.select(*line).distinct()
        if blocks > 1:
            every = every.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>")))
            sums = every.join(own.groupBy(*line, "_b").agg(*[F.sum(c).alias(c) for c in p]), [*line, "_b"], "left").fillna(0.0, p)
            before = Window.partitionBy(*line).orderBy(F.desc("_b") if backwards else F.col("_b")).rowsBetween(Window.unboundedPreceding, -1)
            every = sums.select(*line, "_b", *[F.coalesce(F.sum(c).over(before), F.lit(0.0)).alias(f"before_{c}") for c in p])
            if not backwards:
                every = every.join(own.where("_i = 0").select(*line, *[F.col(c).alias(f"first_{c}") for c in p]), line, "left").fillna(0.0, [f"first_{c}" for c in p])
        else:
            every = every.withColumn("_b", F.lit(0).cast("long"))
        low = F.col("_b") * self.block
        dense = every.withColumn("_i", F.explode(F.sequence(low, F.least(low + (self.block - 1), F.lit(self.n - 1).cast("long")))))
        dense = dense.join(own, [*line, "_b", "_i"], "left").fillna(0.0, p)
        inside = Window.partitionBy(*line, "_b").orderBy("_i")
        span = inside.rowsBetween(0, Window.unboundedFollowing) if backwards else inside.rowsBetween(Window.unboundedPreceding, 0)
        for c in p:
            dense = dense.withColumn(f"sum_{c}", F.sum(c).over(span) + (F.col(f"before_{c}") if blocks > 1 else F.lit(0.0)))
            if blocks == 1 and not backwards:
                dense = dense.withColumn(f"first_{c}", F.first(c).over(inside))
        return dense

    def _forward(self, df):
        keys, p = batch(df), parts(df)
        dense, stride = self._run(df, False), strides(self.dims)[self.axis]
        out = []
        for c in p:
            y = F.col(f"sum_{c}")
            if self.kind != "full":
                y = y - F.col(c) / 2
            if self.kind == "trapezoidal":
                y = F.when(F.col("_i") == 0, F.lit(0.0)).otherwise(y - F.col(f"first_{c}") / 2)
            out.append((F.lit(float(self.sampling)) * y).alias(c))
        i = F.col("_i") - F.lit(self.first)
        outer = (F.col("_line") - F.col("_line") % F.lit(stride)) / F.lit(stride * self.n)
        k = outer.cast("long") * F.lit((self.n - self.first) * stride) + F.col("_line") % F.lit(stride) + i * F.lit(stride)
        return dense.where(F.col("_i") >= self.first).select(*keys, k.alias("k"), *out)

    def _adjoint(self, df):
        keys, p = batch(df), parts(df)
        if self.first:
            df = df.withColumn("k", moved(F.col("k"), self.dimsd, self.axis, coordinate(F.col("k"), self.dimsd, self.axis) + 1, self.n))
        dense, stride = self._run(df, True), strides(self.dims)[self.axis]
        out = []
        for c in p:
            y = F.col(f"sum_{c}")
            if self.kind == "half":
                y = y - F.col(c) / 2
            if self.kind == "trapezoidal":
                y = F.when(F.col("_i") == 0, (y - F.col(c)) / 2).otherwise(y - F.col(c) / 2)
            out.append((F.lit(float(self.sampling)) * y).alias(c))
        return dense.select(*keys, (F.col("_line") + F.col("_i") * F.lit(stride)).alias("k"), *out)


class FirstDerivative(Stencil):
    """forward, backward or centered (order 3 or 5) difference quotients; rows without all neighbours are 0, or one-sided
    with ``edge``."""

    def __init__(self, dims, axis: int = -1, sampling: float = 1.0, kind: str = "centered", edge: bool = False, order: int = 3):
        n, d = as_dims(dims)[axis], float(sampling)
        one = lambda o, rows: [(o, -1 / d, *rows), (o + 1, 1 / d, *rows)]
        mid = lambda rows: [(-1, -0.5 / d, *rows), (1, 0.5 / d, *rows)]
        ends = (one(0, (0, 0)) + one(-1, (n - 1, n - 1))) if edge else []
        if kind == "forward":
            taps = one(0, (0, n - 2))
        elif kind == "backward":
            taps = one(-1, (1, n - 1))
        elif kind == "centered" and order == 3:
            taps = mid((1, n - 2)) + ends
        elif kind == "centered" and order == 5:
            rows = (2, n - 3)
            taps = [(-2, 1 / (12 * d), *rows), (-1, -2 / (3 * d), *rows), (1, 2 / (3 * d), *rows), (2, -1 / (12 * d), *rows)] + ends + (mid((1, 1)) + mid((n - 2, n - 2)) if edge else [])
        else:
            raise NotImplementedError(f"no derivative of kind {kind} and order {order}: forward, backward, centered of order 3 or 5 are known")
        super().__init__(dims, axis, taps, name="FirstDerivative")


class SecondDerivative(Stencil):
    def __init__(self, dims, axis: int = -1, sampling: float = 1.0, kind: str = "centered", edge: bool = False):
        n, d = as_dims(dims)[axis], float(sampling) ** 2
        three = lambda o, rows: [(o, 1 / d, *rows), (o + 1, -2 / d, *rows), (o + 2, 1 / d, *rows)]
        if kind == "forward":
            taps = three(0, (0, n - 3))
        elif kind == "backward":
            taps = three(-2, (2, n - 1))
        elif kind == "centered":
            taps = three(-1, (1, n - 2)) + (three(0, (0, 0)) + three(-2, (n - 1, n - 1)) if edge else [])
        else:
            raise NotImplementedError(f"no derivative of kind {kind}: forward, backward and centered are known")
        super().__init__(dims, axis, taps, name="SecondDerivative")


class _Composite(LinOp):
    """Operator that is another one by composition."""

    def __init__(self, op: LinOp, name: str, dims=None, dimsd=None):
        super().__init__(op.dims if dims is None else dims, op.dimsd if dimsd is None else dimsd, name)
        self.op, self.args = op, (op,)
        self.clinear, self.is_complex = op.clinear, op.is_complex

    def _forward(self, df):
        return self.op.forward(df)

    def _adjoint(self, df):
        return self.op.adjoint(df)


class Laplacian(_Composite):
    """Weighted sum of second derivatives over the axes; with ``compat`` the kind goes to the first axis alone."""

    def __init__(self, dims, axes=(-2, -1), weights=(1, 1), sampling=(1, 1), edge=False, kind="centered", compat=False):
        op = None
        for j, (a, w, d) in enumerate(zip(axes, weights, sampling, strict=True)):
            one = w * SecondDerivative(dims, a, d, "centered" if compat and j else kind, edge)
            op = one if op is None else op + one
        super().__init__(op, "Laplacian")


class Gradient(_Composite):
    def __init__(self, dims, sampling=1, edge=False, kind="centered"):
        dims = as_dims(dims)
        sampling = [sampling] * len(dims) if np.isscalar(sampling) else list(sampling)
        super().__init__(VStack([FirstDerivative(dims, a, sampling[a], kind, edge) for a in range(len(dims))]), "Gradient", dims, (len(dims), *dims))


class FirstDirectionalDerivative(_Composite):
    """Derivative along v, a direction or a field of directions."""

    def __init__(self, dims, v, sampling=1, edge=False, kind="centered"):
        dims, v = as_dims(dims), np.asarray(v)
        full = (len(dims), *dims)
        diag = Diagonal(v, full, 0) if v.ndim == 1 else Diagonal(v.reshape(full))
        super().__init__(Sum(full, 0) @ diag @ Gradient(dims, sampling, edge, kind), "FirstDirectionalDerivative", dims, dims)


class SecondDirectionalDerivative(_Composite):
    def __init__(self, dims, v, sampling=1, edge=False):
        first = FirstDirectionalDerivative(dims, v, sampling, edge)
        super().__init__(-(first.H @ first), "SecondDirectionalDerivative")


class Smoothing1D(Stencil):
    """Moving mean of an odd length (an even one grows by one); beyond the ends are zeros."""

    def __init__(self, nsmooth: int, dims, axis: int = -1):
        nsmooth += 1 - nsmooth % 2
        n = as_dims(dims)[axis]
        super().__init__(dims, axis, [(o, 1.0 / nsmooth, -o, n - 1 - o) for o in range(-(nsmooth // 2), nsmooth // 2 + 1)], name="Smoothing1D")


class Smoothing2D(_Composite):
    def __init__(self, nsmooth: Sequence[int], dims, axes=(-2, -1)):
        super().__init__(Smoothing1D(nsmooth[0], dims, axes[0]) @ Smoothing1D(nsmooth[1], dims, axes[1]), "Smoothing2D")


class Spread(Relation):
    """y[ix, it] += x[ix0, it0] along trajectories: table[ix0, it0, ix] is the row it (NaN: none), with dtable the part
    that falls to the next row. fh(ix0, it0) gives a table's line, or line and parts, instead."""

    def __init__(self, dims, dimsd, table=None, dtable=None, fh=None, interp=None):
        (nx0, nt0), (nx, nt) = dims, dimsd
        if (table is None) == (fh is None):
            raise ValueError("either table or fh is needed")
        if fh is not None:
            made = [[fh(a, b) for b in range(nt0)] for a in range(nx0)]
            if isinstance(made[0][0], tuple):
                table, dtable = (np.array([[m[i] for m in row] for row in made], float) for i in (0, 1))
            else:
                table = np.array(made, float)
        table = np.asarray(table, float)
        if table.shape != (nx0, nt0, nx):
            raise ValueError(f"the table's shape is {table.shape}, not {(nx0, nt0, nx)}")
        a, b, ix = np.nonzero(~np.isnan(table))
        it = table[a, b, ix].astype(int)
        c, r = a * nt0 + b, ix * nt + it
        w = np.ones(len(c))
        if dtable is not None:
            d = np.asarray(dtable, float)[a, b, ix]
            c, r, w = np.concatenate([c, c]), np.concatenate([r, r + 1]), np.concatenate([1 - d, d])
        super().__init__(dims, dimsd, lambda spark: relation_frame(spark, r, c, w), name="Spread")


class _Stack(_Node):
    def __init__(self, ops, dims, dimsd):
        self.ops = [op if isinstance(op, LinOp) else MatrixMult(op) for op in ops]
        super().__init__(self.ops, dims, dimsd)

    @staticmethod
    def _offsets(sizes):
        return np.concatenate([[0], np.cumsum(sizes)]).tolist()

    @staticmethod
    def _cut(df, low, high):
        return df.where(F.col("k").between(low, high - 1)).withColumn("k", F.col("k") - low)

    @staticmethod
    def _shift(df, low):
        return df.withColumn("k", F.col("k") + low)


class VStack(_Stack):
    def __init__(self, ops):
        ops = [op if isinstance(op, LinOp) else MatrixMult(op) for op in ops]
        if len({op.shape[1] for op in ops}) > 1:
            raise ValueError("stacked operators take vectors of different sizes")
        super().__init__(ops, ops[0].dims, sum(op.shape[0] for op in ops))
        self.at = self._offsets([op.shape[0] for op in ops])

    def _forward(self, df):
        return union([self._shift(op.forward(df), at) for op, at in zip(self.ops, self.at, strict=False)])

    def _adjoint(self, df):
        return totalled(union([op.adjoint(self._cut(df, a, b)) for op, a, b in zip(self.ops, self.at, self.at[1:], strict=False)]))


class HStack(_Stack):
    def __init__(self, ops):
        ops = [op if isinstance(op, LinOp) else MatrixMult(op) for op in ops]
        if len({op.shape[0] for op in ops}) > 1:
            raise ValueError("operators side by side give vectors of different sizes")
        super().__init__(ops, sum(op.shape[1] for op in ops), ops[0].dimsd)
        self.at = self._offsets([op.shape[1] for op in ops])

    def _forward(self, df):
        return totalled(union([op.forward(self._cut(df, a, b)) for op, a, b in zip(self.ops, self.at, self.at[1:], strict=False)]))

    def _adjoint(self, df):
        return union([self._shift(op.adjoint(df), at) for op, at in zip(self.ops, self.at, strict=False)])


class Block(_Composite):
    def __init__(self, ops):
        super().__init__(VStack([HStack(row) for row in ops]), "Block")


class BlockDiag(_Stack):
    """Operators on the blocks of a vector. One and the same operator for all blocks runs once, with the block as a key."""

    def __init__(self, ops):
        ops = [op if isinstance(op, LinOp) else MatrixMult(op) for op in ops]
        same = len({op.dims for op in ops}) == 1 and len({op.dimsd for op in ops}) == 1
        super().__init__(ops, (len(ops), *ops[0].dims) if same else sum(op.shape[1] for op in ops), (len(ops), *ops[0].dimsd) if same else sum(op.shape[0] for op in ops))
        self.one = ops[0] if all(op is ops[0] for op in ops) else None
        self.rows, self.cols = self._offsets([op.shape[0] for op in ops]), self._offsets([op.shape[1] for op in ops])

    def _run(self, df, adjoint):
        into, out = (self.rows, self.cols) if adjoint else (self.cols, self.rows)
        act = (lambda op: op.adjoint) if adjoint else (lambda op: op.forward)
        if self.one is not None:
            n, m = into[1], out[1]
            df = df.withColumn("_block", ((F.col("k") - F.col("k") % n) / n).cast("long")).withColumn("k", F.col("k") % n)
            return act(self.one)(df).withColumn("k", F.col("_block") * m + F.col("k")).drop("_block")
        return union([self._shift(act(op)(self._cut(df, a, b)), c) for op, a, b, c in zip(self.ops, into, into[1:], out, strict=False)])

    def _forward(self, df):
        return self._run(df, False)

    def _adjoint(self, df):
        return self._run(df, True)


class OnAxis(_Node):
    """A one-dimensional operator along one axis of an array: the other axes are a batch key."""

    def __init__(self, op: LinOp, dims, axis: int):
        dims = as_dims(dims)
        self.axis = axis % len(dims)
        super().__init__((op,), dims, (*dims[: self.axis], op.shape[0], *dims[self.axis + 1 :]))
        self.op = op

    def _run(self, df, dims, n, m, f):
        stride = strides(dims)[self.axis]
        i = coordinate(F.col("k"), dims, self.axis)
        df = df.withColumn("_line", F.col("k") - i * F.lit(stride)).withColumn("k", i)
        out = f(df)
        outer = ((F.col("_line") - F.col("_line") % F.lit(stride)) / F.lit(stride * n)).cast("long")
        return out.withColumn("k", outer * F.lit(m * stride) + F.col("_line") % F.lit(stride) + F.col("k") * F.lit(stride)).drop("_line")

    def _forward(self, df):
        return self._run(df, self.dims, self.op.shape[1], self.op.shape[0], self.op.forward)

    def _adjoint(self, df):
        return self._run(df, self.dimsd, self.op.shape[0], self.op.shape[1], self.op.adjoint)


class Kronecker(_Composite):
    """(A x B): B on the last axis, then A on the first; the product matrix is never built."""

    def __init__(self, Op1, Op2):  # noqa: N803
        n1, n2, m2 = Op1.shape[1], Op2.shape[1], Op2.shape[0]
        op = OnAxis(Op1, (n1, m2), 0) @ OnAxis(Op2, (n1, n2), 1)
        super().__init__(op, "Kronecker", n1 * n2, op.shape[0])


class _Part(LinOp):
    clinear = False

    def __init__(self, dims):
        super().__init__(dims)


class Real(_Part):
    def _forward(self, df):
        return df.select(*batch(df), "k", F.col("re").alias("v")) if is_complex(df) else df

    def _adjoint(self, df):
        return self._forward(df)


class Imag(_Part):
    def _forward(self, df):
        df = complexed(df)
        return df.select(*batch(df), "k", F.col("im").alias("v"))

    def _adjoint(self, df):
        df = df.select(*batch(df), "k", F.col("re").alias("v")) if is_complex(df) else df
        return scaled(df, 1j)


class Conj(_Part):
    def _forward(self, df):
        return df.withColumn("im", -F.col("im")) if is_complex(df) else df

    _adjoint = _forward


__all__ = ["Adjoint", "AxisMatrix", "Block", "BlockDiag", "CausalIntegration", "Conj", "Diagonal", "FirstDerivative", "FirstDirectionalDerivative", "Flip", "FunctionOperator", "Gradient", "HStack", "Identity", "Imag", "Kronecker", "Laplacian", "LinearRegression", "MatrixMult", "MemoizeOperator", "OnAxis", "Pad", "Real", "Regression", "Restriction", "Roll", "SecondDerivative", "SecondDirectionalDerivative", "Smoothing1D", "Smoothing2D", "Spread", "Sum", "Symmetrize", "Transpose", "VStack", "Zero", "relation_frame"]
