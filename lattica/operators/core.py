"""Vectors as frames, and linear operators as pairs of frame transformations.

A vector is a DataFrame (k, v), or (k, re, im) if complex: k is the C-order position in the array, a missing row is 0.
Any other columns are batch keys: an operator applies to each of their values alike, in one job. An operator's forward
and adjoint build plans; nothing runs before an action.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.config import get_ndarray_multiplication

VALUES = ("v", "re", "im")


def parts(df: DataFrame) -> list[str]:
    return ["v"] if "v" in df.columns else ["re", "im"]


def batch(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in (*VALUES, "k")]


def is_complex(df: DataFrame) -> bool:
    return "re" in df.columns


def complexed(df: DataFrame) -> DataFrame:
    return df if is_complex(df) else df.select(*batch(df), "k", F.col("v").alias("re"), F.lit(0.0).alias("im"))


def totalled(df: DataFrame) -> DataFrame:
    """Sum of the rows of each position; partial sums come before the shuffle."""
    return df.groupBy(*batch(df), "k").agg(*[F.sum(p).alias(p) for p in parts(df)])


def alike(*frames: DataFrame) -> list[DataFrame]:
    """All complex if one is."""
    return [complexed(f) for f in frames] if any(map(is_complex, frames)) else list(frames)


def union(frames: Sequence[DataFrame]) -> DataFrame:
    out, *rest = alike(*frames)
    for f in rest:
        out = out.unionByName(f)
    return out


def scaled(df: DataFrame, alpha: complex) -> DataFrame:
    keys = [*batch(df), "k"]
    if isinstance(alpha, complex) and alpha.imag:
        df = complexed(df)
        a, b = F.lit(alpha.real), F.lit(alpha.imag)
        return df.select(*keys, (a * F.col("re") - b * F.col("im")).alias("re"), (a * F.col("im") + b * F.col("re")).alias("im"))
    a = F.lit(float(alpha.real))
    return df.select(*keys, *[(a * F.col(p)).alias(p) for p in parts(df)])


def conjugated(df: DataFrame) -> DataFrame:
    return df.withColumn("im", -F.col("im")) if is_complex(df) else df


def vector(spark: SparkSession, x: np.ndarray) -> DataFrame:
    """Frame of an array; rows of value 0 are left out."""
    x = np.asarray(x).ravel()
    k = np.flatnonzero(x)
    cols = {"k": pa.array(k.astype(np.int64))}
    if np.iscomplexobj(x):
        cols |= {"re": pa.array(x.real[k].astype(float)), "im": pa.array(x.imag[k].astype(float))}
    else:
        cols["v"] = pa.array(x[k].astype(float))
    return spark.createDataFrame(pa.table(cols))


def collected(df: DataFrame, n: int) -> np.ndarray:
    """Array of a frame without batch keys. For vectors that the driver can hold."""
    table = df.toArrow()
    k = table.column("k").to_numpy()
    if "re" in table.column_names:
        out = np.zeros(n, complex)
        np.add.at(out, k, table.column("re").to_numpy() + 1j * table.column("im").to_numpy())
    else:
        out = np.zeros(n)
        np.add.at(out, k, table.column("v").to_numpy())
    return out


def filled(df: DataFrame, n: int) -> DataFrame:
    """All n positions, 0 where df has no row; for frames without batch keys."""
    return df.sparkSession.range(n).select(F.col("id").alias("k")).join(df, "k", "left").select("k", *[F.coalesce(p, F.lit(0.0)).alias(p) for p in parts(df)])


def strides(dims: Sequence[int]) -> list[int]:
    out = [1]
    for n in reversed(dims[1:]):
        out.insert(0, out[0] * n)
    return out


def coordinate(k: Column, dims: Sequence[int], axis: int) -> Column:
    s = strides(dims)[axis]
    q = k if s == 1 else (k - k % F.lit(s)) / F.lit(s)
    q = q.cast("long")
    return q % F.lit(dims[axis]) if axis % len(dims) else q


def position(index: Sequence[Column], dims: Sequence[int]) -> Column:
    out = F.lit(0).cast("long")
    for i, s in zip(index, strides(dims), strict=True):
        out = out + i * F.lit(s)
    return out.cast("long")


def moved(k: Column, dims: Sequence[int], axis: int, to: Column, n: int) -> Column:
    """Position in an array whose axis has length n, with coordinate ``to`` there and the others unchanged."""
    axis %= len(dims)
    new = [*dims[:axis], n, *dims[axis + 1 :]]
    return position([to if a == axis else coordinate(k, dims, a) for a in range(len(dims))], new)


def size(dims: int | Sequence[int]) -> int:
    return int(np.prod(dims)) if not isinstance(dims, int) else dims


def as_dims(dims: int | Sequence[int]) -> tuple[int, ...]:
    return (int(dims),) if isinstance(dims, (int, np.integer)) else tuple(int(d) for d in dims)


class LinOp:
    """Operator of shape (size(dimsd), size(dims)). Subclasses give _forward and _adjoint from frame to frame."""

    clinear = True
    explicit = False
    is_complex = False

    def __init__(self, dims, dimsd=None, name: str | None = None):
        self.dims = as_dims(dims)
        self.dimsd = self.dims if dimsd is None else as_dims(dimsd)
        self.name = name or type(self).__name__
        self.reset_count()

    @property
    def shape(self) -> tuple[int, int]:
        return size(self.dimsd), size(self.dims)

    @property
    def dtype(self) -> np.dtype:
        """Values are doubles, or pairs of them."""
        return np.dtype(complex if self.is_complex else float)

    def reset_count(self) -> None:
        self.matvec_count = self.rmatvec_count = self.matmat_count = self.rmatmat_count = 0

    def _forward(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError(f"{self.name} has no forward")

    def _adjoint(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError(f"{self.name} has no adjoint")

    def forward(self, df: DataFrame) -> DataFrame:
        self.matvec_count += 1
        return self._forward(df)

    def adjoint(self, df: DataFrame) -> DataFrame:
        self.rmatvec_count += 1
        return self._adjoint(df)

    def _checked(self, x: np.ndarray, n: int) -> np.ndarray:
        if x.size != n:
            raise ValueError(f"dimension mismatch: {self.name} of shape {self.shape} and an array of {x.size}")
        return x.ravel()

    def matvec(self, x):
        if isinstance(x, DataFrame):
            return self.forward(x)
        return collected(self.forward(vector(session(), self._checked(x, self.shape[1]))), self.shape[0])

    def rmatvec(self, y):
        if isinstance(y, DataFrame):
            return self.adjoint(y)
        return collected(self.adjoint(vector(session(), self._checked(y, self.shape[0]))), self.shape[1])

    def _columns(self, x: np.ndarray, f: Callable, n: int, rows: int) -> np.ndarray:
        if x.ndim != 2 or x.shape[0] != n:
            raise ValueError(f"dimension mismatch: {self.name} of shape {self.shape} and a matrix of {x.shape}")
        spark = session()
        frame = vector(spark, x).withColumn("rhs", F.col("k") % x.shape[1]).withColumn("k", ((F.col("k") - F.col("rhs")) / x.shape[1]).cast("long"))
        out = f(frame)
        return collected(out.withColumn("k", F.col("k") * x.shape[1] + F.col("rhs")).drop("rhs"), rows * x.shape[1]).reshape(rows, -1)

    def matmat(self, x):
        """All columns in one job, the column's number being a batch key; a frame has its columns as batch keys already."""
        self.matmat_count += 1
        if isinstance(x, DataFrame):
            return self._forward(x)
        return self._columns(np.asarray(x), self._forward, self.shape[1], self.shape[0])

    def rmatmat(self, y):
        self.rmatmat_count += 1
        if isinstance(y, DataFrame):
            return self._adjoint(y)
        return self._columns(np.asarray(y), self._adjoint, self.shape[0], self.shape[1])

    def dot(self, x):
        if isinstance(x, LinOp):
            return Product(self, x)
        if np.isscalar(x):
            return Scaled(self, x)
        if isinstance(x, DataFrame):
            return self.forward(x)
        if hasattr(x, "through"):
            return x.through(self.forward)
        if not get_ndarray_multiplication():
            raise TypeError("products with arrays are switched off: use matvec")
        x = np.asarray(x)
        if x.ndim == 2 and x.shape != self.dims and x.shape[0] == self.shape[1]:
            return self.matmat(x)
        out = self.matvec(x)
        return out.reshape(self.dimsd) if x.ndim > 1 else out

    def __mul__(self, x):
        return self.dot(x)

    def __matmul__(self, x):
        if np.isscalar(x):
            raise ValueError("scalars are multiplied by *")
        return self.dot(x)

    def __rmul__(self, alpha):
        if not np.isscalar(alpha):
            return NotImplemented
        return Scaled(self, alpha)

    def __add__(self, other: LinOp) -> LinOp:
        return Plus(self, other)

    def __neg__(self) -> LinOp:
        return Scaled(self, -1.0)

    def __sub__(self, other: LinOp) -> LinOp:
        return Plus(self, -other)

    def __pow__(self, p: int) -> LinOp:
        return Power(self, p)

    @property
    def H(self) -> LinOp:  # noqa: N802
        return adjoint_of(self)

    @property
    def T(self) -> LinOp:  # noqa: N802
        return self.transpose()

    def transpose(self) -> LinOp:
        return Conjugate(adjoint_of(self)) if self.is_complex else adjoint_of(self)

    def conj(self) -> LinOp:
        return Conjugate(self)

    def apply_columns(self, cols: Sequence[int]) -> LinOp:
        return Columns(self, cols)

    def toreal(self, forw: bool = True, adj: bool = True) -> LinOp:
        return RealImag(self, forw, adj, True)

    def toimag(self, forw: bool = True, adj: bool = True) -> LinOp:
        return RealImag(self, forw, adj, False)

    def tocoo(self) -> DataFrame:
        """(r, c, v) or (r, c, re, im) of the entries that aren't 0: the operator on all unit vectors in one job."""
        n = self.shape[1]
        unit = session().range(n).select(F.col("id").alias("k"), F.col("id").alias("c"), F.lit(1.0).alias("v"))
        out = self._forward(unit)
        return out.where(" or ".join(f"{p} <> 0" for p in parts(out))).withColumnRenamed("k", "r")

    tosparse = tocoo

    def todense(self) -> np.ndarray:
        m, n = self.shape
        coo = self.tocoo()
        return collected(coo.withColumn("k", F.col("r") * n + F.col("c")).drop("r", "c"), m * n).reshape(m, n)

    def div(self, y: np.ndarray, niter: int = 100) -> np.ndarray:
        """Solve self x = y: directly if the operator holds its matrix, else by LSQR."""
        if self.explicit:
            a = self.todense()
            return np.linalg.solve(a, y.ravel()) if a.shape[0] == a.shape[1] else np.linalg.lstsq(a, y.ravel(), rcond=None)[0]
        from lattica.plans.solvers import lsqr

        return lsqr(self, np.asarray(y).ravel(), niter=niter, atol=1e-8, btol=1e-8)[0]

    def __truediv__(self, y):
        return self.div(y)

    def eigs(self, neigs: int | None = None, symmetric: bool = False, niter: int = 60) -> np.ndarray:
        """Largest eigenvalues, by magnitude; singular values if the operator isn't square. Block power iterations."""
        m, n = self.shape
        if neigs is None or neigs >= min(m, n) - 1 or self.explicit:
            a = self.todense()
            values = (np.linalg.eigvalsh(a) if symmetric else np.linalg.eigvals(a)) if m == n else np.linalg.svd(a, compute_uv=False)
            return values[np.argsort(-np.abs(values))][: neigs or len(values)]
        op = self if m == n else adjoint_of(self) @ self
        q, _ = np.linalg.qr(np.random.default_rng(0).normal(size=(n, min(n, neigs + 8))))
        for _ in range(niter):
            q, _ = np.linalg.qr(op.matmat(q))
        small = q.conj().T @ op.matmat(q)
        values = np.linalg.eigvalsh(small) if symmetric or m != n else np.linalg.eigvals(small)
        values = values[np.argsort(-np.abs(values))][:neigs]
        return values if m == n else np.sqrt(np.abs(values))

    def cond(self) -> float:
        values = np.abs(self.eigs())
        return float(values.max() / values.min())

    def trace(self, method: str | None = None, neval: int | None = None) -> float:
        from lattica.functions import estimators

        if self.shape[0] != self.shape[1]:
            raise ValueError("only square operators have a trace")
        if method == "explicit" or method is None and self.explicit:
            coo = self.tocoo().where("r = c")
            return sum(float(x or 0) * w for x, w in zip(coo.agg(*[F.sum(p) for p in parts(coo)]).first(), (1, 1j), strict=False))
        kind = {None: estimators.trace_hutchpp, "hutch++": estimators.trace_hutchpp, "na-hutch++": estimators.trace_nahutchpp, "hutchinson": estimators.trace_hutchinson}[method]
        return kind(self, neval)

    def describe(self, depth: int = 0) -> str:
        own = "  " * depth + f"{self.name}{self.shape}"
        return "\n".join([own, *[x.describe(depth + 1) for x in getattr(self, "args", ()) if isinstance(x, LinOp)]])

    def __repr__(self) -> str:
        return f"<{self.shape[0]}x{self.shape[1]} {self.name}>"




def common_dtype(ops: Iterable[LinOp], dtypes: Iterable = ()) -> np.dtype:
    """The type that holds the values of all operators and types."""
    return np.result_type(*[op.dtype for op in ops], *dtypes)


def need_dtype(x: np.ndarray, dtype, name: str) -> None:
    """Refuse an array that a real operator would lose the imaginary part of."""
    if np.iscomplexobj(x) and not np.issubdtype(np.dtype(dtype), np.complexfloating):
        raise TypeError(f"{name} is real, but the array holds complex numbers")


def session() -> SparkSession:
    found = SparkSession.getActiveSession()
    if found is None:
        raise RuntimeError("no Spark session is active")
    return found


class _Node(LinOp):
    def __init__(self, args: Sequence, dims, dimsd):
        super().__init__(dims, dimsd)
        self.args = tuple(args)
        ops = [a for a in args if isinstance(a, LinOp)]
        self.clinear = all(a.clinear for a in ops)
        self.is_complex = any(a.is_complex for a in ops)


class Scaled(_Node):
    """alpha A, and conj(alpha) A^H; nested factors merge."""

    def __init__(self, op: LinOp, alpha: complex):
        if isinstance(op, Scaled):
            op, alpha = op.op, op.alpha * alpha
        super().__init__((op,), op.dims, op.dimsd)
        self.op, self.alpha = op, alpha
        self.explicit = op.explicit
        self.is_complex |= isinstance(alpha, complex) and alpha.imag != 0

    def _forward(self, df):
        return scaled(self.op.forward(df), self.alpha)

    def _adjoint(self, df):
        return scaled(self.op.adjoint(df), np.conj(self.alpha))


class Adjoint(_Node):
    def __init__(self, op: LinOp):
        super().__init__((op,), op.dimsd, op.dims)
        self.op, self.explicit = op, op.explicit

    def _forward(self, df):
        return self.op.adjoint(df)

    def _adjoint(self, df):
        return self.op.forward(df)


def adjoint_of(op: LinOp) -> LinOp:
    """Adjoint with the rule pushed down to the leaves, so products reverse and double adjoints vanish."""
    if isinstance(op, Adjoint):
        return op.op
    if isinstance(op, Product):
        return Product(adjoint_of(op.args[1]), adjoint_of(op.args[0]))
    if isinstance(op, Plus):
        return Plus(*map(adjoint_of, op.args))
    if isinstance(op, Scaled):
        return Scaled(adjoint_of(op.op), np.conj(op.alpha))
    if isinstance(op, Conjugate):
        return Conjugate(adjoint_of(op.op))
    if isinstance(op, Power):
        return Power(adjoint_of(op.op), op.p)
    return Adjoint(op)


class Conjugate(_Node):
    def __init__(self, op: LinOp):
        super().__init__((op,), op.dims, op.dimsd)
        self.op = op

    def _forward(self, df):
        return conjugated(self.op.forward(conjugated(df)))

    def _adjoint(self, df):
        return conjugated(self.op.adjoint(conjugated(df)))


class Product(_Node):
    def __init__(self, a: LinOp, b: LinOp):
        if a.shape[1] != b.shape[0]:
            raise ValueError(f"cannot multiply {a!r} and {b!r}")
        super().__init__((a, b), b.dims, a.dimsd)

    def _forward(self, df):
        return self.args[0].forward(self.args[1].forward(df))

    def _adjoint(self, df):
        return self.args[1].adjoint(self.args[0].adjoint(df))


class Plus(_Node):
    def __init__(self, a: LinOp, b: LinOp):
        if a.shape != b.shape:
            raise ValueError(f"cannot add {a!r} and {b!r}")
        super().__init__((a, b), a.dims, a.dimsd)

    def _forward(self, df):
        return totalled(union([a.forward(df) for a in self.args]))

    def _adjoint(self, df):
        return totalled(union([a.adjoint(df) for a in self.args]))


class Power(_Node):
    def __init__(self, op: LinOp, p: int):
        if op.shape[0] != op.shape[1] or p < 0 or int(p) != p:
            raise ValueError("only square operators have powers, of whole exponents from 0")
        super().__init__((op,), op.dims, op.dimsd)
        self.op, self.p = op, int(p)

    def _forward(self, df):
        for _ in range(self.p):
            df = self.op.forward(df)
        return df

    def _adjoint(self, df):
        for _ in range(self.p):
            df = self.op.adjoint(df)
        return df


class Columns(_Node):
    """A restricted to some columns."""

    def __init__(self, op: LinOp, cols: Sequence[int]):
        super().__init__((op,), (len(cols),), op.dimsd)
        self.op, self.cols = op, [int(c) for c in cols]

    def _mapping(self, df):
        return df.sparkSession.createDataFrame([(i, c) for i, c in enumerate(self.cols)], "_i long, _c long")

    def _forward(self, df):
        m = self._mapping(df)
        return self.op.forward(df.join(m, df["k"] == m["_i"]).select(*batch(df), F.col("_c").alias("k"), *parts(df)))

    def _adjoint(self, df):
        out = self.op.adjoint(df)
        m = self._mapping(df)
        return out.join(m, out["k"] == m["_c"]).select(*batch(out), F.col("_i").alias("k"), *parts(out))


class RealImag(_Node):
    """Real or imaginary part after A, and after A^H (there minus the imaginary part)."""

    def __init__(self, op: LinOp, forw: bool, adj: bool, real: bool):
        super().__init__((op,), op.dims, op.dimsd)
        self.op, self.forw, self.adj, self.real = op, forw, adj, real
        self.clinear = False

    def _part(self, df, sign):
        df = complexed(df)
        return df.select(*batch(df), "k", (F.col("re") if self.real else F.lit(sign) * F.col("im")).alias("v"))

    def _forward(self, df):
        out = self.op.forward(df)
        return self._part(out, 1.0) if self.forw else out

    def _adjoint(self, df):
        out = self.op.adjoint(df)
        return self._part(out, -1.0) if self.adj else out


class FunctionOperator(LinOp):
    """Operator of a function of frames and, if there is one, the function of its adjoint."""

    def __init__(self, f: Callable, *args, name: str | None = None):
        fc = args[0] if args and callable(args[0]) else None
        sizes = args[1:] if fc else args
        n, m = (sizes[0], sizes[0]) if len(sizes) == 1 else sizes
        super().__init__(m, n, name)
        self.f, self.fc = f, fc

    def _forward(self, df):
        return self.f(df)

    def _adjoint(self, df):
        if self.fc is None:
            raise NotImplementedError(f"{self.name} has no adjoint")
        return self.fc(df)


def aslinearoperator(op) -> LinOp:
    """op itself, or an operator around anything with shape, matvec and rmatvec on frames."""
    return op if isinstance(op, LinOp) else FunctionOperator(op.matvec, op.rmatvec, op.shape[0], op.shape[1])


class Remap(LinOp):
    """Each row moves: y[to(k)] = x[k] where that is defined. ``to`` and ``back`` map a key to a key or null."""

    def __init__(self, dims, dimsd, to: Callable[[Column], Column], back: Callable[[Column], Column], name: str | None = None):
        super().__init__(dims, dimsd, name)
        self.to, self.back = to, back

    @staticmethod
    def _move(df, f):
        return df.select(*batch(df), f(F.col("k")).cast("long").alias("k"), *parts(df)).where("k is not null")

    def _forward(self, df):
        return self._move(df, self.to)

    def _adjoint(self, df):
        return self._move(df, self.back)


class Stencil(LinOp):
    """y[i] = sum of c x[i + o] along an axis over the taps (o, c, lo, hi) with lo <= i <= hi.

    Both directions send each row to the rows its taps reach and add up there; partial sums come before the shuffle, which
    goes by position, so no line of the array has to fit in a task.
    """

    def __init__(self, dims, axis: int, taps: Iterable[tuple[int, complex, int, int]], n_out: int | None = None, name: str | None = None):
        dims = as_dims(dims)
        self.axis = axis % len(dims)
        self.n = dims[self.axis]
        self.n_out = self.n if n_out is None else n_out
        super().__init__(dims, (*dims[: self.axis], self.n_out, *dims[self.axis + 1 :]), name)
        self.taps = [(int(o), c, max(0, int(lo)), min(self.n_out - 1, int(hi))) for o, c, lo, hi in taps]
        self.taps = [t for t in self.taps if t[1] != 0 and t[2] <= t[3]]
        self.is_complex = any(np.iscomplexobj(t[1]) and np.imag(t[1]) for t in self.taps)

    def _send(self, df, dims, n_to, taps):
        if self.is_complex:
            df = complexed(df)
        if not taps:
            return df.limit(0)
        i = coordinate(F.col("k"), dims, self.axis)
        hits = F.array(*[F.struct((i + F.lit(o)).alias("i"), F.lit(float(np.real(c))).alias("a"), F.lit(float(np.imag(c))).alias("b"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for o, c, lo, hi in taps])
        hits = F.filter(hits, lambda t: t["i"].between(t["lo"], t["hi"]))
        df = df.select(*batch(df), "k", *parts(df), F.explode(hits).alias("t"))
        a, b = F.col("t.a"), F.col("t.b")
        if not self.is_complex:
            values = [(a * F.col(p)).alias(p) for p in parts(df)]
        else:
            values = [(a * F.col("re") - b * F.col("im")).alias("re"), (a * F.col("im") + b * F.col("re")).alias("im")]
        return totalled(df.select(*[c for c in batch(df) if c != "t"], moved(F.col("k"), dims, self.axis, F.col("t.i"), n_to).alias("k"), *values))

    def _forward(self, df):
        return self._send(df, self.dims, self.n_out, [(-o, c, lo, hi) for o, c, lo, hi in self.taps])

    def _adjoint(self, df):
        # Row i reaches column i + o if lo <= i <= hi, that is lo + o <= column <= hi + o, within the axis.
        taps = [(o, np.conj(c), max(0, lo + o), min(self.n - 1, hi + o)) for o, c, lo, hi in self.taps]
        return self._send(df, self.dimsd, self.n, taps)


class Relation(LinOp):
    """Operator of a relation (r, c, a[, ai]): y[r] = sum of a x[c]. ``make`` builds the relation's frame from a session.

    With ``inner`` it acts on the leading part of positions, each row and column standing for ``inner`` neighbours in turn:
    the join goes by the leading part, so the relation isn't repeated.
    """

    def __init__(self, dims, dimsd, make: Callable[[SparkSession], DataFrame], is_complex: bool = False, name: str | None = None, inner: int = 1):
        super().__init__(dims, dimsd, name)
        self.make, self.is_complex, self.inner = make, is_complex, int(inner)

    def relation(self) -> DataFrame:
        return self.make(session())

    def _join(self, df, by, to, sign):
        rel = self.make(df.sparkSession)
        rel = rel.select(*[F.col(c).alias("_" + c) for c in rel.columns])
        if self.is_complex:
            df = complexed(df)
            turn = F.lit(sign) * F.col("_ai")
            values = [(F.col("_a") * F.col("re") - turn * F.col("im")).alias("re"), (F.col("_a") * F.col("im") + turn * F.col("re")).alias("im")]
        else:
            values = [(F.col("_a") * F.col(p)).alias(p) for p in parts(df)]
        if self.inner == 1:
            return totalled(df.join(rel, df["k"] == rel["_" + by]).select(*batch(df), F.col("_" + to).alias("k"), *values))
        at = F.col("k") % F.lit(self.inner)
        hit = df.withColumn("_at", at).withColumn("_lead", ((F.col("k") - at) / F.lit(self.inner)).cast("long")).join(rel, F.col("_lead") == F.col("_" + by))
        return totalled(hit.select(*batch(df), (F.col("_" + to) * F.lit(self.inner) + F.col("_at")).alias("k"), *values))

    def _forward(self, df):
        return self._join(df, "c", "r", 1.0)

    def _adjoint(self, df):
        return self._join(df, "r", "c", -1.0)


class Traces(LinOp):
    """A function of whole lines along an axis, in Arrow batches: for transforms that need all samples of a line.

    ``forward_kernel`` and ``adjoint_kernel`` take and give a matrix of lines by samples.
    """

    def __init__(self, dims, axis: int, n_out: int, forward_kernel: Callable, adjoint_kernel: Callable, out_complex: bool = False, back_complex: bool = False, name: str | None = None):
        dims = as_dims(dims)
        self.axis, self.n_out = axis % len(dims), int(n_out)
        super().__init__(dims, (*dims[: self.axis], self.n_out, *dims[self.axis + 1 :]), name)
        self.kernels = (forward_kernel, adjoint_kernel)
        self.out_complex, self.back_complex = out_complex, back_complex
        self.is_complex = out_complex

    def _run(self, df, dims, n, m, kernel, out_complex):
        p, keys = parts(df), batch(df)
        stride = strides(dims)[self.axis]
        line = F.col("k") - coordinate(F.col("k"), dims, self.axis) * F.lit(stride)
        outer = (line - line % F.lit(stride)) / F.lit(stride * n)
        packed = df.select(*keys, line.alias("line"), (outer.cast("long") * F.lit(m * stride) + line % F.lit(stride)).alias("to"), coordinate(F.col("k"), dims, self.axis).alias("i"), *p)
        packed = packed.groupBy(*keys, "line", "to").agg(F.collect_list(F.struct("i", *p)).alias("x"))
        names = ["re", "im"] if out_complex else ["v"]

        def run(batches):
            for b in batches:
                x = b.column("x")
                flat = x.flatten()
                row = np.repeat(np.arange(len(x)), x.value_lengths().to_numpy())
                grid = np.zeros((len(x), n), complex if "re" in p else float)
                at = flat.field("i").to_numpy(zero_copy_only=False)
                grid[row, at] = flat.field("v").to_numpy(zero_copy_only=False) if "v" in p else flat.field("re").to_numpy(zero_copy_only=False) + 1j * flat.field("im").to_numpy(zero_copy_only=False)
                out = kernel(grid)
                lines = np.repeat(np.arange(len(x)), m)
                k = b.column("to").to_numpy()[:, None] + np.arange(m) * stride
                cols = [b.column(c).take(pa.array(lines)) for c in keys] + [pa.array(k.ravel())]
                cols += [pa.array(np.ascontiguousarray(v).ravel().astype(float)) for v in ((out.real, out.imag) if out_complex else (np.real(out),))]
                yield pa.RecordBatch.from_arrays(cols, names=[*keys, "k", *names])

        ddl = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keys), "k long", *(f"{c} double" for c in names)])
        return packed.mapInArrow(run, ddl)

    def _forward(self, df):
        return self._run(df, self.dims, self.dims[self.axis], self.n_out, self.kernels[0], self.out_complex or is_complex(df) and self.back_complex is None)

    def _adjoint(self, df):
        return self._run(df, self.dimsd, self.n_out, self.dims[self.axis], self.kernels[1], bool(self.back_complex) or is_complex(df) and self.back_complex is None)


class Cached(_Node):
    """Operator that keeps the results of its last ``max_neval`` products, each known by the values it was taken of.

    Values are told apart by their number and the sum and exclusive or of their hashes, one job for each product; results
    are written to the shared folder and deleted when they are forgotten.
    """

    def __init__(self, op: LinOp, max_neval: int = 10):
        super().__init__((op,), op.dims, op.dimsd)
        self.op, self.max_neval = op, max_neval
        self.kept: list[tuple[tuple, DataFrame, str]] = []

    def _of(self, kind: str, df: DataFrame, f: Callable) -> DataFrame:
        from lattica.plans import storage

        nonzero = df.where(" or ".join(f"{p} <> 0" for p in parts(df))).select(F.xxhash64(*sorted(batch(df)), "k", *parts(df)).alias("h"))
        key = (kind, tuple(sorted(df.columns)), *nonzero.agg(F.count("h"), F.expr("bit_xor(h)"), F.sum(F.col("h").cast("decimal(38,0)"))).first())
        for known, out, _ in self.kept:
            if known == key:
                return out
        out, path = storage.write(f(df))
        self.kept.append((key, out, path))
        if len(self.kept) > self.max_neval:
            storage.forget(self.kept.pop(0)[2])
        return out

    def _forward(self, df):
        return self._of("forward", df, self.op.forward)

    def _adjoint(self, df):
        return self._of("adjoint", df, self.op.adjoint)


MemoizeOperator = Cached


def dottest(op: LinOp, rtol: float = 1e-6, atol: float = 1e-21, complexflag: int = 0, seed: int = 42, raiseerror: bool = True) -> bool:
    """Whether <A u, v> = <u, A^H v> for random u and v; real parts alone for operators that are R-linear."""
    rng = np.random.default_rng(seed)
    m, n = op.shape
    u, v = rng.normal(size=n), rng.normal(size=m)
    if complexflag in (1, 3):
        u = u + 1j * rng.normal(size=n)
    if complexflag in (2, 3):
        v = v + 1j * rng.normal(size=m)
    left, right = np.vdot(v, op.matvec(u)), np.vdot(op.rmatvec(v), u)
    left, right = (left, right) if op.clinear else (left.real, right.real)
    ok = bool(abs(left - right) <= max(rtol * max(abs(left), abs(right)), atol))
    if raiseerror and not ok:
        raise AttributeError(f"dot test of {op!r} failed: {left} and {right}")
    return ok


__all__ = [n for n, x in list(globals().items()) if not n.startswith("_") and (isinstance(x, type) or callable(x)) and getattr(x, "__module__", "") == __name__]
