"""Signal-processing operators: convolutions, transforms, interpolation, Radon transforms, windows."""

from __future__ import annotations

from collections.abc import Sequence
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions.tapers import taper
from lattica.operators.basic import AxisMatrix, BlockDiag, Diagonal, OnAxis, Restriction, _Composite, relation_frame
from lattica.operators.core import LinOp, Relation, Stencil, Traces, as_dims, batch, complexed, coordinate, parts, position, size, strides, totalled


class LongConvolve1D(LinOp):
    """Convolution along an axis with a filter of many samples: y[i] = sum of h[k] x[i - k + offset].

    The axis is cut into blocks; a sample goes to the blocks that its filter reaches, and each block is convolved as a whole
    in Arrow batches. Rows grow by the filter's length over ``block``, not by its samples.
    """

    def __init__(self, dims, h, offset: int = 0, axis: int = -1, n_out: int | None = None, block: int = 4096):
        dims = as_dims(dims)
        self.axis, self.h, self.offset, self.block = axis % len(dims), np.asarray(h), offset, block
        self.n, self.n_out = dims[self.axis], dims[self.axis] if n_out is None else n_out
        super().__init__(dims, (*dims[: self.axis], self.n_out, *dims[self.axis + 1 :]), "Convolve1D")
        self.is_complex = np.iscomplexobj(self.h)

    def _run(self, df, dims, n, n_to, h, offset):
        if np.iscomplexobj(h):
            df = complexed(df)
        p, keys, size_, taps = parts(df), batch(df), self.block, len(h)
        stride = strides(dims)[self.axis]
        i = coordinate(F.col("k"), dims, self.axis)
        line = F.col("k") - i * F.lit(stride)
        outer = ((line - line % F.lit(stride)) / F.lit(stride * n)).cast("long")
        first = F.greatest(F.lit(0), F.floor((i - F.lit(offset)) / F.lit(size_)))
        last = F.least(F.lit((n_to - 1) // size_), F.floor((i + F.lit(taps - 1 - offset)) / F.lit(size_)))
        rows = df.select(*keys, (outer * F.lit(n_to * stride) + line % F.lit(stride)).alias("_to"), i.alias("_i"), first.alias("_f"), last.alias("_l"), *p).where("_f <= _l")
        rows = rows.withColumn("_b", F.explode(F.sequence("_f", "_l")))
        packed = rows.groupBy(*keys, "_to", "_b").agg(F.collect_list(F.struct("_i", *p)).alias("x"))

        def run(batches):
            for whole in batches:
                for at in range(0, whole.num_rows, 64):
                    b = whole.slice(at, 64)
                    k, values, lengths = [], [], []
                    for to, block, x in zip(b.column("_to").to_pylist(), b.column("_b").to_pylist(), b.column("x"), strict=True):
                        base = block * size_
                        samples = x.values
                        take = lambda c: samples.field(c).to_numpy(zero_copy_only=False)  # noqa: B023, E731
                        window = np.zeros(size_ + taps - 1, complex if "re" in p else float)
                        np.add.at(window, take("_i") - (base + offset - taps + 1), take("v") if "v" in p else take("re") + 1j * take("im"))
                        y = np.convolve(window, h, "valid")[: n_to - base]
                        k.append(to + (base + np.arange(len(y))) * stride)
                        values.append(y)
                        lengths.append(len(y))
                    row, y = pa.array(np.repeat(np.arange(b.num_rows), lengths)), np.concatenate(values)
                    cols = [b.column(c).take(row) for c in keys] + [pa.array(np.concatenate(k))] + [pa.array(np.ascontiguousarray(v)) for v in ((y.real, y.imag) if "re" in p else (y,))]
                    yield pa.RecordBatch.from_arrays(cols, names=[*keys, "k", *p])

        ddl = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keys), "k long", *(f"{c} double" for c in p)])
        return packed.mapInArrow(run, ddl)

    def _forward(self, df):
        return self._run(df, self.dims, self.n, self.n_out, self.h, self.offset)

    def _adjoint(self, df):
        return self._run(df, self.dimsd, self.n_out, self.n, np.conj(self.h[::-1]), len(self.h) - 1 - self.offset)


#: Filters of more samples are convolved block by block.
FEW_TAPS = 64


def Convolve1D(dims, h, offset: int = 0, axis: int = -1):  # noqa: N802
    """y[i] = sum of h[k] x[i - k + offset]: as long as x, or as h if that is longer."""
    h = np.asarray(h)
    n = as_dims(dims)[axis]
    if h.ndim != 1:
        raise ValueError("a filter of one axis is needed")
    if offset > len(h) - 1:
        raise ValueError(f"no sample {offset} in a filter of {len(h)}")
    m = max(n, len(h))
    if len(h) > FEW_TAPS:
        return LongConvolve1D(dims, h, offset, axis, m)
    return Stencil(dims, axis, [(offset - k, c, k - offset, n - 1 + k - offset) for k, c in enumerate(h.tolist())], m, "Convolve1D")


class ConvolveND(LinOp):
    """Convolution over several axes, as long as x; the offsets name the filter's sample at 0."""

    def __init__(self, dims, h, offset=None, axes=(-2, -1)):
        super().__init__(dims)
        h = np.asarray(h)
        self.axes = [a % len(self.dims) for a in axes]
        offset = [0] * len(axes) if offset is None else list(offset)
        if len(offset) != len(axes) or h.ndim != len(axes):
            raise ValueError("h, offset and axes must have as many dimensions")
        self.taps = [([int(i) - o for i, o in zip(at, offset, strict=True)], float(h[tuple(at)])) for at in np.argwhere(h != 0)]

    def _send(self, df, sign):
        at = [coordinate(F.col("k"), self.dims, a) for a in range(len(self.dims))]
        shift = F.explode(F.array(*[F.struct(*[F.lit(sign * d).alias(f"d{j}") for j, d in enumerate(off)], F.lit(c).alias("c")) for off, c in self.taps]))
        df = df.select(*batch(df), *[i.alias(f"_i{a}") for a, i in enumerate(at)], *parts(df), shift.alias("_t"))
        ok, new = F.lit(True), [F.col(f"_i{a}") for a in range(len(self.dims))]
        for j, a in enumerate(self.axes):
            new[a] = new[a] + F.col(f"_t.d{j}")
            ok &= new[a].between(0, self.dims[a] - 1)
        keys = [c for c in batch(df) if c not in {"_t", *(f"_i{a}" for a in range(len(self.dims)))}]
        return totalled(df.where(ok).select(*keys, position(new, self.dims).alias("k"), *[(F.col("_t.c") * F.col(p)).alias(p) for p in parts(df)]))

    def _forward(self, df):
        return self._send(df, 1)

    def _adjoint(self, df):
        return self._send(df, -1)


class Convolve2D(ConvolveND):
    def __init__(self, dims, h, offset=(0, 0), axes=(-2, -1)):
        super().__init__(dims, h, offset, axes)


def _neighbours(n: int, ih) -> list[tuple[int, int, float]]:
    """(i, j, w): filters j and weights of sample i, between centres ih that lie evenly; the ends keep the last filter."""
    ih = np.asarray(ih, float)
    step = ih[1] - ih[0] if len(ih) > 1 else 1.0
    if len(np.unique(np.diff(ih))) > 1:
        raise ValueError("the filters' centres aren't at equal distances")
    out = []
    for i in range(n):
        q = float((i - ih[0]) / step)
        j = int(np.floor(q))
        if j < 0:
            out.append((i, 0, 1.0))
        elif j >= len(ih) - 1:
            out.append((i, len(ih) - 1, 1.0))
        else:
            out += [(i, j, 1 - (q - j)), (i, j + 1, q - j)]
    return out


class _NonStationary(Relation):
    """y[i + t - centre] += h_i[t] x[i], where h_i lies between the filters of a bank with centres along each axis.

    The relation joins each axis's table of neighbours with the bank. ``inp`` given, the bank is the model instead.
    """

    def __init__(self, dims, hs, centres, inp=None, name=None):
        dims, centres = as_dims(dims), [np.asarray(c) for c in centres]
        m = len(centres)
        shape = tuple(np.shape(hs)) if inp is None else (*[len(c) for c in centres], *hs)
        taps = shape[m:]
        if any(t % 2 == 0 for t in taps):
            raise ValueError("filters hs must have odd length")
        if len(dims) != m:
            raise ValueError("one array of centres for each axis")

        def make(spark):
            rel = spark.range(size(dims)).withColumnRenamed("id", "p")
            bank = F.lit(0).cast("long")
            weight = F.lit(1.0)
            for a, c in enumerate(centres):
                near = spark.createDataFrame(_neighbours(dims[a], c), f"i{a} long, j{a} long, w{a} double")
                rel = rel.withColumn(f"i{a}", coordinate(F.col("p"), dims, a)).join(F.broadcast(near), f"i{a}")
                bank = bank * F.lit(len(c)) + F.col(f"j{a}")
                weight = weight * F.col(f"w{a}")
            rel = rel.select("p", *[f"i{a}" for a in range(m)], (bank * F.lit(size(taps))).alias("b"), weight.alias("w"))
            rel = rel.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(size(taps) - 1))))
            ok, to = F.lit(True), []
            for a in range(m):
                to.append(F.col(f"i{a}") + coordinate(F.col("t").cast("long"), taps, a) - F.lit(taps[a] // 2))
                ok &= to[a].between(0, dims[a] - 1)
            rel = rel.where(ok).select("p", (F.col("b") + F.col("t")).alias("f"), "w", position(to, dims).alias("r"))
            if inp is None:
                values = relation_frame(spark, np.arange(np.size(hs)), np.arange(np.size(hs)), np.ravel(hs)).select(F.col("r").alias("f"), F.col("a").alias("h"))
                return rel.join(F.broadcast(values), "f").select("r", F.col("p").alias("c"), (F.col("w") * F.col("h")).alias("a"))
            x = relation_frame(spark, np.arange(size(dims)), np.arange(size(dims)), np.ravel(inp)).select(F.col("r").alias("p"), F.col("a").alias("x"))
            return rel.join(x, "p").groupBy("r", F.col("f").alias("c")).agg(F.sum(F.col("w") * F.col("x")).alias("a"))

        super().__init__(dims if inp is None else shape, dims, make, name=name)


class NonStationaryConvolve1D(_Composite):
    def __init__(self, dims, hs, ih, axis: int = -1):
        dims = as_dims(dims)
        one = _NonStationary((dims[axis],), hs, [ih])
        super().__init__(one if len(dims) == 1 else OnAxis(one, dims, axis), "NonStationaryConvolve1D", dims, dims)


class NonStationaryConvolve2D(_NonStationary):
    def __init__(self, dims, hs, ihx, ihz):
        super().__init__(dims, hs, [ihx, ihz], name="NonStationaryConvolve2D")


class NonStationaryConvolve3D(_NonStationary):
    def __init__(self, dims, hs, ihx, ihy, ihz):
        super().__init__(dims, hs, [ihx, ihy, ihz], name="NonStationaryConvolve3D")


class NonStationaryFilters1D(_NonStationary):
    def __init__(self, inp, hsize: int, ih):
        super().__init__(np.shape(inp), (hsize,), [ih], inp, "NonStationaryFilters1D")


class NonStationaryFilters2D(_NonStationary):
    def __init__(self, inp, hshape, ihx, ihz):
        super().__init__(np.shape(inp), tuple(hshape), [ihx, ihz], inp, "NonStationaryFilters2D")


class FFT(Traces):
    """Fourier transform along an axis. norm is ortho, none or 1/n; a real one scales the bins that stand for two by the
    root of 2, so the adjoint is exact."""

    def __init__(self, dims, axis: int = -1, nfft: int | None = None, sampling: float = 1.0, norm: str = "ortho", real: bool = False, ifftshift_before: bool = False, fftshift_after: bool = False):
        n = as_dims(dims)[axis]
        nfft = nfft or n
        factor = {"ortho": nfft**-0.5, "none": 1.0, "1/n": 1.0 / nfft}[norm]
        if real and fftshift_after:
            raise ValueError("fftshift_after needs a complex transform")
        m = nfft // 2 + 1 if real else nfft
        twice = slice(1, 1 + (nfft - 1) // 2)

        def forward(x):
            x = np.fft.ifftshift(x, axes=-1) if ifftshift_before else x
            if real:
                y = np.fft.rfft(x.real, nfft, axis=-1) * factor
                y[:, twice] *= 2**0.5
            else:
                y = np.fft.fft(x, nfft, axis=-1) * factor
            return np.fft.fftshift(y, axes=-1) if fftshift_after else y

        def adjoint(y):
            y = np.fft.ifftshift(y, axes=-1) if fftshift_after else y.astype(complex)
            if real:
                y = y.copy()
                y[:, twice] /= 2**0.5
                x = np.fft.irfft(y, nfft, axis=-1) * nfft * factor
            else:
                x = np.fft.ifft(y, axis=-1) * nfft * factor
            x = x[:, :n] if nfft >= n else np.pad(x, ((0, 0), (0, n - nfft)))
            return np.fft.fftshift(x, axes=-1) if ifftshift_before else x

        super().__init__(dims, axis, m, forward, adjoint, True, not real, "FFT")
        self.clinear = not real
        self.nfft, self.real, self.factor, self.norm = nfft, real, factor, norm
        f = np.fft.rfftfreq(nfft, sampling) if real else np.fft.fftfreq(nfft, sampling)
        self.f = np.fft.fftshift(f) if fftshift_after else f

    def div(self, y, niter=100):
        """The exact inverse."""
        return self.rmatvec(np.ravel(y)) / (self.nfft * self.factor**2)


class FFTND(_Composite):
    """Transforms along several axes, the last one real if asked."""

    def __init__(self, dims, axes=(-3, -2, -1), nffts=None, sampling=1.0, norm="ortho", real=False, ifftshift_before=False, fftshift_after=False):
        dims = as_dims(dims)
        axes = [a % len(dims) for a in axes]
        each = lambda x, fill=None: list(x) if isinstance(x, (list, tuple, np.ndarray)) else [x if fill is None or x is not None else fill] * len(axes)
        nffts, sampling, before, after = each(nffts), each(sampling), each(ifftshift_before), each(fftshift_after)
        op, self.fs = None, [None] * len(axes)
        for j in reversed(range(len(axes))):
            one = FFT(dims if op is None else op.dimsd, axes[j], nffts[j], sampling[j], norm, real and j == len(axes) - 1, before[j], after[j] and not (real and j == len(axes) - 1))
            self.fs[j] = one.f
            op = one if op is None else one @ op
        super().__init__(op, "FFTND", dims)
        self._inverse = 1.0
        for f in self.fs:
            n = len(f) if not (real and f is self.fs[-1]) else (nffts[-1] or dims[axes[-1]])
            self._inverse *= {"ortho": 1.0, "none": n, "1/n": 1.0 / n}[norm]

    def div(self, y, niter=100):
        return self.rmatvec(np.ravel(y)) / self._inverse


class FFT2D(FFTND):
    def __init__(self, dims, axes=(-2, -1), nffts=None, sampling=1.0, norm="ortho", real=False, ifftshift_before=False, fftshift_after=False):
        if len(axes) != 2:
            raise ValueError(f"two axes are needed, not {len(axes)}")
        super().__init__(dims, axes, nffts, sampling, norm, real, ifftshift_before, fftshift_after)
        self.f1, self.f2 = self.fs


class Shift(_Composite):
    """Shift by a part of samples, the same for all lines or an array of one for each: F^H exp(-2 pi i f s) F."""

    def __init__(self, dims, shift, axis: int = -1, nfft: int | None = None, sampling: float = 1.0, real: bool = False):
        dims = as_dims(dims)
        axis %= len(dims)
        fft = FFT(dims, axis, nfft, sampling, real=real)
        if np.ndim(shift) == 0:
            d = Diagonal(np.exp(-2j * np.pi * fft.f * shift), fft.dimsd, axis)
        else:
            s = np.broadcast_to(np.expand_dims(np.asarray(shift), axis) if np.ndim(shift) < len(dims) else shift, (*dims[:axis], 1, *dims[axis + 1 :]))
            f = fft.f.reshape([-1 if a == axis else 1 for a in range(len(dims))])
            d = Diagonal(np.exp(-2j * np.pi * f * s))
        super().__init__(fft.H @ d @ fft, "Shift", dims, dims)


def dct_matrix(n: int, kind: int) -> np.ndarray:
    """Orthonormal cosine transform of type 1 to 4."""
    i, k = np.arange(n)[None, :], np.arange(n)[:, None]
    if kind == 1:
        w = np.where((np.arange(n) == 0) | (np.arange(n) == n - 1), 0.5**0.5, 1.0)
        return (2 / (n - 1)) ** 0.5 * np.outer(w, w) * np.cos(np.pi * i * k / (n - 1))
    if kind == 4:
        return (2 / n) ** 0.5 * np.cos(np.pi * (2 * i + 1) * (2 * k + 1) / (4 * n))
    if kind not in (2, 3):
        raise ValueError(f"there is no cosine transform of type {kind}, only 1 to 4")
    m = (2 / n) ** 0.5 * np.cos(np.pi * (2 * i + 1) * k / (2 * n))
    m[0] *= 0.5**0.5
    return m if kind == 2 else m.T


class DCT(_Composite):
    def __init__(self, dims, type: int = 2, axes=None):  # noqa: A002
        dims = as_dims(dims)
        axes = range(len(dims)) if axes is None else [axes] if np.isscalar(axes) else axes
        op = None
        for a in axes:
            m = dct_matrix(dims[a], type)
            one = Traces(dims, a, dims[a], lambda x, m=m: x @ m.T, lambda y, m=m: y @ m, False, None)
            op = one if op is None else one @ op
        super().__init__(op, "DCT")


def _groups(n: int) -> list[list[complex]]:
    """Roots inside the unit circle of the polynomial that makes n vanishing moments orthonormal, conjugates together."""
    out: list[list[complex]] = []
    for y in np.roots([comb(n - 1 + k, k) for k in reversed(range(n))]) if n > 1 else []:
        if y.imag < -1e-12:
            continue
        z = np.roots([1, -2 + 4 * y, 1])
        z = z[np.argmin(abs(z))]
        out.append([z, np.conj(z)] if y.imag > 1e-12 else [z.real])
    return out


def _scaling(n: int, roots) -> np.ndarray:
    h = np.real(np.poly([*roots, *[-1] * n]))
    return h / h.sum() * 2**0.5


def _bend(h: np.ndarray) -> float:
    """How far a filter's phase is from a straight line, where it passes."""
    w = np.linspace(0.02, np.pi * 0.75, 200)
    response = np.exp(-1j * np.outer(w, np.arange(len(h)))) @ h
    phase = np.unwrap(np.angle(response))
    slope = (w @ phase) / (w @ w)
    return float(np.sum(np.abs(response) ** 2 * (phase - slope * w) ** 2))


def wavelet_filters(wavelet: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(low, high, dual low, dual high): x is taken apart by the first two and put together by the others.

    haar and dbN have the roots of least phase, symN those whose phase is the straightest; biorA.B are splines of A vanishing
    moments for putting together and B for taking apart, rbioA.B the other way round.
    """
    family = wavelet.rstrip("0123456789.")
    order = wavelet[len(family) :]
    try:
        if wavelet == "haar" or family == "db" and 1 <= int(order) <= 16:
            n = 1 if wavelet == "haar" else int(order)
            low = _scaling(n, [z for g in _groups(n) for z in g])
        elif family == "sym" and 2 <= int(order) <= 12:
            n, groups = int(order), _groups(int(order))
            choices = [_scaling(n, [1 / z if pick >> k & 1 else z for k, g in enumerate(groups) for z in g]) for pick in range(1 << len(groups))]
            low = min(choices, key=lambda h: round(_bend(h), 9))
        elif family in ("bior", "rbio"):
            a, b = map(int, order.split("."))
            if (a + b) % 2 or not (1 <= a <= 3 and 1 <= b <= 9):
                raise ValueError
            spline = lambda m: np.array([comb(m, k) / 2**m for k in range(m + 1)])
            q, y = np.zeros(1), np.array([-0.25, 0.5, -0.25])
            power = np.ones(1)
            for k in range((a + b) // 2):  # the half-band polynomial in y = sin(w / 2) ** 2, centred
                q = np.pad(q, ((len(power) - len(q)) // 2,)) + comb((a + b) // 2 - 1 + k, k) * power
                power = np.convolve(power, y)
            low, dual = 2**0.5 * np.convolve(spline(b), q), 2**0.5 * spline(a)
            front = (len(low) - len(dual)) // 2
            dual = np.pad(dual, (front, len(low) - len(dual) - front))
            if len(low) % 2:  # an even length puts the high ones one sample on
                low, dual = np.pad(low, (0, 1)), np.pad(dual, (0, 1))
            if family == "rbio":
                low, dual = dual, low
            sign = (-1.0) ** np.arange(len(low))
            return low, dual[::-1] * sign, dual, low[::-1] * sign
        else:
            raise ValueError
    except ValueError:
        raise ValueError(f"'{wavelet}' is no wavelet here: haar, db1 to db16, sym2 to sym12, and biorA.B and rbioA.B with A up to 3 and B up to 9 are") from None
    high = low[::-1] * (-1.0) ** np.arange(len(low))
    return low, high, low, high


def wavelet_filter(wavelet: str) -> np.ndarray:
    return wavelet_filters(wavelet)[0]


class DWT(Traces):
    """Periodic wavelet transform along an axis, zeros appended up to a length that halves ``level`` times. Samples are the
    coarsest averages, then the details from coarse to fine. It is orthonormal but for biorthogonal wavelets, whose inverse()
    isn't the adjoint."""

    def __init__(self, dims, axis: int = -1, wavelet: str = "haar", level: int = 1):
        n = as_dims(dims)[axis]
        m = max(2 ** int(np.ceil(np.log2(n))), 2**level)
        low, high, dual_low, dual_high = wavelet_filters(wavelet)

        def forward(x):
            x = np.pad(x, ((0, 0), (0, m - n)))
            details = []
            for _ in range(level):
                half = x.shape[1] // 2
                at = (2 * np.arange(half)[:, None] + np.arange(len(low))[None, :]) % x.shape[1]
                details.append(x[:, at] @ high)
                x = x[:, at] @ low
            return np.concatenate([x, *reversed(details)], axis=1)

        def together(y, low, high):
            half = m >> level
            x = y[:, :half]
            for _ in range(level):
                d = y[:, half : 2 * half]
                at = (2 * np.arange(half)[:, None] + np.arange(len(low))[None, :]) % (2 * half)
                out = np.zeros((len(y), 2 * half), y.dtype)
                for t in range(len(low)):
                    np.add.at(out, (slice(None), at[:, t]), x * low[t] + d * high[t])
                x, half = out, 2 * half
            return x[:, :n]

        super().__init__(dims, axis, m, forward, lambda y: together(y, low, high), False, None, "DWT")
        self._inverse = Traces(self.dimsd, self.axis, n, lambda y: together(y, dual_low, dual_high), forward, False, None, "IDWT")

    def inverse(self, y):
        """What the transform was taken of."""
        return self._inverse.forward(y) if isinstance(y, DataFrame) else self._inverse.matvec(np.ravel(y))


class DWTND(_Composite):
    def __init__(self, dims, axes=(-3, -2, -1), wavelet: str = "haar", level: int = 1):
        dims = as_dims(dims)
        op = None
        for a in axes:
            one = DWT(dims if op is None else op.dimsd, a, wavelet, level)
            op = one if op is None else one @ op
        super().__init__(op, "DWTND")


class DWT2D(DWTND):
    def __init__(self, dims, axes=(-2, -1), wavelet: str = "haar", level: int = 1):
        super().__init__(dims, axes, wavelet, level)


def Interp(dims, iava, axis: int = -1, kind: str = "linear"):  # noqa: N802
    """(operator, positions): samples between those of an axis, by the nearest one, linearly, or by sinc functions."""
    dims, n = as_dims(dims), as_dims(dims)[axis]
    iava = np.asarray(iava, float)
    if kind == "nearest":
        iava = np.round(iava).astype(int)
    elif kind == "linear":
        iava = np.where(iava >= n - 1, n - 1 - 1e-10, iava)
    elif kind != "sinc":
        raise NotImplementedError(f"no interpolation is called {kind}: nearest, linear and sinc are known")
    if len(np.unique(iava)) != len(iava):
        raise ValueError("each position of iava may stand once")
    j = np.arange(len(iava))
    if kind == "nearest":
        return Restriction(dims, iava, axis), iava
    if kind == "linear":
        low = np.floor(iava).astype(int)
        w = iava - low
        return AxisMatrix(dims, axis, len(iava), (np.concatenate([j, j]), np.concatenate([low, low + 1]), np.concatenate([1 - w, w])), "Interp"), iava
    m = np.sinc(iava[:, None] - np.arange(n)[None, :])
    r, c = np.nonzero(m)
    return AxisMatrix(dims, axis, len(iava), (r, c, m[r, c]), "Interp"), iava


class Bilinear(Relation):
    """Values at points (2, n) of the first two axes, from the four samples around."""

    def __init__(self, iava, dims):
        dims, (a, b) = as_dims(dims), np.asarray(iava, float)
        if len(np.unique(np.stack([a, b]), axis=1).T) != len(a):
            raise ValueError("each position of iava may stand once")
        a, b = np.minimum(a, dims[0] - 1 - 1e-10), np.minimum(b, dims[1] - 1 - 1e-10)
        i, j = np.floor(a).astype(int), np.floor(b).astype(int)
        u, v = a - i, b - j
        n, rest = np.arange(len(a)), size(dims[2:]) if dims[2:] else 1
        corners = [(i, j, (1 - u) * (1 - v)), (i + 1, j, u * (1 - v)), (i, j + 1, (1 - u) * v), (i + 1, j + 1, u * v)]
        r, c, w = np.concatenate([n] * 4), np.concatenate([x * dims[1] + y for x, y, _ in corners]), np.concatenate([w for *_, w in corners])

        super().__init__(dims, (len(a), *dims[2:]), lambda spark: relation_frame(spark, r, c, w), name="Bilinear", inner=rest)


class Fredholm1(Relation):
    """y[s, i, z] = sum over j of G[s, i, j] x[s, j, z]. G is an array, or a frame (s, i, j, a[, ai]) with its shape."""

    def __init__(self, G, nz: int = 1, shape=None):  # noqa: N803
        array = None if shape else np.asarray(G)
        ns, nx, ny = shape or array.shape

        def make(spark):
            if array is not None:
                s, i, j = np.nonzero(array)
                return relation_frame(spark, s * nx + i, s * ny + j, array[s, i, j])
            rest = [c for c in G.columns if c in ("a", "ai")]
            return G.select((F.col("s") * nx + F.col("i")).cast("long").alias("r"), (F.col("s") * ny + F.col("j")).cast("long").alias("c"), *rest)

        one = nz == 1
        super().__init__((ns, ny) if one else (ns, ny, nz), (ns, nx) if one else (ns, nx, nz), make, "ai" in G.columns if array is None else np.iscomplexobj(array), "Fredholm1", nz)


def _unitless(axis: np.ndarray, centered: bool) -> tuple[np.ndarray, float]:
    step, n = abs(axis[1] - axis[0]), len(axis)
    return (np.arange(n) - n // 2 + ((n + 1) % 2) / 2 if centered else axis / step), step


class _Radon(Relation):
    """Sums along curves: y[h, floor(tau)] += x[p, t], with tau = curve(h, t, p) in samples; ``interp`` splits between two.

    The relation is computed by Spark from the axes, one row for each (p, t, h) that stays inside.
    """

    def __init__(self, nt: int, hs: Sequence[np.ndarray], ps: Sequence[np.ndarray], kind, interp: bool, name: str):
        nh, np_ = size([len(h) for h in hs]), size([len(p) for p in ps])

        def make(spark):
            rel = spark.range(np_ * nt * nh).select((F.col("id") % nh).alias("h"), ((F.col("id") - F.col("id") % nh) / nh).cast("long").alias("c"))
            t = (F.col("c") % nt).cast("double")
            ip = (F.col("c") - F.col("c") % nt) / nt
            x, p = [], []
            for into, axes, at in ((x, hs, F.col("h")), (p, ps, ip.cast("long"))):
                for a, values in enumerate(axes):
                    i = coordinate(at, [len(v) for v in axes], a)
                    into.append(F.element_at(F.array(*[F.lit(float(v)) for v in values]), (i + 1).cast("int")))
            if callable(kind):
                tau = kind(x if len(x) > 1 else x[0], t, p if len(p) > 1 else p[0])
            elif kind == "linear":
                tau = sum((a * b for a, b in zip(x, p, strict=True)), t)
            elif kind == "parabolic":
                tau = sum((a * a * b for a, b in zip(x, p, strict=True)), t)
            else:
                tau = F.sqrt(sum(((a / b) * (a / b) for a, b in zip(x, p, strict=True)), t * t))
            rel = rel.select("h", "c", tau.alias("tau")).where(F.col("tau").isNotNull() & ~F.isnan("tau") & (F.col("tau") >= 0) & (F.col("tau") < (nt - 1 if interp else nt)))
            low = F.floor("tau").cast("long")
            rel = rel.select("c", (F.col("h") * nt + low).alias("r"), (F.col("tau") - low).alias("d"))
            if not interp:
                return rel.select("r", "c", F.lit(1.0).alias("a"))
            return rel.select("c", F.explode(F.array(F.struct(F.col("r").alias("r"), (1 - F.col("d")).alias("a")), F.struct((F.col("r") + 1).alias("r"), F.col("d").alias("a")))).alias("x")).select("x.r", "c", "x.a")

        if not callable(kind) and kind not in ("linear", "parabolic", "hyperbolic"):
            raise NotImplementedError(f"{kind} is no curve: linear, parabolic, hyperbolic or a function are")
        super().__init__((np_, nt), (nh, nt), make, name=name)


class Radon2D(_Radon):
    def __init__(self, taxis, haxis, pxaxis, kind="linear", centeredh=True, interp=True):
        taxis, haxis, pxaxis = map(np.asarray, (taxis, haxis, pxaxis))
        h, dh = _unitless(haxis, centeredh)
        super().__init__(len(taxis), [h], [pxaxis * dh / abs(taxis[1] - taxis[0])], kind, interp, "Radon2D")


class Radon3D(_Radon):
    def __init__(self, taxis, hyaxis, hxaxis, pyaxis, pxaxis, kind="linear", centeredh=True, interp=True):
        taxis, pyaxis, pxaxis = map(np.asarray, (taxis, pyaxis, pxaxis))
        hy, dy = _unitless(np.asarray(hyaxis), centeredh)
        hx, dx = _unitless(np.asarray(hxaxis), centeredh)
        dt = abs(taxis[1] - taxis[0])
        super().__init__(len(taxis), [hy, hx], [pyaxis * dy / dt, pxaxis * dx / dt], kind, interp, "Radon3D")


class Phases(Relation):
    """y[r, f] = sum over c of exp(i phase(r, c, f)) x[c, f] for frequencies low <= f < high, 0 at the others."""

    def __init__(self, rows, cols, nf: int, phase, low: int = 0, high: int | None = None, name: str = "Phases"):
        n, m = size(as_dims(rows)), size(as_dims(cols))
        high = nf if high is None else high

        def make(spark):
            rel = spark.range(n * m * (high - low)).select((F.col("id") % (high - low) + low).alias("f"), ((F.col("id") - F.col("id") % (high - low)) / (high - low)).cast("long").alias("x"))
            rel = rel.select("f", ((F.col("x") - F.col("x") % m) / m).cast("long").alias("i"), (F.col("x") % m).alias("j"))
            a = phase(F.col("i"), F.col("j"), F.col("f"))
            return rel.select((F.col("i") * nf + F.col("f")).alias("r"), (F.col("j") * nf + F.col("f")).alias("c"), F.cos(a).alias("a"), F.sin(a).alias("ai"))

        super().__init__((*as_dims(cols), nf), (*as_dims(rows), nf), make, True, name)


def _values(x) -> object:
    """Column of an axis's value at an index column."""
    items = [float(v) for v in x]
    return lambda i: F.element_at(F.array(*[F.lit(v) for v in items]), (i + 1).cast("int"))


class FourierRadon2D(_Composite):
    """Radon transform in the frequency domain, exact between samples; parabolic for squared offsets."""

    def __init__(self, taxis, haxis, pxaxis, nfft: int, flims=None, kind="linear"):
        taxis, haxis = np.asarray(taxis), np.asarray(haxis, float)
        h = haxis**2 if kind == "parabolic" else haxis
        nt, dt = len(taxis), taxis[1] - taxis[0]
        fp = FFT((len(pxaxis), nt), -1, nfft, dt, real=True)
        fh = FFT((len(h), nt), -1, nfft, dt, real=True)
        low, high = flims or (0, nfft // 2 + 1)
        hv, pv, fv = _values(h), _values(pxaxis), _values(fp.f)
        op = fh.H @ Phases(len(h), len(pxaxis), len(fp.f), lambda i, j, f: F.lit(-2 * np.pi) * fv(f) * pv(j) * hv(i), low, high) @ fp
        super().__init__(op, "FourierRadon2D")


class FourierRadon3D(_Composite):
    def __init__(self, taxis, hyaxis, hxaxis, pyaxis, pxaxis, nfft: int, flims=None, kind=("linear", "linear")):
        kind = (kind, kind) if isinstance(kind, str) else kind
        hy, hx = (np.asarray(h, float) ** (2 if k == "parabolic" else 1) for h, k in zip((hyaxis, hxaxis), kind, strict=True))
        nt, dt = len(taxis), taxis[1] - taxis[0]
        np_, nh = len(pyaxis) * len(pxaxis), len(hy) * len(hx)
        fp, fh = FFT((np_, nt), -1, nfft, dt, real=True), FFT((nh, nt), -1, nfft, dt, real=True)
        low, high = flims or (0, nfft // 2 + 1)
        yv, xv, pyv, pxv, fv = map(_values, (hy, hx, pyaxis, pxaxis, fp.f))
        at = lambda k, n: ((k - k % n) / n).cast("long")
        phase = lambda i, j, f: F.lit(-2 * np.pi) * fv(f) * (pyv(at(j, len(pxaxis))) * yv(at(i, len(hx))) + pxv(j % len(pxaxis)) * xv(i % len(hx)))
        op = fh.H @ Phases(nh, np_, len(fp.f), phase, low, high) @ fp
        super().__init__(op, "FourierRadon3D", (len(pyaxis), len(pxaxis), nt), (len(hy), len(hx), nt))


class ChirpRadon2D(_Composite):
    """Linear Radon transform with as many slopes as traces, up to pmax; ``inverse`` filters by the frequency."""

    def __init__(self, taxis, haxis, pmax: float):
        nt, dt = len(taxis), abs(taxis[1] - taxis[0])
        nx, dx = len(haxis), abs(haxis[1] - haxis[0])
        self.fft = FFT((nx, nt), -1)
        omega = _values(np.fft.fftfreq(nt, dt))
        self.step, mid = 2 * dt * pmax / dx / nx * dx, (nx + 1) // 2
        self.kernel = Phases(nx, nx, nt, lambda i, j, f: F.lit(2 * np.pi * self.step) * omega(f) * (i - mid) * (j - mid))
        self.omega = np.fft.fftfreq(nt, dt)
        super().__init__((self.fft.H @ self.kernel @ self.fft).toreal(), "ChirpRadon2D")

    def inverse(self, y: np.ndarray) -> np.ndarray:
        filtered = self.fft.H @ Diagonal(np.abs(self.omega), self.fft.dimsd, -1) @ self.kernel.H @ self.fft
        return (filtered.matvec(np.ravel(y)).real * self.step).reshape(self.dims)


class ChirpRadon3D(_Composite):
    def __init__(self, taxis, hyaxis, hxaxis, pmax):
        nt, dt = len(taxis), abs(taxis[1] - taxis[0])
        ny, nx = len(hyaxis), len(hxaxis)
        sy, sx = 2 * dt * pmax[0] / ny, 2 * dt * pmax[1] / nx
        fft = FFT((ny * nx, nt), -1)
        omega = _values(np.fft.fftfreq(nt, dt))
        at = lambda k: ((k - k % nx) / nx).cast("long") - (ny + 1) // 2
        of = lambda k: k % nx - (nx + 1) // 2
        kernel = Phases(ny * nx, ny * nx, nt, lambda i, j, f: F.lit(2 * np.pi) * omega(f) * (F.lit(sy) * at(i) * at(j) + F.lit(sx) * of(i) * of(j)))
        super().__init__((fft.H @ kernel @ fft).toreal(), "ChirpRadon3D", (ny, nx, nt), (ny, nx, nt))


class Seislet(Traces):
    """Lifting along local slopes (nx, nt): odd traces less their prediction from even ones, even ones updated by half of
    what is left. One task works on one section, as the traces of a section predict each other."""

    def __init__(self, slopes, sampling=(1.0, 1.0), level: int | None = None, inv: bool = False):
        slopes = np.asarray(slopes, float)
        nx, nt = slopes.shape
        n = 2 ** int(np.ceil(np.log2(nx)))
        dx, dt = sampling
        steps = int(np.log2(n)) - 1 if level is None else level
        slopes = np.pad(slopes, ((0, n - nx), (0, 0)))
        t = np.arange(nt) * dt

        def move(trace, at, sign, back):
            m = np.sinc((t[None, :] - sign * dx * slopes[at][None, :] - t[:, None]) / dt)
            return trace @ (m.T if back else m)

        def predict(x, lev, sign, adj):
            """Each trace moved by 2**lev traces along the slopes, to the right (sign 1) or left."""
            hop, out = 2**lev, np.empty_like(x)
            for i in range(len(x)):
                first = 2 * i * hop + (0 if sign > 0 else hop)
                order = list(range(hop))
                trace = x[i]
                for s in reversed(order) if adj else order:
                    trace = move(trace, min(max(first + sign * s, 0), n - 1), sign, adj)
                out[i] = trace
            return out

        def forward(flat):
            out = []
            for x in flat.reshape(len(flat), nx, nt):
                x, parts_ = np.pad(x, ((0, n - nx), (0, 0))), []
                for lev in range(steps):
                    res = x[1::2] - predict(x[::2], lev, 1, False)
                    x = x[::2] + predict(res, lev, -1, False) / 2
                    parts_.append(res)
                out.append(np.concatenate([*parts_, x]).ravel())
            return np.array(out)

        def back(flat, exact):
            out = []
            for y in flat.reshape(len(flat), n, nt):
                sizes = [n >> (lev + 1) for lev in range(steps)]
                at = np.concatenate([[0], np.cumsum(sizes)])
                x = y[at[-1] :]
                for lev in reversed(range(steps)):
                    res = y[at[lev] : at[lev + 1]]
                    if exact:
                        even = x - predict(res, lev, -1, False) / 2
                        odd = res + predict(even, lev, 1, False)
                    else:
                        odd = res + predict(x, lev, -1, True) / 2
                        even = x - predict(odd, lev, 1, True)
                    x = np.empty((2 * len(even), nt))
                    x[::2], x[1::2] = even, odd
                out.append(x[:nx].ravel())
            return np.array(out)

        super().__init__(nx * nt, 0, n * nt, forward, lambda y: back(y, inv), False, False, "Seislet")
        self._back, self.inner = back, (n, nt)

    def inverse(self, y: np.ndarray) -> np.ndarray:
        return self._back(np.ravel(y)[None, :], True).ravel()


class Windows(LinOp):
    """Overlap-add: (windows of the first axes, samples in them, other axes) to the data, each window tapered.

    The taper is flat at the outer edges of the first and last window; samples past the last whole window have none.
    """

    def __init__(self, dimsd, nwin, nover, tapertype="hanning", scalings=None):
        dimsd = as_dims(dimsd)
        self.nwin, self.step = as_dims(nwin), [a - b for a, b in zip(as_dims(nwin), as_dims(nover), strict=True)]
        m = len(self.nwin)
        self.count = [(n - w) // s + 1 for n, w, s in zip(dimsd, self.nwin, self.step, strict=False)]
        if min(self.count) < 1:
            raise ValueError("the window is longer than the data")
        super().__init__((*self.count, *self.nwin, *dimsd[m:]), dimsd)
        self.tapers = []
        for w, o, n in zip(self.nwin, as_dims(nover), self.count, strict=True):
            one = taper(w, o, tapertype)
            rows = np.tile(one, (n, 1))
            if o:
                rows[0, :o] = 1
                rows[-1, -o:] = 1
            self.tapers.append(rows)
        self.scalings = None if scalings is None else np.ravel(scalings)

    def _weight(self, wins, at):
        out = F.lit(1.0)
        for rows, w, i, n in zip(self.tapers, wins, at, self.count, strict=True):
            kinds = F.when(w == 0, F.array(*[F.lit(float(x)) for x in rows[0]])).when(w == n - 1, F.array(*[F.lit(float(x)) for x in rows[-1]])).otherwise(F.array(*[F.lit(float(x)) for x in rows[min(1, n - 1)]]))
            out = out * F.element_at(kinds, (i + 1).cast("int"))
        if self.scalings is not None:
            out = out * F.element_at(F.array(*[F.lit(float(x)) for x in self.scalings]), (position(wins, self.count) + 1).cast("int"))
        return out

    def _forward(self, df):
        m = len(self.nwin)
        at = [coordinate(F.col("k"), self.dims, a) for a in range(len(self.dims))]
        wins, inner, rest = at[:m], at[m : 2 * m], at[2 * m :]
        to = position([w * s + i for w, s, i in zip(wins, self.step, inner, strict=True)] + rest, self.dimsd)
        weight = self._weight(wins, inner)
        return totalled(df.select(*batch(df), to.alias("k"), *[(weight * F.col(p)).alias(p) for p in parts(df)]))

    def _adjoint(self, df):
        m = len(self.nwin)
        keys, p = batch(df), parts(df)
        df = df.select(*keys, *p, *[coordinate(F.col("k"), self.dimsd, a).alias(f"_i{a}") for a in range(len(self.dimsd))])
        for a in range(m):
            low = F.greatest(F.lit(0), F.ceil((F.col(f"_i{a}") - F.lit(self.nwin[a] - 1)) / F.lit(self.step[a])))
            high = F.least(F.lit(self.count[a] - 1), F.floor(F.col(f"_i{a}") / F.lit(self.step[a])))
            df = df.where(low <= high).withColumn(f"_w{a}", F.explode(F.sequence(low.cast("long"), high.cast("long"))))
        wins = [F.col(f"_w{a}") for a in range(m)]
        inner = [F.col(f"_i{a}") - w * s for a, (w, s) in enumerate(zip(wins, self.step, strict=True))]
        rest = [F.col(f"_i{a}") for a in range(m, len(self.dimsd))]
        weight = self._weight(wins, inner)
        return df.select(*keys, position([*wins, *inner, *rest], self.dims).alias("k"), *[(weight * F.col(x)).alias(x) for x in p])


class _Sliding(_Composite):
    def __init__(self, Op, dims, dimsd, nwin, nover, tapertype, name, scalings=None):  # noqa: N803
        windows = Windows(dimsd, nwin, nover, tapertype, scalings)
        n = size(windows.count)
        if Op.shape[0] * n != windows.shape[1]:
            raise ValueError(f"the operator gives {Op.shape[0]} samples and a window has {windows.shape[1] // n}")
        op = windows @ BlockDiag([Op] * n)
        if dims is not None and size(as_dims(dims)) != op.shape[1]:
            raise ValueError(f"dims must have {op.shape[1]} elements: {n} windows of the operator's model")
        super().__init__(op, name, (*windows.count, *Op.dims), windows.dimsd)


class Sliding1D(_Sliding):
    def __init__(self, Op, dim, dimd, nwin, nover, tapertype="hanning"):  # noqa: N803
        super().__init__(Op, dim, dimd, nwin, nover, tapertype, "Sliding1D")


class Sliding2D(_Sliding):
    def __init__(self, Op, dims, dimsd, nwin, nover, tapertype="hanning"):  # noqa: N803
        super().__init__(Op, dims, dimsd, nwin, nover, tapertype, "Sliding2D")


class Sliding3D(_Sliding):
    def __init__(self, Op, dims, dimsd, nwin, nover, nop=None, tapertype="hanning"):  # noqa: N803
        super().__init__(Op, dims, dimsd, nwin, nover, tapertype, "Sliding3D")


class Patch2D(_Sliding):
    def __init__(self, Op, dims, dimsd, nwin, nover, nop=None, tapertype="hanning", scalings=None):  # noqa: N803
        super().__init__(Op, dims, dimsd, nwin, nover, tapertype, "Patch2D", scalings)


class Patch3D(_Sliding):
    def __init__(self, Op, dims, dimsd, nwin, nover, nop=None, tapertype="hanning", scalings=None):  # noqa: N803
        super().__init__(Op, dims, dimsd, nwin, nover, tapertype, "Patch3D", scalings)


def window_design(dimsd, nwin, nover, nop):
    """(numbers of windows, dims of the model, first samples, ends) of windows over the first axes of dimsd."""
    dimsd, nwin, nover, nop = map(as_dims, (dimsd, nwin, nover, nop))
    starts = [np.arange(0, n - w + 1, w - o) for n, w, o in zip(dimsd, nwin, nover, strict=False)]
    counts = tuple(len(s) for s in starts)
    dims = tuple(c * p for c, p in zip(counts, nop, strict=False)) + tuple(nop[len(counts) :])
    return counts, dims, starts, [s + w for s, w in zip(starts, nwin, strict=True)]


sliding1d_design = sliding2d_design = sliding3d_design = patch2d_design = patch3d_design = window_design

__all__ = [n for n in list(globals()) if n[0].isupper() or n.endswith("_design")]

