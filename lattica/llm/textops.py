"""Vectorised word splitting and hashing over Arrow string columns, for the Arrow-batched operators."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64


def _bytes_but(*gaps: tuple[int, int]) -> np.ndarray:
    table = np.ones(256, bool)
    for low, high in gaps:
        table[low : high + 1] = False
    return table


#: Bytes of words [^\x20\x09-\x0D]+ in UTF-8.
WORDS = _bytes_but((0x20, 0x20), (0x09, 0x0D))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def raw(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offset of each row in them; null counts as empty."""
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = pc.fill_null(col, "")
    _, off, data = col.buffers()
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1]
    if data is None:
        return np.zeros(0, np.uint8), off - off[0]
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def tidy() -> None:
    """Give freed memory back to the system: a Python worker lives on between tasks, and would keep its peak."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


def pieces(batches: Iterator[pa.RecordBatch], text: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Rows in order, in batches of about ``most`` bytes of text: a longer text is a batch of its own."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        i, total, sizes = 0, 0, size.tolist()
        for j, n in enumerate(sizes):
            if j > i and total + n > most:
                yield batch.slice(i, j - i)
                i, total = j, 0
            total += n
        if len(sizes) > i:
            yield batch.slice(i, len(sizes) - i)
        tidy()


def spans(data: np.ndarray, off: np.ndarray, table: np.ndarray = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and where each row's words begin in them; no word crosses rows."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = table[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    before[off[:-1][off[:-1] < n]] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    last = off[1:] - 1
    after[last[last >= 0]] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U(27))
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


class Rolling:
    """Polynomial hash modulo 2**64 of any slice of a sequence, from prefix sums."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U)

    def __reduce__(self):
        return Rolling, (self.base,)  # without the tables, which grow again where they are needed

    def _grow(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            for name, b in (("up", self.base), ("down", self.inverse)):
                powers = np.full(size, b, U)
                powers[0] = 1
                setattr(self, name, np.cumprod(powers, dtype=U))

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Prefix sums of a sequence, from which of() takes slices."""
        n = len(values)
        self._grow(n + 1)
        out = np.zeros(n + 1, U)
        np.cumsum(values.astype(U, copy=False) * self.up[:n], out=out[1:])
        return out

    def of(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((sums[ends] - sums[starts]) * self.down[starts])

    def __call__(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return self.of(self.sums(values), starts, ends)


BYTES = Rolling(0x9E3779B97F4A7C15)
WINDOW = Rolling(0xD1342543DE82EF95)
WINDOW2 = Rolling(0xC2B2AE3D27D4EB4F)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return BYTES(data.astype(U) + U(1), starts, ends)


def windows(ptr: np.ndarray, k: int) -> np.ndarray:
    """Index of the first word of each window of k words; windows stay within a row."""
    n = int(ptr[-1])
    room = np.repeat(ptr[1:], np.diff(ptr)) - np.arange(n)
    return np.flatnonzero(room >= k)
