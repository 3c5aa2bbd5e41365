"""Bitmaps of bounded size that let most rows skip a join; what they let through by mistake, a join removes later."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def slot(hash_: Column, bits: int) -> Column:
    return F.pmod(hash_, F.lit(bits))


def bitmap(df: DataFrame, hash_: Column, n: int, most: int = 1 << 27) -> np.ndarray:
    """Words of 64 bits with the slots of the hashes set; 16 bits for each of n hashes, but ``most`` bits at most."""
    bits = 1 << 16
    while bits < 16 * n and bits < most:
        bits <<= 1
    rows = df.select(slot(hash_, bits).alias("s")).groupBy(F.expr("s div 64").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(s % 64 as int)))").alias("b")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[rows.column("w").to_numpy()] = rows.column("b").to_numpy()
    return out


def inside(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each signed hash is in the bitmap."""
    s = hashes.astype(np.int64, copy=False) & np.int64(len(words) * 64 - 1)
    return (words[s >> 6] >> (s & 63)) & 1 == 1
