"""Joins whose keys may be very uneven."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it has more than one in so many of all rows; so there are fewer hot keys than this.
MOST_HOT = 2000


def hot_keys(df: DataFrame, keys: list[str], most: int = MOST_HOT) -> DataFrame:
    """The keys that have more than one in ``most`` of the rows: ``most`` rows at most, counted with partial sums."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = df.count()
    return df.sparkSession.createDataFrame(counts.where(F.col("_n") > F.lit(total // most + 1)).select(*keys).toArrow())


def split_join(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", most: int = MOST_HOT, few: int = 20_000) -> DataFrame:
    """big joined with small, which has one row for each key, so that no key of big has to fit in a task.

    Up to ``few`` rows of small are broadcast. Beyond, rows of big with a hot key meet their row of small where they are
    read: there are ``most`` such keys at most, so that side is broadcast. The others are joined by their key. Rows of a
    null key find no partner. Both inputs should be written tables, or cheap: big is read three times.
    """
    if small.count() <= few:
        return big.join(F.broadcast(small), keys, how)
    hot = hot_keys(big, keys, most)
    if hot.isEmpty():
        return big.join(small, keys, how)
    hot_small = F.broadcast(small.join(F.broadcast(hot), keys, "left_semi"))
    hot_big = big.join(F.broadcast(hot), keys, "left_semi").join(hot_small, keys, how)
    return hot_big.unionByName(big.join(F.broadcast(hot), keys, "left_anti").join(small, keys, how))
