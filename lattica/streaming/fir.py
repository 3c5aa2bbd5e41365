"""Finite filters over streams: state for each key holds the last samples, and a window sums what falls into it."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def fir(events: DataFrame, key: str, order: str, value: str, h: Sequence[float]) -> DataFrame:
    """(key, order, y): y = sum of h[k] times the k-th last value of the key. Rows of one trigger are taken in order;
    values before the first are 0. The state is as long as the filter. The key is a string or an integer."""
    h = np.asarray(h, float)
    kind = lambda c: events.schema[c].dataType.simpleString()

    def step(k, batches, state: GroupState):
        past = np.array(state.get[0]) if state.exists else np.zeros(len(h) - 1)
        rows = pd.concat(list(batches)).sort_values(order)
        x = np.concatenate([past, rows[value].to_numpy(float)])
        y = np.convolve(x, h)[len(past) : len(past) + len(rows)]
        state.update((x[len(x) - len(past) :].tolist(),))
        yield pd.DataFrame({key: k[0], order: rows[order].to_numpy(), "y": y})

    return events.select(key, order, value).groupBy(key).applyInPandasWithState(step, f"{key} {kind(key)}, {order} {kind(order)}, y double", "past array<double>", "append", GroupStateTimeout.NoTimeout)


def windowed_sum(events: DataFrame, time: str, value: str, length: str, slide: str | None = None, late: str = "10 minutes", keys: Sequence[str] = ()) -> DataFrame:
    """Sum of the values in each time window and key; rows later than ``late`` behind the newest are left out."""
    w = F.window(time, length, slide) if slide else F.window(time, length)
    return events.withWatermark(time, late).groupBy(w.alias("window"), *keys).agg(F.sum(value).alias("y"))
