"""Environment of a session, and how an operator's time depends on its parallelism."""

from __future__ import annotations

import platform
import time
from collections.abc import Sequence

import numpy as np

from lattica.operators.core import LinOp, session, vector


class Report:
    """Versions of what runs here, as text."""

    def __init__(self, more: Sequence[str] = ()):
        import importlib

        self.versions = {"python": platform.python_version(), "machine": platform.machine()}
        for name in ("pyspark", "pyarrow", "numpy", "pandas", *more):
            try:
                self.versions[name] = importlib.import_module(name).__version__
            except (ImportError, AttributeError):
                self.versions[name] = "not found"

    def __repr__(self) -> str:
        return "\n".join(f"{k:>10} : {v}" for k, v in self.versions.items())


def scalability_test(op: LinOp, x: np.ndarray, partitions: Sequence[int] = (1, 2, 4), forward: bool = True) -> tuple[list[float], list[float]]:
    """(seconds, speedups over the first) of one product for numbers of shuffle partitions."""
    spark = session()
    old = spark.conf.get("spark.sql.shuffle.partitions")
    frame, times = vector(spark, x), []
    try:
        for n in partitions:
            spark.conf.set("spark.sql.shuffle.partitions", n)
            start = time.time()
            (op.forward(frame) if forward else op.adjoint(frame)).write.format("noop").mode("overwrite").save()
            times.append(time.time() - start)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    return times, [times[0] / t for t in times]
