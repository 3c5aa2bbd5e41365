"""Vectors between the steps of a solver, written to the shared folder that ``spark.checkpoint.dir`` names.

A written vector cuts the lineage and survives the loss of executors. Only in local mode, where the folder may be unset, a
temporary folder of this process takes its place.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
#: Paths written and not yet deleted, in order.
written: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="lattica-"))
    return _own[0]


def write(df: DataFrame) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{folder(spark)}/lattica-vector-{uuid.uuid4().hex}"
    df.write.parquet(path)
    written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path), path


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def sweep(since: int, live: set[str]) -> None:
    """Delete what was written from place ``since`` on, but for the paths in ``live``."""
    for spark, path in written[since:]:
        if path not in live:
            delete(spark, path)
    written[since:] = [x for x in written[since:] if x[1] in live]


def forget(path: str) -> None:
    """Delete one of the tables written."""
    for x in [x for x in written if x[1] == path]:
        delete(*x)
        written.remove(x)


@atexit.register
def _forget() -> None:
    for spark, path in written:
        try:
            delete(spark, path)
        except Exception:  # the session has gone, and on a cluster so has its driver
            return
