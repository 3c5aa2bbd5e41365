"""Tables written between steps, in the shared folder that ``spark.checkpoint.dir`` names.

A written table cuts the lineage and survives the loss of any executor. The folder is read from the session; only in
local mode (tests, notebooks), where it may be unset, a temporary folder of this process takes its place.
"""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if "dir" not in _own:
        _own["dir"] = "file://" + tempfile.mkdtemp(prefix="lattica-")
    return _own["dir"]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def stage(df: DataFrame) -> DataFrame:
    """Write df, and return the written table. Shuffle files that only df needed become free to go."""
    spark = df.sparkSession
    path = f"{folder(spark)}/lattica-stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_forget, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lattica_path = path
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return out


def drop(df: DataFrame) -> None:
    """Delete a staged table that nothing reads any more."""
    path = getattr(df, "_lattica_path", None)
    if path:
        _delete(df.sparkSession, path)


def _forget(spark: SparkSession, path: str) -> None:
    try:
        _delete(spark, path)
    except Exception:  # the session has gone, and on a cluster so has its driver
        pass


class Shared:
    """A value of bounded size for all executors, with its class, so that they need not have the package."""

    def __init__(self, spark: SparkSession, value):
        self.data = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    def get(self):
        return cloudpickle.loads(self.data.value)
