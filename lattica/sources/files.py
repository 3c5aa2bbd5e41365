"""Arrays in files, as frames: .npy and .npz in, Parquet out."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_npy(spark: SparkSession, path: str) -> tuple[DataFrame, tuple[int, ...]]:
    """(vector frame, dims) of the .npy files at a path that Spark can list; each file is one array along a first axis of
    files, in order of their names, read where its task runs. All must have one shape; complex arrays give (k, re, im)."""
    files = spark.read.format("binaryFile").load(path)

    def heads(batches):
        import io

        for b in batches:
            names, shapes, kinds = [], [], []
            for name, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                x = np.load(io.BytesIO(content), allow_pickle=False)
                names.append(name)
                shapes.append(list(x.shape))
                kinds.append(bool(np.iscomplexobj(x)))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(shapes, pa.list_(pa.int64())), pa.array(kinds, pa.bool_())], names=["path", "shape", "complex"])

    def parse(batches):
        import io

        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                flat = np.ravel(np.load(io.BytesIO(content), allow_pickle=False))
                n = len(flat)
                yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array(np.arange(n)), pa.array(flat.real.astype(float)), pa.array(flat.imag.astype(float))], names=["path", "k", "re", "im"])

    known = files.select("path", "content").mapInArrow(heads, "path string, shape array<long>, complex boolean")
    shapes = known.groupBy("shape").agg(F.count(F.lit(1)).alias("n"), F.max("complex").alias("complex")).limit(2).collect()
    if len(shapes) != 1:
        raise ValueError("no .npy file, or files of different shapes")
    shape, count = tuple(shapes[0]["shape"]), shapes[0]["n"]
    n = int(np.prod(shape))
    order = files.select("path").withColumn("f", F.row_number().over(Window.orderBy("path")) - 1)
    rows = files.select("path", "content").mapInArrow(parse, "path string, k long, re double, im double").join(order, "path")
    key = (F.col("f").cast("long") * n + F.col("k")).alias("k")
    return rows.select(key, *(["re", "im"] if shapes[0]["complex"] else [F.col("re").alias("v")])), (count, *shape)


def write_grid(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
