"""Connected components as Spark jobs, and a union-find for what fits in a task."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.staging import drop, stage


def components(edges: DataFrame, few: int = 100_000) -> DataFrame:
    """(node, root) of the nodes in edges (a, b): root is the least node that they reach.

    Up to ``few`` distinct edges are joined in one task. Beyond, each round takes the least label among the neighbours and
    then the label of that label, so rounds grow with the logarithm of a chain's length. Labels are written after each
    round.
    """
    edges = stage(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    if edges.count() <= few:
        return edges.coalesce(1).mapInArrow(_joined, "node long, root long")
    both = stage(edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    drop(edges)
    labels = stage(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).withColumnRenamed("a", "node"))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("root").alias("far")), "b").groupBy(F.col("a").alias("node")).agg(F.min("far").alias("far"))
        low = labels.join(near, "node").select("node", F.col("root").alias("was"), F.least("root", "far").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("root").alias("further"))
        new = stage(low.join(jump, "next", "left").select("node", "was", F.least(F.col("next"), F.coalesce("further", "next")).alias("root")))
        changed = new.where("was <> root").limit(1).count()
        drop(labels)
        labels = new
        if not changed:
            drop(both)
            return labels.select("node", "root")


def _joined(batches):
    tables = [b for b in batches if b.num_rows]
    a, b = ([x for t in tables for x in t.column(c).to_pylist()] for c in "ab")
    names = sorted(set(a) | set(b))
    place = {x: i for i, x in enumerate(names)}
    union = Union(len(names))
    for x, y in zip(a, b, strict=True):
        union.join(place[x], place[y])
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array([names[union.find(i)] for i in range(len(names))], pa.int64())], names=["node", "root"])


class Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True
