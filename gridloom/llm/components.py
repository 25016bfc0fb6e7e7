"""Connected components: one task's union-find while the edges are few, beyond that large-star and small-star steps in DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


#: Edges (counted first) that one task may join: 16 MB of them.
FEW = 1 << 20


def _union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    up: dict[int, int] = {}

    def top(x: int) -> int:
        path = []
        while (y := up.setdefault(x, x)) != x:
            path.append(x)
            x = y
        for y in path:
            up[y] = x
        return x

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            x, y = top(u), top(v)
            if x != y:
                up[max(x, y)] = min(x, y)
    v = np.array(list(up), np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(np.array([top(x) for x in v.tolist()], np.int64))], ["v", "c"])


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """edges (a long, b long) -> (v, c): for each vertex of an edge, the smallest vertex it is connected with.

    Beyond FEW edges, each step is two joins and a distinct over the edges; a vertex of any degree is only ever a key of an aggregation with
    partial sums or of a join that Spark may split. Edges shrink to stars about the smallest vertex of each component, then the loop ends.
    """
    now = scratch.save(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    if now.count() <= FEW:
        return now.coalesce(1).mapInArrow(_union, "v long, c long")
    while not _stars(now):
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.save(large, "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = scratch.save(small.unionAll(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        scratch.drop(now, large)
        now = new
    return now.select(F.col("u").alias("v"), F.col("v").alias("c")).unionAll(now.select("v", F.col("v").alias("c")).distinct())


def _stars(edges: DataFrame) -> bool:
    """Whether each vertex has one smaller neighbour at most, and none that has one itself."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1").isEmpty()
