"""Connected components of a distributed graph by alternating large and small stars.

Edges are first thinned to a forest within each partition. Then every round links each
node's larger neighbours to its smallest one, and its smaller neighbours to the smallest
of them, until nothing changes; the number of rounds grows with the logarithm of the
graph's size. Each round is written to the shared folder, so lineage stays short and a
lost executor costs one round. No node's edges meet in one task: minima are aggregated
before the shuffle, and the joins may be split where a node is hot.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netweave.llm.common import discard, saved

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (larger, smallest of its tree) of a partition's forest."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                up[max(a, b)] = min(a, b)
                up.setdefault(min(a, b), min(a, b))
    nodes = [x for x in up if root(x) != x]
    for low in range(0, len(nodes), 50_000):
        part = nodes[low:low + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([root(x) for x in part], pa.int64())], ["u", "v"])


def _round(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    up = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    lows = up.groupBy("u").agg(F.min("v").alias("m"))
    down = up.join(lows, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return down.unionByName(lows.withColumnRenamed("m", "v")).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % F.lit(1 << 31))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, comp (the smallest node of its component) for every node that has an edge.

    ``a`` and ``b`` are long and not null; loops and repeated edges are allowed.
    """
    spark = edges.sparkSession
    pairs = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    now, path = saved(pairs.mapInArrow(_forest, "u long, v long"), "edges")
    before = _state(now)
    while before[0]:
        following, place = saved(_round(now), "edges")
        state = _state(following)
        discard(spark, path)
        now, path = following, place
        if state == before:
            break
        before = state
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(roots)
