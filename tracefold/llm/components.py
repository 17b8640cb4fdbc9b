"""Connected components of a graph given as a table of links; nothing is collected."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefold.llm.common import written


def local_union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the links a task sees: each node is linked to the smallest node it reaches there.

    The links that come out join the same nodes. A forest is written out and begun anew whenever it is large.
    """
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while parent[top] != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    def out() -> pa.RecordBatch:
        pairs = [(x, r) for x in parent if (r := root(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["u", "v"])

    for batch in batches:
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
            parent.setdefault(u, u)
            parent.setdefault(v, v)
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > 500_000:
            yield out()
            parent.clear()
    yield out()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node, component``: the smallest node reachable, for every node of ``links`` (u, v long) that isn't its
    own component's smallest. Loops, repeated links and links with a null are without effect.

    Each round unites inside tasks, then gives every node the smallest of its neighbours (map-side minimum) and
    links the other neighbours to that one, until every node has one smaller neighbour only and that one has
    none: alternating large-star and small-star steps, whose number grows with the logarithm of the size.
    """
    now = written(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                  .mapInArrow(local_union, "u bigint, v bigint").distinct(), "links")
    for _ in range(most_rounds):
        # done if no node stands on both sides and none has two smaller neighbours
        tops = now.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("x"))
        chained = now.select(F.col("v").alias("u")).distinct().join(tops.select("u"), "u", "left_semi")
        if tops.filter("m <> x").isEmpty() and chained.isEmpty():
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        # large star: larger neighbours go to the smallest node around
        both = now.union(now.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: smaller neighbours and the node itself go to the smallest one
        large = large.filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m")).filter("u <> v"))
        now = written(small.mapInArrow(local_union, "u bigint, v bigint").distinct(), "links")
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
