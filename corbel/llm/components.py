"""Connected components by alternating large-star and small-star steps on an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corbel.workspace import Workspace

#: Edges that a task holds at a time when it replaces them by a spanning forest.
LOCAL_EDGES = 200_000


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each ``LOCAL_EDGES`` of a partition's edges: its nodes with the least node that those edges connect them to."""
    up: dict = {}
    held = 0

    def root(x):
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    def out() -> pa.RecordBatch:
        hi = [x for x in up if up[x] != x]
        return pa.RecordBatch.from_arrays([pa.array(hi, kind), pa.array([root(x) for x in hi], kind)], names=["hi", "lo"])

    for batch in batches:
        kind = batch.column("a").type
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                up[max(a, b)] = min(a, b)
        held += batch.num_rows
        if held >= LOCAL_EDGES:
            yield out()
            up, held = {}, 0
    if up:
        yield out()


def _open(edges: DataFrame) -> bool:
    """Whether a node has two lower ends, or is a lower and an upper one: a forest of stars has neither."""
    ends = edges.select(F.col("hi").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("lo").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return not ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or up > 0 and down > 0").isEmpty()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = edges.join(least, "hi").filter("lo > m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return least.select("hi", F.col("m").alias("lo")).unionByName(moved).distinct()


def connected_components(edges: DataFrame, ws: Workspace, name: str = "cc") -> DataFrame:
    """``edges(a, b)`` of longs or binaries -> ``(node, root)`` for every node on an edge; root is the least node.

    Edges with a null end and loops are ignored; repeated edges count once.  First each partition's edges are
    replaced by spanning stars, some at a time.  Then every step is two grouped minima with map-side combining and a
    join Spark may split, so a hub with a third of all edges is no single task's work.  The edges go through the shared
    folder after each round, until they are a forest of stars.
    """
    edges = edges.select("a", "b").filter("a is not null and b is not null and a <> b")
    kind = edges.schema["a"].dataType.simpleString()
    now, k = ws.save(edges.mapInArrow(_forests, f"hi {kind}, lo {kind}").distinct(), f"{name}-0"), 0
    while _open(now):
        k += 1
        nxt = ws.save(_small_star(_large_star(now)), f"{name}-{k}")
        ws.drop(f"{name}-{k - 1}")
        now = nxt
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(now.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
