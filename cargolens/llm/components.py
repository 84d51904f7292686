"""Connected components of a large, sparse graph, as rounds of Spark joins.

Each round every node hooks to the neighbour (or itself) of least random
priority, follows that hook once more, and the edges move to the nodes
reached; edges inside one node vanish. About half of the nodes that still have
edges go in a round, so the rounds grow with the logarithm of the number of
edges; the last few edges are joined by one task. Every round's frames are cut into
the shared checkpoint folder, and the joins stand between two plain shuffles, so
adaptive execution splits a node that has a large share of the edges. Roots are
looked up from the last round to the first, one join at a time: a plan with a join
for every round would have the tasks of all of them on the driver at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Edges that one task joins; a round of Spark jobs takes the driver the same room and time however few there are.
FEW_EDGES = 16_384


def _tidy(edges: DataFrame) -> DataFrame:
    """One row for each pair of different nodes."""
    return (edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
            .distinct())


def _hooks(edges: DataFrame, round_no: int) -> DataFrame:
    """(node, hook): the least of a node and its neighbours by a priority of this round."""
    def ranked(c: str) -> Column:
        return F.struct(F.xxhash64(c, F.lit(round_no)).alias("priority"), F.col(c).alias("node"))

    near = edges.select("u", "v").union(edges.select("v", "u"))
    return near.groupBy(F.col("u").alias("node")).agg(F.min(ranked("v")).alias("best")).select(
        "node", F.least("best", ranked("node")).getField("node").alias("hook"))


def _join_few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of the edges of one task; the root is the component's smallest node."""
    parent: dict[int, int] = {}

    def find(a: int) -> int:
        while parent.setdefault(a, a) != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for batch in batches:
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist()):
            ru, rv = find(u), find(v)
            parent[max(ru, rv)] = min(ru, rv)
    yield pa.record_batch({"node": pa.array(list(parent), pa.int64()), "root": pa.array([find(a) for a in parent], pa.int64())})


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v: long).

    Nodes share a root exactly if a path of edges joins them. Loops, repeated
    and reversed edges change nothing; rows with a null end are no edges. No
    edges give an empty frame.
    """
    edges = cut(_tidy(edges.where("u is not null and v is not null").select("u", "v")))
    steps = []
    while edges.count() > FEW_EDGES:
        hooks = cut(_hooks(edges, len(steps)))
        onward = hooks.select(F.col("node").alias("hook"), F.col("hook").alias("to"))
        moved = cut(hooks.join(onward, "hook").select("node", "to"))
        steps.append(moved)
        left = moved.select(F.col("node").alias("u"), F.col("to").alias("tu"))
        right = moved.select(F.col("node").alias("v"), F.col("to").alias("tv"))
        edges = cut(_tidy(edges.join(left, "u").join(right, "v")
                          .select(F.col("tu").alias("u"), F.col("tv").alias("v"))))
    roots = edges.coalesce(1).mapInArrow(_join_few, "node long, root long")
    while steps:
        further = cut(roots).withColumnRenamed("node", "to")
        roots = steps.pop().join(further, "to", "left").select("node", F.coalesce("root", "to").alias("root"))
    return roots
