"""Connected components by alternating large and small stars, all in DataFrames.

Each task first unites its own edges, LOCAL at a time. Where LOCAL edges or fewer are left, one task unites
them; else rounds join the edges with the smallest neighbour of each node. The number of rounds is bounded by
the square of the logarithm of the number of nodes; groups that are stars already take none. Every round
is written to the shared folder, so lost executors cost one round.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import counted, cut

#: Edges that a task holds at once.
LOCAL = 1 << 18


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (u, v) as stars: every node but the smallest of its component, and that one."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    low = np.arange(len(nodes))
    while True:
        x, y = low[a], low[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(low, np.maximum(x, y), np.minimum(x, y))
        while (low[low] != low).any():
            low = low[low]
    moved = low != np.arange(len(nodes))
    return nodes[moved], nodes[low[moved]]


def united(edges: DataFrame) -> DataFrame:
    """edges(u, v) with those that a task has at hand, LOCAL at most, as stars. The components stay."""

    def run(batches):
        held, size = [], 0

        def stars():
            u, v = forest(*(np.concatenate(x) for x in zip(*held)))
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        for batch in batches:
            for i in range(0, batch.num_rows, LOCAL):
                part = batch.slice(i, LOCAL)
                if size + part.num_rows > LOCAL:
                    yield stars()
                    held, size = [], 0
                held.append(tuple(part.column(c).to_numpy() for c in ("u", "v")))
                size += part.num_rows
        if held:
            yield stars()

    return edges.mapInArrow(run, "u long, v long")


def _starred(e: DataFrame) -> bool:
    """Whether each node u of e(u, v) has one v that has no other edge of its own to a smaller node."""
    ends = e.select(F.col("u").alias("node"), F.lit(1).alias("up")).unionByName(e.select(F.col("v").alias("node"), F.lit(0).alias("up")))
    counts = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("low"))
    return not counts.where("ups > 1 or (ups = 1 and low = 0)").head(1)


def components(edges: DataFrame, a: str = "u", b: str = "v") -> DataFrame:
    """edges(a, b) of ids -> (node, comp): every node with an edge to another one, and the smallest id of its
    component."""
    e, n = counted(united(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v")), "components")
    if 0 < n <= LOCAL:
        e = cut(united(e.coalesce(1)), "components")
    elif n:
        e = cut(e.distinct(), "components")
    while n > LOCAL and not _starred(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut(large, "components")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        near = large.join(least, "u")
        small = near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        e = cut(small.distinct(), "components")
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
