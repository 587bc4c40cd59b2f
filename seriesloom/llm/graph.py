"""Connected components over an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, unstage

#: Edges that one task connects by itself; beyond, the rounds do.
ONE_TASK = 1 << 20


def _large_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # written first: a join of two shuffled sides can be split at a hub, one with an aggregate below it can't
    least = stage(both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m")), "least")
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), least


def _small_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = stage(down.groupBy("u").agg(F.min("v").alias("m")), "least")
    moved = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), least


def smallest_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All nodes of the edges, and the smallest node that each reaches: labels fall along edges and then jump to their own
    labels, until nothing changes."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for side in (a, b):
            np.minimum.at(new, label[side], low)
        while not np.array_equal(jumped := new[new], new):
            new = jumped
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new


def _in_one_task(edges: DataFrame) -> DataFrame:
    def run(batches):
        held = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches]
        if held:
            nodes, least = smallest_reachable(*(np.concatenate(x) for x in zip(*held)))
            for i in range(0, len(nodes), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(nodes[i : i + (1 << 16)]), pa.array(least[i : i + (1 << 16)])], names=["id", "component"])

    return edges.coalesce(1).mapInArrow(run, "id long, component long")


def components(edges: DataFrame, name: str = "components", one_task: int = ONE_TASK) -> DataFrame:
    """(id, component) for every node that stands in an edge (u, v): the smallest node it reaches.

    Up to `one_task` edges are connected in one task of bounded memory. More take rounds, each of which writes its edges to
    the shared folder, so a lost executor costs one round at most. A round only takes minima per node and joins them back,
    so no neighbour list is ever held in one place; the rounds grow with the logarithm of the longest path. No edges: an
    empty result.
    """
    now = stage(edges.select(F.least("u", "v").cast("long").alias("u"), F.greatest("u", "v").cast("long").alias("v")).filter("u <> v").distinct(), name)
    if now.count() <= one_task:
        return _in_one_task(now)
    mark = None
    while True:
        large, a = _large_star(now)
        large = stage(large, name)
        small, b = _small_star(large)
        new = stage(small, name)
        unstage(now, a, large, b)
        now = new
        here = tuple(now.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first())
        if here == mark:
            break
        mark = here
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
