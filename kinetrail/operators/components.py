"""Connected components of an edge table, entirely on DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.durable import forget, settle

MOST_ROUNDS = 60
#: Edges that one task may hold: some 16 MB. Rounds over files pay beyond that.
TASK_EDGES = 1 << 19


def _large_star(edges: DataFrame) -> DataFrame:
    """Link each node's larger neighbours to its smallest neighbour (itself included)."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link each node and its smaller neighbours to the smallest of them. edges: u > v."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    linked = edges.join(low, "u")
    rest = linked.filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.union(low.select("u", F.col("m").alias("v"))).distinct()


def roots_of(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All ends of the edges, and the smallest node each of them reaches: hooking and pointer jumping on arrays."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return nodes, nodes[root]
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(np.asarray(b.column(0)), np.asarray(b.column(1))) for b in batches]
    if held:
        nodes, root = roots_of(*(np.concatenate(x) for x in zip(*held)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(root)], ["node", "component"])


def connected_components(edges: DataFrame, u: str = "u", v: str = "v", task_edges: int | None = None) -> DataFrame:
    """(node, component) for every node with an edge to another; component is the smallest node of its component.

    Alternating large-star and small-star steps (Kiveris et al., 2014): O(log^2 n) rounds of joins on shuffled keys.
    Each round ends in shared files; the driver sees one row of counts a round, never edges or labels. As long as there
    are no more edges than a task may hold (`task_edges`, TASK_EDGES if not given), which is counted first, one task solves
    them in memory instead."""
    e = edges.select(F.greatest(u, v).cast("long").alias("u"), F.least(u, v).cast("long").alias("v")).filter("u <> v").distinct()
    e = settle(e, "components")
    if e.count() <= (TASK_EDGES if task_edges is None else task_edges):
        out = settle(e.coalesce(1).mapInArrow(_solve, "node long, component long"), "components")
        forget(e)
        return out
    before = None
    for _ in range(MOST_ROUNDS):
        now = settle(_small_star(_large_star(e)), "components")
        forget(e)
        e = now
        state = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before or state[0] == 0:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
