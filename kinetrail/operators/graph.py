"""Graphs of particles: degrees, components, distances, contacts, chains and polymer architecture.

Nodes are a table with a `node` column, edges a table with u and v; undirected, several edges of a pair count once
where it says adjacency."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import Box, distance_squared, to_fractional, wrap
from ..plans.durable import forget, settle
from .components import TASK_EDGES, connected_components


def adjacency(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, once; edges of a node with itself are dropped."""
    e = edges.select("u", "v").filter("u <> v")
    return e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node and degree, 0 for isolated nodes."""
    counted = adjacency(edges).groupBy(F.col("u").alias("node")).agg(F.count("*").alias("degree"))
    return nodes.select("node").join(counted, "node", "left").select("node", F.coalesce("degree", F.lit(0)).alias("degree"))


def components(nodes: DataFrame, edges: DataFrame, task_edges: int | None = None) -> DataFrame:
    """node and component, numbered 0.. by their smallest node; isolated nodes are components."""
    stray = edges.select(F.explode(F.array("u", "v")).alias("node")).join(nodes, "node", "left_anti")
    if not stray.isEmpty():
        raise ValueError("an edge has an end that is no node")
    roots = nodes.select("node").join(connected_components(edges, task_edges=task_edges), "node", "left").select("node", F.coalesce("component", "node").alias("root"))
    roots = settle(roots, "roots")
    # Numbers of the distinct roots: each range is numbered apart and moved by the counts before it.
    from ..functions.stats import numbered_globally

    numbers = numbered_globally(roots.select("root").distinct(), ["root"], "component")
    return roots.join(numbers, "root").select("node", F.col("component").cast("long").alias("component"))


def derived_molecules(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return components(nodes, edges).select("node", (F.col("component") + 1).alias("mol"))


def component_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("component").agg(F.count("*").alias("size"))


def size_histogram(labels: DataFrame) -> DataFrame:
    return component_sizes(labels).groupBy("size").agg(F.count("*").alias("count"))


def cluster_moments(labels: DataFrame) -> DataFrame:
    """m0..m3 of component sizes and the weight-average size m2/m1 (0 without nodes)."""
    s = F.col("size").cast("double")
    m = [F.coalesce(F.sum(x), F.lit(0.0)) for x in (F.lit(1.0), s, s * s, s * s * s)]
    out = component_sizes(labels).agg(*(c.alias(f"m{k}") for k, c in enumerate(m)))
    return out.withColumn("weight_average", F.when(F.col("m1") > 0, F.col("m2") / F.col("m1")).otherwise(0.0))


def degree_distribution(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return degrees(nodes, edges).groupBy("degree").agg(F.count("*").alias("count"))


def summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """vertices, edges, components, ends, branches and cycle rank E - V + C."""
    d = degrees(nodes, edges).agg(F.count("*").alias("vertices"), F.sum(F.col("degree")).alias("twice"), F.sum((F.col("degree") == 1).cast("long")).alias("ends"), F.sum((F.col("degree") >= 3).cast("long")).alias("branches"))
    c = components(nodes, edges).agg(F.countDistinct("component").alias("components"))
    # Two frames of one row each.
    return d.join(c, F.lit(True)).select("vertices", F.expr("twice div 2").alias("edges"), "components", "ends", "branches", (F.expr("twice div 2") - F.col("vertices") + F.col("components")).alias("cycle_rank"))


def _hops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Breadth first over rows (u, v) of an adjacency; a row without v is a source."""
    held = [(np.asarray(b.column(0)), np.asarray(pc.fill_null(b.column(1), 0)), np.asarray(pc.is_null(b.column(1)))) for b in batches]
    if not held:
        return
    u, v, start = (np.concatenate(x) for x in zip(*held))
    nodes, at = np.unique(np.concatenate([u, v[~start]]), return_inverse=True)
    tail, head = at[: len(u)][~start], at[len(u) :]
    hops = np.full(len(nodes), -1, np.int64)
    hops[at[: len(u)][start]] = 0
    reached = 0
    while True:
        new = head[(hops[tail] == reached) & (hops[head] < 0)]
        if not len(new):
            break
        reached += 1
        hops[new] = reached
    seen = hops >= 0
    yield pa.RecordBatch.from_arrays([pa.array(nodes[seen]), pa.array(hops[seen])], ["node", "hops"])


def distances(nodes: DataFrame, edges: DataFrame, sources: DataFrame, task_edges: int | None = None) -> DataFrame:
    """node and hops from the nearest source, -1 where none reaches.

    A round of the loop joins the last frontier only. An adjacency that a task may hold, counted first, is walked there."""
    adj = settle(adjacency(edges), "adjacency")
    first = settle(sources.select("node").distinct(), "sources")
    if adj.count() + first.count() <= 2 * (TASK_EDGES if task_edges is None else task_edges):
        rows = adj.select(F.col("u").cast("long"), F.col("v").cast("long")).union(first.select(F.col("node").cast("long"), F.lit(None).cast("long")))
        seen = settle(rows.coalesce(1).mapInArrow(_hops, "node long, hops long"), "seen")
        forget(adj, first)
        return nodes.select("node").join(seen, "node", "left").select("node", F.coalesce("hops", F.lit(-1)).alias("hops"))
    seen = settle(first.withColumn("hops", F.lit(0).cast("long")), "seen")
    frontier, hops = seen, 0
    while True:
        hops += 1
        new = frontier.select(F.col("node").alias("u")).join(adj, "u").select(F.col("v").alias("node")).distinct().join(seen, "node", "left_anti")
        frontier = settle(new.withColumn("hops", F.lit(hops).cast("long")), "frontier")
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
        if hops % 8 == 0:
            seen = settle(seen, "seen")
    return nodes.select("node").join(seen, "node", "left").select("node", F.coalesce("hops", F.lit(-1)).alias("hops"))


def distance_bins(hops: DataFrame, values: DataFrame) -> DataFrame:
    """Per hop count: count, sum and sum of squares of node values; unreachable nodes are left out."""
    x = F.col("value")
    return hops.filter("hops >= 0").join(values, "node").groupBy("hops").agg(F.count("*").alias("count"), F.sum(x).alias("sum"), F.sum(x * x).alias("sumsq"))


def spanning(labels: DataFrame, positions: DataFrame, box: Box, eps: float = 1e-6) -> DataFrame:
    """Per component: whether its wrapped cell coordinates reach both faces of each axis, within eps."""
    eps = max(0.0, eps)
    inside = [v - F.floor(v) for v in to_fractional(box, F.col("x"), F.col("y"), F.col("z"))]
    rows = labels.join(positions, "node").select("component", *(c.alias(a) for c, a in zip(inside, "abc")))
    return rows.groupBy("component").agg(*(((F.min(a) <= eps) & (F.max(a) >= 1 - eps)).alias(f"spans_{n}") for a, n in zip("abc", "xyz")))


def filter_bonds(bonds: DataFrame, types: list[int] | None = None, members: DataFrame | None = None) -> DataFrame:
    """Edges of the given bond types with both ends among the members (node)."""
    out = bonds if types is None else bonds.filter(F.col("type").isin(types))
    if members is not None:
        for end in ("u", "v"):
            out = out.join(members.select(F.col("node").alias(end)), end, "left_semi")
    return out


#: Points of a cell that one block holds.
CELL_BLOCK = 1024


def contacts(points: DataFrame, cutoff: float, box: Box | None = None, include_self: bool = False) -> DataFrame:
    """Pairs u < v within the cutoff. A cell list: points are hashed to cells no smaller than the cutoff, and each cell
    meets itself and the half of its neighbours that lies ahead by an equality join, so far points never meet and a pair
    is found once.

    A cell of more than CELL_BLOCK points is dealt into blocks, and what meets it is copied to each of them, so a cell that
    holds all points is joined by as many tasks as it has blocks. With a box, distances are minimum images and cells
    wrap; where an axis holds fewer than three cells, it is one cell."""
    if cutoff < 0:
        raise ValueError("a cutoff is not negative")
    cols = {c: F.col(c) for c in "xyz"}
    if box is None:
        size = cutoff if cutoff > 0 else 1.0
        cell = [F.floor(cols[c] / size).cast("long") for c in "xyz"]
        counts = [0, 0, 0]
    else:
        p = wrap(box, *cols.values())
        lx, ly, lz = box.edges
        # Heights of the cell perpendicular to its faces.
        heights = (lx / (1 + (box.xy / ly) ** 2 + ((box.xy * box.yz / ly - box.xz) / lz) ** 2) ** 0.5, ly / (1 + (box.yz / lz) ** 2) ** 0.5, lz)
        counts = [n if (n := int(h / cutoff) if cutoff > 0 else 1) >= 3 else 1 for h in heights]
        inside = [v - F.floor(v) for v in to_fractional(box, *p)]
        cell = [F.least(F.floor(v * n), F.lit(n - 1)).cast("long") for v, n in zip(inside, counts)]
    placed = points.select("node", "x", "y", "z", *(c.alias(f"c{k}") for k, c in enumerate(cell)))
    reach = [(-1, 0, 1) if n != 1 else (0,) for n in counts]
    ahead = [d for d in itertools.product(*reach) if d >= (0, 0, 0)]
    near = lambda k: F.pmod(F.col(f"c{k}") + F.col("d")[k], F.lit(counts[k])) if counts[k] else F.col(f"c{k}") + F.col("d")[k]
    # Cells that are dealt into blocks: at most one for each CELL_BLOCK points.
    heavy = placed.groupBy("c0", "c1", "c2").agg(F.count("*").alias("n")).filter(F.col("n") > CELL_BLOCK).select("c0", "c1", "c2", F.ceil(F.col("n") / CELL_BLOCK).alias("m"))
    blocks = F.coalesce("m", F.lit(1))
    left = placed.withColumn("d", F.explode(F.array(*(F.array(*(F.lit(x) for x in d)) for d in ahead))))
    left = left.select(F.col("node").alias("u"), *(F.col(c).alias(f"u{c}") for c in "xyz"), (F.array_max("d") == 0).alias("flat"), (F.array_min("d") == 0).alias("up"), *(near(k).cast("long").alias(f"c{k}") for k in range(3)))
    left = left.join(heavy, ["c0", "c1", "c2"], "left").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))).drop("m")
    right = placed.join(heavy, ["c0", "c1", "c2"], "left").select(F.col("node").alias("v"), *(F.col(c).alias(f"v{c}") for c in "xyz"), "c0", "c1", "c2", F.pmod(F.xxhash64("node"), blocks).alias("block"))
    # Within a cell a pair is met from both its points.
    met = left.join(right, ["c0", "c1", "c2", "block"]).filter(~(F.col("flat") & F.col("up")) | (F.col("u") < F.col("v")))
    one, two = tuple(F.col(f"u{c}") for c in "xyz"), tuple(F.col(f"v{c}") for c in "xyz")
    if box is None:
        d = [a - b for a, b in zip(one, two)]
        square: Column = d[0] * d[0] + d[1] * d[1] + d[2] * d[2]
    else:
        square = distance_squared(box, one, two)
    out = met.filter(square <= cutoff * cutoff).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    return out.union(points.select(F.col("node").alias("u"), F.col("node").alias("v"))) if include_self else out


def polymer_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per component: size, edges, ends, branch points, cycle rank and architecture tag."""
    labels = settle(components(nodes, edges), "labels")
    rows = labels.join(degrees(nodes, edges), "node").groupBy("component").agg(F.count("*").alias("size"), F.expr("sum(degree) div 2").alias("edges"), F.sum((F.col("degree") == 1).cast("long")).alias("ends"), F.sum((F.col("degree") >= 3).cast("long")).alias("branches"))
    rows = rows.withColumn("cycle_rank", F.col("edges") - F.col("size") + 1)
    tree = F.when((F.col("branches") == 0) & (F.col("ends") == 2), "linear").when(F.col("branches") > 0, "branched").otherwise("other")
    looped = F.when((F.col("cycle_rank") == 1) & (F.col("ends") == 0) & (F.col("branches") == 0), "ring").otherwise("network")
    return rows.withColumn("tag", F.when(F.col("size") <= 1, "other").when(F.col("cycle_rank") == 0, tree).otherwise(looped))


def polymer_tag(classified: DataFrame) -> DataFrame:
    """tag (other, one architecture, or mixed) and the sorted architectures seen."""
    seen = classified.filter("tag <> 'other'").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    tag = F.when(F.size("tags") == 0, "other").when(F.size("tags") == 1, F.get("tags", F.lit(0))).otherwise("mixed")
    return seen.select(tag.alias("tag"), F.array_join("tags", ",").alias("tags"))


def chains_from_positions(rows: DataFrame, strict: bool = True) -> DataFrame:
    """chain, position and node from (node, chain_id, chain_pos); ties by node, or an error when strict."""
    if strict and not rows.groupBy("chain_id", "chain_pos").count().filter("count > 1").isEmpty():
        raise ValueError("two nodes of a chain have one position")
    at = F.row_number().over(Window.partitionBy("chain_id").orderBy("chain_pos", "node")) - 1
    return rows.select(F.col("chain_id").alias("chain"), at.cast("long").alias("position"), "node")


def chains_from_linear(nodes: DataFrame, edges: DataFrame, strict: bool = False) -> DataFrame:
    """Chains of the linear components (single nodes too), from the end with the smaller node; others are skipped."""
    classified = polymer_components(nodes, edges)
    linear = classified.filter("cycle_rank = 0 and branches = 0 and (size = 1 or ends = 2)")
    if strict and classified.count() != linear.count():
        raise ValueError("a component is not linear")
    labels = components(nodes, edges).join(linear.select("component"), "component", "left_semi")
    labels = settle(labels, "chain-labels")
    ends = labels.join(degrees(nodes, edges).filter("degree <= 1"), "node", "left_semi").groupBy("component").agg(F.min("node").alias("node"))
    hops = distances(nodes, edges, ends.select("node")).filter("hops >= 0")
    return labels.join(hops, "node").select((F.col("component") + 1).alias("chain"), F.col("hops").alias("position"), "node")
