"""Topology groups: sets of nodes described by bonds, components and degrees."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph
from .selection import SelectionError

_FORMS = (
    (re.compile(r"all"), lambda n, e, g: n),
    (re.compile(r"atoms_in_any_bond"), lambda n, e, g: _ends(n, e)),
    (re.compile(r"atoms_in_bond_type:?\s*\{?\s*([0-9][0-9,\s]*)\}?"), lambda n, e, g, t: _ends(n, e.filter(F.col("type").isin([int(x) for x in t.split(",") if x.strip()])))),
    (re.compile(r"atoms_in_component_size\s*>=\s*([0-9]+)"), lambda n, e, g, k: _component_size(n, e, int(k))),
    (re.compile(r"atoms_incident_to_(?:atom_)?group(?::\s*(?P<a>\w+)|\(\s*(?P<b>\w+)\s*\))"), lambda n, e, g, a, b: _incident(n, e, g(a or b))),
    (re.compile(r"atoms_degree_is:?\s*\(?([0-9]+)\)?"), lambda n, e, g, k: graph.degrees(n, e).filter(F.col("degree") == int(k)).select("node")),
    (re.compile(r"atoms_is_end"), lambda n, e, g: graph.degrees(n, e).filter("degree = 1").select("node")),
)


def _ends(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array("u", "v")).alias("node"))
    return nodes.select("node").join(ends, "node", "left_semi")


def _component_size(nodes: DataFrame, edges: DataFrame, least: int) -> DataFrame:
    labels = graph.components(nodes, edges)
    large = graph.component_sizes(labels).filter(F.col("size") >= least)
    return labels.join(large, "component", "left_semi").select("node")


def _incident(nodes: DataFrame, edges: DataFrame, group: DataFrame) -> DataFrame:
    """Neighbours of the group's members; a member counts only if it is a neighbour itself."""
    near = graph.adjacency(edges).join(group.select(F.col("node").alias("u")), "u", "left_semi").select(F.col("v").alias("node"))
    return nodes.select("node").join(near, "node", "left_semi")


def topo_group(definition: str, nodes: DataFrame, edges: DataFrame, atom_group: Callable[[str], DataFrame] | None = None) -> DataFrame:
    """The nodes of a topology group. edges: type, u, v; atom_group gives a static atom group's nodes by name."""

    def missing(name: str) -> DataFrame:
        raise SelectionError(f"unknown group {name!r}")

    for pattern, build in _FORMS:
        m = pattern.fullmatch(definition.strip())
        if m:
            return build(nodes, edges, atom_group or missing, *m.groups())
    raise SelectionError(f"not a topology group: {definition!r}")
