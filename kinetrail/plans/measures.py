"""Measures: named observables that a run plans from its configuration. A measure declares what it needs and turns the
context's DataFrames into result DataFrames; `register_measure` adds one."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from ..operators import correlate
from ..operators.correlate import SERIES, CorrelatorSpec
from ..sources.ini import Config, ConfigError
from . import selection
from .topology import topo_group


@dataclass
class Capabilities:
    """What the planner checks before anything runs."""

    dynamic_selection: bool = True
    fields: tuple[str, ...] = ()
    sections: tuple[str, ...] = ()
    needs_mapping: bool = False
    scales: tuple[str, ...] = ("auto", "AA", "UA", "CG")
    group_keys: tuple[str, ...] = ("group",)


@dataclass
class Context:
    """The run's tables: particles, positions, optional topology and mapping, and its groups."""

    positions: DataFrame
    atoms: DataFrame
    dt: float
    groups: selection.Groups
    edges: DataFrame | None = None
    topo_groups: dict[str, str] = field(default_factory=dict)
    mapping: DataFrame | None = None
    dry: bool = False
    bond_edges: DataFrame | None = None
    bead_edges: DataFrame | None = None
    _selections: dict[str, DataFrame] = field(default_factory=dict)

    def topo_ids(self, name: str) -> DataFrame:
        if name == "all":
            return self.groups.ids("all")
        if name not in self.topo_groups:
            raise selection.SelectionError(f"unknown topology group {name!r}")
        if self.edges is None:
            raise selection.SelectionError("a topology group needs a topology")
        nodes = self.atoms.select(F.col("idx").alias("node"))
        held = topo_group(self.topo_groups[name], nodes, self.edges, lambda g: self.groups.ids(g).join(self.atoms, "id").select(F.col("idx").alias("node")))
        return self.atoms.join(held.withColumnRenamed("node", "idx"), "idx", "left_semi").select("id")

    def graph_source(self, wanted: str = "auto") -> str:
        """Which graph there is: beads with bonds before filtered bonds before none. An explicit one must be there."""
        there = {"bead_graph": self.bead_edges, "bond_graph": self.bond_edges, "topology_graph": self.edges}
        if wanted == "auto":
            return next((k for k, e in there.items() if e is not None), "none")
        if wanted == "none":
            return wanted
        if there.get(wanted) is None:
            raise ConfigError(f"there is no graph {wanted!r}")
        return wanted

    def graph(self, source: str = "auto") -> tuple[DataFrame, DataFrame]:
        """nodes (node) and edges (u, v) of a graph: atoms by canonical index, or beads by number."""
        source = self.graph_source(source)
        if source == "none":
            raise ConfigError("there is no graph")
        if source == "bead_graph":
            number = lambda c: self.mapping.select(F.col("bead_id").alias(c), F.col("bead").alias(f"{c}_")).distinct()
            edges = self.bead_edges.join(number("u"), "u").join(number("v"), "v").select(F.col("u_").alias("u"), F.col("v_").alias("v"))
            return self.mapping.select(F.col("bead").alias("node")).distinct(), edges
        return self.atoms.select(F.col("idx").alias("node")), (self.bond_edges if source == "bond_graph" else self.edges).select("u", "v")

    def total(self, ids: DataFrame, value: str, fixed_order: bool = False) -> DataFrame:
        """frame and the sum of a column over a selection; in a fixed order, the same to the last bit in every run."""
        rows = self.positions.join(ids, "id", "left_semi")
        if not fixed_order:
            return rows.groupBy("frame").agg(F.sum(value).alias("sum"))
        return stats.ordered_sums(rows, value, "frame", "id")

    def is_dynamic(self, group: str) -> bool:
        return selection.inline_is_dynamic(group) if ":" in group else self.groups.is_dynamic(group)

    def atom_members(self, group: str) -> DataFrame:
        """(frame, id) of a named or inline group."""
        if ":" in group:
            mode = "dynamic" if selection.inline_is_dynamic(group) else "static"
            inline = selection.Groups({**self.groups.definitions, "__inline": f"selection_mode:{mode};{group}"}, self.atoms, self.positions, self.groups.box)
            return inline.members("__inline")
        return self.groups.members(group)

    def static_ids(self, group: str, topo: str = "all", combine: str = "A&T") -> DataFrame:
        """Ids of a static combination, planned once for each key."""
        key = selection.selection_key(group, topo, combine)
        if key not in self._selections:
            if self.is_dynamic(group):
                raise selection.SelectionError(f"{group!r} follows the frames; this measure needs a static selection")
            a = self.atom_members(group).filter("frame = 0").select("id") if ":" in group else self.groups.ids(group)
            self._selections[key] = selection.combined_ids(self.atoms, a, self.topo_ids(topo), combine)
        return self._selections[key]


@dataclass
class Incremental:
    """How a measure keeps up with a stream: the rows that the frames from `since` on add, given all frames so far, and the
    dataset of all rows together. A measure without it is planned anew over the frames so far at each flush."""

    partial: Callable[[Context, int], DataFrame]
    finish: Callable[[DataFrame], DataFrame]
    schema: str


@dataclass
class Measure:
    kind: str
    capabilities: Capabilities
    build: Callable[[Context, Config, str], dict[str, Any]]


REGISTRY: dict[str, Measure] = {}


def register_measure(kind: str, capabilities: Capabilities | None = None):
    if not kind:
        raise ValueError("a measure needs a name")

    def add(build: Callable[[Context, Config, str], dict[str, Any]]):
        if kind in REGISTRY:
            raise ValueError(f"measure {kind} exists")
        REGISTRY[kind] = Measure(kind, capabilities or Capabilities(), build)
        return build

    return add


def find_measure(kind: str) -> Measure:
    if kind not in REGISTRY:
        raise ConfigError(f"unknown measure {kind!r}; there are: {', '.join(sorted(REGISTRY))}")
    return REGISTRY[kind]


def correlator_spec(cfg: Config, section: str, dt: float) -> CorrelatorSpec:
    least = cfg.get_int(section, "min_pairs_per_bin", 0)
    return CorrelatorSpec(
        kind=cfg.get(section, "correlator", "exact"), axis=cfg.get(section, "lag_axis", "frame"), dt=dt, timebin_width=cfg.get_float(section, "timebin_width"), min_pairs_per_bin=least,
        bin_merge=cfg.get_bool(section, "bin_merge", least > 0), lag_stride=cfg.get_int(section, "lag_stride", 1), block_size=cfg.get_int(section, "block_size", None),
        channels=cfg.get_int(section, "mt_channels", 16), levels=cfg.get_int(section, "mt_levels", 10), components=cfg.get(section, "components", "xxyyzz"),
    )


UNITS = {"frame": "frames", "timestep": "timesteps", "timebin": "simulation_time"}


@register_measure("msd", Capabilities(dynamic_selection=False, group_keys=("group", "drift_group")))
def build_msd(ctx: Context, cfg: Config, section: str) -> dict[str, Any]:
    spec = correlator_spec(cfg, section, ctx.dt)
    group, topo, combine = cfg.get(section, "group", "all"), cfg.get(section, "topo_group", "all"), cfg.get(section, "combine", "A&T")
    remove, drift_group = cfg.get_bool(section, "remove_drift", True), cfg.get(section, "drift_group", "all")
    frames = (cfg.get_int(section, "frame_start", 0), cfg.get_int(section, "frame_end", -1))
    members = ctx.static_ids(group, topo, combine)
    # The drift selection is always part of the run's audit; over all particles it needs no join.
    over = ctx.static_ids(drift_group if remove else "all", "all", "A")
    drift = over if remove and drift_group != "all" else None
    key = selection.selection_key(group, topo, combine)
    incremental = None
    if spec.kind == "exact":
        value = correlate.squared_displacement(spec.components)
        incremental = Incremental(lambda now, since: correlate.pairs_of_frames(correlate.prepared(now.positions, members, drift, remove, frames), value, spec.lag_stride, since), lambda pairs: correlate.exact_series(pairs, spec), "cur long, org long, dts long, v double")
    return {
        "frame": correlate.msd(ctx.positions, spec, members, drift, remove, frames),
        "incremental": incremental,
        "path": cfg.get(section, "output", "msd.dat"),
        "columns": [{"name": c, "unit": UNITS[spec.axis] if c == "lag" else ""} for c in SERIES],
        "notes": [f"correlator {spec.kind} axis {spec.axis} dt {spec.dt}", f"selection {key}", f"drift {drift_group if remove else 'kept'} frames {frames[0]}..{frames[1]} components {spec.components} block {spec.block_size}"],
        "selection": key,
        "drift_selection": selection.selection_key(drift_group if remove else "all", "all", "A"),
        "members": members,
    }


@register_measure("selection_size")
def build_selection_size(ctx: Context, cfg: Config, section: str) -> dict[str, Any]:
    group = cfg.get(section, "group", "all")

    def sizes(now: Context, since: int) -> DataFrame:
        counted = now.atom_members(group).filter(F.col("frame") >= since).groupBy("frame").agg(F.count("*").alias("n"))
        return now.positions.filter(F.col("frame") >= since).select("frame").distinct().join(counted, "frame", "left").select(F.col("frame").alias("frame_index"), F.coalesce("n", F.lit(0)).alias("n_selected"))

    series = sizes(ctx, 0)
    return {"frame": series, "incremental": Incremental(sizes, lambda rows: rows, "frame_index long, n_selected long"), "path": cfg.get(section, "output", f"{section.removeprefix('measure.')}.dat"), "columns": [{"name": c, "unit": ""} for c in series.columns], "notes": [f"group {group}"], "selection": group, "members": None}
