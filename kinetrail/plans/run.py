"""A run: configuration to plans to result files. `validate` does all but the execution."""

from __future__ import annotations

import json
import os
import signal
import threading
import time
from dataclasses import replace
from functools import reduce
from pathlib import Path
from typing import Any

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import Box
from ..functions.hashing import file_fingerprint, fnv1a, hex16
from ..functions.places import file_info, file_system, is_file
from ..functions.stats import size_statistics
from ..operators import graph, mapping
from ..sources import sinks, topology
from ..sources.dump import Trajectory, checked, first_particles, read_dump
from ..sources.ranges import Index, scan_dump
from ..sources.ini import Config, ConfigError
from ..streaming import follow
from . import selection
from .durable import settle
from .measures import Context, find_measure

VERSION = "0.1.0"
# Labels of the model scale and their long forms (fixed values of the configuration language).
SCALES = {"auto": "auto", "aa": "AA", "all_atom": "AA", "allatom": "AA", "ua": "UA", "united_atom": "UA", "unitedatom": "UA", "cg": "CG", "coarse_grained": "CG", "coarsegrained": "CG"}
FORMATS = {"bond_table": "bond_table", "table": "bond_table", "bonds": "bond_table", "lammps_data": "data", "lammps": "data", "data": "data"}
KNOWN = ("general", "model", "groups", "topo_groups", "topology", "mapping", "mapping.file", "polymer_classifier")


def _resolve(base: str, path: str) -> str:
    return path if os.path.isabs(path) or "://" in path else os.path.join(base, path)


def plan(spark: SparkSession, cfg: Config, base: str, dry: bool = False, traj: Trajectory | None = None) -> dict[str, Any]:
    """Everything a run needs, as DataFrames. The trajectory is parsed here, once, unless one is given or the run is dry."""
    t0 = time.time()
    source, dt = _resolve(base, cfg.get("general", "input")), cfg.get_float("general", "dt")
    if dt is None or not dt > 0:
        raise ConfigError("[general] dt is required and positive")
    scale = cfg.get("model", "scale", "auto").lower()
    if scale not in SCALES:
        raise ConfigError(f"unknown model scale {scale!r}")
    warnings = [f"section [{s}] is not read" for s in cfg.sections if s not in KNOWN and not s.startswith("measure.")]
    if traj is None:
        traj = read_dump(spark, source, cfg.get_bool("general", "allow_header_change"), settled=not dry)
    read_s = time.time() - t0
    b = traj.frames.orderBy("frame").select("box").first()["box"]
    box = Box((b["xlo"], b["ylo"], b["zlo"]), (b["xhi"], b["yhi"], b["zhi"]), b["xy"], b["xz"], b["yz"])
    edges, tables = None, {}
    if cfg.has("topology", "file"):
        path, form = _resolve(base, cfg.get("topology", "file")), FORMATS.get(cfg.get("topology", "format", "bond_table"))
        if form is None:
            raise ConfigError("[topology] format is bond_table or lammps_data")
        if form == "bond_table":
            tables = {"Bonds": topology.read_bond_table(spark, path)}
        else:
            wanted = [s.strip().capitalize() for s in (cfg.get_list("topology", "load") or ["bonds"])]
            tables = topology.read_data_file(spark, path, wanted)
        if "Bonds" in tables:
            edges = topology.canonical_bonds(tables["Bonds"], traj.atoms)
    atoms = traj.atoms
    if cfg.get_bool("topology", "derive_mol_from_bonds"):
        if edges is None:
            raise ConfigError("molecules are derived from bonds, and there are none")
        mols = graph.derived_molecules(atoms.select(F.col("idx").alias("node")), edges)
        atoms = atoms.drop("mol").join(mols.withColumnRenamed("node", "idx"), "idx")
    groups = selection.Groups(cfg.section("groups"), atoms, traj.positions, box)
    bond_edges = edges
    if edges is not None and (cfg.has("topology", "bond_graph.bond_types") or cfg.has("topology", "bond_graph.atom_group")):
        types = [int(x) for x in cfg.get_list("topology", "bond_graph.bond_types")] or None
        name = cfg.get("topology", "bond_graph.atom_group", "")
        members = groups.ids(name).join(atoms, "id").select(F.col("idx").alias("node")) if name else None
        bond_edges = graph.filter_bonds(edges, types, members)
    mode, beads, spec_hash, bead_edges = cfg.get("mapping", "mode", "none"), None, "", None
    if mode != "none":
        file_hash = ""
        if mode in ("identity",):
            beads = mapping.identity_map(atoms)
        elif mode in ("by_mol", "by_mol_ids"):
            beads = mapping.molecule_map(atoms)
        elif mode == "file":
            path = _resolve(base, cfg.get("mapping.file", "path"))
            beads, file_hash = mapping.file_map(topology.read_mapping_file(spark, path), atoms), file_fingerprint(path)
        else:
            raise ConfigError(f"unknown mapping mode {mode!r}")
        group = cfg.get("mapping", "source_group", "")
        if group:
            beads = mapping.restrict(beads, groups.ids(group))
        spec_hash = mapping.specification(SCALES[scale], mode, cfg.get("mapping", "position", "com_geom"), group, file_hash)[1]
        if edges is not None:
            bead_edges = mapping.bead_edges(mapping.atom_bonds(edges, atoms), beads)
    ctx = Context(traj.positions, atoms, dt, groups, edges, cfg.section("topo_groups"), beads, dry, bond_edges, bead_edges)
    measures = []
    for section in sorted(s for s in cfg.sections if s.startswith("measure.")):
        if not cfg.get_bool(section, "enabled", True):
            continue
        name = section.removeprefix("measure.")
        m = find_measure(cfg.get(section, "type", name))
        if SCALES[scale] not in m.capabilities.scales:
            raise ConfigError(f"{name} doesn't work at scale {SCALES[scale]}")
        if m.capabilities.needs_mapping and beads is None:
            raise ConfigError(f"{name} needs a mapping")
        missing = [f for f in m.capabilities.fields if f not in traj.extras and f not in ("x", "y", "z", "id", "type", "mol")]
        if missing:
            raise ConfigError(f"{name} needs the fields {', '.join(missing)}")
        for key in m.capabilities.group_keys:
            g = cfg.get(section, key, "all")
            if not m.capabilities.dynamic_selection and ctx.is_dynamic(g):
                raise ConfigError(f"{name} needs a static selection; {g!r} follows the frames")
        measures.append({"instance": name, "section": section, "type": m.kind, "params": cfg.section(section), "build": m.build, **m.build(ctx, cfg, section)})
    classify = cfg.get_bool("polymer_classifier", "enabled", True)
    graph_source = ctx.graph_source(cfg.get("polymer_classifier", "graph_source", "auto")) if classify else "none"
    described = {"mode": mode, "position": cfg.get("mapping", "position", "com_geom") if mode != "none" else "", "source_group": cfg.get("mapping", "source_group", ""), "spec_hash": spec_hash}
    return {"traj": traj, "ctx": ctx, "measures": measures, "graph_source": graph_source, "tables": tables, "scale": SCALES[scale], "mapping": described, "input": source, "warnings": warnings, "read_s": read_s}


def validate(spark: SparkSession, config: Config | str, base: str | None = None) -> dict[str, Any]:
    """Plans the run and analyses every result's schema; writes nothing."""
    cfg, base = _config(config, base)
    p = plan(spark, cfg, base, dry=True)
    return {"measures": [{"instance": m["instance"], "type": m["type"], "schema": m["frame"].schema.simpleString()} for m in p["measures"]], "warnings": p["warnings"]}


def _config(config: Config | str, base: str | None) -> tuple[Config, str]:
    if isinstance(config, str):
        return Config.read(config), base or str(Path(config).resolve().parent)
    return config, base or os.getcwd()


def _counted(tables: dict[tuple, DataFrame]) -> dict[tuple, int]:
    """The numbers of rows of many tables, by one job. The keys are a run's groups and selections: a few."""
    if not tables:
        return {}
    keys = list(tables)
    marked = [df.select(F.lit(k).alias("k")) for k, df in enumerate(tables.values())]
    found = dict(map(tuple, reduce(DataFrame.unionAll, marked).groupBy("k").count().collect()))
    return {key: found.get(k, 0) for k, key in enumerate(keys)}


def _sizes(p: dict[str, Any]) -> dict[tuple, int]:
    """Sizes of all static groups, topology groups and combined selections, of the topology's tables and the mapping."""
    ctx: Context = p["ctx"]
    out = {("group", n): ctx.groups.ids(n) for n in ctx.groups.definitions if not ctx.groups.is_dynamic(n)}
    out |= {("topo", n): ctx.topo_ids(n) for n in ctx.topo_groups} | {("combined", k): df for k, df in ctx._selections.items()}
    out |= {("table", k): t for k, t in p["tables"].items()}
    if ctx.bond_edges is not None:
        out |= {("bond_graph", "vertices"): ctx.atoms, ("bond_graph", "edges"): ctx.bond_edges}
    if ctx.mapping is not None:
        out |= {("mapping", "atoms"): ctx.mapping, ("mapping", "beads"): ctx.mapping.select("bead").distinct()}
        if ctx.bead_edges is not None:
            out[("mapping", "bead_bonds")] = ctx.bead_edges
    return _counted(out)


def _group_audit(ctx: Context, sizes: dict[tuple, int]) -> list[dict]:
    out = []
    for name in sorted(ctx.groups.definitions):
        row = {"name": name, "definition": ctx.groups.definitions[name], "dynamic": ctx.groups.is_dynamic(name)}
        row["size"] = size_statistics(ctx.groups.sizes(name), "n_selected").first().asDict() if row["dynamic"] else sizes["group", name]
        out.append(row)
    return out


def _write(p: dict[str, Any], cfg: Config, out: str, entry: dict[str, Any], frame: DataFrame) -> dict[str, Any]:
    """One measure's dataset, and what the index says of it (the size of its selection is filled in by _index)."""
    path = os.path.join(out, entry["path"])
    rows = sinks.write_dataset(path, frame, entry["columns"], entry["notes"], append=cfg.get(entry["section"], "writer_mode", "") == "append")
    said = {"instance": entry["instance"], "type": entry["type"], "params": entry["params"], "selection": entry["selection"], "n_selected": None, "outputs": [{"path": entry["path"], "rows": rows, "columns": entry["columns"]}]}
    return said | ({"drift_selection": entry["drift_selection"]} if "drift_selection" in entry else {})


def _index(p: dict[str, Any], cfg: Config, entries: list[dict], timing: dict[str, float], began: float, n_frames: int, hash_input: bool) -> dict[str, Any]:
    ctx: Context = p["ctx"]
    index: dict[str, Any] = {"version": VERSION, "run": {"input": {"path": p["input"]}, "dt": ctx.dt, "scale": p["scale"], "frames": n_frames, "mapping": dict(p["mapping"]), "config_hash": hex16(fnv1a(cfg.to_ini().encode()))}}
    if cfg.get_bool("general", "hash_input", hash_input) and is_file(p["input"]):
        info = file_info(p["input"])
        index["run"]["input"] |= {"size": info.size, "mtime": int(info.mtime_ns // 10**9), "fnv1a64": file_fingerprint(p["input"])}
    sizes = _sizes(p)
    of = lambda kind: {name: n for (k, name), n in sizes.items() if k == kind}
    if p["tables"]:
        index["run"]["topology"] = of("table")
    if ctx.bond_edges is not None:
        index["run"]["bond_graph"] = of("bond_graph")
    index["run"]["mapping"] |= of("mapping")
    entries = [e | {"n_selected": sizes.get(("combined", e["selection"]), e["n_selected"])} for e in entries]
    if p["graph_source"] != "none":
        tags = graph.polymer_tag(graph.polymer_components(*ctx.graph(p["graph_source"]))).first()
        index["polymer_classifier"] = {"graph_source": p["graph_source"], "tag": tags["tag"], "tags": [t for t in tags["tags"].split(",") if t]}
    combined = [{"key": k, "dynamic": False, "size": n} for k, n in sorted(of("combined").items())]
    topo = [{"name": n, "definition": d, "size": sizes["topo", n]} for n, d in sorted(ctx.topo_groups.items())]
    index |= {"groups": {"atom_groups": _group_audit(ctx, sizes), "topo_groups": topo, "combined_selections": combined}, "measures": entries, "warnings": p["warnings"]}
    index["profiling"] = {"wall_seconds": time.time() - began, "reader_seconds": p["read_s"], "measures": timing}
    return json.loads(json.dumps(index))


def run(spark: SparkSession, config: Config | str, base: str | None = None, stop: threading.Event | None = None) -> sinks.Results | None:
    """Runs every enabled measure, writes its dataset and the audit index. None if no measure is enabled.

    A run that follows its input, flushes on the way, or keeps or takes up a checkpoint is a stream (see follow_run)."""
    cfg, base = _config(config, base)
    keys = ("checkpoint_out", "resume_from")
    if cfg.get_bool("general", "follow") or any(cfg.get("general", k, "") for k in keys) or cfg.get_int("general", "flush_every_frames", 0) or cfg.get_float("general", "flush_every_seconds", 0.0):
        return follow_run(spark, cfg, base, stop)
    began = time.time()
    p = plan(spark, cfg, base)
    if not p["measures"]:
        print("no measure is enabled")
        return None
    out = _resolve(base, cfg.get("general", "output_dir", "./out"))
    entries, timing = [], {}
    for m in p["measures"]:
        t = time.time()
        entries.append(_write(p, cfg, out, m, m["frame"]))
        timing[m["instance"]] = time.time() - t
    name = cfg.get("general", "results_json", "results.json")
    sinks.write_index(os.path.join(out, name), _index(p, cfg, entries, timing, began, p["traj"].frames.count(), True))
    return sinks.Results(out, name)


# --- runs as streams ----------------------------------------------------------------------------------------------

#: Settings that may differ between a run and the one that takes it up.
NOT_COMPARED = ("checkpoint_out", "resume_from", "follow", "follow_poll_ms", "flush_every_frames", "flush_every_seconds", "output_dir", "profile", "results_json", "hash_input")


#: Parts that a micro-batch may come in (frames between flushes).
MOST_PARTS = 1_000_000
#: Taken off the numbers of batches of format 1.
OLD_BATCHES = 10**12
#: Parts of one tier that become a part of the next.
COMPACT = 32


class _State:
    """A checkpoint folder: the stream's offsets, the parsed frames and each measure's partial results, by batch.

    A batch's folders are overwritten when it is repeated; its mark comes last, and only marked batches count. Parts of
    committed batches are merged, COMPACT of a tier to one of the next, so n batches leave some COMPACT * log n parts and a
    row is rewritten log n times. A merged part is named by its first and last part and its tier; once it is marked, the
    parts within it don't count, and they are deleted then (or by the next merge, if that was cut off)."""

    def __init__(self, folder: str):
        self.folder = folder
        self.system, self.path = file_system(folder)

    def exists(self) -> bool:
        return self.system.get_file_info(f"{self.path}/run_meta.json").type != fs.FileType.NotFound

    def clear(self) -> None:
        if self.system.get_file_info(self.path).type != fs.FileType.NotFound:
            self.system.delete_dir(self.path)

    @staticmethod
    def span(part: str) -> tuple[int, int, int]:
        """First and last part number and tier of a part."""
        first, last, tier = part.split("_") if "_" in part else (part, part, 0)
        return int(first), int(last), int(tier)

    def mark(self, part: str, frames: int) -> None:
        self.system.create_dir(f"{self.path}/marks", recursive=True)
        with self.system.open_output_stream(f"{self.path}/marks/{part}") as f:
            f.write(str(frames).encode())

    def _names(self) -> tuple[list[str], list[str]]:
        """Marked parts that count, in order, and those that lie within one of them."""
        found = [x.base_name for x in self.system.get_file_info(fs.FileSelector(f"{self.path}/marks", allow_not_found=True))]
        counted, within, behind = [], [], None
        for part in sorted(found, key=lambda x: (self.span(x)[0], -self.span(x)[2])):
            if behind is not None and self.span(part)[1] <= behind:
                within.append(part)
            else:
                counted.append(part)
                behind = self.span(part)[1]
        return counted, within

    def marks(self) -> dict[str, int]:
        out = {}
        for part in self._names()[0]:
            with self.system.open_input_file(f"{self.path}/marks/{part}") as f:
                out[part] = int(f.read())
        return out

    def compact(self, spark: SparkSession, marks: dict[str, int], kinds: dict[str, Any], below: int) -> None:
        """Merge parts numbered under `below`, whose batches are committed; kinds names the tables and their schemas."""
        tier = 0
        while True:
            some = sorted((x for x in marks if self.span(x)[2] == tier and self.span(x)[1] < below), key=self.span)
            if not some and all(self.span(x)[2] < tier for x in marks):
                break
            if len(some) >= COMPACT:
                whole = f"{self.span(some[0])[0]:016d}_{self.span(some[-1])[1]:016d}_{tier + 1}"
                for kind, schema in kinds.items():
                    self.read(spark, kind, some, schema).write.mode("overwrite").parquet(self.place(kind, whole))
                self.mark(whole, sum(marks[x] for x in some))
                marks[whole] = sum(marks.pop(x) for x in some)
                for part in self._names()[1]:  # the mark goes last: what it names is deleted as long as it is there
                    for kind in kinds:
                        if self.system.get_file_info(f"{self.path}/{kind}/{part}").type != fs.FileType.NotFound:
                            self.system.delete_dir(f"{self.path}/{kind}/{part}")
                    self.system.delete_file(f"{self.path}/marks/{part}")
            tier += 1

    def migrate(self) -> None:
        """A folder of format 1 becomes one of format 2. Its committed batches keep their frames and results, under numbers
        below all new ones, and the byte and frame of its last committed offset become the place to go on from. The header
        is rewritten last, so a migration that was cut off is taken up."""
        header = f"{self.path}/run_meta.json"
        if not self.exists():
            return
        with self.system.open_input_file(header) as f:
            meta = json.loads(f.read())
        if meta.get("version") != 1:
            return
        listed = lambda p: self.system.get_file_info(fs.FileSelector(p, allow_not_found=True))
        if self.system.get_file_info(f"{self.path}/offsets").type != fs.FileType.NotFound:
            self.system.move(f"{self.path}/offsets", f"{self.path}/offsets-1")
        done = [int(x.base_name) for x in listed(f"{self.path}/offsets-1/commits") if x.base_name.isdigit()]
        at = {"byte": 0, "frame": 0}
        if done:
            with self.system.open_input_file(f"{self.path}/offsets-1/offsets/{max(done)}") as f:
                at = json.loads(f.read().decode().rstrip("\n").split("\n")[-1])
        for folder in listed(self.path):
            if folder.type == fs.FileType.Directory and folder.base_name != "offsets-1":
                for x in listed(folder.path):
                    if len(x.base_name) == 10 and x.base_name.isdigit():
                        kept = int(x.base_name) in done
                        if kept:
                            self.system.move(x.path, f"{folder.path}/{int(x.base_name) - OLD_BATCHES:016d}")
                        elif x.type == fs.FileType.File:
                            self.system.delete_file(x.path)
                        else:
                            self.system.delete_dir(x.path)
        follow.Positions(f"{self.folder}/positions").note(-1, at["byte"], at["frame"])
        with self.system.open_output_stream(header) as f:
            f.write(json.dumps(meta | {"version": 2}).encode())

    def place(self, kind: str, part: str) -> str:
        return f"{self.folder}/{kind}/{part}"

    def read(self, spark: SparkSession, kind: str, parts: list[str], schema) -> DataFrame:
        if not parts:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(*[self.place(kind, x) for x in parts])


def _started(spark: SparkSession, source: str, allow_header_change: bool) -> tuple[Trajectory, Index]:
    """The particles of a dump that may still grow, from its first frame; positions hold that frame alone."""
    index, atoms = first_particles(spark, source, allow_header_change)
    rows = settle(scan_dump(spark, index, ["frame", "timestep", "id", "x", "y", "z"], (0, 0), allow_header_change), "first-frame")
    frames = index.frames.filter("frame = 0").select("frame", "timestep", "natoms", "box")
    return Trajectory(frames, atoms, checked(rows, atoms), [], index), index


def follow_run(spark: SparkSession, cfg: Config, base: str, stop: threading.Event | None = None) -> sinks.Results | None:
    """A run as a stream over a dump that may grow.

    Each micro-batch of complete frames is parsed once, kept, and given to every measure: one with partial results (see
    measures.Incremental) adds those of the new frames, the others are planned over the frames kept so far. A flush rewrites
    all datasets and the index: after flush_every_frames frames, flush_every_seconds seconds, and at the end. The run
    ends when nothing is left to read or, if it follows, when it's told to stop (SIGINT, SIGTERM or `stop`); what was
    read by then is flushed. checkpoint_out keeps the state, resume_from takes it up if it exists and belongs to this run."""
    began = time.time()
    general = lambda k: _resolve(out, v) if (v := cfg.get("general", k, "")) else ""
    out = _resolve(base, cfg.get("general", "output_dir", "./out"))
    source = _resolve(base, cfg.get("general", "input"))
    following, every, seconds = cfg.get_bool("general", "follow"), cfg.get_int("general", "flush_every_frames", 0), cfg.get_float("general", "flush_every_seconds", 0.0)
    keep, resume = general("checkpoint_out"), general("resume_from")
    header_may_change = cfg.get_bool("general", "allow_header_change")
    traj, index = _started(spark, source, header_may_change)
    p = plan(spark, cfg, base, traj=traj)
    if not p["measures"]:
        print("no measure is enabled")
        return None
    state = _State(keep or resume or follow.scratch(spark, "run"))
    old = _State(resume) if resume else None
    if old is None or not old.exists():
        state.clear()
    elif resume != state.folder:
        state.clear()
        fs.copy_files(old.path, state.path, source_filesystem=old.system, destination_filesystem=state.system)
    state.migrate()
    settings = Config({s: {k: v for k, v in values.items() if s != "general" or k not in NOT_COMPARED} for s, values in cfg.sections.items()})
    topology_file = _resolve(base, cfg.get("topology", "file")) if cfg.has("topology", "file") else ""
    follow.guard(state.folder, {"config": hex16(fnv1a(settings.to_ini().encode())), "input": source, "mapping": p["mapping"]["spec_hash"], "topology": file_fingerprint(topology_file) if topology_file and is_file(topology_file) else "", "sections": sorted(p["tables"]), "measures": [[m["instance"], m["type"], m["params"]] for m in p["measures"]]})
    for m in p["measures"]:
        if m.get("incremental"):  # each state has a header of its own
            follow.guard(f"{state.folder}/{m['instance']}", {"type": m["type"], "instance": m["instance"], "fingerprint": hex16(fnv1a(json.dumps(m["params"], sort_keys=True).encode()))})
    marks, timing, entries = state.marks(), {m["instance"]: 0.0 for m in p["measures"]}, []
    held, parts = {"frames": 0, "time": time.time()}, {}
    groups = p["ctx"].groups
    kinds = {"frames": follow.FIELDS} | {m["instance"]: m["incremental"].schema for m in p["measures"] if m.get("incremental")}

    def now() -> Context:
        rows = state.read(spark, "frames", sorted(marks), follow.FIELDS)
        return replace(p["ctx"], positions=rows, groups=selection.Groups(groups.definitions, p["ctx"].atoms, rows, groups.box))

    def flush() -> None:
        ctx, entries[:] = now(), []
        for m in p["measures"]:
            t = time.time()
            if m.get("incremental"):
                frame = m["incremental"].finish(state.read(spark, m["instance"], sorted(marks), m["incremental"].schema))
            else:
                frame = m["build"](ctx, cfg, m["section"])["frame"]
            entries.append(_write(p, cfg, out, m, frame))
            timing[m["instance"]] += time.time() - t
        audit = _index(p | {"ctx": replace(ctx, _selections=p["ctx"]._selections)}, cfg, entries, timing, began, sum(marks.values()), not following)
        sinks.write_index(os.path.join(out, cfg.get("general", "results_json", "results.json")), audit)
        held.update(frames=0, time=time.time())

    def batch(rows: DataFrame, since: int, n: int, number: int) -> None:
        if number not in parts:
            state.compact(spark, marks, kinds, number * MOST_PARTS)
        part = f"{number * MOST_PARTS + parts.get(number, 0):016d}"  # a batch may come in several parts
        parts[number] = parts.get(number, 0) + 1
        rows.write.mode("overwrite").parquet(state.place("frames", part))
        marks[part] = n
        ctx = now()
        for m in p["measures"]:
            if m.get("incremental"):
                t = time.time()
                m["incremental"].partial(ctx, since).write.mode("overwrite").parquet(state.place(m["instance"], part))
                timing[m["instance"]] += time.time() - t
        state.mark(part, n)
        held["frames"] += n
        if (every and held["frames"] >= every) or (seconds and time.time() - held["time"] >= seconds):
            flush()

    stop = stop or threading.Event()
    before = {}
    if threading.current_thread() is threading.main_thread():
        before = {s: signal.signal(s, lambda *_: stop.set()) for s in (signal.SIGINT, signal.SIGTERM)}
    try:
        flush()
        poll = f"{max(1, cfg.get_int('general', 'follow_poll_ms', 200))} milliseconds"
        each = follow.each_batch(spark, source, index, traj.atoms, follow.Positions(f"{state.folder}/positions"), batch, every, header_may_change)
        query = follow.growth(spark, source).writeStream.foreachBatch(each).option("checkpointLocation", f"{state.folder}/offsets").trigger(processingTime=poll).start()
        try:
            if following:
                while query.isActive and not stop.is_set():
                    query.awaitTermination(0.2)
            else:
                query.processAllAvailable()
            if query.exception() is not None:
                raise query.exception()
        finally:
            query.stop()
        marks.clear()
        marks.update(state.marks())
        flush()
    finally:
        for s, handler in before.items():
            signal.signal(s, handler)
    return sinks.Results(out, cfg.get("general", "results_json", "results.json"))
