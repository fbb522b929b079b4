"""Registered queries over files and streams: the views are written as dumps, topologies, mappings and configurations,
read back by the readers, runs and streams, and compared with what the tables hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.places import file_system
from ..operators import correlate, mapping
from ..sources import dump, ranges, sinks
from ..sources import topology as files
from ..sources.ini import Config
from ..streaming import follow
from . import measures, run
from .catalog import BLOCK, DT, _SEL, groups_of, query, r8, series, spec, sql_msd
from .views import Views, with_views


def rows_of(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def part_files(lines: DataFrame, name: str, parts: int = 3) -> str:
    """Lines (at, line) as a folder of text files, in order of their names, written by the executors."""
    path = follow.scratch(lines.sparkSession, name)
    lines.repartitionByRange(parts, "at").sortWithinPartitions("at").select("line").write.text(path)
    return path


def one_file(folder: str, path: str, stop: int | None = None) -> str:
    """A folder's text files one after the other as one growing file, copied by small pieces, up to byte `stop`."""
    system, spot = file_system(path)
    system.create_dir(spot.rsplit("/", 1)[0], recursive=True)
    left = stop
    with system.open_output_stream(spot) as out:
        for name, _ in ranges.files_of(folder):
            with system.open_input_stream(name) as f:
                while (left is None or left > 0) and (some := f.read(1 << 20 if left is None else min(left, 1 << 20))):
                    out.write(some)
                    left = None if left is None else left - len(some)
    return path


STRAIGHT, TILTED = "pp pp pp\n0 20\n0 4\n0 3", "xy xz yz pp pp pp\n0 23 2\n0 4.5 1\n0 3 0.5"
_FLAGS = {"ix": "id % 3 - 1", "iy": "frame % 2", "iz": "1"}


def dump_frames(v: Views, columns: dict[str, str], box: str = STRAIGHT, swapped: dict[str, str] | None = None) -> DataFrame:
    """frame and text of every frame, with the given atom columns as expressions (in another order in odd frames, if `swapped`)."""
    rows = v.positions.join(v.atoms, "id")

    def line(named: dict[str, str]):
        return F.concat_ws(" ", *(F.expr(c).cast("string") for c in named.values()))

    odd = F.col("frame") % 2 == 1
    text = line(columns) if swapped is None else F.when(odd, line(swapped)).otherwise(line(columns))
    names = F.lit(" ".join(columns)) if swapped is None else F.when(odd, " ".join(swapped)).otherwise(" ".join(columns))
    frames = rows.groupBy("frame", "timestep").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct((-F.col("id")).alias("k"), text.alias("line")))).alias("lines"))
    body = F.array_join(F.transform("lines", lambda x: x["line"]), "\n")
    head = F.concat(F.lit("ITEM: TIMESTEP\n"), F.col("timestep").cast("string"), F.lit("\nITEM: NUMBER OF ATOMS\n"), F.col("n").cast("string"), F.lit(f"\nITEM: BOX BOUNDS {box}\nITEM: ATOMS "), names, F.lit("\n"))
    return frames.select(F.col("frame").alias("at"), F.concat(head, body).alias("line"))


def atom_columns(**more: str) -> dict[str, str]:
    return {c: c for c in ("id", "type", "mol")} | more


UNWRAPPED = {"xu": "x", "yu": "y", "zu": "z"}


def write_dump(v: Views, columns: dict[str, str], box: str = STRAIGHT, swapped: dict[str, str] | None = None) -> str:
    """A dump of several part files, in order of frames."""
    return part_files(dump_frames(v, columns, box, swapped), "dump")


_TRAJ = with_views("traj", "atoms")
_POSITIONS = " select frame, timestep, id, round(x, 8) as x, round(y, 8) as y, round(z, 8) as z from traj"


@query(_TRAJ + _POSITIONS)
def dump_positions(v: Views) -> DataFrame:
    return r8(dump.read_dump(v.spark, write_dump(v, atom_columns(**UNWRAPPED))).positions)


def _flagged(x: str, y: str, z: str) -> str:
    return f", f as (select *, id % 3 - 1 as ix, frame % 2 as iy, 1 as iz from traj) select frame, timestep, id, round({x}, 8) as x, round({y}, 8) as y, round({z}, 8) as z from f"


@query(_TRAJ + _flagged("x + ix*20.0", "y + iy*4.0", "z + iz*3.0"))
def dump_image_flags(v: Views) -> DataFrame:
    return r8(dump.read_dump(v.spark, write_dump(v, atom_columns(x="x", y="y", z="z", **_FLAGS))).positions)


@query(_TRAJ + _flagged("x + ix*20.0 + iy*2.0 + iz*1.0", "y + iy*4.0 + iz*0.5", "z + iz*3.0"))
def dump_image_flags_triclinic(v: Views) -> DataFrame:
    return r8(dump.read_dump(v.spark, write_dump(v, atom_columns(x="x", y="y", z="z", **_FLAGS), TILTED)).positions)


@query(_TRAJ + " select frame, timestep, count(*) as natoms, 0.0::double as xlo, 20.0::double as xhi, 4.0::double as yhi, 3.0::double as zhi, 2.0::double as xy, 1.0::double as xz, 0.5::double as yz, true as triclinic from traj group by frame, timestep")
def dump_frame_headers(v: Views) -> DataFrame:
    frames = dump.read_dump(v.spark, write_dump(v, atom_columns(**UNWRAPPED), TILTED)).frames
    return frames.select("frame", "timestep", "natoms", *(F.col(f"box.{c}").alias(c) for c in ("xlo", "xhi", "yhi", "zhi", "xy", "xz", "yz", "triclinic")))


@query(_TRAJ + " select row_number() over (order by id desc) - 1 as idx, id, type, mol from atoms")
def dump_atoms(v: Views) -> DataFrame:
    return dump.read_dump(v.spark, write_dump(v, atom_columns(**UNWRAPPED))).atoms


@query(_TRAJ + " select frame, id, round(x*2, 8) as q, cast(id % 7 as double) as vx from traj")
def dump_extra_fields(v: Views) -> DataFrame:
    t = dump.read_dump(v.spark, write_dump(v, atom_columns(**UNWRAPPED, q="x * 2", vx="id % 7")))
    return r8(t.positions.select("frame", "id", *t.extras))


@query(_TRAJ + _POSITIONS)
def dump_header_change(v: Views) -> DataFrame:
    columns = atom_columns(**UNWRAPPED)
    path = write_dump(v, columns, swapped={c: columns[c] for c in ("zu", "mol", "id", "yu", "type", "xu")})
    return r8(dump.read_dump(v.spark, path, allow_header_change=True).positions)


# --- topology, mapping, configuration files -----------------------------------------------------------------------

_TRIPLES = "triples as (select a.id as ai, a.id + 1 as aj, a.id + 2 as ak, a.id + 3 as al, a.id % 10 as d, a.mol from atoms a)"


def data_file(v: Views) -> str:
    """A sectioned data file of the views: masses, bonds, and runs of three and four neighbours within a molecule."""
    text = lambda *cs: F.concat_ws(" ", *(c.cast("string") if not isinstance(c, str) else F.col(c).cast("string") for c in cs))
    digit = F.col("id") % 10
    at = lambda k: F.col("id") + k
    parts = [
        ("Masses", v.masses.select(F.col("type").cast("long").alias("k"), F.concat(text("type", "mass"), F.lit("  # kind")).alias("line"))),
        ("Bonds # harmonic", v.bonds.select((F.col("ai") * 100 + F.col("aj")).alias("k"), text(F.col("ai"), "type", "ai", "aj").alias("line"))),
        ("Angles", v.atoms.filter(digit <= 7).select(F.col("id").alias("k"), text("id", F.lit(1), "id", at(1), at(2)).alias("line"))),
        ("Dihedrals", v.atoms.filter(digit <= 6).select(F.col("id").alias("k"), text("id", F.lit(2), "id", at(1), at(2), at(3)).alias("line"))),
        ("Impropers", v.atoms.filter(digit == 0).select(F.col("id").alias("k"), text("id", F.lit(3), at(3), at(2), at(1), "id").alias("line"))),
    ]
    lines = rows_of(v.spark, [(0, 0, "a data file"), (0, 1, ""), (0, 2, "3 atom types")], "part int, k long, line string")
    for n, (name, df) in enumerate(parts, 1):
        lines = lines.union(rows_of(v.spark, [(n, -2, ""), (n, -1, name), (n, 0, "# rows")], "part int, k long, line string")).union(df.select(F.lit(n), F.col("k") + 1, "line"))
    return part_files(lines.select(F.struct("part", "k").alias("at"), "line"), "topology")


_ATOMS = with_views("atoms")


def _section(query_name: str, section: str, sql: str, *names: str) -> None:
    def read(v: Views) -> DataFrame:
        return files.read_data_file(v.spark, data_file(v), [section])[section].select("type", *names)

    read.__name__ = query_name
    query(sql)(read)


_section("data_masses", "Masses", with_views("masses") + "select type, mass from masses", "mass")
_section("data_bonds", "Bonds", with_views("bonds") + "select type, ai, aj from bonds", "ai", "aj")
_section("data_angles", "Angles", _ATOMS + "select 1::integer as type, id as ai, id + 1 as aj, id + 2 as ak from atoms where id % 10 <= 7", "ai", "aj", "ak")
_section("data_dihedrals", "Dihedrals", _ATOMS + "select 2::integer as type, id as ai, id + 1 as aj, id + 2 as ak, id + 3 as al from atoms where id % 10 <= 6", "ai", "aj", "ak", "al")
_section("data_impropers", "Impropers", _ATOMS + "select 3::integer as type, id + 3 as ai, id + 2 as aj, id + 1 as ak, id as al from atoms where id % 10 = 0", "ai", "aj", "ak", "al")


@query(with_views("edges") + "select type, u, v from edges")
def data_bonds_by_index(v: Views) -> DataFrame:
    return files.canonical_bonds(files.read_data_file(v.spark, data_file(v), ["Bonds"])["Bonds"], v.atoms)


@query(with_views("bonds") + "select case when ai % 2 = 0 then 0 else type end as type, ai, aj from bonds")
def topo_bond_table(v: Views) -> DataFrame:
    path = follow.scratch(v.spark, "bonds")
    two, three, four = F.concat_ws(" ", "ai", "aj"), F.concat_ws("\t", "type", "ai", "aj"), F.concat_ws("  ", F.lit(7), "type", F.lit("x"), "ai", "aj")
    v.bonds.select(F.when(F.col("ai") % 2 == 0, F.concat(two, F.lit(" # two"))).when(F.col("ai") % 3 == 0, three).otherwise(four)).union(rows_of(v.spark, [("# none",), ("",), ("5",)], "x string")).write.text(path)
    return files.read_bond_table(v.spark, path)


def mapping_path(v: Views) -> str:
    """A mapping file, with a comment and a line too short to count."""
    rows = v.mapping.select(F.col("atom_id").alias("at"), F.concat_ws(" ", "atom_id", "bead_id", F.col("weight").cast("string"), "bead_type").alias("line"))
    return part_files(rows.union(rows_of(v.spark, [(-1, "# bead map"), (-1, "x")], "at long, line string")), "mapping")


@query(with_views("mapfile") + "select atom_id, bead_id, weight, bead_type from mapfile")
def mapping_rows(v: Views) -> DataFrame:
    return files.read_mapping_file(v.spark, mapping_path(v))


@query(with_views("atoms") + "select id, mol as bead_id from atoms where type in (1, 3)")
def map_source_group(v: Views) -> DataFrame:
    return mapping.restrict(mapping.molecule_map(v.atoms), groups_of(v, g="type:1,3").ids("g")).select("id", "bead_id")


# --- runs ---------------------------------------------------------------------------------------------------------


def config(v: Views, path: str, **measured: dict) -> Config:
    """A run over a dump at path, which writes beside the settled files."""
    cfg = Config().update("general", input=path, dt=DT, output_dir=follow.scratch(v.spark, "out"), hash_input=False)
    for name, values in measured.items():
        cfg.update(f"measure.{name}", **values)
    return cfg


_EXACT = {"type": "msd", "block_size": BLOCK, "output": "m.dat"}


def loaded(v: Views, results: sinks.Results, name: str = "m") -> DataFrame:
    return series(results.load_frame(v.spark, name))


@query(sql_msd())
def run_msd(v: Views) -> DataFrame:
    """A run with a mapping: beads never change what a measure sees."""
    cfg = config(v, write_dump(v, atom_columns(**UNWRAPPED)), m=_EXACT).define(mapping={"mode": "by_mol"})
    return loaded(v, run.run(v.spark, cfg))


@query(sql_msd(members="where r.id in (select id from atoms where type = 1 and mol between 1 and 5)", views=("atoms",)))
def run_msd_combined(v: Views) -> DataFrame:
    cfg = config(v, write_dump(v, atom_columns(**UNWRAPPED)), m=_EXACT | {"group": "both"}).define(groups={"ones": "type:1", "few": "mol:1-5", "both": "ones & few"})
    return loaded(v, run.run(v.spark, cfg))


def grown(v: Views) -> tuple[str, str]:
    """A dump that ends in the middle of its eleventh frame, and the folder of the whole."""
    whole = part_files(dump_frames(v, atom_columns(x="x", y="y", z="z", ix="0", iy="0", iz="0")), "growing")
    frames = ranges.index_dump(v.spark, whole).frames.filter("frame = 10").select("file", "offset").first()
    before = sum(size for _, size in ranges.files_of(whole)[: frames["file"]])
    return one_file(whole, f"{follow.scratch(v.spark, 'grown')}/t.dump", before + frames["offset"] + 120), whole


@query(sql_msd())
def run_stream_msd(v: Views) -> DataFrame:
    """A run that keeps a checkpoint while the dump is short, and one that takes it up and flushes every eight frames."""
    path, whole = grown(v)
    state = follow.scratch(v.spark, "state")
    run.run(v.spark, config(v, path, m=_EXACT).update("general", checkpoint_out=state))
    one_file(whole, path)
    return loaded(v, run.run(v.spark, config(v, path, m=_EXACT).update("general", checkpoint_out=state, resume_from=state, flush_every_frames=8)))


@query(_SEL + ", s as (select f.frame, count(w.id) as n_selected from (select distinct frame from traj) f left join wrapped w on w.frame = f.frame and w.x between 1 and 8 and w.type = 2 group by f.frame) select frame as frame_index, n_selected from s")
def run_stream_sizes(v: Views) -> DataFrame:
    """Two measures in one pass; an inline selector with a region follows the frames."""
    path, whole = grown(v)
    cfg = config(v, one_file(whole, path), m=_EXACT, s={"type": "selection_size", "group": "type:2;region:slab,x,1,8"}).update("general", flush_every_seconds=1e-3)
    return run.run(v.spark, cfg).load_frame(v.spark, "s").select(F.col("frame_index").cast("long"), F.col("n_selected").cast("long"))


@query(_TRAJ + _POSITIONS)
def follow_positions(v: Views) -> DataFrame:
    path, whole = grown(v)
    spot = follow.scratch(v.spark, "followed")
    for _ in range(2):
        follow.land(v.spark, path, f"{spot}/out", f"{spot}/state", range_bytes=4096)
        one_file(whole, path)
    follow.land(v.spark, path, f"{spot}/out", f"{spot}/state", range_bytes=4096)
    return r8(v.spark.read.schema(follow.FIELDS).parquet(f"{spot}/out/*"))


@query(_TRAJ + _POSITIONS + " where frame between 5 and 20")
def dump_frame_range(v: Views) -> DataFrame:
    """A filter on the frame reaches the source, which reads the bytes of those frames."""
    index = ranges.index_dump(v.spark, write_dump(v, atom_columns(**UNWRAPPED)), range_bytes=1 << 16)
    return r8(ranges.scan_dump(v.spark, index, ["frame", "timestep", "id", "x", "y", "z"]).filter("frame between 5 and 20"))


@query(_TRAJ + _POSITIONS)
def dump_small_ranges(v: Views) -> DataFrame:
    """Ranges far smaller than a frame: each frame is parsed by many tasks."""
    return r8(dump.read_dump(v.spark, write_dump(v, atom_columns(**UNWRAPPED)), range_bytes=2048).positions)


@query(sql_msd())
def stream_msd_exact(v: Views) -> DataFrame:
    spot = follow.scratch(v.spark, "stream")
    correlate.without_drift(v.positions).select("frame", "timestep", "id", "x", "y", "z").repartitionByRange(4, "frame").write.parquet(f"{spot}/in")
    return series(follow.stream_correlation(follow.follow_folder(v.spark, f"{spot}/in"), spec(), f"{spot}/pairs", f"{spot}/state"))


# --- results and audits -------------------------------------------------------------------------------------------

_DEFINED = {"few": "mol:1-5", "near": "selection_mode:dynamic; type:2; region:slab,x,1,8", "ones": "type:1"}


@query(_SEL + ", sizes as (select f.frame, count(w.id) as k from (select distinct frame from traj) f left join wrapped w on w.frame = f.frame and w.x between 1 and 8 and w.type = 2 group by f.frame) select 'all' as name, count(*) as low, count(*) as high from atoms union all select 'few', count(*), count(*) from atoms where mol <= 5 union all select 'ones', count(*), count(*) from atoms where type = 1 union all select 'near', min(k), max(k) from sizes")
def index_groups(v: Views) -> DataFrame:
    cfg = config(v, write_dump(v, atom_columns(**UNWRAPPED)), s={"type": "selection_size", "group": "ones"}).define(groups=_DEFINED)
    audits = run.run(v.spark, cfg).index["groups"]["atom_groups"]
    size = lambda x: (x["min"], x["max"]) if isinstance(x, dict) else (x, x)
    return rows_of(v.spark, [(a["name"], *size(a["size"])) for a in audits], "name string, low long, high long")


@query(with_views("degree") + ", ends as (select id from atoms join degree on node = idx where degree = 1) select 'A=ones;T=ends;combine=A&!T' as key, count(*) as size from atoms where type = 1 and id not in (select id from ends) union all select 'A=all;T=all;combine=A', count(*) from atoms union all select 'A=twos;T=all;combine=A', count(*) from atoms where type = 2")
def index_combined(v: Views) -> DataFrame:
    """The selections of two measures and of their drifts, over all particles and over a group."""
    bonds = follow.scratch(v.spark, "bonds")
    v.bonds.select(F.concat_ws(" ", "type", "ai", "aj")).write.text(bonds)
    ends = {"group": "ones", "topo_group": "ends", "combine": "A & !T"}
    cfg = config(v, write_dump(v, atom_columns(**UNWRAPPED)), m=_EXACT | ends, n=_EXACT | ends | {"drift_group": "twos", "output": "n.dat"}).define(groups={"ones": "type:1", "twos": "type:2"}, topo_groups={"ends": "atoms_is_end"}).update("topology", file=bonds, format="bond_table")
    found = run.run(v.spark, cfg).index["groups"]["combined_selections"]
    return rows_of(v.spark, [(x["key"], x["size"]) for x in found], "key string, size long")


@query(with_views("edges", "mapfile") + ", beads as (select distinct least(a.bead_id, b.bead_id) as u, greatest(a.bead_id, b.bead_id) as v from bonds join mapfile a on a.atom_id = ai join mapfile b on b.atom_id = aj where a.bead_id <> b.bead_id) select 'Bonds' as item, count(*) as n from edges union all select 'bond_graph', count(*) from edges where type in (1, 2) union all select 'beads', count(distinct bead_id) from mapfile union all select 'mapped', count(*) from mapfile union all select 'bead_bonds', count(*) from beads")
def index_topology(v: Views) -> DataFrame:
    cfg = config(v, write_dump(v, atom_columns(**UNWRAPPED)), s={"type": "selection_size"}).define(mapping={"mode": "file"}, mapping__file={"path": mapping_path(v)})
    cfg.update("topology", **{"file": data_file(v), "format": "data", "load": "bonds,masses", "bond_graph.bond_types": "1,2"})
    found = run.run(v.spark, cfg).index["run"]
    return rows_of(v.spark, [("Bonds", found["topology"]["Bonds"]), ("bond_graph", found["bond_graph"]["edges"]), ("beads", found["mapping"]["beads"]), ("mapped", found["mapping"]["atoms"]), ("bead_bonds", found["mapping"]["bead_bonds"])], "item string, n long")


@query(with_views("atoms") + "select mol, count(*) as n from atoms group by mol")
def dataset_by_columns(v: Views) -> DataFrame:
    """A table of a caller's own columns, written in an order of its own and read back."""
    path = f"{follow.scratch(v.spark, 'dataset')}/d.dat"
    made = sinks.Dataset(["n", "mol"]).column("n", "atoms", "atoms of the molecule").column("mol", "", "molecule")
    sinks.write_dataset(path, v.atoms.groupBy("mol").agg(F.count("*").alias("n")), made, ["molecules"])
    return v.spark.read.schema("n long, mol long").option("sep", " ").option("comment", "#").csv(path).select("mol", "n")


# --- extension surface --------------------------------------------------------------------------------------------


@query(_SEL + " select frame, id from wrapped where x between 1 and 8 and type = 2")
def sel_inline_region(v: Views) -> DataFrame:
    """An unnamed selector with a region follows the frames."""
    ctx = measures.Context(v.positions, v.atoms, DT, groups_of(v))
    return ctx.atom_members("type:2;region:slab,x,1,8")


@query(_SEL + " select frame, id from wrapped where type = 2 and mol between 1 and 5")
def sel_inline_static(v: Views) -> DataFrame:
    return measures.Context(v.positions, v.atoms, DT, groups_of(v)).atom_members("type:2;mol:1-5")


@query(_SEL + " select 'a' as name, count(*) as n from atoms where type = 1 union all select 'b', count(*) from atoms where type = 1 or id between 1 and 40 union all select 'c', count(*) from atoms where id between 1 and 40")
def sel_expression_rule(v: Views) -> DataFrame:
    """A definition with a colon is a selector, any other an expression over groups."""
    g = groups_of(v, a="type:1", b="a | c", c="id:1-40")
    out = None
    for name in "abc":
        one = g.ids(name).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.union(one)
    return out


@query(with_views("atoms") + "select 'A=ones;T=all;combine=A&T' as key, true as again, id from atoms where type = 1")
def selection_cache(v: Views) -> DataFrame:
    """A combined selection is planned once for each key."""
    ctx = measures.Context(v.positions, v.atoms, DT, groups_of(v, ones="type:1"))
    ids = ctx.static_ids("ones", "all", " A & T")
    return ids.select(F.lit(next(iter(ctx._selections))).alias("key"), F.lit(ctx.static_ids("ones", "all", "A&T") is ids).alias("again"), "id")


@query(with_views("traj") + "select frame, round(sum(x), 6) as total from traj where id % 3 = 0 group by frame")
def reduce_fixed_order(v: Views) -> DataFrame:
    ctx = measures.Context(v.positions, v.atoms, DT, groups_of(v, ones="type:1"))
    return ctx.total(ctx.static_ids("ones"), "x", fixed_order=True).select("frame", F.round("sum", 6).alias("total"))


@query(with_views("samples") + "select round(sum(value), 4) as total from samples")
def ordered_sum(v: Views) -> DataFrame:
    return stats.ordered_sum(v.samples, "value", ["i"]).select(F.round("sum", 4).alias("total"))


@query(sql_msd(drift=False, axes="x").replace("(c.x-o.x)*(c.x-o.x)", "c.x*o.x"))
def correlate_own_pair(v: Views) -> DataFrame:
    """A caller's function of two samples: the product of the x coordinates."""
    return series(correlate.exact(v.positions, spec(), lambda cur, org: cur["x"] * org["x"]))


@query(with_views("traj") + "select id, frame // 2 as k, round(x, 8) as x from traj where frame % 2 = 0")
def correlate_own_average(v: Views) -> DataFrame:
    """A caller's coarse sample of two neighbours: the first of them."""
    return r8(correlate.coarse_levels(v.positions, 2, lambda a, b: a).filter("level = 1").select("id", "k", "x"))


@query(with_views("bonds", "mapfile") + ", beads as (select bead_id, row_number() over (order by bead_id) - 1 as bead from (select distinct bead_id from mapfile)) select distinct least(p.bead, q.bead) as u, greatest(p.bead, q.bead) as v from bonds join mapfile a on a.atom_id = ai join mapfile b on b.atom_id = aj join beads p on p.bead_id = a.bead_id join beads q on q.bead_id = b.bead_id where p.bead <> q.bead")
def graph_of_beads(v: Views) -> DataFrame:
    beads = mapping.file_map(v.mapping, v.atoms)
    ctx = measures.Context(v.positions, v.atoms, DT, None, mapping=beads, bead_edges=mapping.bead_edges(v.bonds, beads))
    return ctx.graph()[1].select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))

