"""Hand-computed cases of the trajectory operators, files and streams."""

from __future__ import annotations

import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from kinetrail.functions import geometry, stats
from kinetrail.functions.hashing import fnv1a, hex16
from kinetrail.operators import correlate, graph, mapping
from kinetrail.operators.correlate import CorrelatorSpec
from kinetrail.plans import measures, run, selection, topology
from kinetrail.sources import dump, sinks
from kinetrail.sources import topology as files
from kinetrail.sources.ini import Config, ConfigError
from kinetrail.streaming import follow

# Three frames of four particles; the middle one lists them in another order.
FRAMES = [
    [(1, 0, 0, 0), (2, 1, 0, 0), (3, 0, 1, 0), (4, 1, 1, 0)],
    [(4, 2, 1, 0), (2, 1, 1, 0), (1, 1, 0, 0), (3, 0, 2, 0)],
    [(1, 2, 0, 0), (2, 2, 1, 0), (3, 0, 3, 0), (4, 3, 1, 0)],
]
KIND = {1: 1, 2: 1, 3: 2, 4: 2}


def frame_text(n: int, rows, header="id type mol xu yu zu", row=None) -> str:
    row = row or (lambda r: f"{r[0]} {KIND[r[0]]} {KIND[r[0]]} {r[1]} {r[2]} {r[3]}")
    return f"ITEM: TIMESTEP\n{n}\nITEM: NUMBER OF ATOMS\n{len(rows)}\nITEM: BOX BOUNDS pp pp pp\n0 10\n0 10\n0 10\nITEM: ATOMS {header}\n" + "".join(row(r) + "\n" for r in rows)


@pytest.fixture()
def dump_file(tmp_path):
    path = tmp_path / "t.dump"
    path.write_text("".join(frame_text(i, f) for i, f in enumerate(FRAMES)))
    return str(path)


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_dump_and_exact_msd(spark, dump_file):
    t = dump.read_dump(spark, dump_file)
    assert [tuple(r) for r in t.atoms.orderBy("idx").collect()] == [(0, 1, 1, 1), (1, 2, 1, 1), (2, 3, 2, 2), (3, 4, 2, 2)]
    got = [tuple(r) for r in correlate.msd(t.positions, CorrelatorSpec(block_size=2)).orderBy("lag").collect()]
    assert got == [(1.0, 1.0, 0.4375, 2, 0.0, 1, 1.0), (2.0, 2.0, 1.375, 1, 0.0, 0, 2.0)]
    joined = correlate.exact(correlate.without_drift(t.positions), CorrelatorSpec(block_size=2), tiled=False)
    assert [tuple(r) for r in joined.orderBy("lag").collect()] == got


def test_wrapped_triclinic_and_extra_fields(spark, tmp_path):
    text = "ITEM: TIMESTEP\n5\nITEM: NUMBER OF ATOMS\n1\nITEM: BOX BOUNDS xy xz yz pp pp pp\n0 13 2\n0 5 1\n0 3 1\nITEM: ATOMS id x y z ix iy iz q\n7 1 1 1 1 1 1 0.5\n"
    (tmp_path / "w.dump").write_text(text)
    t = dump.read_dump(spark, str(tmp_path / "w.dump"))
    b = t.frames.first()["box"]
    assert (b["xlo"], b["xhi"], b["ylo"], b["yhi"]) == (0.0, 10.0, 0.0, 4.0)  # bounds hold the tilts 2, 1, 1
    assert [tuple(r) for r in t.positions.collect()] == [(0, 5, 7, 1 + 10 + 2 + 1.0, 1 + 4 + 1.0, 4.0, 0.5)]
    assert t.extras == ["q"]


@pytest.mark.parametrize("text", [
    frame_text(0, FRAMES[0])[:-12],
    frame_text(0, FRAMES[0]) + frame_text(1, FRAMES[1][:3]),
    frame_text(0, FRAMES[0]) + frame_text(1, [(1, 0, 0, 0)] * 4),
    frame_text(0, FRAMES[0]) + frame_text(1, FRAMES[1], "id mol type xu yu zu"),
    frame_text(0, FRAMES[0], "id type xs ys zs"),
    frame_text(0, FRAMES[0]).replace("1 1 1 0 0 0", "1 1 1 0x 0 0"),
])
def test_bad_dumps_fail(spark, tmp_path, text):
    (tmp_path / "b.dump").write_text(text)
    with pytest.raises((dump.DumpError, PySparkException)):
        dump.read_dump(spark, str(tmp_path / "b.dump")).positions.collect()


def signal(spark, steps):
    return table(spark, [(1, f, ts, float(f * f), 0.0, 0.0) for f, ts in enumerate(steps)], "id long, frame long, timestep long, x double, y double, z double")


class Particle:
    """One particle's levels: the last m samples of each and the sample that waits for its neighbour."""

    def __init__(self, m: int, levels: int, axes: str = "xyz"):
        self.m, self.levels = m, levels
        self.at = ["xyz".index(a) + 1 for a in axes]
        self.rings = [[] for _ in range(levels)]
        self.waiting = [None] * levels
        self.next = [0] * levels

    def push(self, sample: list, level: int, out: list) -> None:
        k = self.next[level]
        self.next[level] += 1
        ring = self.rings[level]
        low = 1 if level == 0 else self.m // 2 + 1
        for d in range(low, self.m + 1):
            if d <= len(ring):
                org = ring[-d]
                if sample[0] > org[0]:
                    out.append((level, d, k, k - d, sample[0] - org[0], sum((sample[a] - org[a]) ** 2 for a in self.at)))
        ring.append(sample)
        del ring[: -self.m]
        if level + 1 < self.levels:
            if self.waiting[level] is None:
                self.waiting[level] = sample
            else:
                first, self.waiting[level] = self.waiting[level], None
                half = [int(first[0] / 2) + int(sample[0] / 2), *((a + b) * 0.5 for a, b in zip(first[1:], sample[1:]))]
                self.push(half, level + 1, out)


def stream_emulation(steps, m, levels):
    """Multi-tau pairs pushed one sample at a time."""
    p = Particle(m, levels)
    out = []
    for f, ts in enumerate(steps):
        p.push([ts, float(f * f), 0.0, 0.0], 0, out)
    return sorted((d * 2**level, cur, dts, v) for level, d, cur, org, dts, v in out)


@pytest.mark.parametrize("n", [5, 28])
def test_multi_tau_equals_streaming_emulation(spark, n):
    steps = [10 * f + f % 3 for f in range(n)]
    spec = CorrelatorSpec(kind="multitau", channels=4, levels=3, block_size=0)
    rows = {}
    for lag, _, dts, v in stream_emulation(steps, 4, 3):
        rows.setdefault(float(lag), []).append((dts, v))
    got = {r["lag"]: r for r in correlate.multi_tau(signal(spark, steps), spec).collect()}
    assert set(got) == set(rows)
    for lag, pairs in rows.items():
        assert got[lag]["count_pairs"] == len(pairs)
        assert math.isclose(got[lag]["msd"], sum(v for _, v in pairs) / len(pairs)) and math.isclose(got[lag]["mean_dtimestep"], sum(d for d, _ in pairs) / len(pairs))


def test_axes_agree_on_even_steps_and_backward_steps_drop(spark):
    s = signal(spark, range(0, 60, 10))
    by_frame = correlate.exact(s, CorrelatorSpec(block_size=0)).orderBy("lag").collect()
    by_step = correlate.exact(s, CorrelatorSpec(axis="timestep", block_size=0)).orderBy("lag").collect()
    assert [(r["msd"], r["count_pairs"]) for r in by_frame] == [(r["msd"], r["count_pairs"]) for r in by_step]
    assert [r["count_pairs"] for r in correlate.exact(signal(spark, [0, 10, 5]), CorrelatorSpec(block_size=0)).orderBy("lag").collect()] == [1, 1]


def test_merge_backward(spark):
    spec = CorrelatorSpec(axis="timebin", timebin_width=1.0, min_pairs_per_bin=4, block_size=0)
    got = correlate.exact(signal(spark, [0, 1, 2, 3]), spec).orderBy("lag").collect()
    assert [r["count_pairs"] for r in got] == [6]  # bins of 3, 2 and 1 pairs: 3 and 2 meet forward, the last joins them backward


@pytest.mark.parametrize("bad", [{"kind": "fft", "block_size": 3}, {"axis": "x"}, {"kind": "multitau", "axis": "timestep"}, {"channels": 3}, {"axis": "timestep", "lag_stride": 2}, {"components": "q"}, {"dt": 0}])
def test_bad_specs(bad):
    with pytest.raises((ValueError, NotImplementedError)):
        CorrelatorSpec(**bad)


def test_minimum_image_rounds_half_to_even(spark):
    box = geometry.Box((0.0, 0.0, 0.0), (10.0, 10.0, 10.0))
    df = table(spark, [(5.0,), (15.0,), (-5.0,), (25.0,)], "d double")
    assert [r[0] for r in df.select(geometry.minimum_image(box, F.col("d"), F.lit(0.0), F.lit(0.0))[0]).collect()] == [5.0, -5.0, -5.0, 5.0]
    with pytest.raises(ValueError):
        geometry.Box((0.0, 0.0, 0.0), (0.0, 1.0, 1.0))


def test_wrap_inverts_cell_shifts(spark):
    box = geometry.Box((1.0, 2.0, 3.0), (11.0, 8.0, 7.0), 2.0, 1.0, 0.5)
    df = table(spark, [(3.0, 4.0, 5.0)], "x double, y double, z double")
    moved = geometry.unwrap(box, F.col("x"), F.col("y"), F.col("z"), F.lit(2), F.lit(-1), F.lit(3))
    back = df.select(*geometry.wrap(box, *moved)).first()
    assert all(math.isclose(a, b) for a, b in zip(back, (3.0, 4.0, 5.0)))


@pytest.fixture()
def world(spark, dump_file):
    t = dump.read_dump(spark, dump_file)
    return t.atoms, t.positions, geometry.Box((0.0, 0.0, 0.0), (10.0, 10.0, 10.0))


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_static_and_dynamic_groups(world):
    g = selection.Groups({"near": "region:slab,x,1.5,9", "moving": "selection_mode:dynamic;region:slab,x,1.5,9", "one": "type:1", "mix": "selection_mode:dynamic; moving & one", "none": "id:"}, *world)
    assert ids(g.ids("near")) == [] and ids(g.ids("one")) == [1, 2] and ids(g.ids("none")) == []
    assert sorted((r["frame"], r["id"]) for r in g.members("moving").collect()) == [(1, 4), (2, 1), (2, 2), (2, 4)]
    assert sorted((r["frame"], r["id"]) for r in g.members("mix").collect()) == [(2, 1), (2, 2)]
    assert sorted(tuple(r) for r in g.sizes("moving").collect()) == [(0, 0), (1, 1), (2, 3)]


@pytest.mark.parametrize("defs", [{"a": "b", "b": "a"}, {"a": "b|", "b": "type:1"}, {"a": "d", "d": "selection_mode:dynamic;region:slab,x,0,1"}, {"a": "missing & missing"}, {"a": "region:cone,1"}, {"a": "colour:1"}, {"a": "type:one"}, {"a": "!b", "b": "type:1"}])
def test_bad_groups(world, defs):
    with pytest.raises(selection.SelectionError):
        selection.Groups(defs, *world)


def test_combinations():
    assert selection.selection_key("x", "y", " a & ( t | !A ) ") == "A=x;T=y;combine=A&(T|!A)"
    assert selection.selection_key("x", "y", "") == "A=x;T=y;combine=A&T"
    for bad in ("A &", "B", "(A", "A T"):
        with pytest.raises(selection.SelectionError):
            selection.parse_combine(bad)
    assert selection.inline_is_dynamic("region:slab,x,0,1;type:1") and not selection.inline_is_dynamic("type:1")


@pytest.fixture()
def shapes(spark):
    """A chain 0-1-2, a ring 3-4-5, a star around 6, two linked rings 10..14, and 15 alone."""
    edges = [(0, 1), (1, 2), (3, 4), (4, 5), (3, 5), (6, 7), (6, 8), (6, 9), (10, 11), (11, 12), (10, 12), (12, 13), (13, 14), (12, 14), (1, 0)]
    return table(spark, [(i,) for i in range(16)], "node long"), table(spark, [(1, *e) for e in edges], "type int, u long, v long")


def test_polymers_and_chains(shapes):
    nodes, edges = shapes
    tags = [r["tag"] for r in graph.polymer_components(nodes, edges).orderBy("component").collect()]
    assert tags == ["linear", "ring", "branched", "network", "other"]
    assert tuple(graph.polymer_tag(graph.polymer_components(nodes, edges)).first()) == ("mixed", "branched,linear,network,ring")
    assert sorted(tuple(r) for r in graph.chains_from_linear(nodes, edges).collect()) == [(1, 0, 0), (1, 1, 1), (1, 2, 2), (5, 0, 15)]
    with pytest.raises(ValueError):
        graph.chains_from_linear(nodes, edges, strict=True)
    assert tuple(graph.summary(nodes, edges).first()) == (16, 14, 5, 5, 2, 3)


def test_bfs_and_topology_groups(shapes):
    nodes, edges = shapes
    hops = {r["node"]: r["hops"] for r in graph.distances(nodes, edges, nodes.filter("node in (0, 3)")).collect()}
    assert [hops[i] for i in (0, 1, 2, 3, 4, 5, 6, 15)] == [0, 1, 2, 0, 1, 1, -1, -1]
    one = lambda d: sorted(r["node"] for r in topology.topo_group(d, nodes, edges, lambda g: nodes.filter("node in (0, 6)")).collect())
    assert one("atoms_is_end") == [0, 2, 7, 8, 9] and one("atoms_degree_is 0" if False else "atoms_degree_is:0") == [15]
    assert one("atoms_in_component_size>=4") == [6, 7, 8, 9, 10, 11, 12, 13, 14] and one("atoms_incident_to_group(g)") == [1, 7, 8, 9]
    with pytest.raises(selection.SelectionError):
        one("atoms_in_component_size<3")
    with pytest.raises(ValueError):
        graph.components(nodes.filter("node < 3"), edges)


@pytest.mark.parametrize("block", [1024, 2])
def test_contacts_match_brute_force(spark, monkeypatch, block):
    import random

    monkeypatch.setattr(graph, "CELL_BLOCK", block)
    r = random.Random(3)
    points = [(i, r.uniform(0, 8), r.uniform(0, 6), r.uniform(0, 5)) for i in range(150)]
    df = table(spark, points, "node long, x double, y double, z double")
    got = {tuple(x) for x in graph.contacts(df, 0.9).collect()}
    assert got == {(a[0], b[0]) for a in points for b in points if a[0] < b[0] and math.dist(a[1:], b[1:]) <= 0.9}
    box = geometry.Box((0.0, 0.0, 0.0), (8.0, 6.0, 2.0))

    def near(a, b):
        d = [p - q for p, q in zip(a[1:], b[1:])]
        d = [x - round(x / e) * e for x, e in zip(d, (8.0, 6.0, 2.0))]
        return sum(x * x for x in d) <= 0.81

    found = [tuple(x) for x in graph.contacts(df, 0.9, box).collect()]
    assert set(found) == {(a[0], b[0]) for a in points for b in points if a[0] < b[0] and near(a, b)} and len(found) == len(set(found))


def test_one_cell_that_holds_all_points_is_spread(spark, monkeypatch):
    monkeypatch.setattr(graph, "CELL_BLOCK", 16)
    df = spark.range(200).select(F.col("id").alias("node"), *((F.col("id") * 0.001 + 0.1).alias(c) for c in "xyz"))
    met = graph.contacts(df, 10.0)
    assert met.count() == met.distinct().count() == 199 * 100
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "block" in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_spanning(spark):
    labels = table(spark, [(0, 0), (1, 0), (2, 1)], "node long, component long")
    at = table(spark, [(0, 0.0, 1.0, 0.0), (1, 9.9999999, 2.0, 0.0), (2, 5.0, 5.0, 5.0)], "node long, x double, y double, z double")
    got = {r["component"]: tuple(r)[1:] for r in graph.spanning(labels, at, geometry.Box((0.0, 0.0, 0.0), (10.0, 10.0, 10.0))).collect()}
    assert got == {0: (True, False, False), 1: (False, False, False)}


def test_mapping_edges(spark, world):
    atoms, positions, _ = world
    rows = table(spark, [(1, 10, 0.0, None), (2, 10, 0.0, None), (3, 20, 1.0, 5)], "atom_id long, bead_id long, weight double, bead_type int")
    m = mapping.file_map(rows, atoms)
    beads = {r["bead_id"]: tuple(r)[2:] for r in mapping.bead_positions(positions.filter("frame = 0"), m).collect()}
    assert beads == {10: (0.0, 0.0, 0.0), 20: (0.0, 1.0, 0.0)}  # no weight: the origin
    assert {r["bead_id"]: r["bead_type"] for r in m.collect()} == {10: 0, 20: 5}
    values = table(spark, [(10, 4.0), (20, 6.0)], "bead_id long, value double")
    assert sorted(tuple(r) for r in mapping.back_extensive(atoms, m, values, -1.0).collect()) == [(1, 2.0), (2, 2.0), (3, 6.0), (4, -1.0)]
    for bad in ([(9, 1, 1.0, None)], [(1, 1, -1.0, None)], [(1, 1, 1.0, None), (1, 2, 1.0, None)], [(1, 1, 1.0, 1), (2, 1, 1.0, 2)]):
        with pytest.raises(ValueError):
            mapping.file_map(table(spark, bad, "atom_id long, bead_id long, weight double, bead_type int"), atoms)


def test_statistics(spark):
    df = table(spark, [(i, float(x)) for i, x in enumerate([-1, 0, 0.5, 9.9999, 10, 3, 3])] + [(9, float("nan"))], "i long, v double")
    assert {r["bin"]: r["weight"] for r in stats.histogram(df, "v", 0, 10, 5).collect()} == {-1: 1.0, 0: 2.0, 1: 2.0, 2: 0.0, 3: 0.0, 4: 1.0, 5: 1.0}
    one = table(spark, [(4.0,)], "v double")
    assert tuple(stats.mean_and_variance(one, "v").first()) == (1, 4.0, 0.0, 0.0, 0.0, 0.0)
    assert tuple(stats.size_statistics(one, "v").first()) == (1, 4.0, 4.0, 4.0, 0.0)
    numbers = table(spark, [(i, float(i)) for i in range(11)], "i long, v double").repartition(4)
    got = stats.block_summary(stats.blocks(numbers, "v", ["i"], 3)).first()
    assert got["n_blocks"] == 3 and got["mean"] == 4.0 and math.isclose(got["variance"], 9.0)
    assert stats.log_edges(1, 100, 2)[1] == pytest.approx(10)


def test_running_statistics_take_values_in_order(spark, tmp_path):
    """The result is that of adding the values by event_id, however the rows lie in the files."""
    from kinetrail.plans.catalog import QUERIES

    values = [1e16, 1.0, -1e16, 1.0]
    rows = [(i, u, v) for u in (7, 8) for i, v in enumerate(values, u * 10)]
    table(spark, rows[::-1], "event_id long, user_id long, value double").repartition(2, F.col("event_id") % 2).write.parquet(str(tmp_path / "events.parquet"))
    got = {r["user"]: (r["n"], r["mean"]) for r in QUERIES["running_mean_var"](spark, str(tmp_path)).collect()}
    assert got == {7.0: (4, 0.25), 8.0: (4, 0.25)}
    with pytest.raises(ValueError):
        stats.mean_and_variance(table(spark, rows, "i long, u long, v double"), "v", None, ["i"])


@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_numbers_are_gapless_beyond_the_range_sample(spark, coalesce):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    try:
        n = 1_200_000
        df = spark.range(0, n, 1, 6).select(F.xxhash64("id").alias("k"), F.col("id").cast("string").alias("payload"))
        got = stats.numbered_globally(df, ["k"], "i")
        assert got.columns == ["k", "payload", "i"]
        seen = got.agg(F.count("*"), F.countDistinct("i"), F.min("i"), F.max("i"), F.countDistinct("k")).first()
        assert tuple(seen) == (n, n, 0, n - 1, n)
        # In order: a number's key is the smallest of those at and after it.
        ends = got.groupBy((F.col("i") / 1000).cast("long").alias("b")).agg(F.min("k").alias("low"), F.max("k").alias("high")).orderBy("b").collect()
        assert all(a["high"] < b["low"] for a, b in zip(ends, ends[1:]))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_fingerprints_of_files():
    assert mapping.specification()[1] == "23cd01ddafd5c96c" and hex16(fnv1a(b"")) == "14650fb0739d0383"


def test_topology_files(spark, tmp_path):
    (tmp_path / "bonds").write_text("1 2 # a bond\n7 2 3\n1 9 3 4\n# none\n5\n")
    assert sorted(tuple(r) for r in files.read_bond_table(spark, str(tmp_path / "bonds")).collect()) == [(0, 1, 2), (7, 2, 3), (9, 3, 4)]
    (tmp_path / "data").write_text("title\n\n4 atoms\n\nMasses\n\n1 12.0 # C\n2 1.0\n1 13.0\n\nBonds\n\n1 1 1 2\n2 2 2 3\n\nAngles\n\n1 1 1 2 3\n\nImpropers\n")
    got = files.read_data_file(spark, str(tmp_path / "data"), ["Masses", "Bonds", "Angles", "Impropers"])
    assert sorted(tuple(r) for r in got["Masses"].collect()) == [(1, 13.0), (2, 1.0)]
    assert sorted(tuple(r) for r in got["Bonds"].collect()) == [(1, 1, 2), (2, 2, 3)] and [tuple(r) for r in got["Angles"].collect()] == [(1, 1, 2, 3)] and got["Impropers"].count() == 0
    with pytest.raises(files.TopologyError):
        files.read_data_file(spark, str(tmp_path / "data"), ["Dihedrals"])
    (tmp_path / "map").write_text("1 10\n2 10 2.5\n3 20 1 4\nx\n")
    assert sorted(tuple(r) for r in files.read_mapping_file(spark, str(tmp_path / "map")).collect()) == [(1, 10, 1.0, None), (2, 10, 2.5, None), (3, 20, 1.0, 4)]


def test_configuration():
    c = Config.parse("[general]\n; no\n# no\ninput = 'a;b'\ndt=1\ndt = 2 \n[measure.m]\nenabled = off\nlist = a, b\n")
    assert c.get("general", "input") == "a;b" and c.get_float("general", "dt") == 2.0 and not c.get_bool("measure.m", "enabled") and c.get_list("measure.m", "list") == ["a", "b"]
    assert Config.parse(c.to_ini()).sections == c.sections
    for bad in ("x = 1", "[a\n", "[a]\nnothing"):
        with pytest.raises(ConfigError):
            Config.parse(bad)
    built = Config().update("general", dt=1.0, profile=True).define(groups={"a": "type:1"}, measure__msd={"group": "a"})
    assert built.get("general", "profile") == "true" and built.copy().sections == built.sections


def test_run_and_validate(spark, dump_file, tmp_path):
    (tmp_path / "bonds").write_text("1 2\n3 4\n")
    cfg = Config().update("general", input=dump_file, dt=1.0, output_dir=str(tmp_path / "out")).update("topology", file=str(tmp_path / "bonds"), format="bond_table")
    cfg.define(groups={"poly": "type:1"}, topo_groups={"ends": "atoms_is_end"}, measure__msd_all={"type": "msd", "block_size": 2, "output": "msd.dat"}, measure__size={"type": "selection_size", "group": "region:slab,x,1.5,9"})
    assert [m["instance"] for m in run.validate(spark, cfg)["measures"]] == ["msd_all", "size"] and not (tmp_path / "out").exists()
    results = run.run(spark, cfg)
    assert results.load_table("msd_all") == [[1, 1, 0.4375, 2, 0, 1, 1], [2, 2, 1.375, 1, 0, 0, 2]]
    assert results.load_table("selection_size") == [[0, 0], [1, 1], [2, 3]] and results.index["polymer_classifier"] == {"graph_source": "bond_graph", "tag": "linear", "tags": ["linear"]}
    assert results.load_frame(spark, "msd_all").count() == 2 and results.index["run"]["frames"] == 3
    assert sinks.Results(str(tmp_path / "out")).find_measure("msd")["n_selected"] == 4
    with pytest.raises(ConfigError):
        run.validate(spark, cfg.copy().update("measure.other", type="unheard"))
    with pytest.raises(ConfigError):
        run.validate(spark, cfg.copy().update("measure.m2", type="msd", group="region:slab,x,0,1"))
    assert "m3" in [m["instance"] for m in run.validate(spark, cfg.copy().update("measure.m3", type="msd", correlator="fft"))["measures"]]
    off = Config({k: v for k, v in cfg.sections.items() if not k.startswith("measure.")})
    assert run.run(spark, off) is None


def test_registering_measures():
    @measures.register_measure("just_a_test")
    def build(ctx, cfg, section):
        return {}

    with pytest.raises(ValueError):
        measures.register_measure("just_a_test")(build)
    del measures.REGISTRY["just_a_test"]


def test_follow_a_growing_dump(spark, tmp_path):
    path = tmp_path / "g.dump"
    whole = [frame_text(i, f) for i, f in enumerate(FRAMES)]
    for spec in (CorrelatorSpec(kind="multitau", channels=2, levels=1, block_size=0), CorrelatorSpec(block_size=2)):
        at = [str(tmp_path / f"{x}-{spec.kind}") for x in ("pairs", "state")]
        landed = str(tmp_path / f"landed-{spec.kind}")

        def followed(spec=spec, at=at, landed=landed, name=str(path)):
            follow.land(spark, str(path), landed, f"{landed}-state", range_bytes=100)
            return follow.stream_correlation(follow.follow_folder(spark, f"{landed}/*"), spec, *at, name)

        path.write_text(whole[0] + whole[1] + whole[2][:40])
        assert [(r["lag"], r["count_pairs"]) for r in followed().collect()] == [(1.0, 1)]
        path.write_text("".join(whole))
        want = correlate.correlate(dump.read_dump(spark, str(path)).positions, spec).orderBy("lag").collect()
        assert [tuple(r) for r in followed().orderBy("lag").collect()] == [tuple(r) for r in want]
        with pytest.raises(ValueError):
            followed(CorrelatorSpec(kind=spec.kind, channels=4, levels=1), name=str(path) + "x")


def run_config(path, out, **general) -> Config:
    cfg = Config().update("general", input=str(path), dt=1.0, output_dir=str(out), **general)
    return cfg.define(measure__m={"type": "msd", "block_size": 2, "output": "m.dat"}, measure__t={"type": "msd", "correlator": "multitau", "mt_channels": 2, "mt_levels": 1, "output": "t.dat"}, measure__s={"type": "selection_size", "group": "region:slab,x,1.5,9"})


def test_run_as_a_stream_resumes(spark, tmp_path):
    path, whole = tmp_path / "g.dump", [frame_text(i, f) for i, f in enumerate(FRAMES)]
    path.write_text("".join(whole))
    want = run.run(spark, run_config(path, tmp_path / "batch"))
    path.write_text(whole[0] + whole[1][:60])
    one = run.run(spark, run_config(path, tmp_path / "one", checkpoint_out=str(tmp_path / "state")))
    assert one.load_table("s") == [[0, 0]] and one.index["run"]["frames"] == 1
    path.write_text("".join(whole))
    two = run.run(spark, run_config(path, tmp_path / "two", resume_from=str(tmp_path / "state"), checkpoint_out=str(tmp_path / "state2"), flush_every_frames=1))
    for name in ("m", "t", "s"):
        assert two.load_table(name) == want.load_table(name)
    assert two.index["run"]["frames"] == 3 and "fnv1a64" in two.index["run"]["input"]
    with pytest.raises(ValueError):  # another measure's settings
        run.run(spark, run_config(path, tmp_path / "two", resume_from=str(tmp_path / "state2")).update("measure.m", block_size=3))


def test_a_run_takes_up_a_checkpoint_of_the_first_format(spark, tmp_path):
    import json

    path, state, whole = tmp_path / "g.dump", tmp_path / "state", [frame_text(i, f) for i, f in enumerate(FRAMES)]
    path.write_text("".join(whole))
    want = run.run(spark, run_config(path, tmp_path / "batch"))
    path.write_text(whole[0] + whole[1])
    run.run(spark, run_config(path, tmp_path / "one", checkpoint_out=str(state)))
    header = json.loads((state / "m" / "run_meta.json").read_text())
    assert (header["magic"], header["type"], header["instance"]) == ("kinetrail-state", "msd", "m")
    # As the first format had it: batches in ten digits, offsets of bytes and frames, no positions, no headers of states.
    for folder in ("marks", "frames", "m", "s"):
        for x in (state / folder).iterdir():
            x.rename(x.with_name(f"{int(x.name):010d}")) if x.name.isdigit() else x.unlink()
    (state / "marks" / "0000000007").write_text("1")  # a batch that was never committed
    for x in (state / "positions").iterdir():
        x.unlink()
    for x in [*(state / "offsets" / "offsets").iterdir(), *(state / "offsets" / "commits").iterdir()]:
        x.unlink()
    (state / "offsets" / "offsets" / "0").write_text('v1\n{}\n' + json.dumps({"byte": len(whole[0] + whole[1]), "frame": 2}))
    (state / "offsets" / "commits" / "0").write_text('v1\n{}')
    meta = json.loads((state / "run_meta.json").read_text())
    (state / "run_meta.json").write_text(json.dumps(meta | {"version": 1}))
    path.write_text("".join(whole))
    two = run.run(spark, run_config(path, tmp_path / "two", resume_from=str(state), checkpoint_out=str(state)))
    for name in ("m", "t", "s"):
        assert two.load_table(name) == want.load_table(name)
    assert two.index["run"]["frames"] == 3 and json.loads((state / "run_meta.json").read_text())["version"] == 2
    again = run.run(spark, run_config(path, tmp_path / "three", resume_from=str(state), checkpoint_out=str(state)))
    assert again.load_table("m") == want.load_table("m")


def test_parts_of_a_followed_run_are_merged(spark, tmp_path, monkeypatch):
    path, state, whole = tmp_path / "g.dump", tmp_path / "state", [frame_text(i, f) for i, f in enumerate(FRAMES)]
    path.write_text("".join(whole))
    want = run.run(spark, run_config(path, tmp_path / "batch"))
    monkeypatch.setattr(run, "COMPACT", 2)
    path.write_text(whole[0] + whole[1])
    run.run(spark, run_config(path, tmp_path / "one", checkpoint_out=str(state), flush_every_frames=1))
    first, second = (f"{n:016d}" for n in (0, 1))
    merged = f"{first}_{second}_1"
    names = lambda kind: {x.name for x in (state / kind).iterdir() if x.name[0] not in "._r"}
    assert names("marks") == names("frames") == {first, second}  # parts of one batch, merged once it is committed
    path.write_text("".join(whole))
    two = run.run(spark, run_config(path, tmp_path / "two", resume_from=str(state), checkpoint_out=str(state)))
    third = f"{run.MOST_PARTS:016d}"
    assert names("marks") == names("frames") == names("m") == {merged, third}
    assert len(names("positions")) == 2 and two.index["run"]["frames"] == 3
    # A merge that ended before its parts were deleted: they don't count, and go with the next one.
    (state / "marks" / first).write_text("1")
    assert sorted(run._State(str(state)).marks()) == [merged, third]
    for name in ("m", "t", "s"):
        assert two.load_table(name) == want.load_table(name)
    again = run.run(spark, run_config(path, tmp_path / "three", resume_from=str(state), checkpoint_out=str(state)))
    assert again.load_table("m") == want.load_table("m") and again.index["run"]["frames"] == 3


def test_tiers_of_merged_parts(spark, tmp_path, monkeypatch):
    """Nine batches at two a tier: no row is lost or met twice, whatever tier it is in."""
    monkeypatch.setattr(run, "COMPACT", 2)
    state, marks = run._State(str(tmp_path)), {}
    for n in range(9):
        state.compact(spark, marks, {"v": "n long"}, n)
        part = f"{n:016d}"
        spark.range(n, n + 1).toDF("n").write.parquet(state.place("v", part))
        state.mark(part, 1)
        marks[part] = 1
        assert state.marks() == marks and sum(marks.values()) == n + 1
        assert sorted(r.n for r in state.read(spark, "v", sorted(marks), "n long").collect()) == list(range(n + 1))
    assert len(marks) <= 3 and {x.name for x in (tmp_path / "v").iterdir()} == set(marks)


def test_follow_until_told_to_stop(spark, tmp_path):
    import threading

    path, stop = tmp_path / "g.dump", threading.Event()
    path.write_text(frame_text(0, FRAMES[0]))

    def grow():
        for i in (1, 2):
            with open(path, "a") as f:
                f.write(frame_text(i, FRAMES[i]))
        for _ in range(240):
            seen = (tmp_path / "out" / "results.json").exists() and sinks.Results(str(tmp_path / "out")).index["run"]["frames"]
            if seen == 3 or stop.wait(0.5):
                break
        stop.set()

    writer = threading.Thread(target=grow)
    writer.start()
    got = run.run(spark, run_config(path, tmp_path / "out", follow=True, flush_every_seconds=0.01), stop=stop)
    writer.join()
    assert got.index["run"]["frames"] == 3 and got.load_table("m") == [[1, 1, 0.4375, 2, 0, 1, 1], [2, 2, 1.375, 1, 0, 0, 2]] and "fnv1a64" not in got.index["run"]["input"]


def test_datasets_and_fixed_order_sums(spark, tmp_path):
    spec = sinks.Dataset(["v"]).column("i", "frames", "number").column("v", "A")
    with pytest.raises(ValueError):
        spec.column("v")
    df = table(spark, [(1, 2.0), (2, 1.0)], "i long, v double")
    assert sinks.write_dataset(str(tmp_path / "d"), df, spec, ["note"]) == 2
    assert (tmp_path / "d").read_text() == "# note\n# i(frames)\tv(A)\n2 1\n1 2\n"
    with pytest.raises(ValueError):
        sinks.write_dataset(str(tmp_path / "d"), df.select("i"), spec, [])
    values = [(i, 0.1 * (i % 7) + 1e9 * (i % 3)) for i in range(3000)]
    many = table(spark, values, "i long, v double")
    parts = [math.fsum(()) for _ in range(3)]
    for i, v in values:
        parts[i // stats.FOLD] += v
    want = 0.0
    for x in parts:
        want += x
    assert all(stats.ordered_sum(many.repartition(k), "v", ["i"]).first()[0] == want for k in (1, 5))
    assert [tuple(r) for r in stats.ordered_sums(many.withColumn("k", F.lit(4)), "v", "k", "i").collect()] == [(4, want)]
    assert stats.ordered_sum(many.limit(0), "v", ["i"]).first()[0] == 0.0


def test_components_and_hops_in_rounds_and_in_a_task(spark, shapes, monkeypatch):
    from kinetrail.operators import components

    nodes, edges = shapes
    small = [sorted(map(tuple, f.collect())) for f in (components.connected_components(edges), graph.distances(nodes, edges, nodes.filter("node in (0, 3)")))]
    monkeypatch.setattr(components, "TASK_EDGES", 0)
    monkeypatch.setattr(graph, "TASK_EDGES", 0)
    assert [sorted(map(tuple, f.collect())) for f in (components.connected_components(edges), graph.distances(nodes, edges, nodes.filter("node in (0, 3)")))] == small


@pytest.mark.parametrize("rows_a_call,frames", [(40, 1 << 10), (1 << 18, 3), (7, 4), (1 << 18, 1)])
def test_gaps_in_the_tiled_kernel(spark, monkeypatch, rows_a_call, frames):
    monkeypatch.setattr(correlate, "KERNEL_ROWS", rows_a_call)
    monkeypatch.setattr(correlate, "TILE_FRAMES", frames)
    rows = [(i, f, 10 * f, float(i * f), float((f * 7 + i) % 5), 1.0) for i in range(9) for f in range(11) if (i * 3 + f) % 4]
    s = table(spark, rows, "id long, frame long, timestep long, x double, y double, z double").repartition(3)
    near = lambda rows: [(r["lag"], r["count_pairs"], round(r["msd"], 9)) for r in rows]
    for stride in (1, 2):
        spec = CorrelatorSpec(block_size=0, lag_stride=stride, components="xy")
        assert near(correlate.exact(s, spec).orderBy("lag").collect()) == near(correlate.exact(s, spec, tiled=False).orderBy("lag").collect())
    pairs = lambda f: sorted((r["cur"], r["org"], round(r["v"], 9)) for r in f(s, lambda a, b: a["x"] * b["y"] - 1.0, 1, 5).collect())
    assert pairs(correlate.frame_pairs_tiled) == pairs(correlate.frame_pairs) and len(pairs(correlate.frame_pairs)) > 20
    assert correlate.on_arrays(lambda a, b: a["x"] * b["y"]) and not correlate.on_arrays(lambda a, b: F.sqrt(a["x"]))


def folded_plainly(rows, least):
    bins = []
    for row in rows:
        if bins and bins[-1][1] < least:
            bins[-1] = [a + b for a, b in zip(bins[-1], row)]
        else:
            bins.append(list(row))
    if len(bins) > 1 and bins[-1][1] < least:
        last = bins.pop()
        bins[-1] = [a + b for a, b in zip(bins[-1], last)]
    return bins


@pytest.mark.parametrize("seed,n,least", [(1, 1, 5), (2, 60, 20), (3, 60, 1), (4, 61, 1000), (5, 400, 7), (6, 37, 12), (7, 5, 3)])
def test_merged_bins_equal_a_plain_fold(spark, seed, n, least):
    import random

    r = random.Random(seed)
    rows = [(k * 3, float(r.randint(0, 99)), r.choice((1, 2, 3, 30)), r.randint(1, 50), float(r.randint(0, 9)), float(r.randint(90, 99)), r.randint(0, 3)) for k in range(n)]
    base = table(spark, rows, "key long, s double, c long, d long, bs double, bq double, bn long").repartition(3)
    for parts in ("1", "7"):
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            got = [(x["count_pairs"], x["msd"], x["mean_dtimestep"], x["n_blocks"]) for x in correlate.merge_bins(base, least).orderBy("key").collect()]
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        assert got == [(c, s / c, d / c, bn) for s, c, d, _, _, bn in folded_plainly([x[1:] for x in rows], least)]


def test_coarse_averages_may_be_given(spark):
    s = signal(spark, range(0, 80, 10))
    first = correlate.coarse_levels(s, 2, lambda a, b: a).filter("level = 1").orderBy("k").collect()
    assert [r["x"] for r in first] == [float(f * f) for f in (0, 2, 4, 6)]
