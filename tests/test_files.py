"""Files, settings and runs that no table feeds: faults of dumps, byte ranges, growth, guards, sinks and plans."""

from __future__ import annotations

import contextlib
import io
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetrail.functions.hashing import file_fingerprint, fnv1a, hex16
from kinetrail.operators import correlate, mapping, spectral
from kinetrail.operators.correlate import CorrelatorSpec
from kinetrail.plans import measures, run
from kinetrail.sources import dump, ranges, sinks
from kinetrail.sources.ini import Config, ConfigError
from kinetrail.streaming import follow


def frame(step, ids, header="id type xu yu zu", row="{} 1 0 0 0", n=None, box="pp pp pp\n0 20\n0 4\n0 3"):
    return f"ITEM: TIMESTEP\n{step}\nITEM: NUMBER OF ATOMS\n{len(ids) if n is None else n}\nITEM: BOX BOUNDS {box}\nITEM: ATOMS {header}\n" + "".join(row.format(i) + "\n" for i in ids)


FAULTS = {
    "atoms_change": (frame(0, [1, 2]) + frame(1, [1]), "number of atoms changes"),
    "bad_number": (frame(0, [1, 2], row="{} 1 0 0x 0"), "not a number in yu"),
    "header_changes": (frame(0, [1, 2]) + frame(1, [1, 2], "id type zu yu xu"), "header changes"),
    "junk_first": ("hello\n" + frame(0, [1, 2]), "does not begin"),
    "negative_id": (frame(0, [1, -2]), "negative or repeats"),
    "no_frame": ("\n", "no complete first frame"),
    "no_positions": (frame(0, [1, 2], "id type xs ys zs"), "positions need"),
    "repeated_id": (frame(0, [1, 1]), "negative or repeats"),
    "short_row": (frame(0, [1, 2], row="{} 1 0 0"), "don't match the header"),
    "too_long": (frame(0, [1, 2, 3], n=2), "incomplete or malformed"),
    "truncated": (frame(0, [1, 2], n=3), "incomplete or malformed"),
    "unknown_id": (frame(0, [1, 2]) + frame(1, [1, 3]), "unknown id"),
}


@pytest.mark.parametrize("fault", FAULTS)
def test_faulty_dumps_are_refused(spark, tmp_path, fault):
    (tmp_path / "d").write_text(FAULTS[fault][0])
    with pytest.raises(Exception, match=FAULTS[fault][1]):
        dump.read_dump(spark, str(tmp_path / "d"), range_bytes=64).positions.count()


def random_dump(r, frames, atoms):
    """Text and rows of a dump with image flags, in a tilted cell, ids in another order in each frame."""
    text, rows = "", []
    for f in range(frames):
        ids = r.sample(range(1, atoms + 1), atoms)
        lines = [(i, r.randint(1, 3), r.uniform(0, 9), r.uniform(0, 9), r.uniform(0, 9), r.randint(-2, 2), r.randint(-2, 2), r.randint(-2, 2)) for i in ids]
        text += f"ITEM: TIMESTEP\n{f * 5}\nITEM: NUMBER OF ATOMS\n{atoms}\nITEM: BOX BOUNDS xy xz yz pp pp pp\n0 13 2\n0 10 0\n0 9 1\nITEM: ATOMS id type x y z ix iy iz\n"
        text += "".join(" ".join(map(str, x)) + r.choice(("\n", " \n", "\n\n" if r.random() < 0.1 else "\n")) for x in lines)
        # The bounding box less the tilts: xy 2, xz 0, yz 1.
        rows += [(f, f * 5, i, x + a * 11 + b * 2 + c * 0, y + b * 9 + c * 1, z + c * 9) for i, _, x, y, z, a, b, c in lines]
    return text, sorted(rows)


@pytest.mark.parametrize("size", [7, 50, 333, 1 << 20])
def test_ranges_of_any_size_give_the_same_rows(spark, tmp_path, size):
    text, want = random_dump(random.Random(1), 4, 9)
    (tmp_path / "d").write_text(text)
    t = dump.read_dump(spark, str(tmp_path / "d"), range_bytes=size)
    got = sorted(map(tuple, t.positions.collect()))
    assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3:] for g in got], [w[3:] for w in want], atol=1e-12)
    first = [int(line.split()[0]) for line in text.split("ITEM: ATOMS")[1].split("\n")[1:] if len(line.split()) == 8]
    assert [r["id"] for r in t.atoms.orderBy("idx").collect()] == first and t.frames.count() == 4
    # The same in two files, cut between frames.
    (tmp_path / "two").mkdir()
    at = text.index("ITEM: TIMESTEP", 10)
    (tmp_path / "two" / "a").write_text(text[:at])
    (tmp_path / "two" / "b").write_text(text[at:])
    assert sorted(map(tuple, dump.read_dump(spark, str(tmp_path / "two"), range_bytes=size).positions.collect())) == got


def test_small_ranges_share_tasks(spark, tmp_path):
    """The number of tasks is bounded while the ranges are small, a frame still has several, and the index has each range."""
    text, want = random_dump(random.Random(5), 6, 60)
    (tmp_path / "d").write_text(text)
    index = ranges.index_dump(spark, str(tmp_path / "d"), 16)
    assert index.ranges.count() == -(-len(text) // 16) > 1000
    rows = ranges.scan_dump(spark, index, ["frame", "timestep", "id"])
    most = ranges.TASKS * spark.sparkContext.defaultParallelism
    assert 6 * 6 < rows.rdd.getNumPartitions() <= 2 * most
    assert sorted(map(tuple, rows.collect())) == [w[:3] for w in want]


def test_small_ranges_of_a_growing_dump_share_files(spark, tmp_path):
    """A batch settles its rows in a bounded number of files, however small the ranges."""
    text, want = random_dump(random.Random(6), 5, 60)
    path = tmp_path / "d"
    path.write_text(text)
    first, atoms = dump.first_particles(spark, str(path))
    seen = []
    each = follow.each_batch(spark, str(path), first, atoms, follow.Positions(str(tmp_path / "p")), lambda rows, *_: seen.append((len(rows.inputFiles()), sorted((r[0], r[1], r[2]) for r in rows.collect()))), range_bytes=32)
    each(spark.createDataFrame([(0, len(text))], follow.RANGES), 0)
    assert seen[0][1] == [w[:3] for w in want] and seen[0][0] <= 2 * 16 * spark.sparkContext.defaultParallelism < len(text) // 32


def test_filters_on_frames_read_their_bytes_alone(spark, tmp_path):
    text, want = random_dump(random.Random(2), 12, 6)
    (tmp_path / "d").write_text(text)
    index = ranges.index_dump(spark, str(tmp_path / "d"), 100)
    for condition, keep in (("frame between 3 and 4", lambda f: 3 <= f <= 4), ("frame = 11", lambda f: f == 11), ("frame > 9 and id <> 2", lambda f: f > 9), ("frame in (1, 5)", lambda f: f in (1, 5)), ("frame = 99", lambda f: False), ("frame < 0", lambda f: False), ("frame <= 0", lambda f: f == 0)):
        df = ranges.scan_dump(spark, index, ["frame", "id", "x"]).filter(condition)
        got = sorted((r[0], r[1]) for r in df.collect())
        assert got == [(f, i) for f, _, i, *_ in want if keep(f) and not ("id" in condition and i == 2)], condition
    plan = ranges.scan_dump(spark, index, ["frame", "x"]).filter("frame between 3 and 4")._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "GreaterThanOrEqual(frame,3)" in plan and "ReadSchema: struct<frame:bigint,x:double>" in plan
    options = {"path": index.path, "tables": json.dumps([index.ranges._settled_at, index.frames._settled_at]), "files": json.dumps(index.files), "names": json.dumps(index.names), "first": "3", "last": "4"}
    planned = ranges.RangeReader(ranges.scan_dump(spark, index).schema, options).partitions()
    begin, end = (len("ITEM: TIMESTEP".join(text.split("ITEM: TIMESTEP")[: k + 1])) for k in (3, 5))
    assert min(p.begin for p in planned) == begin and max(p.end for p in planned) == end


def test_lines_of_a_range(tmp_path):
    from pyarrow import fs

    r = random.Random(4)
    text = "".join("x" * r.randint(0, 9) + "\n" for _ in range(60)) + "end"
    (tmp_path / "t").write_text(text)
    with fs.LocalFileSystem().open_input_file(str(tmp_path / "t")) as f:
        for size in (1, 5, 17, 1000):
            got = b"".join(ranges.lines_of(f, a, a + size)[0] for a in range(0, len(text), size))
            assert got.decode() == text


def test_growth_is_landed_once(spark, tmp_path):
    text, want = random_dump(random.Random(3), 6, 5)
    path, out = tmp_path / "g", str(tmp_path / "out")
    cuts = [len(text) // 2, len(text) // 2 + 3, len(text) - 4, len(text)]
    for cut in cuts:
        path.write_text(text[:cut])
        follow.land(spark, str(path), out, str(tmp_path / "state"), range_bytes=64)
        got = sorted(map(tuple, spark.read.schema(follow.FIELDS).parquet(f"{out}/*").collect()))
        begins = [k for k in range(len(text)) if text.startswith("ITEM: TIMESTEP", k)] + [len(text)]
        whole = sum(a + len(text[a:b].rstrip("\n")) < cut for a, b in zip(begins, begins[1:]))
        assert [g[:3] for g in got] == [w[:3] for w in want if w[0] < whole]
    # A batch that is repeated leaves what it had finished.
    first, atoms = dump.first_particles(spark, str(path))
    calls = []
    each = follow.each_batch(spark, str(path), first, atoms, follow.Positions(str(tmp_path / "p")), lambda rows, low, n, number: calls[-1].append((low, n, number, rows.count())), most=4)
    for number, end in ((0, cuts[0]), (1, cuts[3]), (1, cuts[3])):
        calls.append([])
        each(spark.createDataFrame([(0, end)], follow.RANGES), number)
    assert calls[1] == calls[2] and [n for _, n, *_ in calls[0]] + [n for _, n, *_ in calls[1]] in ([3, 3], [2, 4]) and all(rows == 5 * n for c in calls for _, n, _, rows in c)


def test_growing_dumps_are_checked(spark, tmp_path):
    path = tmp_path / "g"
    for later in (frame(1, [1, 3]), frame(1, [1, 1]), frame(1, [1]), frame(1, [1, 2], "id type zu yu xu"), frame(1, [1, 2], row="{} 1 0x 0 0")):
        path.write_text(frame(0, [1, 2]) + later + frame(2, [1, 2]))
        with pytest.raises(Exception):
            follow.land(spark, str(path), str(tmp_path / "o"), str(tmp_path / f"s{abs(hash(later))}"))


# --- the Fourier correlator ---------------------------------------------------------------------------------------


def test_summed_squares_equal_pairs():
    r = np.random.default_rng(1)
    for frames in (2, 3, 17, 64):
        x = r.standard_normal((5, frames, 3)).cumsum(axis=1) + 1e3
        want = [((x[:, k:] - x[:, :-k]) ** 2).sum() for k in range(1, frames)]
        assert np.allclose(spectral.summed_squares(x), want, rtol=1e-9)


def walk(spark, frames, particles, step=lambda f: 10 * f + f % 3, gap=None):
    r = np.random.default_rng(2)
    at = r.standard_normal((particles, frames, 3)).cumsum(axis=1)
    rows = [(i, f, step(f), *map(float, at[i, f])) for i in range(particles) for f in range(frames) if (i, f) != gap]
    return spark.createDataFrame(rows, "id long, frame long, timestep long, x double, y double, z double").repartition(4)


@pytest.mark.parametrize("numbers", [1 << 20, 100])
def test_fft_equals_exact(spark, monkeypatch, numbers):
    monkeypatch.setattr(spectral, "KERNEL_NUMBERS", numbers)
    for kind in ({}, {"lag_stride": 3, "components": "xz"}, {"axis": "timestep"}, {"axis": "timebin", "timebin_width": 35.0}, {"axis": "timebin", "timebin_width": 25.0, "min_pairs_per_bin": 30}):
        rows = walk(spark, 20, 7, (lambda f: 10 * f + f % 3) if "axis" not in kind else (lambda f: 10 * f))
        fast, slow = ([tuple(r) for r in correlate.correlate(rows, CorrelatorSpec(kind=k, block_size=0, **kind)).orderBy("lag").collect()] for k in ("fft", "exact"))
        assert np.allclose(fast, slow, rtol=1e-9) and len(fast) == len(slow) > 0


def test_fft_refuses_what_it_can_not_average(spark):
    for rows, kind in ((walk(spark, 9, 3, gap=(1, 4)), {}), (walk(spark, 9, 3, gap=(1, 8)), {}), (walk(spark, 9, 3, lambda f: 5 * f + f % 2), {"axis": "timestep"}), (walk(spark, 9, 3, lambda f: 7), {}), (walk(spark, 9, 3).filter("frame <> 4"), {}), (walk(spark, 9, 3).union(walk(spark, 9, 1)), {})):
        with pytest.raises(Exception, match="fft correlator"):
            correlate.correlate(rows, CorrelatorSpec(kind="fft", **kind)).collect()
    with pytest.raises(ValueError):
        CorrelatorSpec(kind="fft", block_size=4)
    with pytest.raises(ValueError):
        correlate.correlate(walk(spark, 3, 1), CorrelatorSpec(kind="fft"), lambda a, b: a["x"])
    assert correlate.correlate(walk(spark, 1, 3), CorrelatorSpec(kind="fft")).collect() == []


# --- settings, sinks, plans ---------------------------------------------------------------------------------------


def test_settings_read_and_written():
    c = Config.parse("; a comment\n[general]\ndt = 1\ninput = 'a;b'\ndt=2 \n# another\n[groups]\nends = \"mol:1, 2\"\n[measure.m]\nenabled = off\n")
    assert [(s, k, x) for s in c.sections for k, x in c.section(s).items()] == [("general", "dt", "2"), ("general", "input", "a;b"), ("groups", "ends", "mol:1, 2"), ("measure.m", "enabled", "off")]
    c = Config().define(measure__a={"type": "msd"}, groups={"g": "type:1,2"}).update("general", dt=0.5, profile=True)
    assert c.to_ini().rstrip("\n").split("\n") == ["[general]", "dt = 0.5", "profile = true", "", "[groups]", "g = type:1,2", "", "[measure.a]", "type = msd"]


def test_checkpoints_are_guarded(tmp_path):
    meta = {"config": "a", "input": "x"}
    follow.guard(str(tmp_path / "s"), meta)
    follow.guard(str(tmp_path / "s"), meta)
    for other in ({"input": "y"}, {"config": "b"}):
        with pytest.raises(ValueError):
            follow.guard(str(tmp_path / "s"), meta | other)


def test_fingerprints(tmp_path):
    def plain(data):
        h = 1469598103934665603
        for b in data:
            h = (h ^ b) * 1099511628211 % 2**64
        return f"{h:016x}"

    for text in (b"", b"AFRICA 0", bytes(range(256))):
        assert hex16(fnv1a(text)) == plain(text)
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "b").write_bytes(b"two")
    (tmp_path / "d" / "a").write_bytes(b"one")
    (tmp_path / "d" / "_SUCCESS").write_bytes(b"x")
    assert file_fingerprint(str(tmp_path / "d")) == plain(b"onetwo")
    assert mapping.specification("AA", "by_mol", "com_mass", "g")[1] == plain(b"model_scale=AA;mode=by_mol;position=com_mass;source_group=g;file_hash_fnv1a64=")


def test_text_tables_and_indexes(tmp_path):
    path = str(tmp_path / "t.dat")
    for rows, dry in (([(1, 2.5)], False), ([(9, 9)], True), ([(3, "x")], False)):
        sinks.TextTable(path, ["sizes"], append=True, dry=dry).write(rows)
    assert open(path).read() == "# sizes\n1 2.5\n3 x\n"
    notes = {"a": 'a"\\\né', "b": "漢\t"}
    sinks.write_index(str(tmp_path / "results.json"), {"notes": notes})
    assert json.loads((tmp_path / "results.json").read_text(encoding="utf-8"))["notes"] == notes


def test_datasets_are_written_in_order_by_tasks(spark, tmp_path):
    path = f"file://{tmp_path}/d.dat"
    rows = spark.range(1000).repartition(7).select((999 - F.col("id")).alias("k"), (F.col("id") * 0.5).alias("x"))
    assert sinks.write_dataset(path, rows, [{"name": "k"}, {"name": "x"}], ["note"]) == 1000
    want = "# note\n# k x\n" + "".join(f"{k} {(999 - k) * 0.5:.17g}\n" for k in range(1000))
    assert (tmp_path / "d.dat").read_text() == want and [x.name for x in tmp_path.iterdir()] == ["d.dat"]
    assert sinks.write_dataset(path, rows.limit(0), [{"name": "k"}], [], append=True) == 0 and (tmp_path / "d.dat").read_text() == want
    sinks.write_dataset(path, spark.range(2).withColumnRenamed("id", "k"), [{"name": "k"}], [], append=True)
    assert (tmp_path / "d.dat").read_text() == want + "0\n1\n"
    # A write that fails leaves the old file, and nothing beside it.
    broken = rows.select(F.when(F.col("k") == 500, F.raise_error(F.lit("broken")).cast("long")).otherwise(F.col("k")).alias("k"))
    with pytest.raises(Exception, match="broken"):
        sinks.write_dataset(path, broken, [{"name": "k"}], [])
    assert (tmp_path / "d.dat").read_text() == want + "0\n1\n" and [x.name for x in tmp_path.iterdir()] == ["d.dat"]


@pytest.mark.parametrize("values,good", [({}, True), ({"axis": "timebin", "timebin_width": 2.0}, True), ({"axis": "timestep"}, True), ({"kind": "fft"}, True), ({"kind": "multitau"}, True), ({"kind": "multitau", "channels": 5}, False), ({"kind": "multitau", "axis": "timestep"}, False), ({"axis": "x"}, False), ({"components": "q"}, False), ({"axis": "timestep", "lag_stride": 2}, False), ({"dt": 0.0}, False)])
def test_correlator_settings(values, good):
    with contextlib.nullcontext() if good else pytest.raises(ValueError):
        CorrelatorSpec(**values)


def test_registered_measures_and_the_command_line():
    from kinetrail.__main__ import main

    shipped = {k: m.capabilities for k, m in measures.REGISTRY.items() if k in ("msd", "selection_size")}
    assert {k: (c.group_keys, c.dynamic_selection) for k, c in shipped.items()} == {"msd": (("group", "drift_group"), False), "selection_size": (("group",), True)}
    said = io.StringIO()
    with contextlib.redirect_stdout(said):
        assert main(["--list-measures"]) == 0
    assert {"msd", "selection_size"} <= set(said.getvalue().split())


def test_what_a_validation_says(spark, tmp_path):
    (tmp_path / "d").write_text(frame(0, [1, 2]) + frame(1, [2, 1]))
    parsed = dump.read_dump(spark, str(tmp_path / "d"))
    cases = {"bad_combine": {"type": "msd", "combine": "A &"}, "bad_group": {"type": "msd", "group": "nobody"}, "dynamic_msd": {"type": "msd", "group": "region:slab,x,1,8"}, "fft_blocks": {"type": "msd", "correlator": "fft", "block_size": 5}, "unheard": {"type": "unheard"}}
    base = Config().update("general", input=str(tmp_path / "d"), dt=1.0)
    for name, values in cases.items():
        with pytest.raises((ConfigError, ValueError)):
            run.plan(spark, base.copy().update(f"measure.{name}", **values), "/", dry=True, traj=parsed)
    for values in ({"type": "msd", "block_size": 2}, {"type": "msd", "correlator": "fft"}):
        assert run.plan(spark, base.copy().update("measure.m", **values), "/", dry=True, traj=parsed)["measures"][0]["frame"].columns == correlate.SERIES


def test_layout_of_an_index_and_its_selections(spark, tmp_path):
    (tmp_path / "d").write_text(frame(0, [1, 2]) + frame(1, [2, 1]))
    cfg = Config().update("general", input=str(tmp_path / "d"), dt=1.0, output_dir=str(tmp_path / "out")).define(groups={"one": "id:1"}, measure__s={"type": "selection_size"}, measure__m={"type": "msd", "block_size": 0, "drift_group": "one"}, measure__k={"type": "msd", "block_size": 0, "remove_drift": False, "output": "k.dat"}, measure__f={"type": "msd", "correlator": "fft", "output": "f.dat"})
    results = run.run(spark, cfg)
    assert set(results.index) == {"groups", "measures", "profiling", "run", "schema_version", "version", "warnings"} and {"config_hash", "dt", "frames", "input", "mapping", "scale"} <= set(results.index["run"])
    assert results.index["schema_version"] == "1.0" and results.dataset_columns("s") == ["frame_index", "n_selected"]
    assert {x["key"]: x["size"] for x in results.index["groups"]["combined_selections"]} == {"A=all;T=all;combine=A": 2, "A=all;T=all;combine=A&T": 2, "A=one;T=all;combine=A": 1}
    assert results.find_measure("m")["drift_selection"] == "A=one;T=all;combine=A" and results.find_measure("m")["n_selected"] == 2 and results.load_table("k") == results.load_table("f")


def test_choice_of_a_graph(spark):
    edges = spark.range(1)
    held = {"nothing": {}, "bonds": {"edges": edges}, "filtered": {"edges": edges, "bond_edges": edges}, "all": {"edges": edges, "bond_edges": edges, "bead_edges": edges}}
    for wanted, name, source in (("auto", "all", "bead_graph"), ("auto", "bonds", "topology_graph"), ("auto", "filtered", "bond_graph"), ("auto", "nothing", "none"), ("bond_graph", "all", "bond_graph")):
        assert measures.Context(edges, edges, 1.0, None, **held[name]).graph_source(wanted) == source
    with pytest.raises(ConfigError):
        measures.Context(edges, edges, 1.0, None, **held["bonds"]).graph_source("bead_graph")
