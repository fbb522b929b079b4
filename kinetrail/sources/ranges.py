"""Dumps as byte ranges: an index that executors make, and a batch source that parses ranges of it.

The index needs two looks at no more than counts. Each byte range counts the lines that begin in it and notes its
frame marks, with the few header lines behind each (a header may reach beyond its range). Prefix sums over the ranges'
counts then tell every range its first frame and the line of that frame at which it begins, so a frame of any size is
parsed by as many tasks as it has ranges, and none of them holds it. Several files read as if they were one, in order
of their names. Blank lines are nothing.

Ranges may be far smaller than what a task should read: tasks of both looks then take neighbouring ranges together, up to
RANGE_BYTES, while there are TASKS of them a core. A frame is still parsed by as many tasks as its bytes ask for.

The source (`dump_ranges`) plans a partition for each range or run of neighbours. A filter on `frame` is taken over by the source: ranges
outside are not planned, and the first and last are cut at the frames' marks. Only the columns of the schema that is
asked for are made from the tokens.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.dataset
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from ..functions.places import file_system
from ..plans.durable import forget, settle

MARK = re.compile(rb"^ITEM: TIMESTEP[ \t\r]*$", re.MULTILINE)
HEAD_LINES = 9
RANGE_BYTES = 64 << 20
#: Tasks a core below which neighbouring ranges don't share a task.
TASKS = 16
#: Body lines that are split into tokens at once.
CHUNK_LINES = 1 << 16
CORE = ("id", "type", "mol", "molecule", "x", "y", "z", "xu", "yu", "zu", "ix", "iy", "iz")


class DumpError(ValueError):
    pass


def header_columns(line: str) -> list[str]:
    if not line.startswith("ITEM: ATOMS"):
        raise DumpError(f"not an atoms header: {line!r}")
    names = line[len("ITEM: ATOMS") :].split()
    if "id" not in names:
        raise DumpError("the atoms header has no id")
    have = lambda *n: all(x in names for x in n)
    if not (have("xu", "yu", "zu") or have("x", "y", "z", "ix", "iy", "iz")):
        raise DumpError("positions need xu yu zu, or x y z with ix iy iz")
    return names


@dataclass(frozen=True)
class Head:
    """A frame's header: timestep, number of atoms, bounds of the cell (less what tilts add), tilts and columns."""

    timestep: int
    natoms: int
    low: tuple[float, float, float]
    high: tuple[float, float, float]
    tilts: tuple[float, float, float]
    triclinic: bool
    names: tuple[str, ...]


def whole(text: str, kind: type, what: str):
    try:
        return kind(text)
    except ValueError:
        raise DumpError(f"not a number in {what}: {text}") from None


def parse_head(lines: list[str]) -> Head:
    if len(lines) < HEAD_LINES or lines[2].strip() != "ITEM: NUMBER OF ATOMS" or not lines[4].startswith("ITEM: BOX BOUNDS"):
        raise DumpError("an incomplete or malformed frame")
    tilted = "xy xz yz" in lines[4]
    b = [[whole(x, float, "box bounds") for x in lines[k].split()] for k in (5, 6, 7)]
    if any(len(x) < 2 + tilted for x in b):
        raise DumpError("an incomplete or malformed frame")
    xy, xz, yz = (x[2] for x in b) if tilted else (0.0, 0.0, 0.0)
    low = (b[0][0] - min(0.0, xy, xz, xy + xz), b[1][0] - min(0.0, yz), b[2][0])
    high = (b[0][1] - max(0.0, xy, xz, xy + xz), b[1][1] - max(0.0, yz), b[2][1])
    natoms = whole(lines[3], int, "number of atoms")
    if natoms < 0:
        raise DumpError("an incomplete or malformed frame")
    return Head(whole(lines[1], int, "timestep"), natoms, low, high, (xy, xz, yz), tilted, tuple(header_columns(lines[8])))


def lines_of(f: pa.NativeFile, begin: int, end: int) -> tuple[bytes, int]:
    """The lines that begin in [begin, end), whole, and where the first of them begins."""
    size = f.size()
    end = min(end, size)
    at = begin
    if begin > 0 and f.read_at(1, begin - 1) != b"\n":
        while True:
            some = f.read_at(min(1 << 16, size - at), at)
            if not some:
                return b"", size
            spot = some.find(b"\n")
            at += spot + 1 if spot >= 0 else len(some)
            if spot >= 0:
                break
    if at >= end:
        return b"", at
    data = f.read_at(end - at, at)
    more = []
    while not (more[-1] if more else data).endswith(b"\n") and at + len(data) + sum(map(len, more)) < size:
        some = f.read_at(1 << 16, at + len(data) + sum(map(len, more)))
        spot = some.find(b"\n")
        more.append(some if spot < 0 else some[: spot + 1])
    return data + b"".join(more), at


def head_lines(f: pa.NativeFile, at: int) -> list[str]:
    """Up to nine lines that are not blank from byte `at` on."""
    held = b""
    while True:
        some = f.read_at(1 << 12, at + len(held))
        held += some
        found = [x for x in held.split(b"\n")[: None if not some else -1] if x.strip()]
        if len(found) >= HEAD_LINES or not some:
            return [x.decode("utf-8").rstrip("\r") for x in found[:HEAD_LINES]]


def line_starts(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the lines that aren't blank begin, and where each ends (behind its line feed)."""
    if not data:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    x = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(x == 10) + 1
    if not len(ends) or ends[-1] != len(x):
        ends = np.append(ends, len(x))
    starts = np.concatenate([[0], ends[:-1]])
    odd = np.flatnonzero(np.isin(x[starts], (9, 10, 11, 12, 13, 32)))
    blank = [k for k in odd if not data[starts[k] : ends[k]].strip()]
    return np.delete(starts, blank), np.delete(ends, blank)


def scan(path: str, range_bytes: int):
    """(file, name, begin, end) of neighbouring ranges, read at once, to what each of them holds: lines, and marks with
    offset, line within the range and header."""
    kind = pa.list_(pa.struct([("offset", pa.int64()), ("line", pa.int64()), ("head", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(path)
        for batch in batches:
            for number, name, begin, end in zip(*(c.to_pylist() for c in batch.columns)):
                begins = np.arange(begin, end, range_bytes)
                with system.open_input_file(name) as f:
                    data, at = lines_of(f, begin, end)
                    starts, _ = line_starts(data)
                    # The first line of each range, and behind the last.
                    cuts = np.append(np.searchsorted(starts + at, begins), len(starts))
                    spots = np.array([m.start() for m in MARK.finditer(data)], np.int64)
                    marks: list[list[dict]] = [[] for _ in begins]
                    for s, k in zip(spots, np.searchsorted(starts, spots)):
                        own = int(np.searchsorted(begins, at + s, "right")) - 1
                        marks[own].append({"offset": int(at + s), "line": int(k - cuts[own]), "head": "\n".join(head_lines(f, int(at + s)))})
                ends = np.minimum(begins + range_bytes, end)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(begins), number, np.int32)), pa.array(begins), pa.array(ends), pa.array(np.diff(cuts)), pa.array(marks, kind)], ["file", "begin", "end", "lines", "marks"])

    return run


def number(text: Column, kind: str, what: str) -> Column:
    """The whole token as a number, or an error that names the column."""
    value = text.try_cast(kind)
    return F.when(value.isNull(), F.raise_error(F.concat(F.lit(f"not a number in {what}: "), F.coalesce(text, F.lit("nothing"))))).otherwise(value)


def box_struct(lines: Column) -> Column:
    """xlo..zhi, xy, xz, yz and triclinic, with the bounding box of a tilted cell corrected. lines: the bounds' four lines."""
    part = lambda i, k: F.get(F.split(F.trim(F.get(lines, F.lit(1 + i))), r"\s+"), F.lit(k))
    tilted = F.get(lines, F.lit(0)).contains("xy xz yz")
    v = {(i, k): number(part(i, k), "double", "box bounds") for i in range(3) for k in range(2)}
    tilt = [F.when(tilted, part(i, 2).try_cast("double")).otherwise(0.0) for i in range(3)]
    xy, xz, yz = tilt
    zero = F.lit(0.0)
    return F.struct(
        (v[0, 0] - F.least(zero, xy, xz, xy + xz)).alias("xlo"), (v[0, 1] - F.greatest(zero, xy, xz, xy + xz)).alias("xhi"),
        (v[1, 0] - F.least(zero, yz)).alias("ylo"), (v[1, 1] - F.greatest(zero, yz)).alias("yhi"), v[2, 0].alias("zlo"), v[2, 1].alias("zhi"),
        xy.alias("xy"), xz.alias("xz"), yz.alias("yz"), tilted.alias("triclinic"),
    )


@dataclass
class Index:
    """frames: frame, timestep, natoms, box, header, file, offset. The source reads both tables in `ranges` and `frames`.

    `first` and `count` say which frames there are; `stop` is the byte behind the last of them (of a growing file)."""

    path: str
    files: list[str]
    ranges: DataFrame
    frames: DataFrame
    names: list[str]
    first: int
    count: int
    stop: int


def files_of(path: str) -> list[tuple[str, int]]:
    """The files of a path, in order of their names: itself, or what a folder holds but hidden files and marks of writers."""
    system, spot = file_system(path)
    info = system.get_file_info(spot)
    if info.type == fs.FileType.File:
        return [(info.path, info.size)]
    found = system.get_file_info(fs.FileSelector(spot, allow_not_found=True))
    return sorted((x.path, x.size) for x in found if x.type == fs.FileType.File and not x.base_name.startswith(("_", ".")))


def last_line_end(path: str, name: str, begin: int, end: int) -> int:
    """The byte behind the last line feed in [begin, end), or `begin`; read backwards, a little at a time."""
    system, _ = file_system(path)
    with system.open_input_file(name) as f:
        while end > begin:
            size = min(1 << 14, end - begin)
            spot = f.read_at(size, end - size).rfind(b"\n")
            if spot >= 0:
                return end - size + spot + 1
            end -= size
    return begin


def index_dump(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES, growing: bool = False, begin: int = 0, end: int | None = None, first: int = 0, names: list[str] | None = None) -> Index:
    """Two settled tables of the dump's ranges and frames. The driver lists files and sees one header.

    A `growing` file is looked at from byte `begin`, where frame number `first` begins, to `end` at most; a last frame that
    isn't complete is left for later. `names` are the columns of an earlier first frame."""
    files = files_of(path)
    spans = [(k, name, 0, size) for k, (name, size) in enumerate(files)]
    if growing:
        if len(files) > 1:
            raise DumpError("a dump that grows is one file")
        spans = [(k, name, begin, last_line_end(path, name, begin, min(size, size if end is None else end))) for k, name, _, size in spans]
    stop = spans[-1][3] if spans else 0
    listed = spark.createDataFrame(spans, "file int, name string, low long, high long")
    total = sum(-(-(high - low) // range_bytes) for _, _, low, high in spans)
    # Neighbouring ranges that a task reads at once.
    least = TASKS * spark.sparkContext.defaultParallelism
    near = range_bytes * max(1, min(RANGE_BYTES // range_bytes, total // least))
    begins = listed.filter("high > low").select("file", "name", "high", F.explode(F.sequence("low", F.col("high") - 1, F.lit(near).cast("long"))).alias("begin"))
    begins = begins.select("file", "name", "begin", F.least(F.col("begin") + near, "high").alias("end"))
    tasks = max(1, min(total, 4 * spark.sparkContext.defaultParallelism))
    scanned = settle(begins.repartition(tasks, "file", "begin").mapInArrow(scan(path, range_bytes), "file int, begin long, end long, lines long, marks array<struct<offset:long,line:long,head:string>>"), "dump-ranges")

    # A row of counts for each range, in one order; marks and headers stay out of it.
    counts = scanned.select("file", "begin", "end", "lines", F.size("marks").cast("long").alias("n_marks"), F.try_element_at("marks", F.lit(-1)).alias("m"))
    counts = counts.select("file", "begin", "end", "lines", "n_marks", F.col("m.line").alias("mark_line"), F.col("m.offset").alias("mark_offset"))
    before = Window.orderBy("file", "begin").rowsBetween(Window.unboundedPreceding, -1)
    ranges = counts.withColumns({"lines_before": F.coalesce(F.sum("lines").over(before), F.lit(0)), "frames_before": F.coalesce(F.sum("n_marks").over(before), F.lit(0)) + first})
    opened = F.last(F.when(F.col("mark_line").isNotNull(), F.struct((F.col("lines_before") + F.col("mark_line")).alias("line"), "file", F.col("mark_offset").alias("offset"))), ignorenulls=True).over(before)
    ranges = ranges.withColumn("opened", opened).select("file", "begin", "end", "lines", "n_marks", "lines_before", "frames_before", (F.col("lines_before") - F.col("opened.line")).alias("line"), F.col("opened.file").alias("open_file"), F.col("opened.offset").alias("open_offset"))
    ranges = settle(ranges, "dump-index")
    stray = ranges.filter("open_offset is null and lines > 0").join(scanned.select("file", "begin", F.get("marks", F.lit(0)).alias("m")), ["file", "begin"]).filter("m is null or m.line > 0")
    if not stray.isEmpty():
        raise DumpError("a frame does not begin where one should")

    marks = scanned.join(ranges.select("file", "begin", "lines_before", "frames_before"), ["file", "begin"]).select("file", "lines_before", "frames_before", F.posexplode("marks").alias("k", "m"))
    marks = marks.select((F.col("frames_before") + F.col("k")).alias("frame"), (F.col("lines_before") + F.col("m.line")).alias("at"), "file", F.col("m.offset").alias("offset"), F.split("m.head", "\n").alias("lines"))
    all_lines = ranges.agg(F.sum("lines")).first()[0] or 0
    nexts = marks.select((F.col("frame") - 1).alias("frame"), F.col("at").alias("next"))
    marks = marks.join(nexts, "frame", "left").withColumn("held", F.coalesce("next", F.lit(all_lines)) - F.col("at"))
    text = lambda k: F.trim(F.get("lines", F.lit(k)))
    if growing:
        short = F.col("next").isNull() & ((F.col("held") < HEAD_LINES) | (F.col("held") < F.coalesce(text(3).try_cast("long"), F.lit(0)) + HEAD_LINES))
        # The last frame's row alone: where it begins, if it isn't complete.
        cut = marks.filter(short).select("offset").first()
        stop = cut["offset"] if cut is not None else stop
        marks = marks.filter(~short)
    natoms = number(text(3), "long", "number of atoms")
    sound = (F.size("lines") == HEAD_LINES) & (text(2) == "ITEM: NUMBER OF ATOMS") & (F.col("held") == natoms + HEAD_LINES)
    checked = F.when(~sound, F.raise_error(F.lit("an incomplete or malformed frame"))).otherwise(natoms)
    header = F.regexp_replace(F.trim(F.regexp_replace(text(8), "^ITEM: ATOMS", "")), r"\s+", " ")
    frames = marks.select("frame", number(text(1), "long", "timestep").alias("timestep"), checked.cast("long").alias("natoms"), box_struct(F.slice("lines", 5, 4)).alias("box"), header.alias("header"), "file", "offset")
    frames = settle(frames.repartitionByRange(max(1, min(64, total)), "frame").sortWithinPartitions("frame"), "dump-frames")
    head = frames.filter(F.col("frame") == first).select("header").first()
    if head is None and not growing:
        raise DumpError("the dump has no complete first frame")
    if names is None:
        names = header_columns(f"ITEM: ATOMS {head[0]}") if head is not None else []
    forget(scanned)
    return Index(path, [name for name, _ in files], ranges, frames, names, first, frames.count(), stop)


# --- the source ---------------------------------------------------------------------------------------------------


@dataclass
class Range(InputPartition):
    """Lines that begin in [begin, end) of a file. The first mark is frame `next`; before it lie lines of frame next - 1, of
    which the first is line `line` and whose header is at (open_file, open_offset)."""

    file: str
    begin: int
    end: int
    next: int
    line: int | None
    open_file: str | None
    open_offset: int | None


def rows_schema(names: list[str]) -> str:
    extras = "".join(f", `{n}` double" for n in names if n not in CORE)
    return f"frame long, timestep long, pos long, id long, type int, mol long, x double, y double, z double{extras}"


class RangeReader(DataSourceReader):
    """Parses ranges; without pushdown of filters."""

    def __init__(self, schema, options) -> None:
        self.columns = [(f.name, f.dataType.simpleString()) for f in schema.fields]
        self.path, self.where, self.files = options["path"], json.loads(options["tables"]), json.loads(options["files"])
        self.names, self.any_header = tuple(json.loads(options["names"])), options.get("allow_header_change", "false") == "true"
        self.low, self.high = int(options.get("first", 0)), int(options.get("last", -1))
        self.tasks = int(options.get("tasks", 0))

    def partitions(self) -> list[Range]:
        system, spot = file_system(self.where[0])
        rows = pa.dataset.dataset(spot, filesystem=system, format="parquet").to_table().sort_by([("file", "ascending"), ("begin", "ascending")]).to_pylist()
        cuts = self._cuts()
        if cuts is None:
            return []
        lower, upper = cuts
        out = []
        for r in rows:
            begin, end, n, line, opened = r["begin"], r["end"], r["frames_before"], r["line"], (r["open_file"], r["open_offset"])
            if lower is not None and (r["file"], end) <= lower or upper is not None and (r["file"], begin) >= upper:
                continue
            if lower is not None and lower[0] == r["file"] and lower[1] >= begin:
                begin, n, line, opened = lower[1], self.low, None, (None, None)
            if upper is not None and upper[0] == r["file"]:
                end = min(end, upper[1])
            out.append(Range(self.files[r["file"]], begin, end, n, line, None if opened[0] is None else self.files[opened[0]], opened[1]))
        return self._together(out)

    def _together(self, planned: list[Range]) -> list[Range]:
        """Neighbouring ranges as one, up to RANGE_BYTES, while there are more than `tasks` of them (0: as they are)."""
        if not self.tasks or len(planned) <= self.tasks:
            return planned
        most = min(RANGE_BYTES, -(-sum(r.end - r.begin for r in planned) // self.tasks))
        out = planned[:1]
        for r in planned[1:]:
            last = out[-1]
            if r.file == last.file and r.begin == last.end and r.end - last.begin <= most:
                out[-1] = replace(last, end=r.end)
            else:
                out.append(r)
        return out

    def _cuts(self) -> tuple[tuple[int, int] | None, tuple[int, int] | None] | None:
        """(file, offset) at which the wanted frames begin and end; None if there are none."""
        if self.high >= 0 and self.high < self.low:
            return None
        wanted = [f for f in (self.low, self.high + 1) if f > 0]
        if not wanted:
            return None, None
        system, spot = file_system(self.where[1])
        frames = pa.dataset.dataset(spot, filesystem=system, format="parquet")
        at = {r["frame"]: (r["file"], r["offset"]) for r in frames.to_table(columns=["frame", "file", "offset"], filter=pa.dataset.field("frame").isin(wanted)).to_pylist()}
        if self.low > 0 and self.low not in at:
            return None
        return at.get(self.low) if self.low > 0 else None, at.get(self.high + 1) if self.high >= 0 else None

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # what Spark asks for if there are no partitions
            return
        system, _ = file_system(self.path)
        with system.open_input_file(partition.file) as f:
            data, at = lines_of(f, partition.begin, partition.end)
            if not data:
                return
            starts, ends = line_starts(data)
            marks = [int(np.searchsorted(starts, m.start())) for m in MARK.finditer(data)]
            # Stretches of lines of one frame: its number, its header, the first line's place in it.
            stretches = [(partition.next + k, a, b, 0, None) for k, (a, b) in enumerate(zip(marks, [*marks[1:], len(starts)]))]
            first = marks[0] if marks else len(starts)
            if first and partition.line is not None:
                stretches.insert(0, (partition.next - 1, 0, first, partition.line, (partition.open_file, partition.open_offset)))
            for frame, a, b, line, opened in stretches:
                if frame < self.low or 0 <= self.high < frame:
                    continue
                if opened is None:
                    head = parse_head(head_lines(f, int(at + starts[a])))
                else:
                    with system.open_input_file(opened[0]) as g:
                        head = parse_head(head_lines(g, opened[1]))
                if not self.any_header and head.names != self.names:
                    raise DumpError("the atoms header changes")
                a += max(0, HEAD_LINES - line)
                line = max(line, HEAD_LINES)
                for k in range(a, b, CHUNK_LINES):
                    stop = min(b, k + CHUNK_LINES)
                    yield self._batch(data, starts[k:stop], ends[k:stop], frame, head, line - HEAD_LINES + k - a)

    def _batch(self, data: bytes, starts: np.ndarray, ends: np.ndarray, frame: int, head: Head, pos: int) -> pa.RecordBatch:
        n, width = len(starts), len(head.names)
        base = int(starts[0]) if n else 0
        if n and (starts[1:] == ends[:-1]).all():
            offsets = np.append(starts, ends[-1]) - base
            lines = pa.StringArray.from_buffers(n, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data[base : int(ends[-1])]))
        else:
            lines = pa.array([data[a:b].decode("utf-8") for a, b in zip(starts, ends)], pa.string())
        tokens = pa.compute.utf8_split_whitespace(pa.compute.utf8_trim_whitespace(lines))
        if n and not pa.compute.all(pa.compute.equal(pa.compute.list_value_length(tokens), width)).as_py():
            raise DumpError("a row's columns don't match the header")
        flat, made = tokens.flatten(), {}

        def column(name: str, kind: pa.DataType) -> pa.Array:
            if (name, kind) not in made:
                try:
                    made[name, kind] = flat.take(pa.array(np.arange(head.names.index(name), n * width, width))).cast(kind)
                except pa.ArrowInvalid as e:
                    raise DumpError(f"not a number in {name}: {e}") from None
                except ValueError:
                    raise DumpError(f"a frame has no column {name}") from None
            return made[name, kind]

        def position(axis: str) -> pa.Array:
            if all(c in head.names for c in ("xu", "yu", "zu")):
                return column(f"{axis}u", pa.float64())
            x = np.asarray(column(axis, pa.float64()))
            ix, iy, iz = (np.asarray(column(c, pa.int64())) for c in ("ix", "iy", "iz"))
            k, (xy, xz, yz) = "xyz".index(axis), head.tilts
            flag, side = (ix, iy, iz)[k], head.high[k] - head.low[k]
            return pa.array((x + flag * side + iy * xy + iz * xz, x + flag * side + iz * yz, x + flag * side)[k])

        def value(name: str) -> pa.Array:
            if name in ("frame", "timestep"):
                return pa.array(np.full(n, frame if name == "frame" else head.timestep, np.int64))
            if name == "pos":
                return pa.array(np.arange(pos, pos + n))
            if name in ("x", "y", "z"):
                return position(name)
            if name in ("type", "mol"):
                there = next((c for c in (("type",) if name == "type" else ("mol", "molecule")) if c in head.names), None)
                kind = pa.int32() if name == "type" else pa.int64()
                return column(there, kind) if there else pa.nulls(n, kind)
            return column(name, pa.int64() if name == "id" else pa.float64())

        return pa.RecordBatch.from_arrays([value(c) for c, _ in self.columns], [c for c, _ in self.columns])


class PushingReader(RangeReader):
    """Takes over comparisons of `frame` with constants."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for x in filters:
            kept = True
            if getattr(x, "attribute", None) == ("frame",):
                v, low, high = getattr(x, "value", None), 0, None
                kept = False
                if isinstance(x, EqualTo):
                    low, high = v, v
                elif isinstance(x, GreaterThan):
                    low = v + 1
                elif isinstance(x, GreaterThanOrEqual):
                    low = v
                elif isinstance(x, LessThan):
                    high = v - 1
                elif isinstance(x, LessThanOrEqual):
                    high = v
                elif isinstance(x, In) and x.value and all(isinstance(k, int) for k in x.value):
                    low, high, kept = min(x.value), max(x.value), True
                else:
                    kept = not isinstance(x, IsNotNull)  # every row has a frame
                self._within(low, high)
            if kept:
                yield x

    def _within(self, low: int, high: int | None) -> None:
        self.low = max(self.low, low)
        if high is not None:
            if high < 0:
                self.low, self.high = 1, 0
            else:
                self.high = high if self.high < 0 else min(self.high, high)


class DumpRanges(DataSource):
    """The rows of an indexed dump."""

    @classmethod
    def name(cls) -> str:
        return "dump_ranges"

    def schema(self) -> str:
        return rows_schema(json.loads(self.options["names"]))

    def reader(self, schema) -> DataSourceReader:
        return (PushingReader if self.options["push"] == "true" else RangeReader)(schema, self.options)


PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def scan_dump(spark: SparkSession, index: Index, columns: list[str] | None = None, frames: tuple[int, int] = (0, -1), allow_header_change: bool = False, push: bool = True) -> DataFrame:
    """The index's rows: the given columns of rows_schema (all by default), of frames first..last (-1: to the end).

    With `push`, filters on `frame` reach the source; Spark asks for its feature flag in the session for that, which is
    set here and concerns Python sources alone."""
    if push:
        spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(DumpRanges)
    kinds = dict(re.findall(r"`?([^`,]+?)`? (long|int|double)(?:, |$)", rows_schema(index.names)))
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (columns or kinds))
    options = {"path": index.path, "tables": json.dumps([index.ranges._settled_at, index.frames._settled_at]), "files": json.dumps(index.files), "names": json.dumps(index.names), "allow_header_change": str(allow_header_change).lower(), "first": str(frames[0]), "last": str(frames[1]), "tasks": str(TASKS * spark.sparkContext.defaultParallelism), "push": str(push).lower()}
    return spark.read.format("dump_ranges").schema(schema).options(**options).load()
