"""Trajectory dumps: text frames of ITEM sections, found and parsed by byte ranges (see `ranges`).

The column list comes from the first frame's header and is checked against all others; numbers must be whole tokens.
type and mol are taken from the first frame alone; ids must be the same set in every frame."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.durable import settle
from .ranges import CORE, RANGE_BYTES, DumpError, Index, header_columns, index_dump, scan_dump  # noqa: F401


@dataclass
class Trajectory:
    """frames: frame, timestep, natoms, box; atoms: idx, id, type, mol; positions: frame, timestep, id, x, y, z, extras."""

    frames: DataFrame
    atoms: DataFrame
    positions: DataFrame
    extras: list[str]
    index: Index | None = None


def read_dump(spark: SparkSession, path: str, allow_header_change: bool = False, check: bool = True, settled: bool = True, frames: tuple[int, int] = (0, -1), range_bytes: int = RANGE_BYTES) -> Trajectory:
    """The dump's index is made at once; the rows of the wanted frames are parsed once into a settled table (unless
    `settled` is false: then plans parse what they ask for, and filters on `frame` reach the source). The atoms are those of
    the first frame, of which nothing else is read."""
    index = index_dump(spark, path, range_bytes)
    extras = [n for n in index.names if n not in CORE]
    per_frame = index.frames.agg(F.countDistinct("header").alias("h"), F.countDistinct("natoms").alias("n")).first()
    if check and per_frame["n"] > 1:
        raise DumpError("the number of atoms changes")
    if check and per_frame["h"] > 1 and not allow_header_change:
        raise DumpError("the atoms header changes")
    atoms = settle(scan_dump(spark, index, ["pos", "id", "type", "mol"], (0, 0), allow_header_change).withColumnRenamed("pos", "idx"), "dump-atoms")
    positions = scan_dump(spark, index, ["frame", "timestep", "id", "x", "y", "z", *extras], frames, allow_header_change)
    if settled:
        positions = settle(positions, "dump")
    if check:
        checked(positions, atoms)
    wanted = index.frames.filter((F.col("frame") >= frames[0]) & ((F.col("frame") <= frames[1]) if frames[1] >= 0 else F.lit(True)))
    return Trajectory(wanted.select("frame", "timestep", "natoms", "box"), atoms, positions, extras, index)


def checked(positions: DataFrame, atoms: DataFrame) -> DataFrame:
    """The rows, if every frame has the first frame's ids, each once; an error otherwise."""
    per = positions.groupBy("frame").agg(F.count("*").alias("n"), F.countDistinct("id").alias("d"), F.min("id").alias("low"))
    if not per.filter("n <> d or low < 0").isEmpty():
        raise DumpError("an id is negative or repeats within a frame")
    if not positions.join(atoms, "id", "left_anti").isEmpty():
        raise DumpError("a later frame has an unknown id")
    return positions


def first_particles(spark: SparkSession, path: str, allow_header_change: bool = False, range_bytes: int = RANGE_BYTES) -> tuple[Index, DataFrame]:
    """The index of a dump that may still grow, and its atoms: idx, id, type, mol of the first frame, which must be there."""
    index = index_dump(spark, path, range_bytes, growing=True)
    if not index.count:
        raise DumpError("the dump has no complete first frame")
    return index, settle(scan_dump(spark, index, ["pos", "id", "type", "mol"], (0, 0), allow_header_change).withColumnRenamed("pos", "idx"), "dump-atoms")
