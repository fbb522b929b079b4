"""Streams of trajectories: a growing dump as a source, and measures that keep up with it.

`dump_growth` is a stream of byte ranges of one growing file: its offset is the file's length, and the driver sees no more
of the file than that. Each micro-batch indexes the new range on the executors (see `sources.ranges`), from the byte
behind the last complete frame, finds the frames that are complete by now, and parses them by ranges with the batch
reader, so a frame of any size is parsed by many tasks and a part of a frame is never seen. Where a batch ended (byte and
number of frames) is noted beside the checkpoint, so a repeated batch begins where it did before, and a resumed query
goes on where it stopped. A path may name any file system that Arrow reads."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming.query import StreamingQuery

from ..functions.places import file_info, file_system
from ..operators.correlate import CorrelatorSpec
from ..plans.durable import forget, settle, shared_dir
from ..sources.dump import checked, first_particles
from ..sources.ranges import RANGE_BYTES, DumpError, Index, index_dump, scan_dump
from .state import BUCKETS, PAIRS, pair_sums, rocks, summarise_pairs

FIELDS = "frame long, timestep long, id long, x double, y double, z double"
RANGES = "begin long, end long"


@dataclass
class NewBytes(InputPartition):
    begin: int
    end: int


class _Growth(DataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {"byte": 0}

    def latestOffset(self) -> dict:
        info = file_info(self.path)
        return {"byte": info.size if info.type == fs.FileType.File else 0}

    def partitions(self, start: dict, end: dict) -> list[NewBytes]:
        return [NewBytes(start["byte"], end["byte"])] if end["byte"] > start["byte"] else []

    def read(self, partition: NewBytes) -> Iterator[tuple]:
        yield partition.begin, partition.end

    def commit(self, end: dict) -> None:
        pass


class DumpGrowth(DataSource):
    """spark.readStream.format("dump_growth").option("path", ...): byte ranges by which a file has grown."""

    @classmethod
    def name(cls) -> str:
        return "dump_growth"

    def schema(self) -> str:
        return RANGES

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Growth(self.options["path"])


class Positions:
    """Where a batch ended: a small file in a folder, written whole. The last two are kept: a batch may be repeated."""

    def __init__(self, folder: str):
        self.system, self.path = file_system(folder)

    def _below(self, batch: int) -> list[int]:
        return sorted(n for x in self.system.get_file_info(fs.FileSelector(self.path, allow_not_found=True)) if (n := int(x.base_name)) < batch)

    def before(self, batch: int) -> dict:
        """Byte and frames behind the batches before this one."""
        last = max(self._below(batch), default=None)
        if last is None:
            return {"byte": 0, "frames": 0}
        with self.system.open_input_file(f"{self.path}/{last:010d}") as f:
            return json.loads(f.read())

    def note(self, batch: int, byte: int, frames: int) -> None:
        self.system.create_dir(self.path, recursive=True)
        with self.system.open_output_stream(f"{self.path}/{batch:010d}") as f:
            f.write(json.dumps({"byte": byte, "frames": frames}).encode())
        for old in self._below(batch)[:-1]:
            self.system.delete_file(f"{self.path}/{old:010d}")


Handle = Callable[[DataFrame, int, int, int], None]


def each_batch(spark: SparkSession, path: str, first: Index, atoms: DataFrame, positions: Positions, handle: Handle, most: int = 0, allow_header_change: bool = False, range_bytes: int = RANGE_BYTES) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: `handle(rows, first frame, frames, batch)` gets FIELDS of the frames that are complete by now, at
    most `most` at a time (0: all), checked by the batch reader's rules against the first frame."""
    natoms = first.frames.select("natoms").first()[0]

    def run(batch: DataFrame, number: int) -> None:
        end = batch.agg(F.max("end")).first()[0]
        if end is None:
            return
        was = positions.before(number)
        index = index_dump(spark, path, range_bytes, growing=True, begin=was["byte"], end=end, first=was["frames"], names=first.names)
        if index.count:
            if not index.frames.filter(F.col("natoms") != natoms).isEmpty():
                raise DumpError("the number of atoms changes")
            step = most or index.count
            for low in range(index.first, index.first + index.count, step):
                high = min(low + step, index.first + index.count) - 1
                rows = settle(scan_dump(spark, index, ["frame", "timestep", "id", "x", "y", "z"], (low, high), allow_header_change), "followed")
                handle(checked(rows, atoms), low, high - low + 1, number)
                forget(rows)
        positions.note(number, index.stop, index.first + index.count)
        forget(index.ranges, index.frames)

    return run


def growth(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(DumpGrowth)
    return spark.readStream.format("dump_growth").option("path", path).load()


def land(spark: SparkSession, path: str, folder: str, checkpoint: str, allow_header_change: bool = False, range_bytes: int = RANGE_BYTES, forever: bool = False) -> StreamingQuery:
    """The complete frames of a growing dump as Parquet folders, one a batch; ends with what is there unless `forever`.

    A batch that is repeated after its folder was finished leaves it as it is, so readers of the folder see each row once."""
    first, atoms = first_particles(spark, path, allow_header_change, range_bytes)
    where = file_system(folder)

    def handle(rows: DataFrame, low: int, n: int, number: int) -> None:
        if where[0].get_file_info(f"{where[1]}/{number:010d}/_SUCCESS").type == fs.FileType.NotFound:
            rows.write.mode("overwrite").parquet(f"{folder}/{number:010d}")

    run = each_batch(spark, path, first, atoms, Positions(f"{checkpoint}-positions"), handle, 0, allow_header_change, range_bytes)
    writer = growth(spark, path).writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    query = writer.start() if forever else writer.trigger(availableNow=True).start()
    if not forever:
        query.awaitTermination()
    return query


def follow_folder(spark: SparkSession, folder: str) -> DataFrame:
    """A folder of Parquet files with FIELDS (or, as a pattern, of such folders), each new file a part of the stream."""
    return spark.readStream.schema(FIELDS).parquet(folder)


# --- checkpoints --------------------------------------------------------------------------------------------------

# What a state file begins with (fixed values of this format).
MAGIC, STATE_VERSION = "kinetrail-state", 2


def guard(checkpoint: str, meta: dict) -> None:
    """Resume only what was begun with the same settings: the header beside the state names the format and all of them."""
    meta = json.loads(json.dumps({"magic": MAGIC, "version": STATE_VERSION, **meta}))
    system, folder = file_system(checkpoint)
    path = f"{folder}/run_meta.json"
    if system.get_file_info(path).type != fs.FileType.NotFound:
        with system.open_input_file(path) as f:
            held = json.loads(f.read())
        differs = sorted(k for k in {*held, *meta} if held.get(k) != meta.get(k))
        if differs:
            raise ValueError(f"the checkpoint belongs to a run with other settings: {', '.join(differs)}")
    else:
        system.create_dir(folder, recursive=True)
        with system.open_output_stream(path) as f:
            f.write(json.dumps(meta).encode())


def stream_correlation(stream: DataFrame, spec: CorrelatorSpec, folder: str, checkpoint: str, source: str = "", buckets: int = BUCKETS) -> DataFrame:
    """Runs over what is there and returns the series so far; a later call with the same checkpoint goes on."""
    guard(checkpoint, {"source": source, "kind": spec.kind, "channels": spec.channels, "levels": spec.levels, "components": spec.components, "lag_stride": spec.lag_stride, "buckets": buckets})
    with rocks(stream.sparkSession):
        query = pair_sums(stream, spec, buckets).writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()
        query.awaitTermination()
    spark = stream.sparkSession
    return summarise_pairs(spark.read.schema(PAIRS).parquet(folder), spec)


def stream_sizes(stream: DataFrame, predicate, folder: str, checkpoint: str) -> DataFrame:
    """Per frame the number of rows that satisfy the predicate. A frame may spread over batches, so parts are summed."""

    def flush(batch: DataFrame, number: int) -> None:
        counted = batch.groupBy("frame").agg(F.sum(F.when(predicate, 1).otherwise(0)).cast("long").alias("n"))
        counted.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    query = stream.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    spark = stream.sparkSession
    return spark.read.parquet(folder).groupBy("frame").agg(F.sum("n").alias("n_selected"))


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared place, for streams that a query runs to their end."""
    return f"{shared_dir(spark)}/kinetrail/{name}-{uuid.uuid4().hex}"
