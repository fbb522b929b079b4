"""Result files: text tables that executors write in order, the audit index, and reading both back.

Paths may name any file system that Arrow reads. Readers see the old or the new file, never a part: everything is written
beside the target and moved there at the end."""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..functions.places import file_system, is_file
from ..operators.correlate import SERIES

SCHEMA_VERSION = "1.0"
#: Bytes that are copied at a time.
PIECE = 1 << 20


def replace_file(path: str, text: str) -> None:
    system, spot = file_system(path)
    system.create_dir(posixpath.dirname(spot), recursive=True)
    part = f"{spot}.part-{uuid.uuid4().hex}"
    with system.open_output_stream(part) as f:
        f.write(text.encode("utf-8"))
    system.move(part, spot)


def spelled(rows: Iterator[tuple]) -> str:
    return "".join(" ".join(f"{v:.17g}" if isinstance(v, float) else str(v) for v in r) + "\n" for r in rows)


@dataclass
class Part(WriterCommitMessage):
    """A task's file: its place in the order, path and rows."""

    number: int
    name: str
    rows: int


class _TextWriter(DataSourceArrowWriter):
    """Tasks write a file each; the commit puts them, in order of their partitions, behind the header (or behind what there
    is) and moves the whole over the target. An abort deletes the tasks' files and leaves the target as it was."""

    def __init__(self, options) -> None:
        self.path, self.header, self.append, self.job = options["path"], json.loads(options["header"]), options.get("append") == "true", options["job"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        from pyspark import TaskContext

        task = TaskContext.get()
        system, spot = file_system(self.path)
        system.create_dir(f"{spot}.{self.job}", recursive=True)
        name, rows = f"{spot}.{self.job}/{task.partitionId():08d}-{task.taskAttemptId()}", 0
        with system.open_output_stream(name) as f:
            for batch in iterator:
                f.write(spelled(zip(*(c.to_pylist() for c in batch.columns))).encode("utf-8"))
                rows += batch.num_rows
        return Part(task.partitionId(), name, rows)

    def commit(self, messages: list[Part | None]) -> None:
        system, spot = file_system(self.path)
        whole = f"{spot}.{self.job}/whole"
        system.create_dir(f"{spot}.{self.job}", recursive=True)
        there = self.append and system.get_file_info(spot).type == fs.FileType.File
        with system.open_output_stream(whole) as out:
            if not there:
                out.write("".join(f"# {h}\n" for h in self.header).encode("utf-8"))
            for name in ([spot] if there else []) + [m.name for m in sorted((m for m in messages if m is not None), key=lambda m: m.number)]:
                with system.open_input_stream(name) as f:
                    while piece := f.read(PIECE):
                        out.write(piece)
        system.move(whole, spot)
        system.delete_dir(f"{spot}.{self.job}")

    def abort(self, messages: list[Part | None]) -> None:
        system, spot = file_system(self.path)
        if system.get_file_info(f"{spot}.{self.job}").type != fs.FileType.NotFound:
            system.delete_dir(f"{spot}.{self.job}")


class OrderedText(DataSource):
    """df.write.format("ordered_text"): the rows of df in the order of its partitions, as one text file."""

    @classmethod
    def name(cls) -> str:
        return "ordered_text"

    def schema(self) -> str:
        raise NotImplementedError("a format to write")

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _TextWriter(self.options)


class TextTable:
    """A text table that is rewritten whole or appended to (its header once); nothing happens on a dry run."""

    def __init__(self, path: str, header: list[str], append: bool = False, dry: bool = False):
        self.path, self.header, self.append, self.dry = path, header, append, dry

    def write(self, rows: list[tuple]) -> None:
        """A few rows of the driver's own."""
        if self.dry:
            return
        held = ""
        if self.append and is_file(self.path):
            system, spot = file_system(self.path)
            with system.open_input_file(spot) as f:
                held = f.read().decode("utf-8")
        replace_file(self.path, (held or "".join(f"# {h}\n" for h in self.header)) + spelled(iter(rows)))

    def write_frame(self, frame: DataFrame) -> None:
        """The rows of a DataFrame, written by its tasks in the order of its partitions."""
        if self.dry:
            return
        spark = frame.sparkSession
        spark.dataSource.register(OrderedText)
        frame.write.format("ordered_text").mode("append").options(path=self.path, header=json.dumps(self.header), append=str(self.append).lower(), job=uuid.uuid4().hex).save()


class Dataset:
    """What a result table holds, column by column: a name, a unit and a description each, in writing order. The rows are
    ordered by the first column unless `order` names others."""

    def __init__(self, order: list[str] | None = None):
        self.columns: list[dict[str, str]] = []
        self.order = order

    def column(self, name: str, unit: str = "", description: str = "") -> Dataset:
        if not name or any(c["name"] == name for c in self.columns):
            raise ValueError(f"a dataset's columns have names, each once: {name!r}")
        self.columns.append({"name": name, "unit": unit, "description": description})
        return self

    def header(self) -> str:
        return "\t".join(c["name"] + (f"({c['unit']})" if c["unit"] else "") for c in self.columns)


def write_dataset(path: str, frame: DataFrame, columns: list[dict[str, str]] | Dataset, notes: list[str], dry: bool = False, append: bool = False) -> int:
    """A result table as text, in order of its first column (or as its Dataset says), by the executors. Returns the number
    of rows, observed while they are written."""
    spec = columns if isinstance(columns, Dataset) else None
    names = [c["name"] for c in (spec.columns if spec else columns)]
    missing = [n for n in names if n not in frame.columns]
    if missing:
        raise ValueError(f"the dataset lacks the columns {', '.join(missing)}")
    if dry:
        return 0
    observed = Observation()
    # Counted behind the sort: what lies before it runs once more for the sort's sample.
    ordered = frame.select(*names).orderBy(*((spec.order if spec else None) or names[:1])).observe(observed, F.count(F.lit(1)).alias("rows"))
    TextTable(path, [*notes, spec.header() if spec else " ".join(names)], append).write_frame(ordered)
    return observed.get["rows"]


def write_series(path: str, series: DataFrame, notes: list[str], dry: bool = False) -> int:
    """A correlation series, in order of lag; one row a lag, so it is small. Returns the number of rows."""
    return write_dataset(path, series, [{"name": c} for c in SERIES], notes, dry)


def write_index(path: str, index: dict) -> None:
    replace_file(path, json.dumps({"schema_version": SCHEMA_VERSION, **index}, indent=2) + "\n")


class Results:
    """What a run left: its index, and datasets as lists or DataFrames."""

    def __init__(self, folder: str, index: str = "results.json"):
        self.folder = folder
        system, spot = file_system(posixpath.join(folder, index))
        with system.open_input_file(spot) as f:
            self.index = json.loads(f.read())

    def measures(self) -> list[dict]:
        return self.index["measures"]

    def find_measure(self, name: str) -> dict:
        """By instance, or by type if one instance has it."""
        found = [m for m in self.measures() if m["instance"] == name] or [m for m in self.measures() if m["type"] == name]
        if len(found) != 1:
            raise KeyError(f"{len(found)} measures are called {name!r}")
        return found[0]

    def dataset_path(self, name: str) -> str:
        return posixpath.join(self.folder, self.find_measure(name)["outputs"][0]["path"])

    def dataset_columns(self, name: str) -> list[str]:
        return [c["name"] for c in self.find_measure(name)["outputs"][0]["columns"]]

    def load_table(self, name: str) -> list[list[float]]:
        """A small dataset as lists; load_frame reads one of any size."""
        system, spot = file_system(self.dataset_path(name))
        with system.open_input_file(spot) as f:
            return [[float(x) for x in line.split()] for line in f.read().decode("utf-8").split("\n") if line.strip() and line[0] != "#"]

    def load_frame(self, spark: SparkSession, name: str) -> DataFrame:
        schema = ", ".join(f"{c} double" for c in self.dataset_columns(name))
        return spark.read.schema(schema).option("sep", " ").option("comment", "#").csv(self.dataset_path(name))
