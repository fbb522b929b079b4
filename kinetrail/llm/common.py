"""Shared plumbing of the text operators: Arrow batches in bounded slices, mergeable tables of fixed size."""

from __future__ import annotations

import ctypes
import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.durable import forget, settle  # noqa: F401

#: Text bytes that a kernel sees at once; bounds a Python worker's memory whatever the batch size.
SLICE_BYTES = 1 << 20
#: Most bytes of an Arrow batch between the JVM and a worker; whole texts make large rows.
BATCH_BYTES = 4 << 20
#: Most rows that Spark's Parquet reader makes at once: with whole texts or sets, its usual 4096 are arrays of 16 to 64 MB.
READ_ROWS = 256


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's limits on batches to BATCH_BYTES (Arrow) and READ_ROWS (Parquet): tasks share an executor's memory.

    The limits exist only as settings of the session; one that is lower already stays."""
    for name, most in (("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES), ("spark.sql.parquet.columnarReaderBatchSize", READ_ROWS)):
        now = spark.conf.get(name, None)
        if now is None or not now.isdigit() or int(now) > most:
            spark.conf.set(name, str(most))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator reads; anything else in the table, whatever its name, is pruned."""
    bound_batches(df.sparkSession)
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def slices(batch: pa.RecordBatch, text_at: int = 1, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Row ranges of a batch whose texts together hold about `most` bytes (one row at least)."""
    if batch.num_rows == 0:
        return
    column = batch.column(text_at)
    lengths = np.asarray(pa.compute.fill_null(pa.compute.binary_length(column), 0)).astype(np.int64)
    group = (np.cumsum(lengths) - lengths) // most
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


_LIBC = ctypes.CDLL(None)


def release() -> None:
    """Give back what a finished partition has freed: workers outlive their tasks, and several share an executor."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


Batches = Iterator[pa.RecordBatch]


def tidy(run: Callable[[Batches], Batches], last: Callable[[], None] = lambda: None) -> Callable[[Batches], Batches]:
    """run, then last and release, once a partition is done (or dropped)."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            last()
            release()

    return whole


def map_slices(df: DataFrame, kernel: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, text_at: int = 1, most: int = SLICE_BYTES, first: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None, last: Callable[[], None] = lambda: None) -> DataFrame:
    """`kernel` over bounded slices of every Arrow batch (passed through `first`), in the partitions df already has; `last`
    is called when one is done."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(first(batch) if first else batch, text_at, most):
                out = kernel(part)
                if out is not None and out.num_rows:
                    yield out

    bound_batches(df.sparkSession)
    return df.mapInArrow(tidy(run, last), schema)


def texts_of(column: pa.Array) -> list[str]:
    """Python strings, null as the empty text."""
    return [x if x is not None else "" for x in column.to_pylist()]


def utf8_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 (or binary) bytes of a column end to end and the rows+1 offsets into them; null counts as empty."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if column.null_count:
        lengths = np.where(np.asarray(column.is_valid()), np.diff(offsets), 0)
        if int(lengths.sum()) != int(offsets[-1] - offsets[0]):  # a null row may still cover bytes
            column = pa.compute.fill_null(column, b"")
            return utf8_of(pa.concat_arrays([column]))
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of uint64 values (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd base and of its inverse modulo 2^64, grown as needed."""

    def __init__(self, base: int):
        self.base = base
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            for name, b in (("up", self.base), ("down", pow(self.base, -1, 1 << 64))):
                steps = np.full(n, b, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        return self.up[:n], self.down[:n]


#: Bytes of a table that merge as one row: as many merging tasks as the table has such blocks.
TABLE_BLOCK = 1 << 20
#: Most tables that are filled and merged, whatever the number of partitions: beyond it a task fills one from several.
MOST_TABLES = 2048


def blocks_of(*columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A task's table of fixed size (a power of two of rows), in blocks that merge one by one; empty blocks are left out.
    Several columns of a table are laid side by side block by block: it is never held twice."""
    n = max(1, sum(c.nbytes for c in columns) // TABLE_BLOCK)
    for k, parts in enumerate(zip(*(np.split(c, n) for c in columns))):
        if any(x.any() for x in parts):
            part = parts[0] if len(parts) == 1 else np.stack(parts, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], ["block", "data"])


def merged_table(df: DataFrame, fill: Callable[[Batches], Batches], empty: np.ndarray, merge: Callable[[np.ndarray, np.ndarray], np.ndarray], finish: Callable[[np.ndarray], np.ndarray] = lambda x: x) -> np.ndarray:
    """The merged table of df: `fill` makes the blocks (see blocks_of) of a task's rows. Each block is finished where it is
    merged, and the driver gets bytes of the finished table alone. `empty` is a task's table with nothing in it.

    Neighbouring partitions share a task where there are more than MOST_TABLES of them, without a shuffle, so what moves is
    MOST_TABLES tables at most, and a merging task reads as many blocks."""
    tables = df.coalesce(MOST_TABLES).mapInArrow(tidy(fill), "block int, data binary")
    n = max(1, empty.nbytes // TABLE_BLOCK)
    dtype, shape = empty.dtype, (len(empty) // n, *empty.shape[1:])

    def join(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for x in batch.column("data"):
                part = np.frombuffer(zlib.decompress(x.as_buffer()), dtype).reshape(shape)
                total = part.copy() if total is None else merge(total, part)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([zlib.compress(np.ascontiguousarray(finish(total)).tobytes(), 1)], pa.binary())], ["block", "data"])

    blank = finish(np.zeros(shape, dtype))
    out = np.tile(blank, (n, *[1] * (blank.ndim - 1)))
    for r in tables.groupBy("block").applyInArrow(join, "block int, data binary").collect():
        out[r[0] * len(blank) : (r[0] + 1) * len(blank)] = np.frombuffer(zlib.decompress(bytes(r[1])), blank.dtype).reshape(blank.shape)
    return out


def set_bits(table: np.ndarray, cells: np.ndarray) -> None:
    """Set the bits at ascending distinct cells of a packed table."""
    if len(cells):
        byte = (cells >> np.uint64(3)).astype(np.int64)
        bit = np.uint8(128) >> (cells & np.uint64(7)).astype(np.uint8)
        first = np.flatnonzero(np.concatenate([[True], byte[1:] != byte[:-1]]))
        table[byte[first]] |= np.bitwise_or.reduceat(bit, first)


def get_bits(table: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Whether each cell of a packed table, eight to a byte, is set."""
    return ((table[cells >> np.uint64(3)] >> (np.uint64(7) - (cells & np.uint64(7))).astype(np.uint8)) & 1).astype(bool)


def partitions_for(df: DataFrame, bytes_each: int = 128 << 20) -> int:
    """Shuffle partitions as the session says, and more where the planner's estimate of df's size asks for them.

    Rows that Spark did not read from files have no estimate (the planner's is 2^63 for each)."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    size = 0 if size >= 1 << 60 else size
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(1 << 20, size // bytes_each))


def table_bits(df: DataFrame, bytes_per_entry: int, least: int, most: int) -> int:
    """Bits of a table with about an entry for so many bytes of input (by the planner's estimate), within bounds."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return min(most, max(least, int(np.ceil(np.log2(max(size, 1) / bytes_per_entry)))))


def bloom(df: DataFrame, key: str, bits: int) -> np.ndarray:
    """A Bloom filter (two probes a key) over a long column: 2^bits bits, packed, merged across partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << (bits - 3), np.uint8)
        for batch in batches:
            set_bits(table, np.unique(np.concatenate(bloom_probes(np.asarray(batch.column(0)).view(np.uint64), bits))))
        yield from blocks_of(table)

    return merged_table(df.select(F.col(key).cast("long")), run, np.zeros(1 << (bits - 3), np.uint8), np.bitwise_or)


def bloom_probes(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    shift = np.uint64(64 - bits)
    return mix(keys) >> shift, mix(keys ^ np.uint64(0xD6E8FEB86659FD93)) >> shift


def in_bloom(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    a, b = bloom_probes(keys, len(table).bit_length() + 2)
    return get_bits(table, a) & get_bits(table, b)


def sifter(table, hit: bool, at: int) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    """Rows of a batch whose long column number `at` is (hit) or is not in the broadcast Bloom filter."""

    def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = in_bloom(table.value, np.asarray(pa.compute.fill_null(batch.column(at), 0)).view(np.uint64))
        return batch.filter(pa.array(found if hit else ~found))

    return keep


def sift(df: DataFrame, table, hit: bool, at: int) -> DataFrame:
    keep = sifter(table, hit, at)
    return df.mapInArrow(tidy(lambda batches: map(keep, batches)), df.schema)
