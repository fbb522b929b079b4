"""Near-duplicate vectors: p-stable hashing of normalised vectors in several tables, then exact cosines.

A table's key is a row of quantised Gaussian projections of the unit vector, floor((a.x + b) / width). How many
projections and tables there are follows from the number of vectors, the threshold and the recall asked for at it
(`tables_for`): unrelated vectors of one label then share a bucket about once in as many vectors as there are.

Work on groups of copies is bounded in three steps. Equal vectors of a label are one class, summed before any join.
Classes within half the threshold's angle of the first class of one of their buckets form a ball round it: all pairs of
a ball are linked, by the triangle inequality, and need no comparison. Only buckets that hold several balls are compared:
blocks of `BLOCK` classes a bucket, one unit for each pair of blocks, each pair of classes in the first table that they
share. Units return each class's number of links and a spanning set of links between balls, never pairs.

Defined results: a vector that is null, empty, zero or holds a null or non-finite component, and one without a label,
links with nothing. Vectors of different lengths aren't linked. Repeated rows are linked rows like any others. A null
vec_id stays null unless its component has another. An empty table gives no rows; other columns are ignored. A long
vector is one value of a row; a slice of at least one row is in memory at once.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components, roots_of
from .common import Batches, bound_batches, forget, mix, partitions_for, settle, tidy

_U = np.uint64
#: Width of a projection's cells, in units of the unit sphere's radius.
WIDTH = 1.5
#: Chance that a pair exactly at the threshold shares a bucket; pairs above it share one more often.
RECALL = 0.98
#: Tables whose buckets offer ball centres.
LEAD_TABLES = 4
#: Classes of a bucket in one block.
BLOCK = 256
#: Numbers of a slice of vectors, and pairs compared at once.
SLICE_NUMBERS, SLICE_PAIRS = 1 << 18, 1 << 14
#: Rows of whole units that are compared together.
HOLD_ROWS = 1 << 11
#: Runs of at most so many rows are compared together.
SHORT = 48


def chance(distance: float, width: float = WIDTH) -> float:
    """Chance that one quantised Gaussian projection agrees for two points at this distance."""
    x = width / distance
    return math.erf(x / math.sqrt(2)) - math.sqrt(2 / math.pi) / x * (1 - math.exp(-x * x / 2))


def tables_for(n: int, threshold: float, recall: float) -> tuple[int, int]:
    """(projections a table, tables) for n vectors."""
    near, far = chance(math.sqrt(2 - 2 * threshold)), chance(math.sqrt(2))
    k = max(1, math.ceil(math.log(max(n, 2)) / -math.log(far)))
    return k, max(LEAD_TABLES, math.ceil(math.log(1 - recall) / math.log1p(-(near**k))))


class Hasher:
    """Bucket keys of unit vectors, from fixed seeds, for vectors of any length."""

    def __init__(self, projections: int, tables: int) -> None:
        self.shape, self.planes = (tables, projections), {}

    def __call__(self, units: np.ndarray) -> np.ndarray:
        """rows x tables keys."""
        dim, (tables, k) = units.shape[1], self.shape
        if dim not in self.planes:
            r = np.random.default_rng([20240611, dim])
            self.planes[dim] = (r.standard_normal((dim, tables * k)), r.uniform(0, WIDTH, tables * k))
        a, b = self.planes[dim]
        cells = np.floor((units @ a + b) / WIDTH).astype(np.int64).astype(_U).reshape(len(units), tables, k)
        out = mix(np.arange(1, tables + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(dim))[None, :] + np.zeros((len(units), 1), _U)
        for j in range(k):
            out = mix(out + cells[:, :, j] * _U(0xD6E8FEB86659FD93) + _U(j))
        return out.view(np.int64)


def matrix(column: pa.Array) -> np.ndarray:
    """A list column without nulls whose rows are equally long, as doubles."""
    flat = np.asarray(column.flatten()).astype(np.float64)
    return flat.reshape(len(column), -1)


def units_of(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def even_slices(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Bounded row ranges whose vectors (column `at`) are equally long, with their unit vectors."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = np.asarray(pa.compute.list_value_length(batch.column(at)))
        for dim in np.unique(lengths):
            part = batch.filter(pa.array(lengths == dim))
            step = max(1, SLICE_NUMBERS // int(dim))
            for k in range(0, part.num_rows, step):
                some = part.slice(k, step)
                yield some, units_of(matrix(some.column(at)))


def hashed(hasher: Hasher, tables: int) -> Callable[[Batches], Batches]:
    """(node, ball, v) to (t, bucket, node, ball), a row a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, units in even_slices(batches, 2):
            keys = hasher(units)[:, :tables]
            node, ball = (np.repeat(np.asarray(some.column(k)), tables) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(tables, dtype=np.int32), len(units))), pa.array(keys.ravel()), pa.array(node), pa.array(ball)], ["t", "bucket", "node", "ball"])

    return run


def centred(least: float) -> Callable[[Batches], Batches]:
    """(node, centre, v, cv) to the rows whose cosine is at least `least`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, units in even_slices(batches, 2):
            near = (units * units_of(matrix(some.column(3)))).sum(axis=1) >= least
            yield pa.RecordBatch.from_arrays([some.column(0).filter(pa.array(near)), some.column(1).filter(pa.array(near))], ["node", "centre"])

    return run


def whole_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows in batches of whole units (equal in the first five columns) with vectors of one length (column 2)."""

    def even(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        dims = np.asarray(batch.column(2))
        for dim in np.unique(dims):
            yield batch.filter(pa.array(dims == dim))

    held: pa.RecordBatch | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        held = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        last = int(unit_starts([np.asarray(held.column(k)) for k in range(5)])[-1])
        if last >= HOLD_ROWS:
            yield from even(held.slice(0, last))
            held = held.slice(last)
    if held is not None:
        yield from even(held)


def unit_starts(key: list[np.ndarray]) -> np.ndarray:
    change = np.zeros(len(key[0]), bool)
    change[:1] = True
    for k in key:
        change[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(change)


class Rows:
    """Columns of the units' rows; runs of equal (bucket, label, lo, hi) are units."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        self.key = [np.asarray(batch.column(k)) for k in range(5)]
        self.t, self.block, self.node, self.ball, self.w = (np.asarray(batch.column(k)) for k in range(5, 10))
        self.v = matrix(batch.column(10))
        self.keys = np.frombuffer(b"".join(batch.column(11).to_pylist()), np.int64).reshape(batch.num_rows, -1)


def linked(rows: Rows, a: np.ndarray, b: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Which pairs count here: near ones of different balls and, in a unit of two blocks, of different blocks, that share
    no earlier table."""
    lo, hi = rows.key[3], rows.key[4]
    keep = near & (rows.ball[a] != rows.ball[b]) & ((lo[a] == hi[a]) | (rows.block[a] != rows.block[b]))
    at = np.flatnonzero(keep)
    for k in range(0, len(at), SLICE_PAIRS):
        some = at[k : k + SLICE_PAIRS]
        same = rows.keys[a[some]] == rows.keys[b[some]]
        keep[some] = same.argmax(axis=1) == rows.t[a[some]]
    return keep


def compared(threshold: float) -> Callable[[Batches], Batches]:
    """Units to (a, b, n): links of class a to n vectors (b null), and links a-b that connect as all do (n 0)."""

    def pairs_of(rows: Rows) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        units, starts = units_of(rows.v), unit_starts(rows.key)
        sizes = np.diff(np.append(starts, len(rows.t)))
        run = np.repeat(np.arange(len(starts)), sizes)
        short = np.repeat(sizes <= SHORT, sizes)
        for d in range(1, SHORT):
            a = np.flatnonzero(short[:-d] & (run[:-d] == run[d:])) if d < len(run) else np.zeros(0, int)
            if not len(a):
                break
            step = max(BLOCK, 4 * SLICE_NUMBERS // units.shape[1])
            for k in range(0, len(a), step):
                x = a[k : k + step]
                keep = linked(rows, x, x + d, (units[x] * units[x + d]).sum(axis=1) >= threshold)
                yield x[keep], x[keep] + d
        for s, n in zip(starts[sizes > SHORT], sizes[sizes > SHORT]):
            for k in range(0, n, BLOCK):
                part = np.arange(s + k, min(s + k + BLOCK, s + n))
                x, y = np.nonzero(units[part] @ units[s : s + n].T >= threshold)
                x, y = part[x], s + y
                x, y = x[x < y], y[x < y]
                keep = linked(rows, x, y, np.ones(len(x), bool))
                yield x[keep], y[keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_units(batches):
            yield from counted(batch)

    def counted(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = Rows(batch)
        many = np.zeros(batch.num_rows, np.int64)
        ends: list[tuple[np.ndarray, np.ndarray]] = []
        for x, y in pairs_of(rows):
            np.add.at(many, x, rows.w[y])
            np.add.at(many, y, rows.w[x])
            u, v = rows.ball[x], rows.ball[y]
            if len(u):
                ends.append(roots_of(u, v))
        some = np.flatnonzero(many)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(rows.node[some]), pa.nulls(len(some), pa.int64()), pa.array(many[some])], ["a", "b", "n"])
        if ends:
            u, v = roots_of(*(np.concatenate(x) for x in zip(*ends)))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(np.zeros(len(u), np.int64))], ["a", "b", "n"])

    return run


def with_keys(hasher: Hasher) -> Callable[[Batches], Batches]:
    """(node, label, v, w, ball) with the keys of all tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, units in even_slices(batches, 2):
            keys = hasher(units)
            yield pa.RecordBatch.from_arrays([*some.columns, pa.array([x.tobytes() for x in keys], pa.binary())], [*some.schema.names, "keys"])

    return run


def near_vectors(df: DataFrame, threshold: float = 0.93, recall: float = RECALL, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row; links are cosines of at least `threshold` within a label."""
    bound_batches(df.sparkSession)
    label = F.col(label_col).cast("string")
    sound = label.isNotNull() & F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector_col, lambda x: x != 0)
    v = F.when(F.coalesce(sound, F.lit(False)), F.col(vector_col))
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), label.alias("label"), v.alias("v"))
    keyed = rows.select("vec_id", "label", "v", F.when(F.col("v").isNotNull(), F.xxhash64("label", "v")).alias("k1"), F.xxhash64(F.lit(1), "v", "label").alias("k2"))
    classes = keyed.filter("k1 is not null").groupBy("k1", "k2").agg(F.min("vec_id").alias("low"), F.count("*").alias("w"), F.first("label").alias("label"), F.first("v").alias("v"))
    classes = settle(classes.withColumn("node", F.monotonically_increasing_id()), "vector-classes")
    projections, tables = tables_for(classes.count(), threshold, recall)
    hasher = Hasher(projections, tables)

    # Balls: within half the threshold's angle of the first class of a bucket.
    entries = "t int, bucket long, node long, ball long"
    lead = classes.select("node", F.col("node").alias("ball"), "v", "label").mapInArrow(tidy(hashed(hasher, LEAD_TABLES)), entries).join(classes.select("node", "label"), "node")
    firsts = lead.groupBy("bucket", "label").agg(F.min("node").alias("centre"), F.count("*").alias("n")).filter("n > 1").drop("n")
    offers = lead.join(firsts, ["bucket", "label"]).filter("node <> centre").select("node", "centre").distinct()
    offers = offers.join(classes.select("node", "v"), "node").join(classes.select(F.col("node").alias("centre"), F.col("v").alias("cv")), "centre").filter("size(v) = size(cv)")
    balls = offers.select("node", "centre", "v", "cv").mapInArrow(tidy(centred(math.sqrt((1 + threshold) / 2) + 1e-9)), "node long, centre long").groupBy("node").agg(F.min("centre").alias("centre"))
    members = classes.join(balls, "node", "left").select("node", "label", "v", "w", "low", "k1", "k2", F.coalesce("centre", "node").alias("ball"))
    members = settle(members, "vector-members")

    # Buckets of several balls, in pairs of blocks.
    every = members.select("node", "ball", "v").mapInArrow(tidy(hashed(hasher, tables)), entries)
    apart = every.groupBy("bucket").agg(F.count("*").alias("n"), F.min("ball").alias("x"), F.max("ball").alias("y")).filter("x <> y").select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("m"))
    placed = every.join(apart, "bucket").withColumn("block", F.pmod(F.xxhash64("node"), "m").cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1))).select("t", "bucket", "node", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    loads = members.select("node", "label", "v", "w", "ball").mapInArrow(tidy(with_keys(hasher)), f"node long, label string, v {dict(rows.dtypes)['v']}, w long, ball long, keys binary")
    units = placed.join(loads, "node").select("bucket", F.xxhash64("label").alias("hash"), F.size("v").alias("dim"), "lo", "hi", "t", "block", "node", "ball", "w", "v", "keys")
    units = units.repartition(partitions_for(df), "bucket", "lo", "hi").sortWithinPartitions("bucket", "hash", "dim", "lo", "hi")
    found = settle(units.mapInArrow(tidy(compared(threshold)), "a long, b long, n long"), "vector-links")

    edges = found.filter("b is not null").select("a", "b").union(members.filter("node <> ball").select("node", "ball"))
    components = connected_components(edges, "a", "b")
    grown = members.join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lows = grown.groupBy("component").agg(F.min("low").alias("component_id"))
    inside = members.groupBy("ball").agg(F.sum("w").alias("inside"))
    outside = found.filter("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("outside"))
    done = grown.join(lows, "component").join(inside, "ball").join(outside, "node", "left").select("k1", "k2", "component_id", (F.col("inside") - 1 + F.coalesce("outside", F.lit(0))).alias("n_links"))
    done = settle(done, "vector-results")
    forget(classes, members, found)
    out = keyed.select("vec_id", "k1", "k2").join(done, ["k1", "k2"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
