"""Time-origin-averaged correlation of particle signals: exact, spectral and multi-tau, with block errors.

A signal has columns id, frame, timestep and value columns (x, y, z). Every correlator first reduces each pair of time
origins (cur, org) to one number over all particles, then each lag to one row over its pairs. The first reduction is an
Arrow kernel over tiles of time (or, for functions that need Columns, a join on id whose rows stream into a partial
aggregate); what is shuffled after it is a cell for each pair of frames and call.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.durable import settle
from .spectral import lag_sums

AXES = ("frame", "timestep", "timebin")
# Names of the component masks (fixed values of the configuration language).
COMPONENTS = {
    "xxyyzz": "xyz", "all": "xyz", "xyz": "xyz", "xx": "x", "x": "x", "yy": "y", "y": "y", "zz": "z", "z": "z",
    "xxyy": "xy", "xy": "xy", "xxzz": "xz", "xz": "xz", "yyzz": "yz", "yz": "yz",
}


@dataclass(frozen=True)
class CorrelatorSpec:
    kind: str = "exact"
    axis: str = "frame"
    dt: float = 1.0
    timebin_width: float | None = None
    min_pairs_per_bin: int = 0
    bin_merge: bool | None = None
    lag_stride: int = 1
    block_size: int | None = None
    channels: int = 16
    levels: int = 10
    components: str = "xxyyzz"

    def __post_init__(self) -> None:
        if self.kind not in ("exact", "multitau", "fft"):
            raise ValueError(f"unknown correlator {self.kind}")
        if self.block_size is None:
            object.__setattr__(self, "block_size", 0 if self.kind == "fft" else 200)
        if self.kind == "fft" and self.block_size > 0:
            raise ValueError("the fft correlator makes no pairs, so it has no block errors; block_size is 0")
        if self.axis not in AXES:
            raise ValueError(f"unknown lag axis {self.axis}")
        if self.kind == "multitau" and self.axis != "frame":
            raise ValueError("multitau needs the frame axis")
        if self.lag_stride < 1 or (self.axis == "timestep" and self.lag_stride != 1):
            raise ValueError("the timestep axis takes every lag; strides are at least 1")
        if self.channels < 2 or self.channels % 2 or self.levels < 1:
            raise ValueError("multitau needs an even number of channels and a level")
        if self.components not in COMPONENTS:
            raise ValueError(f"unknown components {self.components}")
        if not self.dt > 0 or (self.timebin_width is not None and not self.timebin_width > 0):
            raise ValueError("dt and the bin width are positive")

    @property
    def width(self) -> float:
        return self.dt if self.timebin_width is None else self.timebin_width

    @property
    def merges(self) -> bool:
        return self.min_pairs_per_bin > 0 and (self.bin_merge is None or self.bin_merge)


def center_of_mass(positions: DataFrame) -> DataFrame:
    """Plain mean position of each frame."""
    return positions.groupBy("frame").agg(*(F.avg(c).alias(f"c{c}") for c in "xyz"))


def without_drift(positions: DataFrame, over: DataFrame | None = None) -> DataFrame:
    """Positions less the mean position, per frame, of the particles in `over` (all by default)."""
    com = center_of_mass(positions if over is None else over)
    # One row a frame; Spark broadcasts it while it is small and joins on the frame beyond that.
    return positions.join(com, "frame").select(*(c for c in positions.columns if c not in "xyz"), *((F.col(c) - F.col(f"c{c}")).alias(c) for c in "xyz"))


PairValue = Callable[[dict[str, Column], dict[str, Column]], Column]


def squared_displacement(components: str = "xxyyzz") -> PairValue:
    axes = COMPONENTS[components]

    def value(cur: dict[str, Column], org: dict[str, Column]) -> Column:
        terms = [(cur[a] - org[a]) * (cur[a] - org[a]) for a in axes]
        return sum(terms[1:], terms[0])

    return value


def frame_pairs(signal: DataFrame, value: PairValue, stride: int = 1, since: int | None = None) -> DataFrame:
    """cur, org, dts and the mean over particles of value(cur, org); pairs that don't go forward in time are left out.

    With `since`, only the pairs whose later frame is that one or one after it."""
    cur = signal.select("id", *(F.col(c).alias(f"cur_{c}") for c in ("frame", "timestep", "x", "y", "z")))
    if since is not None:
        cur = cur.filter(F.col("cur_frame") >= since)
    org = signal.select("id", *(F.col(c).alias(f"org_{c}") for c in ("frame", "timestep", "x", "y", "z")))
    lag = F.col("cur_frame") - F.col("org_frame")
    met = cur.join(org, "id").filter((lag > 0) & (lag % stride == 0) & (F.col("cur_timestep") > F.col("org_timestep")))
    side = lambda s: {c: F.col(f"{s}_{c}") for c in "xyz"}
    met = met.select(F.col("cur_frame").alias("cur"), F.col("org_frame").alias("org"), (F.col("cur_timestep") - F.col("org_timestep")).alias("dts"), value(side("cur"), side("org")).alias("v"))
    return met.groupBy("cur", "org", "dts").agg(F.avg("v").alias("v"))


#: Rows that a call of the tiled kernel takes together (a particle's rows of a tile at least), and frames of a tile's side.
KERNEL_ROWS, TILE_FRAMES = 1 << 18, 1 << 10


def on_arrays(value: PairValue) -> bool:
    """Whether a pair function is arithmetic alone, so that it takes arrays as well as Columns."""
    try:
        side = {c: np.zeros(1) for c in "xyz"}
        return isinstance(value(side, side), np.ndarray)
    except Exception:  # noqa: BLE001  whatever a function of Columns says to arrays
        return False


def frame_pairs_tiled(signal: DataFrame, value: PairValue, stride: int = 1, since: int | None = None) -> DataFrame:
    """frame_pairs by an Arrow kernel: the join's rows, a pair of frames for each particle, never exist.

    Time is cut into blocks of TILE_FRAMES frames, and a tile is a pair of blocks (of later and earlier frames). A row goes
    to the tiles that its frame has a part in, one while there is one block, and particles meet there by id: a tile of
    some particles is one kernel call, so a long trajectory, be it of a single particle, is spread over as many tasks as it
    has tiles. Sums and counts are held by pair of frames. Where a particle lacks a frame it counts for nothing."""
    last = signal.agg(F.max("frame")).first()[0]
    blocks = 0 if last is None else last // TILE_FRAMES
    own = F.expr(f"frame div {TILE_FRAMES}")
    # Tiles (later, earlier): of a frame as the later one, and as the earlier one in later blocks.
    tiles = F.concat(F.transform(F.sequence(F.lit(0).cast("long"), own), lambda o: F.struct(own.alias("c"), o.alias("o"))), F.transform(F.when(own < blocks, F.sequence(own + 1, F.lit(blocks).cast("long"))).otherwise(F.array().cast("array<bigint>")), lambda c: F.struct(c.alias("c"), own.alias("o"))))
    rows = signal.select("id", "frame", "timestep", "x", "y", "z")
    rows = rows.withColumn("t", F.explode(tiles)).select("t.c", "t.o", "id", "frame", "timestep", "x", "y", "z") if blocks else rows.select(F.lit(0).cast("long").alias("c"), F.lit(0).cast("long").alias("o"), *rows.columns)
    if since is not None:
        rows = rows.filter(F.col("c") >= since // TILE_FRAMES)
    tile_frames = TILE_FRAMES

    def solve(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        frames, f = np.unique(np.asarray(rows["frame"]), return_inverse=True)
        ids, i = np.unique(np.asarray(rows["id"]), return_inverse=True)
        steps = np.zeros(len(frames), np.int64)
        steps[f] = np.asarray(rows["timestep"])
        held = np.zeros((len(frames), len(ids)))
        held[f, i] = 1.0
        values = {}
        for axis in "xyz":
            x = np.zeros(held.shape)
            x[f, i] = np.asarray(rows[axis])
            values[axis] = x
        whole = len(f) == held.size
        block, later, earlier = frames // tile_frames, int(rows["c"][0].as_py()), int(rows["o"][0].as_py())
        out: list[tuple] = []
        for k in np.flatnonzero(block == later):
            if since is not None and frames[k] < since:
                continue
            fits = np.flatnonzero((block[:k] == earlier) & ((frames[k] - frames[:k]) % stride == 0) & (steps[k] > steps[:k]))
            if not len(fits):
                continue
            span = slice(fits[0], fits[-1] + 1) if fits[-1] - fits[0] + 1 == len(fits) else fits
            made = value({a: x[k] for a, x in values.items()}, {a: x[span] for a, x in values.items()})
            both = held[span] * held[k] if not whole else None
            s = made.sum(axis=1) if whole else (made * both).sum(axis=1)
            n = np.full(len(fits), len(ids)) if whole else both.sum(axis=1).astype(np.int64)
            some = n > 0
            out.append((np.full(int(some.sum()), frames[k]), frames[fits[some]], steps[k] - steps[fits[some]], s[some], n[some]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["cur", "org", "dts", "s", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            held = pa.concat_tables([*([held] if held is not None else []), pa.Table.from_batches([batch])]).combine_chunks()
            c, o, at = (np.asarray(held[x]) for x in ("c", "o", "id"))
            ends = np.flatnonzero((c[1:] != c[:-1]) | (o[1:] != o[:-1])) + 1  # a tile's rows are done
            begin = 0
            for end in ends:
                yield from solve(held.slice(begin, end - begin))
                begin = int(end)
            if held.num_rows - begin >= KERNEL_ROWS:
                cut = begin + int(np.searchsorted(at[begin:], at[-1]))  # the last particle may go on
                if cut > begin:
                    yield from solve(held.slice(begin, cut - begin))
                    begin = cut
            held = held.slice(begin)
        if held is not None and held.num_rows:
            yield from solve(held)

    parts = rows.repartition("id", "c", "o").sortWithinPartitions("c", "o", "id", "frame").mapInArrow(run, "cur long, org long, dts long, s double, n long")
    return parts.groupBy("cur", "org", "dts").agg((F.sum("s") / F.sum("n")).alias("v"))


def pairs_of_frames(signal: DataFrame, value: PairValue, stride: int = 1, since: int | None = None) -> DataFrame:
    """frame_pairs by the tiled kernel where the function takes arrays, by the join on id where it needs Columns."""
    return (frame_pairs_tiled if on_arrays(value) else frame_pairs)(signal, value, stride, since)


def block_errors(pairs: DataFrame, size: int) -> DataFrame:
    """key, n_blocks and sem from completed blocks of the key's pairs in arrival order: by cur, then by lag."""
    at = F.row_number().over(Window.partitionBy("key").orderBy("cur", F.desc("org"))) - 1
    blocks = pairs.withColumn("block", F.floor(at / size)).groupBy("key", "block").agg(F.avg("v").alias("b"), F.count("*").alias("n")).filter(F.col("n") == size)
    n, mean, square = F.count("*"), F.avg("b"), F.avg(F.col("b") * F.col("b"))
    spread = F.sqrt(F.greatest(F.lit(0.0), square - mean * mean) * n / (n - 1) / n)
    return blocks.groupBy("key").agg(n.alias("n_blocks"), F.when(n > 1, spread).otherwise(0.0).alias("sem"))


def lag_table(pairs: DataFrame, block_size: int) -> DataFrame:
    """Per key: value, count_pairs, mean_dtimestep, n_blocks, sem. pairs: key, cur, org, dts, v."""
    base = pairs.groupBy("key").agg(F.avg("v").alias("msd"), F.count("*").alias("count_pairs"), F.avg("dts").alias("mean_dtimestep"))
    if block_size <= 0:
        return base.withColumn("n_blocks", F.lit(0).cast("long")).withColumn("sem", F.lit(0.0))
    errors = block_errors(pairs, block_size)
    return base.join(errors, "key", "left").withColumn("n_blocks", F.coalesce("n_blocks", F.lit(0))).withColumn("sem", F.coalesce("sem", F.lit(0.0)))


def bin_sums(pairs: DataFrame, block_size: int) -> DataFrame:
    """Per key the sums that merge: of values, pairs and timestep differences, and of completed blocks' means."""
    base = pairs.groupBy("key").agg(F.sum("v").alias("s"), F.count("*").alias("c"), F.sum("dts").alias("d"))
    if block_size <= 0:
        return without_blocks(base)
    at = F.row_number().over(Window.partitionBy("key").orderBy("cur", F.desc("org"))) - 1
    full = pairs.withColumn("block", F.floor(at / block_size)).groupBy("key", "block").agg(F.avg("v").alias("b"), F.count("*").alias("n")).filter(F.col("n") == block_size)
    return base.join(full.groupBy("key").agg(F.sum("b").alias("bs"), F.sum(F.col("b") * F.col("b")).alias("bq"), F.count("*").alias("bn")), "key", "left").fillna(0)


def without_blocks(base: DataFrame) -> DataFrame:
    return base.withColumn("bs", F.lit(0.0)).withColumn("bq", F.lit(0.0)).withColumn("bn", F.lit(0).cast("long"))


_SUMS = {"s": "double", "c": "long", "d": "long", "bs": "double", "bq": "double", "bn": "long"}


def segment_ends(counts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For a bin that begins at each row: the row that completes it (or the number of rows), and where, once the bins
    behind it are made too, the unfinished one begins."""
    ahead = np.concatenate([[0], np.cumsum(counts)])
    ends = np.searchsorted(ahead[1:], ahead[:-1] + least)
    tails = np.arange(len(counts) + 1)
    for i in range(len(counts) - 1, -1, -1):
        if ends[i] < len(counts):
            tails[i] = tails[ends[i] + 1]
    return ends, tails


def merge_bins(base: DataFrame, least: int) -> DataFrame:
    """Bins (of bin_sums) with fewer than `least` pairs absorb the following ones; a last one too small joins the bin before.

    Block means of merged bins are pooled, unfinished blocks are not. The fold is a scan over ranges of bins: what a range
    does to the bin that enters it unfinished hangs only on that bin's number of pairs, of which there are `least`, so a
    range is summed up by at most so many rows. Those are joined in order, a few rows a range; then every range, which now
    knows what enters it, makes its own bins."""
    names = list(_SUMS)
    rows = base.select("key", *(F.col(n).cast(k).alias(n) for n, k in _SUMS.items())).repartitionByRange("key").sortWithinPartitions("key")
    placed = settle(rows.withColumn("part", F.spark_partition_id()), "bins")
    sums = ", ".join(f"{n} {k}" for n, k in _SUMS.items())

    def sorted_columns(table: pa.Table) -> dict[str, np.ndarray]:
        order = np.argsort(np.asarray(table["key"]), kind="stable")
        return {n: np.asarray(table[n])[order] for n in names}

    def batch(columns: dict[str, list], first: dict[str, list]) -> pa.Table:
        return pa.table({**first, **{n: pa.array(columns[n], pa.float64() if _SUMS[n] == "double" else pa.int64()) for n in names}})

    def summed(key: tuple, table: pa.Table) -> pa.Table:
        """Rows (part, needs, sums): a bin that enters with `needs` pairs or more leaves these sums; none enters with -1 but
        the range's own total."""
        columns = sorted_columns(table)
        ends, tails = segment_ends(columns["c"], least)
        ahead = np.cumsum(columns["c"])
        cuts = range(min(int(np.searchsorted(ahead, least)) + 1, len(ahead)))
        starts = [0, *(int(tails[j + 1]) for j in cuts)]
        part = key[0].as_py()
        return batch({n: [x[k:].sum() for k in starts] for n, x in columns.items()}, {"part": pa.array([part] * len(starts), pa.int32()), "needs": pa.array([-1, *(max(0, least - int(ahead[j])) for j in cuts)], pa.int64())})

    def joined(table: pa.Table) -> pa.Table:
        """What enters each range, and as part -1 what is left behind the last."""
        held, out = dict.fromkeys(names, 0), []
        ranges: dict[int, list[dict]] = {}
        for r in table.to_pylist():
            ranges.setdefault(r["part"], []).append(r)
        for part in sorted(ranges):
            out.append({"part": part, **held})
            total = next(r for r in ranges[part] if r["needs"] < 0)
            # The first cut is made by the bin that needs most, of those that what enters can complete.
            fits = [r for r in ranges[part] if 0 <= r["needs"] <= held["c"]]
            best = max(fits, key=lambda r: r["needs"]) if fits else None
            held = {n: best[n] for n in names} if best else {n: held[n] + total[n] for n in names}
        out.append({"part": -1, **held})
        return batch({n: [r[n] for r in out] for n in names}, {"part": pa.array([r["part"] for r in out], pa.int32())})

    def folded(key: tuple, table: pa.Table, entering: pa.Table) -> pa.Table:
        columns = sorted_columns(table)
        columns = {n: np.concatenate([np.asarray(entering[n])[:1].astype(x.dtype), x]) for n, x in columns.items()}
        ends, _ = segment_ends(columns["c"], least)
        starts, at = [], 0
        while at < len(ends) and ends[at] < len(ends):
            starts.append(at)
            at = int(ends[at]) + 1
        done = {n: np.add.reduceat(x[:at], starts) if starts else x[:0] for n, x in columns.items()}
        return batch(done, {"key": pa.array((key[0].as_py() << 32) + np.arange(len(starts), dtype=np.int64))})

    exits = placed.groupBy("part").applyInArrow(summed, f"part int, needs long, {sums}")
    # One group, of at most `least` + 1 rows a range.
    carried = settle(exits.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(joined, f"part int, {sums}"), "bins-carried")
    bins = placed.groupBy("part").cogroup(carried.filter("part >= 0").groupBy("part")).applyInArrow(folded, f"key long, {sums}")
    bins = settle(bins, "bins-merged")
    last = bins.agg(F.coalesce(F.max("key"), F.lit(0).cast("long")).alias("key"))
    left = carried.filter("part < 0 and c > 0").withColumn("one", F.lit(1)).join(last.withColumn("one", F.lit(1)), "one")  # a row and a row
    merged = bins.select("key", *names).unionByName(left.select("key", *names)).groupBy("key").agg(*(F.sum(n).alias(n) for n in names))
    mean = F.col("bs") / F.col("bn")
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("bq") / F.col("bn") - mean * mean) * F.col("bn") / (F.col("bn") - 1) / F.col("bn"))
    return merged.select("key", (F.col("s") / F.col("c")).alias("msd"), F.col("c").alias("count_pairs"), (F.col("d") / F.col("c")).alias("mean_dtimestep"), F.col("bn").alias("n_blocks"), F.when(F.col("bn") > 1, spread).otherwise(0.0).alias("sem"))


SERIES = ["lag", "time", "msd", "count_pairs", "sem", "n_blocks", "mean_dtimestep"]


def exact(signal: DataFrame, spec: CorrelatorSpec, value: PairValue | None = None, tiled: bool = True) -> DataFrame:
    """The exact correlator over all pairs of frames; `tiled` false asks for the join on id whatever the function."""
    value = value or squared_displacement(spec.components)
    return exact_series((pairs_of_frames if tiled else frame_pairs)(signal, value, spec.lag_stride), spec)


def exact_series(pairs: DataFrame, spec: CorrelatorSpec) -> DataFrame:
    """The series of the pairs that frame_pairs made, all at once or batch after batch."""
    if spec.axis == "frame":
        keyed = pairs.withColumn("key", F.col("cur") - F.col("org"))
    elif spec.axis == "timestep":
        keyed = pairs.withColumn("key", F.col("dts"))
    else:
        keyed = pairs.withColumn("key", F.floor(F.col("dts") * spec.dt / spec.width).cast("long"))
    merged = spec.axis == "timebin" and spec.merges
    return on_axis(merge_bins(bin_sums(keyed, spec.block_size), spec.min_pairs_per_bin) if merged else lag_table(keyed, spec.block_size), spec)


def on_axis(rows: DataFrame, spec: CorrelatorSpec) -> DataFrame:
    """Rows by key as a series: lag and time in the axis' units."""
    mean_time = F.col("mean_dtimestep") * spec.dt
    if spec.axis == "frame":
        lag, time = F.col("key").cast("double"), mean_time
    elif spec.axis == "timestep":
        lag, time = F.col("key").cast("double"), F.col("key") * F.lit(spec.dt)
    else:
        lag = time = mean_time
    return rows.withColumn("lag", lag).withColumn("time", time).select(*SERIES)


def spectral(signal: DataFrame, spec: CorrelatorSpec) -> DataFrame:
    """The exact correlator of squared displacements from Fourier transforms, without pairs and so without block errors."""
    sums = lag_sums(signal, COMPONENTS[spec.components], spec.lag_stride, equal_steps=spec.axis != "frame")
    if spec.axis == "frame":
        key = F.col("lag")
    elif spec.axis == "timestep":
        key = F.expr("d div c")
    else:
        key = F.floor(F.col("d") / F.col("c") * spec.dt / spec.width).cast("long")
    base = without_blocks(sums.groupBy(key.alias("key")).agg(*(F.sum(x).alias(x) for x in "scd")))
    if spec.axis == "timebin" and spec.merges:
        return on_axis(merge_bins(base, spec.min_pairs_per_bin), spec)
    rows = base.select("key", (F.col("s") / F.col("c")).alias("msd"), F.col("c").alias("count_pairs"), (F.col("d") / F.col("c")).alias("mean_dtimestep"), F.col("bn").alias("n_blocks"), F.lit(0.0).alias("sem"))
    return on_axis(rows, spec)


Average = Callable[[Column, Column], Column]


def coarse_levels(signal: DataFrame, levels: int, average: Average | None = None) -> DataFrame:
    """level, k and averaged samples: level l+1 averages neighbouring samples 2k and 2k+1 of level l, both present.
    `average` makes the coarse value of two neighbours, their mean by default.

    The timestep of an average is the sum of the two halves, each truncated."""
    at = (F.dense_rank().over(Window.partitionBy("id").orderBy("frame")) - 1).cast("long")
    level = signal.select("id", at.alias("k"), "timestep", "x", "y", "z")
    out = level.withColumn("level", F.lit(0))
    mean = average or (lambda a, b: (a + b) * 0.5)
    for n in range(1, levels):
        odd = F.col("k") % 2
        first = lambda c: F.max(F.when(odd == 0, F.col(c)))  # noqa: E731, B023
        second = lambda c: F.max(F.when(odd == 1, F.col(c)))  # noqa: E731, B023
        half = lambda c: F.expr(f"{c} div 2")
        level = (
            level.withColumn("half", half("timestep"))
            .groupBy("id", F.expr("k div 2").alias("k"))
            .agg(F.count("*").alias("n"), (first("half") + second("half")).alias("timestep"), *(mean(first(c), second(c)).alias(c) for c in "xyz"))
            .filter("n = 2")
            .select("id", "k", "timestep", "x", "y", "z")
        )
        out = out.unionByName(level.withColumn("level", F.lit(n)))
    return out


def multi_tau(signal: DataFrame, spec: CorrelatorSpec, value: PairValue | None = None, average: Average | None = None) -> DataFrame:
    """Lags d * 2^level: d of 1..m at level 0 and of m/2+1..m above, on the coarse samples of each level.

    The offsets d are spelled out, so pairs meet by an exact key (level, id, k) and not by a range."""
    m = spec.channels
    samples = coarse_levels(signal, spec.levels, average)
    d = F.explode(F.when(F.col("level") == 0, F.sequence(F.lit(1), F.lit(m))).otherwise(F.sequence(F.lit(m // 2 + 1), F.lit(m))))
    cur = samples.select("level", "id", F.col("k").alias("cur"), F.col("timestep").alias("cur_ts"), *(F.col(c).alias(f"cur_{c}") for c in "xyz"), d.alias("d")).withColumn("org", F.col("cur") - F.col("d"))
    org = samples.select("level", "id", F.col("k").alias("org"), F.col("timestep").alias("org_ts"), *(F.col(c).alias(f"org_{c}") for c in "xyz"))
    side = lambda s: {c: F.col(f"{s}_{c}") for c in "xyz"}
    f = value or squared_displacement(spec.components)
    met = cur.join(org, ["level", "id", "org"]).filter("cur_ts > org_ts")
    key = F.col("d") * F.expr("cast(shiftleft(1L, level) as long)")
    pairs = met.groupBy(key.cast("long").alias("key"), "cur", "org", (F.col("cur_ts") - F.col("org_ts")).alias("dts")).agg(F.avg(f(side("cur"), side("org"))).alias("v"))
    rows = lag_table(pairs, spec.block_size)
    return rows.withColumn("lag", F.col("key").cast("double")).withColumn("time", F.col("mean_dtimestep") * spec.dt).select(*SERIES)


def correlate(signal: DataFrame, spec: CorrelatorSpec, value: PairValue | None = None, average: Average | None = None) -> DataFrame:
    if spec.kind == "fft":
        if value is not None:
            raise ValueError("the fft correlator knows squared displacements only")
        return spectral(signal, spec)
    return exact(signal, spec, value) if spec.kind == "exact" else multi_tau(signal, spec, value, average)


def prepared(positions: DataFrame, members: DataFrame | None = None, drift: DataFrame | None = None, remove_drift: bool = True, frames: tuple[int, int] = (0, -1)) -> DataFrame:
    """The frames in range of the members (ids; all by default), less the drift of the `drift` ids."""
    first, last = frames
    rows = positions.filter((F.col("frame") >= first) & ((F.col("frame") <= last) if last >= 0 else F.lit(True)))
    if remove_drift:
        rows = without_drift(rows, None if drift is None else rows.join(drift, "id", "left_semi"))
    return rows if members is None else rows.join(members, "id", "left_semi")


def msd(positions: DataFrame, spec: CorrelatorSpec, members: DataFrame | None = None, drift: DataFrame | None = None, remove_drift: bool = True, frames: tuple[int, int] = (0, -1)) -> DataFrame:
    """Mean squared displacement of the members, less the drift (see `prepared`)."""
    return correlate(prepared(positions, members, drift, remove_drift, frames), spec)


def single_origin_msd(positions: DataFrame, origin: int = 0, remove_drift: bool = True) -> DataFrame:
    """Per frame: mean squared displacement from one origin; with drift removed mean(d^2) - 2 v.mean(d) + v^2, at least 0."""
    org = positions.filter(F.col("frame") == origin).select("id", *(F.col(c).alias(f"o{c}") for c in "xyz"))
    rows = positions.join(org, "id").select("frame", *((F.col(c) - F.col(f"o{c}")).alias(c) for c in "xyz"))
    square = F.avg(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    means = rows.groupBy("frame").agg(square.alias("msd"), *(F.avg(c).alias(f"m{c}") for c in "xyz"))
    if remove_drift:
        drift = F.col("mx") * F.col("mx") + F.col("my") * F.col("my") + F.col("mz") * F.col("mz")
        means = means.withColumn("msd", F.greatest(F.lit(0.0), F.col("msd") - drift))
    return means.select("frame", "msd")
