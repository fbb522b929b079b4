"""Correlators as keyed state of a stream: particles in buckets, each a key whose state Spark keeps in its state store.

The exact correlator's state is a list with an element for each frame of a bucket (packed arrays of ids and values), to
which new frames are appended; old ones are read one after the other and compared with the new. The multi-tau state is one
packed value: levels * channels samples a particle. Both give, for each pair of samples that completes, the sum over the
bucket's particles and their number, so what is written grows with the pairs of frames and the buckets, and not with the
particles. Particles may lack frames, and a frame's rows may come in several batches."""

from __future__ import annotations

import io
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.correlate import COMPONENTS, SERIES, CorrelatorSpec, exact_series, lag_table

PAIRS = "level int, d int, cur long, org long, dts long, s double, n long"
_PAIRS = ["level", "d", "cur", "org", "dts", "s", "n"]
#: Keys that the particles are dealt to; more for more than some 10^4 particles a bucket.
BUCKETS = 64
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """The state store that list state needs, for queries that start within; a query keeps what it started with."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def frames_of(rows: pd.DataFrame, axes: str) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """(frame, timestep, ids ascending, values) of every frame, in order."""
    out = []
    for frame, part in rows.sort_values(["frame", "id"]).groupby("frame", sort=True):
        out.append((int(frame), int(part["timestep"].iloc[0]), part["id"].to_numpy(np.int64), part[list(axes)].to_numpy(np.float64)))
    return out


class ExactState(StatefulProcessor):
    """The window of a bucket, a list element a frame (or a part of one)."""

    def __init__(self, axes: str, stride: int) -> None:
        self.axes, self.stride = axes, stride

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.window = handle.getListState("window", "frame long, timestep long, ids binary, v binary")

    def close(self) -> None:
        pass

    def _pair(self, a: tuple, b: tuple) -> tuple | None:
        cur, org = (a, b) if a[0] > b[0] else (b, a)
        lag, dts = cur[0] - org[0], cur[1] - org[1]
        if lag <= 0 or lag % self.stride or dts <= 0:
            return None
        if len(cur[2]) == len(org[2]) and (cur[2] == org[2]).all():
            x, y = cur[3], org[3]
        else:
            _, i, j = np.intersect1d(cur[2], org[2], assume_unique=True, return_indices=True)
            x, y = cur[3][i], org[3][j]
        return (0, lag, cur[0], org[0], dts, float(((x - y) ** 2).sum()), len(x)) if len(x) else None

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = frames_of(pd.concat(list(rows)), self.axes)
        out = []
        for frame, timestep, ids, v in self.window.get():
            old = (frame, timestep, np.frombuffer(ids, np.int64), np.frombuffer(v, np.float64).reshape(-1, len(self.axes)))
            out += [p for x in new if (p := self._pair(x, old))]
        out += [p for i, x in enumerate(new) for y in new[:i] if (p := self._pair(x, y))]
        self.window.appendList([(f, t, ids.tobytes(), np.ascontiguousarray(v).tobytes()) for f, t, ids, v in new])
        yield pd.DataFrame(out, columns=_PAIRS)


class Levels:
    """The multi-tau levels of many particles: rings of the last m samples, what waits for its neighbour, counters."""

    def __init__(self, m: int, levels: int, axes: int) -> None:
        self.m, self.levels, self.axes = m, levels, axes
        self.ids = np.zeros(0, np.int64)
        self.ring, self.time = np.zeros((levels, m, 0, axes)), np.zeros((levels, m, 0), np.int64)
        self.wait, self.wait_time, self.waits = np.zeros((levels, 0, axes)), np.zeros((levels, 0), np.int64), np.zeros((levels, 0), bool)
        self.next = np.zeros((levels, 0), np.int64)

    NAMES = ("ids", "ring", "time", "wait", "wait_time", "waits", "next")

    def packed(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{n: getattr(self, n) for n in self.NAMES})
        return out.getvalue()

    def restored(self, data: bytes) -> Levels:
        held = np.load(io.BytesIO(data))
        for n in self.NAMES:
            setattr(self, n, held[n])
        return self

    def admit(self, ids: np.ndarray) -> np.ndarray:
        """Places of the particles; new ones get room."""
        fresh = np.setdiff1d(ids, self.ids)
        if len(fresh):
            every = np.union1d(self.ids, fresh)
            at = np.searchsorted(every, self.ids)
            for n in self.NAMES[1:]:
                old = getattr(self, n)
                axis = 2 if n in ("ring", "time") else 1
                new = np.zeros([len(every) if k == axis else x for k, x in enumerate(old.shape)], old.dtype)
                new[(slice(None),) * axis + (at,)] = old
                setattr(self, n, new)
            self.ids = every
        return np.searchsorted(self.ids, ids)

    def push(self, who: np.ndarray, timestep: np.ndarray, v: np.ndarray, level: int, out: list) -> None:
        k = self.next[level, who]
        for d in range(1 if level == 0 else self.m // 2 + 1, self.m + 1):
            some = np.flatnonzero(k >= d)
            if not len(some):
                break
            spot = (k[some] - d) % self.m
            dts = timestep[some] - self.time[level, spot, who[some]]
            square = ((v[some] - self.ring[level, spot, who[some]]) ** 2).sum(axis=1)
            fits = dts > 0
            # All particles of a bucket are usually as far as each other: one row.
            pairs, at = np.unique(np.stack([k[some][fits], dts[fits]]), axis=1, return_inverse=True)
            sums, counts = np.bincount(at.ravel(), square[fits], pairs.shape[1]), np.bincount(at.ravel(), minlength=pairs.shape[1])
            out += [(level, d, int(c), int(c) - d, int(t), float(s), int(n)) for c, t, s, n in zip(*pairs, sums, counts)]
        self.ring[level, k % self.m, who], self.time[level, k % self.m, who] = v, timestep
        self.next[level, who] = k + 1
        if level + 1 == self.levels:
            return
        second = self.waits[level, who]
        first = who[~second]
        self.wait[level, first], self.wait_time[level, first], self.waits[level, first] = v[~second], timestep[~second], True
        both = who[second]
        if len(both):
            self.waits[level, both] = False
            halves = np.trunc(self.wait_time[level, both] / 2).astype(np.int64) + np.trunc(timestep[second] / 2).astype(np.int64)
            self.push(both, halves, (self.wait[level, both] + v[second]) * 0.5, level + 1, out)


class MultiTauState(StatefulProcessor):
    def __init__(self, m: int, levels: int, axes: str) -> None:
        self.m, self.levels, self.axes = m, levels, axes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("levels", "data binary")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        levels, before = Levels(self.m, self.levels, len(self.axes)), self.held.get()
        if before is not None:
            levels.restored(bytes(before[0]))
        out: list[tuple] = []
        for _, timestep, ids, v in frames_of(pd.concat(list(rows)), self.axes):
            levels.push(levels.admit(ids), np.full(len(ids), timestep), v, 0, out)
        self.held.update((levels.packed(),))
        yield pd.DataFrame(out, columns=_PAIRS)


def pair_sums(stream: DataFrame, spec: CorrelatorSpec, buckets: int = BUCKETS) -> DataFrame:
    """PAIRS of a stream of (frame, timestep, id, x, y, z): for each pair that completes, sum and number of a bucket's particles."""
    axes = COMPONENTS[spec.components]
    processor = MultiTauState(spec.channels, spec.levels, axes) if spec.kind == "multitau" else ExactState(axes, spec.lag_stride)
    dealt = stream.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)))
    return dealt.groupBy("bucket").transformWithStateInPandas(processor, PAIRS, "Append", "None")


def summarise_pairs(pairs: DataFrame, spec: CorrelatorSpec) -> DataFrame:
    mean = (F.sum("s") / F.sum("n")).alias("v")
    if spec.kind == "exact":
        return exact_series(pairs.groupBy("cur", "org", "dts").agg(mean), spec)
    key = F.col("d") * F.expr("cast(shiftleft(1L, level) as long)")
    frames = pairs.groupBy(key.cast("long").alias("key"), "cur", "org", "dts").agg(mean)
    rows = lag_table(frames, spec.block_size)
    return rows.withColumn("lag", F.col("key").cast("double")).withColumn("time", F.col("mean_dtimestep") * spec.dt).select(*SERIES)
