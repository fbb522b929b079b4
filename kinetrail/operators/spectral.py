"""Exact mean squared displacements from Fourier transforms: F log F work for a particle of F frames, and no pairs of frames.

For a lag of k frames the sum over a particle's pairs is S1(k) - 2 S2(k): S1 sums |r(t)|^2 + |r(t+k)|^2 and comes from
prefix sums, S2 is the autocorrelation of r, from zero-padded transforms. Transforms are linear, so particles are summed
in the frequency domain and each kernel call goes back once. Positions are taken from each particle's mean first, which
changes no displacement and keeps both sums small.

Particles meet in partitions by id; a call holds some `KERNEL_NUMBERS` numbers of whole particles (one at least). What is
shuffled after that is a row for each lag and call. All particles must have the same frames, without gaps, and timesteps
that go forward; axes of timesteps and time bins need equal steps. Anything else is an error, never a wrong mean.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Numbers (frames times axes of whole particles) of a kernel call.
KERNEL_NUMBERS = 1 << 20


def summed_squares(values: np.ndarray) -> np.ndarray:
    """Sums over particles and pairs of squared displacements at lags 1..F-1. values: particles x frames x axes."""
    frames = values.shape[1]
    values = values - values.mean(axis=1, keepdims=True)
    squares = (values * values).sum(axis=(0, 2))
    ahead = np.cumsum(squares)  # of frames 0..t
    s1 = ahead[-1] - ahead[:-1] + ahead[-2::-1]
    width = 1 << (2 * frames - 1).bit_length()
    power = np.zeros(width // 2 + 1)
    for axis in range(values.shape[2]):
        wave = np.fft.rfft(values[:, :, axis], width, axis=1)
        power += (wave.real * wave.real + wave.imag * wave.imag).sum(axis=0)
    return np.maximum(s1 - 2 * np.fft.irfft(power, width)[1:frames], 0.0)


def check_frames(frame: np.ndarray, timestep: np.ndarray, equal: bool) -> None:
    """frame, timestep: particles x frames of the call."""
    if (frame != frame[0]).any() or (np.diff(frame[0]) != 1).any():
        raise ValueError("the fft correlator needs every particle in every frame, without gaps")
    steps = np.diff(timestep[0])
    if (timestep != timestep[0]).any() or (steps <= 0).any():
        raise ValueError("the fft correlator needs timesteps that go forward and are shared by all particles")
    if equal and len(steps) and (steps != steps[0]).any():
        raise ValueError("the fft correlator needs equal steps on this axis")


def lag_sums(signal: DataFrame, axes: str = "xyz", stride: int = 1, equal_steps: bool = False) -> DataFrame:
    """lag (frames), s (sum over its pairs of frames of the mean over particles), c (pairs) and d (sum of timestep differences)."""

    def solve(table: pa.Table) -> Iterator[pa.RecordBatch]:
        ids = np.asarray(table["id"])
        n = 1 + int((ids[1:] != ids[:-1]).sum())
        if len(ids) % n or (ids.reshape(n, -1) != ids[:: len(ids) // n, None]).any():
            raise ValueError("the fft correlator needs every particle in every frame, once")
        shape = (n, len(ids) // n)
        frame, step = (np.asarray(table[c]).reshape(shape) for c in ("frame", "timestep"))
        check_frames(frame, step, equal_steps)
        sums = summed_squares(np.stack([np.asarray(table[a]).reshape(shape) for a in axes], axis=2)) if shape[1] > 1 else np.zeros(0)
        ahead = np.cumsum(step[0])
        dts = (ahead[-1] - ahead[:-1]) - ahead[-2::-1]
        lag = np.arange(1, shape[1])
        keep = lag % stride == 0
        lag, sums, dts = lag[keep], sums[keep], dts[keep]
        # A row of lag 0 carries the frames of the call, so that calls can be compared.
        column = lambda first, rest: pa.array(np.concatenate([[first], rest]).astype(np.int64))
        yield pa.RecordBatch.from_arrays(
            [column(0, lag), pa.array(np.concatenate([[0.0], sums])), pa.array(np.full(len(lag) + 1, n)), column(0, shape[1] - lag), column(int(step[0, 0]) * 31 + int(step[0, -1]), dts), pa.array(np.full(len(lag) + 1, frame[0, 0])), pa.array(np.full(len(lag) + 1, shape[1]))],
            ["lag", "s", "n", "c", "d", "first", "frames"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) * len(axes) >= KERNEL_NUMBERS:
                table = pa.Table.from_batches(held)
                at = np.asarray(table["id"])
                cut = int(np.searchsorted(at, at[-1]))  # the last particle may go on
                if cut:
                    yield from solve(table.slice(0, cut))
                held = table.slice(cut).combine_chunks().to_batches()
        if held:
            yield from solve(pa.Table.from_batches(held))

    rows = signal.select("id", "frame", "timestep", *axes).repartition("id").sortWithinPartitions("id", "frame")
    parts = rows.mapInArrow(run, "lag long, s double, n long, c long, d long, first long, frames long")
    differs = (F.min("first") != F.max("first")) | (F.min("frames") != F.max("frames")) | (F.min("d") != F.max("d"))
    met = parts.groupBy("lag").agg((F.sum("s") / F.sum("n")).alias("s"), F.max("c").alias("c"), F.max("d").alias("d"), differs.alias("differs"), F.max("frames").alias("frames"))
    refused = F.when(F.col("differs"), F.raise_error(F.lit("the fft correlator needs the same frames of all particles")))
    return met.withColumn("s", F.coalesce(refused.cast("double"), F.col("s"))).filter("lag > 0").select("lag", "s", "c", "d")
