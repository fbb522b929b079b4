"""Binned, running and blocked statistics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.durable import settle


def uniform_bin(x: Column, low: float, high: float, n: int) -> Column:
    """Bin 0..n-1 of [low, high); null outside and for NaN. Rounding at the upper edge stays in the last bin."""
    if n < 1 or not low < high:
        raise ValueError("a histogram needs bins and an ascending range")
    return F.when((x >= low) & (x < high), F.least(F.floor((x - low) * (n / (high - low))), F.lit(n - 1)).cast("long"))


def histogram(df: DataFrame, column: str, low: float, high: float, n: int, weight: str | None = None) -> DataFrame:
    """bin, center and summed weight of every bin, empty ones too; bin -1 holds the underflow, bin n the overflow."""
    x = F.col(column)
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    at = F.when(x < low, -1).when(x >= high, n).otherwise(uniform_bin(x, low, high, n)).cast("long")
    sums = df.filter(x.isNotNull() & ~F.isnan(x)).groupBy(at.alias("bin")).agg(F.sum(w).alias("weight"))
    bins = df.sparkSession.range(-1, n + 1).select(F.col("id").alias("bin"))
    width = (high - low) / n
    center = F.when((F.col("bin") >= 0) & (F.col("bin") < n), F.lit(float(low)) + (F.col("bin") + 0.5) * width)
    return bins.join(F.broadcast(sums), "bin", "left").select("bin", center.alias("center"), F.coalesce("weight", F.lit(0.0)).alias("weight"))


def histogram_2d(df: DataFrame, x: str, y: str, xs: tuple[float, float, int], ys: tuple[float, float, int]) -> DataFrame:
    """ix, iy and weight of the bins that hold something; ix = iy = -1 underflow (tested first), -2 overflow."""
    u, v = F.col(x), F.col(y)
    under, over = (u < xs[0]) | (v < ys[0]), (u >= xs[1]) | (v >= ys[1])
    ix = F.when(under, -1).when(over, -2).otherwise(uniform_bin(u, *xs)).cast("long")
    iy = F.when(under, -1).when(over, -2).otherwise(uniform_bin(v, *ys)).cast("long")
    rows = df.filter(u.isNotNull() & v.isNotNull() & ~F.isnan(u) & ~F.isnan(v))
    return rows.groupBy(ix.alias("ix"), iy.alias("iy")).agg(F.sum(F.lit(1.0)).alias("weight"))


def log_bin(x: Column, low: float, high: float, n: int) -> Column:
    """Bin 0..n-1 of a logarithmic scale; n for what is out of range."""
    if not 0 < low < high or n < 1:
        raise ValueError("logarithmic bins need 0 < low < high")
    scale = n / math.log(high / low)
    inside = (x >= low) & (x < high)
    return F.when(inside, F.least(F.floor(F.ln(F.when(inside, x) / low) * scale), F.lit(n - 1))).otherwise(n).cast("long")


def log_edges(low: float, high: float, n: int) -> list[float]:
    return [low * (high / low) ** (i / n) for i in range(n + 1)]


def mean_and_variance(df: DataFrame, column: str, by: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """n, mean, var_pop, var_sample, std_pop, std_sample; 0 where too few values make one.

    With `order` (and groups) a group's values are taken one after the other in that order, so the last bits don't hang on
    how the rows were split; a group's rows then stream through one task, sorted. Without it, tasks' partial results are
    merged as they come."""
    x = F.col(column)
    if order is not None:
        if not by:
            raise ValueError("values are taken in order within groups")
        # Rows of a group lie side by side, in order: the aggregation behind needs no further exchange.
        df = df.select(*dict.fromkeys([*by, *order, column])).repartition(*by).sortWithinPartitions(*by, *order)
    zero = lambda c, name: F.coalesce(c, F.lit(0.0)).alias(name)
    return df.groupBy(*(by or [])).agg(F.count(x).alias("n"), zero(F.avg(x), "mean"), zero(F.var_pop(x), "var_pop"), zero(F.var_samp(x), "var_sample"), zero(F.stddev_pop(x), "std_pop"), zero(F.stddev_samp(x), "std_sample"))


def size_statistics(df: DataFrame, column: str) -> DataFrame:
    """samples, min, max, mean and sample variance (0 below two samples) of per-frame sizes."""
    x = F.col(column)
    return df.agg(F.count(x).alias("samples"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), F.coalesce(F.var_samp(x), F.lit(0.0)).alias("variance"))


def blocks(df: DataFrame, value: str, order: list[str], size: int, by: list[str] | None = None) -> DataFrame:
    """Means of the completed blocks of `size` consecutive rows; numbering restarts in every group of `by`.

    Without groups the rows are numbered by ranges: each range is numbered apart and moved by the counts before it, so
    no single task sorts them all."""
    by = by or []
    if by:
        at = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
        numbered = df.withColumn("__row", at)
    else:
        numbered = numbered_globally(df.select(*dict.fromkeys([value, *order])), order, "__row")
    block = F.floor(F.col("__row") / size).cast("long")
    return numbered.groupBy(*by, block.alias("block")).agg(F.avg(value).alias("mean"), F.count("*").alias("n")).filter(F.col("n") == size)


def numbered_globally(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with a gapless number from 0 in the given order.

    The rows, range-partitioned and numbered within their partition, are settled before anything is counted: the counts
    and the rows then come from one and the same partitioning. (Two range exchanges would each draw a sample of their
    own, and their partitions need not agree.)"""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    placed = settle(placed, "numbered")
    part, local = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    # One row for each partition: bounded by their number.
    counts = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__c"))
    before = counts.select("__part", F.coalesce(F.sum("__c").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__b"))
    rows = placed.withColumn("__part", part).withColumn("__n", local)
    return rows.join(F.broadcast(before), "__part").withColumn(name, F.col("__n") + F.col("__b")).select(*df.columns, name)


#: Values that one group of an ordered sum folds.
FOLD = 1024


def ordered_sum(df: DataFrame, value: str, order: list[str]) -> DataFrame:
    """One row `sum`: the values added in an order that is always the same, so repeated runs agree to the last bit.

    Runs of FOLD values in the given order are folded one by one, then the runs' sums in the same way, up to one; no
    task holds more than its runs."""
    rows = numbered_globally(df.select(*dict.fromkeys([*order, value])), order, "i").select(F.lit(0).alias("key"), "i", F.col(value).cast("double").alias("v"))
    return _folded(rows, rows.count()).agg(F.coalesce(F.max("v"), F.lit(0.0)).alias("sum"))


def ordered_sums(df: DataFrame, value: str, key: str, order: str) -> DataFrame:
    """key and its `sum`, the values of a key added in the order of an integer column that names them once."""
    rows = df.select(F.col(key).alias("key"), F.col(order).cast("long").alias("i"), F.col(value).cast("double").alias("v"))
    # Runs by the integer's leading digits: as many levels as its range asks for.
    top = rows.agg(F.max("i")).first()[0]
    return _folded(rows, (top or 0) + 1).select(F.col("key").alias(key), F.col("v").alias("sum"))


def _folded(rows: DataFrame, left: int) -> DataFrame:
    while True:
        run = F.array_sort(F.collect_list(F.struct("i", "v")))
        rows = rows.groupBy("key", F.expr(f"i div {FOLD}").alias("i")).agg(F.aggregate(run, F.lit(0.0), lambda a, x: a + F.coalesce(x["v"], F.lit(0.0))).alias("v"))
        left = -(-left // FOLD)
        if left <= 1:
            return rows


def block_summary(means: DataFrame, mean: str = "mean") -> DataFrame:
    """n_blocks, mean of block means, their sample variance and standard error; 0 where too few."""
    n = F.count(mean)
    var = F.coalesce(F.var_samp(mean), F.lit(0.0))
    return means.agg(n.alias("n_blocks"), F.coalesce(F.avg(mean), F.lit(0.0)).alias("mean"), var.alias("variance"), F.when(n > 1, F.sqrt(var / n)).otherwise(0.0).alias("sem"))
