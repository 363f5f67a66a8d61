"""Row numbers and running sums over a whole table without one task that sorts it."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillet.functions.shared import saved

_LOCAL = (1 << 33) - 1


def seeded(key: Column, seed: int) -> Column:
    """A reproducible random order: md5 of seed and key, which every engine computes alike."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))


def _ranged(df: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """Rows in ranges of the order with ``_p``, their range, and ``_i``, their place in it. The table is stored: both
    passes over it see the same ranges, even if an executor is lost in between."""
    d = df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    return saved(d.withColumn("_p", F.shiftright("_m", 33)).withColumn("_i", F.col("_m").bitwiseAND(F.lit(_LOCAL))).drop("_m"))


def _offsets(sizes: DataFrame, *by: str) -> DataFrame:
    """(by.., _p, _o): sum of ``_n`` of the ranges before; a row for each range and key."""
    before = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("_o", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")


def global_rank(df: DataFrame, *order: str, name: str = "rank") -> DataFrame:
    """``df`` with its 0-based place in the order of columns that identify a row.

    Rows are range-partitioned and numbered inside each partition; the partitions' sizes, one row each, give the offsets.
    """
    d = _ranged(df, order)
    offsets = _offsets(d.groupBy("_p").agg(F.count(F.lit(1)).alias("_n")))
    return d.join(F.broadcast(offsets), "_p").withColumn(name, F.col("_o") + F.col("_i")).drop("_p", "_i", "_o")


def rank_in_groups(df: DataFrame, group: str, *order: str, name: str = "rank") -> DataFrame:
    """``df`` with its 0-based place inside its group; a group of any size is spread over ranges."""
    ranked = global_rank(df, group, *order, name="_g")
    start = ranked.groupBy(group).agg(F.min("_g").alias("_s"))
    return ranked.join(start, group).withColumn(name, F.col("_g") - F.col("_s")).drop("_g", "_s")


def running_sum(df: DataFrame, value: str, *order: str, name: str = "before") -> DataFrame:
    """``df`` with the sum of ``value`` over all rows before it in the order of columns that identify a row."""
    d = _ranged(df, order)
    offsets = _offsets(d.groupBy("_p").agg(F.sum(value).alias("_n")))
    inside = F.coalesce(F.sum(value).over(Window.partitionBy("_p").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return d.withColumn("_w", inside).join(F.broadcast(offsets), "_p").withColumn(name, F.col("_o") + F.col("_w")).drop("_p", "_i", "_o", "_w")


def exact_percentile(df: DataFrame, value: str, share: float, bins: int = 1024, few: int = 100_000) -> float | None:
    """The ``share`` percentile of a number column, interpolated between its two neighbours; null and NaN are left out.

    Distributed selection: the values are counted in equal bins between their bounds, the bin that holds the place is cut
    again, and once at most ``few`` values (or one repeated value) are left, these are sorted. No task holds all values."""
    v = saved(df.select(F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v")))
    n = v.count()
    if not n:
        return None
    place = (n - 1) * share
    low, high = (_nth(v, int(i), bins, few) for i in (math.floor(place), math.ceil(place)))
    return low + (high - low) * (place - math.floor(place)) if high != low else low


def _nth(v: DataFrame, place: int, bins: int, few: int) -> float:
    """The value at a 0-based place in the order of ``v``."""
    while True:
        n, low, high = v.agg(F.count("v"), F.min("v"), F.max("v")).first()
        if low == high:
            return low
        if n <= few:
            return sorted(r[0] for r in v.collect())[place]
        # scaled first, so that the width of the widest range is a number
        at = F.least(F.floor((F.col("v") / 2 - low / 2) / (high / 2 - low / 2) * bins), F.lit(bins - 1))
        binned = v.withColumn("b", at)
        before = 0
        for b, count in sorted(binned.groupBy("b").count().collect()):  # at most ``bins`` rows
            if place < before + count:
                break
            before += count
        if count == n:  # one bin holds all: halve between the least and the rest
            rest = v.where(F.col("v") > low)
            ties = n - rest.count()
            if place < ties:
                return low
            v, place = rest, place - ties
        else:
            v, place = binned.where(F.col("b") == b).select("v"), place - before
