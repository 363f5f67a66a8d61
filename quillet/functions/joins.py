"""Joins that Spark plans badly as they stand."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillet.functions.shared import small_side


def not_in(outer: DataFrame, key: str, inner: DataFrame, inner_key: str) -> DataFrame:
    """Rows of ``outer`` whose key is NOT IN the inner keys, by the rules of SQL: an inner null lets none pass, a null key
    passes only an empty inner side. Spark's own null-aware join broadcasts the whole inner side; here one row tells whether
    it is empty or has nulls, and the rest is an anti join that Spark may shuffle."""
    keys = inner.select(F.col(inner_key).alias("_key"))
    told = keys.agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("_key").isNull()).alias("_nulls"))
    open_ = (F.col("_n") == 0) | ((F.col("_nulls") == 0) & F.col(key).isNotNull())
    d = outer.crossJoin(F.broadcast(told)).where(open_).drop("_n", "_nulls")
    return d.join(keys, d[key] == keys["_key"], "left_anti")


def spread_join(many: DataFrame, key: str, spread: str, few: DataFrame, few_key: str, pairs: int = 4_000_000) -> DataFrame:
    """The equi-join of two narrow tables on a key of few values, whose result is far larger than both: Spark deals it by the
    key, or by the few files of the larger side. Here the pairs are counted first, and the rows of ``many`` are dealt by
    ``spread``, which tells them apart, to so many tasks that one gives out about ``pairs`` of them. ``few`` goes to every task,
    as a broadcast up to a million rows, beyond that as a copy for each share of a key."""
    left, right = many.groupBy(key).agg(F.count(F.lit(1)).alias("_l")), few.groupBy(few_key).agg(F.count(F.lit(1)).alias("_r"))
    n = left.join(right, left[key] == right[few_key]).agg(F.sum(F.col("_l").cast("double") * F.col("_r")), F.max(F.col("_l").cast("double") * F.col("_r"))).first()
    tasks, shares = (max(1, math.ceil((x or 0) / pairs)) for x in n)
    side = small_side(few)
    if side is not few:
        return many.repartition(tasks, F.col(spread)).join(side, F.col(key) == F.col(few_key))
    copies = few.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    dealt = many.withColumn("_share", F.pmod(F.xxhash64(spread), F.lit(shares)).cast("int"))
    both = dealt.repartition(tasks, key, "_share").join(copies.repartition(tasks, few_key, "_share"), (F.col(key) == F.col(few_key)) & (dealt["_share"] == copies["_share"]))
    return both.drop("_share")
