"""Connected components of a link table, as Spark jobs (alternating large-star and small-star steps)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def _star(edges: DataFrame, key: str, other: str, low: DataFrame) -> DataFrame:
    """Both sides are stored tables, so adaptive execution may split the rows of a hub."""
    return edges.join(low, edges[key] == low["node"]).select(edges[key].alias("key"), edges[other].alias("other"), "m")


def connected_components(links: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b): component is the smallest node that can be reached.

    Rounds grow with the logarithm of the number of nodes. Every round is written to the shared folder; the number
    of rows never grows from one round to the next.
    """
    edges = saved(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    mark = None
    for _ in range(max_rounds):
        # large star: every larger neighbour of a node goes to the smallest of its neighbours and itself
        both = edges.select(F.col("v").alias("node"), F.col("v").alias("m")).union(edges.select("u", "v"))
        low = saved(both.groupBy("node").agg(F.min("m").alias("m")))
        large = saved(_star(edges, "v", "u", low).select(F.col("other").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        # small star: the smaller neighbours of a node, and itself, go to the smallest of them
        low = saved(large.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")))
        moved = _star(large, "u", "v", low)
        edges = saved(moved.select(F.col("other").alias("u"), F.col("m").alias("v")).union(low.select("node", "m")).where("u <> v").distinct())
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if mark == tuple(now):
            break
        mark = tuple(now)
    else:
        raise RuntimeError("connected components did not settle")
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
