"""Lags, running sums and streaks over runs of any length, without a task that holds a run.

A table of runs (run, seq) is stored in ranges of (run, seq). Windows look at one run inside one range; what crosses a range's
edge (the last value, the sums, the open streak) is a row for each run and range, combined in order of the ranges and joined back.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillet.functions.shared import saved, small_side

RANGE_ROWS = 1 << 16
RANGES_A_PARTITION = 8


@dataclass(frozen=True)
class Runs:
    """Rows of runs in ranges (``_p``); every step adds a column. ``seq`` orders a run and identifies its rows."""

    rows: DataFrame
    run: str
    seq: str

    @staticmethod
    def of(df: DataFrame, run: str = "run_id", seq: str = "seq", range_rows: int = RANGE_ROWS) -> Runs:
        """Ranges of about ``range_rows`` rows, up to eight for each shuffle partition."""
        df = saved(df)
        most = RANGES_A_PARTITION * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        n = max(1, min(most, -(-df.count() // range_rows)))
        return Runs(saved(df.repartitionByRange(n, run, seq).withColumn("_p", F.spark_partition_id())), run, seq)

    def _own(self) -> Window:
        return Window.partitionBy("_p", self.run).orderBy(self.seq)

    def _ranges(self) -> Window:
        return Window.partitionBy(self.run).orderBy("_p")

    def _with(self, edges: DataFrame, *values: Column) -> DataFrame:
        """Rows with what ``values`` make of the edges of all ranges of their run."""
        carried = edges.select("_p", self.run, *values)
        return self.rows.join(small_side(carried), ["_p", self.run], "left")

    def where(self, condition: Column) -> Runs:
        return replace(self, rows=self.rows.where(condition))

    def with_column(self, name: str, value: Column) -> Runs:
        return replace(self, rows=self.rows.withColumn(name, value))

    def previous(self, value: str, name: str) -> Runs:
        """``name``: the value of the row before in its run."""
        edges = self.rows.groupBy("_p", self.run).agg(F.max_by(value, self.seq).alias("_last"))
        d = self._with(edges, F.lag("_last").over(self._ranges()).alias("_c"))
        first = F.row_number().over(self._own()) == 1
        return replace(self, rows=d.withColumn(name, F.when(first, F.col("_c")).otherwise(F.lag(value).over(self._own()))).drop("_c"))

    def running(self, **sums: Column) -> Runs:
        """Sums of each value over its run, up to and with each row; nulls count as 0."""
        zero = {k: F.coalesce(v.cast("long"), F.lit(0)) for k, v in sums.items()}
        edges = self.rows.groupBy("_p", self.run).agg(*[F.sum(v).alias(f"_s_{k}") for k, v in zero.items()])
        before = self._ranges().rowsBetween(Window.unboundedPreceding, -1)
        d = self._with(edges, *[F.coalesce(F.sum(f"_s_{k}").over(before), F.lit(0)).alias(f"_c_{k}") for k in zero])
        upto = self._own().rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return replace(self, rows=d.select(*self.rows.columns, *[(F.col(f"_c_{k}") + F.sum(v).over(upto)).alias(k) for k, v in zero.items()]))

    def streak(self, holds: Column, name: str) -> Runs:
        """``name``: rows in a row, up to and with each, for which ``holds`` is true."""
        ok = F.coalesce(holds, F.lit(False))
        last_break = F.max(F.when(~ok, F.col(self.seq)))
        marked = self.rows.withColumn("_b", last_break.over(Window.partitionBy("_p", self.run)))
        edges = marked.groupBy("_p", self.run).agg(F.count_if(F.col("_b").isNull() | (F.col(self.seq) > F.col("_b"))).alias("_open"), F.max(F.col("_b").isNotNull()).alias("_broken"))
        # ranges without a break go on with the streak that is open before them
        since = F.sum(F.col("_broken").cast("int")).over(self._ranges())
        open_at_end = F.sum("_open").over(Window.partitionBy(self.run, "_g").orderBy("_p"))
        edges = edges.withColumn("_g", since).withColumn("_end", open_at_end)
        d = self._with(edges, F.coalesce(F.lag("_end").over(self._ranges()), F.lit(0)).alias("_c"))
        upto = self._own().rowsBetween(Window.unboundedPreceding, Window.currentRow)
        at, n = F.max(F.when(~ok, F.col("_n"))).over(upto), F.row_number().over(self._own())
        d = d.withColumn("_n", n).withColumn("_at", at)
        return replace(self, rows=d.withColumn(name, (F.col("_n") - F.coalesce("_at", -F.col("_c"))).cast("long")).drop("_c", "_n", "_at"))

    def result(self) -> DataFrame:
        return self.rows.drop("_p")
