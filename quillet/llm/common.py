"""Small Spark helpers of the corpus operators: batches of texts, column hygiene, folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillet.functions.shared import saved, shared_dir, small_side

__all__ = ["crc_mod", "saved", "shared_dir", "small_batches", "small_side", "within", "without"]


def small_batches(spark: SparkSession) -> None:
    """Texts may be long: keep the Arrow batches that tasks exchange with Python to a few MB (unless the session has
    set its own size). Plans are run later than they are made, so the setting stays; it changes no result."""
    for key, usual, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "256"),):
        if spark.conf.get(key, usual) == usual:
            spark.conf.set(key, value)


def without(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Drop columns that an operator's own results are about to name (compared without case, as Spark resolves names)."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text modulo ``n``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def within(rows: DataFrame, chars: int, *order: Column, by: Sequence[str] = ()) -> DataFrame:
    """Rows (``text``) of a counted sample in order while their texts have at most ``chars`` characters, for each ``by``. Texts
    over a sixteenth of that are passed over, so that no single one ends the sample."""
    short = rows.where(F.length("text") <= chars // 16)
    so_far = F.sum(F.length("text")).over(Window.partitionBy(*by).orderBy(*order))
    return short.withColumn("_chars", so_far).where(F.col("_chars") <= chars).drop("_chars")
