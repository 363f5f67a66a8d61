"""Population of documents as they arrive: each document once, whatever is delivered, stopped or repeated."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quillet.sources.documents import DOCUMENT

BATCH = "_batch"


def populate_stream(spark: SparkSession, in_path: str, out_path: str, checkpoint: str, populate: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Run ``populate`` on every new document of ``in_path`` once and store its rows below ``out_path``.

    Ids already seen are kept in the stream's state store, so a batch reads its own documents and the state of their ids, not
    what is stored. A batch writes a folder of its own number: one that was stopped half way and runs again after a restart
    replaces what it left. The state has a row an id; for very many, choose the RocksDB state store of the session. Of rows
    that repeat an id one is taken; a null id is an id."""

    def batch(docs: DataFrame, number: int) -> None:
        populate(docs).write.mode("overwrite").parquet(f"{out_path}/{BATCH}={number}")

    source = spark.readStream.schema(DOCUMENT).parquet(in_path).dropDuplicates(["doc_id"])
    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored(spark: SparkSession, out_path: str) -> DataFrame:
    """All rows that streams have stored below a path."""
    return spark.read.parquet(out_path).drop(BATCH)
