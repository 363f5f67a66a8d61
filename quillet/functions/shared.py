"""Tables in the folder that driver and executors share, and broadcasts behind a count."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder ``spark.checkpoint.dir``. Where it is unset, a local session (tests) gets a new one; a cluster is refused,
    as its executors could not read each other's disks."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="quillet-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_SAVED: list[str] = []


def saved(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: it cuts the lineage and survives lost executors. The
    table stays, as results are read later; ``drop_saved`` removes it."""
    path = f"{shared_dir(df.sparkSession)}/quillet-{uuid.uuid4().hex}"
    _SAVED.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_saved(spark: SparkSession) -> int:
    """Remove the tables that this driver has saved so far, once their results are written elsewhere; their number."""
    jvm, conf, n = spark._jvm, spark._jsc.hadoopConfiguration(), 0
    while _SAVED:
        path = jvm.org.apache.hadoop.fs.Path(_SAVED.pop())
        n += bool(path.getFileSystem(conf).delete(path, True))
    return n


def small_side(df: DataFrame, max_rows: int = 1_000_000) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``max_rows`` rows (it is counted), as it is otherwise. For narrow tables."""
    return F.broadcast(df) if df.count() <= max_rows else df
