"""Building schemas from logs, and clusters of documents."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillet.functions.ranks import rank_in_groups, seeded


def latest_schema(log: DataFrame) -> DataFrame:
    """(run_id, tables): the log of the last step; ``log``: (run_id, seq, tables array)."""
    return log.groupBy("run_id").agg(F.max_by("tables", "seq").alias("tables"))


def monotonic(log: DataFrame) -> DataFrame:
    """Steps with ``valid``: false if the log has fewer tables than the step before."""
    before = F.lag(F.size("tables")).over(Window.partitionBy("run_id").orderBy("seq"))
    return log.withColumn("valid", ~F.coalesce(F.size("tables") < before, F.lit(False)))


def consolidate(entries: DataFrame, assignments: DataFrame, min_documents: int = 5) -> DataFrame:
    """(table_name, attrs): last seen attributes of the tables with more than ``min_documents`` assigned documents."""
    last = entries.groupBy("table_name").agg(F.max_by("attrs", "seq").alias("attrs"))
    used = assignments.groupBy(F.col("res").alias("table_name")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > min_documents)
    return last.join(used, "table_name").select("table_name", "attrs", F.col("n").alias("n_documents"))


def example_documents(assignments: DataFrame, k: int = 3, seed: int = 0) -> DataFrame:
    """(res, example, doc_id): at most k documents of each table, in a seeded random order. The filter on row_number lets
    each task keep its own k of a table before the shuffle (WindowGroupLimit), so a large table is no large group."""
    by = Window.partitionBy("res").orderBy("h", "doc_id")
    d = assignments.select("res", "doc_id", seeded(F.col("doc_id"), seed).alias("h"))
    return d.withColumn("example", F.row_number().over(by)).where(F.col("example") <= k).select("res", "example", "doc_id")


def tailored_schema(schema: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, table_name, attr): the part of a schema (table_name, attr) that each query's ``table.attr`` names need."""
    need = queries.select("query_id", F.explode("attributes").alias("a")).select("query_id", F.regexp_extract("a", r"^(.*?)[.-]", 1).alias("table_name"), F.regexp_extract("a", r"[.-](.*)$", 1).alias("attr"))
    return need.join(schema, ["table_name", "attr"], "left_semi").select("query_id", "table_name", "attr")


def resume_state(log: DataFrame) -> DataFrame:
    """(run_id, seq, tables): the stored result with the most tables, the earliest of equals."""
    return log.groupBy("run_id").agg(F.max_by(F.struct("seq", "tables"), F.struct(F.size("tables"), (-F.col("seq")).alias("x"))).alias("b")).select("run_id", "b.*")


def cluster(vectors: DataFrame, k: int = 2, vec_col: str = "embedding", seed: int = 1) -> DataFrame:
    d = vectors.withColumn("_v", array_to_vector(F.transform(vec_col, lambda x: x.cast("double"))))
    return KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="cluster").fit(d).transform(d).drop("_v")


def cluster_sizes(clustered: DataFrame, id_col: str) -> DataFrame:
    return clustered.groupBy("cluster").agg(F.count(F.lit(1)).alias("documents"), F.min(id_col).alias("first"))


def cluster_documents(clustered: DataFrame, id_col: str, block: int = 100_000) -> DataFrame:
    """(cluster, block, ids): the documents of each cluster in order, as lists of at most ``block`` ids, so that a cluster of
    any size never is one row."""
    ranked = rank_in_groups(clustered.select("cluster", F.col(id_col).alias("id")), "cluster", "id")
    return ranked.groupBy("cluster", F.floor(F.col("rank") / block).alias("block")).agg(F.sort_array(F.collect_list("id")).alias("ids"))
