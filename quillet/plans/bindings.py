"""How the operators are bound to the given tables.

Each row of ``orders`` is a document about an order; its predicted table and values are the true ones, made wrong for
some keys, and rendered as raw model responses of several forms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillet.operators.population import to_table

TYPES = {
    "region": {"r_regionkey": "int", "r_name": "string"},
    "nation": {"n_nationkey": "int", "n_name": "string", "n_regionkey": "int"},
    "customer": {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "string"},
    "supplier": {"s_suppkey": "bigint", "s_name": "string", "s_nationkey": "int", "s_acctbal": "double"},
    "part": {"p_partkey": "bigint", "p_name": "string", "p_brand": "string", "p_type": "string", "p_size": "int", "p_retailprice": "double"},
    "orders": {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double", "o_orderdate": "timestamp", "o_orderpriority": "string"},
    "lineitem": {"l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_returnflag": "string", "l_linestatus": "string"},
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def population_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as populated documents: (doc_id, res, data) with every value as text."""
    types = TYPES[name]
    pairs = [x for c in types for x in (F.lit(c), F.col(c).cast("string"))]
    return table(spark, sf_dir, name).select(F.concat_ws("-", F.lit(name), F.col(next(iter(types))).cast("string")).alias("doc_id"), F.lit(name).alias("res"), F.create_map(*pairs).alias("data"))


def populated(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The relation read back from its populated documents."""
    return to_table(population_of(spark, sf_dir, name), name, TYPES[name])


def order_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents about orders, in key order."""
    o = table(spark, sf_dir, "orders")
    text = F.concat(F.lit("Order "), F.col("o_orderkey"), F.lit(" of customer "), F.col("o_custkey"), F.lit(" has status "), F.col("o_orderstatus"), F.lit(" and priority "), F.col("o_orderpriority"), F.lit("."))
    return o.select(F.col("o_orderkey").cast("string").alias("doc_id"), text.alias("doc_text"), F.lit("orders").alias("source_file"), F.lit(None).cast("string").alias("parent_doc_id"), F.lit(0).alias("chunk_index"), F.col("o_orderkey").alias("ord"))


def order_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ground truth of the order documents: (doc_id, gt_table, gt map)."""
    o = table(spark, sf_dir, "orders")
    gt = F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("priority"), F.when(F.col("o_orderkey") % 31 == 0, F.lit(None)).otherwise(F.col("o_orderpriority")))
    return o.select(F.col("o_orderkey").cast("string").alias("doc_id"), F.when(F.col("o_orderkey") % 37 == 0, F.lit(None)).otherwise(F.lit("orders")).alias("gt_table"), gt.alias("gt"))


def order_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw responses: a table for each document, then a value for each attribute; some attempts are broken."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"), F.col("o_orderpriority").alias("p"))
    k = F.col("k")
    res = F.when(k % 29 == 0, "invoices").otherwise("orders")
    status = F.when(k % 17 == 0, "X").otherwise(F.col("s"))
    priority = F.when(k % 23 == 0, "N/A").when(k % 53 == 0, F.repeat("p", F.lit(25))).otherwise(F.col("p"))
    targets = F.explode(F.array(*[F.struct(F.lit(t).alias("target"), F.lit(a).alias("key"), v.alias("value")) for t, a, v in (("__table__", "res", res), ("status", "status", status), ("priority", "priority", priority))]))
    r = o.select("k", targets.alias("t")).select("k", "t.*").withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(1))))
    body = F.concat(F.lit('{"'), F.col("key"), F.lit('": "'), F.col("value"), F.lit('"}'))
    literal = F.concat(F.lit("{'"), F.col("key"), F.lit("': '"), F.col("value"), F.lit("', 'sure': True}"))
    broken = (F.col("attempt") == 0) & (k % 4 == 2)
    raw = F.when(broken, F.lit("I can't tell {} from this.")).when(k % 4 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(k % 4 == 1, F.concat(F.lit("The answer is "), body, F.lit("."))).otherwise(literal)
    return r.select(k.cast("string").alias("doc_id"), F.lit("Q1").alias("query_id"), "target", "attempt", raw.alias("raw_text"))
