"""Every registered query of the library and its SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillet.plans import relational, sources_plans, statistics_plans

_MODULES = (sources_plans, statistics_plans, relational)


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: s for m in _MODULES for name, s in m.SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses about orders resolved to rows, and summed up by priority with the populated customers."""
    rows = sources_plans.e05_assemble_rows(spark, sf_dir).where("res = 'orders'").select("doc_id", "priority")
    for t in ("orders", "customer"):
        relational.populated(spark, sf_dir, t).createOrReplaceTempView(t)
    rows.createOrReplaceTempView("extracted")
    return spark.sql("SELECT c.c_mktsegment AS segment, e.priority AS priority, round(avg(o.o_totalprice), 2) AS avg_price, max(o.o_totalprice) AS max_price FROM extracted e JOIN orders o ON e.doc_id = CAST(o.o_orderkey AS STRING) JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY c.c_mktsegment, e.priority")
