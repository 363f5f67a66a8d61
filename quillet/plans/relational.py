"""Analytical queries over populated tables: one SQL text for each shape, run by Spark on the populated views.

Averages are rounded a little above their value, so that exact halves round alike in every engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillet.functions.joins import not_in, spread_join

from .bindings import populated

SQL: dict[str, str] = {
    "q01_join_avg_max": "SELECT c.c_mktsegment AS segment, round(avg(o.o_totalprice) + 0.0000001, 2) AS avg_price, round(max(o.o_totalprice), 2) AS max_price FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_orderstatus <> 'P' GROUP BY c.c_mktsegment",
    "q02_join_ranges": "SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_totalprice >= 100000 AND o.o_totalprice < 200000 AND c.c_acctbal > 0 AND c.c_acctbal <= 5000",
    "q03_join_flag_sum": "SELECT c.c_mktsegment AS segment, round(sum(o.o_totalprice), 2) AS total FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_orderstatus = 'F' GROUP BY c.c_mktsegment",
    "q04_three_way_sum": "SELECT c.c_mktsegment AS segment, l.l_returnflag AS flag, round(sum(l.l_quantity), 2) AS quantity FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY c.c_mktsegment, l.l_returnflag",
    "q05_two_roles": "SELECT cn.n_name AS customer_nation, sn.n_name AS supplier_nation, count(*) AS n FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation cn ON c.c_nationkey = cn.n_nationkey JOIN nation sn ON s.s_nationkey = sn.n_nationkey WHERE cn.n_regionkey IN (0, 1) AND sn.n_regionkey IN (2, 3) GROUP BY cn.n_name, sn.n_name",
    "q06_three_way_entity_sum": "SELECT s.s_name AS supplier, round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN supplier s ON l.l_suppkey = s.s_suppkey GROUP BY s.s_name",
    "q07_latest_in_group": "SELECT o_custkey, max(o_orderkey) AS last_order, round(max_by(o_totalprice, o_orderkey), 2) AS last_price FROM orders GROUP BY o_custkey",
    "q08_row_of_maximum": "SELECT p_brand, max_by(p_name, struct_pack(a := p_retailprice, b := -p_partkey)) AS dearest FROM part GROUP BY p_brand",
    "q09_avg_by_joined_key": "SELECT n.n_name AS nation, round(avg(c.c_acctbal) + 0.0000001, 2) AS avg_balance FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name",
    "q10_distinct_join": "SELECT DISTINCT c.c_mktsegment AS segment, l.l_linestatus AS linestatus, o.o_orderpriority AS priority FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey",
    "q11_chain_dates": "SELECT o.o_orderkey, c.c_name, n.n_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE o.o_orderdate >= TIMESTAMP '1995-01-01 00:00:00' AND o.o_orderdate < TIMESTAMP '1996-01-01 00:00:00' AND o.o_orderstatus = 'O'",
    "q12_having_count": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) >= 12",
    "q13_avg_single": "SELECT p_brand, round(avg(p_retailprice) + 0.0000001, 2) AS avg_price FROM part GROUP BY p_brand",
    "q14_count_chain": "SELECT n.n_name AS nation, count(*) AS orders FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name",
    "q15_not_exists": "SELECT c.c_custkey, c.c_name FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')",
    "q16_not_in": "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)",
    "q17_count_distinct": "SELECT count(DISTINCT o_custkey) AS buyers, count(DISTINCT o_orderpriority) AS priorities FROM orders",
    "q18_contains_join": "SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_name LIKE '%77%'",
    "q20_top_groups": "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey ORDER BY count(*) DESC, o_custkey LIMIT 10",
    "q21_above_average": "SELECT o_custkey, round(avg(o_totalprice) + 0.0000001, 1) AS avg_price FROM orders GROUP BY o_custkey HAVING avg(o_totalprice) > (SELECT avg(o_totalprice) FROM orders)",
    "q22_between_dates": "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 50000 AND 60000 AND o_orderdate >= TIMESTAMP '1994-06-01 00:00:00'",
    "q23_longest_and_shortest": "SELECT 'longest' AS kind, max(length(p_name)) AS size, count(*) AS n FROM part WHERE length(p_name) = (SELECT max(length(p_name)) FROM part) UNION ALL SELECT 'shortest' AS kind, min(length(p_name)) AS size, count(*) AS n FROM part WHERE length(p_name) = (SELECT min(length(p_name)) FROM part)",
    "q24_shared_value": "SELECT s_suppkey, s_nationkey FROM (SELECT s_suppkey, s_nationkey, count(*) OVER (PARTITION BY s_nationkey) AS members FROM supplier) t WHERE members > 1",
    "q25_derived_key": "SELECT substr(p.p_brand, 1, 7) AS brand, count(*) AS n FROM part p JOIN (SELECT DISTINCT substr(p_brand, 1, 7) AS b FROM part WHERE p_size < 10) k ON substr(p.p_brand, 1, 7) = k.b GROUP BY substr(p.p_brand, 1, 7)",
    "q26_join_inequality": "SELECT c.c_custkey, s.s_suppkey FROM customer c JOIN supplier s ON c.c_nationkey = s.s_nationkey AND c.c_acctbal <> s.s_acctbal WHERE c.c_acctbal > 9000",
    "q27_join_sum_having": "SELECT n.n_name AS nation, round(sum(o.o_totalprice), 2) AS total FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name HAVING sum(o.o_totalprice) > 1000000",
    "q28_avg_having_avg": "SELECT p_type, p_size, round(avg(p_retailprice) + 0.0000001, 2) AS avg_price FROM part GROUP BY p_type, p_size HAVING avg(p_retailprice) > (SELECT avg(p_retailprice) FROM part)",
    "q28_sum_two_keys": "SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice) / 1000, 0) AS total FROM lineitem GROUP BY l_returnflag, l_linestatus HAVING sum(l_quantity) > 100",
    "q20_top_rows": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
    "q20_top_by_sum": "SELECT l_suppkey, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY l_suppkey ORDER BY sum(l_quantity) DESC, l_suppkey LIMIT 5",
    "q20_top_by_distinct": "SELECT l_suppkey, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_suppkey ORDER BY count(DISTINCT l_partkey) DESC, l_suppkey LIMIT 5",
    "q21_rows_at_least_average": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= (SELECT avg(o_totalprice) FROM orders)",
    "q24_large_groups": "SELECT c_nationkey, count(*) AS members FROM customer GROUP BY c_nationkey HAVING count(*) > (SELECT count(*) / 25 FROM customer)",
}
#: Where the two engines spell a function differently.
SPARK_FORM = {"q08_row_of_maximum": "SELECT p_brand, max_by(p_name, named_struct('a', p_retailprice, 'b', -p_partkey)) AS dearest FROM part GROUP BY p_brand"}


def run(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        sql = SPARK_FORM.get(name, SQL[name])
        for table in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
            if table in sql:
                populated(spark, sf_dir, table).createOrReplaceTempView(table)
        return spark.sql(sql)

    return query


def q16_not_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts, lines = (populated(spark, sf_dir, t) for t in ("part", "lineitem"))
    return not_in(parts.select("p_partkey"), "p_partkey", lines.where("l_quantity > 45"), "l_partkey")


def q26_join_inequality(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = populated(spark, sf_dir, "customer").where("c_acctbal > 9000").select("c_custkey", "c_nationkey", "c_acctbal")
    s = populated(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    return spread_join(c, "c_nationkey", "c_custkey", s, "s_nationkey").where("c_acctbal <> s_acctbal").select("c_custkey", "s_suppkey")


QUERIES = {name: run(name) for name in SQL} | {"q16_not_in": q16_not_in, "q26_join_inequality": q26_join_inequality}
