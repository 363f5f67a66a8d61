"""Queries of the sources, chunks and responses, bound to the given tables, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillet.functions.nulls import is_none_value, is_null
from quillet.functions.shared import shared_dir
from quillet.functions.vectors import cosine
from quillet.operators import chunks as C
from quillet.operators import population as P
from quillet.sources import documents as D
from quillet.streaming.resume import populate_stream, stored

from .bindings import TYPES, order_documents, order_responses, population_of, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, doc_id AS ord FROM documents")
def a01_document_scan(spark: SparkSession, sf: str) -> DataFrame:
    return D.read_documents(spark, f"{sf}/documents.parquet").select("doc_id", "ord")


_FORMAT_TEXT = "replace(coalesce(text, ''), chr(13), ' ')"


@query(f"SELECT fmt, CAST(doc_id AS VARCHAR) AS doc_id, doc_id AS ord, md5({_FORMAT_TEXT}) AS hash FROM documents, (VALUES ('csv'), ('json')) t(fmt)")
def a01_scan_of_formats(spark, sf):
    """The documents written as csv and as json, and read back; texts hold quotes, commas and line ends."""
    root = f"{shared_dir(spark)}/formats-{uuid.uuid4().hex}"
    docs = table(spark, sf, "documents").select(F.replace(F.coalesce("text", F.lit("")), F.lit("\r"), F.lit(" ")).alias("doc_text"), F.col("doc_id").cast("string").alias("doc_id"))
    docs.write.options(header="true", escape='"', ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false").csv(f"{root}/csv")
    docs.write.json(f"{root}/json")
    read = [D.read_documents(spark, f"{root}/{f}", f).select(F.lit(f).alias("fmt"), "doc_id", "ord", F.md5(F.coalesce("doc_text", F.lit(""))).alias("hash")) for f in ("csv", "json")]
    return read[0].union(read[1])


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 1 THEN o_orderpriority ELSE coalesce(n_name, '') END AS doc_text FROM orders LEFT JOIN nation ON o_orderkey % 30 = n_nationkey")
def a02_resolve_text(spark, sf):
    docs = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 1, F.col("o_orderpriority")).otherwise("").alias("doc_text"), F.concat(F.lit("f"), F.col("o_orderkey") % 30).alias("source_file"))
    files = table(spark, sf, "nation").select(F.concat(F.lit("f"), "n_nationkey").alias("path"), F.col("n_name").alias("text"))
    return D.resolve_text(docs, files).select("o_orderkey", "doc_text")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS n, o_orderpriority AS doc_text, CASE WHEN o_orderkey % 3 = 2 THEN '' ELSE 'orders' END AS table_name, CASE WHEN o_orderkey % 3 = 1 THEN o_orderstatus END AS raw_id FROM orders")
def a03_normalize_documents(spark, sf):
    k, p, s = F.col("o_orderkey"), F.col("o_orderpriority"), F.col("o_orderstatus")
    entry = F.when(k % 3 == 0, F.concat(F.lit('{"doc": "'), p, F.lit('", "fn": "orders"}'))).when(k % 3 == 1, F.concat(F.lit('["'), p, F.lit('", "orders", "'), s, F.lit('"]'))).otherwise(F.concat(F.lit('"'), p, F.lit('"')))
    raw = table(spark, sf, "orders").select(F.concat(F.lit('{"'), k, F.lit('": '), entry, F.lit("}")).alias("json"))
    return D.normalize_documents(raw)


@query("SELECT c_custkey AS doc_id, count(o_orderkey) AS n_records, min(o_orderkey) AS first_row FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderkey % 7 <> 0 GROUP BY c_custkey")
def a04_document_info(spark, sf):
    o = table(spark, sf, "orders")
    mapping = o.select(F.col("o_custkey").alias("doc_id"), F.lit("orders").alias("table_name"), F.col("o_orderkey").alias("row_id"), F.lit("full").alias("match_type"))
    truth = o.where(F.col("o_orderkey") % 7 != 0).select(F.lit("orders").alias("table_name"), F.col("o_orderkey").alias("row_id"), F.create_map(F.lit("status"), F.col("o_orderstatus")).alias("data"))
    info = D.document_info(table(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id")), mapping, truth)
    return info.select("doc_id", F.col("n_records").cast("long").alias("n_records"), F.get("records", F.lit(0))["row_id"].alias("first_row"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS query_id, CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 2 END AS n, CASE WHEN p_partkey % 5 = 0 THEN p_name ELSE p_brand END AS first FROM part")
def a05_query_catalog(spark, sf):
    good = F.concat(F.lit('["'), "p_brand", F.lit('", "'), "p_type", F.lit('"]'))
    raw = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("query_id"), F.col("p_name").alias("query"), F.when(F.col("p_partkey") % 5 == 0, F.col("p_name")).otherwise(good).alias("attributes"))
    return D.read_queries(raw).select("query_id", F.size("attributes").alias("n"), F.get("attributes", F.lit(0)).alias("first"))


_SCHEMA_SQL = "SELECT p_brand AS schema_name, count(*) AS n, min_by(p_name, p_partkey) AS first FROM part WHERE p_size {} 25 GROUP BY p_brand"


def _catalog(spark, sf, query_id):
    part = table(spark, sf, "part").withColumn("query_id", F.when(F.col("p_size") < 25, F.lit(None)).otherwise(F.lit("q1")))
    attrs = part.select(F.col("p_brand").alias("schema_name"), F.col("p_name").alias("attribute_name"), F.col("p_type").alias("description"), "query_id", F.col("p_partkey").alias("ord"))
    return D.schema_catalog(attrs.select("schema_name", "query_id").distinct(), attrs, query_id)


@query(_SCHEMA_SQL.format("<"))
def a06_schema_catalog(spark, sf):
    return _catalog(spark, sf, None).select("schema_name", F.size("attributes").cast("long").alias("n"), F.get("attributes", F.lit(0))["name"].alias("first"))


@query("SELECT p_name AS attribute_name FROM part WHERE p_size >= 25 AND p_brand = (SELECT min(p_brand) FROM part)")
def a07_schema_lookup(spark, sf):
    name = table(spark, sf, "part").agg(F.min("p_brand")).first()[0]
    return D.schema_attributes(_catalog(spark, sf, "q1"), name)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 77")
def a08_point_lookup(spark, sf):
    return D.lookup(table(spark, sf, "orders"), "o_custkey", 77, "o_orderkey", "o_totalprice")


@query("SELECT (SELECT count(*) FROM documents) AS n_documents, (SELECT count(*) FROM conversations) AS n_queries, true AS has_schemas")
def a09_dataset_summary(spark, sf):
    return D.dataset_summary(table(spark, sf, "documents"), table(spark, sf, "conversations"), table(spark, sf, "nation"))


@query("SELECT CAST(o_orderkey AS VARCHAR) || '-0' AS doc_id, regexp_replace(o_orderpriority, '[- ]', '_', 'g') AS table_name, CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS VARCHAR) AS row_id, 'full' AS match_type FROM orders")
def a10_convert_dataset(spark, sf):
    n = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("n"), F.col("o_orderstatus").alias("doc_text"), F.col("o_orderpriority").alias("table_name"))
    return D.convert_dataset(n)[1]


@query("""SELECT p_partkey, attr, CASE WHEN p_partkey % 13 = 0 THEN 'missing right' WHEN p_partkey % 17 = 0 THEN 'missing left' ELSE 'value' END AS kind FROM part, (VALUES ('p_name'), ('p_retailprice')) t(attr)
WHERE (p_partkey % 13 = 0 AND p_partkey % 17 <> 0) OR (p_partkey % 17 = 0 AND p_partkey % 13 <> 0) OR (p_partkey % 13 <> 0 AND p_partkey % 17 <> 0 AND p_partkey % 11 = 0 AND attr = 'p_name')""")
def a11_parity_check(spark, sf):
    a = table(spark, sf, "part").select("p_partkey", "p_name", "p_retailprice")
    a, whole = a.where(F.col("p_partkey") % 17 != 0), a
    b = whole.where(F.col("p_partkey") % 13 != 0).withColumn("p_retailprice", F.col("p_retailprice") * (1 + 1e-9)).withColumn("p_name", F.when(F.col("p_partkey") % 11 == 0, F.lit("x")).otherwise(F.col("p_name")))
    return D.compare_datasets(a, b, ["p_partkey"]).select("p_partkey", "attr", "kind")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, o_orderstatus AS status, 'orders' AS dataset, 'Q' || o_orderkey % 2 AS query_id, 'base' AS param FROM orders")
def a12_write_population(spark, sf):
    path = f"{shared_dir(spark)}/population-{uuid.uuid4().hex}"
    o = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("doc_id"), F.col("o_orderstatus").alias("status"), F.lit("orders").alias("dataset"), F.concat(F.lit("Q"), F.col("o_orderkey") % 2).alias("query_id"), F.lit("base").alias("param"))
    D.write_population(o, path)
    return spark.read.parquet(path)


@query("SELECT CAST(o_orderkey AS VARCHAR) AS doc_id FROM orders WHERE o_orderkey % 3 <> 0")
def a13_pending(spark, sf):
    docs = order_documents(spark, sf)
    return D.pending(docs, docs.where(F.col("ord") % 3 == 0)).select("doc_id")


@query("SELECT p_brand AS gt_table, p_name || p_partkey AS pred_attr, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE p_type || '|' || p_size END AS gt_attrs FROM part")
def a14_name_map(spark, sf):
    target = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit('"'), "p_type", F.lit('"'))).otherwise(F.concat(F.lit('["'), "p_type", F.lit('", "'), "p_size", F.lit('"]')))
    raw = table(spark, sf, "part").select(F.concat(F.lit('{"attribute": {"'), "p_brand", F.lit('": {"'), "p_name", "p_partkey", F.lit('": '), target, F.lit("}}}")).alias("json"))
    return D.read_name_map(raw).select("gt_table", "pred_attr", F.array_join("gt_attrs", "|").alias("gt_attrs"))


@query("SELECT d AS doc_id, row_number() OVER (ORDER BY try_cast(d AS BIGINT) NULLS LAST, d) - 1 AS place FROM (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'x' ELSE '' END || o_orderkey AS d FROM orders) t")
def a15_numeric_order(spark, sf):
    k = F.col("o_orderkey")
    return D.numbered(table(spark, sf, "orders").select(F.concat(F.when(k % 3 == 0, "x").otherwise(""), k.cast("string")).alias("doc_id")))


_CHUNKS = "SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, substr(text, CAST(i * 450 + 1 AS BIGINT), 500) AS chunk FROM documents, generate_series(0, greatest(CAST(ceil((length(text) - 500) / 450.0) AS BIGINT), 0)) t(i)"


@query(f"SELECT doc_id, chunk_index, length(chunk) AS size, md5(chunk) AS hash FROM ({_CHUNKS}) c")
def b01_chunks(spark, sf):
    return C.chunk_documents(table(spark, sf, "documents"), text_col="text").select("doc_id", "chunk_index", F.length("chunk").alias("size"), F.md5("chunk").alias("hash"))


@query("SELECT p_partkey, CASE WHEN length(p_name) < 20 OR len(string_split(p_name, ' ')) < 5 THEN p_name || chr(10) || chr(10) || 'Context: ' || p_brand || ', ' || p_type ELSE p_name END AS query FROM part")
def b02_augment_query(spark, sf):
    return C.augment_query(table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("query"), F.array("p_brand", "p_type").alias("attributes"))).select("p_partkey", "query")


@query("SELECT p_brand AS schema_name, string_agg(p_name, ',' ORDER BY p_partkey) AS features FROM part GROUP BY p_brand")
def b03_feature_list(spark, sf):
    return C.feature_list(table(spark, sf, "part").withColumnRenamed("p_brand", "schema_name"), "schema_name", order="p_partkey", name="p_name")


@query()
def b04_embed(spark, sf):
    return C.embed(table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "text").select("doc_id", "embedding")


_SIM = "round(list_cosine_similarity(CAST({} AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)), 6)"
_QUERY_IDS = (0, 1, 2)


def _first_vector(spark, sf):
    return table(spark, sf, "embeddings").where("vec_id = 0").select(F.col("embedding").alias("query_vec"))


@query(f"SELECT vec_id, {_SIM.format('embedding')} AS sim FROM embeddings")
def b05_cosine(spark, sf):
    e = table(spark, sf, "embeddings").crossJoin(F.broadcast(_first_vector(spark, sf)))
    return e.select("vec_id", F.round(cosine(F.col("embedding"), F.col("query_vec")), 6).alias("sim"))


_FILTERED = f"WITH c AS ({_CHUNKS}), t AS (SELECT c.*, count(*) OVER (PARTITION BY doc_id) AS n, e.embedding AS v FROM c JOIN embeddings e ON e.vec_id = (doc_id * 7 + chunk_index) % (SELECT count(*) FROM embeddings)), s AS (SELECT t.*, q.vec_id AS query_id, list_cosine_similarity(CAST(t.v AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS sim FROM t, embeddings q WHERE q.vec_id IN {_QUERY_IDS}), f AS (SELECT *, n = 1 OR sim >= 0.0 AS kept FROM s) "


def _chunks_and_queries(spark, sf):
    e = table(spark, sf, "embeddings")
    n = e.agg(F.count(F.lit(1)).alias("n_vec"))
    ch = C.chunk_documents(table(spark, sf, "documents"), text_col="text").crossJoin(F.broadcast(n))
    ch = ch.join(e.select("vec_id", "embedding"), (F.col("doc_id") * 7 + F.col("chunk_index")) % F.col("n_vec") == F.col("vec_id")).select("doc_id", "chunk_index", "chunk", "embedding")
    return ch, e.where(F.col("vec_id").isin(*_QUERY_IDS)).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))


@query(_FILTERED + "SELECT query_id, doc_id, chunk_index, round(sim, 6) + 0.0 AS sim, kept FROM f")
def b06_filter_chunks(spark, sf):
    chunks, queries = _chunks_and_queries(spark, sf)
    return C.chunk_verdicts(chunks.drop("chunk"), queries, 0.0).select("query_id", "doc_id", "chunk_index", (F.round("sim", 6) + F.lit(0.0)).alias("sim"), "kept")


@query(_FILTERED + "SELECT query_id, doc_id, count(*) AS num_chunks, count(*) FILTER (WHERE kept) AS num_kept, count(*) FILTER (WHERE NOT kept) AS num_dropped, round(min(sim), 6) AS min_sim, round(max(sim), 6) AS max_sim, round(avg(sim), 6) AS avg_sim FROM f GROUP BY query_id, doc_id")
def b07_filter_statistics(spark, sf):
    s = C.filter_statistics(*_chunks_and_queries(spark, sf), 0.0)
    return s.select("query_id", "doc_id", "num_chunks", "num_kept", "num_dropped", *[F.round(c, 6).alias(c) for c in ("min_sim", "max_sim", "avg_sim")])


@query(_FILTERED + "SELECT query_id, doc_id, md5(coalesce(string_agg(chunk, chr(10) || chr(10) ORDER BY chunk_index) FILTER (WHERE kept), '')) AS hash FROM f GROUP BY query_id, doc_id")
def b08_reassemble(spark, sf):
    ch, q = _chunks_and_queries(spark, sf)
    whole = C.reassemble(C.filter_chunks(ch, q, 0.0), C.filter_statistics(ch, q, 0.0), "query_id")
    return whole.select("query_id", "doc_id", F.md5("doc_text").alias("hash"))


@query("SELECT round(quantile_cont(list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)), 0.05), 6) AS threshold FROM embeddings WHERE label = (SELECT label FROM embeddings WHERE vec_id = 0) AND vec_id <> 0")
def b09_calibrate(spark, sf):
    e = table(spark, sf, "embeddings")
    q = e.where("vec_id = 0").select(F.col("embedding").alias("qv"), F.col("label").alias("ql"))
    pairs = e.where("vec_id <> 0").crossJoin(F.broadcast(q)).select(cosine(F.col("embedding"), F.col("qv")).alias("sim"), (F.col("label") == F.col("ql")).alias("is_relevant"))
    return C.calibrate_threshold(pairs).select(F.round("threshold", 6).alias("threshold"))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, target, attempt,
 CASE WHEN attempt = 0 AND o_orderkey % 4 = 2 THEN NULL WHEN target = '__table__' THEN CASE WHEN o_orderkey % 29 = 0 THEN 'invoices' ELSE 'orders' END
 WHEN target = 'status' THEN CASE WHEN o_orderkey % 17 = 0 THEN 'X' ELSE o_orderstatus END ELSE CASE WHEN o_orderkey % 23 = 0 THEN 'N/A' WHEN o_orderkey % 53 = 0 THEN repeat(o_orderpriority, 25) ELSE o_orderpriority END END AS value
FROM orders, (VALUES ('__table__'), ('status'), ('priority')) t(target), (VALUES (0), (1)) a(attempt)""")
def e01_extract_json(spark, sf):
    r = P.parsed_responses(order_responses(spark, sf))
    key = F.when(F.col("target") == "__table__", "res").otherwise(F.col("target"))
    return r.select("doc_id", "target", "attempt", F.element_at("obj", key).alias("value"))


def _assigned(spark, sf):
    return P.resolve_tables(order_responses(spark, sf), ["orders", "invoices"])


def _schema(spark, sf):
    return table(spark, sf, "region").where("r_regionkey = 0").select(F.lit("Q1").alias("query_id"), F.lit("orders").alias("table_name"), F.explode(F.array(F.lit("status"), F.lit("priority"), F.lit("clerk"))).alias("attr"))


_RES = "CASE WHEN o_orderkey % 29 = 0 THEN 'invoices' ELSE 'orders' END"
_STATUS = "CASE WHEN o_orderkey % 17 = 0 THEN 'X' ELSE o_orderstatus END"
_PRIORITY = "CASE WHEN o_orderkey % 23 = 0 THEN 'N/A' ELSE o_orderpriority END"
_STORED = "CASE WHEN o_orderkey % 23 = 0 THEN 'None' WHEN o_orderkey % 53 = 0 THEN repeat(o_orderpriority, 25) ELSE o_orderpriority END"


@query(f"SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, 'Q1' AS query_id, {_RES} AS res FROM orders")
def e02_resolve_tables(spark, sf):
    return _assigned(spark, sf)


@query(f"SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, attr, CASE attr WHEN 'status' THEN {_STATUS} WHEN 'priority' THEN {_STORED} ELSE 'None' END AS value FROM orders, (VALUES ('status'), ('priority'), ('clerk')) t(attr) WHERE o_orderkey % 29 <> 0")
def e03_resolve_attributes(spark, sf):
    return P.resolve_attributes(order_responses(spark, sf), _assigned(spark, sf), _schema(spark, sf)).select("doc_id", "attr", "value")


@query("SELECT o_orderkey, v, lower(trim(v)) IN ('', 'n/a', 'nan') AS none_value, lower(trim(v)) IN ('', 'n/a', 'nan', 'unknown') AS null_value FROM (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN ' N/A ' WHEN 1 THEN 'unknown' WHEN 2 THEN '  ' WHEN 3 THEN 'NaN' ELSE o_orderpriority END AS v FROM orders) t")
def e04_null_vocabularies(spark, sf):
    k = F.col("o_orderkey") % 6
    v = F.when(k == 0, " N/A ").when(k == 1, "unknown").when(k == 2, "  ").when(k == 3, "NaN").otherwise(F.col("o_orderpriority"))
    d = table(spark, sf, "orders").select("o_orderkey", v.alias("v"))
    return d.select("o_orderkey", "v", is_none_value(F.col("v")).alias("none_value"), is_null(F.col("v")).alias("null_value"))


@query(f"SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, {_RES} AS res, CASE WHEN o_orderkey % 29 = 0 THEN 0 ELSE 3 END AS n, CASE WHEN o_orderkey % 29 <> 0 THEN {_STORED} END AS priority, o_orderkey % 29 <> 0 AND length({_STORED}) > 100 AS overlong FROM orders")
def e05_assemble_rows(spark, sf):
    d = P.populate(order_responses(spark, sf), ["orders", "invoices"], _schema(spark, sf))
    return d.select("doc_id", "res", F.size("data").alias("n"), F.element_at("data", "priority").alias("priority"), "overlong")


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS VARCHAR) AS o_orderdate, o_orderpriority FROM orders")
def e06_to_table(spark, sf):
    t = P.to_table(population_of(spark, sf, "orders"), "orders", TYPES["orders"])
    return t.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, o_orderstatus AS status, o_orderpriority AS priority FROM orders")
def e08_extract_by_patterns(spark, sf):
    return P.extract_by_patterns(order_documents(spark, sf), {"status": r"status (\w)", "priority": r"priority (.*)\."})


@query("SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, o_orderstatus AS status FROM orders")
def s01_populate_stream(spark, sf):
    """Documents that arrive in two deliveries, each read by a stream that goes on where the one before ended."""
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    docs = order_documents(spark, sf)
    fn = lambda d: P.extract_by_patterns(d, {"status": r"status (\w)"})
    for k in (0, 1):
        docs.where(F.col("ord") % 2 == k).write.mode("append").parquet(f"{root}/in")
        populate_stream(spark, f"{root}/in", f"{root}/out", f"{root}/checkpoint", fn).awaitTermination()
    return stored(spark, f"{root}/out")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 1 END AS n, o_orderstatus AS status FROM orders")
def e09_single_shot(spark, sf):
    o = table(spark, sf, "orders")
    one = F.concat(F.lit('{"status": "'), "o_orderstatus", F.lit('"}'))
    many = F.concat(F.lit('[{"status": "?"}, {"priority": "'), "o_orderpriority", F.lit('"}, '), one, F.lit("]"))
    raw = o.select(F.col("o_orderkey").cast("string").alias("doc_id"), F.when(F.col("o_orderkey") % 2 == 0, many).otherwise(one).alias("raw_text"))
    return P.single_shot(raw).select("doc_id", F.size("data").alias("n"), F.element_at("data", "status").alias("status"))


@query(f"SELECT CAST(o_orderkey AS VARCHAR) AS doc_id FROM orders WHERE o_orderkey % 29 <> 0 AND {_STORED} = 'None'")
def q19_missing_values(spark, sf):
    rows = e05_assemble_rows(spark, sf).where("res = 'orders'")
    return rows.where(is_null(F.col("priority"))).select("doc_id")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, o_orderstatus AS status FROM orders")
def e08_extract_with_function(spark, sf):
    def status(batches):
        for p in batches:
            yield p[["doc_id"]].assign(status=p["doc_text"].str.extract(r"status (\w)", expand=False))

    return P.extract_with(order_documents(spark, sf).select("doc_id", "doc_text"), status, "doc_id string, status string")


@query("SELECT c_custkey AS doc_id, 'orders' AS gt_table, min_by(o_orderstatus, o_orderkey) AS status FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def g01_pairing(spark, sf):
    o = table(spark, sf, "orders")
    mapping = o.select(F.col("o_custkey").alias("doc_id"), F.lit("orders").alias("table_name"), F.col("o_orderkey").alias("row_id"))
    truth = o.select(F.lit("orders").alias("table_name"), F.col("o_orderkey").alias("row_id"), F.create_map(F.lit("status"), F.col("o_orderstatus")).alias("data"))
    info = D.document_info(table(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id")), mapping, truth).where("n_records > 0")
    first = F.get("records", F.lit(0))
    return info.select("doc_id", first["table_name"].alias("gt_table"), F.element_at(F.map_from_entries(first["data"]), "status").alias("status"))
