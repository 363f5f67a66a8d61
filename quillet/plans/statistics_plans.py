"""Queries of cascades, sampling, schemas, evaluation and detection, bound to the given tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillet.functions.predicates import conjunction
from quillet.functions.shared import saved
from quillet.operators import cascade as K
from quillet.operators import detection as H
from quillet.operators import evaluation as G
from quillet.operators import sampling as S
from quillet.operators import schemas as B
from quillet.operators.heads import score_heads, train_heads

from .bindings import order_truth, table
from .sources_plans import _PRIORITY, _RES, _STATUS

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# --- predicates and cascades -------------------------------------------------------------------------------------
_P1, _P2, _P3 = "p_size >= 20", "p_type contains 'ECONOMY'", "p_retailprice > p_size"
_PARTS = f"SELECT *, {_P1} AS a, contains(p_type, 'ECONOMY') AS b, {_P3} AS c FROM part"


@query(f"SELECT p_partkey FROM ({_PARTS}) t WHERE a AND b AND c")
def f01_predicates(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    return p.where(conjunction(f"{_P1} ; {_P2} ; {_P3}", p.columns)).select("p_partkey")


_OBS = "SELECT p_brand AS attr, p_size >= 20 AS passed FROM part"
_POST = f"SELECT attr, 0.5 * 3 + count(*) FILTER (WHERE passed) AS alpha, 0.5 * 3 + count(*) FILTER (WHERE NOT passed) AS beta FROM ({_OBS}) t GROUP BY attr"


def _posterior(spark, sf):
    return K.posterior(table(spark, sf, "part").select(F.col("p_brand").alias("attr"), (F.col("p_size") >= 20).alias("passed")))


@query(f"SELECT attr, CAST(alpha AS DOUBLE) AS alpha, CAST(beta AS DOUBLE) AS beta, round(alpha / (alpha + beta), 6) AS mean FROM ({_POST}) p")
def f07_posterior(spark, sf):
    return _posterior(spark, sf).withColumn("mean", F.round("mean", 6))


_SEQ_OBS = "SELECT o_orderkey AS seq, o_orderpriority AS attr, o_orderstatus = 'F' AS passed FROM orders"
_RUNNING = "count(*) FILTER (WHERE {}passed) OVER (PARTITION BY attr ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def _observed(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("attr"), (F.col("o_orderstatus") == "F").alias("passed"))


def _order_priors(spark, sf):
    return _observed(spark, sf).where("attr < '3'").select("attr").distinct().withColumn("mean", F.substring("attr", 1, 1).cast("double") / 4)


@query(f"SELECT seq, attr, alpha, beta, round(alpha / (alpha + beta), 9) AS mean FROM (SELECT seq, attr, CAST(mu * 3 + {_RUNNING.format('')} AS DOUBLE) AS alpha, CAST((1 - mu) * 3 + {_RUNNING.format('NOT ')} AS DOUBLE) AS beta FROM (SELECT *, CASE WHEN attr < '3' THEN CAST(substr(attr, 1, 1) AS DOUBLE) / 4 ELSE 0.5 END AS mu FROM ({_SEQ_OBS}) x) o) r")
def f07_running_posterior(spark, sf):
    d = K.running_posterior(_observed(spark, sf), _order_priors(spark, sf))
    return d.select("seq", "attr", "alpha", "beta", F.round("mean", 9).alias("mean"))


_BATCHES = f"SELECT attr, b AS batch, 1.5 + count(*) FILTER (WHERE passed AND seq // 5000 < b) AS alpha, 1.5 + count(*) FILTER (WHERE NOT passed AND seq // 5000 < b) AS beta FROM ({_SEQ_OBS}) o, range(0, (SELECT max(o_orderkey) // 5000 + 1 FROM orders)) t(b) GROUP BY attr, b"


def _before_batches(spark, sf):
    return K.posterior_by_batch(_observed(spark, sf), 5000)


@query(f"SELECT batch, attr, row_number() OVER (PARTITION BY batch ORDER BY (ascii(attr) - 40) / (1 - alpha / (alpha + beta)), attr) AS rank FROM ({_BATCHES}) s")
def f02_order_by_batch(spark, sf):
    stats = _before_batches(spark, sf).withColumn("cost", F.ascii("attr") - 40.0).withColumn("position", F.col("attr"))
    return K.order_by_batch(stats, "fail_fast").select("batch", "attr", F.col("rank").cast("long").alias("rank"))


@query()
def f08_draw_by_batch(spark, sf):
    return K.draw_by_batch(_before_batches(spark, sf), seed=1)


@query()
def f08_thompson_draw(spark, sf):
    return K.thompson_draw(_posterior(spark, sf), seed=1)


def _ordered(spark, sf, mode):
    stats = _posterior(spark, sf).withColumn("cost", F.expr("cast(substring(attr, 7) AS double)") + 1).withColumn("position", F.col("attr"))
    return K.order_predicates(stats, mode).select("attr", F.col("rank").cast("long").alias("rank"))


_STATS = f"SELECT attr, alpha / (alpha + beta) AS mean, CAST(substr(attr, 7) AS DOUBLE) + 1 AS cost FROM ({_POST}) p"


@query(f"SELECT attr, row_number() OVER (ORDER BY mean * cost DESC, attr) AS rank FROM ({_STATS}) s")
def f02_order_predicates(spark, sf):
    return _ordered(spark, sf, "product")


@query(f"SELECT attr, row_number() OVER (ORDER BY cost / (1 - mean), attr) AS rank FROM ({_STATS}) s")
def f02_order_fail_fast(spark, sf):
    return _ordered(spark, sf, "fail_fast")


_LAZY = f"SELECT p_partkey, CASE WHEN NOT a THEN 1 WHEN NOT b THEN 2 ELSE 3 END AS num_extracted, CASE WHEN NOT a THEN 'p_size >= 20' WHEN NOT b THEN 'p_type contains ''ECONOMY''' WHEN NOT c THEN 'p_retailprice > p_size' END AS stopped_at FROM ({_PARTS}) t"


@query(f"SELECT p_partkey, num_extracted, stopped_at, stopped_at IS NOT NULL AS stopped_early FROM ({_LAZY}) l")
def f03_lazy_extract(spark, sf):
    return K.lazy_extract(table(spark, sf, "part"), [_P1, _P2, _P3]).select("p_partkey", "num_extracted", "stopped_at", "stopped_early")


_STOPPED = "CASE WHEN NOT a THEN 'size' WHEN NOT b THEN 'type' WHEN NOT c THEN 'price' END"


@query(f"SELECT p_partkey, CAST(p_size AS VARCHAR) AS size, CASE WHEN a THEN p_type END AS type, CASE WHEN NOT a THEN 1 WHEN NOT b THEN 2 ELSE 3 END AS num_extracted, {_STOPPED} AS stopped_at FROM ({_PARTS}) t")
def f03_lazy_extract_with(spark, sf):
    """The same cascade with a user's functions, which see a document only as long as it passes."""
    stages = [
        ("size", lambda p: p["p_size"].astype(str), lambda v: v.astype(int) >= 20),
        ("type", lambda p: p["p_type"], lambda v: v.str.contains("ECONOMY", regex=False)),
        ("price", lambda p: (p["p_retailprice"] > p["p_size"]).astype(str), lambda v: v == "True"),
    ]
    docs = table(spark, sf, "part").select("p_partkey", "p_size", "p_type", "p_retailprice")
    return K.lazy_extract_with(docs, stages, key="p_partkey").select("p_partkey", "size", "type", "num_extracted", "stopped_at")


@query(f"SELECT stopped_at, count(*) AS documents, CAST(sum(num_extracted) AS BIGINT) AS extractions FROM ({_LAZY}) l GROUP BY stopped_at")
def f04_cascade_statistics(spark, sf):
    return K.cascade_statistics(K.lazy_extract(table(spark, sf, "part"), [_P1, _P2, _P3]))


@query(f"SELECT 1 AS stage, count(*) AS reached, count(*) * 5.0::DOUBLE AS cost FROM part UNION ALL SELECT 2, count(*), count(*) * 7.0::DOUBLE FROM ({_PARTS}) t WHERE a UNION ALL SELECT 3, count(*), count(*) * 11.0::DOUBLE FROM ({_PARTS}) t WHERE a AND b")
def f05_cascade_cost(spark, sf):
    return K.cascade_cost(table(spark, sf, "part"), [(_P1, 5), (_P2, 7), (_P3, 11)]).select("stage", "reached", "cost")


_PRIORS = "SELECT DISTINCT p_brand AS attr, CAST(substr(p_brand, 7) AS DOUBLE) / 100 AS mu FROM part WHERE substr(p_brand, 7) <> '11' UNION ALL SELECT 'unseen', 0.25::DOUBLE"


@query(f"SELECT attr, coalesce(mu, 0.5) * 3 + coalesce(p, 0) AS alpha, (1 - coalesce(mu, 0.5)) * 3 + coalesce(f, 0) AS beta FROM (SELECT attr, count(*) FILTER (WHERE passed) AS p, count(*) FILTER (WHERE NOT passed) AS f FROM ({_OBS}) t GROUP BY attr) o FULL JOIN ({_PRIORS}) q USING (attr)")
def f06_priors(spark, sf):
    part = table(spark, sf, "part")
    known = part.where("substr(p_brand, 7) <> '11'").select(F.col("p_brand").alias("attr"), (F.expr("cast(substr(p_brand, 7) AS double)") / 100).alias("mean")).distinct()
    priors = known.union(part.agg(F.lit("unseen").alias("attr"), F.lit(0.25).alias("mean")))
    return K.posterior(part.select(F.col("p_brand").alias("attr"), (F.col("p_size") >= 20).alias("passed")), priors).drop("mean")


@query("SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN (p_size % 100) / 100.0::DOUBLE WHEN 1 THEN CASE WHEN p_size > 1 THEN p_size / 100.0::DOUBLE ELSE p_size END WHEN 2 THEN 0.8::DOUBLE WHEN 4 THEN 0.2::DOUBLE WHEN 6 THEN least(p_size / 10.0::DOUBLE, 1) ELSE 0.5::DOUBLE END AS selectivity FROM part")
def f09_parse_selectivity(spark, sf):
    k, s = F.col("p_partkey") % 7, F.col("p_size")
    text = F.when(k == 0, F.concat(F.lit('{"selectivity": '), F.format_string("%.2f", s / 100.0), F.lit("}"))).when(k == 1, F.concat(F.lit("about "), s, F.lit(" percent"))).when(k == 2, F.lit("quite High, not low")).when(k == 4, F.lit("low to medium"))
    text = text.when(k == 5, F.concat(F.lit('{"share": '), s, F.lit("}"))).when(k == 6, F.concat(F.lit('{"value": '), F.format_string("%.1f", s / 10.0), F.lit("}"))).otherwise(F.lit("no idea"))
    return table(spark, sf, "part").select("p_partkey", K.parse_selectivity(text).alias("selectivity"))


# --- sampling ----------------------------------------------------------------------------------------------------
def _log(spark, sf):
    o = table(spark, sf, "orders")
    return o.select((F.col("o_custkey") % 50).alias("run_id"), F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("table_name"), F.array("o_orderpriority").alias("attrs"))


def _snapshots(spark, sf):
    return S.schema_features(_log(spark, sf))


_SNAP = "WITH o AS (SELECT o_custkey % 50 AS run_id, o_orderkey AS seq, o_orderstatus AS s, o_orderpriority AS p FROM orders), e0 AS (SELECT *, row_number() OVER w AS n, lag(s) OVER w AS ls, lag(p) OVER w AS lp FROM o WINDOW w AS (PARTITION BY run_id ORDER BY seq)), e AS (SELECT *, CASE WHEN ls IS NULL THEN 1.0::DOUBLE WHEN s <> ls THEN 1.0 WHEN p <> lp THEN 2.0 / 3 ELSE 0.0 END AS entropy FROM e0), r AS (SELECT *, sum(CASE WHEN entropy < 0.05 THEN 0 ELSE 1 END) OVER (PARTITION BY run_id ORDER BY seq) AS island FROM e), k AS (SELECT *, CAST(sum(CASE WHEN entropy < 0.05 THEN 1 ELSE 0 END) OVER (PARTITION BY run_id, island ORDER BY seq) AS BIGINT) AS streak FROM r), "
_SNAP += "f AS (SELECT run_id, seq, 'table:' || s AS x FROM o UNION ALL SELECT run_id, seq, s || '.' || p FROM o), fr AS (SELECT *, row_number() OVER (PARTITION BY run_id, x ORDER BY seq) AS r FROM f), oc AS (SELECT run_id, seq, count(*) FILTER (WHERE r = 1) AS firsts, count(*) FILTER (WHERE r = 2) AS seconds FROM fr GROUP BY run_id, seq), g AS (SELECT oc.*, row_number() OVER w AS n, CAST(sum(firsts - seconds) OVER w AS BIGINT) AS n1, sum(firsts) OVER w AS seen, sum(seconds) OVER w AS twice FROM oc WINDOW w AS (PARTITION BY run_id ORDER BY seq)) "


@query(_SNAP + "SELECT run_id, seq, string_agg(x, ',' ORDER BY x) AS features FROM f GROUP BY run_id, seq")
def c01_schema_features(spark, sf):
    return _snapshots(spark, sf).select("run_id", "seq", F.array_join(F.array_sort("features"), ",").alias("features"))


@query("WITH o AS (SELECT o_custkey % 50 AS run_id, o_orderkey AS seq, o_orderstatus AS s FROM orders) SELECT run_id, seq, s || '.Attribute Name,' || s || '.Description,table:' || s AS features FROM o")
def c01_strict_keys(spark, sf):
    """Features of a reader that takes the field names of nested attributes."""
    d = S.schema_features(_log(spark, sf), strict_keys=True)
    return d.select("run_id", "seq", F.array_join(F.array_sort("features"), ",").alias("features"))


@query(_SNAP + "SELECT run_id, seq, round(entropy, 6) AS entropy FROM e")
def c02_schema_entropy(spark, sf):
    return S.schema_entropy(_snapshots(spark, sf)).select("run_id", "seq", F.round("entropy", 6).alias("entropy"))


@query(_SNAP + "SELECT run_id, seq, streak FROM k")
def c03_stability_streak(spark, sf):
    return S.stability_streak(S.schema_entropy(_snapshots(spark, sf))).select("run_id", "seq", "streak")


@query(_SNAP + "SELECT run_id, count(*) AS n, round(avg(entropy), 6) AS mean, min(entropy) AS min, max(entropy) AS max, round(max_by(entropy, seq), 6) AS final, 2 AS n_features FROM e GROUP BY run_id")
def c04_entropy_statistics(spark, sf):
    return S.entropy_statistics(S.schema_entropy(_snapshots(spark, sf))).withColumn("mean", F.round("mean", 6)).withColumn("final", F.round("final", 6))


_STOP5 = _SNAP + "SELECT run_id, count(*) AS n, min(n) FILTER (WHERE streak >= 2 AND n >= 10 AND pow(0.95, n) * 2 <= 0.05) AS stop_n, CAST(greatest(ceil(ln(2 / 0.05) / 0.05), 10) AS BIGINT) AS min_sample FROM k GROUP BY run_id"


@query(_STOP5)
def c05_stop_point_entropy(spark, sf):
    return S.stop_point_entropy(_snapshots(spark, sf), m=2).withColumn("stop_n", F.col("stop_n").cast("long"))


@query(_SNAP + "SELECT run_id, seq, n, n1, round(n1 / n, 6) AS missing, n >= 50 AND n % 5 = 0 AND n1 / n < 0.05 AS stop FROM g")
def c07_good_turing(spark, sf):
    return S.good_turing(_snapshots(spark, sf)).select("run_id", "seq", F.col("n").cast("long").alias("n"), "n1", F.round("missing", 6).alias("missing"), "stop")


@query(_SNAP + "SELECT run_id, times, count(*) AS features FROM (SELECT run_id, x, count(*) AS times FROM f GROUP BY run_id, x) t GROUP BY run_id, times")
def c08_frequency_of_frequencies(spark, sf):
    return S.frequency_of_frequencies(_snapshots(spark, sf))


@query(_SNAP + "SELECT k.run_id, count(*) AS n, min(k.n) FILTER (WHERE k.n >= 10 AND (streak >= 3 OR twice >= 0.95 * seen)) AS stop_n FROM k JOIN g ON k.run_id = g.run_id AND k.seq = g.seq GROUP BY k.run_id")
def c09_legacy_stop(spark, sf):
    return S.legacy_stop(_snapshots(spark, sf)).withColumn("stop_n", F.col("stop_n").cast("long"))


@query(f"SELECT run_id, n AS total, coalesce(stop_n, n) AS processed, n - coalesce(stop_n, n) AS saved, coalesce(stop_n, n) < n AS stopped_early FROM ({_STOP5}) s")
def c15_run_report(spark, sf):
    return S.run_report(S.stop_point_entropy(_snapshots(spark, sf), m=2).withColumn("stop_n", F.col("stop_n").cast("long")))


_DIST = "sqrt(list_sum(list_transform(list_zip(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])), lambda x: (x[1] - x[2]) * (x[1] - x[2]))))"


@query("WITH p0 AS (SELECT embedding FROM embeddings WHERE vec_id = 0), d1 AS (SELECT vec_id, e.embedding AS v, " + _DIST.format(a="e.embedding", b="p0.embedding") + " AS d FROM embeddings e, p0 WHERE vec_id <> 0), p1 AS (SELECT vec_id, v, d FROM d1 ORDER BY d DESC, vec_id LIMIT 1), d2 AS (SELECT d1.vec_id, least(d1.d, " + _DIST.format(a="d1.v", b="p1.v") + ") AS d FROM d1, p1 WHERE d1.vec_id <> p1.vec_id), p2 AS (SELECT vec_id, d FROM d2 ORDER BY d DESC, vec_id LIMIT 1) SELECT 1 AS pick, vec_id AS id, round(d, 6) AS min_dist FROM p1 UNION ALL SELECT 2, vec_id, round(d, 6) FROM p2")
def c10_select_maxmin(spark, sf):
    return S.select_maxmin(table(spark, sf, "embeddings"), [0], 2).withColumn("min_dist", F.round("min_dist", 6))


_MEAN = "(SELECT list(m ORDER BY i) AS mean FROM (SELECT i, avg(x) AS m FROM (SELECT generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) u GROUP BY i) g)"


@query(f"SELECT vec_id AS id, round({_DIST.format(a='embedding', b='mean')}, 6) AS distance FROM embeddings, {_MEAN} m ORDER BY {_DIST.format(a='embedding', b='mean')} DESC, vec_id LIMIT 1")
def c11_farthest_from_mean(spark, sf):
    return S.farthest_from_mean(table(spark, sf, "embeddings")).withColumn("distance", F.round("distance", 6))


_FAR = "SELECT vec_id FROM embeddings, (SELECT list(m ORDER BY i) AS mean FROM (SELECT i, avg(x) AS m FROM (SELECT generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings WHERE vec_id IN {chosen}) u GROUP BY i) g) m WHERE vec_id NOT IN {gone} ORDER BY " + _DIST.format(a="embedding", b="mean") + " DESC, vec_id LIMIT 1"


@query("WITH p1 AS (" + _FAR.format(chosen="(SELECT vec_id FROM embeddings)", gone="(SELECT -1)") + "), p2 AS (" + _FAR.format(chosen="(SELECT vec_id FROM p1)", gone="(SELECT vec_id FROM p1)") + "), p12 AS (SELECT * FROM p1 UNION ALL SELECT * FROM p2), p3 AS (" + _FAR.format(chosen="(SELECT vec_id FROM p12)", gone="(SELECT vec_id FROM p12)") + ") SELECT 1 AS pick, vec_id AS id FROM p1 UNION ALL SELECT 2, vec_id FROM p2 UNION ALL SELECT 3, vec_id FROM p3")
def c12_diversity_order(spark, sf):
    return S.diversity_order(table(spark, sf, "embeddings"), 3)


@query("SELECT count(*) FILTER (WHERE doc_id IN (SELECT vec_id FROM embeddings)) AS with_vector, count(*) FILTER (WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)) AS without_vector FROM documents")
def c13_embedding_coverage(spark, sf):
    return S.embedding_coverage(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "embeddings").select("vec_id"), "doc_id", "vec_id")


@query("SELECT doc_id, row_number() OVER (ORDER BY md5('7:' || doc_id), doc_id) - 1 AS place FROM documents")
def c14_shuffle(spark, sf):
    return S.shuffled(table(spark, sf, "documents").select("doc_id"), "doc_id", 7)


# --- schemas -----------------------------------------------------------------------------------------------------
def _tables_log(spark, sf):
    o = table(spark, sf, "orders")
    return o.select((F.col("o_custkey") % 50).alias("run_id"), F.col("o_orderkey").alias("seq"), F.slice(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.lit(1), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("tables"))


@query("SELECT o_custkey % 50 AS run_id, max(o_orderkey) % 3 + 1 AS n FROM orders GROUP BY 1")
def d01_latest_schema(spark, sf):
    return B.latest_schema(_tables_log(spark, sf)).select("run_id", F.size("tables").cast("long").alias("n"))


@query("SELECT run_id, seq, coalesce(NOT n < lag(n) OVER (PARTITION BY run_id ORDER BY seq), true) AS valid FROM (SELECT o_custkey % 50 AS run_id, o_orderkey AS seq, o_orderkey % 3 AS n FROM orders) t")
def d02_monotonic(spark, sf):
    return B.monotonic(_tables_log(spark, sf)).select("run_id", "seq", "valid")


@query("SELECT p_brand AS table_name, max_by(p_type, p_partkey) AS attrs, count(*) AS n_documents FROM part GROUP BY p_brand HAVING count(*) > 80")
def d03_consolidate(spark, sf):
    p = table(spark, sf, "part")
    out = B.consolidate(p.select(F.col("p_brand").alias("table_name"), F.array("p_type").alias("attrs"), F.col("p_partkey").alias("seq")), p.select(F.col("p_brand").alias("res")), 80)
    return out.select("table_name", F.get("attrs", F.lit(0)).alias("attrs"), "n_documents")


@query("SELECT source AS res, CAST(r AS INTEGER) AS example, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5('0:' || doc_id), doc_id) AS r FROM documents) t WHERE r <= 3")
def d04_example_documents(spark, sf):
    return B.example_documents(table(spark, sf, "documents").select("doc_id", F.col("source").alias("res")))


@query("SELECT DISTINCT CAST(p_size AS VARCHAR) AS query_id, p_brand AS table_name, p_type AS attr FROM part WHERE p_partkey % 2 = 0 AND p_brand IN (SELECT p_brand FROM part WHERE p_size = 1) AND EXISTS (SELECT 1 FROM part s WHERE s.p_size = 1 AND s.p_brand = part.p_brand AND s.p_type = part.p_type)")
def d05_tailored_schema(spark, sf):
    p = table(spark, sf, "part")
    need = p.where("p_partkey % 2 = 0").groupBy(F.col("p_size").cast("string").alias("query_id")).agg(F.collect_set(F.concat("p_brand", F.lit("."), "p_type")).alias("attributes"))
    return B.tailored_schema(p.where("p_size = 1").select(F.col("p_brand").alias("table_name"), F.col("p_type").alias("attr")), need)


@query("SELECT run_id, arg_max(seq, n * 1000000000000 - seq) AS seq, max(n) AS n FROM (SELECT o_custkey % 50 AS run_id, o_orderkey AS seq, o_orderkey % 3 + 1 AS n FROM orders) t GROUP BY run_id")
def d06_resume_state(spark, sf):
    return B.resume_state(_tables_log(spark, sf)).select("run_id", "seq", F.size("tables").cast("long").alias("n"))


@query()
def d07_cluster(spark, sf):
    return B.cluster(table(spark, sf, "embeddings").select("vec_id", "embedding"), 2).select("vec_id", "cluster")


def _given_clusters(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.col("label").alias("cluster"))


@query("SELECT label AS cluster, count(*) AS documents, min(vec_id) AS first FROM embeddings GROUP BY label")
def d08_cluster_sizes(spark, sf):
    return B.cluster_sizes(_given_clusters(spark, sf), "vec_id")


@query("SELECT label AS cluster, r // 100 AS block, string_agg(vec_id, ',' ORDER BY vec_id) AS ids FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS r FROM embeddings) t GROUP BY 1, 2")
def d08_cluster_documents(spark, sf):
    d = B.cluster_documents(_given_clusters(spark, sf), "vec_id", 100)
    return d.withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), ","))


# --- evaluation --------------------------------------------------------------------------------------------------
def _pairs(spark, sf):
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    data = F.create_map(F.lit("status"), F.when(k % 17 == 0, "X").otherwise(F.col("o_orderstatus")), F.lit("priority"), F.when(k % 23 == 0, "N/A").otherwise(F.col("o_orderpriority")), F.lit("note"), F.when(k % 41 == 0, "late"))
    pred = o.select(k.cast("string").alias("doc_id"), F.when(k % 43 == 0, F.lit(None)).when(k % 29 == 0, "invoices").otherwise("orders").alias("pred_table"), data.alias("pred"))
    return pred.join(order_truth(spark, sf), "doc_id")


def _name_map(spark, sf):
    rows = F.explode(F.array(F.struct(F.lit("status").alias("pred_attr"), F.array(F.lit("status")).alias("gt_attrs")), F.struct(F.lit("priority").alias("pred_attr"), F.array(F.lit("priority")).alias("gt_attrs"))))
    return table(spark, sf, "region").where("r_regionkey = 0").select(F.lit("orders").alias("gt_table"), rows.alias("m")).select("gt_table", "m.*")


def _checked(spark, sf):
    tables = table(spark, sf, "region").where("r_regionkey = 0").select(F.lit("orders").alias("pred_table"), F.lit("orders").alias("mapped"))
    return G.check_tables(_pairs(spark, sf), tables)


_EV = f"""WITH e AS (SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, CASE WHEN o_orderkey % 43 = 0 THEN NULL ELSE {_RES} END AS pt, CASE WHEN o_orderkey % 37 <> 0 THEN 'orders' END AS gt, lower({_STATUS}) AS ps, lower(o_orderstatus) AS gs, lower({_PRIORITY}) AS pp, CASE WHEN o_orderkey % 31 = 0 THEN '' ELSE lower(o_orderpriority) END AS gp, o_orderkey % 41 = 0 AS note FROM orders),
ok AS (SELECT *, coalesce(pt = gt, false) AS table_ok FROM e),
a AS (SELECT doc_id, 'status' AS attr, ps AS p, gs AS g FROM ok WHERE table_ok UNION ALL SELECT doc_id, 'priority', pp, gp FROM ok WHERE table_ok),
c AS (SELECT *, CASE WHEN p = 'n/a' AND g = '' THEN 'TP' WHEN g = '' THEN 'FP' WHEN p = 'n/a' THEN 'FN' WHEN contains(p, g) THEN 'TP' ELSE 'FP' END AS outcome FROM a),
cc AS (SELECT doc_id, count(*) FILTER (WHERE outcome = 'TP') AS tp, count(*) FILTER (WHERE outcome = 'FP') AS fp, count(*) FILTER (WHERE outcome = 'FN') AS fn FROM c GROUP BY doc_id),
d AS (SELECT ok.doc_id, CASE WHEN table_ok THEN tp ELSE 0 END AS tp,
 CASE WHEN gt IS NULL THEN CASE WHEN pt IS NOT NULL THEN 1 + (pp <> 'n/a')::INT + note::INT ELSE 0 END WHEN NOT table_ok THEN note::INT ELSE fp + note::INT END AS fp,
 CASE WHEN gt IS NULL THEN 0 WHEN NOT table_ok THEN 1 + (gp <> '')::INT ELSE fn END AS fn,
 CASE WHEN gt IS NULL AND pt IS NULL THEN 1 ELSE 0 END AS tn, CASE WHEN gt IS NULL THEN pt IS NULL ELSE table_ok END AS table_ok,
 CASE WHEN gt IS NULL THEN true WHEN NOT table_ok THEN false ELSE fp = 0 AND fn = 0 AND NOT note END AS correct FROM ok LEFT JOIN cc USING (doc_id)) """


@query(_EV + "SELECT doc_id, table_ok FROM ok")
def g02_table_check(spark, sf):
    return _checked(spark, sf).select("doc_id", "table_ok")


@query(_EV + "SELECT doc_id, attr, outcome FROM c")
def g04_compare_attributes(spark, sf):
    return G.compare_attributes(_checked(spark, sf), _name_map(spark, sf)).select("doc_id", "attr", "outcome")


@query(_EV + "SELECT doc_id, 'note' AS attr FROM ok WHERE note AND gt IS NOT NULL")
def g05_extra_attributes(spark, sf):
    return G.extra_attributes(_checked(spark, sf), _name_map(spark, sf))


@query(_EV + "SELECT doc_id, tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn, table_ok, correct FROM d")
def g07_document_counts(spark, sf):
    return G.document_counts(_checked(spark, sf), _name_map(spark, sf))


_TOT = "SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, CAST(sum(tn) AS BIGINT) AS tn, count(*) FILTER (WHERE correct) AS correct_documents, count(*) AS documents FROM d"


@query(_EV + _TOT)
def g08_totals(spark, sf):
    return G.totals(G.document_counts(_checked(spark, sf), _name_map(spark, sf)))


@query(_EV + "SELECT gt_table, attr, total, correct, round(correct / total, 6) AS accuracy FROM (SELECT CASE WHEN grouping(t) = 0 THEN t END AS gt_table, attr, count(*) AS total, count(*) FILTER (WHERE outcome = 'TP') AS correct FROM (SELECT 'orders' AS t, attr, outcome FROM c) x GROUP BY ROLLUP (t, attr)) y")
def g09_attribute_accuracy(spark, sf):
    return G.attribute_accuracy(G.compare_attributes(_checked(spark, sf), _name_map(spark, sf))).withColumn("accuracy", F.round("accuracy", 6))


@query(_EV + f", t AS ({_TOT}) SELECT round(tp / (tp + fn), 6) AS recall, round(tp / (tp + fp), 6) AS precision, round(2 * (tp / (tp + fn)) * (tp / (tp + fp)) / (tp / (tp + fn) + tp / (tp + fp)), 6) AS f1, round(correct_documents / documents, 6) AS accuracy FROM t")
def g10_metrics(spark, sf):
    m = G.metrics(G.totals(G.document_counts(_checked(spark, sf), _name_map(spark, sf))))
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns])


@query(_EV + "SELECT count(*) FILTER (WHERE pt = gt) AS tp, count(*) FILTER (WHERE pt IS NOT NULL AND pt IS DISTINCT FROM gt) AS fp, count(*) FILTER (WHERE gt IS NOT NULL AND pt IS DISTINCT FROM gt) AS fn, count(*) FILTER (WHERE pt IS NULL AND gt IS NULL) AS tn FROM ok")
def g11_table_confusion(spark, sf):
    return G.table_confusion(_pairs(spark, sf))


def _votes(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(F.col("l_returnflag").alias("pred_value"), F.concat(F.lit("s"), "l_suppkey").alias("gt_value"), (F.col("l_quantity") > 25).alias("vote"))


_VOTE = "SELECT l_returnflag AS pred_value, 's' || l_suppkey AS gt_value, count(*) FILTER (WHERE l_quantity > 25) AS y, count(*) FILTER (WHERE l_quantity <= 25) AS n FROM lineitem GROUP BY 1, 2"


@query(f"SELECT pred_value, gt_value, y >= n AS result, y > 0 AND n > 0 AS disagree FROM ({_VOTE}) v")
def g13_committee_vote(spark, sf):
    return G.committee_vote(_votes(spark, sf))


@query(_EV + "SELECT DISTINCT p AS pred_value, g AS gt_value FROM c WHERE p <> 'n/a' AND g <> '' AND NOT contains(p, g)")
def g12_missing_verdicts(spark, sf):
    cmp = G.compare_attributes(_checked(spark, sf), _name_map(spark, sf))
    known = G.committee_vote(_votes(spark, sf))
    return G.missing_verdicts(cmp, known)


def _verdicts(spark, sf):
    k = F.col("o_orderkey")
    votes = table(spark, sf, "orders").where(k % 17 == 0).select(F.lit("x").alias("pred_value"), F.lower("o_orderstatus").alias("gt_value"), (k % 5 < F.when(F.col("o_orderstatus") == "F", 1).otherwise(4)).alias("vote"))
    return G.committee_vote(votes)


_JUDGED = ", vd AS (SELECT lower(o_orderstatus) AS g, count(*) FILTER (WHERE o_orderkey % 5 < CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 4 END) * 2 >= count(*) AS yes FROM orders WHERE o_orderkey % 17 = 0 GROUP BY 1), cv AS (SELECT doc_id, attr, CASE WHEN outcome = 'FP' AND c.p = 'x' AND attr = 'status' AND c.g <> '' AND yes THEN 'TP' ELSE outcome END AS outcome FROM c LEFT JOIN vd ON vd.g = c.g) "


@query(_EV + _JUDGED + "SELECT doc_id, attr, outcome FROM cv")
def g12_verdict_lookup(spark, sf):
    return G.compare_attributes(_checked(spark, sf), _name_map(spark, sf), _verdicts(spark, sf)).select("doc_id", "attr", "outcome")


@query(_EV + _JUDGED + ", cj AS (SELECT doc_id, count(*) FILTER (WHERE outcome = 'TP') AS tp, count(*) FILTER (WHERE outcome = 'FP') AS fp, count(*) FILTER (WHERE outcome = 'FN') AS fn FROM cv GROUP BY doc_id) SELECT ok.doc_id, coalesce(tp, 0) AS tp, coalesce(fp, 0) + note::INT AS fp, coalesce(fn, 0) AS fn FROM ok JOIN cj USING (doc_id)")
def g07_judged_counts(spark, sf):
    return G.document_counts(_checked(spark, sf).where("table_ok"), _name_map(spark, sf), _verdicts(spark, sf)).select("doc_id", "tp", "fp", "fn")


@query("SELECT a.n_regionkey AS k, count(*) FILTER (WHERE n_nationkey % 2 = 0 AND n_nationkey % 3 = 0) AS tp, count(*) FILTER (WHERE n_nationkey % 2 = 0 AND n_nationkey % 3 <> 0) AS fp, count(*) FILTER (WHERE n_nationkey % 2 <> 0 AND n_nationkey % 3 = 0) AS fn FROM nation a GROUP BY 1")
def g14_set_counts(spark, sf):
    n = table(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("k")).agg(F.collect_set(F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name"))).alias("a"), F.collect_set(F.when(F.col("n_nationkey") % 3 == 0, F.col("n_name"))).alias("b"))
    return n.select("k", *[c for c in G.set_counts(F.col("a"), F.col("b"))]).select("k", *[F.col(c).cast("long").alias(c) for c in ("tp", "fp", "fn")])


# --- detection ---------------------------------------------------------------------------------------------------
_N_LAYERS, _N_SAMPLES = 6, 3


def _outputs(spark, sf):
    layers = F.explode(F.sequence(F.lit(0), F.lit(_N_LAYERS - 1)))
    d = table(spark, sf, "labels").select("doc_id", F.col("toxic").alias("y"), layers.alias("layer")).withColumn("sample_ix", F.explode(F.sequence(F.lit(0), F.lit(_N_SAMPLES - 1))))
    p = ((F.col("doc_id") * 37 + F.col("layer") * 101 + F.col("sample_ix") * 13) % 1000) / 1000.0
    return d.withColumn("prob", p * 0.7 + F.col("y") * 0.3)


def _labels(spark, sf):
    return table(spark, sf, "labels").select("doc_id", F.col("toxic").alias("y"))


def _scores(spark, sf):
    return H.document_scores(_outputs(spark, sf)).join(_labels(spark, sf), "doc_id")


_OUT = f"WITH o AS (SELECT doc_id, toxic AS y, layer, s, ((doc_id * 37 + layer * 101 + s * 13) % 1000) / 1000.0::DOUBLE * 0.7::DOUBLE + toxic * 0.3::DOUBLE AS prob FROM labels, range({_N_LAYERS}) l(layer), range({_N_SAMPLES}) m(s)), sc AS (SELECT doc_id, y, layer, layer // 2 AS ens, max(prob) AS score FROM o GROUP BY ALL) "


@query("SELECT doc_id, target, y FROM (SELECT doc_id, '__table__' AS target, CASE WHEN quality = 1 THEN 0 ELSE 1 END AS y FROM labels UNION ALL SELECT doc_id, 'toxic', CASE WHEN toxic = 0 THEN 0 ELSE 1 END FROM labels) t")
def h01_labelled_samples(spark, sf):
    stats = table(spark, sf, "labels").select("doc_id", (F.col("quality") == 1).alias("table_ok"), F.create_map(F.lit("toxic"), F.col("toxic") == 0).alias("attrs"))
    return H.labelled_samples(stats)


@query("WITH n AS (SELECT toxic AS y, count(*) AS n FROM labels GROUP BY 1), r AS (SELECT doc_id, toxic AS y, row_number() OVER (PARTITION BY toxic ORDER BY doc_id) AS r FROM labels) SELECT doc_id, r.y, (SELECT max(n) FROM n) // n.n + CASE WHEN r.r <= (SELECT max(n) FROM n) % n.n THEN 1 ELSE 0 END AS copies FROM r JOIN n ON r.y = n.y")
def h02_oversample(spark, sf):
    return H.oversample(_labels(spark, sf)).groupBy("doc_id", "y").agg(F.count(F.lit(1)).alias("copies"))


@query("SELECT doc_id, percent_rank() OVER (ORDER BY doc_id) < 0.8 AS is_train FROM labels")
def h03_ordered_split(spark, sf):
    return H.ordered_split(_labels(spark, sf), 0.8).select("doc_id", "is_train")


@query("WITH s AS (SELECT doc_id FROM labels ORDER BY md5('3:' || doc_id), doc_id LIMIT 100) SELECT doc_id, toxic AS y, percent_rank() OVER (ORDER BY doc_id) < 0.8 AS is_train FROM labels WHERE doc_id IN (SELECT doc_id FROM s)")
def h03_train_sample(spark, sf):
    return H.ordered_split(H.train_sample(_labels(spark, sf), 100, seed=3), 0.8).select("doc_id", "y", "is_train")


def _vector_samples(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("features"), F.when(F.col("label") == 3, 1).otherwise(0).alias("y"))


@query()
def h04_error_classifier(spark, sf):
    d = _vector_samples(spark, sf)
    split = saved(H.ordered_split(d, 0.8, "vec_id"))
    model, _ = H.best_classifier(H.oversample(split.where("is_train"), order="vec_id"), split.where("not is_train"))
    return H.score_samples(model, d).select("vec_id", "y", "prob")


@query()
def h05_multi_head(spark, sf):
    split = saved(H.ordered_split(_vector_samples(spark, sf), 0.8, "vec_id"))
    model, _ = train_heads(split, hidden=16, epochs=30)
    return score_heads(model, split).select("vec_id", "y", "heads", "prob")


@query(_OUT + "SELECT doc_id, layer, round(score, 6) AS score FROM sc")
def h06_document_scores(spark, sf):
    return H.document_scores(_outputs(spark, sf)).select("doc_id", "layer", F.round("score", 6).alias("score"))


def _ens(spark, sf):
    return _scores(spark, sf).withColumn("ens", F.floor(F.col("layer") / 2).cast("int"))


_VOTES = {
    "half": "SELECT doc_id, CASE WHEN sum((s >= 0.6)::INT) * 2 >= count(*) THEN 1 ELSE 0 END AS pred FROM (SELECT doc_id, ens, avg(score) AS s FROM sc GROUP BY 1, 2) e GROUP BY 1",
    "soft": "SELECT doc_id, CASE WHEN avg(s) >= 0.6 THEN 1 ELSE 0 END AS pred FROM (SELECT doc_id, ens, avg(score) AS s FROM sc GROUP BY 1, 2) e GROUP BY 1",
    "hard": "SELECT doc_id, CASE WHEN sum((s >= 0.5)::INT) * 2 >= count(*) THEN 1 ELSE 0 END AS pred FROM (SELECT doc_id, ens, avg((score >= 0.6)::INT) AS s FROM sc GROUP BY 1, 2) e GROUP BY 1",
}


@query(_OUT + " UNION ALL ".join(f"SELECT '{m}' AS mode, doc_id, pred FROM ({s}) {m}" for m, s in _VOTES.items()))
def h07_ensemble_voting(spark, sf):
    e = _ens(spark, sf)
    out = None
    for m in _VOTES:
        v = H.vote(e, m, 0.6).select(F.lit(m).alias("mode"), "doc_id", "pred")
        out = v if out is None else out.union(v)
    return out


_MET = "count(*) FILTER (WHERE y = 0 AND pred = 0) AS tn, count(*) FILTER (WHERE y = 0 AND pred = 1) AS fp, count(*) FILTER (WHERE y = 1 AND pred = 0) AS fn, count(*) FILTER (WHERE y = 1 AND pred = 1) AS tp"
_RATES = "round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall, round(CASE WHEN tp > 0 THEN 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)) ELSE 0 END, 6) AS f1, round((fp + fn) / (tn + fp + fn + tp), 6) AS error_rate, round((tn + fp) / (tn + fp + fn + tp), 6) AS original_accuracy, round(fn / (tn + fp + fn + tp), 6) AS residual_error_rate, round(CASE WHEN tn + fp > 0 THEN fp / (tn + fp) ELSE 0 END, 6) AS extra_cost_rate, round((tn + fp + tp) / (tn + fp + fn + tp), 6) AS corrected_accuracy"
_COLS = ("precision", "recall", "f1", "error_rate", "residual_error_rate", "extra_cost_rate", "original_accuracy", "corrected_accuracy")


@query(_OUT + f", v AS ({_VOTES['half']}), m AS (SELECT {_MET} FROM v JOIN labels USING (doc_id), (SELECT 1) WHERE true) SELECT tn, fp, fn, tp, {_RATES} FROM m".replace("y = ", "toxic = "))
def h08_detection_metrics(spark, sf):
    m = H.detection_metrics(H.vote(_ens(spark, sf), "half", 0.6).join(_labels(spark, sf), "doc_id"))
    return m.select("tn", "fp", "fn", "tp", *[F.round(c, 6).alias(c) for c in _COLS])


@query(_OUT + "SELECT layer, round((sum(rk) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2) / (count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y = 0)), 6) AS auc FROM (SELECT *, rank() OVER (PARTITION BY layer ORDER BY score) + (count(*) OVER (PARTITION BY layer, score) - 1) / 2 AS rk FROM sc) r GROUP BY layer")
def h09_roc_auc(spark, sf):
    return H.roc_auc(_scores(spark, sf), "layer").withColumn("auc", F.round("auc", 6))


@query(f"SELECT layer, CAST((row_number() OVER (ORDER BY md5('0:' || layer), layer) - 1) // 2 AS INTEGER) AS ens FROM range({_N_LAYERS}) l(layer)")
def h10_layer_ensembles(spark, sf):
    return H.assign_ensembles(_outputs(spark, sf), 2)


_PREFIX = "pr AS (SELECT p.prefix, doc_id, y, CASE WHEN sum((s >= 0.6)::INT) * 2 >= count(*) THEN 1 ELSE 0 END AS pred FROM (SELECT doc_id, y, ens, avg(score) AS s FROM sc GROUP BY 1, 2, 3) e JOIN (SELECT unnest([1, 2, 3]) AS prefix) p ON e.ens < p.prefix GROUP BY 1, 2, 3)"


@query(_OUT + f", {_PREFIX}, m AS (SELECT prefix, {_MET} FROM pr GROUP BY prefix) SELECT prefix, tn, fp, fn, tp, {_RATES} FROM m")
def h11_incremental_ensembles(spark, sf):
    return H.detection_metrics(H.prefix_votes(_ens(spark, sf), 3, 0.6), "prefix").select("prefix", "tn", "fp", "fn", "tp", *[F.round(c, 6).alias(c) for c in _COLS])


_SIZED = "sz AS (SELECT doc_id, y, layer, size, least(score + size / 1000.0::DOUBLE * ((doc_id * 7 + layer) % 5), 1) AS score FROM sc, (SELECT unnest([50, 100]) AS size) q)"
_AUC = "round((sum(rk) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2) / (count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y = 0)), 6) AS auc"


@query(_OUT + f", {_SIZED}, m AS (SELECT layer, size, {_MET} FROM (SELECT *, (score >= 0.6)::INT AS pred FROM sz) x GROUP BY layer, size), u AS (SELECT layer, size, {_AUC} FROM (SELECT *, rank() OVER (PARTITION BY layer, size ORDER BY score) + (count(*) OVER (PARTITION BY layer, size, score) - 1) / 2 AS rk FROM sz) r GROUP BY layer, size) SELECT m.layer, m.size, tn, fp, fn, tp, {_RATES}, auc FROM m JOIN u ON m.layer = u.layer AND m.size = u.size")
def h12_size_grid(spark, sf):
    size = F.explode(F.array(F.lit(50), F.lit(100))).alias("size")
    s = _scores(spark, sf).select("doc_id", "y", "layer", "score", size).withColumn("score", F.least(F.col("score") + F.col("size") / 1000.0 * ((F.col("doc_id") * 7 + F.col("layer")) % 5), F.lit(1.0)))
    return H.size_grid(s, "layer", "size", threshold=0.6).select("layer", "size", "tn", "fp", "fn", "tp", *[F.round(c, 6).alias(c) for c in (*_COLS, "auc")])


def _three_votes(spark, sf):
    s = _scores(spark, sf).where("layer < 3")
    return s.groupBy("doc_id", "y").agg(F.transform(F.sort_array(F.collect_list(F.struct("layer", "score"))), lambda x: (x["score"] >= 0.6).cast("int")).alias("v")).select("y", "v")


_BOUND = "v AS (SELECT doc_id, y, max((score >= 0.6)::INT) FILTER (WHERE layer = 0) AS a, max((score >= 0.6)::INT) FILTER (WHERE layer = 1) AS b, max((score >= 0.6)::INT) FILTER (WHERE layer = 2) AS c FROM sc GROUP BY 1, 2), w AS (SELECT *, ((a <> y)::INT + (b <> y)::INT + (c <> y)::INT) / 3 AS e, ((a <> b)::INT + (a <> c)::INT + (b <> c)::INT) / 3 AS d, (((a <> y)::INT + (b <> y)::INT) * (a <> b)::INT + ((a <> y)::INT + (c <> y)::INT) * (a <> c)::INT + ((b <> y)::INT + (c <> y)::INT) * (b <> c)::INT) / 9 AS eps FROM v), m AS (SELECT avg(e) FILTER (WHERE y = 1) AS l, avg(d) FILTER (WHERE y = 1) AS dis, avg(eps) FILTER (WHERE y = 1) AS eps, avg((e > 0.5)::INT) FILTER (WHERE y = 1) AS num, avg(e * e) FILTER (WHERE y = 1) AS den, avg((y = 1)::INT) AS p1 FROM w), k AS (SELECT k, round(coalesce(num / nullif(den, 0), 0) * (l + (3 * (k - 1)) / (2 * k) * (coalesce(eps / nullif(2 * l, 0), 0) * l - 0.5 * dis)) * p1, 4) AS error FROM m, (SELECT unnest([3, 4, 5, 6, 7, 8]) AS k) q)"


@query(_OUT + f", {_BOUND} SELECT k, error FROM k")
def h13_voting_error(spark, sf):
    return H.voting_error(_three_votes(spark, sf))


@query(_OUT + f", {_BOUND} SELECT 'k' || k AS name, error AS value FROM k UNION ALL SELECT 'n' || n, round(CASE WHEN error <= 0 OR error >= 1 THEN 0 ELSE exp(-(pow(1 / (2 * error) - 1, 2) * n * error) / 2) END, 4) FROM k, (SELECT unnest([1, 2, 3, 4, 5, 6, 7, 8]) AS n) q WHERE k = 3")
def h15_error_bounds(spark, sf):
    return H.error_bounds(_three_votes(spark, sf))


def _split(spark, sf):
    part = F.when(F.col("doc_id") % 10 == 0, "cell").when(F.col("doc_id") % 3 == 0, "recal").otherwise("test")
    return _labels(spark, sf).withColumn("part", part)


_CONF = _OUT + ", sp AS (SELECT doc_id, toxic AS y, CASE WHEN doc_id % 10 = 0 THEN 'cell' WHEN doc_id % 3 = 0 THEN 'recal' ELSE 'test' END AS part FROM labels), pv AS (SELECT doc_id, list(score ORDER BY layer) AS p FROM sc WHERE layer < 3 GROUP BY 1), bo AS (SELECT sp.*, lab, list_transform(p, lambda x: CASE WHEN lab = 1 THEN 1 - x ELSE x END) AS s FROM sp JOIN pv USING (doc_id), (SELECT unnest([0, 1]) AS lab) l), ce AS (SELECT doc_id AS cell, s AS c FROM bo WHERE part = 'cell' AND lab = y ORDER BY doc_id LIMIT 50), di AS (SELECT part, doc_id, y, lab, cell, (s[1] - c[1]) * (s[1] - c[1]) + (s[2] - c[2]) * (s[2] - c[2]) + (s[3] - c[3]) * (s[3] - c[3]) AS d FROM bo, ce WHERE part <> 'cell'), pl AS (SELECT part, doc_id, y, lab, cell FROM di QUALIFY row_number() OVER (PARTITION BY doc_id, lab ORDER BY d, cell) = 1), pe AS (SELECT ce.cell, count(*) FILTER (WHERE part = 'recal' AND lab = y) AS t, count(*) FILTER (WHERE part = 'recal' AND lab <> y) AS f FROM ce LEFT JOIN pl ON ce.cell = pl.cell GROUP BY 1), ra AS (SELECT *, coalesce(sum(t) OVER (ORDER BY CASE WHEN t > 0 THEN (f + t) / t ELSE 'inf'::DOUBLE END, cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM pe), tk AS (SELECT alpha, cell FROM ra, (SELECT unnest([0.05, 0.1, 0.2]::DOUBLE[]) AS alpha) a WHERE before < ceil((1 - alpha) * ((SELECT count(*) FROM sp WHERE part = 'recal') + 1))), se AS (SELECT a.alpha, pl.doc_id, pl.y, list_sort(list(DISTINCT lab) FILTER (WHERE tk.cell IS NOT NULL)) AS labels FROM pl CROSS JOIN (SELECT unnest([0.05, 0.1, 0.2]::DOUBLE[]) AS alpha) a LEFT JOIN tk ON tk.alpha = a.alpha AND tk.cell = pl.cell WHERE part = 'test' GROUP BY 1, 2, 3), st AS (SELECT alpha, doc_id, y, CASE WHEN labels IS NULL OR len(labels) = 0 THEN [0] ELSE labels END AS labels FROM se) "


def _sets(spark, sf, layers="layer < 3"):
    p = _scores(spark, sf).where(layers).groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("layer", "score"))), lambda x: x["score"]).alias("p"))
    return H.conformal_sets(p, _split(spark, sf), (0.05, 0.1, 0.2))


@query(_CONF + "SELECT alpha, doc_id, array_to_string(labels, ',') AS labels FROM st")
def h16_conformal_sets(spark, sf):
    return _sets(spark, sf).select("alpha", "doc_id", F.array_join(F.col("labels").cast("array<string>"), ",").alias("labels"))


@query(_CONF + f", cm AS (SELECT alpha, round(avg(list_contains(labels, y)::INT), 6) AS coverage, round(avg((len(labels) > 1)::INT), 6) AS abstain_share, round(avg(len(labels)), 6) AS avg_size, {_MET} FROM (SELECT *, list_contains(labels, 1)::INT AS pred FROM st) x GROUP BY alpha) SELECT alpha, coverage, abstain_share, avg_size, tn, fp, fn, tp, {_RATES} FROM cm")
def h17_conformal_metrics(spark, sf):
    m = H.conformal_metrics(_sets(spark, sf))
    return m.select("alpha", "tn", "fp", "fn", "tp", *[F.round(c, 6).alias(c) for c in ("coverage", "abstain_share", "avg_size", *_COLS)])


@query(_CONF + "SELECT alpha, doc_id FROM st WHERE y = 1 AND NOT list_contains(labels, 1)")
def h17_missed_documents(spark, sf):
    return H.missed_documents(_sets(spark, sf))


_COVER = "SELECT {} AS head, alpha, round(avg(list_contains(labels, y)::INT), 6) AS coverage FROM st GROUP BY alpha"


@query("SELECT * FROM (" + _CONF + _COVER.format(0) + ") a UNION ALL SELECT * FROM (" + _CONF.replace("layer < 3", "layer >= 3") + _COVER.format(1) + ") b")
def h17_metrics_by_head(spark, sf):
    both = _sets(spark, sf).withColumn("head", F.lit(0)).union(_sets(spark, sf, "layer >= 3").withColumn("head", F.lit(1)))
    return H.conformal_metrics(both, "head").select("head", "alpha", F.round("coverage", 6).alias("coverage"))


_GRID = "[" + ", ".join(map(str, H.THRESHOLDS)) + "]::DOUBLE[]"
_MV = _OUT + f", g AS (SELECT threshold, doc_id, y, count(*) FILTER (WHERE score >= threshold) AS ones, count(*) AS n FROM sc, (SELECT unnest({_GRID}) AS threshold) t GROUP BY 1, 2, 3), h AS (SELECT *, CASE WHEN ones * 2 >= n THEN 1 ELSE 0 END AS pred, least(ones, n - ones, 3) AS disagree FROM g) "


@query(_MV + "SELECT threshold, disagree, count(*) AS documents, round(avg((y = 1 AND pred = 0)::INT), 6) AS fn_rate FROM h GROUP BY 1, 2")
def h18_marginal_levels(spark, sf):
    return H.marginal_voting(_outputs(spark, sf), _labels(spark, sf))[0].withColumn("fn_rate", F.round("fn_rate", 6))


@query(_MV + "SELECT threshold, abstain, round(count(*) FILTER (WHERE CASE WHEN disagree <= abstain THEN y = 0 AND pred = 1 ELSE y = 0 END) / count(*) FILTER (WHERE y = 0), 6) AS extra_cost_rate, round(1 - count(*) FILTER (WHERE disagree <= abstain AND y = 1 AND pred = 0) / count(*), 6) AS accuracy FROM h, (SELECT unnest([0, 1, 2]) AS abstain) a GROUP BY 1, 2")
def h18_marginal_abstention(spark, sf):
    m = H.marginal_voting(_outputs(spark, sf), _labels(spark, sf))[1]
    return m.select("threshold", "abstain", F.round("extra_cost_rate", 6).alias("extra_cost_rate"), F.round("accuracy", 6).alias("accuracy"))


@query(_OUT + "SELECT layer, 'score' AS measure, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std FROM sc GROUP BY layer")
def h19_trial_summary(spark, sf):
    t = H.trial_summary(_scores(spark, sf).select("layer", F.lit("score").alias("measure"), F.col("score").alias("value")), "layer")
    return t.select("layer", "measure", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


def _tokens(spark, sf):
    b = table(spark, sf, "benchmark").select("item_id", F.split("text", " ").alias("tokens"))
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    n = table(spark, sf, "embeddings").agg(F.count(F.lit(1)).alias("n"))
    t = b.select("item_id", F.posexplode("tokens").alias("pos", "token_text")).crossJoin(F.broadcast(n))
    return t.join(e, (F.col("item_id") * 31 + F.col("pos")) % F.col("n") == F.col("vec_id")).select("item_id", "pos", "token_text", "vec")


def _aligned(spark, sf):
    b = table(spark, sf, "benchmark").select("item_id", F.split("text", " ").alias("tokens"))
    span = H.align_span(F.col("tokens"), F.concat(F.lit('"'), F.array_join(F.slice("tokens", F.lit(2), (F.col("item_id") % 40 + 1).cast("int")), ""), F.lit('" ')))
    return b.withColumn("s", span).select("item_id", F.col("s.start").alias("start"), F.col("s.n").alias("n"))


@query("SELECT item_id, dim, round(avg(x), 6) AS mean, round(max(x), 6) AS high FROM (SELECT b.item_id, generate_subscripts(e.embedding, 1) AS dim, CAST(unnest(e.embedding) AS DOUBLE) AS x FROM (SELECT item_id, generate_subscripts(string_split(text, ' '), 1) - 1 AS pos FROM benchmark) b JOIN embeddings e ON (b.item_id * 31 + b.pos) % (SELECT count(*) FROM embeddings) = e.vec_id) t GROUP BY 1, 2")
def e11_pool_tokens(spark, sf):
    p = H.pool_tokens(_tokens(spark, sf), "item_id").withColumn("d", F.expr("size(pooled) DIV 2"))
    x = p.select("item_id", "pooled", "d", F.posexplode(F.slice("pooled", F.lit(1), F.col("d").cast("int"))).alias("i", "m"))
    return x.select("item_id", (F.col("i") + 1).cast("long").alias("dim"), F.round("m", 6).alias("mean"), F.round(F.get("pooled", (F.col("d") + F.col("i")).cast("int")), 6).alias("high"))


@query("WITH b AS (SELECT item_id, string_split(text, ' ') AS t, item_id % 40 + 1 AS k FROM benchmark), s AS (SELECT item_id, t, generate_subscripts(t, 1) AS i, array_to_string(t[2:k + 1], '') AS want FROM b), e AS (SELECT *, unnest(range(i, least(i + 60, len(t) + 1))) AS j FROM s), m AS (SELECT item_id, i, j, row_number() OVER (PARTITION BY item_id ORDER BY i, j) AS r FROM e WHERE trim(array_to_string(t[i:j], ''), chr(34) || chr(39) || chr(10) || ' ') = trim(want, chr(34) || chr(39) || chr(10) || ' ')) SELECT b.item_id, CAST(i - 1 AS INTEGER) AS start, CAST(j - i + 1 AS INTEGER) AS n FROM b LEFT JOIN m ON b.item_id = m.item_id AND r = 1")
def e10_align_span(spark, sf):
    return _aligned(spark, sf)
