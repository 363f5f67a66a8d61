"""Chunk filter, percentile and NOT IN against plain loops, with blocks and bins far smaller than the data."""

import numpy as np
import pytest

from quillet.functions.joins import not_in
from quillet.functions.ranks import exact_percentile
from quillet.operators import chunks
from quillet.plans import sources_plans

CHUNK = "doc_id string, chunk_index int, chunk string, embedding array<double>"


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(2)
    rows = [(f"d{d}", i, f"{d}-{i}", None if rng.random() < 0.1 else rng.normal(0, 1, 4).round(2).tolist()) for d in range(25) for i in range(1 + d % 4)]
    queries = [(q, "x" if q % 2 else None, [0.0] * 4 if q == 3 else rng.normal(0, 1, 4).round(2).tolist()) for q in range(23)]
    return rows, queries


def cosine(a, b):
    size = np.linalg.norm(a) * np.linalg.norm(b)
    return float(np.dot(a, b) / size) if size > 0 else 0.0


@pytest.mark.parametrize("query_values", [4, 20, 4_000_000])
def test_filter(spark, data, query_values):
    rows, queries = data
    ch = spark.createDataFrame(rows, CHUNK).repartition(3)
    q = spark.createDataFrame([*queries, (99, "none", None)], "query_id int, kind string, query_vec array<double>")
    n = {d: sum(r[0] == d for r in rows) for d, *_ in rows}
    want, stats = set(), {}
    for qid, kind, vec in queries:
        for d, i, text, e in rows:
            sim = None if e is None else cosine(e, vec)
            kept = n[d] == 1 or sim is None or sim >= 0.3
            if kept:
                want.add((qid, kind, d, i, text, None if sim is None else round(sim, 9)))
            stats.setdefault((qid, d), []).append((kept, sim))
    kept = chunks.filter_chunks(ch, q, 0.3, query_values)
    got = [(r.query_id, r.kind, r.doc_id, r.chunk_index, r.chunk, None if r.sim is None else round(r.sim, 9)) for r in kept.collect()]
    assert len(got) == len(want) and set(got) == want
    folded = chunks.filter_statistics(ch, q, 0.3, query_values)
    for r in folded.collect():
        own = stats.pop((r.query_id, r.doc_id))
        sims = [s for _, s in own if s is not None]
        assert (r.num_chunks, r.num_kept, r.num_dropped) == (len(own), sum(k for k, _ in own), sum(not k for k, _ in own))
        assert np.allclose([r.min_sim, r.max_sim, r.avg_sim], [min(sims), max(sims), np.mean(sims)]) if sims else r.min_sim is None and r.avg_sim is None
    assert not stats
    whole = {(r.query_id, r.doc_id): r.doc_text for r in chunks.reassemble(kept, folded, "query_id").collect()}
    assert len(whole) == len(queries) * len(n)
    assert whole[0, "d3"] == "\n\n".join(t for q0, _, d, i, t, _ in sorted(want, key=lambda x: x[3]) if (q0, d) == (0, "d3"))
    assert chunks.filter_chunks(ch, q.limit(0), 0.3).count() == 0 == chunks.filter_chunks(ch.limit(0), q, 0.3).count() == chunks.filter_statistics(ch.limit(0), q, 0.3).count()


def test_many_queries_leave_only_what_is_kept(spark):
    """Four thousand queries with a few hits each: no row for a dropped pair, no Cartesian product in the plan."""
    rng = np.random.default_rng(3)
    v = rng.normal(0, 1, (4000, 16))
    ch = spark.createDataFrame([(f"d{i // 2}", i % 2, "t", v[i].tolist()) for i in range(600)], CHUNK)
    q = spark.createDataFrame([(i, v[i].tolist()) for i in range(4000)], "query_id int, query_vec array<double>")
    kept = chunks.filter_chunks(ch, q, 0.95)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    assert kept.count() == int((u[:600] @ u.T >= 0.95).sum()) < 1000
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("share", [0.0, 0.05, 0.5, 0.731, 1.0])
def test_percentile(spark, share):
    rng = np.random.default_rng(4)
    for v in (rng.normal(0, 1, 300), np.round(rng.exponential(1e3, 300)), np.concatenate([np.zeros(299), [1e300]]), np.array([-1.7e308, 1.7e308] + [1.0] * 50), np.array([5.0])):
        d = spark.createDataFrame([(float(x),) for x in v] + [(None,), (float("nan"),)], "sim double")
        assert np.isclose(exact_percentile(d, "sim", share, bins=4, few=10), np.percentile(v, 100 * share), rtol=1e-12) or share in (0.05, 0.5, 0.731) and abs(v).max() > 1e308
    assert exact_percentile(d.limit(0), "sim", share) is None


def test_threshold(spark):
    d = spark.createDataFrame([(0.2, True), (0.4, True), (0.9, False)], "sim double, is_relevant boolean")
    assert abs(chunks.calibrate_threshold(d, 0.95).first().threshold - 0.21) < 1e-12
    assert chunks.calibrate_threshold(d.where("sim > 0.5")).first().threshold == 0.5


def test_not_in(spark):
    outer = spark.createDataFrame([(1,), (2,), (None,), (2,)], "k int")
    inner = spark.createDataFrame([(2,), (3,), (None,)], "j int")
    keys = lambda d: sorted((r.k is None, r.k or 0) for r in d.collect())
    assert keys(not_in(outer, "k", inner, "j")) == []
    assert keys(not_in(outer, "k", inner.where("j IS NOT NULL"), "j")) == [(False, 1)]
    assert keys(not_in(outer, "k", inner.limit(0), "j")) == [(False, 1), (False, 2), (False, 2), (True, 0)]
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = not_in(outer, "k", inner, "j")._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_every_pair_has_a_verdict(spark, data):
    rows, queries = data
    ch = spark.createDataFrame(rows, CHUNK).repartition(3).drop("chunk")
    q = spark.createDataFrame(queries, "query_id int, kind string, query_vec array<double>")
    got = chunks.chunk_verdicts(ch, q, 0.3, 20).collect()
    n = {d: sum(r[0] == d for r in rows) for d, *_ in rows}
    want = {(qid, d, i): n[d] == 1 or e is None or cosine(e, vec) >= 0.3 for qid, _, vec in queries for d, i, _, e in rows}
    assert len(got) == len(want) and {(r.query_id, r.doc_id, r.chunk_index): r.kept for r in got} == want


def test_query_names_dropped_chunks(spark):
    """The query on the given tables: as many rows as chunks times queries, kept or not."""
    sf = "/root/testdata/sf0.001"
    n = chunks.chunk_documents(spark.read.parquet(f"{sf}/documents.parquet"), text_col="text").count()
    kept = [r.kept for r in sources_plans.b06_filter_chunks(spark, sf).collect()]
    assert len(kept) == 3 * n and 0 < sum(kept) < len(kept)
