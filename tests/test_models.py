"""Operators that SQL cannot express: brute force, held-out accuracy and properties; long responses; plans."""

import math

import numpy as np
from pyspark.ml.feature import HashingTF
from pyspark.sql import functions as F

from quillet import registry
from quillet.operators import chunks, detection, population, schemas
from quillet.plans.bindings import populated

SF = "/root/testdata/sf0.001"


def test_embed_equals_hashed_counts(spark):
    texts = ["A b a", "", "c  d", "b a A"]
    got = {r.text: r.embedding for r in chunks.embed(spark.createDataFrame([(t,) for t in texts], "text string"), "text", dim=64).collect()}
    place = HashingTF(numFeatures=64)
    for t in texts:
        want = np.zeros(64)
        for w in t.lower().split(" "):
            want[place.indexOf(w)] += 1
        np.testing.assert_allclose(got[t], want / (np.linalg.norm(want) or 1))


def test_thompson_draws_follow_their_posterior(spark):
    from quillet.operators.cascade import thompson_draw

    post = spark.createDataFrame([("a", 80.0, 20.0), ("b", 1.5, 1.5)], "attr string, alpha double, beta double")
    draws = [{r.attr: r.draw for r in thompson_draw(post, s).collect()} for s in range(12)]
    again = {r.attr: r.draw for r in thompson_draw(post, 3).collect()}
    assert again == draws[3] and abs(np.mean([d["a"] for d in draws]) - 0.8) < 0.05 and np.std([d["b"] for d in draws]) > 0.1


def test_clusters_are_the_nearest_centres(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(0 if i % 2 else 5, 0.3, 4)]) for i in range(60)]
    got = {r.vec_id: r.cluster for r in schemas.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 2).collect()}
    v = np.array([r[1] for r in rows])
    own = np.array([got[i] for i in range(60)])
    centres = np.array([v[own == c].mean(axis=0) for c in (0, 1)])
    assert (((v[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1) == own).all() and len(set(own[::2])) == len(set(own[1::2])) == 1


def test_classifier_is_chosen_on_held_out_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(0, 1, 6)]) for i in range(300)]
    d = spark.createDataFrame([(i, x, int(x[0] * x[1] > 0)) for i, x in rows], "doc_id long, features array<double>, y int")  # no line parts these classes
    train, valid = d.where("doc_id < 220"), d.where("doc_id >= 220")
    model, accuracy = detection.best_classifier(train, valid, candidates=((0, 1), (24, 1), (24, 2)))
    assert accuracy > 0.7 and model.__class__.__name__.startswith("Multilayer")
    scored = detection.score_samples(model, valid).collect()
    assert math.isclose(np.mean([(r.prob >= 0.5) == (r.y == 1) for r in scored]), accuracy)


def test_long_responses(spark):
    long = "y" * 1_000_000
    texts = ['x {"res": "' + long + '"} z', "no { close " * 50_000, '```JSON\n{"res": "' + long + '"}\n```', '```\n{"res": "' + "`} " * 300_000 + '"}\n```', "{'res': None, 'b': {'c': True}}", "{" * 500_000]
    d = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", population.extract_json(F.col("t")).alias("m"))
    got = [r.m for r in d.orderBy("i").collect()]
    assert got[0] == got[2] == {"res": long} and got[1] is None and got[5] is None and len(got[3]["res"]) == 900_000
    assert got[4] == {"res": None, "b": '{"c":true}'} or got[4]["res"] is None


def test_extraction_runs_once_and_scans_are_pruned(spark):
    for name in ("e02_resolve_tables", "e05_assemble_rows"):
        plan = registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("extracted_object(") == 1 == plan.count("+- ArrowEvalPython")
    scan = populated(spark, SF, "orders").select("o_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "o_comment" not in scan and "o_totalprice" not in scan.split("ReadSchema")[1]


def test_one_pass_equals_two(spark):
    t = "doc_id string, query_id string, target string, attempt int, raw_text string"
    rows = [("1", "q", "__table__", 0, '{"res": "zz"}'), ("1", "q", "__table__", 1, '{"res": "a"}'), ("1", "q", "x", 0, "?"), ("1", "q", "x", 3, '{"x": " N/A "}'), ("1", "q", "x", 5, '{"x": "late"}'), ("1", "q", "y", 40, '{"y": "too late"}'),
            ("2", "q", "__table__", 0, '{"res": "none"}'), ("2", "q", "x", 0, '{"x": 1}'), ("3", "q", "x", 0, '{"x": 1}'), ("4", "q", "__table__", 2, '{"res": "a"}'), ("4", "q", "y", 0, '{"y": "v"}')]
    r = spark.createDataFrame(rows, t)
    schema = spark.createDataFrame([("q", "a", "x"), ("q", "a", "y")], "query_id string, table_name string, attr string")
    a = population.resolve_tables(r, ["a"])
    two = population.assemble_rows(a, population.resolve_attributes(r, a, schema))
    one = population.populate(r, ["a"], schema)
    plain = lambda d: sorted((x.doc_id, x.res or "", sorted(x.data.items()), x.overlong) for x in d.collect())
    assert plain(one) == plain(two) == [("1", "a", [("x", "None"), ("y", "None")], False), ("2", "", [], False), ("4", "a", [("x", "None"), ("y", "v")], False)]


def test_draws_of_batches_follow_what_came_before(spark):
    from quillet.operators.cascade import draw_by_batch, posterior_by_batch

    rows = [(s, a, s % 10 < k) for a, k in (("a", 9), ("b", 2)) for s in range(0, 400) if a == "a" or s < 100]
    d = spark.createDataFrame([*rows, (5, None, True)], "seq long, attr string, passed boolean")
    prior = spark.createDataFrame([("c", 0.9)], "attr string, mean double")
    post = posterior_by_batch(d, 50, prior)
    got = {(r.batch, r.attr): (r.alpha, r.beta) for r in post.collect()}
    assert len(got) == 3 * 8 and got[0, "a"] == (1.5, 1.5) and got[2, "b"] == got[7, "b"] == (1.5 + 20, 1.5 + 80) and got[7, "a"] == (1.5 + 315, 1.5 + 35)
    assert math.isclose(got[3, "c"][0], 2.7) and posterior_by_batch(d.limit(0), 50).count() == 0
    draws = [{(r.batch, r.attr): r.draw for r in draw_by_batch(post, s).collect()} for s in range(8)]
    assert draws[0] == {(r.batch, r.attr): r.draw for r in draw_by_batch(post.repartition(3), 0).collect()}
    assert abs(np.mean([x[7, "a"] for x in draws]) - 0.9) < 0.05 and abs(np.mean([x[7, "b"] for x in draws]) - 0.2) < 0.05 and np.std([x[0, "a"] for x in draws]) > 0.1


def test_training_rows_are_dealt_to_many_parts(spark):
    d = spark.range(5000).select(F.array((F.col("id") % 7).cast("double"), F.col("id").cast("double")).alias("features"), (F.col("id") % 2).cast("int").alias("y"))
    few = d.repartition("y")  # adaptive execution leaves it in one part
    assert few.rdd.getNumPartitions() == 1 < detection.dealt(few, "features", "y").rdd.getNumPartitions()
    place = lambda x: [list(map(tuple, p)) for p in detection.dealt(x, "features", "y").rdd.glom().collect()]
    assert place(few) == place(d.orderBy(F.desc("id"))) and sum(map(len, place(d))) == 5000
    models = [detection.train_classifier(x, hidden=4) for x in (few, d)]
    assert models[0].weights.toArray().tolist() == models[1].weights.toArray().tolist()
