"""Behaviours stated by the survey: null vocabularies, counting rules, stop points, cascades, votes."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillet.functions import joins
from quillet.functions.nulls import is_none_value, is_null
from quillet.functions.predicates import predicate
from quillet.operators import cascade, chunks, detection, evaluation, population, sampling


def test_vocabularies(spark):
    d = spark.createDataFrame([(v,) for v in (None, " ", "None", "n/a", "unknown", "0", "<NA>")], "v string").select(is_none_value(F.col("v")).alias("a"), is_null(F.col("v")).alias("b")).collect()
    assert [r.a for r in d] == [True, True, True, True, False, False, True]
    assert [r.b for r in d] == [True, True, True, True, True, False, False]


def test_json_forms(spark):
    raw = ["```json\n{\"a\": 1}\n```", "x ```{\"a\": 2}``` y", "so {} or {'a': None, 'b': True}.", "{\"a\": {\"b\": 1}}", "{}", "nothing", None]
    got = [r.m for r in spark.createDataFrame([(r,) for r in raw], "r string").select(population.extract_json(F.col("r")).alias("m")).collect()]
    assert got[0] == {"a": "1"} and got[1] == {"a": "2"} and got[2] == {"a": None, "b": "true"} and got[3] == {"a": '{"b":1}'}
    assert got[4:] == [None, None, None]


@pytest.mark.parametrize("n", [0, 1, 499, 500, 501, 950, 951, 2000])
def test_chunks(spark, n):
    text = "".join(chr(0x1F600 + i % 50) if i % 7 == 0 else chr(97 + i % 26) for i in range(n))
    want, start = [], 0
    while True:
        want.append(text[start : start + 500])
        if start + 500 >= len(text):
            break
        start += 450
    got = chunks.chunk_documents(spark.createDataFrame([("d", text)], "doc_id string, doc_text string")).orderBy("chunk_index").collect()
    assert [r.chunk for r in got] == want


def test_overlap_is_checked(spark):
    with pytest.raises(ValueError):
        chunks.chunk_array(F.lit("x"), 50, 50)


def test_entropy_sequence(spark):
    f = lambda *a: [x for x in ("table:users", "users.id", "users.name", "users.email") if x in a]
    steps = [[], f("table:users", "users.id"), f("table:users", "users.id", "users.name"), *[f("table:users", "users.id", "users.name", "users.email")] * 3]
    snap = spark.createDataFrame([("r", i + 1, s) for i, s in enumerate(steps)], "run_id string, seq int, features array<string>")
    e = [round(r.entropy, 6) for r in sampling.schema_entropy(snap).orderBy("seq").collect()]
    assert e == [1.0, 1.0, 0.333333, 0.25, 0.0, 0.0]
    assert sampling.stop_point_entropy(snap, m=2, n_min=3, probabilistic=False).first().stop_n == 6


def test_good_turing_naive(spark):
    import random

    rng = random.Random(3)
    feats = [[f"f{int(rng.paretovariate(0.7)) % 300}" for _ in range(3)] for _ in range(200)]
    snap = spark.createDataFrame([("r", i, sorted(set(f))) for i, f in enumerate(feats)], "run_id string, seq int, features array<string>")
    seen, want = {}, []
    for f in feats:
        for x in set(f):
            seen[x] = seen.get(x, 0) + 1
        want.append(sum(v == 1 for v in seen.values()))
    assert [r.n1 for r in sampling.good_turing(snap).orderBy("seq").collect()] == want


def test_attribute_outcomes(spark):
    rows = [("1", "t", {"a": "x y"}, "t", {"A": "X"}), ("2", "t", {"a": "none"}, "t", {"A": None}), ("3", "t", {"a": "v"}, "t", {}), ("4", "t", {"a": ""}, "t", {"A": "z"}), ("5", "t", {}, "t", {"A": "z"}), ("6", "t", {"a": "x"}, "t", {"A": "x y"}), ("7", "u", {"a": "1", "b": "2"}, "t", {"A": "z"}), ("8", "u", {"a": "1"}, None, {}), ("9", None, {}, None, {})]
    pairs = spark.createDataFrame(rows, "doc_id string, pred_table string, pred map<string,string>, gt_table string, gt map<string,string>")
    names = spark.createDataFrame([("t", "a", ["A"])], "gt_table string, pred_attr string, gt_attrs array<string>")
    checked = evaluation.check_tables(pairs, spark.createDataFrame([("t", "t")], "pred_table string, mapped string"))
    got = {r.doc_id: r.outcome for r in evaluation.compare_attributes(checked, names).collect()}
    assert got == {"1": "TP", "2": "TP", "3": "FP", "4": "FN", "5": "FN", "6": "FP"}
    d = {r.doc_id: r for r in evaluation.document_counts(checked, names).collect()}
    assert (d["7"].fp, d["7"].fn, d["7"].correct) == (1, 1, False)
    assert (d["8"].fp, d["8"].tn, d["8"].correct, d["8"].table_ok) == (1, 0, True, False)
    assert (d["9"].tn, d["9"].correct) == (1, True)


def test_predicates(spark):
    d = spark.createDataFrame([("3", "2", "Fall 1"), ("x", "2", None)], "a string, b string, c string")
    got = [tuple(r) for r in d.select(predicate("a > b", d.columns), predicate("a >= 3"), predicate("c contains 'Fall'"), predicate("a == 'x'")).collect()]
    assert got == [(True, True, True, False), (False, False, False, True)]


def test_black_box_cascade(spark):
    calls = spark.sparkContext.accumulator(0)

    def costly(p):
        calls.add(len(p))
        return p["v"].astype(str)

    def fails(p):
        raise RuntimeError("no answer")

    d = spark.createDataFrame([(i, i % 4) for i in range(40)], "doc_id int, v int").coalesce(1)
    stages = [("first", lambda p: p["v"].astype(str), lambda s: s == "0"), ("broken", fails, lambda s: s == "0"), ("second", costly, lambda s: pd.Series([True] * len(s), index=s.index))]
    got = cascade.lazy_extract_with(d, stages).collect()
    assert calls.value == 10
    assert {(r.num_extracted, r.stopped_at) for r in got} == {(1, "first"), (3, None)}


def test_votes_and_auc(spark):
    s = spark.createDataFrame([(1, 0, 0, 0.9), (1, 0, 1, 0.1), (1, 1, 2, 0.2)], "doc_id int, ens int, layer int, score double")
    assert {m: detection.vote(s, m).first().pred for m in ("half", "soft", "hard")} == {"half": 1, "soft": 0, "hard": 1}
    a = spark.createDataFrame([(0, 0.1), (0, 0.4), (1, 0.4), (1, 0.8)], "y int, score double")
    assert detection.roc_auc(a).first().auc == pytest.approx(0.875)


def test_oversample(spark):
    d = spark.createDataFrame([(i, int(i < 3)) for i in range(10)], "doc_id int, y int")
    got = detection.oversample(d).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in got} == {0: 3, 1: 2, 2: 2, **{i: 1 for i in range(3, 10)}}


def test_join_of_few_keys_is_spread(spark, monkeypatch):
    """A hot key is dealt to many tasks, with a broadcast side and without; the result is that of the plain join."""
    many = spark.range(3000).selectExpr("id", "cast(if(id % 10 = 0, id % 7, 1) AS int) AS k").union(spark.createDataFrame([(-1, None)], "id long, k int"))
    few = spark.range(200).selectExpr("id AS s", "cast(if(id % 4 = 0, id % 9, 1) AS int) AS k2").union(spark.createDataFrame([(-1, None)], "s long, k2 int"))
    want = sorted((r.id, r.s) for r in many.join(few, F.col("k") == F.col("k2")).collect())
    for small in (True, False):
        if not small:
            monkeypatch.setattr(joins, "small_side", lambda df: df)
        out = joins.spread_join(many, "k", "id", few, "k2", pairs=20_000)
        assert out.columns == ["id", "k", "s", "k2"] and sorted((r.id, r.s) for r in out.collect()) == want
        sizes = [n for n in out.select("id").mapInPandas(lambda batches: iter([pd.DataFrame({"n": [sum(map(len, batches))]})]), "n long").toPandas()["n"] if n]
        assert len(sizes) > 8 and max(sizes) < len(want) / 4
