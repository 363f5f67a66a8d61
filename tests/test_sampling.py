"""Runs spread over ranges against windows and plain loops; picks against plain loops, with numbers and text as ids."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillet.functions.segments import Runs
from quillet.operators import detection, sampling


@pytest.fixture(scope="module")
def runs():
    rng = random.Random(4)
    rows = [(r, s, rng.choice([0, 1, 1, 1, 1, None]), rng.randint(-3, 3)) for r, n in (("a", 1), ("b", 200), ("c", 37), ("d", 5)) for s in rng.sample(range(1000), n)]
    return sorted(rows, key=lambda x: x[:2])


@pytest.mark.parametrize("range_rows", [5, 31, 100_000])
def test_runs_against_loops(spark, runs, range_rows):
    d = spark.createDataFrame(runs, "run_id string, seq long, ok int, v int").repartition(3)
    got = Runs.of(d, range_rows=range_rows).previous("v", "before").running(total=F.col("v"), n=F.lit(1)).streak(F.col("ok") == 1, "streak").result()
    got = {(r.run_id, r.seq): (r.before, r.total, r.n, r.streak) for r in got.collect()}
    want, state = {}, {}
    for run, seq, ok, v in runs:
        before, total, n, streak = state.get(run, (None, 0, 0, 0))
        state[run] = (v, total + v, n + 1, streak + 1 if ok == 1 else 0)
        want[run, seq] = (before, *state[run][1:])
    assert got == want


def test_streak_over_many_unbroken_ranges(spark):
    d = spark.range(400).select(F.lit(1).alias("run_id"), F.col("id").alias("seq"), (F.col("id") != 60).alias("ok"))
    got = {r.seq: r.streak for r in Runs.of(d, range_rows=11).streak(F.col("ok"), "streak").result().collect()}
    assert got == {i: i + 1 if i < 60 else i - 60 for i in range(400)}


def test_known_sequence_stops_at_the_sixth_document(spark):
    grown = [["table:a", "a.x"], ["table:b", "b.x"], ["table:b", "b.x", "b.y"], ["table:b", "b.x", "b.y", "b.z"], ["table:b", "b.x", "b.y", "b.z"], ["table:b", "b.x", "b.y", "b.z"]]
    d = spark.createDataFrame([(1, i, x) for i, x in enumerate(grown)], "run_id int, seq int, features array<string>")
    entropy = [round(r.entropy, 4) for r in sampling.schema_entropy(d).orderBy("seq").collect()]
    assert entropy == [1.0, 1.0, 0.3333, 0.25, 0.0, 0.0]
    assert sampling.stop_point_entropy(d, m=2, n_min=3, probabilistic=False).first().stop_n == 6


def test_one_long_run(spark):
    """A million steps of one run: no range holds more than a small share, and every statistic is that of a loop."""
    n = 1_000_000
    step = F.when(F.col("id") < 40, F.col("id")).otherwise(F.lit(40) + F.floor(F.col("id") / 250_000))
    d = spark.range(n).select(F.lit("r").alias("run_id"), F.col("id").alias("seq"), F.array(F.lit("table:t"), F.concat(F.lit("t."), step)).alias("features"))
    runs = Runs.of(d.select("run_id", "seq"))
    sizes = [r["count"] for r in runs.rows.groupBy("_p").count().collect()]
    assert len(sizes) >= 12 and max(sizes) <= 2 * n / len(sizes)
    got = sampling.stop_point_entropy(d).first()
    assert (got.n, got.stop_n) == (n, 72)  # 0.95^n * 2 <= 0.05 from step 72, when the streak is longer than eight
    g = sampling.good_turing(d).where("seq IN (39, 40, 41, 999999)").orderBy("seq").collect()
    assert [(r.n, r.n1) for r in g] == [(40, 40), (41, 41), (42, 40), (n, 40)]


def plain_maxmin(rows, chosen, k):
    v = dict(rows)
    points, left, out = [v[c] for c in chosen], {i: x for i, x in rows if i not in chosen}, []
    while len(out) < k and left:
        dist = {i: min((float(np.sqrt(((x - p) ** 2).sum())) for p in points), default=np.inf) for i, x in left.items()}
        best = min(left, key=lambda i: (-dist[i], i))
        out.append((best, dist[best]))
        points.append(left.pop(best))
    return out


@pytest.mark.parametrize("text", [False, True])
@pytest.mark.parametrize("held", [160, 4_000_000])
def test_picks(spark, text, held):
    rng = np.random.default_rng(7)
    name = (lambda i: f"doc{i}") if text else (lambda i: i)
    rows = [(name(i), np.round(rng.normal(0, 1, 8), 1)) for i in range(300)]
    rows += [(name(300 + i), rows[i][1]) for i in range(30)]
    d = spark.createDataFrame([(i, x.tolist()) for i, x in rows] + [(name(999), None)], f"vec_id {'string' if text else 'long'}, embedding array<double>")
    got = [(r.id, r.min_dist) for r in sampling.select_maxmin(d, [name(3)], 50, held_values=held).orderBy("pick").collect()]
    want = plain_maxmin(rows, [name(3)], 50)
    assert [i for i, _ in got] == [i for i, _ in want] and np.allclose([x for _, x in got], [x for _, x in want])
    assert [r.id for r in sampling.select_maxmin(d, [], 2).collect()] == [i for i, _ in plain_maxmin(rows, [], 2)]
    left, chosen = dict(rows), []
    for _ in range(12):
        m = np.mean(chosen or list(left.values()), axis=0)
        best = min(left, key=lambda i: (-float(np.sqrt(((left[i] - m) ** 2).sum())), i))
        chosen.append(left.pop(best))
        want = best
    got = [r.id for r in sampling.diversity_order(d, 12, held_values=held).orderBy("pick").collect()]
    assert got[-1] == want and len(set(got)) == 12
    far = sampling.farthest_from_mean(d.where(F.col("embedding").isNotNull())).first()
    assert far.id == got[0] and sampling.select_maxmin(d.limit(0), [], 3).count() == 0 == sampling.diversity_order(d.limit(0), 3).count()


def test_fifty_picks_take_few_passes(spark, monkeypatch):
    rng, passes = np.random.default_rng(8), []
    d = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(0, 1, (3000, 4)))], "vec_id long, embedding array<double>")
    real = sampling._farthest
    monkeypatch.setattr(sampling, "_farthest", lambda *a: passes.append(1) or real(*a))
    sampling.select_maxmin(d, [0], 50, held_values=4000)
    assert len(passes) <= 8
    passes.clear()
    sampling.diversity_order(d, 50)
    assert len(passes) == 1


def test_few_picks_bring_few_rows(spark, monkeypatch):
    """Rows that reach the driver don't grow with the table."""
    brought, real = [], sampling._farthest
    monkeypatch.setattr(sampling, "_farthest", lambda *a: brought.append(len((out := real(*a))[0])) or out)
    d = spark.range(12_000).selectExpr("id AS vec_id", "array(cast(id % 97 AS double), cast(id % 89 AS double)) AS embedding")
    assert [r.pick for r in sampling.diversity_order(d, 3).orderBy("pick").collect()] == [1, 2, 3]
    assert [r.pick for r in sampling.select_maxmin(d, [0], 2).orderBy("pick").collect()] == [1, 2]
    assert max(brought) <= sampling.HELD_ROWS + 3 * sampling.HELD_PER_PICK


def test_vectors_are_summed_whole(spark):
    d = spark.createDataFrame([("a", 0, [1.0, 5.0]), ("a", 1, [3.0, -2.0]), ("b", 0, [0.0, 0.0])], "doc_id string, pos int, vec array<double>")
    pooled = detection.pool_tokens(d, "doc_id")
    assert {r.doc_id: r.pooled for r in pooled.collect()} == {"a": [2.0, 1.5, 3.0, 5.0], "b": [0.0] * 4}
    for x in (pooled, sampling.mean_vector(d, "vec")):
        assert "posexplode" not in x._jdf.queryExecution().executedPlan().toString().lower()
