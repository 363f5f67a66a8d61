"""Heads: gradient against differences, one process against Spark, the diversity term, and what is learned."""

import numpy as np
import pytest

from quillet.operators.heads import Heads, score_heads, train_heads


@pytest.mark.parametrize("beta", [0.0, 0.7])
def test_gradient(beta):
    rng = np.random.default_rng(1)
    x, y = rng.normal(0, 1, (9, 4)), rng.integers(0, 2, 9).astype(float)
    m = Heads.start(3, 4, 5, 2)
    loss, grad = m.loss(x, y, beta)
    flat = m.flat()
    for i in rng.choice(len(flat), 25, replace=False):
        step = np.zeros(len(flat))
        step[i] = 1e-6
        diff = (m.like(flat + step).loss(x, y, beta)[0] - m.like(flat - step).loss(x, y, beta)[0]) / 2e-6
        assert abs(diff - grad[i]) < 1e-6
    out = m.logits(x)[0]
    pairs = [out[i] @ out[j] / np.linalg.norm(out[i]) / np.linalg.norm(out[j]) for i in range(3) for j in range(i)]
    assert np.isclose(loss, np.mean(np.log1p(np.exp(out)) - y * out) + beta * sum(pairs) / 6)


def samples(spark, n=600):
    rng = np.random.default_rng(5)
    rows = [(i, x.tolist(), int(x[0] * x[1] > 0), i % 4 != 0) for i, x in enumerate(rng.normal(0, 1, (n, 4)))]
    return rows, spark.createDataFrame(rows, "doc_id long, features array<double>, y int, is_train boolean")


def plain(rows, beta, epochs, seed=1):
    x, y = np.array([r[1] for r in rows if r[3]]), np.array([r[2] for r in rows if r[3]], float)
    m = Heads.start(3, 4, 16, seed)
    flat, mean, spread = m.flat(), 0.0, 0.0
    for t in range(1, epochs + 1):
        g = m.like(flat).loss(x, y, beta)[1]
        mean, spread = 0.9 * mean + 0.1 * g, 0.999 * spread + 0.001 * g * g
        flat = flat - 0.05 * (mean / (1 - 0.9**t) / (np.sqrt(spread / (1 - 0.999**t)) + 1e-8) + 1e-4 * flat)
    return m.like(flat)


def test_training(spark):
    rows, d = samples(spark)
    model, accuracy = train_heads(d, hidden=16, epochs=45, rate=0.05, beta=0.1)
    again, same = train_heads(d, hidden=16, epochs=45, rate=0.05, beta=0.1)
    assert accuracy > 0.85 and same == accuracy and np.allclose(again.flat(), model.flat())
    # without held rows the last weights stay: one batch of all rows, as in one process
    few = [(*r[:3], True) for r in rows if r[3]]
    last, none = train_heads(spark.createDataFrame(few, d.schema), hidden=16, epochs=6, rate=0.05)
    want = plain(few, 1.0, 6)
    assert none == 0.0 and np.allclose(last.flat(), want.flat(), atol=1e-8)
    x = np.array([r[1] for r in rows])
    alike = lambda m: np.mean([np.corrcoef(m.logits(x)[0])[i, j] for i in range(3) for j in range(i)])
    assert alike(plain(few, 3.0, 40)) < alike(plain(few, 0.0, 40))
    scored = {r.doc_id: r for r in score_heads(model, d.unionByName(spark.createDataFrame([(-1, None, 0, True)], d.schema))).collect()}
    p = 1 / (1 + np.exp(-model.logits(x)[0]))
    assert np.allclose([scored[r[0]].heads for r in rows], p.T) and np.allclose([scored[r[0]].prob for r in rows], p.mean(axis=0))
    assert scored[-1].prob is None and scored[-1].heads is None
    with pytest.raises(ValueError):
        train_heads(d.limit(0))
