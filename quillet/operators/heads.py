"""Error classifier of several heads that are trained together, with a term that keeps them apart.

A head is one hidden layer of rectified units. The loss of a batch is the mean cross-entropy of the heads plus ``beta`` times
the mean cosine of two heads' outputs over the batch. An epoch is one Spark job: tasks sum gradients over their batches with
numpy, groups of tasks sum those, and the driver makes one step (Adam with weight decay) from a few rows of the model's size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillet.functions.shared import saved

ROWS = 1024
SUMS = 8


@dataclass(frozen=True)
class Heads:
    """Weights of all heads: w (heads, dim, hidden), b (heads, hidden), v (heads, hidden), c (heads)."""

    w: np.ndarray
    b: np.ndarray
    v: np.ndarray
    c: np.ndarray

    @staticmethod
    def start(heads: int, dim: int, hidden: int, seed: int) -> Heads:
        rng = np.random.default_rng(seed)
        return Heads(rng.normal(0, np.sqrt(2 / dim), (heads, dim, hidden)), np.zeros((heads, hidden)), rng.normal(0, np.sqrt(1 / hidden), (heads, hidden)), np.zeros(heads))

    @property
    def parts(self) -> tuple[np.ndarray, ...]:
        return self.w, self.b, self.v, self.c

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts])

    def like(self, flat: np.ndarray) -> Heads:
        ends = np.cumsum([p.size for p in self.parts])[:-1]
        return Heads(*(x.reshape(p.shape) for x, p in zip(np.split(flat, ends), self.parts, strict=True)))

    def logits(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """((heads, rows) outputs, (heads, rows, hidden) units)."""
        units = np.maximum(np.einsum("nd,kdh->knh", x, self.w, optimize=True) + self.b[:, None], 0)
        return np.einsum("knh,kh->kn", units, self.v) + self.c[:, None], units

    def loss(self, x: np.ndarray, y: np.ndarray, beta: float) -> tuple[float, np.ndarray]:
        """(loss, gradient) of one batch."""
        out, units = self.logits(x)
        k, n = out.shape
        loss = float((np.logaddexp(0, out) - y * out).mean())
        slope = (1 / (1 + np.exp(-out)) - y) / (n * k)
        if k > 1 and beta:
            size = np.maximum(np.sqrt((out * out).sum(axis=1)), 1e-8)
            unit = out / size[:, None]
            alike = unit @ unit.T
            np.fill_diagonal(alike, 0)
            share = beta / (k * (k - 1))
            loss += share * alike.sum() / 2
            slope += share * (alike_sum(unit, alike) / size[:, None])
        back = slope[:, :, None] * self.v[:, None] * (units > 0)
        grad = Heads(np.einsum("nd,knh->kdh", x, back, optimize=True), back.sum(axis=1), np.einsum("kn,knh->kh", slope, units), slope.sum(axis=1))
        return loss, grad.flat()


def alike_sum(unit: np.ndarray, alike: np.ndarray) -> np.ndarray:
    """For each head the sum over the others of (their direction less its own part along the head's)."""
    other = unit.sum(axis=0) - unit
    return other - alike.sum(axis=1)[:, None] * unit


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(pc.list_flatten(column), np.float64).reshape(len(column), -1)


def train_heads(samples: DataFrame, features: str = "features", label: str = "y", is_train: str = "is_train", heads: int = 3, hidden: int = 128, epochs: int = 40, rate: float = 0.02, decay: float = 1e-4, beta: float = 1.0, seed: int = 1, tasks: int = 64) -> tuple[Heads, float]:
    """(model, accuracy): the weights with the best accuracy of the averaged heads on the rows that are not ``is_train``, the
    last of equals. Rows without features or label are left out. The stored sample fixes its batches of ``ROWS`` rows."""
    d = samples.select(F.col(features).cast("array<double>").alias("x"), F.col(label).cast("double").alias("y"), F.col(is_train).alias("train")).where("x IS NOT NULL AND y IS NOT NULL AND train IS NOT NULL")
    d = saved(d)
    first = d.select(F.size("x")).first()
    if first is None:
        raise ValueError("no samples")
    d = d.repartition(max(1, min(tasks, -(-d.count() // ROWS))), F.xxhash64("x"))
    d = saved(d)
    model = Heads.start(heads, first[0], hidden, seed)
    spark, n_weights = samples.sparkSession, len(model.flat())
    flat, mean, spread, best = model.flat(), np.zeros(n_weights), np.zeros(n_weights), (model, -1.0)

    def total(rows: pa.Table) -> pa.Table:
        whole = sum(np.frombuffer(g, np.float64) for g in rows.column("grad").to_pylist())
        sums = [pa.array([pc.sum(rows.column(c)).as_py()]) for c in ("n", "right", "held")]
        return pa.Table.from_arrays([pa.array([whole.tobytes()], pa.binary()), *sums], ["grad", "n", "right", "held"])

    for step in range(1, epochs + 2):
        shared = spark.sparkContext.broadcast(model.like(flat))

        def gradient(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            m, grad, n, right, held = shared.value, np.zeros(n_weights), 0, 0, 0
            for whole in batches:
                for at in range(0, whole.num_rows, ROWS):
                    b = whole.slice(at, ROWS)
                    x, y, train = _matrix(b.column(0)), np.asarray(b.column(1)), np.asarray(b.column(2), bool)
                    if train.any():
                        grad += train.sum() * m.loss(x[train], y[train], beta)[1]
                        n += int(train.sum())
                    if not train.all():
                        out = m.logits(x[~train])[0].mean(axis=0)
                        right += int(((out > 0) == (y[~train] == 1)).sum())
                        held += int((~train).sum())
            yield pa.RecordBatch.from_arrays([pa.array([grad.tobytes()], pa.binary()), *[pa.array([v], pa.int64()) for v in (n, right, held)]], ["grad", "n", "right", "held"])

        own = d.mapInArrow(gradient, "grad binary, n long, right long, held long").withColumn("k", F.spark_partition_id() % SUMS)
        rows = own.groupBy("k").applyInArrow(total, "grad binary, n long, right long, held long").collect()
        shared.unpersist()
        n, right, held = (sum(r[c] for r in rows) for c in ("n", "right", "held"))
        accuracy = right / held if held else 0.0
        if accuracy >= best[1]:
            best = (model.like(flat), accuracy)
        if step > epochs or not n:
            break
        grad = sum(np.frombuffer(r["grad"], np.float64) for r in rows) / n
        mean, spread = 0.9 * mean + 0.1 * grad, 0.999 * spread + 0.001 * grad * grad
        flat = flat - rate * (mean / (1 - 0.9**step) / (np.sqrt(spread / (1 - 0.999**step)) + 1e-8) + decay * flat)
    return best


def score_heads(model: Heads, samples: DataFrame, features: str = "features") -> DataFrame:
    """Samples with ``heads``, each head's probability of an error, and ``prob``, their mean; null without features."""
    shared = samples.sparkSession.sparkContext.broadcast(model)
    base = samples.drop("heads", "prob")
    names = [*base.columns, "heads", "prob"]
    at = base.columns.index(features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            some = np.flatnonzero(np.asarray(pc.is_valid(b.column(at))))
            p = 1 / (1 + np.exp(-shared.value.logits(_matrix(b.column(at).take(pa.array(some))))[0])) if len(some) else np.zeros((len(shared.value.c), 0))
            of = np.full(b.num_rows, -1)
            of[some] = np.arange(len(some))
            take = pa.array(of, mask=of < 0)
            lists = pa.array(p.T.tolist(), pa.list_(pa.float64())).take(take)
            yield pa.RecordBatch.from_arrays([*b.columns, lists, pa.array(p.mean(axis=0)).take(take)], names)

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema)
    return base.mapInArrow(run, f"{types}, heads array<double>, prob double")
