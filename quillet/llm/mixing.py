"""Mixing sources to target weights (operator 2) by iterative proportional fitting.

Every document belongs to a cell (source, language, topic) and brings its words as tokens. The token weights of the
cells are raked until their sums by source, by language and by topic meet the targets; then each document is kept
with probability min(1, scale * weight of its cell), where the scale makes the expected tokens meet the budget. The
draw is a hash of the document id, so the same documents are kept in every run. Raking ends when every marginal is within
``TOLERANCE`` of its target, or after ``ROUNDS`` rounds, for any number of cells; ``converged`` says which of both it was
(targets that contradict each other, such as a language that only one source has, have no exact fit).

Topics are the nearest of ``n_topics`` centres of hashed word vectors (words of five bytes or more), found by k-means
over all documents. Default targets are the present token shares to the power ``temper``.

Scale: the documents' vectors (256 bytes each) are stored once and read in each step of k-means, in which a task sends its
sums; sums are of whole numbers, so that centres don't depend on how rows are dealt. One aggregation by cell, pre-aggregated in each task, so that one source with most rows is no hot key. Up to
``local_cells`` cells (their number is counted first) are raked in memory and broadcast; more are raked by the same
rounds as Spark jobs over the table of cells and joined. Texts are not shuffled.

Defined cases: a null text has no tokens and topic -1, as has a text without long words; null source or language is a
cell of its own; a document in a cell without tokens has weight 0 but is kept with probability 1, as it costs
nothing; a target for a value that does not occur is left out and the rest is scaled to one; rows that repeat an id
are drawn alike; columns named as a result column are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import saved, small_batches, without
from .text import Words, slices

DIM = 64
X_UNIT, C_UNIT = float(1 << 28), float(1 << 22)  # products of both stay below 2^53
RESULT = ["topic", "n_tokens", "weight", "probability", "kept", "converged"]
ROUNDS, TOLERANCE = 200, 1e-9


def vectors(w: Words) -> np.ndarray:
    """Unit vectors of signed hashed counts of the longer words of each text; zero if there are none."""
    use = np.flatnonzero(w.end - w.start >= 5)
    h = w.hash[use]
    cell = w.doc[use] * DIM + (h % np.uint64(DIM)).astype(np.int64)
    sign = ((h >> np.uint64(40)) & np.uint64(1)).astype(np.float64) * 2 - 1
    x = np.bincount(cell, weights=sign, minlength=w.n_rows * DIM).reshape(w.n_rows, DIM)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def units(x: np.ndarray) -> np.ndarray:
    """Vectors as whole numbers: sums are then the same in any order, and products with centres are exact."""
    return np.rint(x * X_UNIT)


def topics(q: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Nearest centre of each row of ``units``, the first of equals; -1 for a zero vector."""
    return np.where(np.abs(q).sum(axis=1) > 0, (q @ centres.T).argmax(axis=1), -1).astype(np.int32)


def farthest(q: np.ndarray, centres: np.ndarray) -> tuple[float, list[int]]:
    """(similarity, vector) of the row least similar to its nearest centre, of equals the smallest vector."""
    near = (q @ centres.T).max(axis=1)
    return float(near.min()), min(q[near == near.min()].astype(np.int64).tolist())


def sums(q: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Sum of the rows nearest to each centre."""
    near = (q @ centres.T).argmax(axis=1)
    return np.stack([q[near == c].astype(np.int64).sum(axis=0) for c in range(len(centres))])


def _directions(total: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Unit vectors of sums in whole numbers; a centre without vectors stays."""
    x = total.astype(np.float64)
    size = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.where(size > 0, np.rint(x / np.maximum(size, 1e-12) * C_UNIT), before)


def fitted_centres(far: Callable, total: Callable, k: int, rounds: int = 15) -> np.ndarray:
    """Centres of k-means over all vectors, which ``far`` and ``total`` read (``farthest`` and ``sums`` of all rows). The first
    centre is the direction of all together, each next the vector farthest from those chosen (fewer, if all are chosen)."""
    centres = _directions(total(np.zeros((1, DIM))), np.zeros((1, DIM)))
    while len(centres) < k:
        similarity, x = far(centres)
        if similarity >= (1 - 1e-5) * X_UNIT * C_UNIT:
            break
        centres = np.concatenate([centres, _directions(np.array([x]), np.zeros((1, DIM)))])
    for _ in range(rounds):
        again = _directions(total(centres), centres)
        if (again == centres).all():
            break
        centres = again
    return centres


def k_means(x: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """The same centres from vectors in memory."""
    q = units(x)
    return fitted_centres(lambda c: farthest(q, c), lambda c: sums(q, c), k, rounds)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int32).reshape(-1, DIM).astype(np.float64)


def k_means_spark(vecs: DataFrame, k: int, rounds: int = 15) -> np.ndarray:
    """The same centres from a table of vectors (``x``, binary), a pass for each step; tasks send a row each."""

    def far(centres: np.ndarray) -> tuple[float, list[int]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = [farthest(_matrix(b.column(0)), centres) for b in batches if b.num_rows]
            if found:
                best = min(found)
                yield pa.RecordBatch.from_arrays([pa.array([best[0]]), pa.array([best[1]], pa.list_(pa.int64()))], ["s", "x"])

        return min((r["s"], list(r["x"])) for r in vecs.mapInArrow(run, "s double, x array<long>").collect())

    def total(centres: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(centres.shape, np.int64)
            for b in batches:
                if b.num_rows:
                    out += sums(_matrix(b.column(0)), centres)
            yield pa.RecordBatch.from_arrays([pa.array([out.ravel().tolist()], pa.list_(pa.int64()))], ["x"])

        return sum((np.array(r["x"], np.int64) for r in vecs.mapInArrow(run, "x array<long>").collect()), np.zeros(centres.size, np.int64)).reshape(centres.shape)

    return fitted_centres(far, total, k, rounds)


def rake_local(codes: np.ndarray, mass: np.ndarray, targets: list[np.ndarray], rounds: int = ROUNDS, tol: float = TOLERANCE) -> tuple[np.ndarray, bool]:
    """Fitted mass of each cell, and whether it converged. ``codes``: (cells, dims) value numbers; ``targets``: shares by value number."""
    fit, worst = mass / max(mass.sum(), 1e-300), 0.0
    for _ in range(rounds):
        worst = 0.0
        for d, want in enumerate(targets):
            have = np.bincount(codes[:, d], weights=fit, minlength=len(want))
            worst = max(worst, float(np.abs(have - want)[have > 0].max(initial=0)))
            fit = fit * np.where(have > 0, want / np.where(have > 0, have, 1), 1)[codes[:, d]]
        if worst < tol:
            break
    return fit, worst < tol


def scale_local(tokens: np.ndarray, weight: np.ndarray, budget: float) -> float:
    """Scale s with sum of tokens * min(1, s * weight) = budget; cells that reach 1 leave the rest a larger share."""
    s, full = 0.0, np.zeros(len(tokens), bool)
    for _ in range(len(tokens) + 1):
        rest = float((tokens * weight)[~full].sum())
        if rest <= 0:
            break
        s = max(0.0, budget - float(tokens[full].sum())) / rest
        now = weight * s >= 1
        if (now == full).all() or (now | full).sum() == full.sum():
            break
        full |= now
    return s


def rake_spark(cells: DataFrame, dims: list[str], targets: list[DataFrame], total: float, budget: float, rounds: int = ROUNDS, tol: float = TOLERANCE) -> tuple[DataFrame, float, bool]:
    """The same fit as Spark jobs: (cells with ``weight``, scale, converged). ``targets``: (value, want) tables."""
    fit = saved(cells.withColumn("fit", F.col("tokens") / F.lit(total)))
    for _ in range(rounds):
        gaps = []
        for dim, want in zip(dims, targets, strict=True):
            have = fit.groupBy(F.col(dim).alias("v")).agg(F.sum("fit").alias("have"))
            step = saved(have.join(want.select(F.col("value"), "want"), F.col("v").eqNullSafe(F.col("value"))).select("v", "have", "want", F.when(F.col("have") > 0, F.col("want") / F.col("have")).otherwise(1.0).alias("f")))
            gaps.append(step.where("have > 0").agg(F.max(F.abs(F.col("have") - F.col("want")))).first()[0] or 0.0)
            fit = fit.join(step.select("v", "f"), F.col(dim).eqNullSafe(F.col("v"))).withColumn("fit", F.col("fit") * F.col("f")).drop("v", "f")
        fit = saved(fit)
        if max(gaps) < tol:
            break
    weighted = saved(fit.withColumn("weight", F.when(F.col("tokens") > 0, F.col("fit") * total / F.col("tokens")).otherwise(0.0)))
    s = 0.0
    for _ in range(50):
        full = F.col("weight") * F.lit(s) >= 1
        r = weighted.agg(F.sum(F.when(full, F.col("tokens")).otherwise(0)).alias("full"), F.sum(F.when(~full, F.col("tokens") * F.col("weight")).otherwise(0.0)).alias("rest")).first()
        new = max(0.0, budget - float(r["full"] or 0)) / r["rest"] if r["rest"] else s
        if abs(new - s) <= 1e-12 * max(1.0, s):
            break
        s = new
    return weighted, s, max(gaps) < tol


def mix_sources(docs: DataFrame, targets: dict[str, dict] | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", keep_tokens: float = 0.6, temper: float = 0.5, n_topics: int = 8, seed: int = 1, local_cells: int = 200_000) -> DataFrame:
    """Documents with ``topic``, ``n_tokens``, ``weight`` (of the cell), ``probability``, ``kept`` and ``converged``.

    ``targets``: shares by value for "source", "lang" and "topic"; ``keep_tokens``: budget as a share of all tokens.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    base = without(docs, RESULT)
    ident, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    names = base.columns
    slim = base.select(F.col(f"`{source_col}`").cast("string").alias("source"), F.col(f"`{lang_col}`").cast("string").alias("lang"), text.alias("text"))

    def vector_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text"):
                w = Words(b.column("text"))
                q = units(vectors(w)).astype(np.int32)
                x = pa.array([r.tobytes() if r.any() else None for r in q], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("source"), b.column("lang"), pa.array(w.counts().astype(np.int64)), x], ["source", "lang", "n_tokens", "x"])

    seen = saved(slim.mapInArrow(vector_rows, "source string, lang string, n_tokens long, x binary"))
    some = seen.where("x is not null").select("x")
    centres = k_means_spark(some, n_topics) if some.take(1) else np.zeros((n_topics, DIM))

    def placed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            topic = topics(_matrix(b.column("x").fill_null(bytes(4 * DIM))), centres)
            yield pa.RecordBatch.from_arrays([b.column("source"), b.column("lang"), pa.array(topic), b.column("n_tokens")], ["source", "lang", "topic", "n_tokens"])

    def full_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index(text_col)
        for batch in batches:
            for b in slices(batch, names[at]):
                w = Words(b.column(at))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(topics(units(vectors(w)), centres)), pa.array(w.counts().astype(np.int64))], [*names, "topic", "n_tokens"])

    extra = [T.StructField("topic", T.IntegerType()), T.StructField("n_tokens", T.LongType())]
    placed = seen.mapInArrow(placed_rows, "source string, lang string, topic int, n_tokens long")
    dims = ["source", "lang", "topic"]
    cells = saved(placed.groupBy(*dims).agg(F.sum("n_tokens").alias("tokens")))
    facts = cells.agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("t")).first()
    total = float(facts["t"] or 0)
    budget = keep_tokens * total
    if facts["n"] <= local_cells:
        rows = cells.toPandas()  # at most local_cells rows
        tokens = rows["tokens"].to_numpy(np.float64)
        codes, wants = [], []
        for d in dims:
            values = sorted(set(rows[d].tolist()), key=str)
            number = {v: i for i, v in enumerate(values)}
            codes.append(np.array([number[v] for v in rows[d].tolist()], np.int64))
            have = np.bincount(codes[-1], weights=tokens, minlength=len(values)) if len(values) else np.zeros(0)
            share = np.array([float((targets or {}).get(d, {}).get(v, 0)) for v in values]) if (targets or {}).get(d) else np.where(have > 0, (have / max(total, 1)) ** temper, 0)
            wants.append(np.where(have > 0, share, 0) / max(np.where(have > 0, share, 0).sum(), 1e-300))
        code = np.stack(codes, 1) if len(rows) else np.zeros((0, 3), np.int64)
        fit, converged = rake_local(code, tokens, wants)
        weight = np.where(tokens > 0, fit * total / np.maximum(tokens, 1), 0.0)
        s = scale_local(tokens, weight, budget)
        table = pa.table({"_q_source": pa.array(rows["source"], pa.string()), "_q_lang": pa.array(rows["lang"], pa.string()), "_q_topic": pa.array(rows["topic"], pa.int32()), "weight": weight, "_q_tokens": pa.array(rows["tokens"], pa.int64())})
        weighted = F.broadcast(spark.createDataFrame(table, "_q_source string, _q_lang string, _q_topic int, weight double, _q_tokens long"))
    else:
        tables = []
        for d in dims:
            have = cells.groupBy(F.col(d).alias("value")).agg(F.sum("tokens").alias("t")).where("t > 0")
            own = (targets or {}).get(d)
            if own:
                lookup = F.create_map(*[F.lit(x) for v, y in own.items() for x in (str(v), float(y))])
                have = have.withColumn("want", F.coalesce(F.element_at(lookup, F.col("value").cast("string")), F.lit(0.0)))
            else:
                have = have.withColumn("want", F.pow(F.col("t") / total, F.lit(temper)))
            have = saved(have)
            all_ = have.agg(F.sum("want")).first()[0] or 1.0
            tables.append(have.select("value", (F.col("want") / all_).alias("want")))
        fitted, s, converged = rake_spark(cells.where("tokens > 0"), dims, tables, total, budget)
        weighted = fitted.select(F.col("source").alias("_q_source"), F.col("lang").alias("_q_lang"), F.col("topic").alias("_q_topic"), "weight", F.col("tokens").alias("_q_tokens"))
    full = base.mapInArrow(full_rows, T.StructType([*base.schema.fields, *extra]))
    same = F.col(f"`{source_col}`").cast("string").eqNullSafe(F.col("_q_source")) & F.col(f"`{lang_col}`").cast("string").eqNullSafe(F.col("_q_lang")) & (F.col("topic") == F.col("_q_topic"))
    p = F.when(F.coalesce("_q_tokens", F.lit(0)) == 0, 1.0).otherwise(F.least(F.lit(1.0), F.col("weight") * F.lit(float(s))))
    draw = F.xxhash64(F.lit(seed), ident).bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))
    out = full.join(weighted, same, "left").withColumn("probability", p).withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    return out.select(*[F.col(f"`{c}`") for c in names], "topic", "n_tokens", "weight", "probability", (draw < F.col("probability")).alias("kept"), F.lit(bool(converged)).alias("converged"))


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang")
    return mix_sources(docs).select("doc_id", *RESULT)


QUERIES = {"op2_mixing": op2_mixing}
SQL: dict[str, str] = {}
