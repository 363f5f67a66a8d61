"""When a growing schema is stable, and which documents to read next.

Snapshots are rows (run_id, seq, features); every statistic of a run is computed for all its steps in one job, and a run of
any length is spread over ranges (``quillet.functions.segments``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillet.functions.ranks import global_rank, seeded
from quillet.functions.segments import Runs
from quillet.functions.shared import saved, small_side
from quillet.functions.vectors import euclidean

#: Rows that a pass of picks brings to the driver, at most, and the further ones for each pick.
HELD_ROWS, HELD_PER_PICK = 4096, 64


def schema_features(log: DataFrame, strict_keys: bool = False) -> DataFrame:
    """(run_id, seq, features): ``table:T`` and ``T.attr`` of each step's schema log (run_id, seq, table_name, attrs).

    ``strict_keys`` names an attribute's own field names instead, as a reader of nested objects does that takes keys."""
    names = F.array(F.lit("Attribute Name"), F.lit("Description")) if strict_keys else F.col("attrs")
    f = F.concat(F.array(F.concat(F.lit("table:"), "table_name")), F.transform(F.coalesce(names, F.array().cast("array<string>")), lambda a: F.concat_ws(".", F.col("table_name"), a)))
    return log.groupBy("run_id", "seq").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(f)))).alias("features"))


def entropy_of(a: Column, b: Column, both_empty: float = 1.0) -> Column:
    union = F.size(F.array_union(a, b))
    diff = F.size(F.array_except(a, b)) + F.size(F.array_except(b, a))
    return F.when(union > 0, diff / union).otherwise(F.lit(both_empty))


def _entropies(runs: Runs, both_empty: float = 1.0) -> Runs:
    change = F.when(F.col("_before").isNull(), F.lit(1.0)).otherwise(entropy_of(F.col("features"), F.col("_before"), both_empty))
    d = runs.previous("features", "_before").with_column("entropy", change)
    return replace(d, rows=d.rows.drop("_before"))


def schema_entropy(snapshots: DataFrame, both_empty: float = 1.0) -> DataFrame:
    """Snapshots with ``entropy``: share of features that changed since the step before; 1 at the first step."""
    return _entropies(Runs.of(snapshots), both_empty).result()


def stability_streak(entropies: DataFrame, theta: float = 0.05) -> DataFrame:
    """``streak``: steps in a row, up to this one, with entropy below ``theta``."""
    return Runs.of(entropies).streak(F.col("entropy") < theta, "streak").result()


def entropy_statistics(entropies: DataFrame) -> DataFrame:
    return entropies.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.avg("entropy").alias("mean"), F.min("entropy").alias("min"), F.max("entropy").alias("max"), F.max_by("entropy", "seq").alias("final"), F.max_by(F.size("features"), "seq").alias("n_features"))


def stop_point_entropy(snapshots: DataFrame, theta: float = 0.05, m: int = 8, n_min: int = 10, delta: float = 0.05, epsilon: float = 0.05, probabilistic: bool = True) -> DataFrame:
    """(run_id, n, stop_seq, min_sample): the first step with a streak of m, n_min documents and (1 - eps)^n * F <= delta."""
    runs = _entropies(Runs.of(snapshots)).streak(F.col("entropy") < theta, "streak").running(n=F.lit(1))
    d = runs.result().withColumn("f", F.size("features"))
    bound = (F.col("f") > 0) & (F.pow(F.lit(1 - epsilon), F.col("n")) * F.col("f") <= delta) if probabilistic else F.lit(True)
    ok = (F.col("streak") >= m) & (F.col("n") >= n_min) & bound
    need = F.when(F.col("f") > 0, F.greatest(F.ceil(F.ln(F.col("f") / delta) / epsilon), F.lit(n_min))).otherwise(F.lit(n_min))
    return d.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.when(ok, F.col("n"))).alias("stop_n"), F.max_by(need, "seq").cast("long").alias("min_sample"))


def _occurrences(snapshots: DataFrame) -> DataFrame:
    """(run_id, seq, firsts, seconds): features seen for the first and for the second time at each step. Both are minima over
    a feature's steps, so that a feature of every step is no group of its own in any task."""
    one = snapshots.select("run_id", "seq", F.explode("features").alias("f"))
    first = saved(one.groupBy("run_id", "f").agg(F.min("seq").alias("_first")))
    second = one.join(small_side(first), ["run_id", "f"]).where(F.col("seq") > F.col("_first")).groupBy("run_id", "f").agg(F.min("seq").alias("seq"))
    seen = first.select("run_id", F.col("_first").alias("seq"), F.lit(1).alias("r")).union(second.select("run_id", "seq", F.lit(2)))
    return seen.groupBy("run_id", "seq").agg(F.count_if(F.col("r") == 1).alias("firsts"), F.count_if(F.col("r") == 2).alias("seconds"))


def good_turing(snapshots: DataFrame, delta: float = 0.05, n_min: int = 50, batch: int = 5) -> DataFrame:
    """Snapshots with ``n``, ``n1`` (features seen once so far), ``missing`` = n1 / n, and ``stop`` at the ends of batches."""
    d = snapshots.select("run_id", "seq").join(_occurrences(snapshots), ["run_id", "seq"], "left")
    d = Runs.of(d).running(n=F.lit(1), n1=F.coalesce("firsts", F.lit(0)) - F.coalesce("seconds", F.lit(0))).result()
    d = d.withColumn("missing", F.col("n1") / F.col("n"))
    return d.select("run_id", "seq", "n", "n1", "missing", ((F.col("n") >= n_min) & (F.col("n") % batch == 0) & (F.col("missing") < delta)).alias("stop"))


def frequency_of_frequencies(snapshots: DataFrame) -> DataFrame:
    return snapshots.select("run_id", F.explode("features").alias("f")).groupBy("run_id", "f").count().groupBy("run_id", F.col("count").alias("times")).agg(F.count(F.lit(1)).alias("features"))


def legacy_stop(snapshots: DataFrame, theta: float = 0.05, m: int = 3, coverage: float = 0.95, min_docs: int = 10) -> DataFrame:
    """(run_id, n, stop_n): the first step, from min_docs on, with a streak of m or with a share of features seen twice."""
    runs = Runs.of(snapshots.join(_occurrences(snapshots), ["run_id", "seq"], "left"))
    runs = _entropies(runs, 0.0).streak(F.col("entropy") < theta, "streak")
    d = runs.running(n=F.lit(1), seen=F.col("firsts"), twice=F.col("seconds")).result()
    ok = (F.col("n") >= min_docs) & ((F.col("streak") >= m) | ((F.col("seen") > 0) & (F.col("twice") >= coverage * F.col("seen"))))
    return d.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.when(ok, F.col("n"))).alias("stop_n"))


def run_report(stops: DataFrame) -> DataFrame:
    """Documents in all, processed, saved, and whether the run stopped early, from (run_id, n, stop_n)."""
    done = F.coalesce("stop_n", "n")
    return stops.select("run_id", F.col("n").alias("total"), done.alias("processed"), (F.col("n") - done).alias("saved"), (done < F.col("n")).alias("stopped_early"))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equally long number lists."""
    flat = np.asarray(pc.list_flatten(column), np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _distances(v: np.ndarray, p: np.ndarray, metric: str) -> np.ndarray:
    """Distance of each row to one vector; a task and the driver find the same numbers for the same row."""
    if metric == "euclidean":
        return np.sqrt(((v - p) ** 2).sum(axis=1))
    size = np.sqrt((v * v).sum(axis=1)) * np.sqrt((p * p).sum())
    return 1.0 - np.divide((v * p).sum(axis=1), size, out=np.zeros(len(v)), where=size > 0)


def _farthest(vectors: DataFrame, points: np.ndarray, gone: list, metric: str, held: int) -> tuple[list, np.ndarray, np.ndarray, float]:
    """(ids, vectors, distances, bound) of the ``held`` rows farthest from their nearest point, by distance and id, and
    a bound for the distances of all others. One pass over the vectors, which stay where they are."""
    shared = vectors.sparkSession.sparkContext.broadcast(points)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = _matrix(b.column(1))
            d = np.full(len(v), np.inf)
            for p in shared.value:
                d = np.minimum(d, _distances(v, p, metric))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(d)], ["id", "v", "d"])

    rest = vectors.where(~F.col("id").isin(gone)) if gone else vectors
    top = rest.mapInArrow(run, f"id {vectors.schema['id'].dataType.simpleString()}, v array<double>, d double").orderBy(F.desc("d"), "id").limit(held + 1).toArrow()
    ids, v, d = top.column("id").to_pylist(), _matrix(top.column("v").combine_chunks()), np.asarray(top.column("d"))
    return (ids, v, d, -np.inf) if len(ids) <= held else (ids[:held], v[:held], d[:held], float(d[held]))


def _held_rows(vectors: DataFrame, held_values: int, k: int) -> int:
    """Rows that a pass brings: ``held_values`` numbers, but not many more than ``k`` picks can use."""
    first = vectors.select(F.size("v")).first()
    return max(2, min(held_values // max(1, first[0]), HELD_ROWS + HELD_PER_PICK * k)) if first else 2


def _plain(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    return v.where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull()))


def select_maxmin(vectors: DataFrame, chosen: list, k: int, metric: str = "euclidean", id_col: str = "vec_id", vec_col: str = "embedding", held_values: int = 4_000_000) -> DataFrame:
    """(pick, id, min_dist): k picks, each the candidate farthest from all chosen before; ties go to the smallest id.

    A pass over the vectors brings the farthest of them (``held_values`` numbers and some thousand rows at most) to the driver, which picks among these while
    the best is farther than the bound of all others, as picks only bring distances down; then comes the next pass. Every pass
    gives one pick at least, and all k where the held rows suffice. Ids may be numbers or text. Null vectors are left out."""
    data = _plain(vectors, id_col, vec_col)
    held = _held_rows(data, held_values, k)
    start = data.where(F.col("id").isin(chosen)).select("v").toArrow().column("v").combine_chunks() if chosen else None  # the chosen few
    points = list(_matrix(start)) if start is not None else []
    picks, gone = [], list(chosen)
    while len(picks) < k:
        ids, v, d, bound = _farthest(data, np.array(points), gone, metric, held)
        live = np.ones(len(ids), bool)
        while live.any() and len(picks) < k:
            most = d[live].max()
            i = min(np.flatnonzero(live & (d == most)).tolist(), key=lambda j: ids[j])
            if not live.all() and not most > bound:  # the first pick of a pass is exact whatever the bound
                break
            picks.append((len(picks) + 1, ids[i], float(d[i])))
            gone.append(ids[i])
            points.append(v[i])
            live[i] = False
            d = np.minimum(d, _distances(v, v[i], metric))
        if not ids:
            break
    return vectors.sparkSession.createDataFrame(picks, f"pick int, id {vectors.schema[id_col].dataType.simpleString()}, min_dist double")


def mean_vector(vectors: DataFrame, vec_col: str) -> DataFrame:
    """One row ``mean``: the average vector, summed in each task first; no row without vectors."""
    v = vectors.where(F.col(vec_col).isNotNull()).select(array_to_vector(F.col(vec_col).cast("array<double>")).alias("v"))
    return v.groupBy(F.lit(1).alias("_all")).agg(vector_to_array(Summarizer.mean(F.col("v"))).alias("mean")).drop("_all")


def farthest_from_mean(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", chosen: DataFrame | None = None) -> DataFrame:
    """(id, distance) of the vector farthest from the mean of ``chosen`` (of all, without it); ties go to the smallest id."""
    m = mean_vector(vectors if chosen is None else chosen, vec_col)
    d = vectors.crossJoin(F.broadcast(m)).select(F.col(id_col).alias("id"), euclidean(F.col(vec_col), F.col("mean")).alias("distance")).where("distance IS NOT NULL")
    return d.orderBy(F.desc("distance"), "id").limit(1)


def diversity_order(vectors: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", held_values: int = 4_000_000) -> DataFrame:
    """(pick, id): the first k documents, each farthest from the mean of those before (the first from the mean of all).

    As in ``select_maxmin``, a pass brings the farthest rows to the driver. While the mean moves by m, no other row is farther
    than their bound plus m; a pick beyond that is exact, else the next pass starts from the new mean."""
    data = _plain(vectors, id_col, vec_col)
    held = _held_rows(data, held_values, k)
    row = mean_vector(data, "v").first()
    picks, gone, total = [], [], None
    centre = np.array(row["mean"]) if row else None
    while centre is not None and len(picks) < k:
        origin = centre
        ids, v, d, bound = _farthest(data, origin[None, :], gone, "euclidean", held)
        live = np.ones(len(ids), bool)
        while live.any() and len(picks) < k:
            d = _distances(v, centre, "euclidean")
            most = d[live].max()
            i = min(np.flatnonzero(live & (d == most)).tolist(), key=lambda j: ids[j])
            if not live.all() and not most > bound + np.sqrt(((centre - origin) ** 2).sum()):
                break
            picks.append((len(picks) + 1, ids[i]))
            gone.append(ids[i])
            live[i] = False
            total = v[i] if total is None else total + v[i]
            centre = total / len(picks)
        if not ids:
            break
    return vectors.sparkSession.createDataFrame(picks, f"pick int, id {vectors.schema[id_col].dataType.simpleString()}")


def embedding_coverage(docs: DataFrame, vectors: DataFrame, doc_key: str, vec_key: str) -> DataFrame:
    v = vectors.select(F.col(vec_key).alias("_k")).distinct()
    return docs.join(v, docs[doc_key] == v["_k"], "left").agg(F.count_if(F.col("_k").isNotNull()).alias("with_vector"), F.count_if(F.col("_k").isNull()).alias("without_vector"))


def shuffled(docs: DataFrame, key: str, seed: int = 0, n: int | None = None) -> DataFrame:
    """A reproducible random order (column ``place``) by the md5 of seed and id; the first ``n`` if given."""
    d = global_rank(docs.withColumn("_h", seeded(F.col(key), seed)), "_h", key, name="place").drop("_h")
    return d if n is None else d.where(F.col("place") < n)
