"""Predicate cascades: learned selectivities, order, lazy evaluation and its cost."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillet.functions.predicates import predicate
from quillet.functions.segments import Runs
from quillet.functions.shared import saved, small_side

STRENGTH = 3.0


def parse_selectivity(text: Column) -> Column:
    """Share from free text: an object's ``selectivity`` or ``value`` (one half without them), else the first number (over 1:
    percent), else the words high, low or medium, looked for in this order; within 0 and 1."""
    obj = F.from_json(text, "map<string,string>")
    named = F.coalesce(obj["selectivity"], obj["value"], F.lit("0.5")).try_cast("double")
    number = F.regexp_extract(text, r"(\d+\.?\d*)", 1).try_cast("double")
    word = F.when(F.lower(text).contains("high"), 0.8).when(F.lower(text).contains("low"), 0.2).when(F.lower(text).contains("medium"), 0.5)
    s = F.coalesce(F.when(obj.isNotNull(), named), F.when(number > 1, number / 100).otherwise(number), word, F.lit(0.5))
    return F.least(F.greatest(s, F.lit(0.0)), F.lit(1.0))


def posterior(observations: DataFrame, priors: DataFrame | None = None, strength: float = STRENGTH) -> DataFrame:
    """(attr, alpha, beta, mean) after all observations (attr, passed). ``priors``: (attr, mean); unknown attributes start at one half."""
    seen = observations.groupBy("attr").agg(F.count_if("passed").alias("p"), F.count_if(~F.col("passed")).alias("f"))
    both = seen.join(priors.select("attr", F.col("mean").alias("mu")), "attr", "full_outer") if priors is not None else seen.withColumn("mu", F.lit(None).cast("double"))
    mu = F.coalesce("mu", F.lit(0.5))
    a, b = mu * strength + F.coalesce("p", F.lit(0)), (1 - mu) * strength + F.coalesce("f", F.lit(0))
    return both.select("attr", a.alias("alpha"), b.alias("beta"), (a / (a + b)).alias("mean"))


def running_posterior(observations: DataFrame, priors: DataFrame | None = None, strength: float = STRENGTH) -> DataFrame:
    """Observations (seq, attr, passed) with ``alpha``, ``beta`` and ``mean`` as they were before each of them. An attribute of
    any length is spread over ranges of ``seq``; ``priors`` as in ``posterior``. An observation that is null counts as neither."""
    own = observations.where(F.col("attr").isNotNull())
    if priors is not None:
        own = own.join(small_side(priors.select("attr", F.col("mean").alias("_mu"))), "attr", "left")
    passed, failed = F.coalesce(F.col("passed").cast("int"), F.lit(0)), F.coalesce((~F.col("passed")).cast("int"), F.lit(0))
    d = Runs.of(own, "attr", "seq").running(_p_upto=passed, _f_upto=failed).result()
    mu = F.coalesce("_mu", F.lit(0.5)) if priors is not None else F.lit(0.5)
    a, b = mu * strength + F.col("_p_upto") - passed, (1 - mu) * strength + F.col("_f_upto") - failed
    return d.select(*observations.columns, a.alias("alpha"), b.alias("beta"), (a / (a + b)).alias("mean"))


def posterior_by_batch(observations: DataFrame, batch_size: int, priors: DataFrame | None = None, strength: float = STRENGTH) -> DataFrame:
    """(batch, attr, alpha, beta, mean): what is known of every attribute before each batch of ``batch_size`` values of ``seq``
    (from 0), also where a batch before had none of its observations. A row for each attribute and batch."""
    batch = F.floor(F.col("seq") / batch_size).cast("long")
    seen = saved(observations.where(F.col("attr").isNotNull()).select("attr", batch.alias("batch"), "passed").groupBy("attr", "batch").agg(F.count_if("passed").alias("p"), F.count_if(~F.col("passed")).alias("f")))
    last = seen.agg(F.max("batch").alias("last"))
    attrs = seen.select("attr").union(priors.select("attr")).distinct() if priors is not None else seen.select("attr").distinct()
    every = attrs.crossJoin(F.broadcast(last)).where("last IS NOT NULL").select("attr", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("batch"))
    d = Runs.of(every.join(seen, ["attr", "batch"], "left"), "attr", "batch").running(p_upto=F.col("p"), f_upto=F.col("f")).result()
    mu = F.lit(0.5)
    if priors is not None:
        d, mu = d.join(small_side(priors.select("attr", F.col("mean").alias("_mu"))), "attr", "left"), F.coalesce("_mu", F.lit(0.5))
    a = mu * strength + F.col("p_upto") - F.coalesce("p", F.lit(0))
    b = (1 - mu) * strength + F.col("f_upto") - F.coalesce("f", F.lit(0))
    return d.select("batch", "attr", a.alias("alpha"), b.alias("beta"), (a / (a + b)).alias("mean"))


def draw_by_batch(posteriors: DataFrame, seed: int = 0) -> DataFrame:
    """(batch, attr, draw): one seeded draw from each attribute's Beta posterior before each batch."""

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            own = [np.random.default_rng([seed, k, *a.encode()]).beta(x, y) for k, a, x, y in zip(p["batch"], p["attr"], p["alpha"], p["beta"], strict=True)]
            yield pd.DataFrame({"batch": p["batch"], "attr": p["attr"], "draw": np.clip(own, 0, 1)})

    return posteriors.select("batch", "attr", "alpha", "beta").mapInPandas(draw, "batch long, attr string, draw double")


def _priority(mode: str) -> Column:
    return (F.col("mean") * F.col("cost")).desc() if mode == "product" else F.when(F.col("mean") < 1, F.col("cost") / (1 - F.col("mean"))).asc_nulls_last()


def order_by_batch(stats: DataFrame, mode: str = "product") -> DataFrame:
    """``order_predicates`` for each batch: predicates (batch, attr, mean, cost, position) with their ``rank`` in the batch, so
    that a cascade runs every batch in the order that all batches before have taught. A batch has a row a predicate."""
    return stats.withColumn("rank", F.row_number().over(Window.partitionBy("batch").orderBy(_priority(mode), F.col("position"))))


def thompson_draw(post: DataFrame, seed: int = 0) -> DataFrame:
    """(attr, draw): one seeded draw from each attribute's Beta posterior."""

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            own = [np.random.default_rng([seed, *a.encode()]).beta(x, y) for a, x, y in zip(p["attr"], p["alpha"], p["beta"], strict=True)]
            yield pd.DataFrame({"attr": p["attr"], "draw": np.clip(own, 0, 1)})

    return post.select("attr", "alpha", "beta").mapInPandas(draw, "attr string, draw double")


def order_predicates(stats: DataFrame, mode: str = "product") -> DataFrame:
    """Predicates (attr, mean, cost, position) with their ``rank``: by mean * cost, largest first, or with ``fail_fast`` by
    cost for each document that fails, smallest first; ties keep the schema's order. The table has a row a predicate."""
    return stats.withColumn("rank", F.row_number().over(Window.orderBy(_priority(mode), F.col("position"))))


def lazy_extract(docs: DataFrame, stages: list[str]) -> DataFrame:
    """Documents with ``num_extracted`` and ``stopped_at``: predicates in order, each document stops at its first failure."""
    fails = [F.when(~predicate(s, docs.columns), F.struct(F.lit(i + 1).alias("n"), F.lit(s).alias("at"))) for i, s in enumerate(stages)]
    stop = F.coalesce(*fails) if len(fails) > 1 else fails[0]
    return docs.withColumn("_s", stop).select(*docs.columns, F.coalesce("_s.n", F.lit(len(stages))).alias("num_extracted"), F.col("_s").isNotNull().alias("stopped_early"), F.col("_s.at").alias("stopped_at"))


def lazy_extract_with(docs: DataFrame, stages: list[tuple[str, Callable[[pd.DataFrame], pd.Series], Callable[[pd.Series], pd.Series]]], key: str = "doc_id") -> DataFrame:
    """The same for black-box stages (attr, extract, test): one Python pass that drops failed documents between stages,
    so that a costly extractor never sees them. An extractor that raises gives null values and the batch goes on."""
    names = [s[0] for s in stages]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            out = pd.DataFrame({key: p[key], **{n: pd.Series([None] * len(p), index=p.index, dtype=object) for n in names}, "num_extracted": 0, "stopped_at": pd.Series([None] * len(p), index=p.index, dtype=object)})
            live = p
            for name, extract, test in stages:
                if not len(live):
                    break
                out.loc[live.index, "num_extracted"] += 1
                try:
                    v = extract(live)
                except Exception:  # noqa: BLE001 - a failing extractor gives nulls, by contract
                    continue
                out.loc[live.index, name] = v.astype(object)
                ok = test(v).fillna(False).astype(bool)
                out.loc[live.index[~ok], "stopped_at"] = name
                live = live[ok]
            yield out

    types = ", ".join(f"{n} string" for n in names)
    return docs.mapInPandas(run, f"{key} {docs.schema[key].dataType.simpleString()}, {types}, num_extracted int, stopped_at string")


def cascade_statistics(extracted: DataFrame) -> DataFrame:
    return extracted.groupBy("stopped_at").agg(F.count(F.lit(1)).alias("documents"), F.sum("num_extracted").cast("long").alias("extractions"))


def cascade_cost(docs: DataFrame, stages: list[tuple[str, float]]) -> DataFrame:
    """(stage, reached, cost): documents that reach each stage of an order, times the stage's cost."""
    alive, sums = F.lit(True), []
    for s, _ in stages:
        sums.append(F.count_if(alive))
        alive = alive & predicate(s, docs.columns)
    one = docs.agg(*[c.alias(f"s{i}") for i, c in enumerate(sums)])
    rows = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("stage"), F.lit(s).alias("predicate"), F.col(f"s{i}").alias("reached"), (F.col(f"s{i}") * float(c)).alias("cost")) for i, (s, c) in enumerate(stages)]))
    return one.select(rows.alias("r")).select("r.*")
