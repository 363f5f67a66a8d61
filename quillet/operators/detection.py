"""Wrong rows: votes of classifiers, their metrics and bounds, conformal sets and abstention.

``outputs``: (doc_id, layer, sample_ix, prob); ``labels``: (doc_id, y), 1 for a wrong row.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillet.functions.ranks import global_rank, rank_in_groups, running_sum, seeded
from quillet.functions.shared import saved
from quillet.functions.spans import aligned_span
from quillet.operators.evaluation import ratio

THRESHOLDS = (0.00001, 0.00005, 0.0001, 0.0005, 0.001, 0.005, 0.01, 0.02, 0.03, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.97, 0.99, 0.995, 0.999)  # fixed values
CELLS = 50


def labelled_samples(doc_stats: DataFrame) -> DataFrame:
    """(doc_id, target, y): a table sample for each document and one for each attribute (map attr -> right)."""
    t = doc_stats.select("doc_id", F.lit("__table__").alias("target"), F.when(F.col("table_ok"), 0).otherwise(1).alias("y"))
    return t.union(doc_stats.select("doc_id", F.explode("attrs").alias("target", "ok")).select("doc_id", "target", F.when(F.col("ok"), 0).otherwise(1)))


def oversample(samples: DataFrame, label: str = "y", order: str = "doc_id") -> DataFrame:
    """Every class as often as the largest: each row max // n times, the first max % n rows once more. ``order`` identifies a row."""
    counts = samples.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    counts = saved(counts.crossJoin(counts.agg(F.max("n").alias("most"))))
    d = rank_in_groups(samples, label, order, name="r").join(F.broadcast(counts), label)
    copies = F.floor(F.col("most") / F.col("n")) + F.when(F.col("r") < F.col("most") % F.col("n"), 1).otherwise(0)
    return d.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), copies))).drop("n", "most", "r")


def train_sample(samples: DataFrame, n: int, order: str = "doc_id", seed: int = 0) -> DataFrame:
    """The samples of ``n`` documents, drawn by the md5 of seed and id."""
    few = samples.select(order).distinct().orderBy(seeded(F.col(order), seed), order).limit(n)
    return samples.join(few, order, "left_semi")


def ordered_split(samples: DataFrame, share: float, order: str = "doc_id") -> DataFrame:
    """``is_train`` for the first share of the documents in order (by percent rank)."""
    docs = global_rank(samples.select(order).distinct(), order, name="_rank")
    n = docs.agg(F.greatest(F.count(F.lit(1)) - 1, F.lit(1)).alias("_n"))
    return samples.join(docs, order).crossJoin(F.broadcast(n)).withColumn("is_train", F.col("_rank") / F.col("_n") < share).drop("_rank", "_n")


def dealt(samples: DataFrame, features: str, label: str, rows: int = 1024, tasks: int = 256) -> DataFrame:
    """The samples in parts of some ``rows``, at most ``tasks``. A training sample has few bytes, so that adaptive execution
    would leave it in few parts, and each step of a fit takes as long as its largest part. Parts are sorted, as sums of
    a step depend on the order of its rows."""
    n = max(1, min(tasks, samples.count() // rows))
    return samples.repartition(n, F.xxhash64(features, label)).sortWithinPartitions(features, label)


def train_classifier(samples: DataFrame, features: str = "features", label: str = "y", hidden: int = 0, seed: int = 1):
    """A fitted error classifier on an array column: one hidden layer of ``hidden`` units, or logistic regression for 0."""
    d = dealt(samples.select(features, label), features, label).withColumn("_v", array_to_vector(F.transform(features, lambda x: x.cast("double")))).withColumn("_y", F.col(label).cast("double"))
    if hidden:
        dim = len(d.select(features).first()[0])
        return MultilayerPerceptronClassifier(layers=[dim, hidden, 2], featuresCol="_v", labelCol="_y", seed=seed, maxIter=60).fit(d)
    return LogisticRegression(featuresCol="_v", labelCol="_y", maxIter=50, regParam=1e-3).fit(d)


def score_samples(model, samples: DataFrame, features: str = "features") -> DataFrame:
    d = samples.withColumn("_v", array_to_vector(F.transform(features, lambda x: x.cast("double"))))
    return model.transform(d).withColumn("prob", vector_to_array("probability")[1]).drop("_v", "rawPrediction", "probability", "prediction")


def best_classifier(train: DataFrame, valid: DataFrame, features: str = "features", label: str = "y", candidates: tuple[tuple[int, int], ...] = ((128, 1), (128, 2), (0, 1))):
    """(model, accuracy): the candidate (hidden units, seed) with the best accuracy on the validation rows, the first of equals."""
    best, train = None, saved(train.select(features, label))
    for hidden, seed in candidates:
        model = train_classifier(train, features, label, hidden, seed)
        right = F.avg(F.when((F.col("prob") >= 0.5) == (F.col(label) == 1), 1.0).otherwise(0.0))
        accuracy = score_samples(model, valid, features).agg(right.alias("a")).first()["a"]
        if best is None or (accuracy or 0.0) > best[1]:
            best = (model, accuracy or 0.0)
    return best


def document_scores(outputs: DataFrame) -> DataFrame:
    return outputs.groupBy("doc_id", "layer").agg(F.max("prob").alias("score"))


def assign_ensembles(outputs: DataFrame, size: int = 3, seed: int = 0) -> DataFrame:
    """Layers dealt to disjoint ensembles of ``size`` in a seeded random order: (layer, ens). A model has a few dozen layers."""
    layers = outputs.select("layer").distinct()
    return layers.withColumn("ens", F.floor((F.row_number().over(Window.orderBy(seeded(F.col("layer"), seed), "layer")) - 1) / size).cast("int"))


def prefix_votes(scores: DataFrame, ensembles: int, threshold: float = 0.5) -> DataFrame:
    """(prefix, doc_id, y, pred): ``vote`` by halves over the first 1, 2, .. ``ensembles`` ensembles of (doc_id, y, ens, score)."""
    one = scores.where(F.col("ens") < ensembles).groupBy("doc_id", "y", "ens").agg(F.when(F.avg("score") >= threshold, 1).otherwise(0).alias("v"))
    wide = one.withColumn("prefix", F.explode(F.sequence(F.col("ens") + 1, F.lit(ensembles))))
    return wide.groupBy("prefix", "doc_id", "y").agg(F.when(F.sum("v") * 2 >= F.count(F.lit(1)), 1).otherwise(0).alias("pred"))


def size_grid(scores: DataFrame, *keys: str, threshold: float = 0.5) -> DataFrame:
    """Metrics and AUC of (keys.., y, score), one row for each key, such as layer and training size."""
    m = detection_metrics(scores.withColumn("pred", (F.col("score") >= threshold).cast("int")), *keys)
    return m.join(roc_auc(scores, *keys), list(keys))


def vote(scores: DataFrame, mode: str = "half", threshold: float = 0.5) -> DataFrame:
    """(doc_id, pred) from (doc_id, ens, layer, score): half = majority of ensemble averages, soft = average of averages,
    hard = majority of ensembles that are majorities of layers; ties are positive."""
    inner = F.avg(F.when(F.col("score") >= threshold, 1.0).otherwise(0.0)) if mode == "hard" else F.avg("score")
    e = scores.groupBy("doc_id", "ens").agg(inner.alias("s"))
    if mode == "soft":
        return e.groupBy("doc_id").agg(F.when(F.avg("s") >= threshold, 1).otherwise(0).alias("pred"))
    bar = 0.5 if mode == "hard" else threshold
    return e.groupBy("doc_id").agg(F.when(F.sum(F.when(F.col("s") >= bar, 1).otherwise(0)) * 2 >= F.count(F.lit(1)), 1).otherwise(0).alias("pred"))


def detection_metrics(preds: DataFrame, *keys: str) -> DataFrame:
    """Confusion and rates of (keys.., y, pred), one row for each key."""
    y, p = F.col("y"), F.col("pred")
    m = preds.groupBy(*keys).agg(F.count_if((y == 0) & (p == 0)).alias("tn"), F.count_if((y == 0) & (p == 1)).alias("fp"), F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 1) & (p == 1)).alias("tp"))
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    n = tn + fp + fn + tp
    pr, re = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return m.select(*keys, "tn", "fp", "fn", "tp", pr.alias("precision"), re.alias("recall"), ratio(2 * pr * re, pr + re).alias("f1"), ratio(fp + fn, n).alias("error_rate"), ratio(fn, n).alias("residual_error_rate"), ratio(fp, tn + fp).alias("extra_cost_rate"), ratio(tn + fp, n).alias("original_accuracy"), ratio(tn + fp + tp, n).alias("corrected_accuracy"))


def roc_auc(scored: DataFrame, *keys: str, score: str = "score") -> DataFrame:
    """Area under the curve as the Mann-Whitney statistic, ties counted half.

    Distinct scores are counted first; the running sum over them goes through ranges of all keys' scores, so that neither
    a key nor the whole table is one task."""
    by = scored.groupBy(*keys, score).agg(F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") == 0).alias("n"))
    d = running_sum(by, "n", *keys, score, name="below")
    first = F.min("below") if keys else F.lit(0)
    sums = d.groupBy(*keys).agg(F.sum("p").alias("p"), F.sum("n").alias("n"), F.sum(F.col("p") * (F.col("below") + F.col("n") / 2)).alias("u"), first.alias("base"))
    return sums.select(*keys, F.when((F.col("p") > 0) & (F.col("n") > 0), (F.col("u") - F.col("base") * F.col("p")) / (F.col("p") * F.col("n"))).alias("auc"))


def voting_error(votes: DataFrame) -> DataFrame:
    """(k, error) for k = 3..8: bound on the error of a majority of three classifiers, on positives, times their share.

    ``votes``: (y, v array of three 0/1 votes). Null without positives."""
    e = F.transform("v", lambda x: F.when(x != F.col("y"), 1.0).otherwise(0.0))
    v = [F.col("v")[i] for i in range(3)]
    e_ = [F.col("e")[i] for i in range(3)]
    differ = lambda i, j: F.when(v[i] != v[j], 1.0).otherwise(0.0)
    ordered = [(i, j) for i in range(3) for j in range(3)]
    eps = sum((0.5 * (e_[i] + e_[j]) * differ(i, j) for i, j in ordered), F.lit(0.0)) / 9
    mean_e = (e_[0] + e_[1] + e_[2]) / 3
    d = votes.withColumn("e", e)
    pos = F.col("y") == 1
    on = lambda c: F.avg(F.when(pos, c))
    a = d.agg(on(mean_e).alias("l"), on((differ(0, 1) + differ(0, 2) + differ(1, 2)) / 3).alias("dis"), on(eps).alias("eps"), on(F.when(mean_e > 0.5, 1.0).otherwise(0.0)).alias("num"), on(mean_e * mean_e).alias("den"), F.avg(F.when(pos, 1.0).otherwise(0.0)).alias("p1"))
    e3 = F.when(F.col("l") > 0, F.col("eps") / (2 * F.col("l"))).otherwise(0.0)
    eta = F.when(F.col("den") > 0, F.col("num") / F.col("den")).otherwise(0.0)
    k = F.col("k")
    est = eta * (F.col("l") + (3 * (k - 1)) / (2 * k) * (e3 * F.col("l") - 0.5 * F.col("dis"))) * F.col("p1")
    return a.withColumn("k", F.explode(F.sequence(F.lit(3), F.lit(8)))).select("k", F.bround(est, 4).alias("error"))


def chernoff(p: Column, n: Column) -> Column:
    delta = 1 / (2 * p) - 1
    return F.when((p <= 0) | (p >= 1), F.lit(0.0)).otherwise(F.exp(-(delta * delta * n * p) / 2))


def error_bounds(votes: DataFrame) -> DataFrame:
    """(name, value): k3..k8 from ``voting_error`` and n1..n8, the Chernoff bound of n classifiers at k3's error."""
    k = voting_error(votes)
    n = k.where("k = 3").withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(8)))).select(F.concat(F.lit("n"), "n").alias("name"), F.bround(chernoff(F.col("error"), F.col("n")), 4).alias("value"))
    return k.select(F.concat(F.lit("k"), "k").alias("name"), F.col("error").alias("value")).union(n)


def marginal_voting(outputs: DataFrame, labels: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS) -> tuple[DataFrame, DataFrame]:
    """(threshold, disagree, documents, fn_rate) and (threshold, abstain, extra_cost_rate, accuracy) over a grid of
    thresholds: layers vote, documents split by the size of the minority, and those above ``abstain`` are checked by hand."""
    grid = F.explode(F.array(*[F.lit(t) for t in thresholds]))
    layer = document_scores(outputs).withColumn("threshold", grid)
    d = layer.groupBy("threshold", "doc_id").agg(F.count_if(F.col("score") >= F.col("threshold")).alias("ones"), F.count(F.lit(1)).alias("n"))
    d = d.withColumn("pred", F.when(F.col("ones") * 2 >= F.col("n"), 1).otherwise(0)).withColumn("disagree", F.least(F.least("ones", F.col("n") - F.col("ones")), F.lit(3))).join(labels, "doc_id")
    missed = (F.col("y") == 1) & (F.col("pred") == 0)
    levels = d.groupBy("threshold", "disagree").agg(F.count(F.lit(1)).alias("documents"), F.avg(F.when(missed, 1.0).otherwise(0.0)).alias("fn_rate"))
    a = d.withColumn("abstain", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    trust = F.col("disagree") <= F.col("abstain")
    cost = a.groupBy("threshold", "abstain").agg(F.count_if(F.when(trust, (F.col("y") == 0) & (F.col("pred") == 1)).otherwise(F.col("y") == 0)).alias("fp"), F.count_if(trust & missed).alias("fn"), F.count_if(F.col("y") == 0).alias("neg"), F.count(F.lit(1)).alias("n"))
    return levels, cost.select("threshold", "abstain", ratio(F.col("fp"), F.col("neg")).alias("extra_cost_rate"), (1 - F.col("fn") / F.col("n")).alias("accuracy"))


def conformal_sets(scores: DataFrame, split: DataFrame, alphas: tuple[float, ...], cells: int = CELLS) -> DataFrame:
    """(alpha, doc_id, y, labels): multi-dimensional conformal label sets.

    ``scores``: (doc_id, p array, one value a layer or head). ``split``: (doc_id, part, y) with parts cell, recal, test. The
    score of a label is 1 - p for 1 and p for 0. Cells are the own scores of the first ``cells`` cell documents in order (as
    many if there are fewer), a bounded table; each recalibration and test score belongs to the nearest cell (the lowest id
    of equals). Cells are taken by their share of false scores until the covered true scores reach (1 - alpha) (n + 1); a
    label is in the set if its cell is taken; an empty set is {0}.
    """
    d = scores.join(split, "doc_id")
    score = lambda label: F.transform("p", lambda x: (F.lit(1.0) - x) if label else x)
    centres = saved(d.where("part = 'cell'").orderBy("doc_id").limit(cells).select(F.col("doc_id").alias("cell"), F.when(F.col("y") == 1, score(1)).otherwise(score(0)).alias("c")))
    one = centres.agg(F.sort_array(F.collect_list(F.struct("cell", "c"))).alias("cells"))
    dist = lambda s, c: F.aggregate(F.zip_with(s, c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, x: acc + x)
    both = d.where("part <> 'cell'").crossJoin(F.broadcast(one)).withColumn("l", F.explode(F.array(F.struct(F.lit(0).alias("label"), score(0).alias("s")), F.struct(F.lit(1).alias("label"), score(1).alias("s")))))
    near = F.array_min(F.transform("cells", lambda c: F.struct(dist(F.col("l.s"), c["c"]).alias("d"), c["cell"].alias("cell"))))["cell"]
    placed = saved(both.select("part", "doc_id", "y", F.col("l.label").alias("label"), near.alias("cell")))
    per = placed.where("part = 'recal'").groupBy("cell").agg(F.count_if(F.col("label") == F.col("y")).alias("t"), F.count_if(F.col("label") != F.col("y")).alias("f"))
    per = centres.select("cell").join(per, "cell", "left").select("cell", F.coalesce("t", F.lit(0)).alias("t"), F.coalesce("f", F.lit(0)).alias("f"))
    ranked = per.withColumn("dens", F.when(F.col("t") > 0, (F.col("f") + F.col("t")) / F.col("t")).otherwise(F.lit(float("inf"))))
    before = F.coalesce(F.sum("t").over(Window.orderBy("dens", "cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # over ``cells`` rows
    n = split.where("part = 'recal'").agg(F.count(F.lit(1)).alias("n"))
    grid = ranked.withColumn("before", before).crossJoin(F.broadcast(n)).withColumn("alpha", F.explode(F.array(*[F.lit(a) for a in alphas])))
    taken = grid.where(F.col("before") < F.ceil((1 - F.col("alpha")) * (F.col("n") + 1))).select("alpha", F.col("cell").alias("taken"))
    test = placed.where("part = 'test'").withColumn("alpha", F.explode(F.array(*[F.lit(a) for a in alphas])))
    hit = test.join(F.broadcast(taken), (test["alpha"] == taken["alpha"]) & (test["cell"] == taken["taken"]), "left").select(test["alpha"], "doc_id", "y", F.when(F.col("taken").isNotNull(), F.col("label")).alias("label"))
    sets = hit.groupBy("alpha", "doc_id", "y").agg(F.sort_array(F.collect_set("label")).alias("labels"))
    return sets.withColumn("labels", F.when(F.size("labels") == 0, F.array(F.lit(0))).otherwise(F.col("labels")))


def conformal_metrics(sets: DataFrame, *keys: str) -> DataFrame:
    """(keys.., alpha, ..): coverage, share of sets with several labels, average size, and ``detection_metrics`` of "1 is in the
    set". ``keys`` may be a layer or head that ``sets`` carries."""
    by = [*keys, "alpha"]
    own = sets.groupBy(*by).agg(F.avg(F.when(F.array_contains("labels", F.col("y")), 1.0).otherwise(0.0)).alias("coverage"), F.avg(F.when(F.size("labels") > 1, 1.0).otherwise(0.0)).alias("abstain_share"), F.avg(F.size("labels").cast("double")).alias("avg_size"))
    return own.join(detection_metrics(sets.withColumn("pred", F.array_contains("labels", F.lit(1)).cast("int")), *by), by)


def missed_documents(sets: DataFrame, *keys: str) -> DataFrame:
    """(keys.., alpha, doc_id): wrong rows whose set lacks 1, one a row."""
    return sets.where((F.col("y") == 1) & ~F.array_contains("labels", F.lit(1))).select(*keys, "alpha", "doc_id")


def trial_summary(trials: DataFrame, *keys: str) -> DataFrame:
    """(keys.., measure, mean, std): over trials, population deviation. ``trials``: (keys.., measure, value)."""
    return trials.groupBy(*keys, "measure").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def pool_tokens(tokens: DataFrame, *keys: str) -> DataFrame:
    """(keys.., pooled): mean and maximum of token vectors by dimension, one after the other. Vectors are folded whole, in
    each task first; null ones are left out."""
    d = tokens.where(F.col("vec").isNotNull()).select(*keys, array_to_vector(F.col("vec").cast("array<double>")).alias("_v"))
    both = Summarizer.metrics("mean", "max").summary(F.col("_v"))
    return d.groupBy(*keys).agg(both.alias("b")).select(*keys, F.concat(vector_to_array("b.mean"), vector_to_array("b.max")).alias("pooled"))


def align_span(tokens: Column, value: Column) -> Column:
    """struct(start, n): first run of tokens whose joined text equals the value; null if none. Quotes and white space at the
    ends of both don't count, nor do double quotes inside; values that stand for a missing one equal each other.
    One search in the joined text, in Arrow batches (``quillet.functions.spans``)."""
    return aligned_span(tokens, value)
