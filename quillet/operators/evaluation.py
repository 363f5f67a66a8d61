"""Populated rows against ground truth, down to single attributes.

``pairs``: (doc_id, pred_table, pred map, gt_table, gt map); a null ``gt_table`` marks an irrelevant document.
``name_map``: (gt_table, pred_attr, gt_attrs). ``verdicts``: (pred_value, gt_value, result).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillet.functions.nulls import is_null
from quillet.functions.shared import small_side

NO_MAP = "map<string,string>"


def check_tables(pairs: DataFrame, table_map: DataFrame) -> DataFrame:
    """Pairs with ``table_ok``: the predicted table's ground-truth name is the right one. ``table_map``: (pred_table, mapped)."""
    d = pairs.join(small_side(table_map), "pred_table", "left")
    return d.withColumn("table_ok", F.coalesce(F.col("mapped") == F.col("gt_table"), F.lit(False))).drop("mapped")


def gt_value(gt: Column, attrs: Column) -> Column:
    """Lower-cased values of the mapped attributes, joined by a space; a missing key is empty."""
    return F.lower(F.array_join(F.filter(F.transform(attrs, lambda a: F.element_at(gt, a)), lambda v: v.isNotNull()), " "))


def compare_attributes(checked: DataFrame, name_map: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """(doc_id, gt_table, attr, pred_value, gt_value, outcome) of right-table documents.

    Both missing is TP, missing truth FP, missing prediction FN; equal values, or a truth contained in the prediction,
    are TP, else the verdict decides. An attribute that the prediction lacks is FN, or not counted if the truth is missing.
    """
    d = checked.where("table_ok").join(small_side(name_map), "gt_table")
    has = F.map_contains_key("pred", F.col("pred_attr"))
    d = d.select("doc_id", "gt_table", F.col("pred_attr").alias("attr"), has.alias("has"), F.lower(F.element_at("pred", F.col("pred_attr"))).alias("pred_value"), gt_value(F.col("gt"), F.col("gt_attrs")).alias("gt_value"))
    if verdicts is not None:
        d = d.join(verdicts.select("pred_value", "gt_value", "result"), ["pred_value", "gt_value"], "left")
    else:
        d = d.withColumn("result", F.lit(None).cast("boolean"))
    p, g = is_null(F.col("pred_value")), is_null(F.col("gt_value"))
    same = (F.col("pred_value") == F.col("gt_value")) | F.contains("pred_value", F.col("gt_value"))
    outcome = F.when(~F.col("has"), F.when(~g, "FN").otherwise("none")).when(p & g, "TP").when(g, "FP").when(p, "FN").when(same | F.coalesce("result", F.lit(False)), "TP").otherwise("FP")
    return d.select("doc_id", "gt_table", "attr", "pred_value", "gt_value", outcome.alias("outcome"))


def extra_attributes(checked: DataFrame, name_map: DataFrame) -> DataFrame:
    """(doc_id, attr): predicted values beyond the name map, each a false positive."""
    values = checked.where("gt_table is not null").select("doc_id", "gt_table", F.explode("pred").alias("pred_attr", "v")).where(~is_null(F.col("v")))
    return values.join(small_side(name_map.select("gt_table", "pred_attr")), ["gt_table", "pred_attr"], "left_anti").select("doc_id", F.col("pred_attr").alias("attr"))


def document_counts(checked: DataFrame, name_map: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """(doc_id, tp, fp, fn, tn, table_ok, correct): irrelevant documents are correct whatever was predicted; a wrong table
    counts each truth as missing and is correct only if there is none."""
    cmp = compare_attributes(checked, name_map, verdicts)
    right = cmp.groupBy("doc_id").agg(F.count_if(F.col("outcome") == "TP").alias("tp"), F.count_if(F.col("outcome") == "FP").alias("fp"), F.count_if(F.col("outcome") == "FN").alias("fn"), (F.count_if(F.col("outcome").isin("FP", "FN")) == 0).alias("all_right"))
    extra = extra_attributes(checked, name_map).groupBy("doc_id").agg(F.count(F.lit(1)).alias("extra"))
    per_table = small_side(name_map.groupBy("gt_table").agg(F.collect_list("gt_attrs").alias("maps")))
    d = checked.join(right, "doc_id", "left").join(extra, "doc_id", "left").join(per_table, "gt_table", "left")
    irrelevant = F.col("gt_table").isNull()
    values = F.size(F.filter(F.map_values("pred"), lambda v: ~is_null(v)))
    truths = F.coalesce(F.size(F.filter("maps", lambda a: ~is_null(gt_value(F.col("gt"), a)))), F.lit(0))
    wrong = ~irrelevant & ~F.col("table_ok")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return d.select(
        "doc_id",
        F.when(irrelevant | wrong, 0).otherwise(zero("tp")).cast("long").alias("tp"),
        F.when(irrelevant, F.when(F.col("pred_table").isNotNull(), values).otherwise(0)).when(wrong, zero("extra")).otherwise(zero("fp") + zero("extra")).cast("long").alias("fp"),
        F.when(irrelevant, 0).when(wrong, truths).otherwise(zero("fn")).cast("long").alias("fn"),
        F.when(irrelevant & F.col("pred_table").isNull(), 1).otherwise(0).cast("long").alias("tn"),
        F.when(irrelevant, F.col("pred_table").isNull()).otherwise(F.col("table_ok")).alias("table_ok"),
        F.when(irrelevant, True).when(wrong, truths == 0).otherwise(F.coalesce("all_right", F.lit(True)) & (zero("extra") == 0)).alias("correct"),
    )


def totals(counts: DataFrame) -> DataFrame:
    return counts.agg(*[F.sum(c).cast("long").alias(c) for c in ("tp", "fp", "fn", "tn")], F.count_if("correct").alias("correct_documents"), F.count(F.lit(1)).alias("documents"))


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def metrics(t: DataFrame) -> DataFrame:
    """One row of totals with recall, precision, F1 and document accuracy; 0 where nothing is counted."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    r, p = ratio(tp, tp + fn), ratio(tp, tp + fp)
    return t.select(r.alias("recall"), p.alias("precision"), ratio(2 * r * p, r + p).alias("f1"), ratio(F.col("correct_documents"), F.col("documents")).alias("accuracy"))


def attribute_accuracy(compared: DataFrame) -> DataFrame:
    """(gt_table, attr, total, correct, accuracy) with a subtotal for each table and one for all (null attr, null table)."""
    return compared.where("outcome <> 'none'").rollup("gt_table", "attr").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("outcome") == "TP").alias("correct")).withColumn("accuracy", ratio(F.col("correct"), F.col("total")))


def table_confusion(pairs: DataFrame) -> DataFrame:
    p, g = F.col("pred_table"), F.col("gt_table")
    return pairs.agg(F.count_if(p.eqNullSafe(g) & g.isNotNull()).alias("tp"), F.count_if(p.isNotNull() & ~p.eqNullSafe(g)).alias("fp"), F.count_if(g.isNotNull() & ~p.eqNullSafe(g)).alias("fn"), F.count_if(p.isNull() & g.isNull()).alias("tn"))


def committee_vote(votes: DataFrame) -> DataFrame:
    """(pred_value, gt_value, result, disagree) of (.., vote): a tie, and no vote at all, is true."""
    yes, no = F.count_if("vote"), F.count_if(~F.col("vote"))
    return votes.groupBy("pred_value", "gt_value").agg((yes >= no).alias("result"), ((yes > 0) & (no > 0)).alias("disagree"))


def missing_verdicts(compared: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Distinct pairs of values that still need a verdict."""
    p, g = F.col("pred_value"), F.col("gt_value")
    need = compared.where(~is_null(p) & ~is_null(g) & ~F.contains(p, g)).select("pred_value", "gt_value").distinct()
    return need.join(verdicts.select("pred_value", "gt_value"), ["pred_value", "gt_value"], "left_anti")


def set_counts(a: Column, b: Column) -> list[Column]:
    """True positives, false positives and false negatives of a predicted set against a true one."""
    return [F.size(F.array_intersect(a, b)).alias("tp"), F.size(F.array_except(a, b)).alias("fp"), F.size(F.array_except(b, a)).alias("fn")]
