"""Queries of folds, models and their artifacts. Training and greedy deals can't be said in SQL; they are tested against plain versions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from millrace.operators import evaluation, ordering, training
from millrace.operators.durable import shared_dir
from millrace.plans.registry import query
from millrace.plans.registry import table as _t

_NUMBERS, _NAMES = ["o_totalprice", "age"], ["o_orderpriority", "day"]


def _orders(spark, sf):
    """Orders with what a model may know of them; their group is the day."""
    rows = _t(spark, sf, "orders").withColumn("date", F.to_date("o_orderdate"))
    return rows.select(
        "o_orderkey",
        "date",
        F.when(F.col("o_orderkey") % 7 > 0, F.col("o_totalprice")).alias("o_totalprice"),
        F.datediff(F.lit("1999-01-01").cast("date"), "date").alias("age"),
        "o_orderpriority",
        F.date_format("date", "E").alias("day"),
        (F.col("o_orderstatus") == "P").cast("int").alias("label"),
    )


@query()
def stratified_folds(spark, sf):
    """Per fold its days, orders and positive orders; no day is split."""
    rows = _orders(spark, sf)
    dealt = rows.join(training.group_folds(rows, "date", "label"), "date")
    return dealt.groupBy("fold").agg(F.countDistinct("date").alias("days"), F.count("*").alias("n"), F.sum("label").alias("positive"))


@query()
def stratified_oof(spark, sf):
    """Every order scored by a forest that saw no order of its day, categories and gaps prepared inside the folds."""
    rows = _orders(spark, sf)
    return training.out_of_fold(rows, training.group_folds(rows, "date", "label", 3), "date", _NUMBERS, _NAMES, "label", trees=5).select("o_orderkey", "fold", "score")


@query()
def leakage(spark, sf):
    """How well the same model seems to do when folds keep days together, and when they split them by row."""
    rows = _orders(spark, sf)
    out = None
    for name, key in (("days", "date"), ("rows", "o_orderkey")):
        found = training.out_of_fold(rows, training.group_folds(rows, key, "label", 3), key, _NUMBERS, _NAMES, "label", trees=5)
        one = evaluation.auc(found, "score", "label").select(F.lit(name).alias("folds"), "roc_auc", "average_precision")
        out = one if out is None else out.unionByName(one)
    return out


@query()
def model_artifact(spark, sf):
    """Orders judged by a model that was written with its threshold and figures, and read again."""
    rows = _orders(spark, sf)
    held = training.out_of_fold(rows, training.group_folds(rows, "date", "label", 3), "date", _NUMBERS, _NAMES, "label", "scaled", trees=3)
    best = evaluation.best_recall(evaluation.sweep(held, "score", "label", 0.05, 0.95, 181)).first()
    meta = {"numeric": _NUMBERS, "categorical": _NAMES, "target": "label", "threshold": best.threshold, "precision": best.precision, "recall": best.recall, "floor_met": best.floor_met, "rows": rows.count()}
    path = f"{shared_dir(spark)}/artifact-{uuid.uuid4().hex}"
    training.save(training.Artifact(training.fitted(rows, _NUMBERS, _NAMES, "label", "scaled", trees=3), meta), path)
    return training.judged(rows, training.load(spark, path)).select("o_orderkey", "score", "said")


@query()
def tree_importance(spark, sf):
    """The features on which a fitted forest splits most."""
    model = training.fitted(_orders(spark, sf), _NUMBERS, _NAMES, "label", trees=5)
    return ordering.strongest(training.importances(model), "feature", "weight")
