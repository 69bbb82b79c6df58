import math
import random

from pyspark.sql import functions as F

from millrace.operators import evaluation, training


def test_features_are_made_once_for_all_folds(spark):
    made = spark.sparkContext.accumulator(0)

    def feature(i):
        made.add(1)
        return float(i % 7)

    rows = spark.range(60, numPartitions=2).select("id", F.udf(feature, "double")("id").alias("a"), (F.col("id") % 2).cast("double").alias("y"), (F.col("id") % 9).alias("g"))
    assert evaluation.out_of_fold(rows, ["a"], "y", "g", "logistic", folds=2).count() == 60
    assert made.value == 60


def test_bins_hold_few_values_apart_and_equal_shares_of_many(spark):
    rng = random.Random(1)
    rows = spark.createDataFrame([(float(i % 5), rng.random(), None, math.nan if i % 3 else 2.0) for i in range(4000)], "a double, b double, c double, d double")
    a, b, c, d = training.bucketizer(rows, ["a", "b", "c", "d"], ["p", "q", "r", "s"]).getSplitsArray()
    assert a == [-math.inf, 0.5, 1.5, 2.5, 3.5, math.inf] and c == [-math.inf, 0.0, math.inf] and d == [-math.inf, 2.0, math.inf]
    assert len(b) == 33 and all(abs(x - i / 32) < 0.05 for i, x in enumerate(b[1:-1], 1))


def test_boosted_trees_learn_from_kinds_of_rows(spark):
    rng = random.Random(2)
    data = [(i, rng.random(), rng.choice(["N", "S", None]), i % 2) for i in range(600)]
    rows = spark.createDataFrame([(i, v / 2 + y / 2 if i % 11 else None, w, y) for i, v, w, y in data], "id long, a double, w string, y int")
    model = training.fitted(rows, ["a"], ["w"], "y", "scaled", trees=2)
    assert [type(s).__name__ for s in model.stages].count("Bucketizer") == 1
    assert sum((r.score > 0.5) == (r.y == 1) for r in training.scored(rows, model).collect()) > 540


def test_sweep_at_its_thresholds(spark):
    cuts = [round(0.05 + i * 0.005, 10) for i in range(181)]
    scores = [*cuts, *[math.nextafter(c, 0) for c in cuts], *[math.nextafter(c, 1) for c in cuts], 0.0, 1.0, -5.0, 1e300, -1e300, None, math.nan]
    rows = spark.createDataFrame([(s, i % 2) for i, s in enumerate(scores)], "s double, y int")
    got = {r.threshold: (r.tp, r.fp) for r in evaluation.sweep(rows, "s", "y", 0.05, 0.95, 181).collect()}
    over = lambda s, c: s is not None and (math.isnan(s) or s >= c)
    assert got == {c: tuple(sum(over(s, c) for i, s in enumerate(scores) if i % 2 == y) for y in (1, 0)) for c in cuts}
