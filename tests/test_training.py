import json
import random
import subprocess
import sys

import numpy as np
from pyspark.sql import functions as F

from millrace.operators import evaluation, training


def plain_folds(groups, folds):
    """Greedy deal of single groups {group: (n per class)}: largest deviation first, to the fold that leaves shares most even."""
    total = np.sum(list(groups.values()), axis=0)
    held = np.zeros((folds, len(total)))
    for g in sorted(groups, key=lambda g: (-np.std(groups[g]), groups[g])):
        cost = []
        for f in range(folds):
            more = held.copy()
            more[f] += groups[g]
            cost.append((round(float(np.std(more / np.maximum(total, 1), axis=0).mean()), 12), held[f].sum(), f))
        held[min(cost)[2]] += groups[g]
    return held


def uneven(held):
    return np.std(held / np.maximum(held.sum(axis=0), 1), axis=0).mean()


def grouped(rng, n, rare):
    return {g: (rng.randrange(1, 30), rng.randrange(1, 9) if rng.random() < rare else 0) for g in range(n)}


def test_folds_against_the_plain_deal(spark):
    rng = random.Random(3)
    for n, rare, most in ((60, 0.2, 10**5), (300, 0.5, 10**5), (300, 0.5, 20), (7, 1.0, 10**5), (2, 0.5, 10**5)):
        groups = grouped(rng, n, rare)
        rows = spark.createDataFrame([(g, y) for g, k in groups.items() for y in (0, 1) for _ in range(k[y])], "g long, y int")
        got = {r.g: r.fold for r in training.group_folds(rows, "g", "y", most_kinds=most).collect()}
        assert set(got) == set(groups)  # each group in one fold
        assert set(got.values()) <= set(range(5))
        held = np.zeros((5, 2))
        for g, f in got.items():
            held[f] += groups[g]
        assert uneven(held) <= uneven(plain_folds(groups, 5)) + (0.005 if most > 20 else 0.03)


def test_folds_of_awkward_groups(spark):
    rows = spark.createDataFrame([(None, 1), (None, None), ("a", 0), ("a", 0), ("b", None)] + [(f"r{i}", i % 2) for i in range(100)], "g string, y int")
    got = training.group_folds(rows, "g", "y").collect()
    assert sorted(str(r.g) for r in got) == sorted({str(r.g) for r in rows.collect()})
    sizes = np.bincount([r.fold for r in got if r.g and r.g.startswith("r")], minlength=5)
    assert sizes.tolist() == [20] * 5
    assert training.group_folds(rows.limit(0), "g", "y").collect() == []


def data(spark, n=240):
    rng = random.Random(2)
    rows = [(i, f"d{i // 6}", rng.choice(["N", "N", "S", None]), None if i % 11 == 0 else float(i % 2) + rng.random(), rng.random(), i % 2) for i in range(n)]
    return spark.createDataFrame(rows, "id long, day string, wind string, a double, b double, y int")


def test_preparation_learns_from_train_only(spark):
    train = spark.createDataFrame([("N", 1.0), ("N", 3.0), ("it's", 8.0), (None, None)], "wind string, a double")
    test = spark.createDataFrame([("E", None), (None, 2.0), ("it's", 5.0)], "wind string, a double")
    from pyspark.ml import Pipeline

    made = Pipeline(stages=training.preparation(train, ["a"], ["wind"])).fit(train)
    assert [r.features.toArray().tolist() for r in made.transform(test).collect()] == [[3.0, 0.0, 0.0], [2.0, 1.0, 0.0], [5.0, 0.0, 1.0]]
    two = spark.createDataFrame([("N", "x"), ("S", "x"), ("W", "x")], "wind string, sky string")
    both = Pipeline(stages=training.preparation(two, [], ["wind", "sky"])).fit(two)
    assert [r.features.toArray().tolist() for r in both.transform(two).collect()] == [[1.0, 0.0, 0.0, 1.0], [0.0, 1.0, 0.0, 1.0], [0.0, 0.0, 1.0, 1.0]]
    none = spark.createDataFrame([(None, 1.0)], "wind string, a double")
    bare = Pipeline(stages=training.preparation(none, ["a"], ["wind"])).fit(none)
    assert [r.features.toArray().tolist() for r in bare.transform(test).collect()] == [[1.0], [2.0], [5.0]]


def test_out_of_fold_with_a_category_that_only_one_fold_has(spark):
    rows = data(spark).withColumn("wind", F.when(F.col("day") == "d3", "only here").otherwise(F.col("wind")))
    folds = training.group_folds(rows, "day", "y", 3)
    for kind in ("forest", "scaled"):
        got = training.out_of_fold(rows, folds, "day", ["a", "b"], ["wind"], "y", kind, trees=4).collect()
        assert sorted(r.id for r in got) == list(range(240))
        assert all(len({r.fold for r in got if r.day == d}) == 1 for d in {r.day for r in got})
        assert sum((r.score > 0.5) == (r.y == 1) for r in got) > 190


def test_row_folds_flatter_where_days_repeat(spark):
    """Rows of a day are alike: split over folds, they are recognised; kept together, they aren't."""
    rng = random.Random(8)
    days = {d: (rng.random(), rng.randrange(2)) for d in range(60)}
    rows = spark.createDataFrame([(d * 10 + k, d, v + rng.random() / 1000, y) for d, (v, y) in days.items() for k in range(8)], "id long, day long, a double, y int")
    of = lambda key: evaluation.auc(training.out_of_fold(rows, training.group_folds(rows, key, "y", 4), key, ["a"], [], "y", trees=10), "score", "y").first().roc_auc
    assert of("id") > of("day") + 0.15


def test_artifact_in_another_session(spark, tmp_path):
    rows = data(spark)
    model = training.fitted(rows, ["a", "b"], ["wind"], "y", trees=5)
    meta = {"numeric": ["a", "b"], "categorical": ["wind"], "threshold": 0.4, "target": "y"}
    path = str(tmp_path / "kept")
    training.save(training.Artifact(model, {"old": 1}), path)
    training.save(training.Artifact(model, meta), path)
    rows.write.parquet(str(tmp_path / "rows"))
    want = {r.id: (r.score, r.said) for r in training.judged(rows, training.Artifact(model, meta)).collect()}
    code = f"""
import json
from pyspark.sql import SparkSession
from millrace.operators import training
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
kept = training.load(spark, {path!r})
rows = training.judged(spark.read.parquet({str(tmp_path / "rows")!r}), kept)
print(json.dumps([kept.metadata, [[r.id, r.score, r.said] for r in rows.collect()]]))
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, timeout=200)
    kept, got = json.loads(done.stdout.strip().splitlines()[-1])
    assert kept == meta
    assert {i: (s, said) for i, s, said in got} == want
    again = training.load(spark, path)
    assert training.judged(rows.drop("b", "wind").withColumn("said", F.lit("x")), again).columns == ["id", "day", "a", "y", "score", "said"]
    weights = {r.feature: r.weight for r in training.importances(again.model).collect()}
    assert set(weights) == {"a", "b", "wind=N", "wind=S"}
    assert max(weights, key=weights.get) == "a" and abs(sum(weights.values()) - 1) < 1e-9
