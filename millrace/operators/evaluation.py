"""Evaluation of rare-event classifiers: thresholds, ranks, votes, leakage-free folds."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.operators import training
from millrace.operators.durable import durable


def binary(label: Column, cut: float = 0.5) -> Column:
    return (label >= cut).cast("int")


def _rates(counts: DataFrame) -> DataFrame:
    zero = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    out = counts.withColumn("precision", zero(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", zero(F.col("tp"), F.col("tp") + F.col("fn")))
    return out.withColumn("f1", zero(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def confusion(scored: DataFrame, score: str, label: str, threshold: float, keys: list[str] = ()) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1 at a threshold; a zero denominator gives 0."""
    said, true = F.col(score) >= threshold, F.col(label) == 1
    n = lambda t: F.count(F.when(t, 1))
    return _rates(scored.groupBy(*keys).agg(n(said & true).alias("tp"), n(said & ~true).alias("fp"), n(~said & true).alias("fn"), n(~said & ~true).alias("tn")))


def sweep(scored: DataFrame, score: str, label: str, low: float, high: float, steps: int) -> DataFrame:
    """confusion at `steps` thresholds from low to high, from one pass.

    Scores fall into the interval below the next threshold; counts of intervals are summed from above.
    """
    width = (high - low) / (steps - 1)
    cuts = [round(low + i * width, 10) for i in range(steps)]
    if width > 1e-6:  # where a score must lie, but for rounding, and the three thresholds there
        guess = F.floor(F.greatest(F.least((F.col(score) - low) / width, F.lit(steps + 1.0)), F.lit(0.0)))
        start = F.greatest(guess - 1, F.lit(0).cast("long")).cast("int")
        reached = lambda d: F.coalesce((F.try_element_at(F.array(*map(F.lit, cuts)), start + d) <= F.col(score)).cast("int"), F.lit(0))
        bin_ = F.when(F.col(score).isNull(), 0).when(F.isnan(F.col(score).cast("double")), steps).otherwise(F.least(start, F.lit(steps)) + reached(1) + reached(2) + reached(3))
    else:
        bin_ = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col(score)))
    per = scored.groupBy(bin_.alias("bin")).agg(F.count(F.when(F.col(label) == 1, 1)).alias("p"), F.count(F.when(F.col(label) != 1, 1)).alias("n"))  # at most steps + 1 rows
    rows = per.agg(F.collect_list(F.struct("bin", "p", "n")).alias("b"))
    at = rows.select("b", F.posexplode(F.array(*map(F.lit, cuts))).alias("i", "threshold"))
    total = lambda f, t: F.aggregate(F.filter("b", t), F.lit(0).cast("long"), lambda a, x: a + x[f])
    above, below = lambda x: x["bin"] > F.col("i"), lambda x: x["bin"] <= F.col("i")
    return _rates(at.select("threshold", total("p", above).alias("tp"), total("n", above).alias("fp"), total("p", below).alias("fn"), total("n", below).alias("tn")))


def best_f1(swept: DataFrame) -> DataFrame:
    """The first threshold of the largest f1."""
    return swept.orderBy(F.desc("f1"), "threshold").limit(1)


def best_recall(swept: DataFrame, floor: float = 0.2) -> DataFrame:
    """The threshold of most recall among those of at least `floor` precision, ties to the lower; best_f1 where none is."""
    return swept.withColumn("floor_met", F.col("precision") >= floor).orderBy(F.desc("floor_met"), F.desc(F.when(F.col("floor_met"), F.col("recall")).otherwise(F.col("f1"))), "threshold").limit(1)


def youden(swept: DataFrame) -> DataFrame:
    """The threshold of the largest true positive rate less false positive rate."""
    j = F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1)) - F.col("fp") / F.greatest(F.col("fp") + F.col("tn"), F.lit(1))
    return swept.withColumn("j", j).orderBy(F.desc("j"), F.desc("threshold")).limit(1)


def auc(scored: DataFrame, score: str, label: str, cells: int = 4096) -> DataFrame:
    """roc_auc (ties count half) and average_precision.

    Distinct scores are counted first. Cells of the score range are then summed from above, and each
    cell's scores are cumulated apart and shifted by what lies above them, so no task orders them all.
    """
    per = scored.groupBy(F.col(score).cast("double").alias("s")).agg(F.sum(F.col(label)).alias("p"), F.sum(1 - F.col(label)).alias("n"))
    lo, hi = scored.agg(F.min(score).cast("double"), F.max(score).cast("double")).first()
    wide = (hi or 0.0) - (lo or 0.0)
    per = per.withColumn("cell", F.floor((F.col("s") - (lo or 0.0)) / wide * (cells - 1)) if wide else F.lit(0).cast("long"))
    over = W.orderBy(F.desc("cell")).rowsBetween(W.unboundedPreceding, -1)  # a row per cell
    above = per.groupBy("cell").agg(F.sum("p").alias("p"), F.sum("n").alias("n")).select("cell", *[F.coalesce(F.sum(c).over(over), F.lit(0)).alias(f"a{c}") for c in ("p", "n")])
    w = W.partitionBy("cell").orderBy(F.desc("s")).rowsBetween(W.unboundedPreceding, 0)
    cum = per.join(F.broadcast(above), "cell").withColumn("cp", F.sum("p").over(w) + F.col("ap")).withColumn("cn", F.sum("n").over(w) + F.col("an"))
    pairs = F.sum(F.col("n") * (F.col("cp") - F.col("p") / 2))
    ap = F.sum(F.col("p") * F.col("cp") / (F.col("cp") + F.col("cn")))
    return cum.agg((pairs / (F.sum("p") * F.sum("n"))).alias("roc_auc"), (ap / F.sum("p")).alias("average_precision"))


def majority(votes: list[Column], need: int = 2) -> Column:
    total = votes[0].cast("int")
    for v in votes[1:]:
        total = total + v.cast("int")
    return (total >= need).cast("int")


def error_overlap(rows: DataFrame, models: list[str], label: str) -> DataFrame:
    """For each ordered pair of models: shared errors and their percent of the first one's errors (diagonal 100, 0 without errors)."""
    wrong = {m: F.col(m) != F.col(label) for m in models}
    cells = [(a, b) for a in models for b in models]
    n = rows.agg(*[F.count(F.when(wrong[a] & wrong[b], 1)).alias(f"{i}") for i, (a, b) in enumerate(cells)])
    own = {a: i for i, (a, b) in enumerate(cells) if a == b}
    listed = F.array(*[F.struct(F.lit(a).alias("model"), F.lit(b).alias("other"), F.col(f"{i}").alias("shared"), F.when(F.lit(a == b), 100.0).when(F.col(f"{own[a]}") == 0, 0.0).otherwise(100 * F.col(f"{i}") / F.col(f"{own[a]}")).alias("percent")) for i, (a, b) in enumerate(cells)])
    return n.select(F.inline(listed))


def agreement(rows: DataFrame, models: list[str], label: str) -> DataFrame:
    """How many rows had 0, 1, ... models right."""
    right = sum(((F.col(m) == F.col(label)).cast("int") for m in models[1:]), (F.col(models[0]) == F.col(label)).cast("int"))
    return rows.groupBy(right.alias("right")).agg(F.count("*").alias("n"))


def error_tag(said: Column, label: Column) -> Column:
    return F.when((said == 1) & (label == 0), "FP").when((said == 0) & (label == 1), "FN")


def fold(group: Column, folds: int = 5) -> Column:
    """A fold that never splits a group."""
    return F.pmod(F.xxhash64(group), F.lit(folds)).cast("int")


def out_of_fold(rows: DataFrame, features: list[str], label: str, group: str, kind: str = "forest", folds: int = 5, seed: int = 42, trees: int = 20) -> DataFrame:
    """rows with `score` predicted by models that saw no row of the same group; imputation and class weights are fitted inside the folds too."""
    dealt = durable(rows.withColumn("__fold", fold(F.col(group), folds)))  # each fold reads it several times
    made = {
        "forest": lambda: RandomForestClassifier(featuresCol="__x", labelCol=label, weightCol="__w", numTrees=trees, seed=seed),
        "boosting": lambda: GBTClassifier(featuresCol="__x", labelCol=label, weightCol="__w", maxIter=trees, seed=seed),
        "logistic": lambda: LogisticRegression(featuresCol="__x", labelCol=label, weightCol="__w", maxIter=50),
    }[kind]
    parts = []
    for k in range(folds):
        seen = dealt.where(F.col("__fold") != k)
        pos = seen.agg(F.avg(label)).first()[0] or 0.0
        weight = F.when(F.col(label) == 1, 0.5 / max(pos, 1e-9)).otherwise(0.5 / max(1 - pos, 1e-9))
        steps = [Imputer(inputCols=features, outputCols=[f"__i_{f}" for f in features], strategy="median"), VectorAssembler(inputCols=[f"__i_{f}" for f in features], outputCol="__x"), made()]
        model = Pipeline(stages=steps).fit(seen.withColumn("__w", weight))
        scored = model.transform(dealt.where(F.col("__fold") == k).withColumn("__w", F.lit(1.0)))
        parts.append(scored.select(*rows.columns, F.col("__fold").alias("fold"), vector_to_array("probability")[1].alias("score")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def masked_beyond(value: Column, hour: Column, model: Column, most: dict[str, int], otherwise: int = 48) -> Column:
    """Predictions only up to a model's last hour."""
    limit = F.lit(otherwise)
    for m, h in most.items():
        limit = F.when(model == m, h).otherwise(limit)
    return F.when(hour <= limit, value)


def objectives(swept: DataFrame, recall_floor: float = 0.5, precision_floor: float = 0.1, miss_cost: float = 10.0) -> DataFrame:
    """(objective, threshold): most precision at a recall floor, most recall at a precision floor, least cost of misses and false alarms. Ties go to the lowest threshold; a floor that none meets is dropped."""
    pick = lambda *order: F.min(F.struct(*order, F.col("threshold"))).getField("threshold")
    one = swept.agg(
        pick((F.col("recall") < recall_floor).alias("a"), (-F.col("precision")).alias("b")).alias("precision"),
        pick((F.col("precision") < precision_floor).alias("a"), (-F.col("recall")).alias("b")).alias("recall"),
        pick((F.col("fp") + miss_cost * F.col("fn")).alias("a")).alias("cost"),
    )
    return one.select(F.inline(F.array(*[F.struct(F.lit(k).alias("objective"), F.col(k).alias("threshold")) for k in ("precision", "recall", "cost")])))


def row_fold(key: Column, folds: int = 5) -> Column:
    """A fold by row, whatever its group."""
    return F.pmod(F.conv(F.substring(F.md5(key.cast("string")), 1, 6), 16, 10).cast("long"), F.lit(folds)).cast("int")


def regression(rows: DataFrame, features: list[str], target: str, group: str, folds: int = 3, trees: int = 8, seed: int = 42) -> DataFrame:
    """One row (n, mae, r2) of gradient-boosted trees' predictions on folds that never split a group. Features are cut into the 32 bins of a tree first; all rows of equal bins are trained on as one weighted row."""
    dealt = rows.withColumn("__fold", fold(F.col(group), folds))
    parts, cells = [], [f"__b_{f}" for f in features]
    for k in range(folds):
        seen = dealt.where(F.col("__fold") != k)
        cut = training.bucketizer(seen, features, cells)
        per = cut.transform(seen).groupBy(*cells).agg(F.avg(target).alias("__y"), F.count("*").cast("double").alias("__n"))  # squared errors around these means have the same least trees
        boosted = GBTRegressor(featuresCol="__x", labelCol="__y", weightCol="__n", predictionCol="__p", maxIter=trees, maxDepth=4, seed=seed)
        vectors = VectorAssembler(inputCols=cells, outputCol="__x")
        model = PipelineModel([cut, vectors, boosted.fit(vectors.transform(durable(per)))])
        parts.append(model.transform(dealt.where(F.col("__fold") == k)).select(F.col(target).cast("double").alias("y"), F.col("__p").alias("p")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    error = F.sum(F.pow(F.col("y") - F.col("p"), 2))
    return out.agg(F.count("*").alias("n"), F.avg(F.abs(F.col("y") - F.col("p"))).alias("mae"), (1 - error / (F.count("*") * F.var_pop("y"))).alias("r2"))
