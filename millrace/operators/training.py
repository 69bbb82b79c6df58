"""Training of classifiers on grouped rows: even folds of whole groups, preparation fitted on training rows only, models kept with their metadata."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Bucketizer, Imputer, OneHotEncoder, SQLTransformer, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.operators.durable import durable
from millrace.operators.series import reindexed

# Folds


def deal(kinds: dict[tuple[int, ...], int], folds: int) -> dict[tuple[int, ...], list[int]]:
    """How many groups of each kind go to each fold. kinds: rows per class -> number of such groups.

    Kinds of the largest deviation between their classes come first. As many of a kind go to each fold
    alike; each one over goes to the fold where the classes' shares stay most even over the folds,
    of equally good ones to that of fewest rows, then to the first.
    """
    classes = len(next(iter(kinds), ()))
    total = [sum(k[c] * m for k, m in kinds.items()) for c in range(classes)]
    held = [[0] * classes for _ in range(folds)]

    def spread(values: list[float]) -> float:
        mean = sum(values) / len(values)
        return math.sqrt(sum((v - mean) ** 2 for v in values) / len(values))

    def cost(kind: tuple[int, ...], f: int) -> tuple[float, int, int]:
        shares = [[(held[g][c] + (kind[c] if g == f else 0)) / total[c] for g in range(folds)] for c in range(classes) if total[c]]
        return (round(sum(map(spread, shares)) / max(1, len(shares)), 12), sum(held[f]), f)

    out = {}
    for kind in sorted(kinds, key=lambda k: (-spread(list(map(float, k))), k)):
        each, over = divmod(kinds[kind], folds)
        out[kind] = [each] * folds
        for f in range(folds):
            held[f] = [h + each * k for h, k in zip(held[f], kind)]
        for _ in range(over):
            f = min(range(folds), key=lambda f: cost(kind, f))
            out[kind][f] += 1
            held[f] = [h + k for h, k in zip(held[f], kind)]
    return out


def _rounded(n: Column, digits: int | None) -> Column:
    """A count at so many significant digits; coarser kinds are fewer."""
    if digits is None:
        return n
    unit = F.pow(10.0, F.greatest(F.lit(0), F.floor(F.log10(F.greatest(n, F.lit(1)))) - (digits - 1)))
    return (F.round(n / unit) * unit).cast("long")


def group_folds(rows: DataFrame, group: str, label: str, folds: int = 5, seed: int = 42, most_kinds: int = 100_000) -> DataFrame:
    """(group, fold): folds that split no group and hold alike shares of every class. label: a column of few different values.

    Groups of the same rows per class are alike, so only the numbers of each kind are dealt out on the driver; if
    there are over most_kinds, counts are dealt at three, two or one significant digits instead. Which
    groups of a kind go where is decided by hash; they are numbered in parts of some 100,000. A null group
    is a group, a null label a class.
    """
    classes = [r[0] for r in rows.select(F.col(label).cast("string").alias("c")).distinct().orderBy("c").collect()]
    counts = [F.count(F.when(F.col(label).cast("string").eqNullSafe(F.lit(c)), 1)) for c in classes]
    per = durable(rows.groupBy(F.col(group).alias("group")).agg(F.array(*counts).alias("n")) if classes else rows.select(F.col(group).alias("group"), F.array(F.lit(0)).cast("array<bigint>").alias("n")))
    for digits in (None, 3, 2, 1):
        kinds = per.select("group", F.transform("n", lambda n: _rounded(n, digits)).alias("kind"))  # noqa: B023
        sizes = kinds.groupBy("kind").count()
        if digits == 1 or sizes.count() <= most_kinds:
            break
    quota = deal({tuple(r.kind): r["count"] for r in sizes.collect()}, folds)
    parts = max(1, per.count() // 100_000)
    placed = kinds.withColumn("h", F.xxhash64("group", F.lit(seed))).withColumn("part", F.pmod("h", F.lit(parts)))
    before = placed.groupBy("kind", "part").count().withColumn("before", F.coalesce(F.sum("count").over(W.partitionBy("kind").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    numbered = placed.withColumn("i", F.row_number().over(W.partitionBy("kind", "part").orderBy("h", "group"))).join(before.select("kind", "part", "before"), ["kind", "part"])
    ends = [(list(k), [sum(q[: f + 1]) for f in range(folds)]) for k, q in quota.items()]
    ends_df = per.sparkSession.createDataFrame(ends, "kind array<bigint>, ends array<bigint>")
    at = F.size(F.filter("ends", lambda e: e < F.col("i") + F.col("before")))
    return numbered.join(F.broadcast(ends_df), "kind").select(F.col("group").alias(group), at.alias("fold"))


# Preparation and models


def preparation(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str], out: str = "features") -> list:
    """Pipeline stages that turn columns into one vector, with what they need learnt from `train` alone.

    A null category becomes the most frequent one, of equally frequent ones the first by spelling; a category that train
    doesn't have gives zeros in all of its columns. A null number becomes the median.
    """
    stages, parts = [], []
    if categorical:
        texts = train.select(*[F.col(c).cast("string").alias(c) for c in categorical])
        labels = [StringIndexer(inputCol=c, outputCol="__i").fit(texts.where(F.col(c).isNotNull())).labels for c in categorical]
        quoted = lambda v: "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
        filled = ", ".join(f"coalesce(cast(`{c}` AS string), {quoted(v[0] if v else '')}) AS `__c_{c}`" for c, v in zip(categorical, labels))
        stages.append(SQLTransformer(statement=f"SELECT *, {filled} FROM __THIS__"))
        seen = [c for c, v in zip(categorical, labels) if v]
        if seen:
            stages += [StringIndexerModel.from_labels(v, inputCol=f"__c_{c}", outputCol=f"__i_{c}", handleInvalid="keep") for c, v in zip(categorical, labels) if v]
            stages.append(OneHotEncoder(inputCols=[f"__i_{c}" for c in seen], outputCols=[f"__h_{c}" for c in seen], dropLast=True))  # the last is the unseen one
            parts += [f"__h_{c}" for c in seen]
    if numeric:
        stages.append(SQLTransformer(statement="SELECT *, " + ", ".join(f"cast(`{c}` AS double) AS `__d_{c}`" for c in numeric) + " FROM __THIS__"))
        stages.append(Imputer(inputCols=[f"__d_{c}" for c in numeric], outputCols=[f"__m_{c}" for c in numeric], strategy="median"))
        parts = [f"__m_{c}" for c in numeric] + parts
    return [*stages, VectorAssembler(inputCols=parts, outputCol=out, handleInvalid="keep")]


#: Kinds of models, with how rows are weighted against a rare class.
BALANCED = {"forest": True, "boosting": True, "scaled": False, "logistic": True}


def _classifier(kind: str, label: str, trees: int, seed: int):
    same = {"featuresCol": "features", "labelCol": label, "weightCol": "__w"}
    if kind == "forest":
        return RandomForestClassifier(**same, numTrees=trees, seed=seed)
    if kind in ("boosting", "scaled"):
        return GBTClassifier(**same, maxIter=trees, seed=seed)
    return LogisticRegression(**same, maxIter=50)


def bucketizer(train: DataFrame, columns: Sequence[str], out: Sequence[str], most: int = 32) -> Bucketizer:
    """Cuts numbers into at most `most` bins, between all values where there are so few, else at quantiles of all rows."""
    value = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    probs = F.array(*[F.lit(i / most) for i in range(1, most)])
    found = train.agg(*[F.approx_count_distinct(value(c)) for c in columns], *[F.percentile_approx(value(c), probs, 10_000) for c in columns]).first()
    splits = []
    for c, about, cuts in zip(columns, found, found[len(columns) :]):
        values = sorted(r[0] for r in train.select(value(c)).distinct().dropna().collect()) if about <= 2 * most else None
        if values and len(values) <= most:
            cuts = [(a + b) / 2 for a, b in zip(values, values[1:])] or values
        splits.append([-math.inf, *sorted(set(cuts or [0.0])), math.inf])
    return Bucketizer(splitsArray=splits, inputCols=list(columns), outputCols=list(out), handleInvalid="error")


def _boosted(rows: DataFrame, stages: list, classifier: GBTClassifier, label: str) -> PipelineModel:
    """Trees see bins only, so rows of equal bins and label are trained on as one row of their weight; work after one pass grows with the kinds of rows."""
    *first, assembler = stages
    made = Pipeline(stages=first).fit(rows)
    ready, inputs = made.transform(rows), assembler.getInputCols()
    numbers, names = [c for c in inputs if c.startswith("__m_")], [c for c in inputs if c.startswith("__h_")]
    more, to = [], [f"__b_{c[4:]}" for c in numbers]
    if numbers:
        more.append(bucketizer(ready, numbers, to))
        ready = more[0].transform(ready)
    kinds = ready.groupBy(*to, *[f"__i_{c[4:]}" for c in names], label).agg(F.sum("__w").alias("__w"), *[F.first(c).alias(c, metadata=ready.schema[c].metadata) for c in names])
    vectors = VectorAssembler(inputCols=[*to, *names], outputCol="features", handleInvalid="keep")
    return PipelineModel([*made.stages, *more, vectors, classifier.fit(vectors.transform(durable(kinds)))])


def fitted(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str], label: str, kind: str = "forest", trees: int = 20, seed: int = 42) -> PipelineModel:
    """A pipeline of preparation and model. Classes weigh alike ("scaled": each positive row as many times as there are negative ones to a positive)."""
    pos, n = train.agg(F.count(F.when(F.col(label) == 1, 1)), F.count("*")).first()
    pos, neg = max(pos, 1), max(n - pos, 1)
    weight = (n / (2 * pos), n / (2 * neg)) if BALANCED[kind] else (neg / pos, 1.0)
    rows = train.withColumn("__w", F.when(F.col(label) == 1, weight[0]).otherwise(weight[1]))
    stages, classifier = preparation(train, numeric, categorical), _classifier(kind, label, trees, seed)
    if kind in ("boosting", "scaled"):
        return _boosted(rows, stages, classifier, label)
    return Pipeline(stages=[*stages, classifier]).fit(rows)


def scored(rows: DataFrame, model: PipelineModel) -> DataFrame:
    """rows with score, the probability of class 1."""
    return model.transform(rows.withColumn("__w", F.lit(1.0))).select(*[c for c in rows.columns if c != "score"], vector_to_array("probability")[1].alias("score"))


def out_of_fold(rows: DataFrame, dealt: DataFrame, group: str, numeric: Sequence[str], categorical: Sequence[str], label: str, kind: str = "forest", trees: int = 20, seed: int = 42) -> DataFrame:
    """rows with fold and score, each scored by a pipeline that saw none of its fold. dealt: (group, fold); by rows if group is a row's key."""
    placed = durable(rows.join(dealt, rows[group].eqNullSafe(dealt[group])).drop(dealt[group]))
    out = None
    for f in sorted(r.fold for r in placed.select("fold").distinct().collect()):
        model = fitted(placed.where(F.col("fold") != f), numeric, categorical, label, kind, trees, seed)
        part = scored(placed.where(F.col("fold") == f), model)
        out = part if out is None else out.unionByName(part)
    return placed.withColumn("score", F.lit(None).cast("double")) if out is None else out


def importances(model: PipelineModel) -> DataFrame:
    """(feature, weight) of a pipeline's fitted trees; a category's columns are named column=value."""
    names: dict[str, list[str]] = {}
    for s in model.stages:
        if isinstance(s, StringIndexerModel):
            c = s.getInputCol()[4:]
            names[f"__h_{c}"] = [f"{c}={v}" for v in s.labels]
        if isinstance(s, VectorAssembler):
            inputs = s.getInputCols()
    flat = [x for c in inputs for x in names.get(c, [c[4:]])]
    weights = model.stages[-1].featureImportances.toArray()
    spark = SparkSession.getActiveSession()
    return spark.createDataFrame([(n, float(w)) for n, w in zip(flat, weights, strict=True)], "feature string, weight double")


# Artifacts


@dataclass(frozen=True)
class Artifact:
    """A fitted pipeline and what is known about it: its columns, threshold and figures."""

    model: PipelineModel
    metadata: dict


def save(artifact: Artifact, path: str) -> None:
    """Write pipeline and metadata below a folder that Spark can write to, replacing what is there."""
    artifact.model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(json.dumps(artifact.metadata, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")


def load(spark: SparkSession, path: str) -> Artifact:
    return Artifact(PipelineModel.load(f"{path}/model"), json.loads(spark.read.text(f"{path}/metadata").first().value))


def judged(rows: DataFrame, artifact: Artifact) -> DataFrame:
    """rows with score and said (1 from the artifact's threshold on). Columns that the model was fitted on and rows don't have count as null."""
    meta = artifact.metadata
    more = [c for c in [*meta["numeric"], *meta["categorical"]] if c not in rows.columns]
    full = reindexed(rows, [*rows.columns, *more], "string") if more else rows
    out = scored(full, artifact.model).withColumn("said", (F.col("score") >= meta["threshold"]).cast("int"))
    return out.select(*[c for c in rows.columns if c not in ("score", "said")], "score", "said")
