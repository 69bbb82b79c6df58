"""Sort modes and the registry of metrics behind them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.operators.durable import durable


class Metric(NamedTuple):
    """A metric that a user can choose: its label, its value, and how it is shown."""

    label: str
    value: Column
    shown: Column | None = None


def by(metrics: Mapping[str, Metric], key: str, descending: bool, tiebreak: str) -> list[Column]:
    """The order of a chosen metric, nulls last either way, ties by the tiebreak."""
    value = metrics[key].value
    return [value.desc_nulls_last() if descending else value.asc_nulls_last(), F.col(tiebreak)]




def loop_orders(recent: str, distance: str, miles: str, count: str, name: str) -> dict[str, list[Column]]:
    d = lambda c: F.col(c).desc_nulls_last()
    return {"recent": [d(recent), F.col(name)], "distance": [d(distance), F.col(name)], "miles": [d(miles), F.col(name)], "count": [d(count), d(distance), F.col(name)]}


def null_as(c: str, value: float) -> Column:
    """Descending with null in the place of a value."""
    return F.coalesce(F.col(c), F.lit(value)).desc()


def ranked(groups: DataFrame, orders: Mapping[str, Sequence[Column]]) -> DataFrame:
    """A rank column per order. For aggregated tables of a bounded number of groups; their rows are ordered in one task."""
    return groups.select("*", *[F.row_number().over(W.orderBy(*o)).cast("long").alias(f"by_{k}") for k, o in orders.items()])


def strongest(weights: DataFrame, name: str, weight: str, n: int = 15) -> DataFrame:
    """The n names of largest absolute weight, fewer if there are fewer: a top list by nature."""
    return weights.orderBy(F.desc(F.abs(F.col(weight))), name).limit(n)


def placed(rows: DataFrame, *order: Column | str, name: str = "place") -> DataFrame:
    """rows with their place from 1 in this order, which should end in a key. Ranges of rows are numbered apart and shifted by what lies before them."""
    cut = durable(rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    sizes = cut.groupBy("__range").agg(F.count("*").alias("n"))  # a row per partition
    before = sizes.select("__range", F.coalesce(F.sum("n").over(W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    own = F.row_number().over(W.partitionBy("__range").orderBy(*order))
    return cut.withColumn("__own", own).join(F.broadcast(before), "__range").withColumn(name, F.col("__own") + F.col("__before")).drop("__own", "__before", "__range")


def placed_within(rows: DataFrame, group: str, *order: str, name: str = "nth", size: str = "n") -> DataFrame:
    """rows with their place from 1 in their own group, in order of columns that end in a key, and the group's size. A null group is one of them.

    Rows are cut into ranges of (group, order), so that a frequent group lies in several; each task numbers its
    part of a group, and parts are shifted by the parts before them.
    """
    part = ["__range", "__group"]
    cut = durable(rows.repartitionByRange(group, *order).withColumns({"__range": F.spark_partition_id(), "__group": F.struct(group)}))
    parts = cut.groupBy(*part).agg(F.count("*").alias("k"))  # a row per group and range: its parts are no more than there are partitions
    of_group = W.partitionBy("__group")
    upto = F.sum("k").over(of_group.orderBy("__range").rowsBetween(W.unboundedPreceding, 0))
    shifts = parts.select(*part, (upto - F.col("k")).alias("__before"), F.sum("k").over(of_group).alias(size))
    own = F.row_number().over(W.partitionBy(*part).orderBy(*order))
    return cut.withColumn("__own", own).join(shifts, part).withColumn(name, F.col("__own") + F.col("__before")).drop("__own", "__before", *part)


def by_size(groups: DataFrame, size: str, seed: str) -> DataFrame:
    """Groups with their place: large ones first, those of one size by seed."""
    return placed(groups, F.desc(size), F.asc(seed))


def by_coverage(rows: DataFrame, percent: str, length: str, name: str) -> DataFrame:
    """Rows with their place: most covered first, then the longer, then by name."""
    return placed(rows, F.desc(percent), F.desc(length), F.asc(name))


def by_key(entries: Column) -> Column:
    """The entries of a map as an array of (key, value), sorted by key; a null map has none."""
    return F.coalesce(F.array_sort(F.map_entries(entries)), F.expr("array()"))


def tags(rows: DataFrame, c: Column) -> DataFrame:
    """Distinct tags of an array column with their place, case ignored, equal ones by spelling."""
    return placed(rows.select(F.explode(c).alias("tag")).where("tag <> ''").distinct(), F.lower("tag"), F.col("tag"))
