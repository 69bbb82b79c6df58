"""Rows found by their place in a list or by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def item_at(rows: DataFrame, documents: DataFrame, key: str, items: str, index: Column, name: str = "item") -> DataFrame:
    """rows with `name`: the element at `index`, from 0, of the array that the document of the same key holds; null where there is none."""
    listed = documents.select(key, F.col(items).alias("__items"))
    return rows.withColumn("__at", index.cast("int")).join(listed, key, "left").withColumn(name, F.get("__items", F.col("__at"))).drop("__items", "__at")


def with_totals(rows: DataFrame, name: str, sums: list[str], label: str = "all") -> DataFrame:
    """(name, sums) of each row, and one row named `label` with the totals over all; without rows these are 0."""
    totals = rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast(rows.schema[c].dataType).alias(c) for c in sums])
    return rows.select(name, *sums).unionByName(totals.select(F.lit(label).alias(name), *sums))


def named(rows: DataFrame, name: str, wanted: str, sums: list[str], label: str = "all") -> DataFrame:
    """The row of this name, the totals for `label`, no row for a name that isn't there."""
    return with_totals(rows if wanted == label else rows.where(F.col(name) == wanted), name, sums, label).where(F.col(name) == wanted)
