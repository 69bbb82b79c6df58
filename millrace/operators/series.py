"""Parallel-array series and long rows, each into the other; JSON helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def to_arrays(rows: DataFrame, key: list[str], x: str, y: str) -> DataFrame:
    """Long rows -> one row per key with arrays x and y in order of x."""
    both = F.array_sort(F.collect_list(F.struct(F.col(x).alias("x"), F.col(y).alias("y"))))
    return rows.groupBy(*key).agg(both.alias("__s")).select(*key, F.transform("__s", lambda s: s["x"]).alias("x"), F.transform("__s", lambda s: s["y"]).alias("y"))


def to_rows(series: DataFrame, key: list[str]) -> DataFrame:
    """The inverse of to_arrays."""
    return series.select(*key, F.explode(F.arrays_zip("x", "y")).alias("__s")).select(*key, "__s.x", "__s.y")


def to_wide(rows: DataFrame, key: list[str], label: str, value: str, labels: list[str]) -> DataFrame:
    """A column per named label; missing ones are null."""
    return rows.groupBy(*key).agg(*[F.max(F.when(F.col(label) == name, F.col(value))).alias(name) for name in labels])


def first_alias(*candidates: Column) -> Column:
    return F.coalesce(*candidates)


def merged_series(own: Column, new: Column, force: bool = False) -> Column:
    """A map of series with new ones added, none that is all null; existing ones stay unless forced."""
    useful = F.map_filter(new, lambda k, v: F.exists(v, lambda x: x.isNotNull()))
    if force:
        return F.map_concat(F.map_filter(own, lambda k, v: ~F.map_contains_key(useful, k)), useful)
    return F.map_concat(own, F.map_filter(useful, lambda k, v: ~F.map_contains_key(own, k)))


def not_all_zero(y: Column) -> Column:
    """Series to show: an empty one, or one with a value other than zero."""
    return (F.size(y) == 0) | F.exists(y, lambda v: v.isNotNull() & (v != 0))


def reindexed(rows: DataFrame, columns: list[str], kind: str = "double") -> DataFrame:
    """Exactly these columns: extra ones dropped, missing ones null."""
    return rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast(kind).alias(c) for c in columns])


def with_suffix(rows: DataFrame, suffix: str, always: tuple[str, ...] = ()) -> DataFrame:
    """The columns of one source, by their ending, and those that all share."""
    return rows.select(*[c for c in rows.columns if c.endswith(f"_{suffix}") or c in always])


def inverted(mapping: DataFrame, name: str, members: str) -> DataFrame:
    """(name, array of members) -> (member, name)."""
    return mapping.select(F.explode(members).alias("member"), name)


def mapped(arrays: DataFrame, change: Callable[[Column], Column] | None, y: str = "y") -> DataFrame:
    """Series with `change` applied to each value, as they are without one. Missing series stay missing, missing values are handed on."""
    return arrays if change is None else arrays.withColumn(y, F.transform(y, change))
