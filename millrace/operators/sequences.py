"""Window and sequence operators. Each takes the keys that partition it; none runs over a whole table in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def trailing_mean(value: str, partition: list, order: list, size: int = 3) -> Column:
    """Mean of the last `size` rows; null for the first size - 1."""
    w = W.partitionBy(*partition).orderBy(*order)
    return F.when(F.row_number().over(w) >= size, F.avg(value).over(w.rowsBetween(1 - size, 0)))


def cumulative(value: str, partition: list, order: list) -> Column:
    return F.sum(value).over(W.partitionBy(*partition).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))


def lead_equal(label: str, partition: list, order: list, same: int = 24, other: int = 8) -> Column:
    """`same` where the next row has an equal label, else `other`; the last row has no next."""
    nxt = F.lead(label).over(W.partitionBy(*partition).orderBy(*order))
    return F.when(nxt == F.col(label), same).otherwise(other)


def changed(c: str, partition: list, order: list) -> Column:
    """Whether a row's value differs from the one before; the first row's does."""
    w = W.partitionBy(*partition).orderBy(*order)
    return (F.row_number().over(w) == 1) | ~F.col(c).eqNullSafe(F.lag(c).over(w))


def islands(rows: DataFrame, level: str, partition: list[str], order: list[str]) -> DataFrame:
    """Runs of equal consecutive levels: partition, island (from 1), level, n, first and last of the first order column."""
    w = W.partitionBy(*partition).orderBy(*order)
    marked = rows.withColumn("__new", changed(level, partition, order).cast("int"))
    numbered = marked.withColumn("island", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy(*partition, "island", level).agg(F.count("*").alias("n"), F.min(order[0]).alias("first"), F.max(order[0]).alias("last"))


def half_credit(covered: Column, length: Column, partition: list[str], order: list[str]) -> Column:
    """Covered part of the way to the next row: all if both ends are covered, half if one is; 0 for the last row."""
    nxt = F.lead(covered.cast("int")).over(W.partitionBy(*partition).orderBy(*order))
    return F.when(nxt.isNull(), 0.0).otherwise(length * (covered.cast("int") + nxt) / 2)


def suffix_letters(label: str, order: list[str]) -> Column:
    """' A', ' B' ... within equal labels that occur more than once, else nothing."""
    nth = F.row_number().over(W.partitionBy(label).orderBy(*order))
    return F.when(F.count("*").over(W.partitionBy(label)) > 1, F.concat(F.lit(" "), F.char(F.lit(64) + nth))).otherwise("")


def neighbours(c: str, partition: list, order: list) -> tuple[Column, Column]:
    """The previous and the next row's value, null at the ends."""
    w = W.partitionBy(*partition).orderBy(*order)
    return F.lag(c).over(w), F.lead(c).over(w)


def laps(index: str, size: Column, partition: list[str], order: list[str]) -> DataFrame:
    """Signed advance of each step around a ring of `size` places: the short way."""
    step = F.pmod(F.col(index) - F.lag(index).over(W.partitionBy(*partition).orderBy(*order)), size)
    return F.when(step > F.floor(size / 2), step - size).otherwise(step)


def resampled(points: DataFrame, track: str, seq: str, x: str, y: str, n: int) -> DataFrame:
    """n points at equal steps of arc length along each track (the end left out): track, i, x, y. A track of no length repeats its first point."""
    w = W.partitionBy(track).orderBy(seq)
    nxt = points.select(track, seq, F.col(x).alias("x0"), F.col(y).alias("y0"), F.lead(x).over(w).alias("x1"), F.lead(y).over(w).alias("y1"))
    legs = nxt.withColumn("leg", F.coalesce(F.sqrt(F.pow(F.col("x1") - F.col("x0"), 2) + F.pow(F.col("y1") - F.col("y0"), 2)), F.lit(0.0)))
    legs = legs.withColumn("to", F.sum("leg").over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("from", F.col("to") - F.col("leg"))
    legs = legs.withColumn("total", F.sum("leg").over(W.partitionBy(track)))
    flat = legs.where("total = 0").groupBy(track).agg(F.min_by("x0", seq).alias("x"), F.min_by("y0", seq).alias("y")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    lo, hi = F.ceil(F.col("from") * n / F.col("total")), F.ceil(F.col("to") * n / F.col("total")) - 1
    inside = legs.where("leg > 0").withColumn("lo", lo).withColumn("hi", F.least(hi, F.lit(n - 1))).where("hi >= lo").withColumn("i", F.explode(F.sequence(F.col("lo").cast("int"), F.col("hi").cast("int"))))
    t = (F.col("i") * F.col("total") / n - F.col("from")) / F.col("leg")
    moved = inside.select(track, "i", (F.col("x0") + (F.col("x1") - F.col("x0")) * t).alias("x"), (F.col("y0") + (F.col("y1") - F.col("y0")) * t).alias("y"))
    return moved.unionByName(flat.select(track, "i", "x", "y"))
