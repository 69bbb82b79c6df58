"""Filters that views share: search, facets, ranges, places, resuming."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def all_of(*tests: Column | None) -> Column:
    """One conjunction for every view; tests that are None are left out."""
    return reduce(lambda a, b: a & b, [t for t in tests if t is not None], F.lit(True))


def holds(c: Column, term: str) -> Column:
    """Whether c holds the term, case ignored; an empty term is in every text."""
    return F.contains(F.lower(c), F.lit(term.lower()))


def facet(c: Column, wanted: str | None, every: str = "all") -> Column | None:
    """c equals the wanted value; no test for the wildcard."""
    return None if wanted in (None, every) else c == wanted


def member(c: Column, wanted: str, every: str = "all") -> Column | None:
    """The array c has the wanted element; no test for the wildcard."""
    return None if wanted == every else F.array_contains(c, wanted)


def upcoming(d: Column, as_of: str) -> Column:
    return d >= F.lit(as_of).cast("timestamp")


def within(x: Column, y: Column, box: tuple[float, float, float, float], pad: float = 0.0) -> Column:
    """Inside a box (x0, x1, y0, y1), widened on all sides."""
    return x.between(box[0] - pad, box[1] + pad) & y.between(box[2] - pad, box[3] + pad)


def outside(x: Column, y: Column, zones: Sequence[tuple[float, float, float]]) -> Column:
    """Outside every zone (x, y, radius) of a short list."""
    return all_of(*[F.pow(x - a, 2) + F.pow(y - b, 2) > r * r for a, b, r in zones])


def beyond_start(points: DataFrame, track: str, order: Sequence[str], x: str, y: str, radius: float) -> DataFrame:
    """Points farther than the radius from their own track's first point. The first point is an aggregate, so no track is sorted."""
    first = points.groupBy(track).agg(F.min_by(F.struct(F.col(x).alias("x"), F.col(y).alias("y")), F.struct(*order)).alias("__first"))
    far = F.pow(F.col(x) - F.col("__first.x"), 2) + F.pow(F.col(y) - F.col("__first.y"), 2) > radius * radius
    return points.join(first, track).where(far).drop("__first")


def reaching(points: DataFrame, track: str, inside: Column) -> DataFrame:
    """Tracks of which any point is inside."""
    return points.groupBy(track).agg(F.bool_or(inside).alias("__in")).where("__in").select(track)


def at_least(rows: DataFrame, key: str, n: int) -> DataFrame:
    """Keys with n rows or more, and how many."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") >= n)


def existing(rows: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """The wanted columns in their order, those left out that there are none of."""
    return rows.select(*[c for c in wanted if c in rows.columns])


def with_defaults(rows: DataFrame, scope: str, defaults: Mapping[str, Mapping[str, str]]) -> DataFrame:
    """Nulls filled by what a row's scope sets; a scope that isn't named fills nothing."""
    fields = sorted({f for d in defaults.values() for f in d})
    fill = lambda f: reduce(lambda c, s: F.when(F.col(scope) == s, F.lit(defaults[s][f])).otherwise(c), [s for s in defaults if f in defaults[s]], F.lit(None).cast("string"))
    return rows.withColumns({f: F.coalesce(F.col(f) if f in rows.columns else F.lit(None), fill(f)) for f in fields})


def numbered(rows: DataFrame, bucket: Column, order: Sequence[str]) -> DataFrame:
    """rows with `index` from 0 in order of (bucket, order), without one task for all: buckets are numbered apart and shifted by what lies before them.

    The bucket must grow with the order, as a month does with a date; there is one row per bucket on the way.
    """
    cut = rows.withColumn("__b", bucket)
    per = cut.groupBy("__b").agg(F.count("*").alias("__n"))
    before = per.withColumn("__before", F.coalesce(F.sum("__n").over(W.orderBy("__b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    own = F.row_number().over(W.partitionBy("__b").orderBy(*order)) - 1
    return cut.withColumn("__own", own).join(F.broadcast(before), "__b").withColumn("index", (F.col("__own") + F.col("__before")).cast("long")).drop("__own", "__b", "__before")


def shard(rows: DataFrame, n: int, which: int) -> DataFrame:
    """Every n-th row of a numbered table."""
    return rows.where(F.pmod("index", F.lit(n)) == which)


def to_do(wanted: DataFrame, done: DataFrame, key: str, complete: Column) -> DataFrame:
    """Wanted keys whose output isn't there, or is there without what makes it complete."""
    return wanted.join(done.where(complete).select(key).distinct(), key, "left_anti")


def shade(touched: Column, visits: Column, most: int = 4) -> Column:
    """How a stretch is drawn: by its visits, `most` at most, if it has any and its trail is touched; else null."""
    return F.when(touched & (visits > 0), F.least(visits, F.lit(most)))
