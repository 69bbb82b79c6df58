"""Spatial joins by grid cells: equi-joins on a cell key, then the exact test."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ring(c: Column) -> Column:
    return F.sequence(c - 1, c + 1)


def near_points(points: DataFrame, targets: DataFrame, radius: float, pid: str = "pid", tid: str = "tid", x: str = "x", y: str = "y") -> DataFrame:
    """(pid, tid, d2) of points and targets at most `radius` apart on a plane.

    Targets are copied into the nine cells around their own, cells being as wide as the radius. A pair
    meets once, and about one in three that meet is in the result, so work grows with the result. Where not the
    pairs but the nearest target or a count is wanted, `quadtree` has both without the pairs.
    """
    p = points.select(F.col(pid).alias("pid"), F.col(x).alias("px"), F.col(y).alias("py")).withColumn("cx", F.floor(F.col("px") / radius)).withColumn("cy", F.floor(F.col("py") / radius))
    t = targets.select(F.col(tid).alias("tid"), F.col(x).alias("tx"), F.col(y).alias("ty"))
    t = t.withColumn("cx", F.explode(_ring(F.floor(F.col("tx") / radius)))).withColumn("cy", F.explode(_ring(F.floor(F.col("ty") / radius))))
    d2 = F.pow(F.col("px") - F.col("tx"), 2) + F.pow(F.col("py") - F.col("ty"), 2)
    return p.join(t, ["cx", "cy"]).withColumn("d2", d2).where(F.col("d2") <= radius * radius).select("pid", "tid", "d2")


def nearest_of_few(centres: Sequence[tuple], x: Column, y: Column) -> Column:
    """Index of the nearest of a short list of (x, y); ties to the first. An expression, no join."""
    dist = F.array(*[F.struct((F.pow(x - cx, 2) + F.pow(y - cy, 2)).alias("d"), F.lit(i).alias("i")) for i, (cx, cy) in enumerate(centres)])
    return F.array_min(dist)["i"]


def in_polygon(x: Column, y: Column, ring: Sequence[tuple[float, float]]) -> Column:
    """Even-odd ray cast against a short ring of (x, y), after its bounding box."""
    xs, ys = [p[0] for p in ring], [p[1] for p in ring]
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]]):
        if y1 != y2:
            hit = ((F.lit(y1) > y) != (F.lit(y2) > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
            crossings = crossings + hit.cast("int")
    return x.between(min(xs), max(xs)) & y.between(min(ys), max(ys)) & (crossings % 2 == 1)


def in_region(x: Column, y: Column, outer: Sequence, inner: Sequence = ()) -> Column:
    """Inside any outer ring and no inner one."""
    test = F.lit(False)
    for ring in outer:
        test = test | in_polygon(x, y, ring)
    for ring in inner:
        test = test & ~in_polygon(x, y, ring)
    return test


def first_box(x: Column, y: Column, boxes: Sequence[tuple[str, float, float, float, float]], other: str = "other") -> Column:
    """Name of the first box (name, x0, x1, y0, y1) that holds the point."""
    out = None
    for name, x0, x1, y0, y1 in boxes:
        test = x.between(x0, x1) & y.between(y0, y1)
        out = F.when(test, name) if out is None else out.when(test, name)
    return F.lit(other) if out is None else out.otherwise(other)
