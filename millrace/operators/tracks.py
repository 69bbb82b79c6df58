"""Tracks and ways: legs, lengths, coverage, and the segments near a point."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.geometry import haversine, segment_distance2
from millrace.operators.durable import durable, salted_join
from millrace.operators.sequences import changed


def legs(points: DataFrame, track: str, order: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Each point beside the next one of its track: cols and next_ cols; a track's last point has no leg."""
    w = W.partitionBy(track).orderBy(*order)
    return points.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in cols], F.lead(F.lit(True)).over(w).alias("__leg")).where("__leg").drop("__leg")


def leg_metres(lat: str, lon: str) -> Column:
    return haversine(F.col(lat), F.col(lon), F.col(f"next_{lat}"), F.col(f"next_{lon}"))


def without_gaps(legs_: DataFrame, length: Column, most: float) -> DataFrame:
    """Legs that aren't longer than a recording gap may be."""
    return legs_.where(~(length > most))


def level_lengths(points: DataFrame, track: str, order: Sequence[str], level: str, step: Column) -> DataFrame:
    """(track, run, level, points, length): runs of equal levels along each track, a leg between two levels being split at its middle.

    step is a leg's length, in terms of next_ columns of `order` and `level`.
    """
    w = W.partitionBy(track).orderBy(*order)
    rows = points.withColumn("run", F.sum(changed(level, [track], list(order)).cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    rows = rows.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in (*order, level, "run")])
    half = F.coalesce(step, F.lit(0)) / 2
    parts = F.array(F.struct(F.col("run"), F.col(level).alias("level"), half.alias("length"), F.lit(1).alias("n")), F.struct(F.col("next_run").alias("run"), F.col(f"next_{level}").alias("level"), half.alias("length"), F.lit(0).alias("n")))
    return rows.select(track, F.inline(parts)).where("run is not null").groupBy(track, "run", "level").agg(F.sum("n").alias("points"), F.sum("length").alias("length"))


def _cells(a: Column, b: Column, cell: float, pad: float) -> Column:
    return F.sequence(F.floor((F.least(a, b) - pad) / cell), F.floor((F.greatest(a, b) + pad) / cell))


def near_segments(points: DataFrame, segments: DataFrame, radius: float, cell: float, pid: str = "pid", sid: str = "sid") -> DataFrame:
    """Distinct (pid, sid) of points (x, y) at most `radius` from a segment (ax, ay, bx, by) of sid.

    Each different place is held against the segments once, however many points lie there. A segment is stamped on the
    grid cells that its box, widened by the radius, touches; a place lies in one. Cells wider than most segments are long
    keep the stamps few. Points take the sids of their place last; only of those with several places are pairs combined again.
    """
    p = points.select(F.col(pid).alias("pid"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where("x is not null and y is not null and not isnan(x) and not isnan(y)")
    spots = p.select("x", "y").distinct().withColumn("cx", F.floor(F.col("x") / cell)).withColumn("cy", F.floor(F.col("y") / cell))
    s = segments.select(F.col(sid).alias("sid"), "ax", "ay", "bx", "by").distinct()
    s = s.withColumn("cx", F.explode(_cells(F.col("ax"), F.col("bx"), cell, radius))).withColumn("cy", F.explode(_cells(F.col("ay"), F.col("by"), cell, radius)))
    near = segment_distance2(*map(F.col, ("x", "y", "ax", "ay", "bx", "by"))) <= radius * radius
    met = durable(salted_join(durable(s), durable(spots), ["cx", "cy"]).where(near).select("x", "y", "sid").distinct())
    range_ = [f(c).alias(a) for c in ("x", "y") for f, a in ((F.min, f"{c}0"), (F.max, f"{c}1"))]
    placed = durable(p.groupBy("pid").agg(*range_).select("pid", F.col("x0").alias("x"), F.col("y0").alias("y"), ((F.col("x0") == F.col("x1")) & (F.col("y0") == F.col("y1"))).alias("one")))
    several = placed.where("not one").select(F.col("pid").alias("__pid"))
    spread = p.join(several, F.col("pid").eqNullSafe(F.col("__pid")), "left_semi").distinct()
    pairs = lambda rows: salted_join(met, rows, ["x", "y"]).select("pid", "sid")
    once = pairs(placed.where("one").select("pid", "x", "y"))
    return once if several.isEmpty() else once.unionByName(pairs(spread).distinct())


def trail_rollup(ways: DataFrame, trail: str, metres: Column, covered: Column, region: str, activity: str, activities: Sequence[str]) -> DataFrame:
    """Per trail: metres, covered, all its regions in order as text, and covered metres by activity (a column each).

    Sums are taken per (trail, region) first, so that a long trail is combined before its regions are listed.
    """
    part = ways.groupBy(trail, region).agg(F.sum(metres).alias("metres"), F.sum(covered).alias("covered"), *[F.sum(F.when(F.col(activity) == a, covered).otherwise(0)).alias(f"by_{a}") for a in activities])
    sums = [F.sum(c).alias(c) for c in ("metres", "covered", *[f"by_{a}" for a in activities])]
    return part.groupBy(trail).agg(*sums, F.array_join(F.array_sort(F.collect_set(region)), ",").alias("regions"))


def percent(covered: Column, metres: Column, digits: int = 1) -> Column:
    return F.when(metres > 0, F.round(100 * covered / metres, digits)).otherwise(0.0)


def regions_of(x: Column, y: Column, boxes: Sequence[tuple[str, float, float, float, float]]) -> Column:
    """Names of all boxes (name, x0, x1, y0, y1) that hold the point; where none does, of the one with the nearest centre."""
    held = F.filter(F.array(*[F.when(x.between(a, b) & y.between(c, d), n) for n, a, b, c, d in boxes]), lambda n: n.isNotNull())
    far = F.array(*[F.struct((F.pow(x - (a + b) / 2, 2) + F.pow(y - (c + d) / 2, 2)).alias("d"), F.lit(n).alias("n")) for n, a, b, c, d in boxes])
    return F.when(F.size(held) > 0, held).otherwise(F.array(F.array_min(far)["n"]))


def joined_rings(ways: DataFrame, owner: str, start: str, end: str) -> DataFrame:
    """(owner, closed, ways): whether unordered ways (start, end) of an owner close to rings: each end meets an even number of others.

    Ways meet in ends, in whatever order and direction they came, so counting ends decides without walking.
    """
    ends = ways.select(owner, F.explode(F.array(start, end)).alias("__end")).groupBy(owner, "__end").agg(F.count("*").alias("k"))
    closed = ends.groupBy(owner).agg((F.max(F.col("k") % 2) == 0).alias("closed"))
    return ways.groupBy(owner).agg(F.count("*").alias("ways")).join(closed, owner)
