"""Regions drawn as rings that are rows themselves: points and ways in them, several regions each."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.operators.durable import durable, salted_join
from millrace.operators.nearest import nearest


def edges(rings: DataFrame) -> DataFrame:
    """(region, x1, y1, x2, y2) of rings (region, ring, position, x, y), whose positions run from 0 without gaps; the last point meets the first."""
    n = rings.groupBy("region", "ring").agg(F.count("*").alias("n"))
    here = rings.join(n, ["region", "ring"]).select("region", "ring", F.pmod(F.col("position") + 1, F.col("n")).alias("position"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    there = rings.select("region", "ring", "position", F.col("x").alias("x2"), F.col("y").alias("y2"))
    return here.join(there, ["region", "ring", "position"]).select("region", "x1", "y1", "x2", "y2")


def _crossings(spots: DataFrame, rings: DataFrame, cell: float) -> DataFrame:
    """(x, y, region), a row at least per region whose edges a ray to the right of a spot crosses, odd in number where the region holds it. spots: different (x, y).

    An edge that spans a whole row of cells is looked at in the cells that it passes; those between them and the region's west
    border are crossed on its account wherever a point lies in them, so there such edges are only counted.
    An edge that ends within a row is looked at in all of that row's cells up to the west border.
    """
    west = rings.groupBy("region").agg(F.floor(F.min("x") / cell - 1e-6).alias("west"))
    e, lo, hi = edges(rings).where("y1 <> y2").join(west, "region"), F.least("y1", "y2"), F.greatest("y1", "y2")
    e = e.withColumn("cy", F.explode(F.sequence(F.floor(lo / cell), F.floor(hi / cell))))
    slack = (F.abs("x1") + F.abs("x2") + cell) * 1e-9  # what is near a border is looked at
    bottom, top = F.col("cy") * F.lit(cell), (F.col("cy") + 1) * F.lit(cell)
    whole = (lo <= bottom - cell * 1e-6) & (hi >= top + cell * 1e-6)
    at = lambda y: F.col("x1") + (F.greatest(lo, F.least(hi, y)) - F.col("y1")) / (F.col("y2") - F.col("y1")) * (F.col("x2") - F.col("x1"))
    a, b = at(bottom - cell * 1e-6), at(top + cell * 1e-6)
    first = F.when(whole, F.greatest(F.col("west"), F.floor((F.least(a, b) - slack) / cell))).otherwise(F.col("west"))
    last = F.floor((F.greatest(a, b) + slack) / cell)
    e = e.select("region", "x1", "y1", "x2", "y2", "cy", "west", whole.alias("whole"), first.alias("first"), last.alias("last"))
    near = e.select("region", "x1", "y1", "x2", "y2", "cy", F.explode(F.sequence("first", F.greatest("first", "last"))).alias("cx"))
    left = W.partitionBy("region", "cy").orderBy(F.desc("first"))
    steps = e.where("whole and first > west").groupBy("region", "cy", "first").agg(F.count("*").alias("n"), F.first("west").alias("west"))
    steps = steps.withColumn("k", F.sum("n").over(left.rowsBetween(W.unboundedPreceding, 0))).withColumn("from", F.coalesce(F.lead("first").over(left), F.col("west")))
    passed = steps.where("k % 2 = 1").select("region", "cy", F.explode(F.sequence("from", F.col("first") - 1)).alias("cx"))
    p = spots.withColumn("cx", F.floor(F.col("x") / cell)).withColumn("cy", F.floor(F.col("y") / cell))
    crosses = ((F.col("y1") > F.col("y")) != (F.col("y2") > F.col("y"))) & (F.col("x") < F.col("x1") + (F.col("y") - F.col("y1")) / (F.col("y2") - F.col("y1")) * (F.col("x2") - F.col("x1")))
    met = salted_join(p, near, ["cx", "cy"]).where(crosses).groupBy("x", "y", "region").agg(F.count("*").alias("k"))
    return met.unionByName(salted_join(p, passed, ["cx", "cy"]).select("x", "y", "region", F.lit(1).cast("long").alias("k")))


def in_regions(points: DataFrame, rings: DataFrame, cell: float, pid: str = "pid", few: int = 16) -> DataFrame:
    """(pid, x, y, region) for each different point (x, y) and each region that holds it: a ray to the right crosses its edges an odd number of times.

    All rings of a region count together, so that a ring inside another cuts a hole. Points at one spot are judged once.
    Cells are halved until about `few` spots share one: what meets in all cells then grows with edges times the root of the spots, and not with their product.
    """
    p = points.select(F.col(pid).alias("pid"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where("x IS NOT NULL AND y IS NOT NULL").distinct()
    p = durable(p)
    spots = durable(p.select("x", "y").distinct())
    cells = spots.select(F.floor(F.col("x") / cell).alias("cx"), F.floor(F.col("y") / cell).alias("cy")).groupBy("cx", "cy").count().agg(F.count("*"), F.sum("count")).first()
    halved = min(10, max(0, round(math.log(max(1.0, (cells[1] or 0) / max(1, cells[0]) / few), 4))))
    odd = _crossings(spots, rings, cell / 2**halved).groupBy("x", "y", "region").agg(F.sum("k").alias("k")).where("k % 2 = 1")
    held = durable(odd.groupBy("x", "y").agg(F.collect_list("region").alias("regions")))
    return salted_join(p, held, ["x", "y"]).select("pid", "x", "y", F.explode("regions").alias("region"))


def regions_of_ways(ways: DataFrame, rings: DataFrame, cell: float, way: str = "way", line: str = "line") -> DataFrame:
    """(way, region, held): all regions that hold any point of a way (points lon, lat); where none does, the one whose ring points' mean is nearest to the way's middle point, held being false.

    rings: (region, ring, position, x, y), x being the longitude. Ways without points have no regions.
    """
    rows = ways.where(F.size(line) > 0).select(F.col(way).alias("way"), F.col(line).alias("line"))
    points = rows.select("way", F.inline("line")).select(F.col("way").alias("pid"), F.col("lon").alias("x"), F.col("lat").alias("y"))
    held = in_regions(points, rings, cell).select(F.col("pid").alias("way"), "region").distinct()
    middle = F.element_at("line", F.floor(F.size("line") / 2).cast("int") + 1)
    lost = rows.join(held.select("way").distinct(), "way", "left_anti").select("way", middle["lat"].alias("lat"), middle["lon"].alias("lon"))
    centres = rings.groupBy("region").agg(F.avg("y").alias("lat"), F.avg("x").alias("lon"))
    near = nearest(lost, centres, "way", "region").where("tid IS NOT NULL").select(F.col("pid").alias("way"), F.col("tid").alias("region"))
    return held.withColumn("held", F.lit(True)).unionByName(near.withColumn("held", F.lit(False)))
