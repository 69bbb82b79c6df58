"""Points of a plane in square cells that are quartered where they are crowded, and searches that go down them."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.operators.durable import durable

_CELL = ["level", "cx", "cy"]
_SLACK = 1e-12  # of a squared distance, for rounding in bounds


class Tree(NamedTuple):
    """cells (level, cx, cy, leaf, n, x0, x1, y0, y1): the weight of a cell's points and the box that they span.
    spots (level, cx, cy, tx, ty, n, tid): different places in the leaf that holds them."""

    cells: DataFrame
    spots: DataFrame
    depth: int


def _at(x: Column, y: Column, width: float, level: int) -> list[Column]:
    side = width / 2**level  # exact, so that a cell's quarters are 2c and 2c + 1
    return [F.lit(level).alias("level"), F.floor(x / side).alias("cx"), F.floor(y / side).alias("cy")]


def grow(rows: DataFrame, tid: str, x: str, y: str, width: float, few: int = 64, deepest: int = 30) -> Tree:
    """Cells of this width, quartered until one holds `few` different places at most, or `deepest` times.

    Rows at one place become one with their number and greatest id, so a heap of copies is one spot. Only
    cells that are still crowded are read again. Rows without a place are left out.
    """
    given = rows.select(F.col(tid).alias("tid"), F.col(x).cast("double").alias("tx"), F.col(y).cast("double").alias("ty")).where("tx is not null and ty is not null and not isnan(tx) and not isnan(ty)")
    left = durable(given.groupBy("tx", "ty").agg(F.count("*").alias("n"), F.max("tid").alias("tid")))
    cells = spots = None
    for level in range(deepest + 1):
        placed = left.select(*_at(F.col("tx"), F.col("ty"), width, level), "tx", "ty", "n", "tid")
        box = [f(c).alias(a) for f, c, a in ((F.min, "tx", "x0"), (F.max, "tx", "x1"), (F.min, "ty", "y0"), (F.max, "ty", "y1"))]
        leaf = (F.count("*") <= few) if level < deepest else F.lit(True)
        per = durable(placed.groupBy(*_CELL).agg(leaf.alias("leaf"), F.sum("n").alias("n"), *box))
        crowded = per.where("not leaf").select(*_CELL)
        done = placed.join(crowded, _CELL, "left_anti")
        cells, spots = (per, done) if cells is None else (cells.unionByName(per), spots.unionByName(done))
        if crowded.isEmpty():
            break
        left = durable(placed.join(crowded, _CELL, "left_semi").select("tx", "ty", "n", "tid"))
    return Tree(cells, spots, level)


def _bounds() -> tuple[Column, Column]:
    """Squared distance of (px, py) to the nearest and to the farthest place that a cell's box allows."""
    px, py, zero = F.col("px"), F.col("py"), F.lit(0.0)
    near = [F.greatest(F.col(f"{c}0") - p, p - F.col(f"{c}1"), zero) for c, p in (("x", px), ("y", py))]
    far = [F.greatest(F.abs(p - F.col(f"{c}0")), F.abs(F.col(f"{c}1") - p)) for c, p in (("x", px), ("y", py))]
    return near[0] * near[0] + near[1] * near[1], far[0] * far[0] + far[1] * far[1]


def _start(points: DataFrame, tree: Tree, width: float) -> DataFrame:
    ring = lambda c: F.explode(F.sequence(F.floor(F.col(c) / width) - 1, F.floor(F.col(c) / width) + 1))
    return points.withColumn("level", F.lit(0)).withColumn("cx", ring("px")).withColumn("cy", ring("py")).join(tree.cells, _CELL)


def _quarters(open_: DataFrame, tree: Tree, keep: list[str]) -> DataFrame:
    half = F.array(*[F.struct((F.col("level") + 1).alias("level"), (2 * F.col("cx") + i).alias("cx"), (2 * F.col("cy") + j).alias("cy")) for i in (0, 1) for j in (0, 1)])
    return open_.select(*keep, F.inline(half)).join(tree.cells, _CELL)


def _d2() -> Column:
    return (F.col("px") - F.col("tx")) * (F.col("px") - F.col("tx")) + (F.col("py") - F.col("ty")) * (F.col("py") - F.col("ty"))


def _points(points: DataFrame, pid: str, x: str, y: str) -> DataFrame:
    return points.select(F.col(pid).alias("pid"), F.col(x).cast("double").alias("px"), F.col(y).cast("double").alias("py")).where("px is not null and py is not null and not isnan(px) and not isnan(py)").distinct()


def nearest_within(points: DataFrame, targets: DataFrame, radius: float, pid: str = "pid", tid: str = "tid", x: str = "x", y: str = "y", few: int = 64) -> DataFrame:
    """(pid, tid, d2): each point's nearest target within the radius, ties to the greatest target id; points without one, or without a place, are not in the result.

    A point goes down the targets' cells and drops at each level those that are farther off, at their
    nearest, than another one is at its farthest. What is left are a few leaves a point, however many targets
    crowd in one place. An id with several places gets the nearest of all.
    """
    tree, limit = grow(targets, tid, x, y, radius, few), F.lit(float(radius) * radius)
    low, high = _bounds()
    key = ["pid", "px", "py"]
    of_point = W.partitionBy(*key)  # nine cells to begin with, then what can't be told apart

    def kept(met: DataFrame) -> DataFrame:
        best = met.withColumn("low", low).where(F.col("low") <= limit).withColumn("best", F.min(high).over(of_point))
        return best.where(F.col("low") <= F.col("best") * (1 + _SLACK)).drop("low", "best")

    seen = kept(_start(_points(points, pid, x, y), tree, radius))
    for _ in range(tree.depth):
        cut = durable(seen)
        seen = kept(cut.where("leaf").unionByName(_quarters(cut.where("not leaf"), tree, key)))
    met = seen.select(*key, *_CELL).join(tree.spots, _CELL).withColumn("d2", _d2()).where(F.col("d2") <= limit)
    return met.groupBy("pid").agg(F.min_by("tid", F.struct(F.col("d2"), -F.col("tid"))).alias("tid"), F.min("d2").alias("d2"))


def visitors(points: DataFrame, targets: DataFrame, radius: float, pid: str = "pid", tid: str = "tid", x: str = "x", y: str = "y", few: int = 64) -> DataFrame:
    """(tid, visitors): how many points lie within the radius of each target; targets without any are not in the result.

    An id stands for one place (a track, which has many, needs `spatial.near_points` and a count of different ids);
    repeated rows count once, and a target with several places counts each point at each. Cells that lie wholly
    inside are counted by their number, so that only the rim meets points one by one.
    """
    single = points.select(F.col(pid).alias("pid"), F.col(x).alias("x"), F.col(y).alias("y")).distinct()
    tree, limit = grow(single, "pid", "x", "y", radius, few), F.lit(float(radius) * radius)
    low, high = _bounds()
    key = ["pid", "px", "py"]  # here a target's
    seen, parts = _start(_points(targets, tid, x, y), tree, radius), []
    for level in range(tree.depth + 1):
        cut = durable(seen.where(low <= limit * (1 + _SLACK)))
        inside = high <= limit * (1 - _SLACK)
        parts.append(cut.where(inside).groupBy("pid").agg(F.sum("n").alias("n")))
        rim = cut.where("leaf").where(~inside).select(*key, *_CELL).join(tree.spots.drop("tid"), _CELL)
        parts.append(rim.where(_d2() <= limit).groupBy("pid").agg(F.sum("n").alias("n")))
        seen = _quarters(cut.where("not leaf").where(~inside), tree, key)
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy(F.col("pid").alias("tid")).agg(F.sum("n").alias("visitors"))
