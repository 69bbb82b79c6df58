import math
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import quadtree, spatial


def places(n, seed, crowd):
    """Half of them crowd in a small square, some of these at one place."""
    rng = random.Random(seed)
    spread = [(i, rng.uniform(-9, 9), rng.uniform(-9, 9)) for i in range(n // 2)]
    near = [(i, 1 + rng.uniform(0, crowd), 1 + rng.uniform(0, crowd)) for i in range(n // 2, n)]
    return [*spread, *near, *[(n + i, 1.25, 1.25) for i in range(9)]]


def frame(spark, rows, name):
    return spark.createDataFrame(rows, f"{name} long, x double, y double")


def brute(pts, tgt, radius):
    d2 = lambda x, y, u, v: (x - u) * (x - u) + (y - v) * (y - v)
    return {(a, b): d2(x, y, u, v) for a, x, y in pts for b, u, v in tgt if d2(x, y, u, v) <= radius * radius}


@pytest.mark.parametrize("few,crowd", [(64, 1.0), (3, 0.5), (1, 1e-3)])
def test_searches_agree_with_all_pairs(spark, few, crowd):
    pts, tgt = places(60, 1, crowd), places(60, 2, crowd)
    near = brute(pts, tgt, 2.0)
    best = {a: min((d, -b) for (c, b), d in near.items() if c == a) for a in {a for a, _ in near}}
    awkward = [(None, 1.0, 1.0), (500, None, 1.0), (501, 1.0, math.nan)]
    p, t = frame(spark, [*pts, *pts[:7], *awkward[1:]], "pid"), frame(spark, [*tgt, *tgt[-3:], *awkward[1:]], "tid")
    got = quadtree.nearest_within(p, t, 2.0, few=few).collect()
    assert {r.pid: (r.d2, -r.tid) for r in got} == best
    counts = {b: sum(1 for c in near if c[1] == b) for b in {b for _, b in near}}
    assert {r.tid: r.visitors for r in quadtree.visitors(p, t, 2.0, few=few).collect()} == counts


def test_empty_tables(spark):
    p, t = frame(spark, places(10, 1, 1.0), "pid"), frame(spark, [], "tid")
    assert quadtree.nearest_within(p, t, 1.0).count() == 0 and quadtree.visitors(p, t, 1.0).count() == 0
    p, t = frame(spark, [], "pid"), frame(spark, places(10, 1, 1.0), "tid")
    assert quadtree.nearest_within(p, t, 1.0).count() == 0 and quadtree.visitors(p, t, 1.0).count() == 0


def test_a_crowd_is_told_apart_by_cells(spark):
    """4,000 targets in one cell: a point meets some leaves of these, not all, also one that stands off."""
    rng = random.Random(3)
    t = frame(spark, [(i, rng.uniform(0, 1), rng.uniform(0, 1)) for i in range(4000)], "tid")
    tree = quadtree.grow(t, "tid", "x", "y", 1.0, few=16)
    assert tree.spots.count() == 4000 and tree.cells.where("leaf").agg(F.sum("n")).first()[0] == 4000
    assert tree.cells.where("leaf").agg(F.max("n")).first()[0] <= 16 and tree.cells.where("level = 0").agg(F.sum("n")).first()[0] == 4000
    p = frame(spark, [(1, 0.5, 0.5), (2, 1.9, 0.5)], "pid")
    pairs = spatial.near_points(p, t, 1.0)
    want = {r.pid: r.d2 for r in pairs.groupBy("pid").agg(F.min("d2").alias("d2")).collect()}
    assert {r.pid: r.d2 for r in quadtree.nearest_within(p, t, 1.0, few=16).collect()} == want
