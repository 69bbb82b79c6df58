import random

from millrace.operators import tracks


def dist2(px, py, ax, ay, bx, by):
    dx, dy = bx - ax, by - ay
    span = dx * dx + dy * dy
    t = 0.0 if span == 0 else max(0.0, min(1.0, ((px - ax) * dx + (py - ay) * dy) / span))
    return (px - ax - t * dx) ** 2 + (py - ay - t * dy) ** 2


def test_points_of_one_place_are_compared_once(spark):
    rng = random.Random(4)
    points = [(i, float(rng.randrange(6)), float(rng.randrange(6))) for i in range(120)] + [(None, 1.0, 1.0), (200, None, 1.0), (201, float("nan"), 1.0)]
    several = [(3, 0.0, 5.0), (3, 5.0, 0.0), (3, 5.0, 0.0), (None, 4.0, 4.0)]
    legs = [(rng.randrange(9), *[rng.uniform(0, 6) for _ in range(4)]) for _ in range(30)] + [(50, 2.0, 2.0, 2.0, 2.0)]
    s = spark.createDataFrame(legs, "sid long, ax double, ay double, bx double, by double")
    for rows in (points, points + several):
        p = spark.createDataFrame(rows, "pid long, x double, y double")
        got = tracks.near_segments(p, s, 0.7, 2.0)
        want = {(i, leg[0]) for i, x, y in rows if x is not None and y is not None for leg in legs if dist2(x, y, *leg[1:]) <= 0.49}
        found = [tuple(r) for r in got.collect()]
        assert len(found) == len(set(found)) and set(found) == want
    once = tracks.near_segments(spark.createDataFrame([r for r in points if r[0] is not None], "pid long, x double, y double"), s, 0.7, 2.0)
    assert "Aggregate" not in once._jdf.queryExecution().executedPlan().toString()  # pairs aren't combined
