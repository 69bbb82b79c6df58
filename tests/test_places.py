import datetime
import math
import random

import duckdb
import pyarrow as pa

from millrace.operators import regions
from millrace.operators.durable import salted_join
from millrace.operators.nearest import _leading, nearest
from millrace.plans import catalog


def km(a, b, c, d):
    h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371.0 * math.asin(min(1.0, math.sqrt(h)))


def check_nearest(spark, points, grid):
    p = spark.createDataFrame(points, "pid long, lat double, lon double")
    g = spark.createDataFrame(grid, "tid long, lat double, lon double, t double")
    bad = lambda v: v is None or math.isnan(v)
    kept = [r for r in grid if not any(map(bad, r[1:]))]
    got = {}
    for r in nearest(p, g, value="t").collect():
        assert str((r.pid, r.lat, r.lon)) not in got
        got[str((r.pid, r.lat, r.lon))] = r
    assert set(got) == {str((d, a, b)) for d, a, b in points}
    for d, a, b in points:
        r = got[str((d, a, b))]
        if bad(a) or bad(b) or not kept:
            assert r.tid is None and r.km is None
            continue
        far = [(km(a, b, lat, lon), t) for t, lat, lon, _ in kept]
        assert abs(r.km - min(far)[0]) < 1e-6
        assert r.tid == min(t for v, t in far if v < min(far)[0] + 1e-7)


def test_nearest_against_all_pairs(spark):
    rng = random.Random(2)
    nan = float("nan")
    grid = [(i, rng.uniform(-90, 90), rng.uniform(0, 360), rng.choice([1.0, nan, None])) for i in range(300)]
    grid += [(900 + i, 45 + i / 1000, 5.0, 0.0) for i in range(30)] + [(5000, 45.0, 5.0, 0.0), (4, None, 3.0, 1.0), (5, nan, 3.0, 1.0)]
    points = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(150)]
    points += [(200, 90.0, 0.0), (201, -90.0, 77.0), (202, 0.0, 180.0), (203, 0.0, -180.0), (204, None, 1.0), (205, 1.0, nan), (7, 12.0, 12.0), (7, 13.0, 12.0), (206, 45.0, 5.0), (206, 45.0, 5.0), (207, 44.9, 365.0)]
    check_nearest(spark, points, grid)


def test_leading_targets_of_far_points():
    """A crowd of targets far from all points: each point keeps what is nearest, equal ones all."""
    rng = random.Random(5)
    crowd = [(i, 10 + rng.random() / 50, 20 + rng.random() / 50) for i in range(700)] + [(900, -10.0, 30.0), (901, -10.0, 10.0)]
    spots = [(i, rng.uniform(-80, -60), rng.uniform(0, 360)) for i in range(200)] + [(300, -10.0, 20.0), (301, 90.0, 0.0)]
    left, right = pa.table(list(zip(*spots)), names=["pid", "lat", "lon"]), pa.table(list(zip(*crowd)), names=["tid", "t_lat", "t_lon"])
    got = _leading(left, right).to_pylist()
    for d, a, b in spots:
        best = min((km(a, b, x, y), t) for t, x, y in crowd)
        assert best[1] in {r["tid"] for r in got if r["pid"] == d}
    assert {r["tid"] for r in got if r["pid"] == 300} == {900, 901}
    assert len(got) < 220 and _leading(left, right.slice(0, 0)).num_rows == 0


def test_nearest_ties_far_targets_and_none(spark):
    square = [(9, 1.0, 0.0, 0.0), (3, -1.0, 0.0, 0.0), (5, 0.0, 1.0, 0.0), (4, 0.0, 359.0, 0.0)]
    check_nearest(spark, [(1, 0.0, 0.0), (2, 0.0, 180.0), (3, 0.5, 0.0)], square)
    check_nearest(spark, [(1, 0.0, 0.0)], [(8, 0.0, 179.0, 1.0)])
    check_nearest(spark, [(1, 0.0, 0.0), (2, 4.0, 4.0)], [(8, 0.0, 1.0, float("nan")), (9, 0.0, 2.0, None)])
    assert nearest(spark.createDataFrame([], "pid long, lat double, lon double"), spark.createDataFrame(square, "tid long, lat double, lon double, t double")).collect() == []


def inside(x, y, rings):
    odd = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]]):
            if (y1 > y) != (y2 > y) and x < x1 + (y - y1) / (y2 - y1) * (x2 - x1):
                odd = not odd
    return odd


def table(spark, shapes):
    return spark.createDataFrame([(name, k, i, float(x), float(y)) for name, rings in shapes.items() for k, ring in enumerate(rings) for i, (x, y) in enumerate(ring)], "region string, ring int, position long, x double, y double")


SHAPES = {
    "hole": [[(0, 0), (10, 0), (10, 10), (0, 10)], [(3, 3), (7, 3), (7, 7), (3, 7)]],
    "star": [[(-5, -5), (5, 20), (12, -6), (-8, 9), (15, 8)]],
    "far": [[(40, 40), (41, 40), (41, 41)]],
    "line": [[(0, 0), (5, 5)]],
}


def test_points_in_several_regions(spark):
    rng = random.Random(5)
    pts = [(i, rng.uniform(-10, 16), rng.uniform(-8, 22)) for i in range(400)] + [(900 + i, 5.0, 1.0 + i / 1000) for i in range(300)] + [(1, 5.0, 5.0), (2, 0.0, 0.0), (3, None, 1.0)]
    got = sorted((r.pid, r.x, r.y, r.region) for r in regions.in_regions(spark.createDataFrame(pts, "pid long, x double, y double"), table(spark, SHAPES), 2.5).collect())
    assert got == sorted((d, x, y, name) for d, x, y in set(pts) if x is not None for name, rings in SHAPES.items() if inside(x, y, rings))


def test_ways_and_their_nearest_region(spark):
    line = lambda *at: [{"lon": float(x), "lat": float(y)} for x, y in at]
    long = [(i / 10, 5.0) for i in range(-100, 500)]
    ways = {1: line((1, 1), (2, 2)), 2: line((5, 5)), 3: line((30, 30), (39, 39)), 4: line(*long), 5: line((1, 1), (40.9, 40.2)), 6: []}
    df = spark.createDataFrame(list(ways.items()), "way long, line array<struct<lon:double,lat:double>>")
    got = {(r.way, r.region, r.held) for r in regions.regions_of_ways(df, table(spark, SHAPES), 2.5).collect()}
    want = set()
    for w, pts in ways.items():
        if not pts:
            continue
        step = max(1, len(pts) // 24)
        seen = {n for p in [*pts[::step], pts[-1]] for n, rings in SHAPES.items() if inside(p["lon"], p["lat"], rings)}
        want |= {(w, n, True) for n in seen}
        if not seen:
            m = pts[len(pts) // 2]
            mean = lambda n, k: sum(p[k] for r in SHAPES[n] for p in r) / sum(map(len, SHAPES[n]))
            want.add((w, min(SHAPES, key=lambda n: (km(m["lat"], m["lon"], mean(n, 1), mean(n, 0)), n)), False))
    assert got == want


def test_every_point_of_a_way_counts(spark, tmp_path):
    """A region that holds one point of a hundred is found, wherever in the way the point is; before, only every fourth was looked at."""
    away = {"lon": 90.0, "lat": 90.0}
    ways = [(i, [{"lon": 40.7, "lat": 40.5} if k == i else away for k in range(100)]) for i in range(100)] + [(200, [away] * 100)]
    df = spark.createDataFrame(ways, "way long, line array<struct<lon:double,lat:double>>")
    got = {(r.way, r.region, r.held) for r in regions.regions_of_ways(df, table(spark, SHAPES), 2.5).collect()}
    assert got == {(i, "far", True) for i in range(100)} | {(200, "far", False)}

    corners, sf = [(0, 10.0), (100, 10.0), (60, 10.0), (37, 40.0)], str(tmp_path)
    spark.createDataFrame([(key, nation, 100.0 * x + nation) for nation in (3, 8) for key, x in corners], "s_suppkey long, s_nationkey int, s_acctbal double").write.parquet(f"{sf}/supplier.parquet")
    events = [(user, user * 1000 + k, datetime.datetime(2024, 1, 1), 75.0 if k == user else 5000.0, '{"k": 30}') for user in range(60) for k in range(60)]
    spark.createDataFrame(events, "user_id long, event_id long, ts timestamp, value double, props string").write.parquet(f"{sf}/events.parquet")
    df, con = catalog.queries()["way_regions"](spark, sf), duckdb.connect()
    for t in ("supplier", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet/*.parquet'")
    want = con.execute(catalog.oracle_sql()["way_regions"]).fetchall()
    assert sorted(tuple(r) for r in df.select("user_id", "region", "held").collect()) == sorted(want)
    assert {user for user, _, held in want if held} == set(range(60))


def test_salted_join(spark):
    left = spark.createDataFrame([(i % 2, i) for i in range(60)] + [(5, 1), (None, 2)], "k int, i int")
    right = spark.createDataFrame([(0, "a"), (0, "b"), (1, "c"), (5, "d"), (7, "e")], "k int, v string")
    for limit in (1, 10, 1000):
        for how in ("inner", "left"):
            got = salted_join(left, right, ["k"], how, limit)
            assert sorted(map(str, got.collect())) == sorted(map(str, left.join(right, ["k"], how).collect()))


def test_a_ring_of_long_edges_in_halved_cells(spark):
    """Edges that run through whole rows of cells are only counted for what lies left of them; before, each met every point of its rows."""
    rng = random.Random(8)
    shapes = {n: [[(rng.uniform(0, 100), rng.randrange(101) / 2) for _ in range(60)]] for n in "ab"} | {"hole": SHAPES["hole"]}
    pts = [(i, rng.choice([rng.uniform(-9, 120), rng.randrange(20) * 5.0]), rng.randrange(-9, 120) / 2) for i in range(600)]
    df = spark.createDataFrame(pts, "pid long, x double, y double")
    got = sorted((r.pid, r.x, r.y, r.region) for r in regions.in_regions(df, table(spark, shapes), 5.0, few=1).collect())
    assert got == sorted((d, x, y, name) for d, x, y in set(pts) for name, rings in shapes.items() if inside(x, y, rings))
