"""Queries of rings, regions and nearest cells, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.operators import rings
from millrace.operators.nearest import nearest
from millrace.operators.regions import regions_of_ways
from millrace.plans.registry import query
from millrace.plans.registry import table as _t

_WAYS = "SELECT user_id AS owner, event_id AS way, [CAST(CAST(floor(value / 45) AS BIGINT) AS VARCHAR), 'm' || event_id, CAST(CAST(props->>'$.k' AS BIGINT) % 11 AS VARCHAR)] AS pts FROM events"


@query(f"""WITH RECURSIVE ways AS ({_WAYS}),
ends AS (SELECT owner, way, tip, spot, row_number() OVER (PARTITION BY owner, spot ORDER BY way, tip) AS nth FROM (
  SELECT owner, way, 0 AS tip, pts[1] AS spot FROM ways WHERE pts[1] <> pts[3] UNION ALL SELECT owner, way, 1, pts[3] FROM ways WHERE pts[1] <> pts[3])),
mates AS (
  SELECT a.owner, a.way, a.tip, b.way AS mate, b.tip AS mate_tip FROM ends a JOIN ends b ON a.owner = b.owner AND a.spot = b.spot AND (a.nth + 1) // 2 = (b.nth + 1) // 2 AND a.nth <> b.nth
  UNION ALL SELECT owner, way, tip, way, 1 - tip FROM ways, (VALUES (0), (1)) t(tip) WHERE pts[1] = pts[3]),
heads AS (SELECT owner, way, tip AS back FROM ends WHERE NOT EXISTS (SELECT 1 FROM mates m WHERE m.owner = ends.owner AND m.way = ends.way AND m.tip = ends.tip)),
chain AS (
  SELECT owner, way AS ring, back AS ring_back, way, back, 0 AS step FROM heads
  UNION ALL SELECT c.owner, c.ring, c.ring_back, m.mate, m.mate_tip, c.step + 1 FROM chain c JOIN mates m ON m.owner = c.owner AND m.way = c.way AND m.tip = 1 - c.back),
ended AS (SELECT owner, ring, ring_back, arg_max(way, step) AS last FROM chain GROUP BY 1, 2, 3),
kept AS (SELECT owner, ring, false AS closed, way, back, step FROM chain JOIN ended USING (owner, ring, ring_back) WHERE ring < last OR ring = last AND ring_back = 0),
loop AS (
  SELECT owner, way AS ring, way, 0 AS back, 0 AS step FROM ways WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.owner = ways.owner AND k.way = ways.way)
  UNION ALL SELECT l.owner, l.ring, m.mate, m.mate_tip, l.step + 1 FROM loop l JOIN mates m ON m.owner = l.owner AND m.way = l.way AND m.tip = 1 - l.back WHERE m.mate > l.ring),
whole AS (SELECT l.owner, l.ring FROM loop l JOIN mates m ON m.owner = l.owner AND m.way = l.way AND m.tip = 1 - l.back AND m.mate = l.ring),
laid AS (SELECT * FROM kept UNION ALL SELECT owner, ring, true, way, back, step FROM loop SEMI JOIN whole USING (owner, ring))
SELECT owner AS user_id, ring, closed, CAST(2 * step + i AS BIGINT) AS position, CASE WHEN back = 0 THEN pts[i + 1] ELSE pts[3 - i] END AS point
FROM laid JOIN ways USING (owner, way), (VALUES (0), (1), (2)) t(i) WHERE step = 0 OR i > 0""")
def ring_assembly(spark, sf):
    """Rings and chains of each user's ways, which run between eleven places."""
    place = lambda c: c.cast("long").cast("string")
    points = F.array(place(F.floor(F.col("value") / 45)), F.concat(F.lit("m"), F.col("event_id").cast("string")), place(F.from_json("props", "k long")["k"] % 11))
    return rings.assembled(_t(spark, sf, "events").select("user_id", "event_id", points.alias("pts")), "user_id", "event_id", "pts")


_KM = "2 * 6371.0 * asin(least(1.0, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))))"


@query(f"""WITH a AS (SELECT c_custkey, (c_custkey * 37 % 1801) / 10.0 - 90 AS lat, (c_custkey * 73 % 3601) / 10.0 AS lon FROM customer),
b AS (SELECT s_suppkey, (s_suppkey * 61 % 1699) / 10.0 - 84.95 AS lat, (s_suppkey * 97 % 3577) / 10.0 - 178.8 AS lon FROM supplier WHERE s_acctbal >= 0)
SELECT c_custkey, arg_min(s_suppkey, (km, s_suppkey)) AS s_suppkey, round(min(km), 6) AS km FROM (SELECT c_custkey, s_suppkey, {_KM} AS km FROM a, b) GROUP BY 1""")
def nearest_grid_cell(spark, sf):
    """Each customer's nearest supplier on the globe, of those whose balance counts as a value."""
    at = lambda key, a, m, down, b, k, left: [((F.col(key) * a % m) / F.lit(10.0) - down).alias("lat"), ((F.col(key) * b % k) / F.lit(10.0) - left).alias("lon")]
    points = _t(spark, sf, "customer").select("c_custkey", *at("c_custkey", 37, 1801, 90, 73, 3601, 0))
    grid = _t(spark, sf, "supplier").select("s_suppkey", *at("s_suppkey", 61, 1699, 84.95, 97, 3577, 178.8), F.when(F.col("s_acctbal") >= 0, F.col("s_acctbal")).otherwise(float("nan")).alias("value"))
    found = nearest(points, grid, "c_custkey", "s_suppkey", "value")
    return found.select(F.col("pid").alias("c_custkey"), F.col("tid").alias("s_suppkey"), F.round("km", 6).alias("km"))


@query(f"""WITH v AS (SELECT s_nationkey AS region, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS pos, count(*) OVER (PARTITION BY s_nationkey) AS n, (s_suppkey * 37 % 101) * 0.5 AS y, s_acctbal / 100 AS x FROM supplier),
e AS (SELECT a.region, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM v a JOIN v b ON a.region = b.region AND b.pos = (a.pos + 1) % a.n),
pts AS (SELECT user_id, value / 5 AS x, CAST(props->>'$.k' AS DOUBLE) / 2 AS y, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
held AS (SELECT DISTINCT user_id, region FROM (SELECT user_id, i, region FROM pts p JOIN e ON (y1 > p.y) <> (y2 > p.y) AND p.x < x1 + (p.y - y1) / (y2 - y1) * (x2 - x1) GROUP BY 1, 2, 3 HAVING count(*) % 2 = 1)),
a AS (SELECT user_id, x AS lon, y AS lat FROM pts WHERE i = n // 2 AND user_id NOT IN (SELECT user_id FROM held)),
b AS (SELECT region, avg(x) AS lon, avg(y) AS lat FROM v GROUP BY 1)
SELECT user_id, region, true AS held FROM held UNION ALL SELECT user_id, arg_min(region, (km, region)), false FROM (SELECT user_id, region, {_KM} AS km FROM a, b) GROUP BY 1""")
def way_regions(spark, sf):
    """Regions that users' ways pass through; a nation's suppliers are the corners of its region."""
    place = W.partitionBy("s_nationkey").orderBy("s_suppkey")
    corners = _t(spark, sf, "supplier").select(F.col("s_nationkey").alias("region"), F.lit(0).alias("ring"), (F.row_number().over(place) - 1).cast("long").alias("position"), (F.col("s_acctbal") / 100).alias("x"), ((F.col("s_suppkey") * 37 % 101) * F.lit(0.5)).alias("y"))
    spot = F.struct("ts", "event_id", (F.col("value") / 5).alias("lon"), (F.from_json("props", "k double")["k"] / 2).alias("lat"))
    ways = _t(spark, sf, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(spot)).alias("line"))
    return regions_of_ways(ways, corners, 5.0, "user_id").withColumnRenamed("way", "user_id")
