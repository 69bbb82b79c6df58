"""Queries of filters, orders, tracks, summaries and formats, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions import dates, geometry, numeric, text
from millrace.operators import aggregates, evaluation, filters, ordering, sequences, series, tracks
from millrace.plans.registry import query
from millrace.plans.registry import table as _t

_DEC = "CAST(sum(CAST({} AS DECIMAL(18,2))) AS DOUBLE)"


def _sum(c: str):
    return F.sum(F.col(c).cast("decimal(18,2)")).cast("double")


# Filters


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring') AND p_type = 'ECONOMY' AND p_size BETWEEN 5 AND 40")
def facet_search(spark, sf):
    test = filters.all_of(filters.holds(F.col("p_name"), "RING"), filters.facet(F.col("p_type"), "ECONOMY"), filters.facet(F.col("p_brand"), "all"), F.col("p_size").between(5, 40))
    return _t(spark, sf, "part").where(test).select("p_partkey", "p_name")


@query("SELECT o_orderkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nth FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01'")
def upcoming_orders(spark, sf):
    soon = _t(spark, sf, "orders").where(filters.upcoming(F.col("o_orderdate"), "1998-01-01"))
    return soon.select("o_orderkey", "o_orderdate", F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).cast("long").alias("nth"))


@query("SELECT p_partkey, 'ring' AS wanted FROM part WHERE list_contains(string_split(p_name, ' '), 'ring') UNION ALL SELECT p_partkey, 'all' FROM part")
def member_filter(spark, sf):
    parts, words = _t(spark, sf, "part"), F.split("p_name", " ")
    one = [parts.where(filters.all_of(filters.member(words, w))).select("p_partkey", F.lit(w).alias("wanted")) for w in ("ring", "all")]
    return one[0].unionByName(one[1])


_TRACK = "SELECT event_id, user_id, ts, value AS x, CAST(props->>'$.k' AS DOUBLE) AS y FROM events"


def _track(spark, sf):
    return _t(spark, sf, "events").select("event_id", "user_id", "ts", F.col("value").alias("x"), F.from_json("props", "k double")["k"].alias("y"))


@query(f"WITH t AS ({_TRACK}), f AS (SELECT user_id, arg_min(x, (ts, event_id)) AS fx, arg_min(y, (ts, event_id)) AS fy FROM t GROUP BY 1) SELECT event_id FROM t JOIN f USING (user_id) WHERE (x - fx) * (x - fx) + (y - fy) * (y - fy) > 2500")
def beyond_start(spark, sf):
    return filters.beyond_start(_track(spark, sf), "user_id", ["ts", "event_id"], "x", "y", 50.0).select("event_id")


@query(f"WITH t AS ({_TRACK}) SELECT event_id FROM t WHERE (x - 50) * (x - 50) + (y - 50) * (y - 50) > 900 AND (x - 10) * (x - 10) + (y - 90) * (y - 90) > 100")
def outside_zones(spark, sf):
    return _track(spark, sf).where(filters.outside(F.col("x"), F.col("y"), [(50.0, 50.0, 30.0), (10.0, 90.0, 10.0)])).select("event_id")


@query(f"WITH t AS ({_TRACK}) SELECT user_id, count(*) AS n, bool_or(x BETWEEN -1 AND 2 AND y BETWEEN -1 AND 2) AS reaches FROM t GROUP BY 1 HAVING count(*) >= 60 AND bool_or(x BETWEEN -1 AND 2 AND y BETWEEN -1 AND 2)")
def box_reach(spark, sf):
    points = _track(spark, sf)
    near = filters.reaching(points, "user_id", filters.within(F.col("x"), F.col("y"), (0.0, 1.0, 0.0, 1.0), 1.0))
    return filters.at_least(points, "user_id", 60).join(near, "user_id").withColumn("reaches", F.lit(True))


@query("SELECT s_suppkey, coalesce(CASE WHEN s_acctbal > 5000 THEN 'rich' END, CASE s_nationkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' END) AS layout, CASE s_nationkey % 3 WHEN 0 THEN 'yes' END AS comments FROM supplier")
def scope_defaults(spark, sf):
    rows = _t(spark, sf, "supplier").select("s_suppkey", F.pmod("s_nationkey", F.lit(3)).cast("string").alias("kind"), F.when(F.col("s_acctbal") > 5000, "rich").alias("layout"))
    return filters.with_defaults(rows, "kind", {"0": {"layout": "a", "comments": "yes"}, "1": {"layout": "b"}}).drop("kind")


@query("SELECT o_orderkey, i AS index FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS i FROM orders) WHERE i % 4 = 1")
def shard_filter(spark, sf):
    """One of four workers' share of a list in order: the operator itself is a modulus, applied to the whole list."""
    rows = filters.numbered(_t(spark, sf, "orders").select("o_orderkey", "o_orderdate"), F.trunc("o_orderdate", "month"), ["o_orderdate", "o_orderkey"])
    return filters.shard(rows, 4, 1).select("o_orderkey", "index")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '1998-01-01')")
def resume_incomplete(spark, sf):
    done = _t(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderdate")
    return filters.to_do(_t(spark, sf, "customer").select("c_custkey"), done, "c_custkey", F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp"))


@query("SELECT l_partkey, n, m >= 160 OR (m > 70 AND share >= 0.9) AS touched, CASE WHEN (m >= 160 OR (m > 70 AND share >= 0.9)) AND n > 0 THEN least(n, 4) END AS shade FROM (SELECT l_partkey, count(*) FILTER (l_returnflag = 'R') AS n, coalesce(sum(l_quantity) FILTER (l_returnflag = 'R'), 0) AS m, coalesce(sum(l_quantity) FILTER (l_returnflag = 'R'), 0) / sum(l_quantity) AS share FROM lineitem GROUP BY 1)")
def display_gate(spark, sf):
    walked = F.col("l_returnflag") == "R"
    per = _t(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count(F.when(walked, 1)).alias("n"), F.coalesce(F.sum(F.when(walked, F.col("l_quantity"))), F.lit(0.0)).alias("m"), F.sum("l_quantity").alias("a"))
    touched = numeric.touched(F.col("m"), F.col("m") / F.col("a"))
    return per.select("l_partkey", "n", touched.alias("touched"), filters.shade(touched, F.col("n")).alias("shade"))


@query("SELECT s_suppkey, s_name, coalesce(CASE WHEN s_acctbal < 0 THEN 'debt' END, CASE WHEN s_nationkey < 5 THEN 'near' END, 'none') AS found FROM supplier WHERE s_acctbal BETWEEN 0 AND 6000 AND s_nationkey BETWEEN 2 AND 20")
def first_existing(spark, sf):
    rows = _t(spark, sf, "supplier").where(filters.within(F.col("s_acctbal"), F.col("s_nationkey"), (0.0, 6000.0, 2.0, 20.0)))
    found = series.first_alias(F.when(F.col("s_acctbal") < 0, "debt"), F.when(F.col("s_nationkey") < 5, "near"), F.lit("none"))
    return filters.existing(rows.withColumn("found", found), ["s_suppkey", "s_fax", "s_name", "found"])


# Orders

_NATIONS = f"SELECT n_name, max(o_orderdate) AS recent, {_DEC.format('o_totalprice')} AS miles, max(o_totalprice) AS distance, count(o_orderkey) AS count, CASE WHEN n_nationkey % 4 > 0 THEN max(o_totalprice) END AS elevation FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY n_name, n_nationkey"


@query(f"""SELECT *, row_number() OVER (ORDER BY recent DESC NULLS LAST, n_name) AS by_recent, row_number() OVER (ORDER BY distance DESC NULLS LAST, n_name) AS by_distance,
row_number() OVER (ORDER BY miles DESC NULLS LAST, n_name) AS by_miles, row_number() OVER (ORDER BY count DESC NULLS LAST, distance DESC NULLS LAST, n_name) AS by_count,
row_number() OVER (ORDER BY coalesce(elevation, 0) DESC, n_name) AS by_height, row_number() OVER (ORDER BY coalesce(elevation, -1) DESC, n_name) AS by_last, row_number() OVER (ORDER BY miles NULLS LAST, n_name) AS by_chosen FROM ({_NATIONS})""")
def sort_modes(spark, sf):
    orders = _t(spark, sf, "orders").join(_t(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    per = orders.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.max("o_orderdate").alias("recent"), _sum("o_totalprice").alias("miles"), F.max("o_totalprice").alias("distance"), F.count("*").alias("count"))
    groups = _t(spark, sf, "nation").select("n_nationkey", "n_name").join(per, "n_nationkey", "left").fillna(0, subset=["count"])
    groups = groups.withColumn("elevation", F.when(F.col("n_nationkey") % 4 > 0, F.col("distance"))).drop("n_nationkey")
    chosen = {"miles": ordering.Metric("Miles", F.col("miles"))}
    orders_ = ordering.loop_orders("recent", "distance", "miles", "count", "n_name")
    return ordering.ranked(groups, orders_ | {"height": [ordering.null_as("elevation", 0), F.col("n_name")], "last": [ordering.null_as("elevation", -1), F.col("n_name")], "chosen": ordering.by(chosen, "miles", False, "n_name")})


@query("SELECT tag, row_number() OVER (ORDER BY lower(tag), tag) AS place FROM (SELECT DISTINCT unnest(string_split(CASE WHEN p_size % 2 = 0 THEN upper(p_name) ELSE p_name END, ' ')) AS tag FROM part) WHERE tag <> ''")
def tag_order(spark, sf):
    name = F.when(F.col("p_size") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name"))
    return ordering.tags(_t(spark, sf, "part"), F.split(name, " "))


_FEATURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("SELECT feature, round(w, 6) AS weight FROM (" + " UNION ALL ".join(f"SELECT '{f}' AS feature, corr({f}, CAST(l_returnflag = 'R' AS INT)) AS w FROM lineitem" for f in _FEATURES) + ")")
def importance(spark, sf):
    flag = (F.col("l_returnflag") == "R").cast("int")
    one = _t(spark, sf, "lineitem").agg(*[F.corr(F.col(f), flag).alias(f) for f in _FEATURES])
    weights = one.select(F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("weight")) for f in _FEATURES])))
    return ordering.strongest(weights, "feature", "weight").select("feature", F.round("weight", 6).alias("weight"))


@query("SELECT ord, category, o_orderkey, row_number() OVER (PARTITION BY category ORDER BY o_orderdate DESC, o_orderkey) AS nth FROM orders JOIN (VALUES (1, 'talks', 'F'), (2, 'papers', 'O'), (3, 'posters', 'X')) c(ord, category, flag) ON flag = o_orderstatus")
def declared_order(spark, sf):
    """Categories in their declared order, each with its rows newest first; a category without rows has no header."""
    declared = spark.sql("SELECT * FROM VALUES (1, 'talks', 'F'), (2, 'papers', 'O'), (3, 'posters', 'X') AS c(ord, category, o_orderstatus)")
    rows = _t(spark, sf, "orders").join(F.broadcast(declared), "o_orderstatus")
    return rows.select("ord", "category", "o_orderkey", F.row_number().over(W.partitionBy("category").orderBy(F.desc("o_orderdate"), "o_orderkey")).cast("long").alias("nth"))


# Aggregates


@query(f"SELECT o_orderpriority, CAST(year(o_orderdate) AS INT) AS year, count(*) AS n, {_DEC.format('o_totalprice')} AS total FROM orders GROUP BY ALL")
def category_year(spark, sf):
    return _t(spark, sf, "orders").groupBy("o_orderpriority", F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"), _sum("o_totalprice").alias("total"))


@query(f"SELECT count(*) AS n, {_DEC.format('o_totalprice')} AS total, median(o_totalprice) AS median, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS best, round(avg(CAST(o_orderstatus = 'F' AS INT)), 6) AS share FROM orders")
def summary_tiles(spark, sf):
    return aggregates.tiles(_t(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), "o_totalprice", "o_orderkey", F.col("o_orderstatus") == "F")


_LOOPS = f"count(*) AS n, min(value) AS shortest, max(value) AS longest, median(value) AS median, {_DEC.format('value')} AS total, CAST(min(ts) AS DATE) AS first, CAST(max(ts) AS DATE) AS last, count(*) FILTER (value >= 50) AS clockwise, count(*) FILTER (value < 50) AS counter, min(value) FILTER (value > 0) AS best"


def _loops(rows):
    v = F.col("value")
    return aggregates.group_medians(rows, ["event_type"], "value").join(rows.groupBy("event_type").agg(
        F.count("*").alias("n"), F.min(v).alias("shortest"), F.max(v).alias("longest"), _sum("value").alias("total"),
        F.to_date(F.min("ts")).alias("first"), F.to_date(F.max("ts")).alias("last"), aggregates.count_if(v >= 50).alias("clockwise"), aggregates.count_if(v < 50).alias("counter"), F.min(F.when(v > 0, v)).alias("best"),
    ), "event_type", "right")


@query(f"SELECT event_type, {_LOOPS} FROM events GROUP BY 1")
def loop_description(spark, sf):
    return _loops(_t(spark, sf, "events"))


@query(f"SELECT event_type, {_LOOPS} FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND event_type <> 'error' GROUP BY 1")
def loops_in_scope(spark, sf):
    return _loops(_t(spark, sf, "events").where(filters.all_of(F.col("ts") >= F.lit("2024-01-10").cast("timestamp"), F.col("event_type") != "error")))


@query("SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS nth, count(*) OVER u AS n, min(ts) OVER u AS first, max(ts) OVER u AS last FROM events WHERE event_type = 'purchase' WINDOW u AS (PARTITION BY user_id)")
def ascents(spark, sf):
    """Who went up how often, first and last, beside each ascent, newest first."""
    rows = _t(spark, sf, "events").where("event_type = 'purchase'").select("user_id", "event_id", "ts")
    per = rows.groupBy("user_id").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    nth = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))).cast("long")
    return rows.withColumn("nth", nth).join(per, "user_id")


@query("SELECT event_type, count(*) AS n, count(*) / (SELECT count(*) FROM events) AS share FROM events GROUP BY 1")
def value_counts(spark, sf):
    return aggregates.shares(_t(spark, sf, "events"), "event_type")


@query("SELECT event_type, min(ts) FILTER (value >= 20) AS lo, max(ts) FILTER (value >= 20) AS hi FROM events GROUP BY 1")
def tight_range(spark, sf):
    y = F.when(F.col("value") >= 20, F.col("value"))
    return _t(spark, sf, "events").groupBy("event_type").agg(F.min(F.when(y.isNotNull(), F.col("ts"))).alias("lo"), F.max(F.when(y.isNotNull(), F.col("ts"))).alias("hi"))


@query("SELECT source, count(*) FILTER (len > 0) AS with_text, count(*) FILTER (len = 0) AS without, CAST(sum(n_chars) AS BIGINT) AS raw, CAST(sum(len) AS BIGINT) AS kept, CASE WHEN count(*) > 0 THEN sum(len) / sum(n_chars) END AS ratio FROM (SELECT source, n_chars, length(regexp_replace(coalesce(text, ''), '[ \\n]+', '', 'g')) AS len FROM documents) GROUP BY 1")
def cache_summary(spark, sf):
    rows = _t(spark, sf, "documents").select("source", "n_chars", F.length(F.regexp_replace(F.coalesce("text", F.lit("")), "[ \n]+", "")).alias("len"))
    return rows.groupBy("source").agg(aggregates.count_if(F.col("len") > 0).alias("with_text"), aggregates.count_if(F.col("len") == 0).alias("without"), F.sum("n_chars").alias("raw"), F.sum("len").alias("kept"), numeric.ratio(F.sum("len"), F.sum("n_chars")).alias("ratio"))


@query("SELECT c_mktsegment, count(*) AS people, round(avg(CAST(k IS NOT NULL AS INT)), 6) AS matched FROM customer LEFT JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'P') ON k = c_custkey GROUP BY 1")
def matched_share(spark, sf):
    known = _t(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("loop", F.lit(1))
    rows = _t(spark, sf, "customer").select("c_custkey", "c_mktsegment").join(known, "c_custkey", "left")
    return rows.groupBy("c_mktsegment").agg(F.count("*").alias("people"), F.round(F.avg(F.col("loop").isNotNull().cast("int")), 6).alias("matched"))


@query("SELECT model, source, auc FROM (SELECT o_orderpriority AS model, o_orderstatus AS source, round(avg(o_totalprice), 4) AS auc, row_number() OVER (PARTITION BY o_orderstatus ORDER BY round(avg(o_totalprice), 4) DESC, o_orderpriority) AS k FROM orders GROUP BY 1, 2) WHERE k = 1")
def best_of_models(spark, sf):
    per = _t(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("model"), F.col("o_orderstatus").alias("source")).agg(F.round(F.avg("o_totalprice"), 4).alias("auc"))
    best = per.groupBy("source").agg(F.min(F.struct((-F.col("auc")).alias("a"), "model")).alias("b"))
    return best.select("b.model", "source", (-F.col("b.a")).alias("auc"))


# Sets


@query("SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS seen, count(DISTINCT o_orderpriority) AS n FROM orders GROUP BY 1")
def set_accumulate(spark, sf):
    got = _t(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("s"))  # five values at most
    return got.select("o_custkey", F.array_join(F.array_sort("s"), ",").alias("seen"), F.size("s").cast("long").alias("n"))


@query("SELECT DISTINCT a.o_custkey, a.o_orderpriority FROM orders a WHERE a.o_orderstatus = 'F' AND EXISTS (SELECT 1 FROM orders b WHERE b.o_custkey = a.o_custkey AND b.o_orderpriority = a.o_orderpriority AND b.o_orderstatus = 'O')")
def shared_parameters(spark, sf):
    """Labels of one model that another also provides."""
    rows = _t(spark, sf, "orders").select("o_custkey", "o_orderpriority", "o_orderstatus")
    other = rows.where("o_orderstatus = 'O'").select("o_custkey", "o_orderpriority").distinct()
    return rows.where("o_orderstatus = 'F'").select("o_custkey", "o_orderpriority").distinct().join(other, ["o_custkey", "o_orderpriority"], "left_semi")


# Tracks

_LEGS = f"""SELECT user_id, ts, x, y, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM ({_TRACK}) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"""
_HAV = "2 * 6371000.0 * asin(least(1.0, sqrt(pow(sin(radians((ny - y) / 100) / 2), 2) + cos(radians(y / 100)) * cos(radians(ny / 100)) * pow(sin(radians((nx - x) / 100) / 2), 2))))"


@query(f"SELECT user_id, count(*) AS legs, round(sum(m), 3) AS metres, count(*) FILTER (NOT m > 60000) AS kept, round(coalesce(sum(m) FILTER (NOT m > 60000), 0), 3) AS kept_metres FROM (SELECT user_id, {_HAV} AS m FROM ({_LEGS}) WHERE nx IS NOT NULL) GROUP BY 1")
def track_lengths(spark, sf):
    points = _track(spark, sf).select("user_id", "ts", "event_id", (F.col("y") / 100).alias("lat"), (F.col("x") / 100).alias("lon"))
    legs = tracks.legs(points, "user_id", ["ts", "event_id"], ["lat", "lon"])
    rows = legs.withColumn("m", geometry.haversine(F.col("lat"), F.col("lon"), F.col("next_lat"), F.col("next_lon"), 6371000.0))
    all_ = rows.groupBy("user_id").agg(F.count("*").alias("legs"), F.round(F.sum("m"), 3).alias("metres"))
    kept = tracks.without_gaps(rows, F.col("m"), 60000.0).groupBy("user_id").agg(F.count("*").alias("kept"), F.round(F.sum("m"), 3).alias("kept_metres"))
    return all_.join(kept, "user_id", "left").fillna(0)


@query("SELECT count(*) AS ways, count(DISTINCT p_name) AS names, round(sum(p_retailprice) / 1609.344, 4) AS miles, CAST(sum(p_size) AS BIGINT) AS vertices FROM part WHERE p_size <= 40")
def network_summary(spark, sf):
    clipped = _t(spark, sf, "part").where("p_size <= 40")
    return clipped.agg(F.count("*").alias("ways"), F.countDistinct("p_name").alias("names"), F.round(numeric.miles(F.sum("p_retailprice")), 4).alias("miles"), F.sum("p_size").alias("vertices"))


@query(f"""WITH t AS (SELECT user_id, ts, event_id, x > 50 AS level, CAST(y AS DOUBLE) AS y FROM ({_TRACK})),
c AS (SELECT *, CASE WHEN level IS NOT DISTINCT FROM lag(level) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new FROM t WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM c),
n AS (SELECT *, lead(y) OVER w AS ny, lead(run) OVER w AS nrun, lead(level) OVER w AS nlevel FROM r WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
p AS (SELECT user_id, run, level, 1 AS k, coalesce(abs(ny - y), 0) / 2 AS half FROM n UNION ALL SELECT user_id, nrun, nlevel, 0, abs(ny - y) / 2 FROM n WHERE nrun IS NOT NULL)
SELECT user_id, CAST(run AS BIGINT) AS run, level, CAST(sum(k) AS BIGINT) AS points, sum(half) AS length FROM p GROUP BY ALL""")
def level_runs(spark, sf):
    rows = _track(spark, sf).select("user_id", "ts", "event_id", (F.col("x") > 50).alias("level"), "y")
    step = F.abs(F.lead("y").over(W.partitionBy("user_id").orderBy("ts", "event_id")) - F.col("y"))
    return tracks.level_lengths(rows.withColumn("step", step), "user_id", ["ts", "event_id"], "level", F.col("step"))


@query(f"SELECT DISTINCT p_partkey AS pid, user_id AS sid FROM (SELECT p_partkey, CAST(p_size * 2 AS DOUBLE) AS px, CAST(p_partkey * 7 % 100 AS DOUBLE) AS py FROM part) JOIN (SELECT user_id, x AS ax, y AS ay, nx AS bx, ny AS by_ FROM ({_LEGS}) WHERE nx IS NOT NULL AND (nx - x) * (nx - x) + (ny - y) * (ny - y) <= 100) ON pow(px - (ax + greatest(0, least(1, CASE WHEN (bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay) = 0 THEN 0 ELSE ((px - ax) * (bx - ax) + (py - ay) * (by_ - ay)) / ((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)) END)) * (bx - ax)), 2) + pow(py - (ay + greatest(0, least(1, CASE WHEN (bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay) = 0 THEN 0 ELSE ((px - ax) * (bx - ax) + (py - ay) * (by_ - ay)) / ((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)) END)) * (by_ - ay)), 2) <= 1.0")
def segments_near(spark, sf):
    """Points at most 1 from a leg of a track, recording gaps of over 10 left out."""
    legs = tracks.legs(_track(spark, sf), "user_id", ["ts", "event_id"], ["x", "y"])
    length2 = F.pow(F.col("next_x") - F.col("x"), 2) + F.pow(F.col("next_y") - F.col("y"), 2)
    segments = tracks.without_gaps(legs, length2, 100.0).select(F.col("user_id").alias("sid"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("next_x").alias("bx"), F.col("next_y").alias("by"))
    points = _t(spark, sf, "part").select(F.col("p_partkey").alias("pid"), (F.col("p_size") * 2).cast("double").alias("x"), (F.col("p_partkey") * 7 % 100).cast("double").alias("y"))
    return tracks.near_segments(points, segments, 1.0, 10.0)


_ROLL = f"SELECT l_suppkey, {_DEC.format('l_quantity')} AS metres, CAST(coalesce(sum(CAST(l_quantity AS DECIMAL(18,2))) FILTER (l_returnflag <> 'N'), 0) AS DOUBLE) AS covered, CAST(coalesce(sum(CAST(l_quantity AS DECIMAL(18,2))) FILTER (l_returnflag = 'A'), 0) AS DOUBLE) AS by_A, CAST(coalesce(sum(CAST(l_quantity AS DECIMAL(18,2))) FILTER (l_returnflag = 'R'), 0) AS DOUBLE) AS by_R, string_agg(DISTINCT l_linestatus, ',' ORDER BY l_linestatus) AS regions FROM lineitem GROUP BY 1"


def _rollup(spark, sf):
    q = F.col("l_quantity")
    walked = F.when(F.col("l_returnflag") != "N", q).otherwise(0.0)
    return tracks.trail_rollup(_t(spark, sf, "lineitem"), "l_suppkey", q, walked, "l_linestatus", "l_returnflag", ["A", "R"])


@query(_ROLL)
def trail_rollup(spark, sf):
    return _rollup(spark, sf)


@query(f"SELECT l_linestatus, count(*) AS trails, CAST(sum(CAST(round(metres / 160.9344, 1) AS DECIMAL(18,1))) AS DOUBLE) AS miles, min(pct) AS least, max(pct) AS most FROM (SELECT *, CASE WHEN metres > 0 THEN round(100 * covered / metres, 1) ELSE 0.0 END AS pct, unnest(string_split(regions, ',')) AS l_linestatus FROM ({_ROLL})) GROUP BY 1")
def coverage_totals(spark, sf):
    """Totals per region of already rounded miles, and the range of rounded percents."""
    rows = _rollup(spark, sf).select(F.explode(F.split("regions", ",")).alias("l_linestatus"), F.round(F.col("metres") / 160.9344, 1).cast("decimal(18,1)").alias("miles"), tracks.percent(F.col("covered"), F.col("metres")).alias("pct"))
    return rows.groupBy("l_linestatus").agg(F.count("*").alias("trails"), F.sum("miles").cast("double").alias("miles"), F.min("pct").alias("least"), F.max("pct").alias("most"))


_PLACES = [("low", 0.0, 3000.0, 0.0, 14.0), ("mid", 2000.0, 6000.0, 5.0, 20.0), ("high", 5500.0, 9000.0, 10.0, 24.0)]


@query("WITH c AS (SELECT c_custkey, c_acctbal AS x, CAST(c_nationkey AS DOUBLE) AS y FROM customer), b(i, name, x0, x1, y0, y1) AS (VALUES " + ", ".join(f"({i}, '{n}', {a}, {b}, {c}, {d})" for i, (n, a, b, c, d) in enumerate(_PLACES)) + "), hit AS (SELECT c_custkey, name AS region FROM c JOIN b ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1) SELECT * FROM hit UNION ALL SELECT c_custkey, arg_min(name, (pow(x - (x0 + x1) / 2, 2) + pow(y - (y0 + y1) / 2, 2), name)) FROM c, b WHERE c_custkey NOT IN (SELECT c_custkey FROM hit) GROUP BY 1")
def regions_touched(spark, sf):
    return _t(spark, sf, "customer").select("c_custkey", F.explode(tracks.regions_of(F.col("c_acctbal"), F.col("c_nationkey").cast("double"), _PLACES)).alias("region"))


@query("SELECT l_orderkey, count(*) AS ways, (SELECT count(*) = 0 FROM (SELECT e FROM (SELECT l_partkey % 5 AS e, l_orderkey AS o FROM lineitem UNION ALL SELECT l_suppkey % 5, l_orderkey FROM lineitem) WHERE o = x.l_orderkey GROUP BY e HAVING count(*) % 2 = 1)) AS closed FROM lineitem x GROUP BY l_orderkey")
def ring_ends(spark, sf):
    ways = _t(spark, sf, "lineitem").select("l_orderkey", (F.col("l_partkey") % 5).alias("a"), (F.col("l_suppkey") % 5).alias("b"))
    return tracks.joined_rings(ways, "l_orderkey", "a", "b")


@query("SELECT user_id, CAST(sum(CASE WHEN s > 5 THEN s - 10 ELSE s END) AS BIGINT) AS advance, round(sum(CASE WHEN s > 5 THEN s - 10 ELSE s END) / 10.0, 6) AS laps FROM (SELECT user_id, (k - lag(k) OVER (PARTITION BY user_id ORDER BY ts, event_id) + 10) % 10 AS s FROM (SELECT user_id, ts, event_id, CAST(y AS BIGINT) % 10 AS k FROM (" + _TRACK + "))) GROUP BY 1")
def lap_count(spark, sf):
    rows = _track(spark, sf).select("user_id", "ts", "event_id", (F.col("y").cast("long") % 10).alias("k"))
    stepped = rows.select("user_id", sequences.laps("k", F.lit(10), ["user_id"], ["ts", "event_id"]).alias("s"))
    return stepped.groupBy("user_id").agg(F.sum("s").cast("long").alias("advance"), F.round(F.sum("s") / 10, 6).alias("laps"))


# Formats and parsing


@query(r"""WITH l AS (SELECT doc_id, i, line, CAST(regexp_full_match(line, '[A-Za-z ]*[A-Za-z][A-Za-z ]*') AS INT) AS head FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents) WHERE NOT regexp_full_match(line, '=+')),
s AS (SELECT *, sum(head) OVER (PARTITION BY doc_id ORDER BY i) AS section FROM l)
SELECT doc_id, CAST(section AS BIGINT) AS section, max(line) FILTER (head = 1) AS heading, count(*) FILTER (head = 0) AS lines FROM s GROUP BY ALL""")
def sections(spark, sf):
    """Lines of letters and blanks only head a section; rules of equals signs are no lines."""
    lines = _t(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).where(~F.col("line").rlike("^=+$"))
    marked = lines.withColumn("head", F.col("line").rlike("^[A-Za-z ]*[A-Za-z][A-Za-z ]*$").cast("int"))
    numbered = marked.withColumn("section", F.sum("head").over(W.partitionBy("doc_id").orderBy("i").rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy("doc_id", "section").agg(F.max(F.when(F.col("head") == 1, F.col("line"))).alias("heading"), aggregates.count_if(F.col("head") == 0).alias("lines"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%B %-d, %Y') AS shown, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S+00:00') AS xml, strftime(o_orderdate, '%b %Y') AS label FROM orders")
def date_formats(spark, sf):
    d = F.col("o_orderdate")
    return _t(spark, sf, "orders").select("o_orderkey", F.date_format(d, "MMMM d, yyyy").alias("shown"), F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("xml"), dates.month_label(d).alias("label"))


@query("SELECT event_id, CASE WHEN CAST(props->>'$.k' AS INT) % 3 = 0 THEN CAST(props->>'$.k' AS DOUBLE) END AS scalar, '{\"id\":' || event_id || ',\"k\":' || CASE WHEN CAST(props->>'$.k' AS INT) > 50 THEN 'null' ELSE CAST(CAST(props->>'$.k' AS INT) AS VARCHAR) END || ',\"kind\":\"' || event_type || '\"}' AS doc FROM events")
def json_clean(spark, sf):
    """A value only where there is exactly one; documents with what isn't a number as null, not left out."""
    k = F.from_json("props", "k int")["k"]
    listed = F.when(k % 3 == 0, F.array(k.cast("string"))).when(k % 3 == 1, F.array(F.lit("x"))).otherwise(F.array(k.cast("string"), F.lit("2")))
    scalar = F.when(F.size(listed) == 1, F.get(listed, F.lit(0)).try_cast("double"))
    doc = F.to_json(F.struct(F.col("event_id").alias("id"), numeric.finite(F.when(k > 50, F.lit(float("nan"))).otherwise(k.cast("double"))).cast("int").alias("k"), F.col("event_type").alias("kind")), {"ignoreNullFields": "false"})
    return _t(spark, sf, "events").select("event_id", scalar.alias("scalar"), doc.alias("doc"))


@query(r"""SELECT c_custkey, trim(c_name) AS trimmed, trim(regexp_replace(c_name, '(?i)^\s*customer#\s*', '')) AS bare,
' ' || c_mktsegment || ' ' || c_name || ', "' || replace(c_name, '&', '&amp;') || '." ' || c_mktsegment || ', 1998.' AS cited,
array_to_string(list_transform(string_split(c_name || '; Ann Lee', '; '), lambda a : CASE WHEN contains(a, 'Lee') THEN '<strong>' || a || '</strong>' ELSE a END), ', ') AS authors,
c_name || '<br />' || c_mktsegment || '; ' || 'x' AS line, format('{:,.1f}', round(CAST(c_acctbal AS DECIMAL(18,2)), 1)) AS money FROM customer""")
def text_formats(spark, sf):
    name, seg = F.col("c_name"), F.col("c_mktsegment")
    cited = text.citation(F.array(F.struct(seg.alias("first"), name.alias("last"))), name, seg, F.lit("1998"))
    return _t(spark, sf, "customer").select(
        "c_custkey", text.clean(name).alias("trimmed"), text.strip_prefix(name, "CUSTOMER#").alias("bare"), cited.alias("cited"),
        text.marked_authors(F.concat(name, F.lit("; Ann Lee")), "Lee").alias("authors"), text.place_line(name, seg, F.lit(" x ")).alias("line"), text.grouped_number(F.col("c_acctbal").cast("decimal(18,2)"), 1).alias("money"),
    )


@query("""SELECT o_orderkey, CAST(o_orderdate AS DATE) AS parsed, CAST(epoch(CAST(o_orderdate AS DATE) - INTERVAL 2 DAY) AS BIGINT) AS cursor,
strftime(o_orderdate + INTERVAL 30 HOUR - INTERVAL 5 HOUR, '%Y-%m-%d %H') AS winter FROM orders WHERE month(o_orderdate) IN (1, 2, 12)""")
def clock_formats(spark, sf):
    d = F.col("o_orderdate")
    rows = _t(spark, sf, "orders").where(F.month(d).isin(1, 2, 12))
    return rows.select("o_orderkey", dates.short_date(F.date_format(d, "M/d/yy")).alias("parsed"), dates.cursor(d).alias("cursor"), F.date_format(dates.valid_time(d, F.lit(30)), "yyyy-MM-dd HH").alias("winter"))


@query("SELECT l_orderkey, l_linenumber, round(l_tax * 3600, 6) AS rate, round(1 / (1 + exp(-l_discount)), 6) AS odds, round(least(1, greatest(0, l_quantity / 50)), 6) AS clamped, CASE WHEN l_discount >= 0.05 THEN 1 ELSE 0 END AS flag, CASE WHEN l_quantity <= CASE l_returnflag WHEN 'R' THEN 18 WHEN 'A' THEN 36 ELSE 48 END THEN l_tax END AS masked FROM lineitem")
def number_formats(spark, sf):
    q = F.col("l_quantity")
    return _t(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(numeric.hourly(F.col("l_tax")), 6).alias("rate"), F.round(numeric.logistic(F.col("l_discount")), 6).alias("odds"), F.round(numeric.clamp(q / 50, 0.0, 1.0), 6).alias("clamped"),
        evaluation.binary(F.col("l_discount"), 0.05).alias("flag"), evaluation.masked_beyond(F.col("l_tax"), q, F.col("l_returnflag"), {"R": 18, "A": 36}).alias("masked"),
    )


@query("SELECT s_suppkey, round(s_acctbal * 111194.92664455873 * cos(radians(44.2)) / 1e6, 4) AS px, round(s_nationkey * 111194.92664455873 / 1e6, 4) AS py, round(pow(s_acctbal - 1000 - greatest(0, least(1, ((s_acctbal - 1000) * 3000 + s_nationkey * 10) / (9000100.0))) * 3000, 2) + pow(s_nationkey - greatest(0, least(1, ((s_acctbal - 1000) * 3000 + s_nationkey * 10) / (9000100.0))) * 10, 2), 3) AS d2, round(CASE WHEN s_nationkey > 0 THEN abs(s_acctbal) / (s_nationkey * s_nationkey / (4 * pi())) ELSE 0 END, 4) AS roundness FROM supplier")
def plane_formats(spark, sf):
    a, n = F.col("s_acctbal"), F.col("s_nationkey").cast("double")
    x, y = geometry.project(n, a, 44.2, 111194.92664455873)
    d2 = geometry.segment_distance2(a, n, F.lit(1000.0), F.lit(0.0), F.lit(4000.0), F.lit(10.0))
    return _t(spark, sf, "supplier").select("s_suppkey", F.round(x / 1e6, 4).alias("px"), F.round(y / 1e6, 4).alias("py"), F.round(d2, 3).alias("d2"), F.round(geometry.circularity(a, n), 4).alias("roundness"))


@query("SELECT event_id, value AS value_a, CAST(NULL AS DOUBLE) AS missing FROM events")
def fitted_columns(spark, sf):
    rows = _t(spark, sf, "events").select("event_id", F.col("value").alias("value_a"), F.col("value").alias("value_b"))
    return series.reindexed(series.with_suffix(rows, "a", ("event_id",)), ["event_id", "value_a", "missing"])


# Evaluation

_CUTS = "(SELECT round(0.05 + i * 0.045, 10) AS threshold FROM range(21) r(i))"
_SCORED = "(SELECT value / 100 AS score, CAST(CAST(props->>'$.k' AS INT) > 60 AS INT) AS label FROM events)"
_SWEPT = f"SELECT threshold, tp, fp, fn, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS r FROM (SELECT threshold, count(*) FILTER (score >= threshold AND label = 1) AS tp, count(*) FILTER (score >= threshold AND label = 0) AS fp, count(*) FILTER (score < threshold AND label = 1) AS fn FROM {_CUTS}, {_SCORED} GROUP BY 1)"


@query(f"WITH s AS ({_SWEPT}) SELECT 'precision' AS objective, (SELECT threshold FROM s ORDER BY CAST(r >= 0.5 AS INT) DESC, p DESC, threshold LIMIT 1) AS threshold UNION ALL SELECT 'recall', (SELECT threshold FROM s ORDER BY CAST(p >= 0.1 AS INT) DESC, r DESC, threshold LIMIT 1) UNION ALL SELECT 'cost', (SELECT threshold FROM s ORDER BY fp + 10 * fn, threshold LIMIT 1)")
def threshold_objectives(spark, sf):
    scored = _t(spark, sf, "events").select((F.col("value") / 100).alias("score"), (F.from_json("props", "k int")["k"] > 60).cast("int").alias("label"))
    return evaluation.objectives(evaluation.sweep(scored, "score", "label", 0.05, 0.95, 21), recall_floor=0.5, precision_floor=0.1, miss_cost=10)


@query("SELECT CAST(CAST('0x' || md5(CAST(event_id AS VARCHAR))[1:6] AS BIGINT) % 5 AS INT) AS fold, count(*) AS n, count(DISTINCT user_id) AS groups FROM events GROUP BY 1")
def row_folds(spark, sf):
    """Folds by row, which split groups; kept to show by how much they flatter."""
    return _t(spark, sf, "events").groupBy(evaluation.row_fold(F.col("event_id")).alias("fold")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("groups"))


@query()
def regression_report(spark, sf):
    """Mean absolute error and R2 of a boosted regression, out of fold. Trees are no matter for SQL; tested on a known function."""
    rows = _t(spark, sf, "lineitem").select("l_orderkey", "l_quantity", "l_discount", "l_tax", "l_extendedprice")
    return evaluation.regression(rows, ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", "l_orderkey")
