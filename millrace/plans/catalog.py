"""Every query of the library outside the training-data package, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions import dates, geometry, numeric, text
from millrace.operators import aggregates, clusters, evaluation, quadtree, sequences, series, sets, spatial
from millrace.plans.registry import oracle_sql, queries, query
from millrace.plans.registry import table as _t
from millrace.sources import writers

__all__ = ["oracle_sql", "queries"]


_BOARD = """SELECT o_custkey, count(*) AS registrations, count(*) FILTER (o_orderpriority = '1-URGENT') AS as_lead,
  count(*) FILTER (o_orderstatus = 'F') AS sails, count(*) FILTER (o_orderstatus = 'F' AND o_orderpriority < '3') AS races,
  count(*) FILTER (o_orderstatus = 'F' AND o_orderpriority >= '3') AS pleasure,
  count(*) FILTER (o_orderstatus = 'F' AND o_totalprice / 10000 > 6) AS full_day,
  count(*) FILTER (o_orderstatus = 'F' AND o_totalprice / 10000 > 24) AS multi_day,
  CAST(coalesce(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (o_orderstatus = 'F'), 0) AS DOUBLE) AS hours
FROM orders GROUP BY o_custkey"""


def _board(spark: SparkSession, sf: str) -> DataFrame:
    price = F.col("o_totalprice")
    board = aggregates.leaderboard(_t(spark, sf, "orders").withColumn("h", price / 10000), ["o_custkey"], F.col("o_orderstatus") == "F", F.col("o_orderpriority") < "3", F.col("h"), F.col("o_orderpriority") == "1-URGENT")
    exact = _t(spark, sf, "orders").groupBy("o_custkey").agg(F.coalesce(F.sum(F.when(F.col("o_orderstatus") == "F", price.cast("decimal(18,2)"))), F.lit(0)).cast("double").alias("hours"))
    return board.drop("hours").join(exact, "o_custkey")


@query(f"SELECT c_name, b.* FROM ({_BOARD}) b JOIN customer ON c_custkey = o_custkey")
def leaderboard(spark, sf):
    names = _t(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return _board(spark, sf).join(names, "o_custkey")


@query(f"SELECT o_custkey, sails, hours, row_number() OVER (ORDER BY hours DESC, o_custkey) AS rank FROM ({_BOARD}) ORDER BY hours DESC, o_custkey LIMIT 15")
def leaderboard_topk(spark, sf):
    return aggregates.top_k(_board(spark, sf).select("o_custkey", "sails", "hours"), "hours", "o_custkey").withColumn("rank", F.col("rank").cast("long"))


@query(f"SELECT count(*) AS people, CAST(sum(registrations) AS BIGINT) AS registrations, CAST(sum(sails) AS BIGINT) AS sails, CAST(sum(races) AS BIGINT) AS races FROM ({_BOARD})")
def leaderboard_totals(spark, sf):
    return aggregates.totals(_board(spark, sf), ["registrations", "sails", "races"])


@query("SELECT o_custkey, o_orderkey, o_orderdate, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS nth FROM orders")
def person_history(spark, sf):
    """Every customer's orders, newest first."""
    rows = _t(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus")
    nth = F.row_number().over(W.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey")).cast("long")
    return rows.withColumn("nth", nth)


@query("""SELECT category, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity, max(l_extendedprice) AS top_price
FROM lineitem JOIN (VALUES ('A', 'returned'), ('R', 'returned'), ('N', 'kept')) c(flag, category) ON l_returnflag = flag GROUP BY category""")
def category_totals(spark, sf):
    groups = spark.createDataFrame([("returned", ["A", "R"]), ("kept", ["N"])], "category string, flags array<string>")
    by_flag = F.broadcast(series.inverted(groups, "category", "flags").withColumnRenamed("member", "l_returnflag"))  # three rows
    rows = _t(spark, sf, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice").join(by_flag, "l_returnflag")
    return rows.groupBy("category").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("quantity"), F.max("l_extendedprice").alias("top_price"))


@query("WITH e AS (SELECT date_trunc('month', min(o_orderdate)) AS a, date_trunc('month', max(o_orderdate)) AS b FROM orders), p AS (SELECT CAST(year(o_orderdate) AS INT) AS year, month(o_orderdate) AS m, count(*) AS v FROM orders GROUP BY ALL), y AS (SELECT CAST(unnest(range(year(a), year(b) + 1)) AS INT) AS year, a, b FROM e) SELECT y.year, " + ", ".join(f"CASE WHEN make_date(y.year, {m}, 1) BETWEEN a AND b THEN coalesce(max(v) FILTER (m = {m}), 0) END AS m{m:02d}" for m in range(1, 13)) + ", CAST(coalesce(sum(v), 0) AS BIGINT) AS total FROM y LEFT JOIN p ON p.year = y.year GROUP BY y.year, a, b")
def year_month_matrix(spark, sf):
    return aggregates.year_month_matrix(_t(spark, sf, "orders"), "o_orderdate", F.count("*"))


@query("SELECT CAST(year(o_orderdate) AS INT) AS year, count(*) FILTER (o_orderpriority < '3') AS races, count(*) FILTER (o_orderpriority >= '3') AS pleasure, count(DISTINCT o_custkey) AS people FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def yearly_distinct(spark, sf):
    done = _t(spark, sf, "orders").where("o_orderstatus = 'F'")
    n = aggregates.count_if
    return done.groupBy(F.year("o_orderdate").alias("year")).agg(n(F.col("o_orderpriority") < "3").alias("races"), n(F.col("o_orderpriority") >= "3").alias("pleasure"), F.countDistinct("o_custkey").alias("people"))


@query("""WITH d AS (SELECT CAST(unnest(generate_series(min(ts)::DATE, max(ts)::DATE, INTERVAL 1 DAY)) AS DATE) AS day FROM events), c AS (SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY ALL)
SELECT d.day, t.event_type, coalesce(n, 0) AS n FROM d CROSS JOIN (SELECT DISTINCT event_type FROM events) t LEFT JOIN c ON c.day = d.day AND c.event_type = t.event_type""")
def dense_daily(spark, sf):
    events = _t(spark, sf, "events").select(F.to_date("ts").alias("day"), "event_type")
    counts = events.groupBy("day", "event_type").agg(F.count("*").alias("n"))
    kinds = events.groupBy().agg(F.collect_set("event_type").alias("k"))  # a handful of names
    spine = dates.day_spine(events, "day").join(F.broadcast(kinds)).select("day", F.explode("k").alias("event_type"))
    return aggregates.on_spine(counts, spine, ["day", "event_type"], ["n"])


@query("""WITH m AS (SELECT CAST(unnest(generate_series(date_trunc('month', min(o_orderdate)), date_trunc('month', max(o_orderdate)), INTERVAL 1 MONTH)) AS DATE) AS month FROM orders),
c AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS n FROM orders GROUP BY 1), f AS (SELECT month, coalesce(n, 0) AS n FROM m LEFT JOIN c USING (month))
SELECT month, n, CASE WHEN row_number() OVER (ORDER BY month) >= 3 THEN round(avg(n) OVER (ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) END AS trailing FROM f""")
def trailing_mean(spark, sf):
    orders = _t(spark, sf, "orders").select(F.to_date("o_orderdate").alias("d"))
    counts = orders.groupBy(F.trunc("d", "month").alias("month")).agg(F.count("*").alias("n"))
    rows = aggregates.on_spine(counts, dates.month_spine(orders, "d"), "month", ["n"])
    return rows.select("month", "n", F.round(sequences.trailing_mean("n", [F.lit(0)], ["month"]), 6).alias("trailing"))  # a row a month, whatever the input


@query("""SELECT year, doy, CAST(sum(s) OVER (PARTITION BY year ORDER BY doy) AS DOUBLE) AS running
FROM (SELECT CAST(year(o_orderdate) AS INT) AS year, CAST(dayofyear(o_orderdate) AS INT) AS doy, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS s FROM orders GROUP BY ALL)""")
def cumulative_doy(spark, sf):
    day = _t(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("year"), F.dayofyear("o_orderdate").alias("doy")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("s"))
    return day.select("year", "doy", sequences.cumulative("s", ["year"], ["doy"]).cast("double").alias("running"))


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) FILTER (strftime(o_orderdate, '%m-%d') >= '12-21' OR strftime(o_orderdate, '%m-%d') <= '03-20') AS winter, count(*) FILTER (month(o_orderdate) NOT IN (1, 2, 3)) AS sailing FROM orders GROUP BY 1")
def seasonal_filter(spark, sf):
    d = F.col("o_orderdate")
    return _t(spark, sf, "orders").groupBy(dates.month_key(d).alias("month")).agg(aggregates.count_if(dates.in_season(d)).alias("winter"), aggregates.count_if(~F.month(d).isin(1, 2, 3)).alias("sailing"))


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity BETWEEN 24 AND 26 AND l_returnflag = 'R' AND l_discount >= 0.05")
def band_filter(spark, sf):
    return _t(spark, sf, "lineitem").where(F.col("l_quantity").between(25 - 1, 25 + 1) & (F.col("l_returnflag") == "R") & (F.col("l_discount") >= 0.05)).select("l_orderkey", "l_linenumber", "l_quantity")


@query("""WITH e AS (SELECT strftime(min(o_orderdate), '%Y-%m') AS lo, strftime(max(o_orderdate), '%Y-%m') AS hi, max(o_orderdate) AS b FROM orders),
r AS (SELECT 'all' AS preset, lo AS a, hi AS z FROM e UNION ALL SELECT '12', greatest(lo, strftime(b - INTERVAL 11 MONTH, '%Y-%m')), hi FROM e UNION ALL SELECT 'ytd', greatest(lo, substr(hi, 1, 4) || '-01'), hi FROM e)
SELECT preset, a AS from_month, z AS to_month, count(*) AS n FROM r JOIN orders ON strftime(o_orderdate, '%Y-%m') BETWEEN a AND z GROUP BY ALL""")
def range_presets(spark, sf):
    orders = _t(spark, sf, "orders")
    ends = orders.agg(F.min("o_orderdate").alias("lo"), F.max("o_orderdate").alias("hi"))
    made = [F.struct(F.lit(k).alias("preset"), *[c.alias(n) for c, n in zip(dates.preset(F.col("lo"), F.col("hi"), k), ("from_month", "to_month"))]) for k in ("all", "12", "ytd")]
    spans = ends.select(F.inline(F.array(*made)))
    months = orders.groupBy(dates.month_key(F.col("o_orderdate")).alias("m")).agg(F.count("*").alias("c"))  # counts first: the range join meets months, not orders
    return months.join(F.broadcast(spans), F.col("m").between(F.col("from_month"), F.col("to_month"))).groupBy("preset", "from_month", "to_month").agg(F.sum("c").alias("n"))


@query("SELECT p_brand, median(p_retailprice) AS median_price, count(*) AS n, min(p_retailprice) AS low, max(p_retailprice) AS high FROM part GROUP BY p_brand")
def median_group(spark, sf):
    parts = _t(spark, sf, "part").select("p_brand", "p_retailprice")
    medians = aggregates.group_medians(parts, ["p_brand"], "p_retailprice").withColumnRenamed("median", "median_price")
    return parts.groupBy("p_brand").agg(F.count("*").alias("n"), F.min("p_retailprice").alias("low"), F.max("p_retailprice").alias("high")).join(medians, "p_brand", "left")


@query("SELECT n_name, count(s_suppkey) AS suppliers, CASE WHEN count(s_suppkey) > 0 THEN round(max(s_acctbal), 2) END AS best FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name")
def roster_left(spark, sf):
    per = _t(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("suppliers"), F.round(F.max("s_acctbal"), 2).alias("best"))
    return aggregates.on_spine(per, _t(spark, sf, "nation"), "n_nationkey", ["suppliers"]).select("n_name", "suppliers", "best")


_BOXES = [("low", -1000.0, 2000.0, 0.0, 10.0), ("middle", 1000.0, 6000.0, 5.0, 20.0), ("high", 5000.0, 1e9, 0.0, 30.0)]


@query("SELECT region, count(*) AS n FROM (SELECT CASE " + " ".join(f"WHEN c_acctbal BETWEEN {a} AND {b} AND c_nationkey BETWEEN {c} AND {d} THEN '{n}'" for n, a, b, c, d in _BOXES) + " ELSE 'other' END AS region FROM customer) GROUP BY region")
def first_match_region(spark, sf):
    return _t(spark, sf, "customer").groupBy(spatial.first_box(F.col("c_acctbal"), F.col("c_nationkey").cast("double"), _BOXES).alias("region")).agg(F.count("*").alias("n"))


@query("""WITH o AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month, o_totalprice AS price FROM orders WHERE o_orderdate < '1998-06-01'),
n AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month, round(o_totalprice * 2, 2) AS price FROM orders WHERE o_orderdate >= '1998-01-01')
SELECT * FROM o WHERE month < '1998-01' AND o_orderkey NOT IN (SELECT o_orderkey FROM n) UNION ALL SELECT * FROM n""")
def window_replace(spark, sf):
    rows = _t(spark, sf, "orders").select("o_orderkey", dates.month_key(F.col("o_orderdate")).alias("month"), F.col("o_totalprice").alias("price"))
    new = rows.where("month >= '1998-01'").withColumn("price", F.round(F.col("price") * 2, 2))  # scraped anew from that month on
    return sets.window_replace(rows.where("month < '1998-06'"), new, "o_orderkey", F.col("month"), "1998-01")


@query("SELECT user_id, event_type, event_id, ts, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def upsert_latest(spark, sf):
    return sets.upsert(_t(spark, sf, "events").select("user_id", "event_type", "event_id", "ts", "value"), ["user_id", "event_type"], ["ts", "event_id"])


@query("""SELECT user_id, event_id, event_type, row_number() OVER w AS nth, first_value(event_type) OVER w AS first_type, first_value(ts) OVER w AS first_ts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def first_row_entities(spark, sf):
    """Each user's first row as its attributes, beside all its events in order, a row each."""
    rows = _t(spark, sf, "events").select("user_id", "ts", "event_id", "event_type")
    first = aggregates.first_rows(rows.withColumn("first_type", F.col("event_type")).withColumn("first_ts", F.col("ts")), ["user_id"], ["ts", "event_id"], ["first_type", "first_ts"])
    nth = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    return rows.withColumn("nth", nth).join(first, "user_id").drop("ts")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def antijoin_resume(spark, sf):
    done = _t(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return sets.missing(_t(spark, sf, "customer").select("c_custkey", "c_name"), done, "c_custkey")


_STATUS = "CASE event_type WHEN 'purchase' THEN 'Skipper' WHEN 'signup' THEN 'Confirmed' WHEN 'click' THEN 'pending' WHEN 'error' THEN 'Cancelled' ELSE '' END"


@query(f"""SELECT user_id, day, CASE WHEN bool_or(s LIKE '%skipper%') THEN 's' ELSE 'c' END AS role,
CASE WHEN bool_or(s LIKE '%skipper%' OR s LIKE '%confirmed%') THEN 'c' WHEN bool_or(s LIKE '%pending%') THEN 'p' WHEN bool_or(s LIKE '%cancel%') THEN 'x' ELSE 'u' END AS status
FROM (SELECT user_id, CAST(ts AS DATE) AS day, lower({_STATUS}) AS s FROM events) GROUP BY ALL""")
def status_precedence(spark, sf):
    role, status = aggregates.status_precedence(F.expr(_STATUS))
    return _t(spark, sf, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(role.alias("role"), status.alias("status"))


@query("SELECT event_id, user_id, CASE WHEN lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) = event_type THEN 24 ELSE 8 END AS hours FROM events")
def lead_label(spark, sf):
    return _t(spark, sf, "events").select("event_id", "user_id", sequences.lead_equal("event_type", ["user_id"], ["ts", "event_id"]).alias("hours"))


@query("""SELECT user_id, CAST(island AS BIGINT) AS island, event_type, count(*) AS n, min(ts) AS first, max(ts) AS last FROM (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island
FROM (SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))) GROUP BY ALL""")
def islands(spark, sf):
    return sequences.islands(_t(spark, sf, "events"), "event_type", ["user_id"], ["ts", "event_id"])


@query("""SELECT user_id, round(sum(CASE WHEN n IS NULL THEN 0 ELSE (c + n) / 2.0 END), 3) AS credited, count(*) AS points FROM (SELECT user_id, CAST(value > 50 AS INT) AS c, lead(CAST(value > 50 AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) GROUP BY user_id""")
def half_credit(spark, sf):
    rows = _t(spark, sf, "events").select("user_id", sequences.half_credit(F.col("value") > 50, F.lit(1.0), ["user_id"], ["ts", "event_id"]).alias("c"))
    return rows.groupBy("user_id").agg(F.round(F.sum("c"), 3).alias("credited"), F.count("*").alias("points"))


@query("""WITH s AS (SELECT l_orderkey, list(DISTINCT l_suppkey) AS supp FROM lineitem GROUP BY 1)
SELECT target, round(sum(CAST(o_totalprice AS DOUBLE) / len(supp)), 1) AS allocated, count(*) AS n FROM (SELECT o_totalprice, supp, unnest(supp) AS target FROM orders JOIN s ON l_orderkey = o_orderkey) GROUP BY target""")
def fraction_alloc(spark, sf):
    per = _t(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set("l_suppkey").alias("supp"))
    rows = _t(spark, sf, "orders").select("o_orderkey", "o_totalprice").join(per, "o_orderkey")
    return aggregates.fractional_allocation(rows, F.col("o_totalprice"), "supp").withColumn("allocated", F.round("allocated", 1))


@query("SELECT least(k, 4) AS bucket, count(*) AS n FROM (SELECT l_orderkey, count(*) AS k FROM lineitem GROUP BY 1) GROUP BY 1")
def capped_hist(spark, sf):
    lines = _t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("k"))
    return aggregates.capped_histogram(lines, F.col("k"))


_PAIRS = """WITH m AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS e FROM lineitem), n AS (SELECT o, count(*) AS n FROM m GROUP BY o)
SELECT a, b, k / (x.n + y.n - k) AS similarity FROM (SELECT p.o AS a, q.o AS b, count(*) AS k FROM m p JOIN m q ON p.e = q.e AND p.o < q.o GROUP BY ALL) JOIN n x ON x.o = a JOIN n y ON y.o = b WHERE k / (x.n + y.n - k) >= 0.5"""


def _pairs(spark, sf):
    return sets.jaccard_pairs(_t(spark, sf, "lineitem").select("l_orderkey", "l_partkey"), "l_orderkey", "l_partkey", 0.5)


@query(_PAIRS)
def jaccard_pairs(spark, sf):
    """Orders of like parts. Parts grow with the orders, so what meets at one part does not."""
    return _pairs(spark, sf)


@query("""WITH m AS (SELECT DISTINCT l_orderkey AS o, l_suppkey AS e FROM lineitem), s AS (SELECT o, count(*) AS n, list(e ORDER BY e) AS es FROM m GROUP BY o),
p AS (SELECT a, b FROM (SELECT p.o AS a, q.o AS b, count(*) AS k FROM m p JOIN m q ON p.e = q.e AND p.o < q.o GROUP BY ALL) JOIN s x ON x.o = a JOIN s y ON y.o = b WHERE k / (x.n + y.n - k) >= 0.6),
l AS (SELECT o, count(*) AS links FROM (SELECT a AS o FROM p UNION ALL SELECT b FROM p) GROUP BY o)
SELECT o AS id, min(o) OVER (PARTITION BY es) AS class_id, count(*) OVER (PARTITION BY es) AS copies, coalesce(links, 0) AS links FROM s LEFT JOIN l USING (o)""")
def jaccard_links(spark, sf):
    """Orders by sets of suppliers: equal ones as a class, and how many others are alike. Single suppliers' orders are equal in heaps."""
    return sets.jaccard_links(_t(spark, sf, "lineitem").select("l_orderkey", "l_suppkey"), "l_orderkey", "l_suppkey", 0.6)


@query()
def medoid_clusters(spark, sf):
    """Clusters of orders of like parts. A greedy iteration, which SQL can't express; tested against the one-by-one order."""
    orders = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("id")).distinct()
    return clusters.clustered_sets(orders, _t(spark, sf, "lineitem").select("l_orderkey", "l_partkey"), "l_orderkey", "l_partkey", 0.5)


_CENTRES = [(0.0, 5.0), (3000.0, 12.0), (6000.0, 20.0), (9000.0, 2.0)]


@query("SELECT nearest, count(*) AS n FROM (SELECT arg_min(i, (d, i)) AS nearest FROM (SELECT c_custkey, i, power(c_acctbal - x, 2) + power(c_nationkey - y, 2) AS d FROM customer, (VALUES " + ", ".join(f"({i}, {x}, {y})" for i, (x, y) in enumerate(_CENTRES)) + ") v(i, x, y)) GROUP BY c_custkey) GROUP BY nearest")
def nearest_one(spark, sf):
    return _t(spark, sf, "customer").groupBy(spatial.nearest_of_few(_CENTRES, F.col("c_acctbal"), F.col("c_nationkey").cast("double")).alias("nearest")).agg(F.count("*").alias("n"))


_NEAR = """FROM (SELECT c_custkey AS pid, c_acctbal AS px, CAST(c_custkey % 997 AS DOUBLE) AS py FROM customer) JOIN (SELECT s_suppkey AS tid, s_acctbal AS tx, CAST(s_suppkey * 37 % 997 AS DOUBLE) AS ty FROM supplier)
ON (px - tx) * (px - tx) + (py - ty) * (py - ty) <= 40000"""


def _near(spark, sf):
    p = _t(spark, sf, "customer").select(F.col("c_custkey").alias("pid"), F.col("c_acctbal").alias("x"), (F.col("c_custkey") % 997).cast("double").alias("y"))
    t = _t(spark, sf, "supplier").select(F.col("s_suppkey").alias("tid"), F.col("s_acctbal").alias("x"), (F.col("s_suppkey") * 37 % 997).cast("double").alias("y"))
    return p, t


@query(f"SELECT tid, count(DISTINCT pid) AS visitors {_NEAR} GROUP BY tid")
def radius_semi(spark, sf):
    return quadtree.visitors(*_near(spark, sf), 200.0)


@query(f"SELECT pid, arg_min(tid, ((px - tx) * (px - tx) + (py - ty) * (py - ty), -tid)) AS tid {_NEAR} GROUP BY pid")
def nearest_within(spark, sf):
    return quadtree.nearest_within(*_near(spark, sf), 200.0).select("pid", "tid")


_OUTER = [(0.0, 0.0), (8000.0, 2.0), (9500.0, 20.0), (4000.0, 24.5), (500.0, 18.0)]
_INNER = [(3000.0, 8.0), (5000.0, 8.5), (5000.0, 14.5), (3000.0, 15.0)]


def _ray(ring: list) -> str:
    legs = [f"CAST((({y1} > y) <> ({y2} > y)) AND x < ({x2} - {x1}) * (y - {y1}) / ({y2} - {y1}) + {x1} AS INT)" for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]]) if y1 != y2]
    return "(" + " + ".join(legs) + ") % 2 = 1"


@query(f"SELECT c_custkey FROM (SELECT c_custkey, c_acctbal AS x, CAST(c_nationkey AS DOUBLE) AS y FROM customer) WHERE {_ray(_OUTER)} AND NOT ({_ray(_INNER)})")
def point_in_polygon(spark, sf):
    return _t(spark, sf, "customer").where(spatial.in_region(F.col("c_acctbal"), F.col("c_nationkey").cast("double"), [_OUTER], [_INNER])).select("c_custkey")


@query("SELECT element, p_partkey AS member, row_number() OVER (PARTITION BY element ORDER BY p_partkey) AS nth, count(*) OVER (PARTITION BY element) AS n FROM (SELECT DISTINCT p_partkey, unnest(string_split(p_name, ' ')) AS element FROM part) WHERE element <> ''")
def group_by_array(spark, sf):
    return aggregates.group_by_element(_t(spark, sf, "part"), F.split("p_name", " "), "p_partkey")


@query("SELECT event_type, CAST(day AS DATE) AS day, n, total FROM (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL) JOIN (SELECT event_type, count(*) AS total FROM events GROUP BY ALL) USING (event_type)")
def series_roundtrip(spark, sf):
    daily = _t(spark, sf, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    arrays = series.to_arrays(daily, ["event_type"], "day", "n").withColumn("total", F.aggregate("y", F.lit(0).cast("long"), lambda a, v: a + v))
    return series.to_rows(arrays, ["event_type", "total"]).select("event_type", F.col("x").alias("day"), F.col("y").alias("n"), "total")


@query("SELECT CAST(ts AS DATE) AS day, " + ", ".join(f"max(value) FILTER (event_type = '{k}') AS {k}" for k in ("click", "error", "purchase")) + " FROM events GROUP BY 1")
def series_wide(spark, sf):
    best = _t(spark, sf, "events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.max("value").alias("v"))
    return series.to_wide(best, ["day"], "event_type", "v", ["click", "error", "purchase"])


@query("SELECT event_id, CAST(props->>'$.k' AS INT) AS k, CASE WHEN event_type LIKE '%_web' OR event_type LIKE '%_app' THEN event_type ELSE event_type || '_web' END AS label FROM events")
def json_props(spark, sf):
    return _t(spark, sf, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"), text.with_model_suffix(F.col("event_type"), F.lit("web"), ("web", "app")).alias("label"))


@query("SELECT c_custkey, substr(sha1('' || lower(trim(c_mktsegment)) || '|' || lower(trim(c_name))), 1, 16) AS id, upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) || ' ' || upper(substr(c_name, 1, 1)) || '.' AS shown, c_mktsegment IN ('1', 'yes', 'true') AS flag FROM customer")
def ids_names(spark, sf):
    seg, name = F.col("c_mktsegment"), F.col("c_name")
    return _t(spark, sf, "customer").select("c_custkey", text.opaque_id(seg, name).alias("id"), text.display_name(seg, name).alias("shown"), text.truthy(seg).alias("flag"))


@query("""SELECT p_partkey, replace(regexp_replace(replace(translate(p_name || ' {x} [y] a--b', '{}\\', ''), ' ', '-'), '\\[.*\\]|[^a-zA-Z0-9_-]', '', 'g'), '--', '-') AS slug,
replace(replace(replace(replace(replace('<' || p_name || '> & "''', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS escaped, regexp_replace(p_name || '/a b', '[^A-Za-z0-9._-]+', '_', 'g') AS safe FROM part""")
def slug_escape(spark, sf):
    name = F.col("p_name")
    return _t(spark, sf, "part").select("p_partkey", text.slug(F.concat(name, F.lit(" {x} [y] a--b"))).alias("slug"), text.escape_html(F.concat(F.lit("<"), name, F.lit("> & \"'"))).alias("escaped"), text.file_safe(F.concat(name, F.lit("/a b"))).alias("safe"))


@query("SELECT doc_id, w AS words, CASE WHEN w < 180 THEN 'less than 1' WHEN w < 360 THEN '1' ELSE CAST(w // 160 AS VARCHAR) END AS minutes FROM (SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '')) AS INT) AS w FROM documents)")
def read_time(spark, sf):
    words = text.word_count(F.col("text"))
    return _t(spark, sf, "documents").select("doc_id", words.alias("words")).withColumn("minutes", text.read_time(F.col("words")))


@query("SELECT page_id, length(regexp_replace(html, '(?is)<script.*?</script>|<!--.*?-->|<style.*?</style>|<[^>]*>', '', 'g')) AS n_text FROM pages")
def strip_html(spark, sf):
    return _t(spark, sf, "pages").select("page_id", F.length(text.strip_html(F.col("html"))).cast("long").alias("n_text"))


@query("""SELECT s_suppkey, '---' || chr(10) || 'title: "' || s_name || '"' || chr(10) || 'date: 2024-01-01' || CASE WHEN s_nationkey > 9 THEN chr(10) || 'venue: ''nation ' || s_nationkey || '''' ELSE '' END || chr(10) || '---' || chr(10) || 'body' AS page FROM supplier""")
def page_render(spark, sf):
    venue = F.when(F.col("s_nationkey") > 9, F.concat(F.lit("nation "), F.col("s_nationkey").cast("string")))
    return _t(spark, sf, "supplier").select("s_suppkey", writers.page(F.col("s_name"), F.lit("2024-01-01"), {"venue": venue, "short": F.lit("nan")}, F.lit("body")).alias("page"))


@query("""SELECT c_custkey, round(c_acctbal * 9 / 5 + 32, 4) AS f, round(c_acctbal * 3.280839895, 4) AS ft, round(c_acctbal / 1609.344, 6) AS mi, round(c_acctbal / 25.4, 4) AS inch,
least(greatest(c_acctbal, 0), 168) AS clamped, CASE WHEN c_acctbal < 5000 THEN c_acctbal END AS masked FROM customer""")
def unit_convert(spark, sf):
    v = F.col("c_acctbal")
    return _t(spark, sf, "customer").select("c_custkey", F.round(numeric.fahrenheit(v), 4).alias("f"), F.round(numeric.feet(v), 4).alias("ft"), F.round(numeric.miles(v), 6).alias("mi"), F.round(numeric.inches(v), 4).alias("inch"), numeric.clamp(v, 0.0, 168.0).alias("clamped"), numeric.below_sentinel(v, 5000.0).alias("masked"))


_SCORED = "FROM (SELECT least(n_chars / 5000.0, 1.0) AS score, quality AS label, source, lang FROM documents JOIN labels USING (doc_id))"


def _scored(spark, sf):
    docs = _t(spark, sf, "documents").select("doc_id", F.least(F.col("n_chars") / 5000, F.lit(1.0)).alias("score"), "source", "lang")
    return docs.join(_t(spark, sf, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id")


_RATES = "tp, fp, fn, tn, p AS precision, r AS recall, CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END AS f1 FROM (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS r"


@query(f"SELECT lang, {_RATES} FROM (SELECT lang, count(*) FILTER (score >= 0.3 AND label = 1) AS tp, count(*) FILTER (score >= 0.3 AND label <> 1) AS fp, count(*) FILTER (score < 0.3 AND label = 1) AS fn, count(*) FILTER (score < 0.3 AND label <> 1) AS tn {_SCORED} GROUP BY lang))")
def confusion_at(spark, sf):
    return evaluation.confusion(_scored(spark, sf), "score", "label", 0.3, ["lang"])


@query(f"SELECT threshold, {_RATES} FROM (SELECT threshold, count(*) FILTER (score >= threshold AND label = 1) AS tp, count(*) FILTER (score >= threshold AND label <> 1) AS fp, count(*) FILTER (score < threshold AND label = 1) AS fn, count(*) FILTER (score < threshold AND label <> 1) AS tn {_SCORED}, (SELECT CAST(0.05 + i * 0.01875 AS DOUBLE) AS threshold FROM range(49) t(i)) GROUP BY threshold))")
def threshold_sweep(spark, sf):
    return evaluation.sweep(_scored(spark, sf), "score", "label", 0.05, 0.95, 49)


@query(f"""WITH s AS (SELECT score AS s, sum(label) AS p, sum(1 - label) AS n {_SCORED} GROUP BY 1), c AS (SELECT *, sum(p) OVER (ORDER BY s DESC) AS cp, sum(n) OVER (ORDER BY s DESC) AS cn FROM s)
SELECT round(CAST(sum(n * (cp - p / 2)) AS DOUBLE) / CAST(sum(p) * sum(n) AS DOUBLE), 9) AS roc_auc, round(sum(CAST(p * cp AS DOUBLE) / CAST(cp + cn AS DOUBLE)) / CAST(sum(p) AS DOUBLE), 9) AS average_precision FROM c""")
def auc_rank(spark, sf):
    return evaluation.auc(_scored(spark, sf), "score", "label").select(F.round("roc_auc", 9).alias("roc_auc"), F.round("average_precision", 9).alias("average_precision"))


_RULES = "SELECT doc_id, CAST(n_chars >= 500 AS INT) AS a, CAST(lang = 'en' AS INT) AS b, CAST(length(source) = 4 AS INT) AS c, quality AS label FROM documents JOIN labels USING (doc_id)"


def _rules(spark, sf):
    docs = _t(spark, sf, "documents").select("doc_id", (F.col("n_chars") >= 500).cast("int").alias("a"), (F.col("lang") == "en").cast("int").alias("b"), (F.length("source") == 4).cast("int").alias("c"))
    return docs.join(_t(spark, sf, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id")


@query(f"SELECT doc_id, CAST(a + b + c >= 2 AS INT) AS vote, CASE WHEN a + b + c >= 2 AND label = 0 THEN 'FP' WHEN a + b + c < 2 AND label = 1 THEN 'FN' END AS tag FROM ({_RULES})")
def majority_vote(spark, sf):
    voted = _rules(spark, sf).withColumn("vote", evaluation.majority([F.col(m) for m in "abc"]))
    return voted.select("doc_id", "vote", evaluation.error_tag(F.col("vote"), F.col("label")).alias("tag"))


@query(f"SELECT CAST(a = label AS INT) + CAST(b = label AS INT) + CAST(c = label AS INT) AS \"right\", count(*) AS n FROM ({_RULES}) GROUP BY 1")
def agreement_buckets(spark, sf):
    return evaluation.agreement(_rules(spark, sf), ["a", "b", "c"], "label")


@query(" UNION ALL ".join(f"SELECT '{x}' AS model, '{y}' AS other, count(*) FILTER ({x} <> label AND {y} <> label) AS shared, {'100.0::DOUBLE' if x == y else f'CASE WHEN count(*) FILTER ({x} <> label) = 0 THEN 0 ELSE 100 * count(*) FILTER ({x} <> label AND {y} <> label) / count(*) FILTER ({x} <> label) END'} AS percent FROM ({_RULES})" for x in "abc" for y in "abc"))
def error_overlap(spark, sf):
    return evaluation.error_overlap(_rules(spark, sf), ["a", "b", "c"], "label")


@query("""SELECT c_custkey, round(2 * 6371008.8 * asin(least(1.0, sqrt(power(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * power(sin(radians(lon2 - lon1) / 2), 2)))), 3) AS meters
FROM (SELECT c_custkey, c_custkey % 90 AS lat1, c_custkey % 180 AS lon1, (c_custkey * 7) % 90 AS lat2, (c_custkey * 11) % 180 AS lon2 FROM customer)""")
def haversine_calc(spark, sf):
    k = F.col("c_custkey")
    return _t(spark, sf, "customer").select("c_custkey", F.round(geometry.haversine((k % 90).cast("double"), (k % 180).cast("double"), (k * 7 % 90).cast("double"), (k * 11 % 180).cast("double")), 3).alias("meters"))


@query("SELECT c_custkey, CAST(trunc(c_acctbal / 300) AS BIGINT) AS toward_zero, CAST(floor(c_acctbal / 300) AS BIGINT) AS down, strftime(make_date(2024, CAST(c_custkey % 12 + 1 AS INT), 1) + INTERVAL 5 MONTH, '%Y-%m') AS later FROM customer")
def cells_and_months(spark, sf):
    v, month = F.col("c_acctbal"), F.format_string("2024-%02d", F.col("c_custkey") % 12 + 1)
    return _t(spark, sf, "customer").select("c_custkey", geometry.cell_truncated(v, 300.0).alias("toward_zero"), geometry.cell_floor(v, 300.0).alias("down"), dates.add_months(month, 5).alias("later"))


@query("SELECT o_orderkey, CAST(floor(s / 60) + CASE WHEN round(s % 60) = 60 THEN 1 ELSE 0 END AS INT) || ':' || lpad(CAST(CAST(CASE WHEN round(s % 60) = 60 THEN 0 ELSE round(s % 60) END AS INT) AS VARCHAR), 2, '0') || '/mi' AS pace FROM (SELECT o_orderkey, o_totalprice / 300 AS s FROM orders)")
def pace_text(spark, sf):
    return _t(spark, sf, "orders").select("o_orderkey", text.pace(F.col("o_totalprice") / 300).alias("pace"))


@query("SELECT o_orderkey, date_trunc('day', t) + to_hours(CAST(floor(hour(t) / 6) * 6 AS INT)) AS run, date_trunc('day', t) + to_hours(CAST(floor(hour(t) / 6) * 6 - 6 AS INT)) AS fallback FROM (SELECT o_orderkey, o_orderdate + to_minutes(CAST(o_orderkey * 37 % 1440 AS INT)) AS t FROM orders)")
def run_times(spark, sf):
    t = F.col("o_orderdate") + F.make_dt_interval(mins=(F.col("o_orderkey") * 37 % 1440).cast("int"))
    rows = _t(spark, sf, "orders").select("o_orderkey", t.cast("timestamp_ntz").alias("t"))
    return rows.select("o_orderkey", dates.run_floor(F.col("t")).cast("timestamp_ntz").alias("run"), dates.run_floor(F.col("t"), back=1).cast("timestamp_ntz").alias("fallback"))


@query("SELECT label || CASE WHEN count(*) OVER (PARTITION BY label) > 1 THEN ' ' || chr(CAST(64 + row_number() OVER (PARTITION BY label ORDER BY n_nationkey) AS INT)) ELSE '' END AS name, n_nationkey FROM (SELECT n_nationkey, 'region ' || n_regionkey AS label FROM nation)")
def suffix_letters(spark, sf):
    named = _t(spark, sf, "nation").withColumn("label", F.concat(F.lit("region "), F.col("n_regionkey").cast("string")))
    return named.select(F.concat("label", sequences.suffix_letters("label", ["n_nationkey"])).alias("name"), "n_nationkey")


@query("SELECT n_nationkey, lag(n_name) OVER w AS previous, lead(n_name) OVER w AS next FROM nation WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_nationkey)")
def neighbour_links(spark, sf):
    previous, following = sequences.neighbours("n_name", ["n_regionkey"], ["n_nationkey"])
    return _t(spark, sf, "nation").select("n_nationkey", previous.alias("previous"), following.alias("next"))


@query("SELECT p_partkey, p_name, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20 OFFSET 40")
def pagination(spark, sf):
    return aggregates.page(_t(spark, sf, "part").select("p_partkey", "p_name", "p_retailprice"), [F.desc("p_retailprice"), "p_partkey"], 3, 20)


def _tracks(spark, sf):
    k, i = F.col("c_custkey"), F.sequence(F.lit(0), F.lit(30))
    point = lambda j: F.struct((44.0 + (k % 50) / 100 + j / 1000 + F.sin(j * k) / 5000).alias("lat"), (-71.0 - j / 1000 + F.cos(j + k) / 3000).alias("lon"))
    keys = _t(spark, sf, "customer").select("c_custkey").repartition(4 * spark.sparkContext.defaultParallelism, "c_custkey")  # keys are a small file, and thus one task
    return keys.select("c_custkey", F.transform(i, point).alias("track"))


@query()
def polyline_roundtrip(spark, sf):
    """Tracks to text and back. Bit-wise coding, tested against a plain version."""
    coded = _tracks(spark, sf).select("c_custkey", geometry.polyline_encode("track").alias("polyline"))
    return coded.select("c_custkey", "polyline", F.size(geometry.polyline_decode("polyline")).alias("points"))


@query()
def simplify_track(spark, sf):
    """Points that stay at 40 m. A recursion, tested against a plain version."""
    return _tracks(spark, sf).select("c_custkey", F.size(geometry.simplifier(40.0)("track")).alias("kept"), F.size(geometry.densified(F.col("track"), 50.0)).alias("dense"))


@query()
def resampled_tracks(spark, sf):
    """Sixteen points at equal arc lengths of each track, and the area they enclose."""
    pts = _tracks(spark, sf).select("c_custkey", F.posexplode("track").alias("seq", "p")).select("c_custkey", "seq", F.col("p.lon").alias("x"), F.col("p.lat").alias("y"))
    even = sequences.resampled(pts, "c_custkey", "seq", "x", "y", 16)
    ring = F.transform(F.array_sort(F.collect_list(F.struct("i", "x", "y"))), lambda p: F.struct(p["x"], p["y"]))
    rings = even.groupBy("c_custkey").agg(ring.alias("ring"))
    return rings.select("c_custkey", F.size("ring").alias("points"), F.round(geometry.signed_area(F.col("ring")), 12).alias("area"))


@query()
def grouped_oof(spark, sf):
    """Out-of-fold scores of a forest whose folds never split a source. Training, so no SQL."""
    docs = _t(spark, sf, "documents").select("doc_id", "source", F.col("n_chars").cast("double").alias("n_chars"), (F.length(F.regexp_replace("text", "[A-Za-z ]", "")) / F.greatest(F.length("text"), F.lit(1))).alias("odd"))
    rows = docs.join(_t(spark, sf, "labels").select("doc_id", F.col("quality").cast("double").alias("quality")), "doc_id")
    return evaluation.out_of_fold(rows, ["n_chars", "odd"], "quality", "source", trees=8).select("doc_id", "fold", "score")


from millrace.plans import coverage, documents, lookups, models, places, upkeep  # noqa: E402, F401 - register their queries
