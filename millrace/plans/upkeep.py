"""Queries of incremental upkeep, each beside the SQL of what is kept in the end."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from millrace.operators.durable import shared_dir
from millrace.plans.registry import query
from millrace.plans.registry import table as _t
from millrace.streaming import incremental


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS ts FROM events GROUP BY 1")
def cursor_pull(spark, sf):
    """Each user's last event, kept by three pulls: half of the time, all of it from the cursor on, and once more with nothing new."""
    events = _t(spark, sf, "events").select("user_id", "event_id", "ts")
    ends = [F.unix_micros(f("ts").cast("timestamp")) for f in (F.min, F.max)]
    half = events.agg(F.timestamp_micros(((ends[0] + ends[1]) / 2).cast("long")).cast("string")).first()[0]
    table = f"{shared_dir(spark)}/kept-{uuid.uuid4().hex}"
    for upto in (half, None, None):

        def source(since, upto=upto):
            rows = events if upto is None else events.where(F.col("ts") < F.lit(upto).cast("timestamp"))
            return rows if since is None else rows.where(F.col("ts") >= F.lit(since).cast("timestamp"))

        incremental.pull(spark, table, source, ["user_id"], ["ts", "event_id"], "ts", buckets=16)
    return incremental.kept(spark, table, events.schema)


@query("SELECT c_custkey, count(o_orderkey) FILTER (o_orderkey IS NOT NULL) AS orders, max(o_orderdate) AS latest FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def resumed_cache(spark, sf):
    """Customers' orders, worked out part by part: a first run is stopped after three parts, a second takes up there."""
    orders = _t(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderdate")

    def work(mine):
        return orders.join(mine, "c_custkey").groupBy("c_custkey").agg(F.count("*").alias("orders"), F.max("o_orderdate").alias("latest"))

    cache = f"{shared_dir(spark)}/cache-{uuid.uuid4().hex}"
    kind = dict(orders.dtypes)["o_orderdate"]
    items, schema = _t(spark, sf, "customer").select("c_custkey"), f"c_custkey long, orders long, latest {kind}"
    incremental.resumed(items, cache, work, "c_custkey", schema, parts=6, stop_after=3)
    return incremental.resumed(items, cache, work, "c_custkey", schema, parts=6).fillna(0, subset=["orders"])
