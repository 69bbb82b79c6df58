"""Queries of lookups by place and name, orders with places, profiles and records, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import cv
from millrace.operators import lookups, ordering, series
from millrace.plans.registry import query
from millrace.plans.registry import table as _t
from millrace.sources import writers


@query("SELECT l_orderkey, l_linenumber, l_partkey, string_split(p_name, ' ')[l_linenumber] AS word FROM lineitem LEFT JOIN part ON l_partkey = p_partkey")
def item_by_place(spark, sf):
    """Each line with the word of its part's name that its number points to."""
    names = _t(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.split("p_name", " ").alias("words"))
    lines = _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return lookups.item_at(lines, names, "l_partkey", "words", F.col("l_linenumber") - 1, "word")


_BY_SEGMENT = "SELECT c_mktsegment AS name, count(*) AS customers, count(DISTINCT c_nationkey) AS nations FROM customer GROUP BY 1"


@query(f"WITH s AS ({_BY_SEGMENT}) SELECT * FROM s UNION ALL SELECT 'all', CAST(sum(customers) AS BIGINT), CAST(sum(nations) AS BIGINT) FROM s")
def rows_and_totals(spark, sf):
    per = _t(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("name")).agg(F.count("*").alias("customers"), F.count_distinct("c_nationkey").alias("nations"))
    return lookups.with_totals(per, "name", ["customers", "nations"])


@query("SELECT *, row_number() OVER (ORDER BY size DESC, seed) AS place FROM (SELECT o_custkey, count(*) AS size, min(o_orderkey) AS seed FROM orders GROUP BY 1)")
def cluster_order(spark, sf):
    groups = _t(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("size"), F.min("o_orderkey").alias("seed"))
    return ordering.by_size(groups, "size", "seed")


@query("SELECT *, row_number() OVER (ORDER BY pct DESC, amount DESC, l_partkey) AS place FROM (SELECT l_partkey, round(100 * sum(l_quantity) FILTER (l_returnflag = 'R') / sum(l_quantity), 1) AS pct, sum(l_quantity) AS amount FROM lineitem GROUP BY 1) WHERE pct IS NOT NULL")
def coverage_order(spark, sf):
    back = F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")))
    per = _t(spark, sf, "lineitem").groupBy("l_partkey").agg(F.round(100 * back / F.sum("l_quantity"), 1).alias("pct"), F.sum("l_quantity").alias("amount"))
    return ordering.by_coverage(per.where("pct is not null"), "pct", "amount", "l_partkey")


@query("SELECT p_partkey, array_to_string(list_transform(list_sort([{'k': p_brand, 'v': CAST(p_size AS VARCHAR)}, {'k': p_type, 'v': p_name}, {'k': p_name, 'v': p_brand}]), lambda x: x.k || '=' || x.v), ';') AS entries FROM part")
def entries_by_key(spark, sf):
    held = F.create_map("p_brand", F.col("p_size").cast("string"), "p_type", "p_name", "p_name", "p_brand")
    shown = F.concat_ws(";", F.transform(ordering.by_key(held), lambda x: F.concat(x["key"], F.lit("="), x["value"])))
    return _t(spark, sf, "part").select("p_partkey", shown.alias("entries"))


@query("""SELECT c_custkey, CASE c_nationkey % 3 WHEN 0 THEN 'Currently employed at ' || c_mktsegment WHEN 1 THEN c_name ELSE 'Currently employed at ' || c_mktsegment || '. ' || c_name END AS summary,
array_to_string(list_filter([CASE WHEN c_custkey % 2 = 0 THEN 'ORCID||https://orcid.org/' || c_custkey END, CASE WHEN c_acctbal > 0 THEN 'GitHub|' || c_name || '|https://github.com/' || c_name END, CASE WHEN c_custkey % 5 = 0 THEN 'Twitter|' || c_mktsegment || '|https://twitter.com/' || c_mktsegment END], lambda x: x IS NOT NULL), ' ') AS profiles FROM customer""")
def author_profiles(spark, sf):
    third = F.col("c_nationkey") % 3
    links = {
        "ORCID": (F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("https://orcid.org/"), F.col("c_custkey").cast("string"))), "", False),
        "GitHub": (F.when(F.col("c_acctbal") > 0, F.col("c_name")).otherwise(""), "https://github.com/", True),
        "Twitter": (F.when(F.col("c_custkey") % 5 == 0, F.col("c_mktsegment")), "https://twitter.com/", True),
    }
    shown = F.concat_ws(" ", F.transform(cv.profiles(links), lambda p: F.concat(p["network"], F.lit("|"), p["username"], F.lit("|"), p["url"])))
    summary = cv.summary(F.when(third != 1, F.col("c_mktsegment")), F.when(third != 0, F.col("c_name")))
    return _t(spark, sf, "customer").select("c_custkey", summary.alias("summary"), shown.alias("profiles"))


@query("SELECT event_type, CAST(ts AS DATE) AS day, max(value) * 2 + 1 AS value FROM events GROUP BY 1, 2")
def mapped_series(spark, sf):
    daily = _t(spark, sf, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.max("value").alias("value"))
    arrays = series.mapped(series.to_arrays(daily, ["event_type"], "day", "value"), lambda v: v * 2 + 1)
    return series.to_rows(arrays, ["event_type"]).select("event_type", F.col("x").alias("day"), F.col("y").alias("value"))


@query("SELECT p_partkey, '@' || lower(p_type) || '{part' || p_partkey || ',' || chr(10) || '  title = {' || p_name || '}' || CASE WHEN p_size > 20 THEN ',' || chr(10) || '  year = {' || (1970 + p_size) || '}' ELSE '' END || chr(10) || '}' AS record FROM part")
def bibtex_records(spark, sf):
    year = F.when(F.col("p_size") > 20, (1970 + F.col("p_size")).cast("string"))
    record = writers.bibtex_record(F.lower("p_type"), F.concat(F.lit("part"), F.col("p_partkey").cast("string")), {"title": F.col("p_name"), "year": year})
    return _t(spark, sf, "part").select("p_partkey", record.alias("record"))
