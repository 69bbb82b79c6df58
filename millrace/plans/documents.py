"""Queries of fallback scans, indexes and CV entries, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import cv
from millrace.plans.registry import query
from millrace.plans.registry import table as _t
from millrace.sources import listing

_DAY = "'w_' || strftime(o_orderdate, '%Y-%m-') || {} || '.json'"
_PADDED, _BARE = _DAY.format("strftime(o_orderdate, '%d')"), _DAY.format("CAST(day(o_orderdate) AS VARCHAR)")


def _named(padded):
    day = F.when(padded, F.date_format("o_orderdate", "dd")).otherwise(F.dayofmonth("o_orderdate").cast("string"))
    return F.concat(F.lit("w_"), F.date_format("o_orderdate", "yyyy-MM-"), day, F.lit(".json"))


@query(f"""WITH found AS (SELECT name, min(o_totalprice) AS price FROM (
  SELECT CASE WHEN o_orderpriority < '2' THEN {_PADDED} ELSE {_BARE} END AS name, o_totalprice FROM orders WHERE o_orderpriority < '3' AND o_custkey % 5 = 0) GROUP BY 1),
items AS (SELECT o_orderkey, {_PADDED} AS padded, {_BARE} AS bare, CASE WHEN o_orderkey % 2 = 0 THEN {_BARE} ELSE {_PADDED} END AS wanted FROM orders)
SELECT o_orderkey, wanted, CASE WHEN w.name IS NOT NULL THEN w.name WHEN p.name IS NOT NULL THEN p.name ELSE b.name END AS used, CASE WHEN w.name IS NOT NULL THEN w.price WHEN p.name IS NOT NULL THEN p.price ELSE b.price END AS price
FROM items LEFT JOIN found w ON w.name = wanted LEFT JOIN found p ON p.name = padded LEFT JOIN found b ON b.name = bare""")
def fallback_scan(spark, sf):
    """For each order the first of its day's file names, as it is, padded or not, that some order has written."""
    orders = _t(spark, sf, "orders")
    found = orders.where("o_orderpriority < '3' AND o_custkey % 5 = 0").select(_named(F.col("o_orderpriority") < "2").alias("name"), F.col("o_totalprice").alias("price"))
    items = orders.select("o_orderkey", _named(F.col("o_orderkey") % 2 != 0).alias("wanted"))
    return listing.resolved(items.withColumn("variants", listing.day_variants(F.col("wanted"))), found, "o_orderkey", "variants").drop("place")


@query("SELECT strftime(o_orderdate, '%Y-%m-%d') AS date, 'o' || o_orderkey || '_' || CAST(year(o_orderdate) AS VARCHAR) || '-' || CAST(month(o_orderdate) AS VARCHAR) || '-' || CAST(day(o_orderdate) AS VARCHAR) || '.JSON' AS filename, 'Orders — ' || strftime(o_orderdate, '%Y-%m-%d') AS label, '/days/' || strftime(o_orderdate, '%Y-%m-%d') || '/o' || o_orderkey || '_' || CAST(year(o_orderdate) AS VARCHAR) || '-' || CAST(month(o_orderdate) AS VARCHAR) || '-' || CAST(day(o_orderdate) AS VARCHAR) || '.JSON' AS path FROM orders WHERE o_orderkey % 3 > 0")
def dated_index(spark, sf):
    """Index entries of files named by unpadded dates; other kinds of files have none."""
    names = F.concat(F.lit("o"), F.col("o_orderkey").cast("string"), F.lit("_"), F.date_format("o_orderdate", "y-M-d"), F.when(F.col("o_orderkey") % 3 > 0, ".JSON").otherwise(".jpg"))
    return listing.index(_t(spark, sf, "orders").select(names.alias("name")), "days", "Orders")


@query("SELECT c_custkey, 'BSc ' || c_name AS area, c_mktsegment AS institution, CAST(1990 + c_custkey % 30 AS VARCHAR) AS end, CASE WHEN c_custkey % 4 > 0 THEN CAST(c_custkey % 4 AS VARCHAR) || '.5' END AS grade, CASE WHEN c_custkey % 3 > 0 THEN ['sold ' || c_nationkey, 'built it'] ELSE [] END AS highlights, ['a' || c_custkey, 'b'] AS keywords FROM customer")
def cv_entries(spark, sf):
    """Entries of CVs written from customers: the degree, what a position's lines say, and the skills."""
    key, text = F.col("c_custkey"), lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    school = text("* no degree\n* BSc ", F.col("c_name"), ", ", F.col("c_mktsegment"), ", ", 1990 + key % 30, F.when(key % 4 > 0, text(" (GPA: ", key % 4, ".5)")).otherwise(F.lit("")), "\n* x")
    jobs = text("* Clerk, Shop, 1990 - present", F.when(key % 3 > 0, text("\n  - sold ", F.col("c_nationkey"), "\n  other\n  *  built it")).otherwise(F.lit("")))
    rows = _t(spark, sf, "customer").select("c_custkey", cv.education(school).alias("e"), cv.work(jobs).alias("w"), cv.skills(text("Tools: a", key, ", b")).alias("s"))
    return rows.select("c_custkey", F.inline("e"), "w", "s").select("c_custkey", "area", "institution", "end", "grade", F.element_at("w", 1)["highlights"].alias("highlights"), F.element_at("s", 1)["keywords"].alias("keywords"))
