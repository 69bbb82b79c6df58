"""Aggregations over participation, activity and forecast rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.operators.durable import durable, salted_join
from millrace.operators.ordering import placed_within


def count_if(test: Column) -> Column:
    return F.count(F.when(test, 1))


def leaderboard(rows: DataFrame, person: list[str], done: Column, race: Column, hours: Column, lead: Column) -> DataFrame:
    """Per person: registrations (all rows), as_lead, and of the done ones sails, races, pleasure, full_day (over 6 h), multi_day (over 24 h), hours (2 dp)."""
    return rows.groupBy(*person).agg(
        F.count("*").alias("registrations"),
        count_if(lead).alias("as_lead"),
        count_if(done).alias("sails"),
        count_if(done & race).alias("races"),
        count_if(done & ~race).alias("pleasure"),
        count_if(done & (hours > 6)).alias("full_day"),
        count_if(done & (hours > 24)).alias("multi_day"),
        F.round(F.coalesce(F.sum(F.when(done, hours.cast("decimal(18,2)"))), F.lit(0)), 2).cast("double").alias("hours"),
    )


def totals(board: DataFrame, metrics: list[str]) -> DataFrame:
    """Sum of each metric over a leaderboard, and how many rows it has."""
    return board.agg(F.count("*").alias("people"), *[F.sum(m).alias(m) for m in metrics])


def status_precedence(status: Column) -> tuple[Column, Column]:
    """Aggregates of many statuses into (role, status): skipper makes role s and confirms; else confirmed, pending, cancelled, unknown."""
    has = lambda word: F.coalesce(F.max(F.lower(status).contains(word)), F.lit(False))
    role = F.when(has("skipper"), "s").otherwise("c")
    return role, F.when(has("skipper") | has("confirmed"), "c").when(has("pending"), "p").when(has("cancel"), "x").otherwise("u")


def first_rows(rows: DataFrame, key: list[str], order: list, attributes: list[str]) -> DataFrame:
    """One row per key: attributes of its first row in order. Map-side combinable and of fixed size per key; no window."""
    seq = F.struct(*order)
    return rows.groupBy(*key).agg(*[F.min_by(F.struct(a), seq).getField(a).alias(a) for a in attributes])


def on_spine(counts: DataFrame, spine: DataFrame, on: str | list[str], zero: list[str]) -> DataFrame:
    """Every row of the spine, with zeros where counts has none. Spines are calendars, small by nature."""
    return spine.join(counts, on, "left").fillna(0, subset=zero)


def year_month_matrix(rows: DataFrame, d: str, value: Column, name: str = "total") -> DataFrame:
    """A row per year with twelve columns m01..m12 and a row total: null outside the months of the data, zero for empty ones inside."""
    ends = rows.agg(F.min(F.trunc(d, "month")).alias("a"), F.max(F.trunc(d, "month")).alias("b"))
    per = rows.groupBy(F.year(d).alias("year"), F.month(d).alias("month")).agg(value.alias("v"))
    years = ends.where("a is not null").select("a", "b", F.explode(F.sequence(F.year("a"), F.year("b"))).alias("year"))
    cells = [F.max(F.when(F.col("month") == m, F.col("v"))).alias(f"v{m}") for m in range(1, 13)]
    wide = years.join(per.groupBy("year").agg(*cells), "year", "left")
    shown = [F.when(F.make_date("year", F.lit(m), F.lit(1)).between(F.col("a"), F.col("b")), F.coalesce(f"v{m}", F.lit(0))).alias(f"m{m:02d}") for m in range(1, 13)]
    total = sum((F.coalesce(F.col(f"v{m}"), F.lit(0)) for m in range(2, 13)), F.coalesce(F.col("v1"), F.lit(0)))
    return wide.select("year", *shown, total.alias(name))


def capped_histogram(rows: DataFrame, n: Column, cap: int = 4) -> DataFrame:
    return rows.groupBy(F.least(n, F.lit(cap)).alias("bucket")).agg(F.count("*").alias("n"))


def fractional_allocation(rows: DataFrame, value: Column, targets: str, name: str = "target") -> DataFrame:
    """Each value in equal parts to the elements of its array; rows without any go to null."""
    return rows.withColumn("__share", value / F.greatest(F.size(targets), F.lit(1))).withColumn(name, F.explode_outer(targets)).groupBy(name).agg(F.sum("__share").alias("allocated"), F.count("*").alias("n"))


def group_by_element(rows: DataFrame, listed: Column, member: str, name: str = "element") -> DataFrame:
    """(element, member, nth, n): for each element of an array column, its members in order, a row each, and how many there are. An element that most rows have is numbered in several tasks."""
    pairs = rows.select(F.col(member).alias("member"), F.explode(F.array_distinct(listed)).alias(name)).where(F.col(name) != "").distinct()
    return placed_within(pairs, name, "member")


def top_k(rows: DataFrame, metric: str, key: str, k: int = 15) -> DataFrame:
    """The k largest by metric, ties by key, with their rank. A limit by nature: Spark keeps k rows per task."""
    best = rows.orderBy(F.desc(metric), key).limit(k)
    return best.withColumn("rank", F.row_number().over(W.orderBy(F.desc(metric), key)))


def page(rows: DataFrame, order: list, number: int, size: int) -> DataFrame:
    """One page of an ordered table."""
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def page_links(pages: int, current: int, reach: int = 2) -> list[int]:
    return list(range(max(1, current - reach), min(pages, current + reach) + 1))


def group_medians(rows: DataFrame, keys: list[str], c: str, few: int = 10_000, cuts: int = 64, small: int = 100_000) -> DataFrame:
    """(keys, median): the exact median of each group (mean of the middle two), nulls and NaN left out; groups without values have no row.

    Quantile sketches of what is left of a group give values to cut it at; rows are then counted below,
    at and between these, and only where the middle lies is looked at again. Groups with a null key have no row. Cuts follow the order of values, not
    their distance, so infinities and heaps of equal values do no harm. A group is gathered only once
    `few` of its rows are left; tables of up to `small` groups are broadcast, others joined with hot groups split.
    """
    values = rows.select(*keys, F.col(c).cast("double").alias("v")).where("v is not null and not isnan(v)")
    none = F.lit(None).cast("double")
    sizes = values.groupBy(*keys).agg(F.count("*").alias("inside")).where("inside > 0")
    middle = F.array_distinct(F.array(F.floor((F.col("inside") - 1) / 2), F.floor(F.col("inside") / 2)))
    todo = durable(sizes.select(*keys, F.explode(middle).alias("at"), none.alias("lo"), none.alias("hi"), F.lit(0).cast("long").alias("before"), "inside"))

    def within(targets: DataFrame) -> DataFrame:
        if not keys or targets.count() <= small:
            met = values.join(F.broadcast(targets), keys) if keys else values.crossJoin(F.broadcast(targets))  # two rows at most
        else:
            met = salted_join(values, targets, keys)
        return met.where("(lo is null or v > lo) and (hi is null or v < hi)")

    found = None
    while True:
        last = within(todo.where(F.col("inside") <= few)).groupBy(*keys, "at").agg(F.array_sort(F.collect_list("v")).alias("vs"), F.first("before").alias("before"))
        part = last.select(*keys, F.element_at("vs", (F.col("at") - F.col("before") + 1).cast("int")).alias("v"))
        found = part if found is None else found.unionByName(part)
        wide = todo.where(F.col("inside") > few)
        if wide.isEmpty():
            break
        marks = [i / cuts for i in range(1, cuts)]
        pivots = within(wide).groupBy(*keys, "at").agg(F.array_distinct(F.percentile_approx("v", marks, 20 * cuts)).alias("p"))
        cut = durable(wide.join(pivots, [*keys, "at"]))
        cell = 2 * F.size(F.filter("p", lambda x: x < F.col("v"))) + F.array_contains("p", F.col("v")).cast("int")
        per = within(cut).groupBy(*keys, "at", cell.alias("cell")).agg(F.count("*").alias("k"))
        upto = F.sum("k").over(W.partitionBy(*keys, "at").orderBy("cell").rowsBetween(W.unboundedPreceding, 0))  # 2 * cuts rows at most
        placed = per.withColumn("upto", upto).join(cut, [*keys, "at"]).withColumn("below", F.col("before") + F.col("upto") - F.col("k"))
        hit = durable(placed.where("below <= at and at < below + k"))
        found = found.unionByName(hit.where("cell % 2 = 1").select(*keys, F.get("p", F.expr("cell div 2").cast("int")).alias("v")))
        edge = lambda i, old: F.coalesce(F.get("p", i.cast("int")), F.col(old))
        todo = durable(hit.where("cell % 2 = 0").select(*keys, "at", F.when(F.col("cell") > 0, edge(F.expr("cell div 2 - 1"), "lo")).otherwise(F.col("lo")).alias("lo"), edge(F.expr("cell div 2"), "hi").alias("hi"), F.col("below").alias("before"), F.col("k").alias("inside")))
    return found.groupBy(*keys).agg(F.avg("v").alias("median"))


def exact_median(rows: DataFrame, c: str, few: int = 10_000, cuts: int = 64) -> float | None:
    """group_medians of a whole column; null for none."""
    return group_medians(rows, [], c, few, cuts).first().median


def tiles(rows: DataFrame, value: str, key: str, flag: Column) -> DataFrame:
    """One row of summary figures: n, total, median, the key of the largest value (ties to the least key), share of rows with the flag."""
    got = rows.agg(F.count("*").alias("n"), F.sum(F.col(value).cast("decimal(18,2)")).cast("double").alias("total"), F.max_by(key, F.struct(F.col(value), -F.col(key))).alias("best"), F.round(F.avg(flag.cast("int")), 6).alias("share"))
    return got.withColumn("median", F.lit(exact_median(rows, value)).cast("double"))


def shares(rows: DataFrame, c: str) -> DataFrame:
    """Value counts with each value's share of all rows."""
    counts = rows.groupBy(c).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("__all"))
    return counts.join(F.broadcast(total)).select(c, "n", (F.col("n") / F.col("__all")).alias("share"))  # one row sent
