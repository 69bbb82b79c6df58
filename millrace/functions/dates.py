"""Date functions. Nothing here reads the clock: what depends on today takes `as_of`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def month_key(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM")


def month_label(d: Column) -> Column:
    return F.date_format(d, "MMM yyyy")


def add_months(key: Column, n: Column | int) -> Column:
    """yyyy-MM plus n months."""
    return month_key(F.add_months(F.to_date(key, "yyyy-MM"), n))


def month_spine(df: DataFrame, d: str, name: str = "month") -> DataFrame:
    """Every month from the first to the last of column d, as dates."""
    ends = df.agg(F.min(d).alias("a"), F.max(d).alias("b")).where("a is not null")
    return ends.select(F.explode(F.sequence(F.trunc(F.col("a").cast("date"), "month"), F.trunc(F.col("b").cast("date"), "month"), F.expr("interval 1 month"))).alias(name))


def day_spine(df: DataFrame, d: str, name: str = "day") -> DataFrame:
    ends = df.agg(F.min(d).alias("a"), F.max(d).alias("b")).where("a is not null")
    return ends.select(F.explode(F.sequence(F.col("a").cast("date"), F.col("b").cast("date"))).alias(name))


def preset(first: Column, last: Column, kind: str, as_of: Column | None = None) -> tuple[Column, Column]:
    """(from, to) month keys of 'all', 'ytd' or a number of months ending at as_of (or the last month), never before the first."""
    end = month_key(last if as_of is None else as_of)
    if kind == "all":
        return month_key(first), month_key(last)
    start = F.concat(F.substring(end, 1, 4), F.lit("-01")) if kind == "ytd" else add_months(end, 1 - int(kind))
    return F.greatest(month_key(first), start), end


def in_season(d: Column, start: str = "12-21", end: str = "03-20") -> Column:
    """Whether the day lies in a season given as MM-dd ends; a season may run over the new year."""
    md = F.date_format(d, "MM-dd")
    return (md >= start) | (md <= end) if start > end else md.between(start, end)


def short_date(s: Column) -> Column:
    """M/d/yy text as a date, 69 to 99 as of the last century; null where it isn't one."""
    d = F.to_date(F.try_to_timestamp(s, F.lit("M/d/yy")))
    return F.when(F.year(d) >= 2069, F.add_months(d, -1200)).otherwise(d)


def run_floor(t: Column, hours: int = 6, back: int = 0) -> Column:
    """The last run at or before t, or `back` runs earlier, over midnight too."""
    return F.date_trunc("day", t) + F.make_dt_interval(hours=F.floor(F.hour(t) / hours) * hours - back * hours)


def valid_time(run: Column, offset_hours: Column, zone: str = "America/New_York") -> Column:
    """Local time of a run (UTC) plus hours."""
    return F.from_utc_timestamp(run + F.make_dt_interval(hours=offset_hours), zone)


def cursor(last: Column, overlap_days: int = 2) -> Column:
    """Epoch seconds from which to fetch again: the last day less an overlap."""
    return F.unix_timestamp(F.date_sub(F.to_date(last), overlap_days).cast("timestamp"))


def bib_month(m: Column) -> Column:
    """A month as two digits from a number or an English name; 01 for neither."""
    named = F.date_format(F.try_to_timestamp(F.concat(F.initcap(F.substring(m, 1, 3)), F.lit(" 2000")), F.lit("MMM yyyy")), "MM")
    return F.coalesce(F.when(m.rlike(r"^\d{1,2}$"), F.lpad(m, 2, "0")), named, F.lit("01"))
