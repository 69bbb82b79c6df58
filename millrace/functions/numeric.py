"""Number functions: units, cleaning and rounding. Null goes through as null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METERS_PER_MILE = 1609.344
FEET_PER_METER = 3.280839895


def finite(c: Column) -> Column:
    """NaN and both infinities as null."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def clamp(c: Column, low: float, high: float) -> Column:
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def below_sentinel(c: Column, sentinel: float = 88_000.0) -> Column:
    """Null from the sentinel on, which says that there is no value."""
    return F.when(c < sentinel, c)


def fahrenheit(celsius: Column) -> Column:
    return celsius * 9 / 5 + 32


def feet(meters: Column) -> Column:
    return meters * FEET_PER_METER


def miles(meters: Column) -> Column:
    return meters / METERS_PER_MILE


def inches(mm: Column) -> Column:
    return mm / 25.4


def hourly(per_second: Column) -> Column:
    return per_second * 3600


def significant(c: Column, figures: int = 2) -> Column:
    """Rounded to a number of significant figures; zero and null stay."""
    factor = F.pow(F.lit(10.0), F.lit(figures) - F.ceil(F.log10(F.abs(c))))
    return F.when(c == 0, c).otherwise(F.floor(c * factor + 0.5) / factor)


def elevation_feet(raw: Column) -> Column:
    """Metres at the start of a text as whole feet; null for anything else."""
    return F.round(F.get(F.split(F.trim(raw), r"\s+"), F.lit(0)).try_cast("double") * FEET_PER_METER).cast("long")


def logistic(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))


def ratio(a: Column, b: Column, otherwise: float | None = None) -> Column:
    """a / b where b isn't zero."""
    out = F.when(b != 0, a / b)
    return out if otherwise is None else F.coalesce(out, F.lit(otherwise))


def touched(meters: Column, share: Column) -> Column:
    """Whether enough of a length was covered: 160 m, or over 70 m and nine tenths of it."""
    return (meters >= 160) | ((meters > 70) & (share >= 0.9))
