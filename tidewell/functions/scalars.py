"""Column functions: text ladders, similarity, dates, and small mathematics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ordered: the first pattern that a title matches gives its type.
EVENT_LADDER = (("error", "(?i)error|fail"), ("trade", "(?i)purchase|buy"), ("navigation", "(?i)view|click"))


def event_type(title: Column) -> Column:
    out = None
    for name, pattern in EVENT_LADDER:
        out = F.when(title.rlike(pattern), name) if out is None else out.when(title.rlike(pattern), name)
    return out.otherwise("other")


def normalize_name(x: Column) -> Column:
    return F.lower(F.regexp_replace(x, r"[^0-9A-Za-z]+", ""))


def number(x: str) -> Column:
    """A number with commas; null if it isn't one."""
    return F.expr(f"try_cast(regexp_replace({x}, ',', '') AS DOUBLE)")


def add_years(t: Column, n: int) -> Column:
    return F.add_months(t, 12 * n)


def latest_weekday(t: Column) -> Column:
    return F.when(F.dayofweek(t) == 1, F.date_sub(t, 2)).when(F.dayofweek(t) == 7, F.date_sub(t, 1)).otherwise(t)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def normal_cdf(x: Column) -> Column:
    """Abramowitz and Stegun 7.1.26."""
    z = F.abs(x) / 2**0.5
    t = 1 / (1 + 0.3275911 * z)
    y = 1 - (((((1.061405429 * t - 1.453152027) * t) + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * F.exp(-z * z)
    return F.when(x < 0, (1 - y) / 2).otherwise((1 + y) / 2)


def freshness_scale(age: Column, grace: int, days: int, floor: float) -> Column:
    return F.when(age <= grace, 1.0).otherwise(F.greatest(F.lit(floor), 1 - (age - grace) / days))


def business_days_between(a: Column, b: Column) -> Column:
    """Weekdays strictly between two dates: full weeks, and what is left of one."""
    first = F.date_add(a, 1)
    n = F.greatest(F.datediff(b, first), F.lit(0))
    rest, day = n % 7, F.weekday(first)
    # Of the rest, which begins on that weekday (Monday is 0), the days that fall on a weekend don't count.
    off = F.greatest(F.least(day + rest, F.lit(7)) - F.greatest(day, F.lit(5)), F.lit(0)) + F.greatest(day + rest - 12, F.lit(0))
    return (F.floor(n / 7) * 5 + rest - off).cast("int")


#: Report codes with the date on which they are available, and in which year.
FILINGS = (("Q1", "05-15", 0), ("H1", "08-14", 0), ("Q3", "11-14", 0), ("FY", "03-31", 1))


def filing_calendar(years, as_of: str):
    """(year, code, available): the reports of the years that are available by a date."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("code"), F.lit(d).alias("d"), F.lit(y).alias("y")) for c, d, y in FILINGS]))
    rows = years.withColumn("e", each)
    available = F.to_date(F.concat_ws("-", (F.col("year") + F.col("e.y")).cast("string"), F.col("e.d")))
    return rows.select("year", "e.code", available.alias("available")).filter(F.col("available") <= F.lit(as_of).cast("date"))
