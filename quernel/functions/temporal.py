"""Time: decay, cut-offs and date ranges in queries. Every function takes its "today" as an argument."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F


def decayed(weight: Column, days: Column, half_life: float, floor: float) -> Column:
    """Halves every ``half_life`` days; never under ``floor``."""
    return F.greatest(weight * F.pow(F.lit(0.5), days / F.lit(float(half_life))), F.lit(float(floor)))


def stale_cutoff(as_of: Column, days: int) -> Column:
    return F.date_sub(as_of, days)


#: What a query may say, in order of precedence. Years back from today, or the group
#: that holds the year; the group that holds the month, if there is one.
PHRASES = (
    (r"năm\s+nay", 0, None, None),
    (r"năm\s+(?:ngoái|trước)", 1, None, None),
    (r"tháng\s+(\d{1,2})\s*(?:/|năm)\s*(\d{4})", None, 2, 1),
    (r"(?:năm|year)\s+(\d{4})", None, 1, None),
    (r"\b((?:19|20)\d{2})\b", None, 1, None),
)
FIRST_YEAR, LAST_YEAR = 1900, 2100


def temporal_range(query: Column, as_of: Column) -> Column:
    """``struct(start, stop)``: the days that a query speaks of; nulls if it names none.

    The first phrase that occurs and gives a year in bounds (and a month, if it has one) decides.
    """
    q, days = F.lower(query), F.struct(F.lit(None).cast("date").alias("start"), F.lit(None).cast("date").alias("stop"))
    for pattern, back, year_at, month_at in reversed(PHRASES):
        group = lambda at, p=pattern: F.regexp_extract(q, p, at).try_cast("int")
        year = F.year(as_of) - back if year_at is None else group(year_at)
        month = F.lit(None).cast("int") if month_at is None else group(month_at)
        fits = q.rlike(pattern) & year.between(FIRST_YEAR, LAST_YEAR) & (F.lit(month_at is None) | month.between(1, 12))
        start = F.make_date(year, F.coalesce(month, F.lit(1)), F.lit(1))
        stop = F.last_day(F.make_date(year, F.coalesce(month, F.lit(12)), F.lit(1)))
        days = F.when(fits, F.struct(start.alias("start"), stop.alias("stop"))).otherwise(days)
    return days


def in_range(day: Column, start: date | Column | None, end: date | Column | None, keep_unknown: bool = False) -> Column:
    """Inclusive range, open where an end is None."""
    inside = F.lit(True)
    if start is not None:
        inside = inside & (day >= F.lit(start))
    if end is not None:
        inside = inside & (day <= F.lit(end))
    return (day.isNull() | inside) if keep_unknown else inside
