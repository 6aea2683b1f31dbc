"""Date-time arithmetic with the warehouse's wall-clock meaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hour_index(ts: Column) -> Column:
    """Whole hours since 1970 on the wall clock; no time zone enters."""
    days = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date"))
    return days.cast("bigint") * 24 + F.hour(ts)


def hours_crossed(start: Column, end: Column) -> Column:
    """Hour boundaries between two times (09:59 to 10:01 gives 1)."""
    return hour_index(end) - hour_index(start)


def plus_hours(ts: Column, hours: int) -> Column:
    return ts + F.make_dt_interval(F.lit(0), F.lit(hours))


def minus_days(ts: Column, days: int) -> Column:
    return ts - F.make_dt_interval(F.lit(days))


def day_bucket(ts: Column, width: int) -> Column:
    """Index of the ``width``-day calendar bucket a time falls into."""
    days = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date"))
    return F.floor(days / F.lit(width)).cast("bigint")
