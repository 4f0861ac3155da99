"""Calendar expressions: weekdays, week buckets and captions."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_date(value: str | date | Column) -> Column:
    """A date column; strings become typed literals so filters prune partitions."""
    if isinstance(value, Column):
        return value
    if isinstance(value, str):
        value = date.fromisoformat(value)
    return F.lit(value)


def weekday(day: str | Column) -> Column:
    """0 = Monday ... 6 = Sunday."""
    return F.weekday(day)


def week_bucket(
    day: Column,
    start: str | date | Column,
    end: str | date | Column,
    merge_trailing_monday: bool = True,
) -> Column:
    """First day of the week bucket that holds ``day`` in the period [start, end].

    A bucket opens on the start of the period and on every Monday after it. By
    default a period that ends on a Monday keeps that Monday in the bucket
    before, which then has eight days; ``merge_trailing_monday=False`` gives
    plain weeks clipped to the period.
    """
    first, last = as_date(start), as_date(end)
    if merge_trailing_monday:
        day = F.least(day, F.date_sub(last, 1))
    # trunc(..., 'week') is the Monday of the week
    return F.greatest(first, F.trunc(day, "week"))


def weekday_name(day: Column) -> Column:
    return F.date_format(day, "EEEE")


def week_caption(day: Column) -> Column:
    return F.format_string("Week of the %s", F.date_format(day, "yyyy-MM-dd"))
