"""Origin/destination flows over trips and the daily rollup."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from odflow import schema as S
from odflow.functions.calendar import as_date, week_bucket

Day = str | date

# Aggregate over the daily rollup that equals ``count`` over its trips.
TRIPS_OF_ROLLUP = "sum(passenger_count_per_day)"


def measure(agg: str | Column, column: str) -> Column:
    """``count`` and ``avg`` of a column, a SQL aggregate as text, or a Column.

    ``count`` counts the rows with a value; ``sum(<column>)`` adds the values up.
    """
    if isinstance(agg, Column):
        return agg
    if agg in ("count", "avg"):
        agg = f"{agg}({column})"
    return F.expr(agg)


def checked_weekdays(
    weekdays: Iterable[int] | None, time_granularity: str = "period"
) -> list[int] | None:
    """The weekday filter of a request, or None where all days count."""
    days = sorted(set(weekdays or ()))
    if any(d not in range(7) for d in days):
        raise ValueError(f"weekdays run from 0 (Monday) to 6 (Sunday), got {days}")
    if time_granularity in ("specific_weekdays", "on_specific_weekdays"):
        if not days:
            raise ValueError(f"{time_granularity!r} needs at least one weekday")
    elif time_granularity != "period":
        raise ValueError(f"unknown time granularity {time_granularity!r}")
    return days or None


def in_period(df: DataFrame, start: Day, end: Day) -> DataFrame:
    """Rows of the days from ``start`` to ``end``, both included.

    On data stored by month the months of the period prune the partitions.
    """
    month = S.LAYOUTS["month"]
    if month in df.columns:
        first, last = (F.trunc(as_date(day), "month") for day in (start, end))
        df = df.filter(F.col(month).between(first, last))
    if start == end:
        return df.filter(F.col("pickup_date") == as_date(start))
    return df.filter(F.col("pickup_date").between(as_date(start), as_date(end)))


def on_weekdays(df: DataFrame, days: Iterable[int]) -> DataFrame:
    """Rows of some weekdays.

    The weekday is also taken from the date, which prunes data stored by day; the
    stored weekday is what an external database can filter on.
    """
    days = list(days)
    return df.filter(
        F.col("pickup_weekday").isin(days) & F.weekday("pickup_date").isin(days)
    )


def links_within_borough(
    flow: DataFrame, lookup: DataFrame | None, borough: str | None
) -> DataFrame:
    """The links of a flow with both ends in one borough; all of them without a borough.

    It stands behind the aggregation, so that the joins see one row per link and
    bucket and not the trips, whatever Spark knows about the size of the lookup.
    """
    if not borough:
        return flow
    if lookup is None:
        raise ValueError("a borough needs the zone lookup")
    zones = lookup.filter(F.col("borough_name") == borough)
    columns = flow.columns
    for end in ("pu_id", "do_id"):
        flow = flow.join(zones.select(F.col("LocationID").alias(end)), end, "left_semi")
    return flow.select(*columns)


def od_flow(
    trips: DataFrame,
    start: Day,
    end: Day,
    *,
    bucket: str = "period",
    agg: str | Column = "count",
    weekdays: Iterable[int] | None = None,
    time_granularity: str = "period",
    borough: str | None = None,
    lookup: DataFrame | None = None,
    merge_trailing_monday: bool = True,
    ordered: bool = False,
) -> DataFrame:
    """Flow per (pu_id, do_id), for the whole period or per ``day`` or ``week``.

    Day and week results carry ``bucket_date``, the day or the first day of the
    week, also where a weekday filter leaves that day itself out. All buckets come
    from one aggregation.

    The daily rollup can stand in for the trips, so that counts need no scan of
    them: with ``agg=TRIPS_OF_ROLLUP`` the result is that of ``count`` over trips.
    """
    days = checked_weekdays(weekdays, time_granularity)
    rows = in_period(trips, start, end)
    if days:
        rows = on_weekdays(rows, days)

    day = F.col("pickup_date")
    keys = [F.col(S.PU).alias("pu_id"), F.col(S.DO).alias("do_id")]
    if bucket == "day":
        keys.insert(0, day.alias("bucket_date"))
    elif bucket == "week":
        week = week_bucket(day, start, end, merge_trailing_monday)
        keys.insert(0, week.alias("bucket_date"))
    elif bucket != "period":
        raise ValueError(f"bucket is 'day', 'week' or 'period', got {bucket!r}")

    flow = rows.groupBy(*keys).agg(
        measure(agg, "passenger_count").alias("aggregated_result")
    )
    flow = links_within_borough(flow, lookup, borough)
    if ordered:
        flow = flow.orderBy("aggregated_result", *flow.columns[:-1])
    return flow


def daily_rollup(trips: DataFrame, start: Day, end: Day) -> DataFrame:
    """Trips with a passenger count per day and link, the base of period maps."""
    return (
        in_period(trips, start, end)
        .groupBy("pickup_date", "pickup_weekday", S.PU, S.DO)
        .agg(F.count("passenger_count").alias("passenger_count_per_day"))
        .select(*S.DAILY_SCHEMA.names)
    )


def date_spine(period: DataFrame, weekdays: Iterable[int] | None = None) -> DataFrame:
    """Every day between the columns ``start`` and ``end`` of ``period``."""
    days = checked_weekdays(weekdays)
    spine = period.select("*", F.explode(F.sequence("start", "end")).alias("day"))
    return spine.filter(F.weekday("day").isin(days)) if days else spine


def bucket_intervals(spine: DataFrame, merge_trailing_monday: bool = True) -> DataFrame:
    """First and last day of every week bucket of a spine."""
    week = week_bucket(
        F.col("day"), F.col("start"), F.col("end"), merge_trailing_monday
    )
    return spine.groupBy(week.alias("bucket_date")).agg(
        F.min("day").alias("first_day"), F.max("day").alias("last_day")
    )


def special_date_calendar(
    spark: SparkSession, entries: Iterable[tuple[date, str]] = S.SPECIAL_DATES
) -> DataFrame:
    """Calendar (bucket_date, special_date) of a list of labelled days."""
    days = (
        F.struct(F.lit(day).alias("bucket_date"), F.lit(label).alias("special_date"))
        for day, label in entries
    )
    return spark.range(1).select(F.inline(F.array(*days)))


def with_special_dates(df: DataFrame, calendar: DataFrame) -> DataFrame:
    """Label the dates that the calendar (bucket_date, special_date) names."""
    return df.join(calendar, "bucket_date", "left")
