"""Period flows and weekday/weekend comparison over the daily rollup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odflow import schema as S
from odflow.operators.flows import (
    Day,
    in_period,
    links_within_borough,
    measure,
    on_weekdays,
)

LINK = ["pu_id", "do_id"]
COUNT_PER_DAY = "passenger_count_per_day"


def _rows(daily: DataFrame, start: Day, end: Day) -> DataFrame:
    return in_period(daily, start, end).withColumnsRenamed({S.PU: "pu_id", S.DO: "do_id"})


def period_flow(
    daily: DataFrame,
    start: Day,
    end: Day,
    *,
    agg: str | Column = "count",
    borough: str | None = None,
    lookup: DataFrame | None = None,
) -> DataFrame:
    """Flow per link over a period of the rollup.

    ``count`` is the number of days on which the link was used and ``avg`` the
    mean per such day; ``sum(passenger_count_per_day)`` is the number of trips.
    """
    flow = (
        _rows(daily, start, end)
        .groupBy(*LINK)
        .agg(measure(agg, COUNT_PER_DAY).alias("aggregated_result"))
    )
    return links_within_borough(flow, lookup, borough)


def weekday_and_weekend_flow(
    daily: DataFrame, start: Day, end: Day, *, agg: str | Column = "count", **where
) -> tuple[DataFrame, DataFrame]:
    """Period flow over the weekdays and over the weekends."""
    weekdays, weekends = (
        period_flow(on_weekdays(daily, days), start, end, agg=agg, **where)
        for days in (S.WEEKDAYS, S.WEEKENDS)
    )
    return weekdays, weekends


def compare_flows(left: DataFrame, right: DataFrame, how: str = "full") -> DataFrame:
    """Difference of two flows per link; a link missing on one side counts 0.

    ``how`` is ``full``, or ``left`` or ``right`` to keep one side's links only.
    """
    left = left.withColumnRenamed("aggregated_result", "l")
    right = right.withColumnRenamed("aggregated_result", "r")
    diff = F.coalesce("l", F.lit(0)) - F.coalesce("r", F.lit(0))
    return left.join(right, LINK, how).select(*LINK, diff.alias("diff"))


def compare_flows_by_union(left: DataFrame, right: DataFrame) -> DataFrame:
    """The full comparison as distinct union of its left and right halves."""
    halves = (compare_flows(left, right, how) for how in ("left", "right"))
    return next(halves).unionByName(next(halves)).distinct()


def _on_weekend() -> Column:
    return F.col("pickup_weekday").isin(*S.WEEKENDS)


def _pivoted(by_side: DataFrame, *others: Column) -> DataFrame:
    """One row per link from one row per link and side, and which sides there are."""
    sides = {"weekday": ~F.col("is_weekend"), "weekend": F.col("is_weekend")}
    columns = [F.max(F.when(on, F.col("result"))).alias(side) for side, on in sides.items()]
    columns += [
        F.coalesce(F.bool_or(on), F.lit(False)).alias(f"has_{side}") for side, on in sides.items()
    ]
    return by_side.groupBy(*LINK).agg(*columns, *others)


def _difference() -> Column:
    return F.coalesce("weekday", F.lit(0)) - F.coalesce("weekend", F.lit(0))


def weekday_weekend_diff(
    daily: DataFrame,
    start: Day,
    end: Day,
    *,
    agg: str | Column = "count",
    borough: str | None = None,
    lookup: DataFrame | None = None,
    how: str = "full",
) -> DataFrame:
    """Weekday flow minus weekend flow per link; a side without flow counts 0.

    The aggregate, text or Column, is computed as given per link and side in one
    scan and one shuffle, and a second small aggregation puts the two sides next to
    each other. ``how`` is ``full``, or ``left`` or ``right`` for the links with
    weekday or weekend flow only, as a join of the two flows would have them.
    """
    if how not in ("full", "left", "right"):
        raise ValueError(f"how is 'full', 'left' or 'right', got {how!r}")
    by_side = (
        _rows(daily, start, end)
        .withColumn("is_weekend", _on_weekend())
        .groupBy(*LINK, "is_weekend")
        .agg(measure(agg, COUNT_PER_DAY).alias("result"))
    )
    sides = _pivoted(by_side)
    if how != "full":
        sides = sides.filter("has_weekday" if how == "left" else "has_weekend")
    diff = sides.select(*LINK, _difference().alias("diff"))
    return links_within_borough(diff, lookup, borough)


def weekday_weekend_diff_by_union(daily: DataFrame, start: Day, end: Day, **options) -> DataFrame:
    """The full difference as distinct union of its left and right halves."""
    halves = (weekday_weekend_diff(daily, start, end, how=how, **options) for how in ("left", "right"))
    return next(halves).unionByName(next(halves)).distinct()


def period_and_diff(
    daily: DataFrame,
    start: Day,
    end: Day,
    *,
    agg: str | Column = "count",
    borough: str | None = None,
    lookup: DataFrame | None = None,
) -> DataFrame:
    """Period flow and weekday/weekend difference as rows of one scan.

    Columns are ``pu_id, do_id, measure, weight``, measure being ``period`` or
    ``diff``. The aggregate is computed as given, per link and per link and side.
    """
    whole = F.col("whole") == 1
    by_side = (
        _rows(daily, start, end)
        .withColumn("is_weekend", _on_weekend())
        .groupingSets([[*LINK], [*LINK, "is_weekend"]], *LINK, "is_weekend")
        .agg(measure(agg, COUNT_PER_DAY).alias("result"), F.grouping("is_weekend").alias("whole"))
    )
    both = _pivoted(by_side, F.max(F.when(whole, F.col("result"))).alias("total")).select(
        *LINK, F.col("total").cast("double").alias("period"), _difference().cast("double").alias("diff")
    )
    both = links_within_borough(both, lookup, borough)
    return both.unpivot(LINK, ["period", "diff"], "measure", "weight")
