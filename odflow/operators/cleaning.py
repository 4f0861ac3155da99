"""Trip preparation: derived dates, clean-up and checks of zone ids."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odflow import schema as S
from odflow.functions.calendar import weekday


def with_trip_dates(trips: DataFrame) -> DataFrame:
    """Add date and weekday of pickup and dropoff."""
    days = {end: F.to_date(f"tpep_{end}_datetime") for end in ("pickup", "dropoff")}
    return trips.withColumns(
        {f"{end}_date": day for end, day in days.items()}
        | {f"{end}_weekday": weekday(day) for end, day in days.items()}
    )


def clean_up_rules(excluded_zones: Iterable[int] = S.EXCLUDED_ZONES) -> dict[str, Column]:
    """Rules that remove a trip, by name; a rule that is null does not remove."""
    excluded = list(excluded_zones)
    rules = {
        "pickup_zone": F.col(S.PU).isin(excluded),
        "dropoff_zone": F.col(S.DO).isin(excluded),
        "passenger_count": F.col("passenger_count") == 0,
        "pickup_time": F.col("tpep_pickup_datetime").isNull(),
        "dropoff_time": F.col("tpep_dropoff_datetime").isNull(),
    }
    rules.update({name: F.col(name) < 0 for name in S.NON_NEGATIVE_AMOUNTS})
    return rules


def clean_trips(
    trips: DataFrame, excluded_zones: Iterable[int] = S.EXCLUDED_ZONES
) -> DataFrame:
    """Trips that break no clean-up rule; missing values break none but the times.

    Each rule is a conjunct of its own, in a form that can move to the scan of its
    column.
    """
    rules = clean_up_rules(excluded_zones).values()
    return trips.filter(reduce(and_, (~rule | rule.isNull() for rule in rules)))


def rule_counts(
    trips: DataFrame, excluded_zones: Iterable[int] = S.EXCLUDED_ZONES
) -> DataFrame:
    """Number of trips that break each clean-up rule, in one pass."""
    rules = clean_up_rules(excluded_zones)
    counts = trips.agg(*(F.count_if(rule).alias(name) for name, rule in rules.items()))
    return counts.unpivot([], list(rules), "rule", "n_trips")


def unknown_zones(trips: DataFrame, lookup: DataFrame) -> DataFrame:
    """Zone ids of trips that the lookup does not know, with their trip counts.

    A missing id refers to no zone, so it breaks no rule. Trips are counted per zone before the join, so it sees one row per zone id.
    """
    ends = F.explode(
        F.array(
            F.struct(F.lit("pickup").alias("trip_end"), F.col(S.PU).alias("LocationID")),
            F.struct(F.lit("dropoff").alias("trip_end"), F.col(S.DO).alias("LocationID")),
        )
    )
    return (
        trips.select(ends.alias("e"))
        .select("e.trip_end", "e.LocationID")
        .filter("LocationID is not null")
        .groupBy("trip_end", "LocationID")
        .agg(F.count("*").alias("n_trips"))
        .join(lookup.select("LocationID"), "LocationID", "left_anti")
    )
