from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from odflow.operators import flows
from odflow.operators.flows import daily_rollup, od_flow


@pytest.fixture(scope="module")
def trips(trip_frame):
    return trip_frame(
        [
            ("2018-01-01", 1, 2, {"passenger_count": 3}),  # Monday
            ("2018-01-01", 1, 2, {"passenger_count": None}),
            ("2018-01-02", 1, 2, {"passenger_count": 5}),
            ("2018-01-06", 2, 3, {"passenger_count": 1}),  # Saturday
            ("2018-01-08", 1, 1, {"passenger_count": 2}),  # Monday
            ("2018-01-15", 1, 2, {"passenger_count": 4}),  # Monday
        ]
    ).cache()


@pytest.fixture(scope="module")
def lookup(spark):
    rows = [(1, "North", "Z1"), (2, "North", "Z2"), (3, "South", "Z3")]
    return spark.createDataFrame(rows, "LocationID INT, borough_name STRING, zone STRING")


def result(df):
    return {tuple(r)[:-1]: r[-1] for r in df.collect()}


def test_count_is_trips_with_a_passenger_count(trips):
    assert result(od_flow(trips, "2018-01-01", "2018-01-15")) == {
        (1, 2): 3, (2, 3): 1, (1, 1): 1,
    }


def test_avg_sum_and_column_aggregates(trips):
    period = ("2018-01-01", "2018-01-02")
    assert result(od_flow(trips, *period, agg="avg")) == {(1, 2): 4.0}
    assert result(od_flow(trips, *period, agg="sum(passenger_count)")) == {(1, 2): 8}
    assert result(od_flow(trips, *period, agg=F.max("passenger_count"))) == {(1, 2): 5}


def test_single_day(trips):
    assert result(od_flow(trips, "2018-01-06", "2018-01-06")) == {(2, 3): 1}


def test_per_day(trips):
    flow = od_flow(trips, "2018-01-01", "2018-01-08", bucket="day")
    assert result(flow) == {
        (date(2018, 1, 1), 1, 2): 1,
        (date(2018, 1, 2), 1, 2): 1,
        (date(2018, 1, 6), 2, 3): 1,
        (date(2018, 1, 8), 1, 1): 1,
    }


def test_per_week_keeps_a_trailing_monday_in_the_week_before(trips):
    flow = od_flow(trips, "2018-01-01", "2018-01-15", bucket="week")
    assert result(flow) == {
        (date(2018, 1, 1), 1, 2): 2,
        (date(2018, 1, 1), 2, 3): 1,
        (date(2018, 1, 8), 1, 1): 1,
        (date(2018, 1, 8), 1, 2): 1,
    }
    plain = od_flow(
        trips, "2018-01-01", "2018-01-15", bucket="week", merge_trailing_monday=False
    )
    assert (date(2018, 1, 15), 1, 2) in result(plain)


def test_bucket_key_is_the_first_day_even_if_filtered_out(trips):
    flow = od_flow(trips, "2018-01-01", "2018-01-07", bucket="week", weekdays=[5])
    assert result(flow) == {(date(2018, 1, 1), 2, 3): 1}


def test_one_day_that_is_not_among_the_weekdays_gives_no_rows(trips):
    assert od_flow(trips, "2018-01-01", "2018-01-01", weekdays=[4]).count() == 0


def test_one_day_per_week(trips):
    flow = od_flow(trips, "2018-01-02", "2018-01-02", bucket="week")
    assert result(flow) == {(date(2018, 1, 2), 1, 2): 1}


def test_borough_needs_both_ends(trips, lookup):
    period = ("2018-01-01", "2018-01-15")
    north = od_flow(trips, *period, borough="North", lookup=lookup)
    assert result(north) == {(1, 2): 3, (1, 1): 1}
    assert od_flow(trips, *period, borough="South", lookup=lookup).count() == 0


def test_ordered(trips):
    flow = od_flow(trips, "2018-01-01", "2018-01-15", ordered=True)
    assert [r["aggregated_result"] for r in flow.collect()] == [1, 1, 3]


def test_requests_are_checked(trips):
    with pytest.raises(ValueError):
        od_flow(trips, "2018-01-01", "2018-01-15", bucket="month")
    with pytest.raises(ValueError):
        od_flow(trips, "2018-01-01", "2018-01-15", weekdays=[7])
    for name in ("specific_weekdays", "on_specific_weekdays"):
        with pytest.raises(ValueError):
            flows.checked_weekdays([], name)
        assert flows.checked_weekdays((6, 5), name) == [5, 6]
    assert flows.checked_weekdays(()) is None


def test_daily_rollup(trips):
    rows = daily_rollup(trips, "2018-01-01", "2018-01-06").collect()
    assert {tuple(r) for r in rows} == {
        (date(2018, 1, 1), 0, 1, 1, 2),
        (date(2018, 1, 2), 1, 1, 1, 2),
        (date(2018, 1, 6), 5, 1, 2, 3),
    }


def test_daily_counts_add_up_to_the_period(trips):
    period = ("2018-01-01", "2018-01-15")
    days = od_flow(trips, *period, bucket="day").agg(F.sum("aggregated_result")).first()[0]
    weeks = od_flow(trips, *period, bucket="week").agg(F.sum("aggregated_result")).first()[0]
    total = od_flow(trips, *period).agg(F.sum("aggregated_result")).first()[0]
    assert days == weeks == total == 5


def test_hot_link(spark):
    """A third of all trips on one link: whole counts, and few rows in the shuffle."""
    n = 300_000
    day = F.date_add(F.lit(date(2018, 1, 1)), (F.col("id") % 10).cast("int"))
    link = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50)
    rows = spark.range(0, n, 1, 16).select(
        day.alias("pickup_date"),
        F.weekday(day).alias("pickup_weekday"),
        (link + 1).cast("int").alias("PULocationID"),
        (link + 2).cast("int").alias("DOLocationID"),
        F.lit(1).alias("passenger_count"),
    )
    flow = od_flow(rows, "2018-01-01", "2018-01-10")
    expected = {}
    for i in range(n):
        key = 0 if i % 3 == 0 else i % 50
        expected[(key + 1, key + 2)] = expected.get((key + 1, key + 2), 0) + 1
    assert result(flow) == expected

    def written(node):
        metric = node.metrics().get("shuffleRecordsWritten")
        own = metric.get().value() if metric.isDefined() else 0
        children = node.children()
        inner = [children.apply(i) for i in range(children.size())]
        if node.nodeName() == "AdaptiveSparkPlan":
            inner = [node.executedPlan()]
        elif "QueryStage" in node.nodeName():
            inner = [node.plan()]
        return own + sum(map(written, inner))

    assert 0 < written(flow._jdf.queryExecution().executedPlan()) <= 16 * 50
