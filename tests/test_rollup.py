"""The mergeable rollup: merges, aggregates over it, and loads that add up."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from odflow.operators import flows, rollup
from odflow.sources import readers, writers

START, END = "2018-01-01", "2018-01-31"


@pytest.fixture(scope="module")
def trips(trip_frame):
    rows = []
    for i in range(400):
        day = f"2018-01-{1 + i % 9:02d}"
        count = None if i % 11 == 0 else i % 7
        rows.append((day, 1 + i % 3, 1 + i % 2, {"passenger_count": count, "VendorID": i % 5}))
    rows.append(("2018-01-20", 9, 9, {"passenger_count": None}))
    return trip_frame(rows).cache()


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


AGGREGATES = [
    "count",
    "avg",
    "sum(passenger_count)",
    "sum(passenger_count) / count(*)",
    "max(passenger_count) - min(passenger_count) + count( passenger_count )",
    "approx_count_distinct(passenger_count)",
]


@pytest.mark.parametrize("agg", AGGREGATES)
@pytest.mark.parametrize("bucket", ["day", "week", "period"])
def test_aggregates_over_states_are_those_over_trips(trips, agg, bucket):
    loads = [rollup.daily_state(trips.filter(F.col("VendorID") % 3 == k), START, END) for k in range(3)]
    for states in (rollup.daily_state(trips, START, END), rollup.merged_states(*loads)):
        found = flows.od_flow(states, START, END, bucket=bucket, agg=rollup.over_state(agg))
        assert rows_of(found) == rows_of(flows.od_flow(trips, START, END, bucket=bucket, agg=agg))


def test_percentiles_of_few_trips_are_exact(trips):
    states = rollup.daily_state(trips, START, END)
    median = rollup.over_state("approx_percentile(passenger_count, 0.5)")
    found = flows.od_flow(states, START, END, agg=median)
    exact = "percentile_disc(0.5) WITHIN GROUP (ORDER BY passenger_count)"
    want = flows.od_flow(trips, START, END, agg=f"cast({exact} as bigint)")
    assert rows_of(found) == rows_of(want)


def test_what_states_cannot_answer():
    for agg in (
        "stddev(passenger_count)",
        "sum(fare_amount)",
        "count(distinct passenger_count)",
        "sum(passenger_count) filter (where VendorID = 1)",
        "sum(*)",
        "sum(passenger_count + 1)",
    ):
        with pytest.raises(ValueError):
            rollup.over_state(agg)


def test_states_stand_in_for_the_rollup(trips):
    states = rollup.daily_state(trips, START, END)
    assert rows_of(rollup.as_daily(states)) == rows_of(flows.daily_rollup(trips, START, END))


def counts(states):
    return {(str(r.pickup_date), r.PULocationID, r.DOLocationID): (r.n_rows, r.n_trips, r.total) for r in states.collect()}


@pytest.mark.parametrize("layout", ["day", "month"])
def test_loads_add_up_and_repeats_add_nothing(spark, trips, tmp_path, layout):
    path = str(tmp_path / layout)
    whole = counts(rollup.daily_state(trips, START, END))
    # the first day and others come in two loads, the second load comes twice
    early, late = (trips.filter((F.col("VendorID") < 2) == side) for side in (True, False))
    writers.write_states(rollup.daily_state(early, START, END), path, "morning", layout=layout)
    assert counts(readers.read_states(spark, path, layout)) == counts(rollup.daily_state(early, START, END))
    for _ in range(2):
        writers.write_states(rollup.daily_state(late, START, END), path, "evening", layout=layout)
        assert counts(readers.read_states(spark, path, layout)) == whole
    # a corrected load replaces what it brought before, and nothing of the other
    fewer = late.filter(F.col("PULocationID") != 2)
    writers.write_states(rollup.daily_state(fewer, START, END), path, "evening", layout=layout)
    kept = early.unionByName(fewer)
    assert counts(readers.read_states(spark, path, layout)) == counts(rollup.daily_state(kept, START, END))


def test_date_filters_prune_stored_states(spark, trips, tmp_path):
    path = str(tmp_path / "s")
    writers.write_states(rollup.daily_state(trips, START, END), path, "a")
    one = flows.in_period(readers.read_states(spark, path), "2018-01-02", "2018-01-02")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "pickup_date" in plan.split("PartitionFilters: [", 1)[1].split("]")[0]


def test_trip_loads_share_a_day(spark, trips, tmp_path):
    path = str(tmp_path / "t")
    for load, side in (("a", True), ("b", False), ("b", False)):
        writers.write_trips(trips.filter((F.col("VendorID") < 2) == side), path, load=load)
    stored = readers.read_trips(spark, path)
    assert sorted(stored.columns) == sorted(trips.columns)
    assert counts(rollup.daily_state(stored, START, END)) == counts(rollup.daily_state(trips, START, END))
    with pytest.raises(ValueError):
        writers.write_trips(trips, path, load="a/b")
