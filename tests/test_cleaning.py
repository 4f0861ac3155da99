from __future__ import annotations

import pytest

from odflow.operators.cleaning import clean_trips, rule_counts, unknown_zones

DAY = "2018-01-02"


@pytest.mark.parametrize(
    "changes, kept",
    [
        ({}, True),
        ({"passenger_count": 0}, False),
        ({"passenger_count": None}, True),
        ({"tip_amount": None}, True),
        ({"tip_amount": -0.01}, False),
        ({"tip_amount": None, "fare_amount": -1.0}, False),
        ({"improvement_surcharge": -1.0}, False),
        ({"extra": -1.0, "mta_tax": None}, False),
        ({"tolls_amount": 0.0}, True),
        ({"PULocationID": 264}, False),
        ({"DOLocationID": 265}, False),
        ({"DOLocationID": 0}, False),
        ({"PULocationID": 263}, True),
        ({"total_amount": -5.0}, True),
        ({"trip_distance": -5.0}, True),
        ({"tpep_pickup_datetime": None}, False),
        ({"tpep_dropoff_datetime": None}, False),
    ],
)
def test_clean_up_rules(trip_frame, changes, kept):
    assert clean_trips(trip_frame([(DAY, 1, 2, changes)])).count() == int(kept)


def test_rule_counts_count_every_broken_rule(trip_frame):
    trips = trip_frame(
        [
            (DAY, 0, 2),
            (DAY, 264, 265, {"fare_amount": -1.0}),
            (DAY, 1, 2, {"passenger_count": None, "tip_amount": None}),
        ]
    )
    counts = {r["rule"]: r["n_trips"] for r in rule_counts(trips).collect()}
    broken = {name: n for name, n in counts.items() if n}
    assert broken == {"pickup_zone": 2, "dropoff_zone": 1, "fare_amount": 1}
    assert len(counts) == 11


def test_unknown_zones(spark, trip_frame):
    schema = "LocationID INT, borough_name STRING, zone STRING"
    lookup = spark.createDataFrame([(1, "A", "x")], schema)
    trips = trip_frame([(DAY, 1, 7), (DAY, 7, 1), (DAY, 7, 1)])
    unknown = unknown_zones(trips, lookup).collect()
    rows = {(r["trip_end"], r["LocationID"], r["n_trips"]) for r in unknown}
    assert rows == {("pickup", 7, 2), ("dropoff", 7, 1)}


def test_kept_rows_of_the_driver_tables(spark):
    from odflow_checks import inputs

    trips = inputs.trips(spark, "/root/testdata/sf0.01")
    assert trips.count() == 60_000
    assert clean_trips(trips, inputs.EXCLUDED).count() == 43_876
