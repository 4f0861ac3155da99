"""Random small inputs against plain loops."""

from __future__ import annotations

import random
from collections import defaultdict
from datetime import date, timedelta

import pytest

from odflow.operators import adjacency, comparison, flows, zones
from odflow.operators.cleaning import clean_trips

START, END = date(2018, 1, 4), date(2018, 2, 5)  # a Thursday to a Monday
BOROUGH = {1: "North", 2: "North", 3: "South", 4: "South", 5: "South"}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    made = []
    for _ in range(3000):
        day = START + timedelta(rng.randint(-5, 40))
        pu = 1 if rng.random() < 1 / 3 else rng.choice([1, 2, 3, 4, 5, 264])
        passengers = rng.choice([None, 0, 1, 1, 2, 5])
        tip = rng.choice([None, -1.0, 0.0, 2.0])
        made.append((day, pu, rng.choice([1, 2, 3, 4, 5]), passengers, tip))
    return made


@pytest.fixture(scope="module")
def clean_rows(rows):
    return [
        r for r in rows if r[1] != 264 and r[3] != 0 and not (r[4] is not None and r[4] < 0)
    ]


@pytest.fixture(scope="module")
def trips(trip_frame, rows):
    raw = trip_frame(
        [
            (day.isoformat(), pu, do, {"passenger_count": n, "tip_amount": tip})
            for day, pu, do, n, tip in rows
        ]
    )
    return clean_trips(raw).cache()


@pytest.fixture(scope="module")
def lookup(spark):
    data = [(z, b, f"Z{z}") for z, b in BOROUGH.items()]
    return spark.createDataFrame(data, "LocationID INT, borough_name STRING, zone STRING")


def bucket_of(day):
    """Walk back to the Monday that opened the bucket; a last Monday opens none."""
    if day == END and END.weekday() == 0:
        day -= timedelta(1)
    while day.weekday() != 0 and day > START:
        day -= timedelta(1)
    return day


@pytest.mark.parametrize("bucket", ["day", "week", "period"])
@pytest.mark.parametrize("weekdays", [None, (0, 1), (5, 6)])
@pytest.mark.parametrize("borough", [None, "South"])
def test_flows(trips, clean_rows, lookup, bucket, weekdays, borough):
    values = defaultdict(list)
    for day, pu, do, n, _ in clean_rows:
        if not START <= day <= END or (weekdays and day.weekday() not in weekdays):
            continue
        if borough and not BOROUGH[pu] == BOROUGH[do] == borough:
            continue
        key = {"day": (day,), "week": (bucket_of(day),), "period": ()}[bucket]
        values[(*key, pu, do)].append(n)
    expected = {
        "count": {k: sum(n is not None for n in v) for k, v in values.items()},
        "sum(passenger_count)": {
            k: sum(n or 0 for n in v) if any(v) else None for k, v in values.items()
        },
    }
    for agg, want in expected.items():
        flow = flows.od_flow(
            trips, START, END, bucket=bucket, agg=agg, weekdays=weekdays,
            borough=borough, lookup=lookup,
        )
        assert {tuple(r)[:-1]: r[-1] for r in flow.collect()} == want


def test_comparison_and_extremes(trips, clean_rows, lookup):
    per_day = defaultdict(int)
    for day, pu, do, n, _ in clean_rows:
        if START <= day <= END:
            per_day[(day, pu, do)] += n is not None
    daily = flows.daily_rollup(trips, START, END)
    got = {(r["pickup_date"], r[3], r[4]): r["passenger_count_per_day"] for r in daily.collect()}
    assert got == per_day

    sides = defaultdict(lambda: ([], []))
    for (day, pu, do), n in per_day.items():
        sides[(pu, do)][day.weekday() >= 5].append(n)
    mean = {
        k: (sum(a) / len(a) if a else 0) - (sum(b) / len(b) if b else 0)
        for k, (a, b) in sides.items()
    }
    diff = comparison.weekday_weekend_diff(daily, START, END, agg="avg")
    assert {(r[0], r[1]): r[2] for r in diff.collect()} == pytest.approx(mean)

    directed = adjacency.directed_flows(diff, zones.zones_of_lookup(lookup), "diff")
    for r in adjacency.zone_extremes(directed).collect():
        own = 0 if r["flow_dir"] == "out" else 1
        links = {k[1 - own]: v for k, v in mean.items() if k[own] == r["zone"]}
        assert r["min_weight"] == pytest.approx(min(links.values()))
        assert r["max_weight"] == pytest.approx(max(links.values()))
        assert r["n_colours"] == len({v for z, v in links.items() if z != r["zone"]})


@pytest.mark.parametrize("bucket", ["day", "week", "period"])
def test_the_rollup_stands_in_for_its_trips(trips, lookup, bucket):
    options = {"bucket": bucket, "weekdays": (0, 1, 6), "borough": "South", "lookup": lookup}
    daily = flows.daily_rollup(trips, START, END)
    of_rollup = flows.od_flow(daily, START, END, agg=flows.TRIPS_OF_ROLLUP, **options)
    of_trips = flows.od_flow(trips, START, END, **options)
    assert set(of_rollup.collect()) == set(of_trips.collect())
