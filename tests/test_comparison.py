from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from odflow.operators import comparison as C

PERIOD = ("2018-01-01", "2018-01-07")


@pytest.fixture(scope="module")
def daily(daily_frame):
    return daily_frame(
        [
            ("2018-01-01", 1, 2, 10),
            ("2018-01-02", 1, 2, 20),
            ("2018-01-06", 1, 2, 6),
            ("2018-01-07", 3, 4, 7),
            ("2018-01-03", 5, 6, 8),
            ("2018-02-01", 1, 2, 99),
        ]
    ).cache()


def result(df):
    return {(r[0], r[1]): r[2] for r in df.collect()}


SUM = "sum(passenger_count_per_day)"


@pytest.mark.parametrize(
    "agg, expected",
    [
        ("count", {(1, 2): 1, (3, 4): -1, (5, 6): 1}),
        ("avg", {(1, 2): 9.0, (3, 4): -7.0, (5, 6): 8.0}),
        (SUM, {(1, 2): 24, (3, 4): -7, (5, 6): 8}),
    ],
)
def test_weekday_weekend_diff(daily, agg, expected):
    assert result(C.weekday_weekend_diff(daily, *PERIOD, agg=agg)) == expected
    sides = C.weekday_and_weekend_flow(daily, *PERIOD, agg=agg)
    assert result(C.compare_flows(*sides)) == expected
    assert result(C.compare_flows_by_union(*sides)) == expected


def test_diff_of_a_column_aggregate(daily):
    diff = C.weekday_weekend_diff(daily, *PERIOD, agg=F.max("passenger_count_per_day"))
    assert result(diff) == {(1, 2): 14, (3, 4): -7, (5, 6): 8}


def test_left_and_right_halves(daily):
    sides = C.weekday_and_weekend_flow(daily, *PERIOD)
    assert result(C.compare_flows(*sides, "left")) == {(1, 2): 1, (5, 6): 1}
    assert result(C.compare_flows(*sides, "right")) == {(1, 2): 1, (3, 4): -1}


def test_swapping_the_sides_changes_the_sign(daily):
    wd, we = C.weekday_and_weekend_flow(daily, *PERIOD, agg="avg")
    there, back = result(C.compare_flows(wd, we)), result(C.compare_flows(we, wd))
    assert there == {k: -v for k, v in back.items()}


def test_one_day_period(daily):
    day = ("2018-01-07", "2018-01-07")
    assert result(C.weekday_weekend_diff(daily, *day)) == {(3, 4): -1}


def test_period_flow(daily):
    assert result(C.period_flow(daily, *PERIOD)) == {(1, 2): 3, (3, 4): 1, (5, 6): 1}
    assert result(C.period_flow(daily, *PERIOD, agg="avg"))[(1, 2)] == 12.0
    assert result(C.period_flow(daily, *PERIOD, agg=SUM))[(1, 2)] == 36


def test_borough(spark, daily):
    lookup = spark.createDataFrame(
        [(i, "A" if i < 5 else "B", f"Z{i}") for i in range(1, 7)],
        "LocationID INT, borough_name STRING, zone STRING",
    )
    where = {"borough": "A", "lookup": lookup}
    assert set(result(C.period_flow(daily, *PERIOD, **where))) == {(1, 2), (3, 4)}
    assert result(C.weekday_weekend_diff(daily, *PERIOD, **where)) == {(1, 2): 1, (3, 4): -1}


@pytest.mark.parametrize("as_column", [False, True])
def test_period_and_diff(daily, as_column):
    agg = F.avg("passenger_count_per_day") if as_column else "avg"
    rows = C.period_and_diff(daily, *PERIOD, agg=agg).collect()
    by_measure = {
        m: {(r["pu_id"], r["do_id"]): r["weight"] for r in rows if r["measure"] == m}
        for m in ("period", "diff")
    }
    assert by_measure["period"] == result(C.period_flow(daily, *PERIOD, agg="avg"))
    assert by_measure["diff"] == result(C.weekday_weekend_diff(daily, *PERIOD, agg="avg"))


def test_composite_text_and_column_agree(daily):
    from pyspark.sql import functions as F

    n = F.col("passenger_count_per_day")
    forms = {
        "sum(passenger_count_per_day) / count(*)": F.sum(n) / F.count("*"),
        "sum(passenger_count_per_day) + max(passenger_count_per_day)": F.sum(n) + F.max(n),
        "round(avg(passenger_count_per_day), 2)": F.round(F.avg(n), 2),
    }
    for text, column in forms.items():
        found = result(C.weekday_weekend_diff(daily, *PERIOD, agg=text))
        assert found == result(C.weekday_weekend_diff(daily, *PERIOD, agg=column))
        both = C.period_and_diff(daily, *PERIOD, agg=text).filter("measure = 'diff'")
        assert {(r.pu_id, r.do_id): r.weight for r in both.collect()} == found


def test_composite_diff_by_hand(daily_frame):
    daily = daily_frame([("2018-01-01", 1, 2, 5), ("2018-01-02", 1, 2, 3), ("2018-01-06", 1, 2, 1)])
    ratio = C.weekday_weekend_diff(daily, *PERIOD, agg="sum(passenger_count_per_day) / count(*)")
    assert result(ratio) == {(1, 2): 3.0}


def test_halves_of_the_difference(daily):
    assert result(C.weekday_weekend_diff(daily, *PERIOD, how="left")) == {(1, 2): 1, (5, 6): 1}
    assert result(C.weekday_weekend_diff(daily, *PERIOD, how="right")) == {(1, 2): 1, (3, 4): -1}
    full = result(C.weekday_weekend_diff(daily, *PERIOD))
    assert result(C.weekday_weekend_diff_by_union(daily, *PERIOD)) == full
