from __future__ import annotations

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from odflow.functions import calendar as C
from odflow.operators import flows


def intervals(spark, start, end, **options):
    period = spark.range(1).select(C.as_date(start).alias("start"), C.as_date(end).alias("end"))
    rows = flows.bucket_intervals(flows.date_spine(period), **options).orderBy("bucket_date")
    return [(r["first_day"].isoformat(), r["last_day"].isoformat()) for r in rows.collect()]


@pytest.mark.parametrize(
    "start, end, expected",
    [
        ("2018-01-01", "2018-01-15", [("2018-01-01", "2018-01-07"), ("2018-01-08", "2018-01-15")]),
        (
            "2018-12-20",
            "2019-01-03",
            [
                ("2018-12-20", "2018-12-23"),
                ("2018-12-24", "2018-12-30"),
                ("2018-12-31", "2019-01-03"),
            ],
        ),
        ("2018-01-07", "2018-01-08", [("2018-01-07", "2018-01-08")]),
        ("2018-01-07", "2018-01-09", [("2018-01-07", "2018-01-07"), ("2018-01-08", "2018-01-09")]),
        ("2018-01-03", "2018-01-03", [("2018-01-03", "2018-01-03")]),
    ],
)
def test_week_buckets(spark, start, end, expected):
    assert intervals(spark, start, end) == expected


def test_plain_weeks(spark):
    assert intervals(spark, "2018-01-01", "2018-01-15", merge_trailing_monday=False) == [
        ("2018-01-01", "2018-01-07"),
        ("2018-01-08", "2018-01-14"),
        ("2018-01-15", "2018-01-15"),
    ]


def test_week_buckets_against_a_walk_over_the_days(spark):
    """Walk the days one by one: a Monday strictly inside the period opens a bucket."""
    cases, expected = [], {}
    for offset in range(0, 14):
        for length in range(0, 40):
            start = date(2018, 12, 17) + timedelta(offset)
            end = start + timedelta(length)
            bucket = start
            for n in range(length + 1):
                day = start + timedelta(n)
                if day.weekday() == 0 and start < day < end:
                    bucket = day
                cases.append((start, end, day))
                expected[(start, end, day)] = bucket
    df = spark.createDataFrame(cases, "start DATE, end DATE, day DATE")
    bucket = C.week_bucket(F.col("day"), F.col("start"), F.col("end"))
    rows = df.withColumn("bucket", bucket).collect()
    assert len(rows) == len(expected)
    assert all(expected[(r["start"], r["end"], r["day"])] == r["bucket"] for r in rows)


def test_weekdays_and_captions(spark):
    days = [date(2018, 1, 1) + timedelta(n) for n in range(7)]
    df = spark.createDataFrame([(d,) for d in days], "d DATE").select(
        "d",
        C.weekday("d").alias("n"),
        C.weekday_name(F.col("d")).alias("name"),
        C.week_caption(F.col("d")).alias("caption"),
    )
    rows = df.orderBy("d").collect()
    assert [r["n"] for r in rows] == list(range(7))
    assert [r["name"] for r in rows] == [
        "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday",
    ]
    assert rows[0]["caption"] == "Week of the 2018-01-01"


def test_date_spine_with_weekdays(spark):
    period = spark.sql("SELECT DATE '2018-01-01' AS start, DATE '2018-01-14' AS end")
    days = [r["day"].day for r in flows.date_spine(period, (5, 6)).orderBy("day").collect()]
    assert days == [6, 7, 13, 14]


def test_special_dates(spark):
    calendar = flows.special_date_calendar(spark)
    assert calendar.count() == 6
    days = spark.sql("SELECT DATE '2018-07-04' AS bucket_date UNION ALL SELECT DATE '2018-07-05'")
    rows = {
        r["bucket_date"].day: r["special_date"]
        for r in flows.with_special_dates(days, calendar).collect()
    }
    assert rows == {4: "National Day", 5: None}
