from __future__ import annotations

import sys
from datetime import date
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from odflow import schema as S  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("odflow-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.maxMetadataStringLength", "2000")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def trip_frame(spark):
    """Builds trips from (pickup day, pu, do[, changed columns])."""
    from datetime import datetime

    from odflow.operators.cleaning import with_trip_dates

    def build(rows):
        full = []
        for day, pu, do, *changes in rows:
            when = datetime.fromisoformat(day) if day else None
            row = {f.name: 1 for f in S.TRIP_FILE_SCHEMA}
            row |= {f.name: 1.0 for f in S.TRIP_FILE_SCHEMA if f.dataType == S.T.DoubleType()}
            row |= {
                "tpep_pickup_datetime": when,
                "tpep_dropoff_datetime": when,
                "store_and_fwd_flag": "N",
                S.PU: pu,
                S.DO: do,
            }
            row |= changes[0] if changes else {}
            full.append(tuple(row[f.name] for f in S.TRIP_FILE_SCHEMA))
        return with_trip_dates(spark.createDataFrame(full, S.TRIP_FILE_SCHEMA))

    return build


@pytest.fixture(scope="session")
def daily_frame(spark):
    """Builds a daily rollup from (day, pu, do, n)."""

    def build(rows):
        full = [
            (date.fromisoformat(day), date.fromisoformat(day).weekday(), n, pu, do)
            for day, pu, do, n in rows
        ]
        return spark.createDataFrame(full, S.DAILY_SCHEMA)

    return build


@pytest.fixture(scope="session")
def square_zones(spark):
    """Four zones in two boroughs; zone i is a square with its corner at (10 i, 5 i)."""
    rows = []
    for i in range(4):
        x, y = 10.0 * i, 5.0 * i
        ring = [(x, y), (x + 4, y), (x + 4, y + 4), (x, y + 4), (x, y)]
        rows.append((i, 0, f"Z{i + 1}", "North" if i < 2 else "South", ring))
    return spark.createDataFrame(rows, S.ZONE_SCHEMA)
