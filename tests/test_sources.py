from __future__ import annotations

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from odflow import schema as S
from odflow.operators.comparison import period_flow
from odflow.operators.flows import od_flow
from odflow.operators.points import frame_positions
from odflow.operators.zones import zone_attributes
from odflow.plans import jobs
from odflow.sources import readers, writers

HEADER = ",".join(S.TRIP_FILE_SCHEMA.names)
LINES = [
    "1,2018-01-01 00:10:00,2018-01-02 00:20:00,2,1.5,1,N,41,24,2,6.5,0.5,0.5,0,0,0.3,7.8",
    "2,2018-01-06 23:59:59,2018-01-07 00:05:00,,0.9,1,Y,24,41,1,5,0.5,0.5,1.2,0,0.3,7.5",
    "2,0000-00-00 00:00:00,2018-01-07 00:05:00,1,0.9,1,N,24,41,1,5,0.5,0.5,1.2,0,0.3,7.5",
]


@pytest.fixture
def trip_file(tmp_path):
    path = tmp_path / "trips.csv"
    path.write_bytes("\r\n".join([HEADER, *LINES, ""]).encode())
    return str(path)


def test_trip_files(spark, trip_file):
    trips = readers.read_trip_files(spark, trip_file)
    assert trips.schema.names == S.TRIP_SCHEMA.names[:17] + [
        "pickup_date", "dropoff_date", "pickup_weekday", "dropoff_weekday",
    ]
    first, second, third = trips.collect()
    assert first["tpep_pickup_datetime"] == datetime(2018, 1, 1, 0, 10)
    assert (first["pickup_date"], first["pickup_weekday"]) == (date(2018, 1, 1), 0)
    assert (first["dropoff_date"], first["dropoff_weekday"]) == (date(2018, 1, 2), 1)
    assert (first["total_amount"], first["store_and_fwd_flag"]) == (7.8, "N")
    assert (second["pickup_weekday"], second["passenger_count"]) == (5, 0)
    assert third["tpep_pickup_datetime"] is None and third["pickup_date"] is None
    assert (third["PULocationID"], third["total_amount"]) == (24, 7.5)


def test_blank_numbers_can_stay_null(spark, trip_file):
    trips = readers.read_trip_files(spark, trip_file, blank_as_zero=False)
    assert trips.filter("passenger_count IS NULL").count() == 1


def test_prepared_trips_and_rollup(spark, trip_frame, tmp_path):
    raw = trip_frame(
        [("2018-01-01", 1, 2)] * 3
        + [("2018-01-02", 1, 2), ("2018-01-02", 264, 2), ("2019-01-01", 1, 2)]
    )
    trips, daily = jobs.prepare_trips(
        raw, str(tmp_path / "trips"), str(tmp_path / "daily"), "2018-01-01", "2018-12-31"
    )
    assert trips.count() == 5
    assert sorted(trips.columns) == sorted(S.TRIP_SCHEMA.names)
    assert {(r["pickup_date"].day, r["passenger_count_per_day"]) for r in daily.collect()} == {
        (1, 3), (2, 1),
    }
    day = trips.filter(F.col("pickup_date") == F.lit(date(2018, 1, 2)))
    assert day.count() == 1
    plan = day._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(pickup_date" in plan
    weekends = od_flow(trips, "2018-01-01", "2018-12-31", weekdays=(5, 6))
    plan = weekends._jdf.queryExecution().executedPlan().toString()
    assert "weekday(pickup_date" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_layout_by_month(spark, trip_frame, tmp_path):
    raw = trip_frame([("2018-01-31", 1, 2), ("2018-02-01", 1, 2), ("2018-03-01", 1, 2)])
    trips, daily = jobs.prepare_trips(
        raw, str(tmp_path / "t"), str(tmp_path / "d"), "2018-01-01", "2018-12-31", layout="month"
    )
    assert (trips.count(), daily.count()) == (3, 3)
    flow = od_flow(trips, "2018-01-15", "2018-02-10", bucket="day")
    assert {r["bucket_date"] for r in flow.collect()} == {date(2018, 1, 31), date(2018, 2, 1)}
    plan = flow._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(pickup_month" in plan
    assert period_flow(daily, "2018-02-01", "2018-03-31").first()["aggregated_result"] == 2


def test_files_in_date_order_are_written_without_a_shuffle(spark, trip_frame, tmp_path):
    path = str(tmp_path / "trips")
    writers.write_trips(trip_frame([("2018-01-01", 1, 2)]), path, in_date_order=True)
    assert readers.read_trips(spark, path).count() == 1


def test_a_hot_date_is_split_over_several_files(spark, trip_frame, tmp_path):
    n = F.col("id")
    day = F.when(n % 3 == 0, F.lit(date(2018, 1, 2))).otherwise(F.lit(date(2018, 1, 1)))
    # most trips on the first date, and an amount that does not compress away
    known = {"pickup_date": day, "fare_amount": F.xxhash64(n).cast("double")}
    hot = spark.range(0, 90_000, 1, 8).select(
        *(known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in S.TRIP_SCHEMA)
    )
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "128k")
    try:
        writers.write_trips(hot, str(tmp_path / "t"))
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert readers.read_trips(spark, str(tmp_path / "t")).count() == 90_000
    files = list((tmp_path / "t" / "pickup_date=2018-01-01").glob("*.parquet"))
    assert len(files) > 1


def test_lookup_from_csv(spark, tmp_path):
    path = tmp_path / "lookup.csv"
    path.write_text("LocationID,borough_name,zone\n1,EWR,Newark Airport\n")
    row = readers.read_lookup(spark, str(path), "csv").first()
    assert tuple(row) == (1, "EWR", "Newark Airport")


def test_stored_products(spark, daily_frame, square_zones, tmp_path):
    daily = daily_frame([("2018-01-01", 1, 2, 5), ("2018-01-06", 2, 1, 3)])
    products = jobs.choropleth(
        daily, zone_attributes(square_zones), "2018-01-01", "2018-01-31", maps=None, compare=True
    )
    path = str(tmp_path / "maps")
    writers.write_choropleth(products, path)
    stored = spark.read.parquet(path)
    names = {r["map_name"] for r in stored.collect()}
    assert "NYC_1_Z1_out_2018_diff_WD_WE" in names
    assert "North_2_Z2_in_2018_diff_WD_WE" in names
    assert len(names) == 8 and stored.count() == products.count()
    assert stored.filter("map_type = 'North' AND flow_dir = 'in'").count() == 2


def test_stored_animation(spark, trip_frame, square_zones, tmp_path):
    trips = trip_frame([("2018-01-01", 1, 2), ("2018-01-02", 2, 1)])
    links = jobs.animation_links(trips, square_zones, "2018-01-01", "2018-01-02")
    writers.write_animation(links, str(tmp_path / "frames"))
    stored = spark.read.parquet(str(tmp_path / "frames"))
    assert stored.count() == 120
    assert stored.filter("bucket_date = DATE '2018-01-02'").count() == 60


def test_animation_is_rebalanced_before_the_frames(spark, trip_frame, square_zones):
    trips = trip_frame([("2018-01-01", 1, 2)])
    links = jobs.animation_links(trips, square_zones, "2018-01-01", "2018-01-02")
    frames = frame_positions(links.hint("rebalance", "map_type", "bucket_date"))
    text = frames._jdf.queryExecution().executedPlan().toString()
    assert text.index("explode(") < text.index("REBALANCE_PARTITIONS_BY_COL")


def test_jdbc_options():
    options = readers.jdbc_options(
        "jdbc:mariadb://host/db", "trips", date(2018, 1, 1), "2018-12-31", user="reader"
    )
    assert options["partitionColumn"] == "pickup_date"
    assert (options["lowerBound"], options["upperBound"]) == ("2018-01-01", "2018-12-31")
    assert options["numPartitions"] == "64" and options["user"] == "reader"


def _trip_lines(*changes):
    from odflow import schema as S

    names = S.TRIP_FILE_SCHEMA.names
    lines = [",".join(names)]
    for change in changes:
        own = dict.fromkeys(names, "1") | {
            "tpep_pickup_datetime": "2018-01-01 00:10:00",
            "tpep_dropoff_datetime": "2018-01-01 00:20:00",
            "store_and_fwd_flag": "N",
        }
        lines.append(",".join((own | change)[n] for n in names))
    return "\r\n".join(lines)


def test_trip_files_keep_what_a_database_reads(spark, tmp_path):
    from odflow.sources import readers

    path = tmp_path / "trips.csv"
    path.write_text(
        _trip_lines(
            {"passenger_count": "1.0"},
            {"tpep_pickup_datetime": "2018-01-01 00:10:00.0"},
            {"passenger_count": "many", "tip_amount": ""},
        )
    )
    rows = readers.read_trip_files(spark, str(path)).collect()
    assert [r.passenger_count for r in rows] == [1, 1, 0]
    assert all(r.tpep_pickup_datetime.minute == 10 for r in rows)
    assert rows[2].tip_amount == 0
    counts = {r["column"]: r.n_values for r in readers.unreadable_values(spark, str(path)).collect()}
    assert counts.pop("passenger_count") == 1 and not any(counts.values())


def test_a_later_load_adds_to_an_earlier_one(spark, daily_frame, tmp_path):
    from odflow.sources import readers, writers

    path = str(tmp_path / "daily")
    writers.write_daily(daily_frame([("2018-01-01", 1, 2, 5), ("2018-01-02", 1, 2, 6)]), path)
    writers.write_daily(daily_frame([("2019-01-01", 1, 2, 7), ("2018-01-02", 1, 2, 8)]), path)
    found = sorted(r.passenger_count_per_day for r in readers.read_daily(spark, path).collect())
    assert found == [5, 7, 8]


def test_missing_zone_ids_are_no_violation(spark):
    from odflow.operators.cleaning import unknown_zones

    trips = spark.createDataFrame([(None, 1), (9, 1)], "PULocationID int, DOLocationID int")
    lookup = spark.createDataFrame([(1,)], "LocationID int")
    assert [tuple(r) for r in unknown_zones(trips, lookup).select("trip_end", "LocationID").collect()] == [("pickup", 9)]
