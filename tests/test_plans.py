"""The physical plans the operators are written for."""

from __future__ import annotations

import re

import pytest

from odflow_checks.catalog import QUERIES

SF = "/root/testdata/sf0.01"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df):
    df.collect()
    return plan(df)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_and_no_nested_loop(spark, name):
    text = plan(QUERIES[name](spark, SF))
    for node in ("Python", "BroadcastNestedLoopJoin", "CartesianProduct"):
        assert node not in text, node


def test_comparison_is_one_scan(spark, daily_frame, tmp_path):
    from odflow.operators.comparison import weekday_weekend_diff
    from odflow.sources import readers, writers

    writers.write_daily(daily_frame([("2018-01-01", 1, 2, 5)]), str(tmp_path / "d"))
    daily = readers.read_daily(spark, str(tmp_path / "d"))
    text = plan(weekday_weekend_diff(daily, "2018-01-01", "2018-01-31", agg="avg"))
    assert text.count("FileScan") == 1
    assert "PartitionFilters: [isnotnull(pickup_date" in text
    assert "ReadSchema: struct<pickup_weekday:int,passenger_count_per_day:bigint," in text


def test_borough_joins_stand_behind_the_aggregation(spark, trip_frame):
    from odflow.operators import flows

    lookup = spark.createDataFrame([(1, "B")], "LocationID int, borough_name string")
    unknown = lookup.repartition(3).union(lookup.repartition(2))
    trips = trip_frame([("2018-01-01", 1, 1)])
    text = plan(flows.od_flow(trips, "2018-01-01", "2018-01-31", borough="B", lookup=unknown))
    # reading down, both semi-joins come before the aggregation and none after
    assert text.count("LeftSemi") == 2
    assert text.rindex("LeftSemi") < text.index("HashAggregate")


def test_comparison_forms_join_the_trips_once(spark):
    for name in ("wd_we_full_join", "outer_join_union"):
        text = final_plan(QUERIES[name](spark, SF)).split("Initial Plan")[0]
        assert len(re.findall(r"FileScan parquet \[l_orderkey", text)) <= 1, name


def test_clean_up_reaches_the_scans(spark):
    text = plan(QUERIES["od_each_day"](spark, SF))
    assert "Or(GreaterThanOrEqual(s_acctbal,0.0),IsNull(s_acctbal))" in text
    assert "Or(GreaterThanOrEqual(c_acctbal,0.0),IsNull(c_acctbal))" in text
    assert "GreaterThanOrEqual(o_orderdate" in text


def test_only_used_columns_are_read(spark):
    text = plan(QUERIES["period_flow_count"](spark, SF))
    assert "l_returnflag" not in text and "o_totalprice" not in text


@pytest.mark.parametrize("name", ["preset_year_weekends", "frame_positions", "point_weights"])
def test_flow_is_aggregated_once_for_sizes_and_links(spark, name):
    """The subquery with the extremes of the run reuses the shuffle of the flow."""
    text = final_plan(QUERIES[name](spark, SF)).split("Initial Plan")[0]
    assert re.search(r"Subquery.*", text)
    assert "ReusedExchange" in text
    scans = re.findall(r"FileScan parquet \[l_orderkey", text)
    assert len(scans) <= 1


def test_both_directions_and_measures_share_one_scan(spark):
    text = plan(QUERIES["choropleth_products"](spark, SF))
    assert len(re.findall(r"FileScan parquet \[l_orderkey", text)) == 1
