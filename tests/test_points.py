from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from odflow.functions import canvas
from odflow.operators import points, zones
from odflow.operators.flows import od_flow
from odflow.plans import jobs


def test_positions(spark):
    df = spark.sql(
        "SELECT 10D AS pu_x, 20D AS pu_y, 128D AS do_x, 79D AS do_y, 'total' AS map_type"
    )
    rows = {r["frame"]: (r["x"], r["y"]) for r in points.frame_positions(df).collect()}
    assert len(rows) == 60
    assert (rows[0], rows[30], rows[59]) == ((10, 20), (70, 50), (128, 79))


def test_positions_truncate_towards_zero(spark):
    df = spark.range(60).select(
        "id", canvas.position(F.lit(-5.7), F.lit(3.9), F.col("id"), 60).alias("x")
    )
    for r in df.collect():
        assert r["x"] == int(-5.7 + (3.9 - -5.7) / 59.0 * r["id"])


@pytest.fixture(scope="module")
def trips(trip_frame):
    rows = [("2018-01-01", 1, 2)] * 4 + [("2018-01-02", 2, 3)] * 2 + [("2018-01-09", 3, 3)]
    return trip_frame(rows + [("2018-01-03", 1, 99)] * 8).cache()


def test_run_extremes_cover_all_dates_and_unknown_zones(trips):
    flow = od_flow(trips, "2018-01-01", "2018-01-14", bucket="day")
    extremes = points.run_extremes(flow).first()
    assert tuple(extremes) == (1, 8)
    for r in points.with_run_extremes(flow).collect():
        assert (r["min_weight"], r["max_weight"]) == (1, 8)


def test_size_legend(trips):
    flow = od_flow(trips, "2018-01-01", "2018-01-14", bucket="day")
    rows = {r["entry"]: r for r in points.size_legend(flow, ["South"]).collect()}
    assert (rows["max"]["size"], rows["max"]["caption"]) == (30, "8 passengers")
    assert (rows["min"]["size"], rows["min"]["caption"]) == (3, "1 passenger")


def test_animation_links(trips, square_zones):
    links = jobs.animation_links(
        trips, square_zones, "2018-01-01", "2018-01-14", maps=("total", "South"), bucket="week"
    )
    rows = links.collect()
    assert {(r["map_type"], r["bucket_date"], r["pu_id"], r["do_id"]) for r in rows} == {
        (m, date(2018, 1, d), pu, do)
        for m in ("total", "South")
        for d, pu, do in ((1, 1, 2), (1, 2, 3), (8, 3, 3))
    }
    sizes = {(r["map_type"], r["pu_id"], r["do_id"]): r["weight"] for r in rows}
    assert sizes[("total", 1, 2)] == 10 and sizes[("South", 1, 2)] == 15
    assert {r["caption"] for r in rows} == {"Week of the 2018-01-01", "Week of the 2018-01-08"}
    assert {r["is_self"] for r in rows if r["pu_id"] == 3} == {True}
    geometry = zones.zone_geometry(square_zones)
    projection = zones.projections(zones.map_bounds(geometry, ["total"]))
    centres = {
        r["zone_idx"] + 1: (r["center_x"], r["center_y"])
        for r in zones.project_geometry(geometry, projection, ["total"]).collect()
    }
    for r in rows:
        if r["map_type"] == "total":
            assert (r["pu_x"], r["pu_y"]) == pytest.approx(centres[r["pu_id"]])
            assert (r["do_x"], r["do_y"]) == pytest.approx(centres[r["do_id"]])


def test_daily_animation_has_weekday_and_special_date(trips, square_zones):
    frames = jobs.flow_animation(trips, square_zones, "2018-01-01", "2018-01-14")
    assert frames.count() == 3 * 60
    rows = frames.filter("frame = 0").select("bucket_date", "caption", "special_date").collect()
    by_day = {r["bucket_date"].day: (r["caption"], r["special_date"]) for r in rows}
    assert by_day == {1: ("Monday", "New Year"), 2: ("Tuesday", None), 9: ("Tuesday", None)}


def test_animation_needs_a_day_or_week(trips, square_zones):
    with pytest.raises(ValueError):
        jobs.animation_links(trips, square_zones, "2018-01-01", "2018-01-14", bucket="period")


def test_frames_per_link(trips, square_zones):
    links = jobs.animation_links(trips, square_zones, "2018-01-01", "2018-01-14")
    frames = points.frame_positions(links)
    assert frames.count() == 60 * links.count()
    rows = frames.filter("frame = 59").collect()
    last = {(r["pu_id"], r["do_id"]): (r["x"], r["y"]) for r in rows}
    for r in links.collect():
        assert last[(r["pu_id"], r["do_id"])] == pytest.approx((r["do_x"], r["do_y"]), abs=1.0)


def test_a_run_by_configuration_lists(trip_frame, square_zones):
    """Lists as they stand in a configuration file; the period ends on a Monday."""
    trips = trip_frame(
        [("2018-01-01", 1, 2), ("2018-01-02", 1, 2), ("2018-01-03", 1, 2), ("2018-01-15", 4, 1)]
    )
    links = jobs.animation_links(
        trips,
        square_zones,
        *["2018-01-01", "2018-01-15"],
        maps=["total", "North"],
        bucket="week",
        weekdays=[0, 1],
        margins=[],
        zoom_on=[],
        borough=False,
    )
    rows = {
        (r["map_type"], r["bucket_date"].day, r["pu_id"]): (r["aggregated_result"], r["weight"])
        for r in links.collect()
    }
    assert rows == {
        ("total", 1, 1): (2, 20), ("total", 8, 4): (1, 10),
        ("North", 1, 1): (2, 30), ("North", 8, 4): (1, 15),
    }
