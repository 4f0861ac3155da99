from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from odflow import schema as S
from odflow.functions import canvas
from odflow.operators import zones
from odflow.plans import jobs
from odflow.sources.readers import parts_from_vertices


def test_centroid_is_the_mean_of_all_vertices(square_zones):
    first = zones.zone_geometry(square_zones).filter("zone_idx = 0").first()
    assert (first["center_x"], first["center_y"]) == pytest.approx((1.6, 1.6))
    assert (first["lower_x"], first["lower_y"], first["upper_x"], first["upper_y"]) == (0, 0, 4, 4)
    assert first["n_vertices"] == 5


def test_rings_come_from_the_input(spark, square_zones):
    vertices = square_zones.select(
        "zone_idx", "zone", "borough", "part", F.posexplode("coords").alias("seq", "p")
    ).select("zone_idx", "zone", "borough", "part", "seq", "p.x", "p.y")
    second = vertices.filter("zone_idx = 1").withColumn("part", F.lit(7))
    parts = parts_from_vertices(vertices.unionByName(second).repartition(3))
    rows = {(r["zone_idx"], r["part"]): [tuple(p) for p in r["coords"]] for r in parts.collect()}
    assert len(rows) == square_zones.count() + 1
    assert rows[1, 7] == rows[1, 0] == [(10, 5), (14, 5), (14, 9), (10, 9), (10, 5)]


def test_long_rings_stay_whole(spark):
    ring = spark.range(10_000).selectExpr(
        "0 AS zone_idx", "'Z' AS zone", "'B' AS borough", "0 AS part", "id AS seq",
        "cast(id AS double) AS x", "0.0D AS y",
    )
    row = parts_from_vertices(ring).first()
    assert len(row["coords"]) == 10_000


def test_zone_without_vertices(spark, square_zones):
    empty = spark.createDataFrame([(9, 0, "Z10", "North", [])], S.ZONE_SCHEMA)
    geometry = zones.zone_geometry(square_zones.union(empty))
    row = geometry.filter("zone_idx = 9").first()
    assert (row["n_vertices"], row["center_x"], row["lower_x"]) == (0, None, None)
    assert zones.map_bounds(geometry, ["total"]).first()["max_x"] == 34


def test_filters(square_zones):
    assert zones.filter_zones(square_zones, ("North", "borough")).count() == 2
    assert zones.filter_zones(square_zones, (["Z1", "Z4"], "zone")).count() == 2
    with pytest.raises(ValueError):
        zones.filter_zones(square_zones, ("North", "county"))


def bounds(spark, max_x, max_y):
    return spark.createDataFrame(
        [("total", 0.0, 0.0, float(max_x), float(max_y))],
        "map_type STRING, min_x DOUBLE, min_y DOUBLE, max_x DOUBLE, max_y DOUBLE",
    )


def test_projection_of_a_wide_map(spark):
    p = zones.projections(bounds(spark, 200, 100))
    row = p.first()
    assert row["conversion"] == pytest.approx(9.6)
    assert (row["axis_to_center"], row["shift_x"], row["shift_y"]) == ("y", 0, pytest.approx(60))
    point = p.select(canvas.canvas_x(F.lit(50.0)), canvas.canvas_y(F.lit(25.0))).first()
    assert tuple(point) == pytest.approx((480, 780))


def test_projection_of_a_high_map_and_a_tie(spark):
    high = zones.projections(bounds(spark, 100, 200)).first()
    assert (high["axis_to_center"], high["conversion"]) == ("x", pytest.approx(5.4))
    tie = zones.projections(bounds(spark, 192, 108)).first()
    assert tie["axis_to_center"] == "x"


def test_margins_shrink_the_area(spark):
    row = zones.projections(bounds(spark, 200, 100), margins=(10, 20, 30, 40)).first()
    assert row["conversion"] == pytest.approx(min((1920 - 60) / 200, (1080 - 40) / 100))
    assert row["floor_y"] == 1050
    same = zones.projections(bounds(spark, 200, 100), margins=[]).first()
    assert same["floor_y"] == 1080


def test_degenerate_map_has_no_scale(spark):
    assert zones.projections(bounds(spark, 0, 0)).first()["conversion"] is None


def test_round_trip(spark):
    p = zones.projections(bounds(spark, 200, 100), margins=(10, 20, 30, 40))
    x, y = canvas.canvas_x(F.lit(33.0)), canvas.canvas_y(F.lit(44.0))
    assert tuple(p.select(canvas.map_x(x), canvas.map_y(y)).first()) == pytest.approx((33, 44))
    scaled = canvas.scale(F.lit(33.0), F.col("min_x"), F.col("conversion"))
    back = canvas.unscale(scaled, F.col("min_x"), F.col("conversion"))
    assert p.select(back).first()[0] == pytest.approx(33)


def test_map_bounds(square_zones):
    geometry = zones.zone_geometry(square_zones)
    rows = zones.map_bounds(geometry, ["total", "South"]).collect()
    by_map = {r["map_type"]: (r["min_x"], r["min_y"], r["max_x"], r["max_y"]) for r in rows}
    assert by_map == {"total": (0, 0, 34, 19), "South": (20, 10, 34, 19)}
    zoomed = zones.map_bounds(geometry, ["total"], (["Z2"], "zone")).first()
    assert (zoomed["min_x"], zoomed["max_x"]) == (10, 14)


def test_projected_geometry_equals_geometry_of_projected_vertices(square_zones):
    maps = ["total", "North"]
    geometry = zones.zone_geometry(square_zones)
    projection = zones.projections(zones.map_bounds(geometry, maps), margins=(5, 6, 7, 8))
    direct = zones.project_geometry(geometry, projection, maps)
    shapes = zones.project_parts(square_zones, projection, maps)
    for name in maps:
        redone = zones.zone_geometry(shapes.filter(F.col("map_type") == name))
        expected = {r["zone_idx"]: r.asDict() for r in redone.collect()}
        for r in direct.filter(F.col("map_type") == name).collect():
            want = expected[r["zone_idx"]]
            got = {k: v for k, v in r.asDict().items() if k != "map_type"}
            assert got == pytest.approx({k: want[k] for k in got})


def test_every_vertex_of_the_total_map_is_on_the_canvas(square_zones):
    shapes = jobs.base_map(square_zones, image_size=(300, 200))
    x = F.transform("coords", lambda p: p["x"])
    y = F.transform("coords", lambda p: p["y"])
    lowest = shapes.agg(
        F.min(F.array_min(x)), F.min(F.array_min(y)), F.max(F.array_max(x)), F.max(F.array_max(y))
    ).first()
    assert lowest[0] >= -1e-9 and lowest[1] >= -1e-9
    assert lowest[2] <= 300 + 1e-9 and lowest[3] <= 200 + 1e-9


def test_base_map_selectors(square_zones):
    shapes = jobs.base_map(square_zones, ("total", "South"), filter_on=("North", "borough"))
    assert shapes.count() == 8
    outlined = {r["zone_idx"] for r in shapes.filter("in_outline").collect()}
    assert outlined == {0, 1}
    single = jobs.base_map(square_zones, ("total", "South"), single_borough=True)
    counts = {r["map_type"]: r["count"] for r in single.groupBy("map_type").count().collect()}
    assert counts == {"total": 4, "South": 2}
    assert shapes.filter("in_outline").count() == 4


def test_zone_schema_is_read_from_json(spark, square_zones, tmp_path):
    from odflow.sources.readers import read_zones

    square_zones.write.json(str(tmp_path / "zones"))
    back = read_zones(spark, str(tmp_path / "zones"), "json")
    assert back.schema == S.ZONE_SCHEMA
    assert sorted(map(str, back.collect())) == sorted(map(str, square_zones.collect()))
