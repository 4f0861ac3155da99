"""Lines of trip files that are no trips, links that are dropped, files in paint order."""

from __future__ import annotations

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F
from test_sources import _trip_lines

from odflow.operators import adjacency, flows, points, zones
from odflow.plans import jobs
from odflow.sources import readers, writers


@pytest.fixture(scope="module")
def broken_file(tmp_path_factory):
    folder = tmp_path_factory.mktemp("trips")
    good = {"passenger_count": "2"}
    lines = _trip_lines(good, {"passenger_count": "many", "tip_amount": "x"}, {"store_and_fwd_flag": '"Y,N"'}, good).split("\r\n")
    whole = lines[1]
    lines.insert(2, ",".join(whole.split(",")[:9]))  # too short
    lines.insert(3, whole + ",7,8")  # too long
    lines.insert(4, whole.replace(",N,", ',"N,'))  # a quote that is never closed
    lines.insert(5, "one")
    (folder / "a.csv").write_text("\r\n".join(lines) + "\r\n")
    (folder / "b.csv").write_text("\r\n".join(lines[:3]) + "\r\n")
    return str(folder)


def test_rejected_lines_are_kept_apart(spark, broken_file):
    rejected = readers.rejected_lines(spark, broken_file)
    found = sorted((r.file, r.reason) for r in rejected.collect())
    assert found == [("a.csv", "long"), ("a.csv", "quote"), ("a.csv", "short"), ("a.csv", "short"), ("b.csv", "short")]
    assert {r.line for r in rejected.filter("n_values = 1").collect()} == {"one"}
    trips = readers.read_trip_files(spark, broken_file)
    assert trips.count() == 4 + 1
    assert trips.count() + rejected.count() == 8 + 2  # all lines but the headers
    # counting on one column sees the same lines
    assert trips.select("passenger_count").filter("passenger_count = 2").count() == 3
    assert trips.agg(F.sum("passenger_count")).first()[0] == 7
    assert "Y,N" in {r.store_and_fwd_flag for r in trips.collect()}


def test_replaced_values_are_listed(spark, broken_file):
    rows = readers.replaced_values(spark, broken_file).collect()
    assert sorted((r.file, r.column, r.text, r.value) for r in rows) == [
        ("a.csv", "passenger_count", "many", "0"),
        ("a.csv", "tip_amount", "x", "0"),
    ]
    counted = {r["column"]: r.n_values for r in readers.unreadable_values(spark, broken_file).collect()}
    assert counted["passenger_count"] == 1 and counted["tip_amount"] == 1 and sum(counted.values()) == 2


def test_dropped_links_are_counted_as_the_run_goes(spark, square_zones):
    links = [(1, 2, 5), (2, 99, 1), (98, 97, 2), (None, 1, 3), (None, 99, 1), (4, 4, 9)]
    od = spark.createDataFrame(links, "pu_id int, do_id int, aggregated_result int")
    seen = Observation("drops")
    found = adjacency.directed_flows(od, zones.zone_attributes(square_zones), dropped=seen)
    plain = adjacency.directed_flows(od, zones.zone_attributes(square_zones))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, plain.select(*found.columns).collect()))
    assert seen.get == {"n_links": 6, "n_null": 2, "n_unknown": 2, "n_kept": 2}


def test_dropped_links_of_an_animation(spark, trip_frame, square_zones):
    trips = trip_frame([("2018-01-01", 1, 2), ("2018-01-01", 7, 2), ("2018-01-02", None, 2), ("2018-01-02", 4, 4)])
    seen = Observation("animation drops")
    links = jobs.animation_links(trips, square_zones, "2018-01-01", "2018-01-02", dropped=seen)
    same = jobs.animation_links(trips, square_zones, "2018-01-01", "2018-01-02")
    assert {(r.pu_id, r.do_id, r.weight) for r in links.collect()} == {(r.pu_id, r.do_id, r.weight) for r in same.collect()}
    assert seen.get["n_links"] == 4 and seen.get["n_null"] == 1 and seen.get["n_unknown"] == 1


def test_frame_totals(spark, trip_frame, square_zones):
    trips = trip_frame([("2018-01-01", 1, 2), ("2018-01-01", 1, 2), ("2018-01-02", 3, 3)])
    frames = jobs.flow_animation(trips, square_zones, "2018-01-01", "2018-01-02", maps=("total", "North"))
    rows = frames.collect()
    for r in points.frame_totals(frames).collect():
        own = [x for x in rows if (x.map_type, x.frame) == (r.map_type, r.frame)]
        assert r.n_points == len(own) == 2 and r.n_self == 1
        assert (r.sum_x, r.sum_y, r.sum_weight) == tuple(sum(x[c] for x in own) for c in ("x", "y", "weight"))
    assert points.frame_totals(frames).count() == 120


def test_files_hold_small_flows_first(spark, trip_frame, square_zones, tmp_path):
    rows = [(f"2018-01-0{1 + d}", p, q) for d in range(2) for p in range(1, 5) for q in range(1, 5) for _ in range((p * q * 7) % 13 + 1)]
    links = jobs.animation_links(trip_frame(rows), square_zones, "2018-01-01", "2018-01-02")
    path = str(tmp_path / "frames")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        writers.write_animation(links, path, in_paint_order=True)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    manifest = writers.paint_manifest(spark, path).orderBy("map_type", "bucket_date", "place").collect()
    assert sum(f.n_rows for f in manifest) == links.count() * 60 and len(manifest) > 2
    for day in {f.bucket_date for f in manifest}:
        own = [f for f in manifest if f.bucket_date == day]
        assert all(a.largest <= b.least for a, b in zip(own, own[1:]))
        painted = []
        for f in own:
            folder = f"{path}/map_type={f.map_type}/bucket_date={f.bucket_date}"
            table = spark.read.parquet(f"{folder}/{f.file}").filter("frame = 30").coalesce(1)
            painted += [r.aggregated_result for r in table.collect()]
        assert painted == sorted(painted) and len(painted) == 16


def test_vertex_rows_give_the_geometry_of_the_parts(spark, square_zones):
    vertices = square_zones.select("zone_idx", "zone", "borough", "part", F.posexplode("coords").alias("seq", "p"))
    vertices = vertices.select("zone_idx", "zone", "borough", "part", "seq", "p.x", "p.y")
    columns = zones.zone_geometry(square_zones).columns
    want, got = (sorted(map(tuple, df.select(*columns).collect())) for df in (zones.zone_geometry(square_zones), zones.vertex_geometry(vertices)))
    assert [tuple(map(str, r)) for r in want] == [tuple(map(str, r)) for r in got]
    empty = spark.createDataFrame([(7, "Z8", "North", 0, 0, None, None)], vertices.schema)
    row = zones.vertex_geometry(empty).first()
    assert row.n_vertices == 0 and row.center_x is None and row.lower_y is None
    plan = zones.vertex_geometry(vertices)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "partial_sum" in plan


def test_a_run_without_unknown_zones_drops_nothing(spark, trip_frame, square_zones):
    flow = flows.od_flow(trip_frame([("2018-01-01", 1, 2)]), "2018-01-01", "2018-01-01")
    seen = Observation("nothing")
    assert points.place_links(flow, zones.zone_geometry(square_zones), seen).count() == 1
    assert seen.get == {"n_links": 1, "n_null": 0, "n_unknown": 0, "n_kept": 1}


def scanned_rows(df):
    """Rows that the scan of an executed plan gave out."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    return plan.collectLeaves().head().metrics().get("numOutputRows").get().value()


def test_a_zone_filter_reads_a_fraction_of_the_row_groups(spark, trip_frame, tmp_path):
    one = trip_frame([("2018-01-01", 1, 1)])
    trips = one.drop("PULocationID", "DOLocationID").crossJoin(
        spark.range(60_000).select(
            (F.xxhash64("id") % 131 + 131).cast("int").alias("PULocationID"),
            (F.xxhash64("id", F.lit(1)) % 65 * 4 + 300).cast("int").alias("DOLocationID"),
        )
    )
    plain, sorted_ = str(tmp_path / "plain"), str(tmp_path / "by_zone")
    spark.conf.set("parquet.block.size", str(32 * 1024))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "256k")
    try:
        writers.write_trips(trips, plain)
        writers.write_trips(trips, sorted_, by_zone=True)
    finally:
        spark.conf.unset("parquet.block.size")
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    for condition, share in (("PULocationID = 77", 0.2), ("PULocationID = 77 AND DOLocationID = 301", 0.05)):
        found = [readers.read_trips(spark, p).filter(condition).select("fare_amount") for p in (plain, sorted_)]
        assert found[0].count() == found[1].count()
        assert scanned_rows(found[1]) <= share * 60_000
    assert scanned_rows(readers.read_trips(spark, plain).filter("PULocationID = 77").select("fare_amount")) > 0.5 * 60_000


def test_unknown_maps_raise_an_error(spark, trip_frame, daily_frame, square_zones):
    trips = trip_frame([("2018-01-01", 1, 2)])
    daily = daily_frame([("2018-01-01", 1, 2, 5)])
    table = zones.zone_attributes(square_zones)
    period = ("2018-01-01", "2018-01-02")
    for maps in (("total", "Atlantis"), ("Atlantis",)):
        with pytest.raises(Exception, match="no zone belongs to the map 'Atlantis'"):
            jobs.animation_links(trips, square_zones, *period, maps=maps).collect()
        with pytest.raises(Exception, match="no zone belongs to the map 'Atlantis'"):
            jobs.base_map(square_zones, maps, zoom_on=("North", "borough")).collect()
        with pytest.raises(Exception, match="no zone belongs to the map 'Atlantis'"):
            jobs.choropleth(daily, table, *period, maps=maps).collect()
        with pytest.raises(Exception, match="no zone belongs to the map 'Atlantis'"):
            jobs.choropleth_products(daily, table, *period, maps=maps).collect()
    assert jobs.animation_links(trips, square_zones, *period, maps=("total", "North")).count() == 2
    assert jobs.choropleth(daily, table, *period, maps=("North", "total")).count() == 4
