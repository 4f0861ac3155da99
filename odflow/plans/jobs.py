"""Whole runs: trip preparation, flow animation and choropleth maps."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from odflow import schema as S
from odflow.functions.calendar import week_caption, weekday_name
from odflow.operators import adjacency, comparison, flows, points, zones
from odflow.operators.cleaning import clean_trips
from odflow.operators.flows import Day
from odflow.operators.zones import Condition
from odflow.sources import readers, writers


def prepare_trips(
    raw: DataFrame,
    trips_path: str,
    daily_path: str,
    start: Day,
    end: Day,
    *,
    excluded_zones: Iterable[int] = S.EXCLUDED_ZONES,
    layout: str = "day",
    in_date_order: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Clean and store the trips, roll the stored trips up and store the rollup."""
    spark = raw.sparkSession
    writers.write_trips(
        clean_trips(raw, excluded_zones),
        trips_path,
        layout=layout,
        in_date_order=in_date_order,
    )
    trips = readers.read_trips(spark, trips_path, layout)
    daily = flows.daily_rollup(trips, start, end)
    writers.write_daily(daily, daily_path, layout=layout)
    return trips, readers.read_daily(spark, daily_path, layout)


def base_map(
    parts: DataFrame,
    maps: Sequence[str] = (S.TOTAL_MAP,),
    *,
    image_size: Sequence[int] = S.DEFAULT_IMAGE_SIZE,
    margins: Sequence[int] = S.NO_MARGINS,
    zoom_on: Condition | None = None,
    filter_on: Condition | None = None,
    single_borough: bool = False,
) -> DataFrame:
    """Zone polygons on the canvas of every map."""
    bounds = zones.map_bounds(zones.zone_geometry(parts), maps, zoom_on)
    return zones.project_parts(
        parts,
        zones.projections(bounds, image_size, margins),
        maps,
        single_borough=single_borough,
        filter_on=filter_on,
    )


def with_captions(df: DataFrame, bucket: str, calendar: DataFrame | None) -> DataFrame:
    """Caption columns of a date or week.

    Days have their weekday name and, where the calendar names them, a special
    date; weeks have a caption with their first day.
    """
    day = F.col("bucket_date")
    if bucket == "week":
        return df.withColumn("caption", week_caption(day))
    df = df.withColumn("caption", weekday_name(day))
    if calendar is None:
        calendar = flows.special_date_calendar(df.sparkSession)
    return flows.with_special_dates(df, calendar)


def animation_links(
    trips: DataFrame,
    parts: DataFrame,
    start: Day,
    end: Day,
    *,
    maps: Sequence[str] = (S.TOTAL_MAP,),
    bucket: str = "day",
    agg: str | Column = "count",
    weekdays: Iterable[int] | None = None,
    time_granularity: str = "period",
    borough: str | None = None,
    lookup: DataFrame | None = None,
    merge_trailing_monday: bool = True,
    image_size: Sequence[int] = S.DEFAULT_IMAGE_SIZE,
    margins: Sequence[int] = S.NO_MARGINS,
    zoom_on: Condition | None = None,
    calendar: DataFrame | None = None,
    dropped: Observation | None = None,
) -> DataFrame:
    """Links of a flow animation: one row per map, date or week, and link.

    The flow is aggregated once for all maps and dates. Point sizes are scaled to
    the largest flow of the whole run, on every map. ``trips`` may be the daily
    rollup, as ``od_flow`` says. ``dropped`` counts the links with an unknown end.
    """
    if bucket not in ("day", "week"):
        raise ValueError(f"an animation runs per 'day' or 'week', got {bucket!r}")
    flow = flows.od_flow(
        trips,
        start,
        end,
        bucket=bucket,
        agg=agg,
        weekdays=weekdays,
        time_granularity=time_granularity,
        borough=borough,
        lookup=lookup,
        merge_trailing_monday=merge_trailing_monday,
    )
    geometry = zones.zone_geometry(parts)
    bounds = zones.map_bounds(geometry, maps, zoom_on)
    projection = zones.projections(bounds, image_size, margins)
    placed = with_captions(points.place_links(flow, geometry, dropped), bucket, calendar)
    return points.map_links(placed, projection, maps)


def flow_animation(
    trips: DataFrame, parts: DataFrame, start: Day, end: Day, **options: Any
) -> DataFrame:
    """Frames of a flow animation; takes the options of ``animation_links``."""
    return points.frame_positions(
        animation_links(trips, parts, start, end, **options)
    )


def animation_totals(
    trips: DataFrame, parts: DataFrame, start: Day, end: Day, **options: Any
) -> DataFrame:
    """Sums over all points of every map and frame of a whole run."""
    return points.frame_totals(flow_animation(trips, parts, start, end, **options))


def _map_names(maps: Sequence[str] | None, zone_table: DataFrame) -> Column:
    if maps is None:
        return F.array(F.lit(S.TOTAL_MAP), F.col("borough"))
    return zones.known_maps(zone_table, maps)


def map_name(is_diff: Column, label: str) -> Column:
    """Name of one map: area, zone id, zone name, direction, label."""
    map_type = F.col("map_type")
    area = F.when(map_type == S.TOTAL_MAP, S.TOTAL_AREA).otherwise(map_type)
    suffix = F.when(is_diff, f"{label}_{S.DIFF_LABEL}").otherwise(label)
    return F.concat_ws("_", area, F.col("zone"), "zone_name", "flow_dir", suffix)


def _zone_flows(
    od: DataFrame, zone_table: DataFrame, weight: str, focus_zones: Condition | None
) -> DataFrame:
    directed = adjacency.directed_flows(od, zone_table, weight)
    if focus_zones:
        selected = zones.filter_zones(zone_table, focus_zones)
        directed = adjacency.focus_on(directed, selected)
    return directed


def choropleth_flows(
    daily: DataFrame,
    zone_table: DataFrame,
    start: Day,
    end: Day,
    *,
    compare: bool = False,
    agg: str | Column = "count",
    borough: str | None = None,
    lookup: DataFrame | None = None,
    focus_zones: Condition | None = None,
) -> DataFrame:
    """In and out flows per zone behind the maps of one measure.

    ``zone_table`` has one row per zone with its index, name and borough.
    """
    where = {"agg": agg, "borough": borough, "lookup": lookup}
    if compare:
        od, weight = comparison.weekday_weekend_diff(daily, start, end, **where), "diff"
    else:
        od, weight = comparison.period_flow(daily, start, end, **where), "aggregated_result"
    return _zone_flows(od, zone_table, weight, focus_zones)


def _coloured_maps(
    directed: DataFrame,
    zone_table: DataFrame,
    maps: Sequence[str] | None,
    is_diff: Column,
    label: str,
) -> DataFrame:
    coloured = adjacency.coloured_flows(directed)
    names = F.explode(_map_names(maps, zone_table))
    return coloured.withColumn("map_type", names).withColumn(
        "map_name", map_name(is_diff, label)
    )


def choropleth(
    daily: DataFrame,
    zone_table: DataFrame,
    start: Day,
    end: Day,
    *,
    maps: Sequence[str] | None = (S.TOTAL_MAP,),
    compare: bool = False,
    label: str = "2018",
    **options: Any,
) -> DataFrame:
    """Coloured zones of the in and out map of every zone.

    ``compare`` maps weekdays against weekends instead of the period. ``maps=None``
    gives every zone the total map and the map of its own borough. A name that is
    neither the total map nor a borough raises an error as the run goes. Further options
    are those of ``choropleth_flows``.
    """
    directed = choropleth_flows(daily, zone_table, start, end, compare=compare, **options)
    return _coloured_maps(directed, zone_table, maps, F.lit(compare), label)


def choropleth_legends(
    daily: DataFrame, zone_table: DataFrame, start: Day, end: Day, **options: Any
) -> DataFrame:
    """Legend levels of the in and out map of every zone; the same on all maps."""
    directed = choropleth_flows(daily, zone_table, start, end, **options)
    return adjacency.legends(adjacency.zone_extremes(directed))


def choropleth_products(
    daily: DataFrame,
    zone_table: DataFrame,
    start: Day,
    end: Day,
    *,
    maps: Sequence[str] | None = (S.TOTAL_MAP,),
    label: str = "2018",
    focus_zones: Condition | None = None,
    **options: Any,
) -> DataFrame:
    """The four products: in and out flow, over the period and as difference.

    All four come from one aggregation of the rollup.
    """
    od = comparison.period_and_diff(daily, start, end, **options)
    directed = _zone_flows(od, zone_table, "weight", focus_zones)
    return _coloured_maps(directed, zone_table, maps, F.col("measure") == "diff", label)


def animation_presets(boroughs: Sequence[str]) -> dict[str, dict[str, Any]]:
    """Options of the usual animation runs, for the total map and every borough."""
    maps = (S.TOTAL_MAP, *boroughs)
    weekly = {"maps": maps, "bucket": "week", "time_granularity": "specific_weekdays"}
    return {
        "year_daily": {"maps": maps, "bucket": "day"},
        "year_weekdays": {**weekly, "weekdays": S.WEEKDAYS},
        "year_weekends": {**weekly, "weekdays": S.WEEKENDS},
    }


MAP_PRESETS: dict[str, dict[str, Any]] = {
    "period_map": {"maps": None, "compare": False},
    "diff_map": {"maps": None, "compare": True},
}
