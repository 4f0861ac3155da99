"""The registered queries: every operator and job on the driver tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from odflow_checks import inputs
from odflow_checks.inputs import BOROUGHS, END, EXCLUDED, START
from odflow import schema as S
from odflow.functions import canvas
from odflow.functions import encoding as E
from odflow.functions.calendar import week_caption, weekday_name
from odflow.operators import adjacency, cleaning, comparison, flows, points, rollup, zones
from odflow.plans import jobs

Query = Callable[[SparkSession, str], DataFrame]

DAY = "1998-03-02"
MONDAY_END = "2001-07-30"
MAPS = (S.TOTAL_MAP, *BOROUGHS)
MARGINS = (40, 60, 80, 20)
CALENDAR = [
    (date(1998, 1, 1), "New Year"),
    (date(1998, 2, 14), "Valentine's Day"),
    (date(1998, 7, 4), "National Day"),
    (date(1998, 12, 25), "Christmas"),
]

QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# Inputs and output helpers -----------------------------------------------


def _clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.clean_trips(inputs.trips(spark, sf_dir), EXCLUDED)


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows.daily_rollup(_clean(spark, sf_dir), START, END)


def _geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zones.zone_geometry(inputs.zone_parts(spark, sf_dir))


def _attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zones.zones_of_lookup(inputs.lookup(spark, sf_dir))


def _projection(geometry: DataFrame) -> DataFrame:
    return zones.projections(zones.map_bounds(geometry, MAPS))


def _round(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n).cast("double"), 6) for n in names})


def _flat_colour(df: DataFrame) -> DataFrame:
    flat = {f"colour_{n}": F.col(f"colour.{n}").cast("double") for n in "bgr"}
    return df.withColumns(flat).drop("colour")


def _calendar(spark: SparkSession) -> DataFrame:
    return flows.special_date_calendar(spark, CALENDAR)


# Preparation ---------------------------------------------------------------


@query
def clean_trips(spark, sf_dir):
    return _clean(spark, sf_dir).select(
        "pickup_date",
        "pickup_weekday",
        "dropoff_date",
        "dropoff_weekday",
        "passenger_count",
        "trip_distance",
        F.col(S.PU).alias("pu_id"),
        F.col(S.DO).alias("do_id"),
        *S.NON_NEGATIVE_AMOUNTS,
        "total_amount",
    )


@query
def clean_violations(spark, sf_dir):
    return cleaning.rule_counts(inputs.trips(spark, sf_dir), EXCLUDED)


@query
def fk_violations(spark, sf_dir):
    known = inputs.lookup(spark, sf_dir).filter(~F.col("LocationID").isin(list(EXCLUDED)))
    unknown = cleaning.unknown_zones(inputs.trips(spark, sf_dir), known)
    return unknown.withColumnRenamed("LocationID", "location_id")


@query
def daily_od_rollup(spark, sf_dir):
    return _daily(spark, sf_dir).withColumnsRenamed({S.PU: "pu_id", S.DO: "do_id"})


# Flows over trips ------------------------------------------------------------


def _flow(**options) -> Query:
    start, end = options.pop("period", (START, END))
    with_lookup = "borough" in options

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        extra = {"lookup": inputs.lookup(spark, sf_dir)} if with_lookup else {}
        return flows.od_flow(_clean(spark, sf_dir), start, end, **options, **extra)

    return run


QUERIES.update(
    {
        "od_day_count": _flow(period=(DAY, DAY)),
        "od_day_avg": _flow(period=(DAY, DAY), agg="avg"),
        "od_period_avg": _flow(agg="avg"),
        "od_each_day": _flow(bucket="day"),
        "od_each_day_weekdays": _flow(bucket="day", weekdays=(0, 1)),
        "od_each_week": _flow(bucket="week"),
        "od_each_week_weekends": _flow(
            bucket="week", weekdays=S.WEEKENDS, time_granularity="specific_weekdays"
        ),
        "od_each_week_monday_end": _flow(bucket="week", period=(START, MONDAY_END)),
        "od_plain_week_monday_end": _flow(
            bucket="week", period=(START, MONDAY_END), merge_trailing_monday=False
        ),
        "od_week_borough": _flow(bucket="week", borough="ASIA"),
        "od_expr_sum": _flow(agg="sum(passenger_count)"),
        "od_ordered_borough": _flow(borough="EUROPE", ordered=True),
    }
)


@query
def od_each_week_of_rollup(spark, sf_dir):
    daily = _daily(spark, sf_dir)
    return flows.od_flow(daily, START, END, bucket="week", agg=flows.TRIPS_OF_ROLLUP)


# Flows over the mergeable rollup -------------------------------------------------


def _state_flow(agg: str, period: tuple[str, str] = (START, END), **options) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        states = rollup.daily_state(_clean(spark, sf_dir), START, END)
        return flows.od_flow(states, *period, agg=rollup.over_state(agg), **options)

    return run


# An aggregate of several parts, as text.
MIXED = "sum(passenger_count) / count(*) + max(passenger_count) - min(passenger_count)"

QUERIES.update(
    {
        "rollup_period_avg": _state_flow("avg"),
        "rollup_day_avg": _state_flow("avg", (DAY, DAY)),
        "rollup_each_week_mixed": _state_flow(MIXED, bucket="week"),
        "rollup_period_distinct": _state_flow("approx_count_distinct(passenger_count)"),
        "rollup_each_day_count": _state_flow("count", bucket="day"),
    }
)


@query
def rollup_of_two_loads(spark, sf_dir):
    """Days that come in two loads, which are added up."""
    clean = _clean(spark, sf_dir)
    loads = (clean.filter(F.col("VendorID") % 2 == k) for k in (0, 1))
    states = rollup.merged_states(*(rollup.daily_state(load, START, END) for load in loads))
    return states.withColumnsRenamed({S.PU: "pu_id", S.DO: "do_id"}).select(
        "pickup_date",
        "pickup_weekday",
        "pu_id",
        "do_id",
        "n_rows",
        "n_trips",
        "total",
        "least",
        "most",
        F.hll_sketch_estimate("values").alias("n_values"),
    )


# Calendar --------------------------------------------------------------------


def _day_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = _clean(spark, sf_dir)
    return clean.groupBy("pickup_date").agg(F.count("*").alias("n_trips"))


def _spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    orders = inputs.table(spark, sf_dir, "orders")
    return flows.date_spine(orders.agg(F.min(day).alias("start"), F.max(day).alias("end")))


@query
def date_spine(spark, sf_dir):
    days, spine = _day_counts(spark, sf_dir), _spine(spark, sf_dir)
    counted = spine.join(days, F.col("day") == F.col("pickup_date"), "left")
    return counted.select(
        "day",
        F.weekday("day").alias("weekday"),
        F.coalesce("n_trips", F.lit(0)).alias("n_trips"),
    )


@query
def week_buckets(spark, sf_dir):
    return flows.bucket_intervals(_spine(spark, sf_dir))


@query
def special_dates(spark, sf_dir):
    days = _day_counts(spark, sf_dir).withColumnRenamed("pickup_date", "bucket_date")
    return flows.with_special_dates(days, _calendar(spark))


@query
def date_captions(spark, sf_dir):
    day = F.col("pickup_date")
    return _day_counts(spark, sf_dir).select(
        day.alias("bucket_date"),
        weekday_name(day).alias("weekday_name"),
        week_caption(day).alias("week_caption"),
        "n_trips",
    )


# Period flows and comparison --------------------------------------------------


def _over_rollup(operator, **options) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        extra = {"lookup": inputs.lookup(spark, sf_dir)} if "borough" in options else {}
        return operator(_daily(spark, sf_dir), START, END, **options, **extra)

    return run


# Aggregates of more than one part, as text.
RATIO = "sum(passenger_count_per_day) / count(*)"
SUM_PLUS_MAX = "sum(passenger_count_per_day) + max(passenger_count_per_day)"
# A month in which some links run on weekdays or weekends only.
MONTH = ("1998-01-01", "1998-01-31")


def _in_month(operator, **options) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return operator(_daily(spark, sf_dir), *MONTH, **options)

    return run


def _period_flow(**options) -> Query:
    return _over_rollup(comparison.period_flow, **options)


def _diff(**options) -> Query:
    return _over_rollup(comparison.weekday_weekend_diff, **options)


QUERIES.update(
    {
        "period_flow_count": _period_flow(),
        "period_flow_avg": _period_flow(agg="avg"),
        "period_flow_sum": _period_flow(agg=flows.TRIPS_OF_ROLLUP),
        "period_flow_borough": _period_flow(agg="avg", borough="ASIA"),
        "wd_we_diff_count": _diff(),
        "wd_we_diff_avg": _diff(agg="avg"),
        "wd_we_diff_sum": _diff(agg=flows.TRIPS_OF_ROLLUP),
        "wd_we_diff_borough": _diff(agg="avg", borough="ASIA"),
        "wd_we_diff_ratio": _diff(agg=RATIO),
        "wd_we_diff_sum_plus_max": _diff(agg=SUM_PLUS_MAX),
        "wd_we_left_join": _diff(how="left"),
        "wd_we_right_join": _diff(how="right"),
        "wd_we_full_join": _diff(how="full"),
        "outer_join_union": _over_rollup(comparison.weekday_weekend_diff_by_union),
        "wd_we_left_join_month": _in_month(comparison.weekday_weekend_diff, how="left"),
        "wd_we_right_join_month": _in_month(comparison.weekday_weekend_diff, how="right"),
        "wd_we_full_join_month": _in_month(comparison.weekday_weekend_diff),
        "outer_join_union_month": _in_month(comparison.weekday_weekend_diff_by_union),
    }
)


# Adjacency and choropleth encoding ---------------------------------------------


def _directed(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily, agg = _daily(spark, sf_dir), flows.TRIPS_OF_ROLLUP
    diff = comparison.weekday_weekend_diff(daily, START, END, agg=agg)
    return adjacency.directed_flows(diff, _attributes(spark, sf_dir), "diff")


@query
def out_adjacency(spark, sf_dir):
    return _directed(spark, sf_dir).filter(F.col("flow_dir") == "out").drop("flow_dir")


@query
def in_adjacency(spark, sf_dir):
    return _directed(spark, sf_dir).filter(F.col("flow_dir") == "in").drop("flow_dir")


@query
def adjacency_lists(spark, sf_dir):
    links = F.transform(
        "links", lambda e: F.concat_ws(":", e["linked_zone"], e["weight"])
    )
    lists = adjacency.adjacency_lists(_directed(spark, sf_dir))
    return lists.withColumn("links", F.array_join(links, ","))


@query
def zone_min_max(spark, sf_dir):
    return adjacency.zone_extremes(_directed(spark, sf_dir))


@query
def focus_flows(spark, sf_dir):
    names = ["NATION_2", "NATION_7", "NATION_11"]
    focus = zones.filter_zones(_attributes(spark, sf_dir), (names, "zone"))
    return adjacency.without_self(adjacency.focus_on(_directed(spark, sf_dir), focus))


@query
def choropleth_colours(spark, sf_dir):
    coloured = adjacency.coloured_flows(_directed(spark, sf_dir))
    return _flat_colour(coloured).drop("linked_zone_name", "zone_name", "borough")


@query
def legend_levels(spark, sf_dir):
    extremes = adjacency.zone_extremes(_directed(spark, sf_dir))
    return _round(_flat_colour(adjacency.legends(extremes)), "level")


# Links with unknown ends ----------------------------------------------------------


UNKNOWN_ZONES = (3, 9, 17)


@query
def known_links(spark, sf_dir):
    """Flows on a zone table that lacks three zones."""
    diff = comparison.weekday_weekend_diff(_daily(spark, sf_dir), START, END, agg=flows.TRIPS_OF_ROLLUP)
    known = _attributes(spark, sf_dir).filter(~F.col("zone_idx").isin(*UNKNOWN_ZONES))
    return adjacency.directed_flows(diff, known, "diff")


def _with_null_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trips of three passengers lose their pickup zone, those of four their dropoff zone."""
    return _clean(spark, sf_dir).withColumns(
        {
            zone: F.when(~F.coalesce(F.col("passenger_count") == n, F.lit(False)), F.col(zone))
            for zone, n in ((S.PU, 3), (S.DO, 4))
        }
    )


@query
def null_zone_links(spark, sf_dir):
    return flows.od_flow(_with_null_ids(spark, sf_dir), START, END)


@query
def null_zone_flows(spark, sf_dir):
    flow = flows.od_flow(_with_null_ids(spark, sf_dir), START, END)
    return adjacency.directed_flows(flow, _attributes(spark, sf_dir))


# Zones and projection --------------------------------------------------------------


@query
def zone_bounds(spark, sf_dir):
    bounds = ["lower_x", "lower_y", "upper_x", "upper_y"]
    return _round(
        _geometry(spark, sf_dir).select("zone_idx", "zone", "borough", *bounds), *bounds
    )


@query
def zone_centroids(spark, sf_dir):
    centre = ["center_x", "center_y"]
    return _round(
        _geometry(spark, sf_dir).select("zone_idx", "n_vertices", *centre), *centre
    )


@query
def vertex_zone_geometry(spark, sf_dir):
    """Bounds and centroids straight from vertex rows."""
    measured = [f"{side}_{axis}" for side in ("lower", "upper", "center") for axis in "xy"]
    return _round(zones.vertex_geometry(inputs.zone_vertices(spark, sf_dir)), *measured)


@query
def vertex_base_map(spark, sf_dir):
    """All vertices on the canvas, row by row."""
    vertices = inputs.zone_vertices(spark, sf_dir)
    maps = ("total", "ASIA")
    projection = zones.projections(zones.map_bounds(zones.vertex_geometry(vertices), maps))
    shapes = zones.project_vertices(
        vertices, projection, maps, filter_on=(["ASIA", "EUROPE"], "borough")
    )
    return _round(shapes, "x", "y").drop("zone", "borough")


@query
def map_bounds(spark, sf_dir):
    bounds = zones.map_bounds(_geometry(spark, sf_dir), MAPS)
    return _round(bounds, "min_x", "min_y", "max_x", "max_y")


@query
def projection_params(spark, sf_dir):
    bounds = zones.map_bounds(_geometry(spark, sf_dir), MAPS)
    params = zones.projections(bounds, margins=MARGINS)
    return _round(
        params, "min_x", "min_y", "max_x", "max_y", "conversion", "shift_x", "shift_y", "floor_y"
    )


@query
def projected_centroids(spark, sf_dir):
    geometry = _geometry(spark, sf_dir)
    projected = zones.project_geometry(geometry, _projection(geometry), MAPS)
    corners = ["lower_x", "lower_y", "upper_x", "upper_y"]
    return _round(projected, "center_x", "center_y", *corners).drop("zone", "borough")


@query
def inverse_projection(spark, sf_dir):
    geometry = _geometry(spark, sf_dir)
    projection = _projection(geometry)
    there = zones.project_geometry(geometry, projection, MAPS).join(projection, "map_type")
    back = there.select(
        "map_type",
        "zone_idx",
        canvas.map_x(F.col("center_x")).alias("x"),
        canvas.map_y(F.col("center_y")).alias("y"),
    )
    return _round(back, "x", "y")


def _vertices(shapes: DataFrame, *columns: str) -> DataFrame:
    rows = shapes.select(*columns, F.posexplode("coords").alias("seq", "p"))
    return rows.select(
        *columns, "seq", *(F.round(f"p.{a}", 6).alias(a) for a in "xy")
    )


@query
def base_map_vertices(spark, sf_dir):
    shapes = jobs.base_map(
        inputs.zone_parts(spark, sf_dir),
        ("total", "ASIA"),
        filter_on=(["ASIA", "EUROPE"], "borough"),
    )
    return _vertices(shapes, "map_type", "zone_idx", "part", "in_outline")


@query
def single_borough_map(spark, sf_dir):
    shapes = jobs.base_map(
        inputs.zone_parts(spark, sf_dir), BOROUGHS, single_borough=True
    )
    return _vertices(shapes, "map_type", "zone_idx", "part")


@query
def zoomed_map_params(spark, sf_dir):
    zoom = (["NATION_3", "NATION_9"], "zone")
    bounds = zones.map_bounds(_geometry(spark, sf_dir), ("total",), zoom)
    return _round(
        zones.projections(bounds).select("map_type", "conversion", "axis_to_center"),
        "conversion",
    )


@query
def zone_attr_filter(spark, sf_dir):
    parts = inputs.zone_parts(spark, sf_dir)
    return zones.filter_zones(parts, (["ASIA", "EUROPE"], "borough")).select(
        "zone_idx", "part", "zone", "borough", F.size("coords").alias("n_vertices")
    )


# Points and frames -------------------------------------------------------------------


def _weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows.od_flow(_clean(spark, sf_dir), START, END, bucket="week")


@query
def global_min_max(spark, sf_dir):
    return points.run_extremes(_weekly(spark, sf_dir))


@query
def point_weights(spark, sf_dir):
    flow = points.with_run_extremes(_weekly(spark, sf_dir))
    result, largest = F.col("aggregated_result"), F.col("max_weight")
    return flow.select(
        "bucket_date",
        "pu_id",
        "do_id",
        E.point_size(result, largest, F.lit("total")).alias("weight_total"),
        E.point_size(result, largest, F.lit("ASIA")).alias("weight_borough"),
    )


@query
def size_legend(spark, sf_dir):
    return points.size_legend(_weekly(spark, sf_dir), ("total", "ASIA"))


@query
def link_class(spark, sf_dir):
    flow = flows.od_flow(_clean(spark, sf_dir), START, END)
    pu, do = F.col("pu_id"), F.col("do_id")
    return _flat_colour(
        flow.select(
            "pu_id",
            "do_id",
            E.to_shape_index(pu).alias("pu_idx"),
            E.to_shape_index(do).alias("do_idx"),
            E.is_self_link(pu, do).alias("is_self"),
            E.link_class(pu, do).alias("link_class"),
            E.link_colour(pu, do).alias("colour"),
        )
    )


@query
def frame_positions(spark, sf_dir):
    geometry = _geometry(spark, sf_dir)
    flow = flows.od_flow(_clean(spark, sf_dir), START, END)
    placed = points.place_links(flow, geometry)
    links = points.map_links(placed, _projection(geometry), ("total",))
    frames = points.frame_positions(links)
    return frames.select("map_type", "frame", "pu_id", "do_id", "x", "y", "weight")


@query
def flow_animation(spark, sf_dir):
    frames = jobs.flow_animation(
        _clean(spark, sf_dir),
        inputs.zone_parts(spark, sf_dir),
        START,
        END,
        maps=("total", "ASIA"),
        bucket="week",
        weekdays=(0, 1),
        borough="ASIA",
        lookup=inputs.lookup(spark, sf_dir),
    )
    return _flat_colour(frames).drop("aggregated_result", "min_weight", "max_weight")


def _animation_preset(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        links = jobs.animation_links(
            _clean(spark, sf_dir),
            inputs.zone_parts(spark, sf_dir),
            START,
            END,
            calendar=_calendar(spark),
            **jobs.animation_presets(BOROUGHS)[name],
        )
        return _round(_flat_colour(links), "pu_x", "pu_y", "do_x", "do_y")

    return run


def _frames_preset(name: str) -> Query:
    """Every frame of a whole run, on six maps, added up per map and frame."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return jobs.animation_totals(
            _clean(spark, sf_dir),
            inputs.zone_parts(spark, sf_dir),
            START,
            END,
            calendar=_calendar(spark),
            **jobs.animation_presets(BOROUGHS)[name],
        )

    return run


for _preset in jobs.animation_presets(()):
    QUERIES[f"preset_{_preset}"] = _animation_preset(_preset)
    QUERIES[f"preset_{_preset}_frames"] = _frames_preset(_preset)


# Choropleth maps ------------------------------------------------------------------------


def _map_output(maps: DataFrame) -> DataFrame:
    return _flat_colour(maps).drop("linked_zone_name", "zone_name", "borough")


def _map_preset(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        options = {**jobs.MAP_PRESETS[name], "label": "all"}
        return _map_output(
            jobs.choropleth(
                _daily(spark, sf_dir), _attributes(spark, sf_dir), START, END, **options
            )
        )

    return run


QUERIES.update({f"preset_{n}": _map_preset(n) for n in jobs.MAP_PRESETS})


def _products(agg: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        products = jobs.choropleth_products(
            _daily(spark, sf_dir),
            _attributes(spark, sf_dir),
            START,
            END,
            agg=agg,
            maps=("total", "ASIA"),
            label="all",
            focus_zones=(["ASIA", "EUROPE"], "borough"),
        )
        return _map_output(products)

    return run


QUERIES["choropleth_products"] = _products("avg")
QUERIES["choropleth_products_ratio"] = _products(RATIO)


@query
def choropleth_legends(spark, sf_dir):
    zone_table = zones.zone_attributes(inputs.zone_parts(spark, sf_dir))
    legends = jobs.choropleth_legends(
        _daily(spark, sf_dir), zone_table, START, END, compare=True
    )
    return _round(_flat_colour(legends), "level")
