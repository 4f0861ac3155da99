"""Zone polygons: selection, geometry and projection onto a canvas.

Polygons come as one row per part (``zone_idx, part, zone, borough, coords``).
Vertices of a part are folded with array functions inside the row; only one small
row of sums and bounds per part goes through the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from odflow import schema as S
from odflow.functions import canvas
from odflow.functions import encoding as E

Condition = tuple[str | list[str], str]


def matches(zones: DataFrame, condition: Condition) -> Column:
    """Condition (value or list of values, attribute) as a filter on zones."""
    values, attribute = condition
    if attribute not in zones.columns:
        raise ValueError(f"zones have no attribute {attribute!r}: {zones.columns}")
    values = [values] if isinstance(values, str) else list(values)
    return F.coalesce(F.col(attribute).isin(values), F.lit(False))


def filter_zones(zones: DataFrame, condition: Condition) -> DataFrame:
    return zones.filter(matches(zones, condition))


def zone_attributes(parts: DataFrame) -> DataFrame:
    """One row per zone: its index, name and borough."""
    return parts.select("zone_idx", "zone", "borough").distinct()


def zones_of_lookup(lookup: DataFrame) -> DataFrame:
    """The same from the zone lookup, for jobs that need no polygons."""
    return lookup.select(
        E.to_shape_index(F.col("LocationID")).alias("zone_idx"),
        "zone",
        F.col("borough_name").alias("borough"),
    )


def zone_geometry(parts: DataFrame) -> DataFrame:
    """One row per zone: centroid (mean of all vertices) and bounds.

    A zone without vertices has neither.
    """

    def total(axis: str) -> Column:
        return F.aggregate("coords", F.lit(0.0), lambda acc, p: acc + p[axis])

    def axis_values(axis: str) -> Column:
        return F.transform("coords", lambda p: p[axis])

    per_part = parts.select(
        "zone_idx",
        "zone",
        "borough",
        F.size("coords").alias("n"),
        *(total(a).alias(f"sum_{a}") for a in "xy"),
        *(F.array_min(axis_values(a)).alias(f"low_{a}") for a in "xy"),
        *(F.array_max(axis_values(a)).alias(f"high_{a}") for a in "xy"),
    )
    vertices = F.sum("n")
    return per_part.groupBy("zone_idx", "zone", "borough").agg(
        vertices.alias("n_vertices"),
        *(
            (F.sum(f"sum_{a}") / F.nullif(vertices, F.lit(0))).alias(f"center_{a}")
            for a in "xy"
        ),
        *(F.min(f"low_{a}").alias(f"lower_{a}") for a in "xy"),
        *(F.max(f"high_{a}").alias(f"upper_{a}") for a in "xy"),
    )


def vertex_geometry(vertices: DataFrame) -> DataFrame:
    """The same from a vertex table (zone_idx, zone, borough, part, seq, x, y).

    Vertices are added up where they lie and one row per task and zone is shuffled, so
    a ring may have any number of vertices and is never put together.
    """
    vertex = F.col("x").isNotNull() & F.col("y").isNotNull()
    axis = {a: F.when(vertex, F.col(a)) for a in "xy"}
    n_vertices = F.count_if(vertex)
    return vertices.groupBy("zone_idx", "zone", "borough").agg(
        n_vertices.alias("n_vertices"),
        *((F.sum(axis[a]) / F.nullif(n_vertices, F.lit(0))).alias(f"center_{a}") for a in "xy"),
        *(F.min(axis[a]).alias(f"lower_{a}") for a in "xy"),
        *(F.max(axis[a]).alias(f"upper_{a}") for a in "xy"),
    )


def on_maps(df: DataFrame, maps: Sequence[str]) -> DataFrame:
    """Repeat rows for every map asked for."""
    names = F.array(*map(F.lit, dict.fromkeys(maps)))
    return df.withColumn("map_type", F.explode(names))


def _on_own_map() -> Column:
    return (F.col("map_type") == S.TOTAL_MAP) | (F.col("borough") == F.col("map_type"))


def map_bounds(
    geometry: DataFrame, maps: Sequence[str], zoom_on: Condition | None = None
) -> DataFrame:
    """Extremes of the zones each map is centred on.

    That is all zones for the total map and the zones of the borough for a borough
    map, unless ``zoom_on`` selects the zones for all of them. A map that is neither
    the total map nor named after a borough of a zone raises an error as the run goes.
    """
    zones = on_maps(geometry, maps)
    chosen = matches(zones, zoom_on) if zoom_on else F.coalesce(_on_own_map(), F.lit(False))
    found = zones.groupBy("map_type").agg(
        *(F.min(F.when(chosen, F.col(f"lower_{a}"))).alias(f"min_{a}") for a in "xy"),
        *(F.max(F.when(chosen, F.col(f"upper_{a}"))).alias(f"max_{a}") for a in "xy"),
        F.count_if(_on_own_map()).alias("n_own"),
        F.count_if(chosen).alias("n_chosen"),
    )
    checked = _checked_map(F.col("n_own") > 0)
    bounds = [f"{side}_{a}" for side in ("min", "max") for a in "xy"]
    return found.filter("n_chosen > 0 OR n_own = 0").select(checked.alias("map_type"), *bounds)


def _checked_map(known: Column) -> Column:
    """The map's name, or an error where no zone belongs to it."""
    message = F.format_string("no zone belongs to the map '%s'", F.col("map_type"))
    return F.when(known, F.col("map_type")).otherwise(F.raise_error(message))


def known_maps(zone_table: DataFrame, maps: Sequence[str]) -> Column:
    """The names of maps as one array, checked against the zones by the rule of ``map_bounds``.

    It is a scalar subquery over the zone table, or a plain value if only the total map is
    asked for.
    """
    names = list(dict.fromkeys(maps))
    if names == [S.TOTAL_MAP]:
        return F.array(F.lit(S.TOTAL_MAP))
    own = [(F.count_if(F.col("borough") == name) > 0).alias(f"known_{i}") for i, name in enumerate(names)]
    entries = [
        F.struct(F.lit(name).alias("map_type"), (F.lit(True) if name == S.TOTAL_MAP else F.col(f"known_{i}")).alias("known"))
        for i, name in enumerate(names)
    ]
    rows = zone_table.agg(*own).select(F.inline(F.array(*entries)))
    return rows.agg(F.collect_list(_checked_map(F.col("known")))).scalar()


def projections(
    bounds: DataFrame,
    image_size: Sequence[int] = S.DEFAULT_IMAGE_SIZE,
    margins: Sequence[int] = S.NO_MARGINS,
) -> DataFrame:
    """Projection of each map: scale to fit one axis, centre on the other.

    ``margins`` are top, right, bottom and left. They shrink the area the map is
    fitted to; top and left do not move it.
    """
    top, right, bottom, left = margins or S.NO_MARGINS
    width = image_size[0] - right - left
    floor_y = image_size[1] - bottom
    height = floor_y - top
    ratio_x = (F.col("max_x") - F.col("min_x")) / width
    ratio_y = (F.col("max_y") - F.col("min_y")) / height
    wide = ratio_x > ratio_y
    ratio = F.when(wide, ratio_x).otherwise(ratio_y)

    def shift(axis: str, room: int) -> Column:
        extent = canvas.scale(
            F.col(f"max_{axis}"), F.col(f"min_{axis}"), F.col("conversion")
        )
        return F.when(F.col("axis_to_center") == axis, (room - extent) / 2).otherwise(0.0)

    return (
        bounds.withColumns(
            {
                "conversion": 1 / F.nullif(ratio, F.lit(0.0)),
                "axis_to_center": F.when(wide, "y").otherwise("x"),
            }
        )
        .withColumns({"shift_x": shift("x", width), "shift_y": shift("y", height)})
        .withColumn("floor_y", F.lit(float(floor_y)))
    )


_PROJECTION = ["map_type", "min_x", "min_y", "conversion", "shift_x", "shift_y", "floor_y"]


def on_canvas(df: DataFrame, projection: DataFrame, maps: Sequence[str]) -> DataFrame:
    """Repeat rows for every map and add the map's projection columns.

    A projection is one row per map of an argument list, so broadcasting it is
    bounded by that list; a shuffle would put all rows of a map in one task.
    """
    rows = projection.select(*_PROJECTION)
    return on_maps(df, maps).join(F.broadcast(rows), "map_type")


def project_geometry(
    geometry: DataFrame, projection: DataFrame, maps: Sequence[str]
) -> DataFrame:
    """Centroid and bounds of every zone on every map.

    The projection scales, moves and mirrors, so projecting the centroid and the
    bounds gives the same as recomputing them from projected vertices; mirroring
    swaps the lower and upper y.
    """
    x, y = canvas.canvas_x, canvas.canvas_y
    return on_canvas(geometry, projection, maps).select(
        "map_type",
        "zone_idx",
        "zone",
        "borough",
        x(F.col("center_x")).alias("center_x"),
        y(F.col("center_y")).alias("center_y"),
        x(F.col("lower_x")).alias("lower_x"),
        y(F.col("upper_y")).alias("lower_y"),
        x(F.col("upper_x")).alias("upper_x"),
        y(F.col("lower_y")).alias("upper_y"),
    )


def project_parts(
    parts: DataFrame,
    projection: DataFrame,
    maps: Sequence[str],
    *,
    single_borough: bool = False,
    filter_on: Condition | None = None,
) -> DataFrame:
    """Base map: all vertices on the canvas of every map, vertex order kept.

    ``single_borough`` keeps only a borough map's own zones. ``in_outline`` tells
    which zones have their outline drawn; ``filter_on`` limits it without leaving
    out any zone.
    """
    shapes = on_canvas(parts, projection, maps)
    if single_borough:
        shapes = shapes.filter(_on_own_map())
    outlined = matches(parts, filter_on) if filter_on else F.lit(True)
    vertices = F.transform(
        "coords",
        lambda p: F.struct(
            canvas.canvas_x(p["x"]).alias("x"), canvas.canvas_y(p["y"]).alias("y")
        ),
    )
    return shapes.select(
        "map_type",
        "zone_idx",
        "part",
        "zone",
        "borough",
        vertices.alias("coords"),
        outlined.alias("in_outline"),
    )


def project_vertices(
    vertices: DataFrame,
    projection: DataFrame,
    maps: Sequence[str],
    *,
    single_borough: bool = False,
    filter_on: Condition | None = None,
) -> DataFrame:
    """Base map as rows per vertex: ``project_parts`` of a vertex table, without any shuffle."""
    shapes = on_canvas(vertices, projection, maps)
    if single_borough:
        shapes = shapes.filter(_on_own_map())
    outlined = matches(vertices, filter_on) if filter_on else F.lit(True)
    return shapes.select(
        "map_type",
        "zone_idx",
        "part",
        "seq",
        "zone",
        "borough",
        canvas.canvas_x(F.col("x")).alias("x"),
        canvas.canvas_y(F.col("y")).alias("y"),
        outlined.alias("in_outline"),
    )


def join_ends(
    links: DataFrame, pu: DataFrame, do: DataFrame, dropped: Observation | None = None
) -> DataFrame:
    """Links with what ``pu`` and ``do`` know of their ends; links with an unknown end are left out.

    ``dropped`` counts them as the run goes, without another pass over the links:
    ``n_links`` seen, ``n_null`` with a missing id, ``n_unknown`` with an id that is not
    known, ``n_kept``. It is filled once the result was written or collected.
    """
    if dropped is None:
        return links.join(pu, "pu_id").join(do, "do_id")
    marked = links.join(pu.withColumn("_pu_known", F.lit(True)), "pu_id", "left")
    marked = marked.join(do.withColumn("_do_known", F.lit(True)), "do_id", "left")
    known = F.col("_pu_known").isNotNull() & F.col("_do_known").isNotNull()
    missing = F.col("pu_id").isNull() | F.col("do_id").isNull()
    counted = marked.observe(
        dropped,
        F.count("*").alias("n_links"),
        F.count_if(missing).alias("n_null"),
        F.count_if(~missing & ~known).alias("n_unknown"),
        F.count_if(known).alias("n_kept"),
    )
    return counted.filter(known).drop("_pu_known", "_do_known")
