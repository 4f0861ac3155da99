"""Moving points: weights, end positions and frames of an animation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from odflow import schema as S
from odflow.functions import canvas
from odflow.functions import encoding as E
from odflow.operators import zones


def run_extremes(flow: DataFrame) -> DataFrame:
    """Smallest and largest flow over all dates of a run: one row."""
    return flow.agg(
        F.min("aggregated_result").alias("min_weight"),
        F.max("aggregated_result").alias("max_weight"),
    )


def with_run_extremes(flow: DataFrame) -> DataFrame:
    """Add the extremes of the run to every flow.

    They come as scalar subqueries, which share the shuffle of ``flow`` and hand
    one value to every task.
    """
    extremes = run_extremes(flow)
    return flow.withColumns(
        {name: extremes.select(name).scalar() for name in extremes.columns}
    )


def size_legend(flow: DataFrame, maps: Sequence[str] = (S.TOTAL_MAP,)) -> DataFrame:
    """Point sizes and captions of the largest and smallest flow, on every map."""
    low, high = F.col("min_weight"), F.col("max_weight")

    def entry(name: str, value: Column, noun: str) -> Column:
        return F.struct(
            F.lit(name).alias("entry"),
            value.alias("value"),
            E.point_size(value, high, F.col("map_type")).alias("size"),
            F.concat(value.cast("string"), F.lit(f" {noun}")).alias("caption"),
        )

    entries = F.array(entry("max", high, "passengers"), entry("min", low, "passenger"))
    return zones.on_maps(run_extremes(flow), maps).select("map_type", F.inline(entries))


def place_links(
    flow: DataFrame, geometry: DataFrame, dropped: Observation | None = None
) -> DataFrame:
    """Flows with the extremes of the run and the centroids of both ends.

    Links with an unknown end are left out, after the extremes of the run were
    taken over all links; ``dropped`` counts them, see ``zones.join_ends``. Dropping missing ids up front, which the joins do anyway,
    keeps the flow the same plan in both, so that its aggregation runs once.
    """

    def centre(end: str) -> DataFrame:
        return geometry.select(
            E.to_location_id(F.col("zone_idx")).alias(f"{end}_id"),
            F.col("center_x").alias(f"{end}_x"),
            F.col("center_y").alias(f"{end}_y"),
        )

    if dropped is None:
        flow = flow.filter(F.col("pu_id").isNotNull() & F.col("do_id").isNotNull())
    return zones.join_ends(with_run_extremes(flow), centre("pu"), centre("do"), dropped)


def map_links(placed: DataFrame, projection: DataFrame, maps: Sequence[str]) -> DataFrame:
    """Placed links on every map: point size, colour, and both ends on the canvas."""
    ends = [f"{end}_{axis}" for end in ("pu", "do") for axis in "xy"]
    pu, do = F.col("pu_id"), F.col("do_id")
    size = E.point_size(
        F.col("aggregated_result"), F.col("max_weight"), F.col("map_type")
    )
    to_canvas = {"x": canvas.canvas_x, "y": canvas.canvas_y}
    return zones.on_canvas(placed, projection, maps).select(
        "map_type",
        *(c for c in placed.columns if c not in ends),
        size.alias("weight"),
        E.is_self_link(pu, do).alias("is_self"),
        E.link_colour(pu, do).alias("colour"),
        *(to_canvas[end[-1]](F.col(end)).alias(end) for end in ends),
    )


def frame_positions(links: DataFrame, frames: int = S.FRAMES_PER_DATE) -> DataFrame:
    """One row per link and frame with the position of its point.

    All that is computed per link stands before the frames are spread out, which
    multiplies the rows without a shuffle.
    """
    frame = F.explode(F.sequence(F.lit(0), F.lit(frames - 1)))
    moving = links.withColumn("frame", frame)
    axes = {
        axis: canvas.position(
            F.col(f"pu_{axis}"), F.col(f"do_{axis}"), F.col("frame"), frames
        )
        for axis in "xy"
    }
    return moving.withColumns(axes).drop("pu_x", "pu_y", "do_x", "do_y")


def frame_totals(frames: DataFrame, *keys: str) -> DataFrame:
    """Exact sums over the points of every map and frame, and of further ``keys``.

    Rows of frames are added up in the task that spreads them out; a row per task, map
    and frame is shuffled.
    """
    return frames.groupBy("map_type", *keys, "frame").agg(
        F.count("*").alias("n_points"),
        *(F.sum(F.col(c).cast("long")).alias(f"sum_{c}") for c in ("x", "y", "weight")),
        F.count_if("is_self").alias("n_self"),
    )
