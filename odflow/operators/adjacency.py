"""Flows seen from each zone: what leaves it and what comes in.

Flows are rows ``flow_dir, zone, linked_zone, weight``; flows of several measures
also carry a ``measure`` column, which then is part of every zone's key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from odflow.functions import encoding as E
from odflow.operators.zones import join_ends


def _focus(flows: DataFrame) -> list[str]:
    return [c for c in ("measure", "flow_dir", "zone") if c in flows.columns]


def _zone_names(zones: DataFrame, end: str) -> DataFrame:
    return zones.select(
        E.to_location_id(F.col("zone_idx")).alias(f"{end}_id"),
        F.col("zone").alias(f"{end}_name"),
        F.col("borough").alias(f"{end}_borough"),
    )


def directed_flows(
    od: DataFrame,
    zones: DataFrame,
    weight: str = "aggregated_result",
    dropped: Observation | None = None,
) -> DataFrame:
    """Every link twice: as ``out`` flow of its origin and ``in`` flow of its target.

    ``zones`` has one row per zone; links with an end it does not know are left
    out, and ``dropped`` counts them, see ``join_ends``. The input is read once for
    both directions.
    """
    sides = [("out", "pu", "do"), ("in", "do", "pu")]
    kept = [c for c in ("measure",) if c in od.columns]
    both = F.array(
        *(
            F.struct(
                F.lit(flow_dir).alias("flow_dir"),
                F.col(f"{zone}_id").alias("zone"),
                F.col(f"{zone}_name").alias("zone_name"),
                F.col(f"{zone}_borough").alias("borough"),
                F.col(f"{linked}_id").alias("linked_zone"),
                F.col(f"{linked}_name").alias("linked_zone_name"),
            )
            for flow_dir, zone, linked in sides
        )
    )
    return (
        join_ends(od, _zone_names(zones, "pu"), _zone_names(zones, "do"), dropped)
        .select(*kept, F.explode(both).alias("flow"), F.col(weight).alias("weight"))
        .select(*kept, "flow.*", "weight")
    )


def adjacency_lists(flows: DataFrame) -> DataFrame:
    """One row per zone and direction with the sorted list of its linked zones.

    A list holds one entry per linked zone, so it is never longer than the number
    of zones in the zone table that ``directed_flows`` joined.
    """
    links = F.collect_list(F.struct("linked_zone", "weight"))
    return flows.groupBy(*_focus(flows)).agg(F.array_sort(links).alias("links"))


def focus_on(flows: DataFrame, focus_zones: DataFrame) -> DataFrame:
    """Only the flows of the selected zones."""
    ids = focus_zones.select(E.to_location_id(F.col("zone_idx")).alias("zone"))
    return flows.join(ids, "zone", "left_semi")


def without_self(flows: DataFrame) -> DataFrame:
    return flows.filter(F.col("linked_zone") != F.col("zone"))


def with_zone_extremes(flows: DataFrame) -> DataFrame:
    """Add the smallest and largest flow of the zone, its self link included.

    A window partition is one zone's links in one direction: one row per linked
    zone, whatever the number of trips behind them.
    """
    links = Window.partitionBy(*_focus(flows))
    return flows.withColumns(
        {
            "min_weight": F.min("weight").over(links),
            "max_weight": F.max("weight").over(links),
        }
    )


def zone_extremes(flows: DataFrame) -> DataFrame:
    """Smallest and largest flow per zone, and how many colours its map shows.

    The self link counts for the extremes but is not coloured. For given extremes
    every weight has its own colour.
    """
    coloured = F.when(F.col("linked_zone") != F.col("zone"), F.col("weight"))
    return flows.groupBy(*_focus(flows)).agg(
        F.min("weight").alias("min_weight"),
        F.max("weight").alias("max_weight"),
        F.count_distinct(coloured).alias("n_colours"),
    )


def coloured_flows(flows: DataFrame) -> DataFrame:
    """Fill colour of every linked zone on the map of its focus zone."""
    colour = E.choropleth_colour(
        F.col("weight"), F.col("min_weight"), F.col("max_weight")
    )
    return without_self(with_zone_extremes(flows)).withColumn("colour", colour)


def legends(extremes: DataFrame) -> DataFrame:
    """One row per legend level of a zone, lowest level first."""
    low, high = F.col("min_weight"), F.col("max_weight")
    levels = E.legend_levels(low, high, F.col("n_colours"))
    return extremes.select("*", F.posexplode(levels).alias("level_no", "level")).withColumns(
        {
            "colour": E.choropleth_colour(F.col("level"), low, high),
            "caption": E.level_caption(F.col("level")),
        }
    )
