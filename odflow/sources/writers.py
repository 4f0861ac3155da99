"""Parquet writers.

They ask for a rebalance instead of a plain repartition on the partition columns:
small partitions are merged and one that holds a large share of the rows is split
over several tasks and files.

Without a load's name a write replaces the partitions it has rows for: with the layout
``day`` single days, with ``month`` whole months. With one, every load has a folder of its own
with its days or months. A late or partial load then adds to the days it shares with others,
and the same load written again replaces itself as a whole, so that a repeat, or a retry after
a failure half way, adds nothing. A path holds named loads or unnamed ones, not both.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from odflow import schema as S
from odflow.operators import rollup
from odflow.operators.points import frame_positions


_LOAD_NAME = f"{string.ascii_letters}{string.digits}-_"


def _write(df: DataFrame, path: str, *partition_columns: str, **options: str) -> None:
    """Replace the partitions that ``df`` has rows for; others at the path stay."""
    writer = df.write.mode("overwrite").options(partitionOverwriteMode="dynamic", **options)
    writer.partitionBy(*partition_columns).parquet(path)


def _with_layout(df: DataFrame, layout: str) -> DataFrame:
    if layout == "month":
        df = df.withColumn(S.LAYOUTS[layout], F.trunc("pickup_date", "month"))
    return df


def _write_load(df: DataFrame, path: str, load: str | None, column: str, **options: str) -> None:
    """The whole of a load, or without a name the partitions that ``df`` has rows for."""
    if load is None:
        return _write(df, path, column, **options)
    if not load or not set(load) <= set(_LOAD_NAME):
        raise ValueError(f"a load's name is letters, digits, '-' and '_', got {load!r}")
    writer = df.write.mode("overwrite").options(partitionOverwriteMode="static", **options)
    writer.partitionBy(column).parquet(f"{path.rstrip('/')}/{S.LOAD}={load}")


def write_trips(
    trips: DataFrame,
    path: str,
    *,
    layout: str = "day",
    in_date_order: bool = False,
    by_zone: bool = False,
    load: str | None = None,
) -> None:
    """Trips laid out by pickup date, which takes the place of date indexes.

    The layout ``day`` makes one directory per date and suits days of gigabytes,
    ``month`` suits less. Files that are already ``in_date_order`` are written
    without a shuffle, as every task then meets few dates.

    ``by_zone`` adds a second access path: trips are dealt and sorted by date and pickup
    zone, so that files and row groups hold few pickup zones, and carry bloom filters of
    dropoff zone and dropoff date. A filter on any of them skips most row groups.
    """
    column = S.LAYOUTS[layout]
    trips = _with_layout(trips.select(*S.TRIP_SCHEMA.names), layout)
    options = {}
    if by_zone:
        order = [column, S.PU, S.DO, "dropoff_date"]
        trips = trips.repartitionByRange(*order).sortWithinPartitions(*order)
        for name in (S.DO, "dropoff_date"):
            options[f"parquet.bloom.filter.enabled#{name}"] = "true"
    elif not in_date_order:
        trips = trips.hint("rebalance", column)
    _write_load(trips, path, load, column, **options)


def write_daily(daily: DataFrame, path: str, *, layout: str = "day") -> None:
    """The daily rollup, laid out by pickup date."""
    column = S.LAYOUTS[layout]
    daily = _with_layout(daily.select(*S.DAILY_SCHEMA.names), layout)
    _write(daily.hint("rebalance", column), path, column)


def write_states(states: DataFrame, path: str, load: str, *, layout: str = "day") -> None:
    """The mergeable rollup of one load; ``read_states`` adds the loads up."""
    column = S.LAYOUTS[layout]
    states = _with_layout(rollup.merged(states).select(*S.STATE_SCHEMA.names), layout)
    _write_load(states.hint("rebalance", column), path, load, column)


def write_animation(links: DataFrame, path: str, *, in_paint_order: bool = False) -> None:
    """All frames of animation links, one directory per map and date.

    The links are rebalanced and spread out over the frames behind that shuffle, so
    it moves one row per link and not one per frame.

    ``in_paint_order`` deals the links by ranges of map, date and flow and sorts every
    range, so that a date's files, by name, and the rows in them hold small flows
    first, as they are painted; a large date still takes several files.
    ``paint_manifest`` lists them.
    """
    keys = ["map_type", "bucket_date"]
    if in_paint_order:
        order = [*keys, "aggregated_result", "pu_id", "do_id"]
        links = links.repartitionByRange(*order).sortWithinPartitions(*order)
    else:
        links = links.hint("rebalance", *keys)
    _write(frame_positions(links), path, *keys)


def paint_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The files of a stored animation: map, date, place in paint order, rows, least and largest flow."""
    files = (
        spark.read.parquet(path)
        .groupBy("map_type", "bucket_date", F.col("_metadata.file_name").alias("file"))
        .agg(
            F.count("*").alias("n_rows"),
            F.min("aggregated_result").alias("least"),
            F.max("aggregated_result").alias("largest"),
        )
    )
    of_date = Window.partitionBy("map_type", "bucket_date").orderBy("file")  # a row per file
    return files.withColumn("place", F.row_number().over(of_date) - 1)


def write_choropleth(products: DataFrame, path: str) -> None:
    """Choropleth rows, one directory per map and flow direction."""
    keys = ["map_type", "flow_dir"]
    _write(products.hint("rebalance", *keys), path, *keys)
