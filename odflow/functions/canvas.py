"""Map projection: zone coordinates to canvas coordinates and back.

The expressions read the columns of one projection row per map:
``min_x, min_y, conversion, shift_x, shift_y, floor_y``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def scale(value: Column, lower: Column, conversion: Column) -> Column:
    """Move the map to the origin and scale it to the canvas."""
    return (value - lower) * conversion


def unscale(value: Column, lower: Column, conversion: Column) -> Column:
    """Exact inverse of ``scale``."""
    return value / conversion + lower


def canvas_x(x: Column) -> Column:
    return scale(x, F.col("min_x"), F.col("conversion")) + F.col("shift_x")


def canvas_y(y: Column) -> Column:
    """The y axis points down on a canvas, so the map is mirrored."""
    scaled = scale(y, F.col("min_y"), F.col("conversion")) + F.col("shift_y")
    return F.col("floor_y") - scaled


def map_x(x: Column) -> Column:
    """Inverse of ``canvas_x``."""
    return unscale(x - F.col("shift_x"), F.col("min_x"), F.col("conversion"))


def map_y(y: Column) -> Column:
    """Inverse of ``canvas_y``."""
    return unscale(
        F.col("floor_y") - y - F.col("shift_y"), F.col("min_y"), F.col("conversion")
    )


def position(origin: Column, target: Column, frame: Column, frames: int) -> Column:
    """Whole-number position on the way from origin to target at one frame."""
    step = (target - origin) / F.lit(float(frames - 1))
    return (origin + step * frame).cast("int")
