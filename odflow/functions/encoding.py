"""Point sizes, colours and legend levels as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from odflow import schema as S


def to_shape_index(location_id: Column) -> Column:
    """Zone ids start at 1, polygon rows at 0."""
    return location_id - 1


def to_location_id(shape_index: Column) -> Column:
    return shape_index + 1


def _bgr(colour) -> Column:
    return F.struct(*(F.lit(v).alias(n) for n, v in zip("bgr", colour)))


def point_size(weight: Column, max_weight: Column, map_type: Column) -> Column:
    """Whole-number size of a moving point, scaled to the largest flow of the run.

    Null when the largest flow is zero.
    """
    scale = F.when(map_type == S.TOTAL_MAP, S.MAX_POINT_TOTAL).otherwise(
        S.MAX_POINT_BOROUGH
    )
    return (weight / F.nullif(max_weight, F.lit(0)) * scale).cast("int")


def is_self_link(pu: Column, do: Column) -> Column:
    return pu == do


def link_class(pu: Column, do: Column) -> Column:
    return F.when(is_self_link(pu, do), "Identical").otherwise("Distinct")


def link_colour(pu: Column, do: Column) -> Column:
    return F.when(is_self_link(pu, do), _bgr(S.SELF_LINK_COLOUR)).otherwise(
        _bgr(S.DISTINCT_LINK_COLOUR)
    )


def choropleth_colour(
    weight: Column, min_weight: Column, max_weight: Column
) -> Column:
    """Fill colour of a flow between ``min_weight`` and ``max_weight``.

    Positive flows run through shades of red by their share of the maximum,
    negative ones through shades of blue by their share of the minimum, and no
    flow is grey. When minimum and maximum are equal that share is one.
    """

    def shade(name: str, low: float, high: float, share: Column) -> Column:
        return ((high - low) * share + low).cast("double").alias(name)

    def ramp(low, high, bound: Column) -> Column:
        share = weight / F.nullif(bound, F.lit(0))
        return F.struct(*(shade(n, a, b, share) for n, a, b in zip("bgr", low, high)))

    grey = F.struct(
        *(F.lit(float(v)).alias(n) for n, v in zip("bgr", S.NO_FLOW_COLOUR))
    )
    return (
        F.when(weight == 0, grey)
        .when(weight > 0, ramp(S.POSITIVE_LOW_COLOUR, S.POSITIVE_HIGH_COLOUR, max_weight))
        .when(weight < 0, ramp(S.NEGATIVE_LOW_COLOUR, S.NEGATIVE_HIGH_COLOUR, min_weight))
    )


def legend_levels(
    min_weight: Column, max_weight: Column, n_colours: Column
) -> Column:
    """Sorted array of the levels a legend shows.

    As many evenly spaced levels as colours were used, eight at most, plus a
    zero level where the levels cross zero without touching it. One colour
    gives the maximum alone, no colour an empty array.
    """
    low, high = min_weight.cast("double"), max_weight.cast("double")
    n = F.least(n_colours, F.lit(S.MAX_LEGEND_LEVELS)).cast("int")
    spaced = F.transform(
        F.sequence(F.lit(0), F.greatest(n, F.lit(2)) - 1),
        lambda k: high + (low - high) * k / (F.greatest(n, F.lit(2)) - 1),
    )
    levels = (
        F.when(n <= 0, F.array().cast("array<double>"))
        .when(n == 1, F.array(high))
        .otherwise(spaced)
    )
    crosses_zero = (
        F.exists(levels, lambda v: v < 0)
        & F.exists(levels, lambda v: v > 0)
        & ~F.exists(levels, lambda v: v == 0)
    )
    return F.array_sort(
        F.when(crosses_zero, F.concat(levels, F.array(F.lit(0.0)))).otherwise(levels)
    )


def level_caption(level: Column) -> Column:
    """``"1.00 passenger"``, ``"2.00 passengers"``: two decimals, ties to even."""
    text = F.call_function("format_number", level, F.lit("0.00"))
    shown = F.abs(text.cast("double"))
    return F.concat(text, F.when(shown.isin(0.0, 1.0), " passenger").otherwise(" passengers"))
