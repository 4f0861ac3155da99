"""A daily rollup that can be added up: partial aggregates of the trips of a link and day.

A row holds counts, sum, extremes and two sketches of the passenger counts of its trips.
States of the same link and day, from several loads of one day, merge into the state of all
their trips, so a late or split load is added and not counted again. Every aggregate over
trips that ``over_state`` can express is answered from the states, of which there is at most
one row for each link and day, instead of the trips.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odflow import schema as S
from odflow.operators.flows import Day, in_period

KEYS = ["pickup_date", "pickup_weekday", S.PU, S.DO]
MEASURED = "passenger_count"

#: Rows per buffer of the quantile sketch; states of fewer trips are exact.
QUANTILE_K = 200

#: How the columns of states of one link and day merge.
_MERGES = {
    "n_rows": F.sum,
    "n_trips": F.sum,
    "total": F.sum,
    "least": F.min,
    "most": F.max,
    "values": F.hll_union_agg,
    "quantiles": F.kll_merge_agg_bigint,
}

#: Aggregates over trips as aggregates over states.
_OVER_STATE = {
    "count(*)": "sum(n_rows)",
    "count": "sum(n_trips)",
    "sum": "sum(total)",
    "avg": "(sum(total) / nullif(sum(n_trips), 0))",
    "min": "min(least)",
    "max": "max(most)",
    "approx_count_distinct": "hll_sketch_estimate(hll_union_agg(values))",
}
_CALL = re.compile(
    rf"\b(count|sum|avg|min|max|approx_count_distinct)\s*\(\s*({MEASURED}|\*)\s*\)", re.IGNORECASE
)
_PERCENTILE = re.compile(
    rf"\bapprox_percentile\s*\(\s*{MEASURED}\s*,\s*(0?\.[0-9]+|[01](?:\.0*)?)\s*\)", re.IGNORECASE
)
_CONDITION = re.compile(r"\b(filter|over|where|distinct)\b", re.IGNORECASE)


def daily_state(trips: DataFrame, start: Day, end: Day) -> DataFrame:
    """The state of every link and day of a period."""
    value = F.col(MEASURED)
    return (
        in_period(trips, start, end)
        .groupBy(*KEYS)
        .agg(
            F.count("*").alias("n_rows"),
            F.count(value).alias("n_trips"),
            F.sum(value).cast("long").alias("total"),
            F.min(value).alias("least"),
            F.max(value).alias("most"),
            F.hll_sketch_agg(value).alias("values"),
            F.kll_sketch_agg_bigint(value.cast("long"), F.lit(QUANTILE_K)).alias("quantiles"),
        )
    )


def merged(states: DataFrame) -> DataFrame:
    """One state for each link and day from any number of them."""
    return states.groupBy(*KEYS).agg(*(merge(c).alias(c) for c, merge in _MERGES.items()))


def merged_states(*states: DataFrame) -> DataFrame:
    """The states of the trips of several loads together."""
    return merged(reduce(DataFrame.unionByName, states))


def over_state(agg: str) -> str:
    """An aggregate over the trips' passenger counts, as one over states.

    ``agg`` is ``count``, ``avg`` or a SQL expression of ``count``, ``sum``, ``avg``,
    ``min``, ``max``, ``approx_count_distinct`` and ``approx_percentile`` of
    ``passenger_count``, and ``count(*)``. Anything else that needs the trips raises a
    ``ValueError``.
    """
    if agg in ("count", "avg"):
        agg = f"{agg}({MEASURED})"

    def call(found: re.Match) -> str:
        name = found[1].lower()
        if found[2] == "*":
            name = f"{name}(*)"
        if name not in _OVER_STATE:
            raise ValueError(f"{found[0]!r} is no aggregate of passenger counts")
        return _OVER_STATE[name]

    quantile = r"kll_sketch_get_quantile_bigint(kll_merge_agg_bigint(quantiles), \1)"
    # a sketch of no values has no quantiles
    text = _PERCENTILE.sub(rf"(CASE WHEN sum(n_trips) > 0 THEN {quantile} END)", agg)
    text = _CALL.sub(call, text)
    if MEASURED in text.lower() or _CONDITION.search(text) or text == agg:
        raise ValueError(f"{agg!r} cannot be answered from daily states")
    return text


def as_daily(states: DataFrame) -> DataFrame:
    """The rollup of trip counts, which period maps and comparisons take."""
    counts: dict[str, Column] = {c: F.col(c) for c in S.DAILY_SCHEMA.names if c in KEYS}
    counts["passenger_count_per_day"] = F.col("n_trips")
    return states.select(*(counts[c].alias(c) for c in S.DAILY_SCHEMA.names))
