from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from odflow.functions import encoding as E


def colour_of(weight, low, high):
    """The colour rule, worked out case by case."""
    if weight == 0:
        return (40, 40, 40)
    if weight > 0:
        share, ends = weight / high, ((40, 40, 100), (100, 100, 255))
    else:
        share, ends = weight / low, ((0, 0, 0), (210, 150, 90))
    return tuple((b - a) * share + a for a, b in zip(*ends))


def levels_of(low, high, n):
    n = min(n, 8)
    if n == 0:
        return []
    if n == 1:
        return [high]
    levels = [high + (low - high) * k / (n - 1) for k in range(n)]
    if min(levels) < 0 < max(levels) and 0 not in levels:
        levels.append(0)
    return sorted(levels)


def test_colours(spark):
    cases = [(0, -10, 10), (5, -10, 10), (10, -10, 10), (-5, -10, 10), (-10, -10, 10)]
    cases += [(3, 3, 3), (-3, -3, -3), (0, 0, 0), (2, 1, 9), (-2, -9, -1), (4, 0, 7)]
    cases = [tuple(map(float, c)) for c in cases]
    df = spark.createDataFrame(cases, "w DOUBLE, lo DOUBLE, hi DOUBLE")
    rows = df.select("*", E.choropleth_colour(F.col("w"), F.col("lo"), F.col("hi")).alias("c"))
    for r in rows.collect():
        assert tuple(r["c"]) == pytest.approx(colour_of(r["w"], r["lo"], r["hi"]))
    known = {(r["w"], r["lo"]): tuple(r["c"]) for r in rows.collect()}
    assert known[(5.0, -10.0)] == pytest.approx((70, 70, 177.5))
    assert known[(-5.0, -10.0)] == pytest.approx((105, 75, 45))
    assert known[(3.0, 3.0)] == pytest.approx((100, 100, 255))


def test_legend_levels(spark):
    cases = [(-10, 10, 4), (2, 8, 1), (2, 8, 0), (0, 7, 9), (-3, 5, 2), (-4, 4, 3), (-9, -1, 12)]
    df = spark.createDataFrame(cases, "lo LONG, hi LONG, n LONG")
    levels = E.legend_levels(F.col("lo"), F.col("hi"), F.col("n"))
    for r in df.withColumn("levels", levels).collect():
        assert r["levels"] == pytest.approx(levels_of(r["lo"], r["hi"], r["n"]))


def test_level_captions_round_ties_to_even(spark):
    values = [1.0, -1.0, 0.0, 2.0, 0.125, 0.375, 1.015, -0.001, 1.004, 12345.678, 0.995, 1e7 / 3]
    df = spark.createDataFrame([(v,) for v in values], "v DOUBLE")
    for r in df.withColumn("caption", E.level_caption(F.col("v"))).collect():
        text = f"{r['v']:.2f}"
        noun = "passenger" if abs(float(text)) in (0, 1) else "passengers"
        assert r["caption"] == f"{text} {noun}"


def test_point_size(spark):
    cases = [(50, 200, "total", 5), (50, 200, "Manhattan", 7), (200, 200, "total", 20)]
    cases += [(200, 200, "Queens", 30), (5, 0, "total", None), (1, 1000, "total", 0)]
    df = spark.createDataFrame(cases, "w LONG, hi LONG, map STRING, size INT")
    size = E.point_size(F.col("w"), F.col("hi"), F.col("map"))
    for r in df.withColumn("got", size).collect():
        assert r["got"] == r["size"]


def test_point_size_truncates_like_int(spark):
    df = spark.range(1, 400).select("id", F.lit(399).alias("hi"), F.lit("total").alias("m"))
    for r in df.withColumn("s", E.point_size(F.col("id"), F.col("hi"), F.col("m"))).collect():
        assert r["s"] == math.trunc(r["id"] / 399 * 20)


def test_link_class_and_ids(spark):
    df = spark.createDataFrame([(1, 1), (1, 2)], "pu INT, do INT")
    pu, do = F.col("pu"), F.col("do")
    rows = df.select(
        E.link_class(pu, do), E.link_colour(pu, do), E.to_shape_index(do),
        E.to_location_id(E.to_shape_index(do)),
    ).collect()
    assert [(r[0], tuple(r[1]), r[2], r[3]) for r in rows] == [
        ("Identical", (141, 91, 67), 0, 1),
        ("Distinct", (135, 162, 34), 1, 2),
    ]
