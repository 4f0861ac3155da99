from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from odflow.operators import adjacency as A
from odflow.operators import zones


@pytest.fixture(scope="module")
def od(spark):
    rows = [(1, 1, 9), (1, 2, 4), (1, 3, 4), (2, 1, -2), (3, 2, 0), (1, 99, 50), (99, 1, 50)]
    return spark.createDataFrame(rows, "pu_id INT, do_id INT, aggregated_result LONG")


@pytest.fixture(scope="module")
def directed(od, square_zones):
    return A.directed_flows(od, zones.zone_geometry(square_zones))


def test_both_directions_without_unknown_zones(directed):
    rows = {(r["flow_dir"], r["zone"], r["linked_zone"]): r["weight"] for r in directed.collect()}
    links = {(1, 1): 9, (1, 2): 4, (1, 3): 4, (2, 1): -2, (3, 2): 0}
    assert rows == {("out", a, b): w for (a, b), w in links.items()} | {
        ("in", b, a): w for (a, b), w in links.items()
    }


def test_totals_are_equal_in_both_directions(directed):
    sums = {r[0]: r[1] for r in directed.groupBy("flow_dir").agg(F.sum("weight")).collect()}
    assert sums["in"] == sums["out"]


def test_names(directed):
    row = directed.filter("flow_dir = 'in' AND zone = 2 AND linked_zone = 3").first()
    assert (row["zone_name"], row["borough"], row["linked_zone_name"]) == ("Z2", "North", "Z3")


def test_lists(directed):
    rows = {(r["flow_dir"], r["zone"]): r["links"] for r in A.adjacency_lists(directed).collect()}
    assert [tuple(e) for e in rows[("out", 1)]] == [(1, 9), (2, 4), (3, 4)]
    assert [tuple(e) for e in rows[("in", 2)]] == [(1, 4), (3, 0)]


def test_extremes_count_the_self_link_but_colours_do_not(directed):
    rows = {(r["flow_dir"], r["zone"]): r for r in A.zone_extremes(directed).collect()}
    out = rows[("out", 1)]
    assert (out["min_weight"], out["max_weight"], out["n_colours"]) == (4, 9, 1)
    same = A.with_zone_extremes(directed).filter("flow_dir = 'out' AND zone = 1").first()
    assert (same["min_weight"], same["max_weight"]) == (4, 9)


def test_colours_leave_out_the_self_link(directed):
    rows = A.coloured_flows(directed).filter("flow_dir = 'out' AND zone = 1").collect()
    assert {r["linked_zone"] for r in rows} == {2, 3}
    assert rows[0]["colour"]["r"] == pytest.approx(100 + 155 * 4 / 9)


def test_focus(directed, square_zones):
    focus = zones.filter_zones(zones.zone_geometry(square_zones), (["Z3"], "zone"))
    assert {r["zone"] for r in A.focus_on(directed, focus).collect()} == {3}


def test_legends(directed):
    rows = A.legends(A.zone_extremes(directed)).filter("flow_dir = 'in' AND zone = 1").collect()
    # flows 9 (self) and -2 into zone 1: one colour, so the maximum alone
    levels = [(r["level_no"], r["level"], r["caption"]) for r in rows]
    assert levels == [(0, 9.0, "9.00 passengers")]


def test_only_a_self_link_has_no_legend(spark, square_zones):
    od = spark.createDataFrame([(4, 4, 3)], "pu_id INT, do_id INT, aggregated_result LONG")
    flows = A.directed_flows(od, zones.zone_geometry(square_zones))
    assert A.legends(A.zone_extremes(flows)).count() == 0
    assert A.coloured_flows(flows).count() == 0
