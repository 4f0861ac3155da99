from __future__ import annotations

import pytest

from odflow.operators.zones import zone_attributes
from odflow.plans import jobs

PERIOD = ("2018-01-01", "2018-01-31")


@pytest.fixture(scope="module")
def zone_table(square_zones):
    return zone_attributes(square_zones)


@pytest.fixture(scope="module")
def daily(daily_frame):
    return daily_frame(
        [
            ("2018-01-01", 1, 2, 5),
            ("2018-01-02", 1, 2, 3),
            ("2018-01-06", 1, 2, 1),
            ("2018-01-06", 2, 3, 4),
            ("2018-01-07", 2, 2, 4),
        ]
    ).cache()


def test_choropleth_on_given_maps(daily, zone_table):
    rows = jobs.choropleth(daily, zone_table, *PERIOD, maps=("total", "South")).collect()
    assert {r["map_type"] for r in rows} == {"total", "South"}
    assert "South_3_Z3_in_2018" in {r["map_name"] for r in rows}
    out = [r for r in rows if r["map_name"] == "NYC_1_Z1_out_2018"]
    assert [(r["linked_zone"], r["weight"]) for r in out] == [(2, 3)]


def test_focus_limits_the_maps(daily, zone_table):
    focused = jobs.choropleth(daily, zone_table, *PERIOD, focus_zones=(["Z1"], "zone"))
    assert {r["zone"] for r in focused.collect()} == {1}
    unfocused = jobs.choropleth(daily, zone_table, *PERIOD, focus_zones=[])
    assert {r["zone"] for r in unfocused.collect()} == {1, 2, 3}


def test_products_equal_the_single_maps(daily, zone_table):
    def rows(df):
        return {
            (r["map_name"], r["linked_zone"]): (
                float(r["weight"]), float(r["min_weight"]), float(r["max_weight"]), r["colour"]
            )
            for r in df.collect()
        }

    single = {}
    for compare in (False, True):
        single |= rows(jobs.choropleth(daily, zone_table, *PERIOD, compare=compare))
    assert rows(jobs.choropleth_products(daily, zone_table, *PERIOD)) == single


def test_legends(daily, zone_table):
    rows = jobs.choropleth_legends(daily, zone_table, *PERIOD, compare=True).collect()
    zone_1 = [r for r in rows if r["flow_dir"] == "out" and r["zone"] == 1]
    assert [(r["level"], r["caption"]) for r in zone_1] == [(1.0, "1.00 passenger")]


def test_presets():
    presets = jobs.animation_presets(["Bronx"])
    assert set(presets) == {"year_daily", "year_weekdays", "year_weekends"}
    assert presets["year_weekends"]["weekdays"] == (5, 6)
    assert presets["year_daily"]["maps"] == ("total", "Bronx")
