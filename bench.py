"""Time the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Every query reads the raw tables and writes its whole result to a sink that drops
it. It runs twice and the second time counts, so that class loading and code
generation stay out of the figures; building the plan is part of them. The
``stored_*`` entries run on trips and rollup prepared once by ``prepare_trips``,
which is timed as well.
"""

from __future__ import annotations

import contextlib
import json
import os
import re
import sys
import tempfile
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from odflow_checks import inputs
from odflow_checks.catalog import QUERIES
from odflow.operators import flows
from odflow.operators.zones import zones_of_lookup
from odflow.plans import jobs

HEADLINE = [
    "clean_trips",
    "daily_od_rollup",
    "od_each_day",
    "od_each_week",
    "od_week_borough",
    "period_flow_avg",
    "wd_we_diff_count",
    "wd_we_diff_avg",
    "outer_join_union",
    "zone_min_max",
    "legend_levels",
    "base_map_vertices",
    "point_weights",
    "frame_positions",
    "flow_animation",
    "preset_year_daily",
    "preset_year_weekdays",
    "preset_year_weekends",
    "preset_period_map",
    "preset_diff_map",
    "choropleth_products",
]


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("odflow-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # small partitions, so that small test data still uses every core
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def drain(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(run: Callable[[], object], warm_up: bool = True) -> float:
    if warm_up:
        run()
    began = time.perf_counter()
    run()
    return round(time.perf_counter() - began, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    seconds = {name: timed(lambda: drain(QUERIES[name](spark, sf_dir))) for name in HEADLINE}

    # an address that all executors share, or else a local folder, as the session is local
    with contextlib.ExitStack() as stack:
        folder = sys.argv[1] if len(sys.argv) > 1 else stack.enter_context(
            tempfile.TemporaryDirectory(prefix="odflow-bench-")
        )
        period = (inputs.START, inputs.END)
        raw = inputs.trips(spark, sf_dir)
        zone_table = zones_of_lookup(inputs.lookup(spark, sf_dir))
        stored: list[DataFrame] = []

        def prepare() -> None:
            paths = f"{folder}/trips", f"{folder}/daily"
            stored.extend(
                jobs.prepare_trips(
                    raw, *paths, *period, excluded_zones=inputs.EXCLUDED, layout="month"
                )
            )

        seconds["prepare_trips"] = timed(prepare, warm_up=False)
        trips, daily = stored
        seconds["stored_od_each_week"] = timed(
            lambda: drain(flows.od_flow(trips, *period, bucket="week"))
        )
        parts = inputs.zone_parts(spark, sf_dir)
        preset = jobs.animation_presets(inputs.BOROUGHS)["year_daily"]
        seconds["stored_year_daily_of_rollup"] = timed(
            lambda: drain(
                jobs.animation_links(daily, parts, *period, agg=flows.TRIPS_OF_ROLLUP, **preset)
            )
        )
        seconds["stored_choropleth_products"] = timed(
            lambda: drain(jobs.choropleth_products(daily, zone_table, *period))
        )

    spark.stop()
    scale = re.search(r"sf([\d.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else None,
            }
        )
    )


if __name__ == "__main__":
    sys.exit(main())
