"""The registered queries as SQL over the driver tables."""

from __future__ import annotations

from odflow_checks.catalog import CALENDAR, DAY, MAPS, MARGINS, MONDAY_END
from odflow_checks.inputs import BOROUGHS, END, EXCLUDED, START

SPAN = f"BETWEEN DATE '{START}' AND DATE '{END}'"

# Common table expressions, put in front of a statement by name -----------------

CTES: dict[str, tuple[str, tuple[str, ...]]] = {}


def _cte(name: str, sql: str, *needs: str) -> None:
    CTES[name] = (sql, needs)


def _with(sql: str, *names: str) -> str:
    ordered: dict[str, str] = {}

    def add(name: str) -> None:
        text, needs = CTES[name]
        for need in needs:
            add(need)
        ordered.setdefault(name, text)

    for name in names:
        add(name)
    head = ",\n".join(f"{n} AS ({t})" for n, t in ordered.items())
    return f"WITH {head}\n{sql}"


_cte(
    "trips",
    """
    SELECT cast(o_orderdate AS date) AS pickup_date,
           cast(isodow(o_orderdate) - 1 AS int) AS pickup_weekday,
           cast(l_shipdate AS date) AS dropoff_date,
           cast(isodow(l_shipdate) - 1 AS int) AS dropoff_weekday,
           CASE WHEN l_linenumber = 7 THEN NULL
                ELSE cast(round(l_discount * 100) AS int) END AS passenger_count,
           l_quantity AS trip_distance,
           s_nationkey + 1 AS pu_id, c_nationkey + 1 AS do_id,
           l_extendedprice AS fare_amount, l_tax AS extra,
           cast(0.5 AS double) AS mta_tax,
           s_acctbal AS tip_amount, c_acctbal AS tolls_amount,
           cast(0.3 AS double) AS improvement_surcharge,
           o_totalprice AS total_amount
    FROM lineitem
    JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey
    JOIN supplier ON l_suppkey = s_suppkey""",
)

RULES = {
    "pickup_zone": f"pu_id IN {EXCLUDED}",
    "dropoff_zone": f"do_id IN {EXCLUDED}",
    "passenger_count": "passenger_count = 0",
    "pickup_time": "pickup_date IS NULL",
    "dropoff_time": "dropoff_date IS NULL",
    "fare_amount": "fare_amount < 0",
    "extra": "extra < 0",
    "mta_tax": "mta_tax < 0",
    "tip_amount": "tip_amount < 0",
    "tolls_amount": "tolls_amount < 0",
    "improvement_surcharge": "improvement_surcharge < 0",
}

_cte(
    "clean",
    f"SELECT * FROM trips WHERE NOT coalesce({' OR '.join(RULES.values())}, false)",
    "trips",
)
_cte(
    "daily",
    f"""
    SELECT pickup_date, pickup_weekday, count(passenger_count) AS passenger_count_per_day,
           pu_id, do_id
    FROM clean WHERE pickup_date {SPAN}
    GROUP BY pu_id, do_id, pickup_date, pickup_weekday""",
    "clean",
)
_cte(
    "lookup",
    """
    SELECT n_nationkey + 1 AS location_id, n_nationkey AS zone_idx,
           n_name AS zone, r_name AS borough
    FROM nation JOIN region ON n_regionkey = r_regionkey""",
)
_cte(
    "day_counts",
    "SELECT pickup_date, count(*) AS n_trips FROM clean GROUP BY pickup_date",
    "clean",
)


_cte(
    "span",
    """
    SELECT cast(min(o_orderdate) AS date) AS lo, cast(max(o_orderdate) AS date) AS hi
    FROM orders""",
)


# Week buckets as an explicit interval table: the start of the period and every
# Monday strictly inside it (or up to its end) open a bucket.
def _intervals(start: str, end: str, last_monday: str = "<", source: str = "") -> str:
    days = f"SELECT {start} AS lo, {end} AS hi {source}"
    return f"""
    SELECT first_day,
           coalesce(lead(first_day) OVER (ORDER BY first_day) - 1, hi) AS last_day
    FROM (SELECT DISTINCT cast(d AS date) AS first_day, hi
          FROM (SELECT lo, hi, unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS d
                FROM ({days}))
          WHERE d = lo OR (isodow(d) = 1 AND d {last_monday} hi))"""


_cte("weeks", _intervals(f"DATE '{START}'", f"DATE '{END}'"))
_cte("weeks_monday_end", _intervals(f"DATE '{START}'", f"DATE '{MONDAY_END}'"))
_cte("weeks_plain", _intervals(f"DATE '{START}'", f"DATE '{MONDAY_END}'", "<="))

_cte(
    "weekly",
    """
    SELECT first_day AS bucket_date, pu_id, do_id,
           count(passenger_count) AS aggregated_result
    FROM clean JOIN weeks ON pickup_date BETWEEN first_day AND last_day
    GROUP BY first_day, pu_id, do_id""",
    "clean",
    "weeks",
)

# Polygons
_cte(
    "vertices",
    """
    SELECT cast(vec_id % 25 AS int) AS zone_idx, vec_id AS part, cast(i AS int) AS seq,
           cast(embedding[2 * i + 1] AS double) AS x,
           cast(embedding[2 * i + 2] AS double) AS y
    FROM (SELECT vec_id, embedding, unnest(range(len(embedding) // 2)) AS i
          FROM embeddings)""",
)
_cte(
    "polygons",
    "SELECT v.*, zone, borough FROM vertices v JOIN lookup USING (zone_idx)",
    "vertices",
    "lookup",
)
_cte("maps", f"SELECT unnest({list(MAPS)}) AS map_type")
_cte(
    "bounds",
    """
    SELECT map_type, min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y
    FROM polygons JOIN maps ON map_type = 'total' OR map_type = borough
    GROUP BY map_type""",
    "polygons",
    "maps",
)


def _projection(bounds: str, margins=(0, 0, 0, 0)) -> str:
    top, right, bottom, left = margins
    width, height = 1920 - right - left, 1080 - bottom - top
    return f"""
    SELECT *,
           CASE WHEN axis_to_center = 'x'
                THEN ({width} - (max_x - min_x) * conversion) / 2 ELSE 0.0 END AS shift_x,
           CASE WHEN axis_to_center = 'y'
                THEN ({height} - (max_y - min_y) * conversion) / 2 ELSE 0.0 END AS shift_y,
           cast({1080 - bottom} AS double) AS floor_y
    FROM (SELECT *,
                 1 / greatest((max_x - min_x) / {width}, (max_y - min_y) / {height})
                     AS conversion,
                 CASE WHEN (max_x - min_x) / {width} > (max_y - min_y) / {height}
                      THEN 'y' ELSE 'x' END AS axis_to_center
          FROM {bounds})"""


_cte("projection", _projection("bounds"), "bounds")
_cte("projection_margins", _projection("bounds", MARGINS), "bounds")
_cte(
    "canvas",
    """
    SELECT map_type, zone_idx, part, seq, zone, borough,
           (x - min_x) * conversion + shift_x AS x,
           floor_y - ((y - min_y) * conversion + shift_y) AS y
    FROM polygons CROSS JOIN projection""",
    "polygons",
    "projection",
)
_cte(
    "projected",
    """
    SELECT map_type, zone_idx, avg(x) AS center_x, avg(y) AS center_y,
           min(x) AS lower_x, min(y) AS lower_y, max(x) AS upper_x, max(y) AS upper_y
    FROM canvas GROUP BY map_type, zone_idx""",
    "canvas",
)

# Statements ---------------------------------------------------------------------

SQL: dict[str, str] = {}

SQL["clean_trips"] = _with("SELECT * FROM clean", "clean")

SQL["clean_violations"] = _with(
    " UNION ALL ".join(
        f"SELECT '{name}' AS rule, count(*) FILTER (WHERE {rule}) AS n_trips FROM trips"
        for name, rule in RULES.items()
    ),
    "trips",
)

SQL["fk_violations"] = _with(
    f"""
    SELECT trip_end, location_id, count(*) AS n_trips
    FROM (SELECT 'pickup' AS trip_end, pu_id AS location_id FROM trips
          UNION ALL SELECT 'dropoff', do_id FROM trips)
    WHERE location_id NOT IN
          (SELECT location_id FROM lookup WHERE location_id NOT IN {EXCLUDED})
    GROUP BY trip_end, location_id""",
    "trips",
    "lookup",
)

SQL["daily_od_rollup"] = _with("SELECT * FROM daily", "daily")


# Flows over trips
def _grouped(where: str, agg: str = "count(passenger_count)", key: str = "") -> str:
    return f"""
    SELECT {key} pu_id, do_id, {agg} AS aggregated_result
    FROM clean WHERE {where} GROUP BY ALL"""


def _per_week(weeks: str, where: str = "true") -> str:
    return f"""
    SELECT first_day AS bucket_date, pu_id, do_id,
           count(passenger_count) AS aggregated_result
    FROM clean JOIN {weeks} ON pickup_date BETWEEN first_day AND last_day
    WHERE {where} GROUP BY ALL"""


def _both_in(flow: str, borough: str) -> str:
    return f"""
    SELECT f.* FROM ({flow}) f
    JOIN lookup lookup_pu ON lookup_pu.location_id = f.pu_id
    JOIN lookup lookup_do ON lookup_do.location_id = f.do_id
    WHERE lookup_pu.borough = '{borough}' AND lookup_do.borough = '{borough}'"""


_AVG = "avg(passenger_count)"
_ON_DAY = f"pickup_date = DATE '{DAY}'"
_IN_SPAN = f"pickup_date {SPAN}"
_BY_DAY = "pickup_date AS bucket_date,"

SQL["od_day_count"] = _with(_grouped(_ON_DAY), "clean")
SQL["od_day_avg"] = _with(_grouped(_ON_DAY, _AVG), "clean")
SQL["od_period_avg"] = _with(_grouped(_IN_SPAN, _AVG), "clean")
SQL["od_each_day"] = _with(_grouped(_IN_SPAN, key=_BY_DAY), "clean")
SQL["od_each_day_weekdays"] = _with(
    _grouped(f"{_IN_SPAN} AND pickup_weekday IN (0, 1)", key=_BY_DAY), "clean"
)
SQL["od_each_week"] = _with("SELECT * FROM weekly", "weekly")
SQL["od_each_week_of_rollup"] = SQL["od_each_week"]
SQL["od_each_week_weekends"] = _with(
    _per_week("weeks", "pickup_weekday IN (5, 6)"), "clean", "weeks"
)
SQL["od_each_week_monday_end"] = _with(
    _per_week("weeks_monday_end"), "clean", "weeks_monday_end"
)
SQL["od_plain_week_monday_end"] = _with(_per_week("weeks_plain"), "clean", "weeks_plain")
SQL["od_week_borough"] = _with(_both_in("SELECT * FROM weekly", "ASIA"), "weekly", "lookup")
SQL["od_expr_sum"] = _with(
    _grouped(_IN_SPAN, "cast(sum(passenger_count) AS bigint)"), "clean"
)
SQL["od_ordered_borough"] = _with(
    _both_in(_grouped(_IN_SPAN), "EUROPE") + " ORDER BY aggregated_result, pu_id, do_id",
    "clean",
    "lookup",
)

# Flows over the mergeable rollup: straight from the trips
_MIXED = (
    "sum(passenger_count) / count(*) + max(passenger_count) - min(passenger_count)"
)
SQL["rollup_period_avg"] = SQL["od_period_avg"]
SQL["rollup_day_avg"] = SQL["od_day_avg"]
SQL["rollup_each_day_count"] = SQL["od_each_day"]
SQL["rollup_each_week_mixed"] = _with(
    _per_week("weeks").replace("count(passenger_count)", _MIXED), "clean", "weeks"
)
SQL["rollup_period_distinct"] = _with(
    _grouped(_IN_SPAN, "count(DISTINCT passenger_count)"), "clean"
)
SQL["rollup_of_two_loads"] = _with(
    f"""
    SELECT pickup_date, pickup_weekday, pu_id, do_id, count(*) AS n_rows,
           count(passenger_count) AS n_trips, cast(sum(passenger_count) AS bigint) AS total,
           min(passenger_count) AS least, max(passenger_count) AS most,
           count(DISTINCT passenger_count) AS n_values
    FROM clean WHERE {_IN_SPAN} GROUP BY ALL""",
    "clean",
)

# Calendar
SQL["date_spine"] = _with(
    """
    SELECT day, cast(isodow(day) - 1 AS int) AS weekday, coalesce(n_trips, 0) AS n_trips
    FROM (SELECT cast(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS date) AS day
          FROM span)
    LEFT JOIN day_counts ON day = pickup_date""",
    "day_counts",
    "span",
)
SQL["week_buckets"] = _with(
    f"""
    SELECT first_day AS bucket_date, first_day, last_day
    FROM ({_intervals('lo', 'hi', source='FROM span')})""",
    "span",
)
SQL["special_dates"] = _with(
    "SELECT pickup_date AS bucket_date, n_trips, CASE "
    + " ".join(
        "WHEN pickup_date = DATE '{}' THEN '{}'".format(d, label.replace("'", "''"))
        for d, label in CALENDAR
    )
    + " END AS special_date FROM day_counts",
    "day_counts",
)
SQL["date_captions"] = _with(
    """
    SELECT pickup_date AS bucket_date, dayname(pickup_date) AS weekday_name,
           'Week of the ' || strftime(pickup_date, '%Y-%m-%d') AS week_caption, n_trips
    FROM day_counts""",
    "day_counts",
)


# Period flows and comparison
def _period(agg: str) -> str:
    return f"""
    SELECT pu_id, do_id, {agg} AS aggregated_result
    FROM daily WHERE pickup_date {SPAN} GROUP BY pu_id, do_id"""


_COUNT_DAYS = "count(passenger_count_per_day)"
_AVG_DAYS = "avg(passenger_count_per_day)"
_SUM_DAYS = "cast(sum(passenger_count_per_day) AS bigint)"


def _halves(agg: str) -> tuple[str, str]:
    wd, we = (
        f"""(SELECT pu_id AS {p}_pu, do_id AS {p}_do, {agg} AS {p}
             FROM daily WHERE pickup_date {SPAN} AND pickup_weekday IN {days}
             GROUP BY pu_id, do_id) {p}"""
        for p, days in (("wd", (0, 1, 2, 3, 4)), ("we", (5, 6)))
    )
    return tuple(
        f"SELECT * FROM {wd} {side} JOIN {we} ON wd_pu = we_pu AND wd_do = we_do"
        for side in ("LEFT", "RIGHT")
    )


def _difference(rows: str) -> str:
    return f"""
    SELECT coalesce(wd_pu, we_pu) AS pu_id, coalesce(wd_do, we_do) AS do_id,
           coalesce(wd, 0) - coalesce(we, 0) AS diff FROM ({rows})"""


def _union_difference(agg: str) -> str:
    return _difference(" UNION ".join(_halves(agg)))


SQL["period_flow_count"] = _with(_period(_COUNT_DAYS), "daily")
SQL["period_flow_avg"] = _with(_period(_AVG_DAYS), "daily")
SQL["period_flow_sum"] = _with(_period(_SUM_DAYS), "daily")
SQL["period_flow_borough"] = _with(
    _both_in(_period(_AVG_DAYS), "ASIA"), "daily", "lookup"
)
SQL["wd_we_diff_count"] = _with(_union_difference(_COUNT_DAYS), "daily")
SQL["wd_we_diff_avg"] = _with(_union_difference(_AVG_DAYS), "daily")
SQL["wd_we_diff_sum"] = _with(_union_difference(_SUM_DAYS), "daily")
SQL["wd_we_diff_borough"] = _with(
    _both_in(_union_difference(_AVG_DAYS), "ASIA"), "daily", "lookup"
)
SQL["wd_we_diff_ratio"] = _with(
    _union_difference("sum(passenger_count_per_day) / count(*)"), "daily"
)
SQL["wd_we_diff_sum_plus_max"] = _with(
    _union_difference(
        "cast(sum(passenger_count_per_day) + max(passenger_count_per_day) AS bigint)"
    ),
    "daily",
)
SQL["wd_we_left_join"] = _with(_difference(_halves(_COUNT_DAYS)[0]), "daily")
SQL["wd_we_right_join"] = _with(_difference(_halves(_COUNT_DAYS)[1]), "daily")
SQL["wd_we_full_join"] = SQL["wd_we_diff_count"]
SQL["outer_join_union"] = SQL["wd_we_diff_count"]

# The same in a month in which some links run on weekdays or weekends only.
_MONTH = "BETWEEN DATE '1998-01-01' AND DATE '1998-01-31'"
for _name in ("wd_we_left_join", "wd_we_right_join", "wd_we_full_join", "outer_join_union"):
    SQL[f"{_name}_month"] = SQL[_name].replace(f"pickup_date {SPAN} AND pickup_weekday", f"pickup_date {_MONTH} AND pickup_weekday")


# Adjacency and choropleth encoding
def _directed(od: str, weight: str) -> str:
    return f"""
    SELECT 'out' AS flow_dir, pu_id AS zone, a.zone AS zone_name, a.borough AS borough,
           do_id AS linked_zone, b.zone AS linked_zone_name, {weight} AS weight
    FROM ({od}) JOIN lookup a ON a.location_id = pu_id JOIN lookup b ON b.location_id = do_id
    UNION ALL
    SELECT 'in', do_id, b.zone, b.borough, pu_id, a.zone, {weight}
    FROM ({od}) JOIN lookup a ON a.location_id = pu_id JOIN lookup b ON b.location_id = do_id"""


_cte("directed", _directed(_union_difference(_SUM_DAYS), "diff"), "daily", "lookup")

_EXTREMES = """
    SELECT flow_dir, zone, min(weight) AS min_weight, max(weight) AS max_weight,
           count(DISTINCT weight) FILTER (WHERE linked_zone <> zone) AS n_colours
    FROM {} GROUP BY flow_dir, zone"""

_cte("extremes", _EXTREMES.format("directed"), "directed")


def _colour(value: str) -> str:
    """The three colour columns of a value between min_weight and max_weight."""

    def channel(name: str, grey: int, positive: tuple, negative: tuple) -> str:
        def ramp(low: int, high: int, bound: str) -> str:
            return f"({high} - {low}) * ({value} / {bound}) + {low}"

        return f"""
        cast(CASE WHEN {value} = 0 THEN {grey}
             WHEN {value} > 0 THEN {ramp(*positive, 'max_weight')}
             ELSE {ramp(*negative, 'min_weight')} END AS double) AS colour_{name}"""

    return ", ".join(
        (
            channel("b", 40, (40, 100), (0, 210)),
            channel("g", 40, (40, 100), (0, 150)),
            channel("r", 40, (100, 255), (0, 90)),
        )
    )


def _coloured(directed: str, extremes: str, columns: str) -> str:
    return f"""
    SELECT {columns}, {_colour('weight')}
    FROM {directed} d JOIN {extremes} e USING (flow_dir, zone)
    WHERE linked_zone <> zone"""


def _legend(extremes: str) -> str:
    return f"""
    SELECT flow_dir, zone, min_weight, max_weight, n_colours,
           cast(row_number() OVER (PARTITION BY flow_dir, zone ORDER BY level) - 1 AS int)
               AS level_no,
           round(level, 6) AS level,
           printf('%.2f', level)
               || CASE WHEN cast(printf('%.2f', level) AS double) IN (-1, 0, 1)
                       THEN ' passenger' ELSE ' passengers' END AS caption,
           {_colour('level')}
    FROM (
        WITH steps AS (
            SELECT *, unnest(range(least(n_colours, 8))) AS k FROM {extremes}),
        spaced AS (
            SELECT flow_dir, zone, min_weight, max_weight, n_colours,
                   CASE WHEN n_colours = 1 THEN cast(max_weight AS double)
                        ELSE cast(max_weight AS double)
                             + (min_weight - max_weight) * k / (least(n_colours, 8) - 1)
                   END AS level
            FROM steps)
        SELECT * FROM spaced
        UNION ALL
        SELECT flow_dir, zone, min_weight, max_weight, n_colours, 0.0
        FROM spaced GROUP BY ALL
        HAVING min(level) < 0 AND max(level) > 0 AND count(*) FILTER (WHERE level = 0) = 0)"""


_DIRECTED_COLUMNS = "zone, zone_name, borough, linked_zone, linked_zone_name, weight"

SQL["out_adjacency"] = _with(
    f"SELECT {_DIRECTED_COLUMNS} FROM directed WHERE flow_dir = 'out'", "directed"
)
SQL["in_adjacency"] = _with(
    f"SELECT {_DIRECTED_COLUMNS} FROM directed WHERE flow_dir = 'in'", "directed"
)
SQL["adjacency_lists"] = _with(
    """
    SELECT flow_dir, zone,
           string_agg(linked_zone || ':' || weight, ',' ORDER BY linked_zone) AS links
    FROM directed GROUP BY flow_dir, zone""",
    "directed",
)
SQL["zone_min_max"] = _with("SELECT * FROM extremes", "extremes")
SQL["focus_flows"] = _with(
    """
    SELECT * FROM directed
    WHERE zone_name IN ('NATION_2', 'NATION_7', 'NATION_11') AND linked_zone <> zone""",
    "directed",
)
SQL["choropleth_colours"] = _with(
    _coloured(
        "directed", "extremes", "flow_dir, zone, linked_zone, weight, min_weight, max_weight"
    ),
    "directed",
    "extremes",
)
SQL["legend_levels"] = _with(_legend("extremes"), "extremes")


# Links with unknown ends
SQL["known_links"] = _with(
    f"""
    SELECT * FROM ({_directed(_union_difference(_SUM_DAYS), 'diff')})
    WHERE zone - 1 NOT IN (3, 9, 17) AND linked_zone - 1 NOT IN (3, 9, 17)""",
    "daily",
    "lookup",
)
_NULL_IDS = f"""
    SELECT CASE WHEN passenger_count = 3 THEN NULL ELSE pu_id END AS pu_id,
           CASE WHEN passenger_count = 4 THEN NULL ELSE do_id END AS do_id,
           count(passenger_count) AS aggregated_result
    FROM clean WHERE {_IN_SPAN} GROUP BY 1, 2"""
SQL["null_zone_links"] = _with(_NULL_IDS, "clean")
SQL["null_zone_flows"] = _with(_directed(_NULL_IDS, "aggregated_result"), "clean", "lookup")


# Zones and projection
def _r6(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


SQL["zone_bounds"] = _with(
    """
    SELECT zone_idx, zone, borough, round(min(x), 6) AS lower_x, round(min(y), 6) AS lower_y,
           round(max(x), 6) AS upper_x, round(max(y), 6) AS upper_y
    FROM polygons GROUP BY zone_idx, zone, borough""",
    "polygons",
)
SQL["zone_centroids"] = _with(
    """
    SELECT zone_idx, count(*) AS n_vertices,
           round(avg(x), 6) AS center_x, round(avg(y), 6) AS center_y
    FROM polygons GROUP BY zone_idx""",
    "polygons",
)
SQL["vertex_zone_geometry"] = _with(
    """
    SELECT zone_idx, zone, borough, count(*) AS n_vertices,
           round(min(x), 6) AS lower_x, round(min(y), 6) AS lower_y, round(max(x), 6) AS upper_x,
           round(max(y), 6) AS upper_y, round(avg(x), 6) AS center_x, round(avg(y), 6) AS center_y
    FROM polygons GROUP BY zone_idx, zone, borough""",
    "polygons",
)
SQL["map_bounds"] = _with(
    f"SELECT map_type, {_r6('min_x', 'min_y', 'max_x', 'max_y')} FROM bounds", "bounds"
)
SQL["projection_params"] = _with(
    "SELECT map_type, axis_to_center, "
    + _r6("min_x", "min_y", "max_x", "max_y", "conversion", "shift_x", "shift_y", "floor_y")
    + " FROM projection_margins",
    "projection_margins",
)
SQL["projected_centroids"] = _with(
    "SELECT map_type, zone_idx, "
    + _r6("center_x", "center_y", "lower_x", "lower_y", "upper_x", "upper_y")
    + " FROM projected",
    "projected",
)
SQL["inverse_projection"] = _with(
    """
    SELECT map_type, zone_idx, round(avg(x), 6) AS x, round(avg(y), 6) AS y
    FROM polygons CROSS JOIN maps GROUP BY map_type, zone_idx""",
    "polygons",
    "maps",
)
SQL["base_map_vertices"] = _with(
    f"""
    SELECT map_type, zone_idx, part, seq, {_r6('x', 'y')},
           borough IN ('ASIA', 'EUROPE') AS in_outline
    FROM canvas WHERE map_type IN ('total', 'ASIA')""",
    "canvas",
)
SQL["vertex_base_map"] = SQL["base_map_vertices"]
SQL["single_borough_map"] = _with(
    f"""
    SELECT map_type, zone_idx, part, seq, {_r6('x', 'y')}
    FROM canvas WHERE map_type = borough""",
    "canvas",
)
_cte(
    "zoom_bounds",
    """
    SELECT 'total' AS map_type, min(x) AS min_x, min(y) AS min_y, max(x) AS max_x,
           max(y) AS max_y
    FROM polygons WHERE zone IN ('NATION_3', 'NATION_9')""",
    "polygons",
)
_cte("zoom_projection", _projection("zoom_bounds"), "zoom_bounds")
SQL["zoomed_map_params"] = _with(
    f"SELECT map_type, axis_to_center, {_r6('conversion')} FROM zoom_projection",
    "zoom_projection",
)
SQL["zone_attr_filter"] = _with(
    """
    SELECT zone_idx, part, zone, borough, cast(count(*) AS int) AS n_vertices
    FROM polygons WHERE borough IN ('ASIA', 'EUROPE') GROUP BY ALL""",
    "polygons",
)


# Points and frames
def _size(value: str, scale: str | int) -> str:
    return f"cast(trunc({value} / nullif(max_weight, 0) * {scale}) AS int)"


_RUN = """(SELECT min(aggregated_result) AS min_weight, max(aggregated_result) AS max_weight
           FROM {})"""

SQL["global_min_max"] = _with(f"SELECT * FROM {_RUN.format('weekly')}", "weekly")
SQL["point_weights"] = _with(
    f"""
    SELECT bucket_date, pu_id, do_id, {_size('aggregated_result', 20)} AS weight_total,
           {_size('aggregated_result', 30)} AS weight_borough
    FROM weekly CROSS JOIN {_RUN.format('weekly')}""",
    "weekly",
)
SQL["size_legend"] = _with(
    " UNION ALL ".join(
        f"""
        SELECT '{map_type}' AS map_type, '{entry}' AS entry, {entry}_weight AS value,
               {_size(f'{entry}_weight', scale)} AS size,
               {entry}_weight || ' {noun}' AS caption
        FROM {_RUN.format('weekly')}"""
        for map_type, scale in (("total", 20), ("ASIA", 30))
        for entry, noun in (("max", "passengers"), ("min", "passenger"))
    ),
    "weekly",
)


def _link_colour(kind: str = "double") -> str:
    return ", ".join(
        f"cast(CASE WHEN pu_id = do_id THEN {a} ELSE {b} END AS {kind}) AS colour_{n}"
        for n, a, b in zip("bgr", (141, 91, 67), (135, 162, 34))
    )


SQL["link_class"] = _with(
    f"""
    SELECT DISTINCT pu_id, do_id, pu_id - 1 AS pu_idx, do_id - 1 AS do_idx,
           pu_id = do_id AS is_self,
           CASE WHEN pu_id = do_id THEN 'Identical' ELSE 'Distinct' END AS link_class,
           {_link_colour()}
    FROM clean WHERE {_IN_SPAN}""",
    "clean",
)


def _links(flow: str, maps: str, keys: str) -> str:
    """Flow on maps with weight and both ends."""
    scale = "CASE WHEN map_type = 'total' THEN 20 ELSE 30 END"
    return f"""
    SELECT o.map_type, {keys} pu_id, do_id, aggregated_result, min_weight, max_weight,
           {_size('aggregated_result', scale).replace('map_type', 'o.map_type')} AS weight,
           o.center_x AS pu_x, o.center_y AS pu_y, t.center_x AS do_x, t.center_y AS do_y
    FROM ({flow}) CROSS JOIN {_RUN.format(f'({flow})')}
    JOIN projected o ON o.zone_idx = pu_id - 1
    JOIN projected t ON t.zone_idx = do_id - 1 AND t.map_type = o.map_type
    WHERE o.map_type IN {maps}"""


def _frames(links: str, columns: str) -> str:
    x, y = (
        f"cast(trunc(pu_{a} + (do_{a} - pu_{a}) / 59.0::double * frame) AS int) AS {a}"
        for a in "xy"
    )
    return f"""
    SELECT map_type, pu_id, do_id, frame, weight, {x}, {y} {columns}
    FROM ({links}) CROSS JOIN (SELECT cast(unnest(range(60)) AS int) AS frame)"""


SQL["frame_positions"] = _with(
    _frames(_links(_grouped(_IN_SPAN), "('total')", ""), ""), "clean", "projected"
)
SQL["flow_animation"] = _with(
    _frames(
        _links(
            _both_in(_per_week("weeks", "pickup_weekday IN (0, 1)"), "ASIA"),
            "('total', 'ASIA')",
            "bucket_date,",
        ),
        f""", bucket_date, pu_id = do_id AS is_self, {_link_colour()},
        'Week of the ' || strftime(bucket_date, '%Y-%m-%d') AS caption""",
    ),
    "clean",
    "weeks",
    "lookup",
    "projected",
)


def _preset(flow: str, caption: str) -> str:
    return f"""
    SELECT map_type, bucket_date, pu_id, do_id, aggregated_result, weight, min_weight,
           max_weight, pu_id = do_id AS is_self, {_link_colour()}, {_r6('pu_x', 'pu_y', 'do_x', 'do_y')}, {caption}
    FROM ({_links(flow, MAPS, 'bucket_date,')})"""


_WEEK_CAPTION = "'Week of the ' || strftime(bucket_date, '%Y-%m-%d') AS caption"
_DAY_CAPTION = (
    "dayname(bucket_date) AS caption, CASE "
    + " ".join(
        "WHEN bucket_date = DATE '{}' THEN '{}'".format(d, label.replace("'", "''"))
        for d, label in CALENDAR
    )
    + " END AS special_date"
)


def _frame_totals(flow: str) -> str:
    frames = _frames(_links(flow, MAPS, "bucket_date,"), ", pu_id = do_id AS is_self")
    return f"""
    SELECT map_type, frame, count(*) AS n_points, cast(sum(x) AS bigint) AS sum_x,
           cast(sum(y) AS bigint) AS sum_y, cast(sum(weight) AS bigint) AS sum_weight,
           count(*) FILTER (is_self) AS n_self
    FROM ({frames}) GROUP BY map_type, frame"""


SQL["preset_year_daily"] = _with(
    _preset(_grouped(_IN_SPAN, key=_BY_DAY), _DAY_CAPTION), "clean", "projected"
)
SQL["preset_year_daily_frames"] = _with(
    _frame_totals(_grouped(_IN_SPAN, key=_BY_DAY)), "clean", "projected"
)
for _name, _days in (("weekdays", (0, 1, 2, 3, 4)), ("weekends", (5, 6))):
    SQL[f"preset_year_{_name}"] = _with(
        _preset(_per_week("weeks", f"pickup_weekday IN {_days}"), _WEEK_CAPTION),
        "clean",
        "weeks",
        "projected",
    )
    SQL[f"preset_year_{_name}_frames"] = _with(
        _frame_totals(_per_week("weeks", f"pickup_weekday IN {_days}")),
        "clean",
        "weeks",
        "projected",
    )


# Choropleth maps
def _map_name(suffix: str) -> str:
    return f"""
        CASE WHEN map_type = 'total' THEN 'NYC' ELSE map_type END || '_' || zone || '_'
        || zone_name || '_' || flow_dir || '_{suffix}' AS map_name"""


_MAP_COLUMNS = (
    "flow_dir, zone, zone_name, borough, linked_zone, weight, min_weight, max_weight"
)


def _choropleth(od: str, value: str, maps: str, suffix: str, where: str = "true") -> str:
    rows = f"(SELECT * FROM ({_directed(od, value)}) WHERE {where})"
    return f"""
    SELECT * EXCLUDE (zone_name, borough), {_map_name(suffix)}
    FROM (SELECT *, unnest({maps}) AS map_type
          FROM ({_coloured(rows, f"({_EXTREMES.format(rows)})", _MAP_COLUMNS)}))"""


SQL["preset_period_map"] = _with(
    _choropleth(_period(_COUNT_DAYS), "aggregated_result", "['total', borough]", "all"),
    "daily",
    "lookup",
)
SQL["preset_diff_map"] = _with(
    _choropleth(
        _union_difference(_COUNT_DAYS), "diff", "['total', borough]", "all_diff_WD_WE"
    ),
    "daily",
    "lookup",
)



def _products(agg: str) -> str:
    products = {
        "period": (_period(agg), "aggregated_result", "all"),
        "diff": (_union_difference(agg), "diff", "all_diff_WD_WE"),
    }
    return " UNION ALL BY NAME ".join(
        f"""
        SELECT *, '{name}' AS measure
        FROM ({_choropleth(od, value, "['total', 'ASIA']", suffix,
                           "borough IN ('ASIA', 'EUROPE')")})"""
        for name, (od, value, suffix) in products.items()
    )


SQL["choropleth_products"] = _with(_products(_AVG_DAYS), "daily", "lookup")
SQL["choropleth_products_ratio"] = _with(
    _products("sum(passenger_count_per_day) / count(*)"), "daily", "lookup"
)

_cte(
    "count_directed", _directed(_union_difference(_COUNT_DAYS), "diff"), "daily", "lookup"
)
_cte("count_extremes", _EXTREMES.format("count_directed"), "count_directed")
SQL["choropleth_legends"] = _with(_legend("count_extremes"), "count_extremes")

assert BOROUGHS == MAPS[1:]
