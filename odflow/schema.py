"""Declared schemas and the fixed values shared by the operators."""

from __future__ import annotations

from datetime import date

from pyspark.sql import types as T

# Fixed values -----------------------------------------------------------

PU = "PULocationID"
DO = "DOLocationID"

# Zone ids that mean "not a real zone" in the trip records.
EXCLUDED_ZONES = (0, 264, 265)

# Money columns that may not be negative in a clean trip.
NON_NEGATIVE_AMOUNTS = (
    "fare_amount",
    "extra",
    "mta_tax",
    "tip_amount",
    "tolls_amount",
    "improvement_surcharge",
)

# Weekdays count from 0 = Monday to 6 = Sunday.
WEEKDAYS = (0, 1, 2, 3, 4)
WEEKENDS = (5, 6)

# Map selector that stands for all zones.
TOTAL_MAP = "total"

# Parts of map names: the area of the total map, the ending of a difference map.
TOTAL_AREA = "NYC"
DIFF_LABEL = "diff_WD_WE"

# Default calendar of labelled days.
SPECIAL_DATES = (
    (date(2018, 1, 1), "New Year"),
    (date(2018, 1, 7), "Coldest Day"),
    (date(2018, 2, 14), "Valentine's Day"),
    (date(2018, 7, 1), "Hottest Day"),
    (date(2018, 7, 4), "National Day"),
    (date(2018, 12, 25), "Christmas"),
)

# Positions computed for every link of one date or week.
FRAMES_PER_DATE = 60

# Largest point size per kind of map.
MAX_POINT_TOTAL = 20
MAX_POINT_BOROUGH = 30

# Colours, all as (blue, green, red).
SELF_LINK_COLOUR = (141, 91, 67)
DISTINCT_LINK_COLOUR = (135, 162, 34)
NO_FLOW_COLOUR = (40, 40, 40)
POSITIVE_LOW_COLOUR = (40, 40, 100)
POSITIVE_HIGH_COLOUR = (100, 100, 255)
NEGATIVE_LOW_COLOUR = (0, 0, 0)
NEGATIVE_HIGH_COLOUR = (210, 150, 90)

# Most levels a choropleth legend shows (a zero level may be added to them).
MAX_LEGEND_LEVELS = 8

DEFAULT_IMAGE_SIZE = (1920, 1080)  # width, height
NO_MARGINS = (0, 0, 0, 0)  # top, right, bottom, left

# Schemas ----------------------------------------------------------------

# Column order of a trip file; the four pickup/dropoff date columns are derived.
TRIP_FILE_SCHEMA = T.StructType(
    [
        T.StructField("VendorID", T.IntegerType()),
        T.StructField("tpep_pickup_datetime", T.TimestampNTZType()),
        T.StructField("tpep_dropoff_datetime", T.TimestampNTZType()),
        T.StructField("passenger_count", T.IntegerType()),
        T.StructField("trip_distance", T.DoubleType()),
        T.StructField("RatecodeID", T.IntegerType()),
        T.StructField("store_and_fwd_flag", T.StringType()),
        T.StructField(PU, T.IntegerType()),
        T.StructField(DO, T.IntegerType()),
        T.StructField("payment_type", T.IntegerType()),
        T.StructField("fare_amount", T.DoubleType()),
        T.StructField("extra", T.DoubleType()),
        T.StructField("mta_tax", T.DoubleType()),
        T.StructField("tip_amount", T.DoubleType()),
        T.StructField("tolls_amount", T.DoubleType()),
        T.StructField("improvement_surcharge", T.DoubleType()),
        T.StructField("total_amount", T.DoubleType()),
    ]
)

DERIVED_DATE_FIELDS = [
    T.StructField("pickup_date", T.DateType()),
    T.StructField("pickup_weekday", T.IntegerType()),
    T.StructField("dropoff_date", T.DateType()),
    T.StructField("dropoff_weekday", T.IntegerType()),
]

TRIP_SCHEMA = T.StructType(TRIP_FILE_SCHEMA.fields + DERIVED_DATE_FIELDS)

# Partition column of stored trips and rollups by layout.
LAYOUTS = {"day": "pickup_date", "month": "pickup_month"}

DAILY_SCHEMA = T.StructType(
    [
        T.StructField("pickup_date", T.DateType()),
        T.StructField("pickup_weekday", T.IntegerType()),
        T.StructField("passenger_count_per_day", T.LongType()),
        T.StructField(PU, T.IntegerType()),
        T.StructField(DO, T.IntegerType()),
    ]
)

# Partial aggregates of the trips of a link and day.
STATE_SCHEMA = T.StructType(
    [
        T.StructField("pickup_date", T.DateType()),
        T.StructField("pickup_weekday", T.IntegerType()),
        T.StructField(PU, T.IntegerType()),
        T.StructField(DO, T.IntegerType()),
        T.StructField("n_rows", T.LongType()),
        T.StructField("n_trips", T.LongType()),
        T.StructField("total", T.LongType()),
        T.StructField("least", T.IntegerType()),
        T.StructField("most", T.IntegerType()),
        T.StructField("values", T.BinaryType()),
        T.StructField("quantiles", T.BinaryType()),
    ]
)

# Outer partition column of stored loads.
LOAD = "load_id"

LOOKUP_SCHEMA = T.StructType(
    [
        T.StructField("LocationID", T.IntegerType()),
        T.StructField("borough_name", T.StringType()),
        T.StructField("zone", T.StringType()),
    ]
)

POINT = T.StructType(
    [T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]
)

# One row per polygon part; a zone with a single ring is a single row.
ZONE_SCHEMA = T.StructType(
    [
        T.StructField("zone_idx", T.IntegerType()),
        T.StructField("part", T.LongType()),
        T.StructField("zone", T.StringType()),
        T.StructField("borough", T.StringType()),
        T.StructField("coords", T.ArrayType(POINT)),
    ]
)
