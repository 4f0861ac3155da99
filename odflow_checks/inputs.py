"""The driver tables seen as trips, zone lookup and zone polygons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from odflow import schema as S
from odflow.operators.cleaning import with_trip_dates
from odflow.operators.zones import zones_of_lookup

# The whole span of order dates.
START, END = "1995-01-01", "2001-12-31"

# Zone ids left out by the clean-up: no zone, and the last two nations.
EXCLUDED = (0, 24, 25)

N_ZONES = 25
BOROUGHS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")


# The columns used, declared so that no job has to infer them from the files.
SCHEMAS = {
    "lineitem": """l_orderkey BIGINT, l_suppkey BIGINT, l_linenumber INT,
        l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE,
        l_returnflag STRING, l_shipdate TIMESTAMP_NTZ""",
    "orders": """o_orderkey BIGINT, o_custkey BIGINT, o_totalprice DOUBLE,
        o_orderdate TIMESTAMP_NTZ""",
    "customer": "c_custkey BIGINT, c_nationkey INT, c_acctbal DOUBLE",
    "supplier": "s_suppkey BIGINT, s_nationkey INT, s_acctbal DOUBLE",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "region": "r_regionkey INT, r_name STRING",
    "embeddings": "vec_id BIGINT, embedding ARRAY<FLOAT>",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One trip per line item, from the supplier's to the customer's nation.

    Customers meet the narrow orders table before the line items do, so the wide
    side is shuffled once per join key and nothing is joined twice. Orders and line
    items both grow with the data, so neither is ever broadcast for the other.
    """
    ordered = table(spark, sf_dir, "orders").join(
        table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")
    )
    joined = (
        table(spark, sf_dir, "lineitem")
        .join(ordered.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    )
    passengers = F.when(
        F.col("l_linenumber") != 7, F.round(F.col("l_discount") * 100).cast("int")
    )
    columns = {
        "VendorID": F.col("l_linenumber"),
        "tpep_pickup_datetime": F.col("o_orderdate"),
        "tpep_dropoff_datetime": F.col("l_shipdate"),
        "passenger_count": passengers,
        "trip_distance": F.col("l_quantity"),
        "RatecodeID": F.lit(1),
        "store_and_fwd_flag": F.col("l_returnflag"),
        S.PU: F.col("s_nationkey") + 1,
        S.DO: F.col("c_nationkey") + 1,
        "payment_type": F.lit(1),
        "fare_amount": F.col("l_extendedprice"),
        "extra": F.col("l_tax"),
        "mta_tax": F.lit(0.5),
        "tip_amount": F.col("s_acctbal"),
        "tolls_amount": F.col("c_acctbal"),
        "improvement_surcharge": F.lit(0.3),
        "total_amount": F.col("o_totalprice"),
    }
    return with_trip_dates(joined.select(*(c.alias(n) for n, c in columns.items())))


def lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as zones, regions as boroughs."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        (F.col("n_nationkey") + 1).alias("LocationID"),
        F.col("r_name").alias("borough_name"),
        F.col("n_name").alias("zone"),
    )


def zone_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vertices of ``zone_parts`` as rows."""
    rows = zone_parts(spark, sf_dir).select(
        "zone_idx", "zone", "borough", "part", F.posexplode("coords").alias("seq", "p")
    )
    return rows.select("zone_idx", "zone", "borough", "part", "seq", "p.x", "p.y")


def zone_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding vector as one polygon part of a zone.

    All vectors are used: vector v is a part of zone v mod 25, and its values are
    read in pairs as vertices.
    """
    value = F.col("embedding")
    coords = F.transform(
        F.sequence(F.lit(0), (F.size(value) / 2).cast("int") - 1),
        lambda i: F.struct(
            F.element_at(value, (2 * i + 1).cast("int")).cast("double").alias("x"),
            F.element_at(value, (2 * i + 2).cast("int")).cast("double").alias("y"),
        ),
    )
    parts = table(spark, sf_dir, "embeddings").select(
        (F.col("vec_id") % N_ZONES).cast("int").alias("zone_idx"),
        F.col("vec_id").alias("part"),
        coords.alias("coords"),
    )
    zones = zones_of_lookup(lookup(spark, sf_dir))
    return parts.join(zones, "zone_idx").select("zone_idx", "part", "zone", "borough", "coords")
