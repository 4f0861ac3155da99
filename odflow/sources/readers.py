"""Readers for trips, zone lookup, zone polygons and external tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from odflow import schema as S
from odflow.operators import rollup
from odflow.operators.cleaning import with_trip_dates

_BROKEN = "broken_line"


def _trip_file_texts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The values of every line as text, and the line itself where it has too few or too many."""
    names = [*S.TRIP_FILE_SCHEMA.names, _BROKEN]
    texts = T.StructType([T.StructField(name, T.StringType()) for name in names])
    reader = spark.read.schema(texts).option("header", True).option("mode", "PERMISSIVE")
    # with every value parsed, a broken line is known whatever columns a query needs
    reader = reader.option("columnNameOfCorruptRecord", _BROKEN).option("columnPruning", False)
    return reader.option("ignoreLeadingWhiteSpace", True).option(
        "ignoreTrailingWhiteSpace", True
    ).csv(path)


def _is_broken() -> Column:
    """Whether a line has too few or too many values; Spark wants a value read besides."""
    first = F.coalesce(F.length(S.TRIP_FILE_SCHEMA.names[0]), F.lit(0))
    return F.col(_BROKEN).isNotNull() & (first >= 0)


def _whole_lines(texts: DataFrame) -> DataFrame:
    return texts.filter(~_is_broken())


def _as_read(field: T.StructField) -> Column:
    """A value as a database reads it: ``1.0`` is an integer, seconds may have a fraction."""
    text = F.col(field.name)
    if isinstance(field.dataType, T.IntegralType):
        return F.round(text.try_cast("double")).try_cast(field.dataType)
    return text.try_cast(field.dataType)


def read_trip_files(
    spark: SparkSession, path: str | list[str], blank_as_zero: bool = True
) -> DataFrame:
    """Trips from comma separated files with one header line.

    Columns are taken by position. A blank or unreadable number becomes 0, as a
    lenient database load makes it, so that the clean-up rules see it;
    ``blank_as_zero=False`` keeps it null. An unreadable timestamp is null.
    ``unreadable_values`` counts them. A line with too few or too many values, as
    one with a broken quote has, is no trip; ``rejected_lines`` has it.
    """
    texts = _whole_lines(_trip_file_texts(spark, path))
    trips = texts.select(*(_as_read(f).alias(f.name) for f in S.TRIP_FILE_SCHEMA))
    if blank_as_zero:
        numbers = [f.name for f in S.TRIP_FILE_SCHEMA if isinstance(f.dataType, T.NumericType)]
        trips = trips.fillna(0, subset=numbers)
    return with_trip_dates(trips)


def unreadable_values(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(column, n_values)``: values of trip files that are there but cannot be read."""
    texts = _whole_lines(_trip_file_texts(spark, path))
    counts = texts.agg(
        *(
            F.count_if((F.length(f.name) > 0) & _as_read(f).isNull()).alias(f.name)
            for f in S.TRIP_FILE_SCHEMA
        )
    )
    return counts.unpivot([], S.TRIP_FILE_SCHEMA.names, "column", "n_values")


def rejected_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(file, reason, n_values, line)`` of the lines of trip files that are no trips.

    ``reason`` is ``quote`` for an odd number of quotes, else ``short`` or ``long``.
    Lines kept by ``read_trip_files`` and rejected ones together are all lines but the
    header and empty ones.
    """
    line = F.col(_BROKEN)
    n_values = F.size(F.split(line, ",", -1))
    quotes = F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))
    reason = F.when(quotes % 2 == 1, "quote").when(n_values < len(S.TRIP_FILE_SCHEMA), "short")
    return (
        _trip_file_texts(spark, path)
        .select("*", F.col("_metadata.file_name").alias("file"))
        .filter(_is_broken())
        .select("file", reason.otherwise("long").alias("reason"), n_values.alias("n_values"), line.alias("line"))
    )


def replaced_values(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(file, column, text, value, line)``: values of kept lines that could not be read as they stand.

    ``text`` is what the file has, ``value`` what the trip gets: 0 for a number, null
    for a timestamp. ``line`` holds the values of the line, joined by commas. Blank
    values are not listed.
    """
    names = S.TRIP_FILE_SCHEMA.names
    numbers = [f.name for f in S.TRIP_FILE_SCHEMA if isinstance(f.dataType, T.NumericType)]
    unread = [
        F.when(
            (F.length(f.name) > 0) & _as_read(f).isNull(),
            F.struct(
                F.lit(f.name).alias("column"),
                F.col(f.name).alias("text"),
                F.lit("0" if f.name in numbers else None).cast("string").alias("value"),
            ),
        )
        for f in S.TRIP_FILE_SCHEMA
    ]
    texts = _trip_file_texts(spark, path).select("*", F.col("_metadata.file_name").alias("file"))
    line = F.concat_ws(",", *(F.coalesce(F.col(n), F.lit("")) for n in names))
    found = _whole_lines(texts).select("file", line.alias("line"), F.explode(F.array_compact(F.array(*unread))).alias("v"))
    return found.select("file", "v.*", "line")


def _read_layout(
    spark: SparkSession, path: str, schema: T.StructType, layout: str
) -> DataFrame:
    column = S.LAYOUTS[layout]
    if column not in schema.names:
        schema = T.StructType([*schema.fields, T.StructField(column, T.DateType())])
    return spark.read.schema(schema).parquet(path).select(*schema.names)


def read_trips(spark: SparkSession, path: str, layout: str = "day") -> DataFrame:
    """Trips stored by ``write_trips``; date filters prune its partitions."""
    return _read_layout(spark, path, S.TRIP_SCHEMA, layout)


def read_daily(spark: SparkSession, path: str, layout: str = "day") -> DataFrame:
    """Daily rollup stored by ``write_daily``."""
    return _read_layout(spark, path, S.DAILY_SCHEMA, layout)


def read_states(spark: SparkSession, path: str, layout: str = "day") -> DataFrame:
    """Mergeable rollup stored by ``write_states``, all loads added up; date filters prune it."""
    return rollup.merged(_read_layout(spark, path, S.STATE_SCHEMA, layout))


def read_lookup(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Zone lookup: LocationID, borough_name, zone."""
    reader = spark.read.schema(S.LOOKUP_SCHEMA)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.format(fmt).load(path)


def read_zones(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Zone polygons, one row per polygon part, from parquet or JSON lines."""
    return spark.read.schema(S.ZONE_SCHEMA).format(fmt).load(path)


def parts_from_vertices(vertices: DataFrame) -> DataFrame:
    """Polygon parts from rows (zone_idx, zone, borough, part, seq, x, y).

    ``part`` numbers the rings of a zone as the input has them and ``seq`` the vertices
    of a ring; a ring is one row of the result, whatever its length.
    """
    return (
        vertices.groupBy("zone_idx", "zone", "borough", F.col("part").cast("long").alias("part"))
        .agg(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))).alias("points"))
        .select(
            "zone_idx",
            "part",
            "zone",
            "borough",
            F.transform(
                "points", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))
            ).alias("coords"),
        )
    )


def jdbc_options(
    url: str,
    table: str,
    start: str | date,
    end: str | date,
    num_partitions: int = 64,
    date_column: str = "pickup_date",
    **extra: str,
) -> dict[str, str]:
    """Options of a table read split on its date column.

    ``start`` and ``end`` only set the stride of the parallel reads; rows outside
    them, and rows without a date, are read too.
    """
    return {
        "url": url,
        "dbtable": table,
        "partitionColumn": date_column,
        "lowerBound": str(start),
        "upperBound": str(end),
        "numPartitions": str(num_partitions),
        "fetchsize": "10000",
        **extra,
    }


def read_jdbc(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    """A table of an external database; Spark pushes filters and columns into it."""
    return spark.read.format("jdbc").options(**options).load()
