"""Scans: Parquet, JDBC, CSV worksheets, raw SQL and map layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.spatial import polygons_from_vertices, with_bbox

OVERRIDE_SCHEMA = "year INT, race STRING, candidate STRING, party STRING"


def scan_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def scan_jdbc(
    spark: SparkSession, url: str, table: str, split_column: str, lower: int, upper: int, parts: int, **options: str
) -> DataFrame:
    """Parallel scan of a database table, one range of the split column per task; filters are pushed down."""
    return (
        spark.read.format("jdbc")
        .options(url=url, dbtable=table, partitionColumn=split_column, lowerBound=lower, upperBound=upper)
        .options(numPartitions=parts, pushDownPredicate="true", **options)
        .load()
    )


def scan_csv(spark: SparkSession, path: str | None, schema: str) -> DataFrame:
    """CSV with a header and a fixed schema; no path means an empty table of that schema."""
    if path is None:
        return spark.createDataFrame([], schema)
    return spark.read.csv(path, schema=schema, header=True, quote='"', escape='"')


def scan_sql(spark: SparkSession, statement: str, **tables: DataFrame) -> DataFrame:
    """Raw SQL over named DataFrames (``{name}`` in the statement)."""
    return spark.sql(statement, **tables)


def clean_overrides(raw: DataFrame) -> DataFrame:
    """Blank candidate means the whole race; party is trimmed, upper-cased and must be present."""
    tidy = raw.withColumns(
        {"candidate": F.coalesce("candidate", F.lit("")), "party": F.upper(F.trim("party"))}
    )
    return tidy.filter(F.col("party").isNotNull() & (F.col("party") != ""))


def zip_dimension(zips: DataFrame) -> DataFrame:
    """Zip codes as text, the type they have in contributions."""
    return zips.withColumn("zip_code", F.col("zip_code").cast("string"))


def profile(table: DataFrame) -> DataFrame:
    """One row per column of a table, from a single pass: rows, NULLs, and the smallest and largest value.

    Numbers are compared as numbers, dates and times as text of the second, lists by their length, all else as text.
    """
    told = []
    for field in table.schema.fields:
        column, nothing, blank = F.col(f"`{field.name}`"), F.lit(None).cast("double"), F.lit(None).cast("string")
        if isinstance(field.dataType, T.ArrayType):
            column = F.size(column)
        if isinstance(field.dataType, (T.NumericType, T.ArrayType)):
            ends = [blank, blank, *[e.cast("double") + 0.0 for e in (F.min(column), F.max(column))]]  # no negative zero
        else:
            shown = F.date_format(column, "yyyy-MM-dd HH:mm:ss") if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)) else column.cast("string")
            ends = [F.min(shown), F.max(shown), nothing, nothing]
        names = ("smallest", "largest", "smallest_number", "largest_number")
        missing = F.count_if(F.col(f"`{field.name}`").isNull())
        told.append(F.struct(F.lit(field.name).alias("column_name"), F.count(F.lit(1)).alias("n"), missing.alias("nulls"), *[e.alias(n) for e, n in zip(ends, names)]))
    return table.agg(F.array(*told).alias("columns")).select(F.inline("columns"))


def layer_shapes(vertices: DataFrame, keys: list[str]) -> DataFrame:
    """A map layer stored by vertices ``(keys, ring, seq, x, y)`` as shapes: rings, number of points, box."""
    shapes = with_bbox(polygons_from_vertices(vertices, keys))
    return shapes.withColumn("npoints", F.aggregate("rings", F.lit(0), lambda n, r: n + F.size(r)))


def scan_layer(layer: DataFrame, precinct: str | None = None) -> DataFrame:
    """Map layer; layers that carry a bare precinct code get the padded voting-district code."""
    return layer if precinct is None else layer.withColumn("vtdst", voting_district(precinct))


def voting_district(precinct: Column | str) -> Column:
    return F.concat(F.lit("00"), precinct)


def county_fips(fips: Column | str) -> Column:
    """County part of a state-and-county code."""
    return F.substring(F.col(fips).cast("string") if isinstance(fips, str) else fips.cast("string"), 3, 3)
