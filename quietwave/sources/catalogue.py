"""Event catalogue exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Columns of a catalogue export.
EXPORT_SCHEMA = (
    "Year int, Month int, Day int, Time string, Lat double, Lon double, Depth double, Mag double, "
    "Region string, Timestamp long"
)


def shape_catalogue(raw: DataFrame) -> DataFrame:
    """Origin time in microseconds with position, depth (km), magnitude and region."""
    moment = F.concat(
        F.format_string("%04d-%02d-%02d ", "Year", "Month", "Day"), F.col("Time"))
    return raw.select(
        *[c for c in raw.columns if c not in EXPORT_SCHEMA.replace(",", " ").split()],
        F.unix_micros(F.to_timestamp(moment)).alias("ts"),
        F.col("Lat").alias("lat"), F.col("Lon").alias("lon"), F.col("Depth").alias("depth"),
        F.col("Mag").alias("mag"), F.col("Region").alias("region"))


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    return shape_catalogue(spark.read.csv(path, header=True, schema=EXPORT_SCHEMA))


def parse_catalogue_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    keep = [c for c in lines.columns if c != line]
    parsed = lines.select(*keep, F.from_csv(F.col(line), F.lit(EXPORT_SCHEMA)).alias("_r")).select(*keep, "_r.*")
    return shape_catalogue(parsed)
