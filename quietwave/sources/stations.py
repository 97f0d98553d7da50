"""Station lists, component and shift maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_station_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """Rows STATION NETWORK LAT LON; blank lines drop out and # starts a comment anywhere."""
    keep = [c for c in lines.columns if c != line]
    text = F.trim(F.regexp_replace(F.col(line), "#.*", ""))
    parts = lines.withColumn("_p", F.split(text, r"\s+")).where(F.length(text) > 0)
    return parts.select(
        *keep, F.col("_p")[0].alias("station"), F.col("_p")[1].alias("network"),
        F.try_element_at("_p", F.lit(3)).cast("double").alias("lat"), F.try_element_at("_p", F.lit(4)).cast("double").alias("lon"))


def read_stations(spark: SparkSession, path: str) -> DataFrame:
    return parse_station_lines(spark.read.text(path))


def station_networks(stations: DataFrame) -> DataFrame:
    """Station to network only."""
    return stations.groupBy("station").agg(F.min("network").alias("network"))


def write_stations(stations: DataFrame, path: str) -> None:
    line = F.concat_ws(" ", "station", "network", F.col("lat").cast("string"), F.col("lon").cast("string"))
    stations.select(line.alias("value")).write.text(path)


def parse_component_map(documents: DataFrame, column: str = "value") -> DataFrame:
    """JSON object station -> component list as rows (station, components)."""
    parsed = F.from_json(column, "map<string,array<string>>")
    return documents.select(F.explode(parsed).alias("station", "components"))


def parse_shift_map(documents: DataFrame, column: str = "value") -> DataFrame:
    """JSON object station -> shift in samples as rows (station, time_shift)."""
    parsed = F.from_json(column, "map<string,int>")
    return documents.select(F.explode(parsed).alias("station", "time_shift"))


def read_json_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True)


def with_components(stations: DataFrame, components: DataFrame, shifts: DataFrame) -> DataFrame:
    """Stations with components (empty lists drop out) and shift (0 when missing)."""
    joined = stations.join(components, "station").where(F.size("components") > 0)
    return joined.join(shifts, "station", "left").withColumn("time_shift", F.coalesce("time_shift", F.lit(0)))


def stations_without_components(stations: DataFrame, components: DataFrame) -> DataFrame:
    """Stations the component map does not name: an error unless empty."""
    return stations.join(components, "station", "left_anti")
