"""Waveform archive, simulation records, ensembles and result sets on Parquet."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quietwave.operators.intervals import as_timestamp
from quietwave.operators.quality import match_methods


MANIFEST = "_manifest"


def write_archive(samples: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Samples (station, channel, ts, x) as folders station / year / jday, and a manifest beside them.

    The manifest has per station, day and channel the number of samples and the first and last instant.
    """
    day = as_timestamp("ts")
    dated = samples.withColumns({"year": F.year(day), "jday": F.dayofyear(day)})
    # rebalance: few files per folder, and a crowded folder is still written by many tasks
    dated.hint("rebalance", "station", "year", "jday").write.mode(mode).partitionBy("station", "year", "jday").parquet(path)
    spans = dated.groupBy("station", "year", "jday", "channel").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    # Spark's readers of the archive pass over a folder with a leading underscore
    spans.write.mode("append" if mode == "append" else "overwrite").parquet(f"{path}/{MANIFEST}")


def _has_manifest(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{MANIFEST}")
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def _days_of(t0: int, t1: int) -> Column:
    """Test on year and jday for the days of [t0, t1] in UTC."""
    first, last = (datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=t) for t in (t0, t1))
    test = F.lit(False)
    for year in range(first.year, last.year + 1):
        low = first.timetuple().tm_yday if year == first.year else 1
        high = last.timetuple().tm_yday if year == last.year else 366
        test = test | ((F.col("year") == year) & F.col("jday").between(low, high))
    return test


def read_archive(spark: SparkSession, path: str, t0: int, t1: int, channels: int = 3) -> DataFrame:
    """Samples of [t0, t1] of stations that have all channels in it.

    Year and day come from the range, so only its folders are read. The manifest tells which stations are whole: a
    channel whose first or last sample of a day lies in the range is there, one without a span that reaches it is not.
    Only where a span covers the range on both sides, so that there might be a gap, are the samples of those stations
    looked at first; otherwise the archive is read once. An archive without a manifest is read twice.
    """
    days = _days_of(t0, t1)
    inside = spark.read.parquet(path).where(days).where(F.col("ts").between(t0, t1))

    def counted(rows: DataFrame) -> DataFrame:
        return rows.groupBy("station").agg(F.countDistinct("channel").alias("_c")).where(F.col("_c") == channels).select("station")

    if not _has_manifest(spark, path):
        return inside.join(counted(inside), "station", "left_semi").drop("year", "jday")
    spans = spark.read.parquet(f"{path}/{MANIFEST}").where(days)
    ends = F.col("first").between(t0, t1) | F.col("last").between(t0, t1)
    around = (F.col("first") < t0) & (F.col("last") > t1)
    seen = spans.groupBy("station", "channel").agg(F.max(ends).alias("sure"), F.max(around).alias("may"))
    held = seen.groupBy("station").agg(F.count_if("sure").alias("sure"), F.count_if(F.expr("may AND NOT sure")).alias("may"))
    whole = held.where((F.col("may") == 0) & (F.col("sure") == channels)).select("station")
    open_ones = held.where((F.col("may") > 0) & (F.col("sure") <= channels) & (F.col("sure") + F.col("may") >= channels)).select("station")
    if not open_ones.isEmpty():
        whole = whole.unionByName(counted(inside.join(open_ones, "station", "left_semi")))
    return inside.join(whole, "station", "left_semi").drop("year", "jday")


def write_simulations(records: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Records (sim_id, inputs map<string,map<string,double>>, station, component, x, misc)."""
    chosen = records.select("sim_id", "inputs", "station", "component", "x", "misc")
    chosen.hint("rebalance", "station").write.mode(mode).partitionBy("station").parquet(path)


def read_simulations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_ensemble(spark: SparkSession, path: str, required: bool = False) -> DataFrame:
    """Every Parquet file below a folder, with the file each row came from.

    `required` makes an empty ensemble an error (training sets).
    """
    frame = spark.read.option("recursiveFileLookup", "true").parquet(path)
    if required and not frame.head(1):
        raise FileNotFoundError(f"no records under {path}")
    return frame.select("*", F.col("_metadata.file_name").alias("file_name"))


def append_results(results: DataFrame, path: str) -> None:
    """Add finished results to a result set; nothing that is there is read or rewritten."""
    results.write.mode("append").parquet(path)


def collect_runs(spark: SparkSession, paths: list[str], keys: list[str], bounds: DataFrame) -> DataFrame:
    """Samples and truths of several runs whose method matches a key, scaled by the bounds.

    Runs hold (event, method, sample_id, pos, value, truth), bounds (pos, lo, hi); a
    missing truth is an error.
    """
    rows = match_methods(spark.read.parquet(*paths), keys)
    rows = rows.withColumn("truth", F.coalesce("truth", F.raise_error(F.lit("a result has no truth")).cast("double")))
    joined = rows.join(bounds.select("pos", "lo", "hi"), "pos")
    scale = lambda c: F.try_divide(F.col(c) - F.col("lo"), F.col("hi") - F.col("lo"))
    return joined.withColumns({"scaled": scale("value"), "scaled_truth": scale("truth")}).drop("lo", "hi")
