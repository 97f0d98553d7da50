"""Rows for training: shifted traces plus noise, unused components zero, parameters scaled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietwave.functions.arrays import shift
from quietwave.operators.noise import with_station_shift
from quietwave.operators.pairing import zero_fill


def training_rows(
    traces: DataFrame, record: list[str], components: list[str], n: int, array_sigma: float, station_width: float, stream: str,
    theta: str, lo: list[float], hi: list[float],
) -> DataFrame:
    """Rows (record, station, component, x, theta).

    `traces` has record, station, component, x, noise and the parameter array.
    """
    moved = with_station_shift(traces, record, "station", array_sigma, station_width, stream, out="_shift")
    noisy = moved.withColumn("_y", F.zip_with(shift("x", "_shift"), "noise", lambda a, b: a + b))
    filled = zero_fill(noisy, record, components, n, x="_y").withColumnRenamed("_y", "x")
    bounds = F.array(*[F.struct(F.lit(float(a)).alias("lo"), F.lit(float(b)).alias("hi")) for a, b in zip(lo, hi)])
    scaled = F.zip_with(theta, bounds, lambda v, b: F.try_divide(v - b["lo"], b["hi"] - b["lo"]))
    known = traces.select(*record, scaled.alias(theta)).dropDuplicates(record)
    return filled.join(known, record)
