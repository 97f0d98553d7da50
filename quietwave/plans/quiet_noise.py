"""Catalogue to noise statistics: blackouts, quiet regions, windows, gate, summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietwave.operators.intervals import HOUR, cut_windows, pane_statistics, quiet_regions, sliding_windows


def quiet_window_statistics(
    samples: DataFrame, regions: DataFrame, keys: list[str], length: int, stride: int, buffer: int, pane: int | None,
) -> DataFrame:
    """Count, mean and variance of every window of every trace key.

    With a `pane` (dense records: many samples per pane) samples are reduced to panes
    first; without one (sparse records) each sample joins the windows it falls in.
    """
    if pane is not None:
        return pane_statistics(samples, regions, keys, length, stride, buffer, pane)
    cut = cut_windows(samples, sliding_windows(regions, length, buffer, stride).select("ws", "we"), HOUR)
    return cut.groupBy(*keys, "ws", "we").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.var_pop("x").alias("variance"))


def station_noise(
    samples: DataFrame, blackouts: DataFrame, keys: list[str], t0: int, t1: int, length: int, stride: int, buffer: int, pane: int | None,
    least_samples: int = 2, variance_floor: float = 1e-30,
) -> DataFrame:
    """Noise level per trace key over all quiet windows that pass the gate."""
    regions = quiet_regions(blackouts, t0, t1)
    stats = quiet_window_statistics(samples, regions, keys, length, stride, buffer, pane)
    passed = stats.where((F.col("n") >= least_samples) & (F.col("variance") > variance_floor))
    return passed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("windows"), F.sum("n").alias("samples"),
        F.avg("variance").alias("mean_variance"), F.stddev_pop("variance").alias("sd_variance"))
