"""Noise statistics: variances, autocovariances, mergeable moments, tapers, rescaling."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quietwave.functions.arrays import variance
from quietwave.functions.draws import normal, uniform
from quietwave.functions.signal import autocovariance
from quietwave.operators.ordering import join_same


def trace_variance(x: str) -> Column:
    """Population variance of a trace held as an array."""
    return variance(x)


def with_autocovariance(traces: DataFrame, lags: int | None = None, x: str = "x", out: str = "acf") -> DataFrame:
    return traces.withColumn(out, autocovariance(lags)(F.col(x)))


def ensemble_autocovariance(traces: DataFrame, keys: list[str], acf: str = "acf") -> DataFrame:
    """Mean and population deviation of the autocovariance per `keys` and lag over all windows.

    Averages are pre-aggregated in each map task, so a station with most of the windows
    costs no more in the shuffle than any other.
    """
    long = traces.where(F.col(acf).isNotNull()).select(*keys, F.posexplode(acf).alias("k", "v"))
    return long.groupBy(*keys, "k").agg(
        F.count("v").alias("n"), F.avg("v").alias("c"), F.stddev_pop("v").alias("sd"))


def lag_zero(cov: DataFrame, keys: list[str], k: str = "k", c: str = "c") -> DataFrame:
    """Variance table: the first value of each covariance."""
    return cov.groupBy(*keys).agg(F.min_by(c, k).alias("variance"))


def moments(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """State of a running mean and deviation: n, mean, m2."""
    return df.groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"),
        (F.var_pop(value) * F.count(value)).alias("m2"))


def merge_moments(states: DataFrame, keys: list[str]) -> DataFrame:
    """Combine states: any split of the data gives the same result.

    Means are taken about the least mean of each key, so an offset does not cancel the spread.
    """
    least = states.groupBy(*keys).agg(F.min("mean").alias("_c"))
    off = F.col("mean") - F.col("_c")
    total = join_same(states, least, keys).groupBy(*keys, "_c").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * off).alias("_t"),
        F.sum("m2").alias("_within"), F.sum(F.col("n") * off * off).alias("_q"))
    shift = F.col("_t") / F.col("n")
    return total.select(
        *keys, "n", (F.col("_c") + shift).alias("mean"),
        F.greatest(F.lit(0.0), F.col("_within") + F.col("_q") - F.col("n") * shift * shift).alias("m2"),
    ).withColumn("sd", F.sqrt(F.col("m2") / F.col("n")))


def taper_covariance(cov: DataFrame, keys: list[str], fit_length: int = 30, ols: bool = True,
                     k: str = "k", c: str = "c") -> DataFrame:
    """c exp(g k): g = -1/L, or the slope through the origin of log|c| - log|c0| over k < L.

    Adds rate (= -g) and tapered.
    """
    if not ols:
        g = F.lit(-1.0 / fit_length)
        return cov.withColumn("rate", -g).withColumn("tapered", F.col(c) * F.exp(g * F.col(k)))
    head = cov.where(F.col(k) < fit_length)
    base = head.where(F.col(k) == 0).select(*keys, F.log(F.abs(c)).alias("_l0"))
    fit = head.join(base, keys).groupBy(*keys).agg(
        F.try_divide(
            F.sum(F.col(k) * (F.log(F.abs(c)) - F.col("_l0"))), F.sum(F.col(k) * F.col(k)).cast("double")
        ).alias("_g"))
    return cov.join(fit, keys).withColumn("rate", -F.col("_g")).withColumn(
        "tapered", F.col(c) * F.exp(F.col("_g") * F.col(k))).drop("_g")


def band_limited_columns(variances: DataFrame, n: int, low: float, high: float, rate: float = 1.0,
                         jitter: float = 0.01, column: str = "variance") -> DataFrame:
    """Toeplitz column k = 0..n-1 of band-limited noise with the given lag-0 variance."""
    tau = F.col("k") / F.lit(rate)
    inner = F.col(column) / F.lit(2 * (high - low))
    wave = inner * (F.sin(2 * math.pi * high * tau) - F.sin(2 * math.pi * low * tau)) / (F.lit(math.pi) * tau)
    value = F.when(F.col("k") == 0, 2 * inner * (high - low) * (1 + jitter)).otherwise(wave)
    return variances.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("c", value)


def damped_cosine_columns(variances: DataFrame, n: int, omega: float = 4.4, decay: float = 1 / 20,
                          rate: float = 1.0, jitter: float = 0.01, column: str = "variance") -> DataFrame:
    """Toeplitz column of exp(-decay t) cos(decay omega t), t = k / rate."""
    t = F.col("k") / F.lit(rate)
    value = F.col(column) * F.exp(-decay * t) * F.cos(decay * omega * t)
    value = F.when(F.col("k") == 0, value * (1 + jitter)).otherwise(value)
    return variances.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("c", value)


def rescale_traces(traces: DataFrame, noise_variance: DataFrame, event_variance: DataFrame, keys: list[str], x: str = "x") -> DataFrame:
    """Divide a noise trace by sqrt(noise variance / event variance) of its station and component."""
    ratio = noise_variance.select(*keys, F.col("variance").alias("_nv")).join(
        event_variance.select(*keys, F.col("variance").alias("_ev")), keys)
    return traces.join(ratio, keys).withColumn(
        x, F.transform(x, lambda v: F.try_divide(v, F.sqrt(F.try_divide(F.col("_nv"), F.col("_ev")))))).drop("_nv", "_ev")


def rescale_columns(cov: DataFrame, targets: DataFrame, keys: list[str], k: str = "k", c: str = "c") -> DataFrame:
    """Scale each covariance column to a target lag-0 value; a zero lag-0 stays as it is."""
    zero = cov.where(F.col(k) == 0).select(*keys, F.col(c).alias("_c0"))
    joined = cov.join(zero, keys).join(targets.select(*keys, F.col("variance").alias("_t")), keys)
    return joined.withColumn(c, F.when(F.col("_c0") == 0, F.col(c)).otherwise(
        F.col(c) * F.try_divide(F.col("_t"), F.col("_c0")))).drop("_c0", "_t")


def with_station_shift(df: DataFrame, record: list[str], station: str, array_sigma: float, station_width: float,
                       stream: str, out: str = "shift") -> DataFrame:
    """Random integer shift: round(N(0, a)) shared by a record + U(-b, b) cut toward zero per station."""
    shared = F.rint(normal(record, stream + ".array") * array_sigma).cast("int")
    own = (F.lit(-station_width) + 2 * station_width * uniform([*record, station], stream + ".station")).cast("int")
    return df.withColumn(out, shared + own)
