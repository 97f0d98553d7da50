"""Scalers whose limits are fitted to the data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietwave.functions.scalers import signed_log


def fit_signed_log_minmax(long: DataFrame, keys: list[str], value: str, out: str = "scaled") -> DataFrame:
    """Signed log between 5 min|x| and max|x| of each column, then min-max to [0, 1].

    Two aggregates; limits join back as a table of one row per column.
    """
    limits = long.groupBy(*keys).agg((5 * F.min(F.abs(value))).alias("_lo"), F.max(F.abs(value)).alias("_hi"))
    logged = long.join(limits, keys).withColumn("_s", signed_log(F.col(value), F.col("_lo"), F.col("_hi")))
    span = logged.groupBy(*keys).agg(F.min("_s").alias("_a"), F.max("_s").alias("_b"))
    return logged.join(span, keys).withColumn(
        out, F.try_divide(F.col("_s") - F.col("_a"), F.col("_b") - F.col("_a"))).drop("_lo", "_hi", "_s", "_a", "_b")
