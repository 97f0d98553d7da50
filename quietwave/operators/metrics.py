"""Predictive metrics of synthetic records against an observation, and their summary.

Inputs are trace rows with the synthetic array `x` and the observed array `obs`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quietwave.functions import arrays as A
from quietwave.functions.batches import blocks
from quietwave.functions.signal import autocovariance, band_power, envelope

TINY = 1e-12


def mse(x: str = "x", obs: str = "obs") -> Column:
    diff = A.subtract(x, obs)
    return F.try_divide(A.power(diff), F.size(x).cast("double"))


def power_misfit(x: str = "x", obs: str = "obs") -> Column:
    observed = A.power(obs) + TINY
    return F.abs(observed - A.power(x)) / observed


def chi2(x: str = "x", obs: str = "obs", variance: str | None = None, dof: Column | None = None) -> Column:
    """Reduced chi-square of x - obs under independent noise of `variance` (1 when absent)."""
    total = A.power(A.subtract(x, obs))
    if variance is not None:
        total = F.try_divide(total, F.col(variance))
    return F.try_divide(total, (F.size(obs) if dof is None else dof).cast("double"))


def correlation_misfit(traces: DataFrame, keys: list[str], x: str = "x", obs: str = "obs") -> DataFrame:
    """Mean over the traces of a record of 1 - Pearson r; a constant trace has r = 0."""
    out = traces.withColumns({"_a": A.centred(x), "_b": A.centred(obs)})
    r = A.dot("_a", "_b") / ((F.sqrt(A.power("_a")) + TINY) * (F.sqrt(A.power("_b")) + TINY))
    return out.groupBy(*keys).agg(F.avg(1 - r).alias("value"))


def band_power_misfit(traces: DataFrame, rate: float, bands: list[tuple[float, float]], x: str = "x", obs: str = "obs") -> DataFrame:
    """Mean relative difference of Welch power over bands, in column value."""
    job = band_power(rate, bands)
    out = traces.withColumns({"_p": job(F.col(x)), "_o": job(F.col(obs))})
    relative = F.zip_with("_p", "_o", lambda p, o: F.abs(o - p) / (o + TINY))
    return out.withColumn("value", A.mean(relative)).drop("_p", "_o")


def envelope_misfit(traces: DataFrame, x: str = "x", obs: str = "obs") -> DataFrame:
    job = envelope()
    out = traces.withColumns({"_s": job(F.col(x)), "_o": job(F.col(obs))})
    relative = F.zip_with("_s", "_o", lambda s, o: F.abs(o - s) / (o + TINY))
    return out.withColumn("value", A.mean(relative)).drop("_s", "_o")


def autocorrelation_misfit(traces: DataFrame, max_lag: int = 50, x: str = "x", obs: str = "obs") -> DataFrame:
    """Mean |difference| of the autocorrelation at lags 1..max_lag of demeaned series."""
    job = autocovariance()

    def acf(name: str) -> Column:
        n = F.size(name)
        raw = F.zip_with(F.col(name), F.sequence(F.lit(0), n - 1), lambda c, k: c * (n - k))
        wanted = F.slice(raw, F.lit(2), F.least(F.lit(max_lag), n - 1))
        return A.over_scalar(wanted, F.element_at(raw, 1) + TINY)

    out = traces.withColumn("_a", job(A.centred(x))).withColumn("_b", job(A.centred(obs)))
    out = out.withColumn("_a", acf("_a")).withColumn("_b", acf("_b"))
    return out.withColumn("value", A.mean(F.zip_with("_a", "_b", lambda a, b: F.abs(a - b)))).drop("_a", "_b")


class MetricRegistry:
    """Named metrics.  A metric takes trace rows (keys, x, obs), keeps them and adds a column value."""

    def __init__(self) -> None:
        self._metrics: dict[str, Callable[[DataFrame], DataFrame]] = {}

    def add_metric(self, name: str, metric: Callable[[DataFrame], DataFrame]) -> None:
        if name in self._metrics:
            raise KeyError(f"metric {name} already exists")
        self._metrics[name] = metric

    def names(self) -> list[str]:
        return list(self._metrics)

    def evaluate(self, traces: DataFrame, keys: list[str], errors: bool = False) -> DataFrame:
        """Long table keys, metric, value (and error); a metric that yields nothing for a row is NaN.

        All metrics run in one pass over the traces and are turned into rows at the end. A metric that cannot be
        planned on these traces is NaN for all of them, a failing row of an `array_metric` is NaN; the
        others are not touched. With `errors` the reason is kept beside the value.
        """
        wide, entries = traces, []
        for k, (name, metric) in enumerate(self._metrics.items()):
            value, reason = F.lit(float("nan")), F.lit(None).cast("string")
            try:
                made = metric(wide)
                failed = "error" in made.columns and "error" not in wide.columns
                wide = made.withColumnRenamed("value", f"_value{k}")
                value = F.coalesce(F.col(f"_value{k}").cast("double"), value)
                if failed:
                    wide, reason = wide.withColumnRenamed("error", f"_error{k}"), F.col(f"_error{k}")
            except Exception as cause:
                reason = F.lit(f"{type(cause).__name__}: {cause}"[:200])
            entries.append(F.struct(F.lit(name).alias("metric"), value.alias("value"), *([reason.alias("error")] if errors else [])))
        return wide.select(*keys, F.inline(F.array(*entries)))


def column_metric(expression: Column) -> Callable[[DataFrame], DataFrame]:
    return lambda traces: traces.withColumn("value", expression)


def array_metric(function: Callable[[np.ndarray, np.ndarray], np.ndarray], x: str = "x", obs: str = "obs") -> Callable[[DataFrame], DataFrame]:
    """A metric from a NumPy function of two blocks (rows x samples) that gives a number per row.

    It runs on whole Arrow batches, traces of one length together. If it raises there, the rows of that block are
    tried one by one, and only those that raise are NaN, with the reason in the column `error`. Rows without
    a trace, or with traces of different lengths, are such rows.
    """
    def row_by_row(one: np.ndarray, other: np.ndarray) -> Iterator[tuple[float, str | None]]:
        for a, b in zip(one, other, strict=True):
            try:
                yield float(np.asarray(function(a[None], b[None]), float).reshape(-1)[0]), None
            except Exception as cause:
                yield float("nan"), f"{type(cause).__name__}: {cause}"[:200]

    @F.arrow_udf("struct<value:double,error:string>")
    def job(traces: pa.Array, observed: pa.Array) -> pa.Array:
        values, reasons = np.full(len(traces), np.nan), np.full(len(traces), "ValueError: no two traces of one length", dtype=object)
        for rows, block in blocks(traces):
            for own, other in blocks(observed.take(pa.array(rows))):
                if other.shape[1] != block.shape[1]:
                    continue
                at, one = rows[own], block[own]
                try:
                    found = np.asarray(function(one, other), float)
                    if found.shape != (len(one),):
                        raise ValueError(f"a metric of {len(one)} traces gave {found.shape}")
                    values[at], reasons[at] = found, None
                except Exception:
                    values[at], reasons[at] = zip(*row_by_row(one, other), strict=True)
        return pa.StructArray.from_arrays([pa.array(values), pa.array(reasons.tolist(), pa.string())], ["value", "error"])

    return lambda traces: traces.withColumn("_m", job(x, obs)).withColumns({"value": F.col("_m.value"), "error": F.col("_m.error")}).drop("_m")


def standard_metrics() -> MetricRegistry:
    registry = MetricRegistry()
    registry.add_metric("chi2", column_metric(chi2()))
    registry.add_metric("power misfit", column_metric(power_misfit()))
    registry.add_metric("envelope misfit", envelope_misfit)
    registry.add_metric("mse", column_metric(mse()))
    return registry


def summarise(values: DataFrame, ensembles: DataFrame, ensemble: str = "ens") -> DataFrame:
    """NaN-skipping mean and population variance per (ensemble, metric).

    Every ensemble of `ensembles` appears for every metric; one without values is NaN.
    """
    clean = F.when(~F.isnan("value"), F.col("value"))
    stats = values.groupBy(ensemble, "metric").agg(F.avg(clean).alias("mean"), F.var_pop(clean).alias("var"))
    names = values.agg(F.collect_set("metric")).scalar()  # as many as there are registered metrics
    grid = ensembles.select(ensemble).distinct().withColumn("_names", names).select(ensemble, F.explode("_names").alias("metric"))
    nan = F.lit(float("nan"))
    return grid.join(stats, [ensemble, "metric"], "left").select(
        ensemble, "metric", F.coalesce("mean", nan).alias("mean"), F.coalesce("var", nan).alias("var"))


def wide_means(summary: DataFrame, metrics: list[str], ensemble: str = "ens") -> DataFrame:
    """One row per ensemble with a column <metric>_mean each."""
    return summary.groupBy(ensemble).agg(*[
        F.max(F.when(F.col("metric") == m, F.col("mean"))).alias(f"{m}_mean") for m in metrics])


def normalise_to_best(summary: DataFrame, higher_is_better: list[str] | None = None, include: str | None = None,
                      exclude: tuple = ("var",), value: str = "mean") -> DataFrame:
    """Value over the best of its metric: the smallest, or the largest where higher is better.

    A zero among lower-is-better values makes that metric null.  Infinite is missing.
    """
    name = F.lower("metric")
    kept = summary if include is None else summary.where(name.contains(include.lower()))
    for word in exclude:
        kept = kept.where(~name.contains(word.lower()))
    finite = F.when(~F.isnan(value) & (F.abs(value) != float("inf")), F.col(value))
    kept = kept.withColumn("_v", finite)
    best = kept.groupBy("metric").agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.bool_or(F.col("_v") == 0).alias("_zero"))
    up = F.col("metric").isin(list(higher_is_better or []))
    score = F.when(up, F.when(F.col("_hi") != 0, F.try_divide("_v", "_hi"))).when(~F.col("_zero"), F.try_divide("_v", "_lo"))
    return kept.join(best, "metric").withColumn("score", score).drop("_v", "_lo", "_hi", "_zero")


def best_synthetics(values: DataFrame, groups: list[str], row_id: str, k: int, metric: str | None = "value") -> DataFrame:
    """The k lowest per group, ties by id, NaN last; without a metric the first k by id."""
    keys = [F.col(row_id)] if metric is None else [F.isnan(metric), F.col(metric), F.col(row_id)]
    order = Window.partitionBy(*groups).orderBy(*keys)
    return values.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
