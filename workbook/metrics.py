"""Predictive metrics of every trace against the mean trace of its ensemble."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from quietwave.operators import metrics as K
from quietwave.operators.covariance import mean_vectors
from quietwave.operators.traces import split_record
from workbook.registry import R, ctes, query, rnd, traces

OBS = "ob AS (SELECT ens, i, avg(v) AS o FROM lg GROUP BY ens, i), j AS (SELECT lg.id, lg.ens, lg.i, lg.v, ob.o FROM lg JOIN ob USING (ens, i))"
CHI = f"SELECT id, ens, sum(pow(v - o, 2)) / 64 AS chi2, abs(sum(o * o) + 1e-12 - sum(v * v)) / (sum(o * o) + 1e-12) AS power, avg(pow(v - o, 2)) AS mse FROM j GROUP BY id, ens"
# analytic signal: the DFT without negative frequencies, summed back
ENV = """kk AS (SELECT k FROM generate_series(0, 32) g(k)), both_s AS (SELECT id, i, v FROM lg UNION ALL SELECT -1 - ens, i, o FROM ob),
sp AS (SELECT id, k, sum(v * cos(2 * pi() * k * i / 64)) AS re, -sum(v * sin(2 * pi() * k * i / 64)) AS im FROM both_s CROSS JOIN kk GROUP BY id, k),
an AS (SELECT id, m AS i, sum(CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END * (re * cos(2 * pi() * k * m / 64) - im * sin(2 * pi() * k * m / 64))) / 64 AS a,
 sum(CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END * (re * sin(2 * pi() * k * m / 64) + im * cos(2 * pi() * k * m / 64))) / 64 AS b FROM sp CROSS JOIN generate_series(0, 63) g(m) GROUP BY id, m),
env AS (SELECT id, i, sqrt(a * a + b * b) AS e FROM an),
em AS (SELECT t.id, t.ens, avg(abs(o.e - s.e) / (o.e + 1e-12)) AS envelope FROM tr t JOIN env s ON s.id = t.id JOIN env o ON o.id = -1 - t.ens AND o.i = s.i GROUP BY 1, 2)"""


def observed(spark, sf_dir):
    t = traces(spark, sf_dir)
    return t.join(mean_vectors(t, ["ens"]).withColumnRenamed("x", "obs"), "ens")


@query("reduced_chi2", ctes("lg") + f", {OBS} SELECT id, {R('sum(pow(v - o, 2)) / 64', 7)} AS chi2, {R('sum(pow(v - o, 2)) / 0.015 / 60', 6)} AS scaled FROM j GROUP BY id")
def reduced_chi2(spark, sf_dir):
    o = observed(spark, sf_dir).withColumn("variance", F.lit(0.015))
    return o.select("id", rnd(K.chi2(), 7).alias("chi2"), rnd(K.chi2(variance="variance", dof=F.lit(60))).alias("scaled"))


@query("correlation_misfit", ctes("lg") + f", {OBS}, c AS (SELECT id, i // 16 AS trace, corr(v, o) AS r FROM j GROUP BY 1, 2) SELECT id, {R('avg(1 - r)')} AS value FROM c GROUP BY id")
def correlation_misfit(spark, sf_dir):
    o = observed(spark, sf_dir)
    cut = split_record(o.select("id", "x"), 4).join(split_record(o.select("id", F.col("obs").alias("x")), 4).withColumnRenamed("x", "obs"), ["id", "trace"])
    return K.correlation_misfit(cut, ["id"]).select("id", rnd("value").alias("value"))


@query("whole_record_correlation", ctes("lg") + f", {OBS} SELECT id, {R('1 - corr(v, o)')} AS value FROM j GROUP BY id")
def whole_record_correlation(spark, sf_dir):
    return K.correlation_misfit(observed(spark, sf_dir), ["id"]).select("id", rnd("value").alias("value"))


@query("power_misfit_and_mse", ctes("lg") + f", {OBS}, c AS ({CHI}) SELECT id, {R('power', 5)} AS power_misfit, {R('mse', 7)} AS mse FROM c")
def power_misfit_and_mse(spark, sf_dir):
    return observed(spark, sf_dir).select("id", rnd(K.power_misfit(), 5).alias("power_misfit"), rnd(K.mse(), 7).alias("mse"))


_PSD = """bd AS (SELECT id, i, (v - avg(v) OVER (PARTITION BY id)) * (0.5 - 0.5 * cos(2 * pi() * i / 64)) AS v FROM (SELECT id, i, v FROM lg UNION ALL SELECT -1 - ens, i, o FROM ob)),
pd AS (SELECT id, k, CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END * (pow(sum(v * cos(2 * pi() * k * i / 64)), 2) + pow(sum(v * sin(2 * pi() * k * i / 64)), 2)) / 24 AS p FROM bd CROSS JOIN generate_series(0, 32) g(k) GROUP BY id, k),
bp AS (SELECT id, sum(CASE WHEN a.k / 64.0 >= 0.05 AND (a.k + 1) / 64.0 < 0.2 THEN (p + q) / 128 ELSE 0 END) + 1e-12 AS b1, sum(CASE WHEN a.k / 64.0 >= 0.2 THEN (p + q) / 128 ELSE 0 END) + 1e-12 AS b2
 FROM (SELECT id, k, p, lead(p) OVER (PARTITION BY id ORDER BY k) AS q FROM pd) a WHERE q IS NOT NULL GROUP BY id)"""


@query("band_power_misfit", ctes("lg") + f", {OBS}, {_PSD} SELECT t.id, {R('(abs(o.b1 - s.b1) / o.b1 + abs(o.b2 - s.b2) / o.b2) / 2', 5)} AS value FROM tr t JOIN bp s ON s.id = t.id JOIN bp o ON o.id = -1 - t.ens")
def band_power_misfit(spark, sf_dir):
    return K.band_power_misfit(observed(spark, sf_dir), 1.0, [(0.05, 0.2), (0.2, 1.0)]).select("id", rnd("value", 5).alias("value"))


@query("envelope_misfit", ctes("lg") + f", {OBS}, {ENV} SELECT id, {R('envelope', 5)} AS value FROM em")
def envelope_misfit(spark, sf_dir):
    return K.envelope_misfit(observed(spark, sf_dir)).select("id", rnd("value", 5).alias("value"))


@query("autocorrelation_misfit", ctes("lg") + f""", {OBS}, s AS (SELECT id, i, v - avg(v) OVER (PARTITION BY id) AS v FROM (SELECT id, i, v FROM lg UNION ALL SELECT -1 - ens, i, o FROM ob)),
a AS (SELECT l.id, r.i - l.i AS k, sum(l.v * r.v) AS c FROM s l JOIN s r ON l.id = r.id AND r.i - l.i BETWEEN 0 AND 50 GROUP BY 1, 2), n AS (SELECT a.id, a.k, a.c / (z.c + 1e-12) AS c FROM a JOIN a z ON a.id = z.id AND z.k = 0 WHERE a.k > 0)
SELECT t.id, {R('avg(abs(p.c - q.c))')} AS value FROM tr t JOIN n p ON p.id = t.id JOIN n q ON q.id = -1 - t.ens AND q.k = p.k GROUP BY t.id""")
def autocorrelation_misfit(spark, sf_dir):
    return K.autocorrelation_misfit(observed(spark, sf_dir)).select("id", rnd("value").alias("value"))


def summary(spark, sf_dir):
    values = K.standard_metrics().evaluate(observed(spark, sf_dir), ["ens", "id"])
    return K.summarise(values, traces(spark, sf_dir))


_LONG = f""", {OBS}, {ENV}, c AS ({CHI}), vals AS (SELECT ens, 'chi2' AS metric, chi2 AS value FROM c UNION ALL SELECT ens, 'power misfit', power FROM c UNION ALL SELECT ens, 'envelope misfit', envelope FROM em UNION ALL SELECT ens, 'mse', mse FROM c),
sm AS (SELECT ens, metric, avg(value) AS mean, var_pop(value) AS var FROM vals GROUP BY 1, 2)"""


@query("metric_summary", ctes("lg") + _LONG + f" SELECT ens, metric, {R('mean', 5)} AS mean, {R('var', 4)} AS var FROM sm")
def metric_summary(spark, sf_dir):
    return summary(spark, sf_dir).select("ens", "metric", rnd("mean", 5).alias("mean"), rnd("var", 4).alias("var"))


@query("metric_means_wide", ctes("lg") + _LONG + f" SELECT ens, {R("max(CASE WHEN metric = 'chi2' THEN mean END)", 6)} AS chi2_mean, {R("max(CASE WHEN metric = 'mse' THEN mean END)", 6)} AS mse_mean FROM sm GROUP BY ens")
def metric_means_wide(spark, sf_dir):
    wide = K.wide_means(summary(spark, sf_dir), ["chi2", "mse"])
    return wide.select("ens", rnd("chi2_mean").alias("chi2_mean"), rnd("mse_mean").alias("mse_mean"))


@query("metrics_normalised_to_best", ctes("lg") + _LONG + f" SELECT ens, metric, {R("CASE WHEN metric = 'mse' THEN mean / max(mean) OVER (PARTITION BY metric) ELSE mean / min(mean) OVER (PARTITION BY metric) END", 5)} AS score FROM sm WHERE metric NOT LIKE '%power%'")
def metrics_normalised_to_best(spark, sf_dir):
    scored = K.normalise_to_best(summary(spark, sf_dir), higher_is_better=["mse"], exclude=("var", "power"))
    return scored.select("ens", "metric", rnd("score", 5).alias("score"))


@query("custom_metric_registry", ctes("lg") + f", {OBS} SELECT ens, 'peak' AS metric, {R('avg(p)')} AS mean FROM (SELECT id, ens, abs(max(abs(v)) - max(abs(o))) AS p FROM j GROUP BY 1, 2) GROUP BY ens")
def custom_metric_registry(spark, sf_dir):
    registry = K.MetricRegistry()
    top = lambda c: F.array_max(F.transform(c, lambda v: F.abs(v)))
    registry.add_metric("peak", K.column_metric(F.abs(top("x") - top("obs"))))
    values = registry.evaluate(observed(spark, sf_dir), ["ens", "id"])
    return K.summarise(values, traces(spark, sf_dir)).select("ens", "metric", rnd("mean").alias("mean"))


@query("metrics_that_fail", ctes("lg") + f""", {OBS}, m AS (SELECT id, ens, avg(abs(v - o)) AS away, max(abs(v)) AS peak, max(CASE WHEN i = 0 THEN v END) AS head FROM j GROUP BY 1, 2)
SELECT id, metric, {R("CASE metric WHEN 'away' THEN away WHEN 'picky' THEN CASE WHEN head <= 0 THEN peak END END")} AS value, metric = 'broken' OR (metric = 'picky' AND head > 0) AS failed FROM m CROSS JOIN (SELECT unnest(['away', 'picky', 'broken']) AS metric)""")
def metrics_that_fail(spark, sf_dir):
    """One metric that works, one that raises for half of the rows, and one on a column that is not there."""
    def picky(x, obs):
        if (x[:, 0] > 0).any():
            raise ArithmeticError("starts above zero")
        return np.abs(x).max(axis=1)

    registry = K.MetricRegistry()
    registry.add_metric("away", K.array_metric(lambda x, obs: np.abs(x - obs).mean(axis=1)))
    registry.add_metric("picky", K.array_metric(picky))
    registry.add_metric("broken", K.column_metric(F.col("not_there")))
    values = registry.evaluate(observed(spark, sf_dir), ["id"], errors=True)
    return values.select("id", "metric", rnd(F.when(~F.isnan("value"), F.col("value"))).alias("value"), F.col("error").isNotNull().alias("failed"))


@query("best_synthetics", ctes("lg") + f", {OBS}, c AS ({CHI}), r AS (SELECT ens, id, chi2, row_number() OVER (PARTITION BY ens ORDER BY chi2, id) AS rank FROM c) SELECT ens, id, rank::INTEGER AS rank, {R('chi2', 7)} AS chi2 FROM r WHERE rank <= 20")
def best_synthetics(spark, sf_dir):
    values = observed(spark, sf_dir).select("ens", "id", K.chi2().alias("value"))
    return K.best_synthetics(values, ["ens"], "id", 20).select("ens", "id", "rank", rnd("value", 7).alias("chi2"))
