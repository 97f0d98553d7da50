"""Noise statistics and covariance tables."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from quietwave.functions import arrays as A
from quietwave.functions.draws import normal
from quietwave.operators import covariance as V
from quietwave.operators import noise as N
from quietwave.operators.priors import gaussian_noise
from quietwave.plans.registries import NOISE_MODELS, covariance
from workbook.registry import R, ctes, normal_sql, query, records, rnd, traces, uniform_sql
from workbook.traces import checksum

ACF = """acf AS (SELECT a.id, a.station, a.component, b.i - a.i AS k, sum(a.v * b.v) / (64 - (b.i - a.i)) AS c FROM rl a JOIN rl b ON a.id = b.id AND b.i >= a.i GROUP BY 1, 2, 3, 4),
ens AS (SELECT station, component, k, count(*) AS n, avg(c) AS c, stddev_pop(c) AS sd FROM acf GROUP BY 1, 2, 3)"""
KEYS = ["station", "component"]


def ensemble(spark, sf_dir):
    return N.ensemble_autocovariance(N.with_autocovariance(records(spark, sf_dir)), KEYS)


def variances(spark, sf_dir):
    return N.lag_zero(ensemble(spark, sf_dir), KEYS)


VAR0 = "var0 AS (SELECT station, component, c AS variance FROM ens WHERE k = 0)"


@query("trace_variance", ctes("rl") + f" SELECT id, {R('var_pop(v)', 8)} AS variance FROM rl GROUP BY id")
def trace_variance(spark, sf_dir):
    return records(spark, sf_dir).select("id", rnd(N.trace_variance("x"), 8).alias("variance"))


@query("autocovariance", ctes("rl") + f", {ACF} SELECT id, k::INTEGER AS k, {R('c', 8)} AS c FROM acf")
def autocovariance(spark, sf_dir):
    a = N.with_autocovariance(records(spark, sf_dir))
    return a.select("id", F.posexplode("acf").alias("k", "c")).select("id", "k", rnd("c", 8).alias("c"))


@query("ensemble_autocovariance", ctes("rl") + f", {ACF} SELECT station, component, k::INTEGER AS k, n, {R('c', 8)} AS c, {R('sd', 8)} AS sd FROM ens")
def ensemble_autocovariance(spark, sf_dir):
    return ensemble(spark, sf_dir).select("station", "component", "k", "n", rnd("c", 8).alias("c"), rnd("sd", 8).alias("sd"))


@query("mergeable_moments", ctes("lg") + f" SELECT ens, count(*)::BIGINT AS n, {R('avg(v)', 8)} AS mean, {R('stddev_pop(v)', 8)} AS sd FROM lg GROUP BY ens")
def mergeable_moments(spark, sf_dir):
    long = traces(spark, sf_dir).select("ens", "id", F.explode("x").alias("v"))
    batches = N.moments(long, ["ens", "id"], "v")
    merged = N.merge_moments(batches.drop("id"), ["ens"])
    return merged.select("ens", "n", rnd("mean", 8).alias("mean"), rnd("sd", 8).alias("sd"))


@query("lag_zero_variance", ctes("rl") + f", {ACF}, {VAR0} SELECT station, component, {R('variance', 8)} AS variance FROM var0")
def lag_zero_variance(spark, sf_dir):
    return variances(spark, sf_dir).select(*KEYS, rnd("variance", 8).alias("variance"))


@query("covariance_taper_fit", ctes("rl") + f""", {ACF}, y AS (SELECT station, component, k, ln(abs(c)) - ln(abs(first_value(c) OVER (PARTITION BY station, component ORDER BY k))) AS y FROM ens WHERE k < 20),
g AS (SELECT station, component, sum(k * y) / sum(k * k) AS g FROM y GROUP BY 1, 2)
SELECT station, component, k::INTEGER AS k, {R('-g', 5)} AS rate, {R('c * exp(g * k)', 8)} AS fitted, {R('c * exp(-k / 20.0::DOUBLE)', 8)} AS fixed FROM ens JOIN g USING (station, component)""")
def covariance_taper_fit(spark, sf_dir):
    e = ensemble(spark, sf_dir).select(*KEYS, "k", "c")
    fitted = N.taper_covariance(e, KEYS, 20)
    fixed = N.taper_covariance(fitted.withColumnsRenamed({"rate": "fit_rate", "tapered": "fitted"}), KEYS, 20, ols=False)
    return fixed.select(*KEYS, "k", rnd("fit_rate", 5).alias("rate"), rnd("fitted", 8).alias("fitted"), rnd("tapered", 8).alias("fixed"))


@query("band_limited_covariance", ctes("rl") + f""", {ACF}, {VAR0} SELECT station, component, k::INTEGER AS k,
{R('CASE WHEN k = 0 THEN variance * 1.01 ELSE variance / 0.3 / 2 * (sin(2 * pi() * 0.4 * k / 2) - sin(2 * pi() * 0.1 * k / 2)) / (pi() * k / 2) END', 8)} AS c FROM var0 CROSS JOIN generate_series(0, 63) t(k)""")
def band_limited_covariance(spark, sf_dir):
    return N.band_limited_columns(variances(spark, sf_dir), 64, 0.1, 0.4, rate=2.0).select(*KEYS, "k", rnd("c", 8).alias("c"))


@query("damped_cosine_covariance", ctes("rl") + f""", {ACF}, {VAR0} SELECT station, component, k::INTEGER AS k,
{R('variance * exp(-k / 20.0::DOUBLE) * cos(k * 4.4 / 20.0::DOUBLE) * CASE WHEN k = 0 THEN 1.01 ELSE 1 END', 8)} AS c FROM var0 CROSS JOIN generate_series(0, 63) t(k)""")
def damped_cosine_covariance(spark, sf_dir):
    return N.damped_cosine_columns(variances(spark, sf_dir), 64).select(*KEYS, "k", rnd("c", 8).alias("c"))


@query("toeplitz_expansion", ctes("rl") + f""", {ACF}, tt AS (SELECT t FROM generate_series(0, 63) q(t)), uu AS (SELECT t AS u FROM tt)
SELECT station, component, t::INTEGER AS t, {R('sum(c * (u + 1))', 6)} AS checksum FROM tt CROSS JOIN uu JOIN ens ON k = abs(t - u) GROUP BY 1, 2, 3""")
def toeplitz_expansion(spark, sf_dir):
    rows = V.toeplitz_rows(ensemble(spark, sf_dir).select(*KEYS, "k", "c"), KEYS)
    return rows.select(*KEYS, "t", rnd(checksum("row")).alias("checksum"))


THEORY = """mean0 AS (SELECT station, i, avg(v) AS m FROM rl GROUP BY 1, 2), rs AS (SELECT rl.station, rl.id, rl.i, rl.v - m AS r FROM rl JOIN mean0 USING (station, i)),
theory AS (SELECT a.station, a.i AS t, b.i AS u, sum(a.r * b.r) / (count(*) - 1) AS c FROM rs a JOIN rs b ON a.id = b.id GROUP BY 1, 2, 3)"""


def theory(spark, sf_dir):
    return V.theory_covariance(records(spark, sf_dir).select("station", "x"), ["station"])


@query("theory_covariance", ctes("rl") + f", {THEORY} SELECT station, t::INTEGER AS t, {R('sum(c * (u + 1))', 7)} AS checksum, {R('sum(c * c)', 8)} AS power FROM theory GROUP BY station, t")
def theory_covariance(spark, sf_dir):
    return theory(spark, sf_dir).select("station", "t", rnd(checksum("row"), 7).alias("checksum"), rnd(A.power("row"), 8).alias("power"))


@query("covariance_sum", ctes("rl") + f""", {THEORY}, v0 AS (SELECT station, avg(v * v) AS v FROM rl GROUP BY 1), top AS (SELECT station, max(c) AS top FROM theory WHERE t = u GROUP BY 1)
SELECT station, t::INTEGER AS t, {R('sum((c + CASE WHEN t = u THEN v + top * 0.001 ELSE 0 END) * (u + 1))', 7)} AS checksum FROM theory JOIN v0 USING (station) JOIN top USING (station) GROUP BY 1, 2""")
def covariance_sum(spark, sf_dir):
    power = records(spark, sf_dir).select("station", F.explode("x").alias("v")).groupBy("station").agg(F.avg(F.col("v") * F.col("v")).alias("variance"))
    return V.add_covariances(theory(spark, sf_dir), V.diagonal_rows(power, ["station"], 64), ["station"]).select("station", "t", rnd(checksum("row"), 7).alias("checksum"))


RHO = "exp(-1 / 20.0::DOUBLE)"
AR1 = f"""pw AS (SELECT station, component, avg(v * v) AS variance FROM rl GROUP BY 1, 2), lead0 AS (SELECT rl.id, rl.station, rl.component, i, v, lag(v) OVER (PARTITION BY rl.id ORDER BY i) AS p FROM rl),
chi AS (SELECT l.id, l.station, l.component, sum(CASE WHEN p IS NULL THEN v * v ELSE pow(v - {RHO} * p, 2) / (1 - {RHO} * {RHO}) END) / max(variance) AS chi2 FROM lead0 l JOIN pw USING (station, component) GROUP BY 1, 2, 3)"""


def _exponential(spark, sf_dir):
    power = records(spark, sf_dir).select(*KEYS, F.explode("x").alias("v")).groupBy(*KEYS).agg(F.avg(F.col("v") * F.col("v")).alias("variance"))
    return power, N.damped_cosine_columns(power, 64, omega=0.0, jitter=0.0).select(*KEYS, "k", "c")


@query("toeplitz_chi2", ctes("rl") + f", {AR1} SELECT id, {R('chi2', 5)} AS chi2, {R('-chi2 / 2', 5)} AS log_likelihood, {R('chi2 / 64', 6)} AS reduced FROM chi")
def toeplitz_chi2(spark, sf_dir):
    _, cov = _exponential(spark, sf_dir)
    solved = V.solve_toeplitz(records(spark, sf_dir), cov, KEYS)
    chi = A.dot("x", "y")
    return solved.select("id", rnd(chi, 5).alias("chi2"), rnd(-chi / 2, 5).alias("log_likelihood"), rnd(chi / 64, 6).alias("reduced"))


@query("dense_block_chi2", ctes("rl") + f", {AR1} SELECT id, {R('chi2', 5)} AS chi2 FROM chi")
def dense_block_chi2(spark, sf_dir):
    _, cov = _exponential(spark, sf_dir)
    solved = V.apply_blocks(records(spark, sf_dir), V.toeplitz_rows(cov, KEYS), KEYS, "solve")
    return solved.select("id", rnd(A.dot("x", "y"), 5).alias("chi2"))


# A third of the records has a null station, with a covariance of its own; another third a station without one.
_LOST = "CASE id % 3 WHEN 0 THEN NULL WHEN 1 THEN -1 ELSE station END"
_LOST_SQL = f"""nk AS (SELECT id, {_LOST} AS station, x FROM rec), nl AS (SELECT id, station, unnest(x) AS v, generate_subscripts(x, 1) - 1 AS i FROM nk),
np AS (SELECT station, avg(v * v) AS variance FROM nl WHERE station IS NULL OR station >= 0 GROUP BY 1), nd AS (SELECT id, station, i, v, lag(v) OVER (PARTITION BY id ORDER BY i) AS p FROM nl)
SELECT nd.id, {R(f'sum(CASE WHEN p IS NULL THEN v * v ELSE pow(v - {RHO} * p, 2) / (1 - {RHO} * {RHO}) END) / max(variance)', 5)} AS chi2 FROM nd LEFT JOIN np ON nd.station IS NOT DISTINCT FROM np.station GROUP BY nd.id"""


def _lost(spark, sf_dir):
    lost = records(spark, sf_dir).select("id", F.expr(_LOST).alias("station"), "x")
    power = lost.where("station IS NULL OR station >= 0").select("station", F.explode("x").alias("v")).groupBy("station").agg(F.avg(F.col("v") * F.col("v")).alias("variance"))
    return lost, N.damped_cosine_columns(power, 64, omega=0.0, jitter=0.0).select("station", "k", "c")


@query("toeplitz_chi2_unmatched", ctes("rec") + ", " + _LOST_SQL)
def toeplitz_chi2_unmatched(spark, sf_dir, **way):
    lost, cov = _lost(spark, sf_dir)
    return V.solve_toeplitz(lost, cov, ["station"], **way).select("id", rnd(A.dot("x", "y"), 5).alias("chi2"))


@query("dense_block_chi2_unmatched", ctes("rec") + ", " + _LOST_SQL)
def dense_block_chi2_unmatched(spark, sf_dir, **way):
    lost, cov = _lost(spark, sf_dir)
    return V.apply_blocks(lost, V.toeplitz_rows(cov, ["station"]), ["station"], "solve", **way).select("id", rnd(A.dot("x", "y"), 5).alias("chi2"))


query("dense_block_chi2_grouped", ctes("rec") + ", " + _LOST_SQL)(partial(dense_block_chi2_unmatched, memory=0, part_samples=64 * 20))


@query("theory_covariance_null_key", ctes("rec") + f""", nk AS (SELECT id, {_LOST} AS station, x FROM rec), rl AS (SELECT id, station, unnest(x) AS v, generate_subscripts(x, 1) - 1 AS i FROM nk),
mean0 AS (SELECT station, i, avg(v) AS m FROM rl GROUP BY 1, 2), rs AS (SELECT rl.station, rl.id, rl.i, rl.v - m AS r FROM rl JOIN mean0 ON rl.i = mean0.i AND rl.station IS NOT DISTINCT FROM mean0.station),
theory AS (SELECT a.station, a.i AS t, b.i AS u, sum(a.r * b.r) / (count(*) - 1) AS c FROM rs a JOIN rs b ON a.id = b.id GROUP BY 1, 2, 3)
SELECT station, t::INTEGER AS t, {R('sum(c * (u + 1))', 7)} AS checksum, {R('sum(c * c)', 8)} AS power FROM theory GROUP BY station, t""")
def theory_covariance_null_key(spark, sf_dir):
    lost = records(spark, sf_dir).select(F.expr(_LOST).alias("station"), "x")
    made = V.theory_covariance(lost, ["station"])
    return made.select("station", "t", rnd(checksum("row"), 7).alias("checksum"), rnd(A.power("row"), 8).alias("power"))


@query("diagonal_chi2", ctes("rl") + f", pw AS (SELECT station, component, avg(v * v) AS variance FROM rl GROUP BY 1, 2) SELECT id, {R('sum(v * v) / max(variance)', 6)} AS chi2, {R('sum(v * (i + 1)) / max(variance)', 5)} AS solved FROM rl JOIN pw USING (station, component) GROUP BY id")
def diagonal_chi2(spark, sf_dir):
    power, _ = _exponential(spark, sf_dir)
    joined = records(spark, sf_dir).join(power, KEYS).withColumn("y", A.over_scalar("x", F.col("variance")))
    return joined.select("id", rnd(A.dot("x", "y")).alias("chi2"), rnd(checksum("y"), 5).alias("solved"))


@query("chi2_per_trace", ctes("rl") + f", {AR1} SELECT station, component, {R('avg(chi2)', 5)} AS chi2, {R('max(sqrt(variance))', 7)} AS noise_level FROM chi JOIN pw USING (station, component) GROUP BY 1, 2")
def chi2_per_trace(spark, sf_dir):
    power, cov = _exponential(spark, sf_dir)
    solved = V.solve_toeplitz(records(spark, sf_dir), cov, KEYS).withColumn("chi2", A.dot("x", "y"))
    return solved.groupBy(*KEYS).agg(F.avg("chi2").alias("_c")).join(power, KEYS).select(
        *KEYS, rnd("_c", 5).alias("chi2"), rnd(F.sqrt("variance"), 7).alias("noise_level"))


@query("inverse_covariance_product", ctes("rl") + f""", pw AS (SELECT station, component, avg(v * v) AS variance FROM rl GROUP BY 1, 2),
n AS (SELECT rl.id, rl.station, rl.component, i, v, coalesce(lag(v) OVER w, 0) AS p, coalesce(lead(v) OVER w, 0) AS q FROM rl WINDOW w AS (PARTITION BY rl.id ORDER BY i))
SELECT id, i::INTEGER AS i, {R(f'((CASE WHEN i IN (0, 63) THEN 1 ELSE 1 + {RHO} * {RHO} END) * v - {RHO} * (p + q)) / (1 - {RHO} * {RHO}) / variance', 4)} AS y FROM n JOIN pw USING (station, component)""")
def inverse_covariance_product(spark, sf_dir):
    _, cov = _exponential(spark, sf_dir)
    solved = V.solve_toeplitz(records(spark, sf_dir), cov, KEYS)
    return solved.select("id", F.posexplode("y").alias("i", "y")).select("id", "i", rnd("y", 4).alias("y"))


@query("adaptive_trace_scaling", ctes("rl") + f""", nv AS (SELECT station, component, avg(v * v) AS nv FROM rl GROUP BY 1, 2), ev AS (SELECT station, component, max(v * v) AS ev FROM rl WHERE i = 0 GROUP BY 1, 2)
SELECT id, {R('sum(v * (i + 1)) / sqrt(max(nv) / max(ev))', 5)} AS checksum FROM rl JOIN nv USING (station, component) JOIN ev USING (station, component) GROUP BY id""")
def adaptive_trace_scaling(spark, sf_dir):
    power, _ = _exponential(spark, sf_dir)
    target = records(spark, sf_dir).groupBy(*KEYS).agg(F.max(F.col("x")[0] * F.col("x")[0]).alias("variance"))
    return N.rescale_traces(records(spark, sf_dir), power, target, KEYS).select("id", rnd(checksum("x"), 5).alias("checksum"))


@query("adaptive_covariance_scaling", ctes("rl") + f""", {ACF}, ev AS (SELECT station, component, max(v * v) AS ev FROM rl WHERE i = 0 GROUP BY 1, 2), c0 AS (SELECT station, component, c AS c0 FROM ens WHERE k = 0)
SELECT station, component, k::INTEGER AS k, {R('c * ev / c0', 8)} AS c FROM ens JOIN ev USING (station, component) JOIN c0 USING (station, component)""")
def adaptive_covariance_scaling(spark, sf_dir):
    target = records(spark, sf_dir).groupBy(*KEYS).agg(F.max(F.col("x")[0] * F.col("x")[0]).alias("variance"))
    return N.rescale_columns(ensemble(spark, sf_dir).select(*KEYS, "k", "c"), target, KEYS).select(*KEYS, "k", rnd("c", 8).alias("c"))


@query("station_time_shift_draws", ctes("rec") + f""", s AS (SELECT id, station, round_even({normal_sql('id', 'shift.array')} * 3, 0)::INTEGER AS a, trunc(-2 + 4 * {uniform_sql('id, station', 'shift.station')})::INTEGER AS b FROM rec)
SELECT id, station, (a + b)::INTEGER AS shift FROM s""")
def station_time_shift_draws(spark, sf_dir):
    return N.with_station_shift(records(spark, sf_dir), ["id"], "station", 3.0, 2.0, "shift").select("id", "station", "shift")


@query("gaussian_noise_scalar", ctes("tr") + f", z AS (SELECT id, i, {normal_sql('id, i', 'white')} * (1 + ens) AS v FROM tr CROSS JOIN generate_series(0, 15) g(i)) SELECT id, {R('sum(v * (i + 1))', 5)} AS checksum, {R('sum(v * v)', 5)} AS power FROM z GROUP BY id")
def gaussian_noise_scalar(spark, sf_dir):
    z = gaussian_noise(traces(spark, sf_dir), ["id"], 16, 1 + F.col("ens"), "white")
    return z.select("id", rnd(checksum("noise"), 5).alias("checksum"), rnd(A.power("noise"), 5).alias("power"))


@query("gaussian_noise_blocks", ctes("rl") + f""", pw AS (SELECT station, component, avg(v * v) AS variance FROM rl GROUP BY 1, 2), z AS (SELECT id, station, component, j, {normal_sql('id, j', 'coloured')} AS z FROM rec CROSS JOIN generate_series(0, 63) g(j)),
y AS (SELECT z.id, i, sum(z.z * sqrt(variance) * pow({RHO}, i - z.j) * CASE WHEN z.j = 0 THEN 1 ELSE sqrt(1 - {RHO} * {RHO}) END) AS v FROM z JOIN pw USING (station, component) JOIN generate_series(0, 63) q(i) ON i >= z.j GROUP BY z.id, i)
SELECT id, {R('sum(v * (i + 1))', 5)} AS checksum, {R('sum(v * v)', 6)} AS power FROM y GROUP BY id""")
def gaussian_noise_blocks(spark, sf_dir):
    _, cov = _exponential(spark, sf_dir)
    white = records(spark, sf_dir).select("id", *KEYS, F.transform(F.sequence(F.lit(0), F.lit(63)), lambda j: normal(["id", j], "coloured")).alias("x"))
    coloured = V.apply_blocks(white, V.toeplitz_rows(cov, KEYS), KEYS, "colour")
    return coloured.select("id", rnd(checksum("y"), 5).alias("checksum"), rnd(A.power("y")).alias("power"))


_CHOICES = ("noise_level", "empirical_diagonal", "empirical_block", "filtered_block", "kolb", "theory_block")


@query("covariance_registry", ctes("rl") + f""", {ACF}, {VAR0}, {THEORY}, tu AS (SELECT t, u FROM generate_series(0, 63) a(t) CROSS JOIN generate_series(0, 63) b(u)),
b AS (SELECT station, component, t, u, 'noise_level' AS name, CASE WHEN t = u THEN 4 ELSE 0 END AS c FROM var0 CROSS JOIN tu UNION ALL SELECT station, component, t, u, 'empirical_diagonal', CASE WHEN t = u THEN variance ELSE 0 END FROM var0 CROSS JOIN tu
 UNION ALL SELECT station, component, t, u, 'empirical_block', c * exp(-k / 20.0::DOUBLE) FROM ens JOIN tu ON k = abs(t - u)
 UNION ALL SELECT station, component, t, u, 'filtered_block', CASE WHEN t = u THEN variance * 1.01 ELSE variance / 0.06 * (sin(2 * pi() * 0.05 * abs(t - u)) - sin(2 * pi() * 0.02 * abs(t - u))) / (pi() * abs(t - u)) END FROM var0 CROSS JOIN tu
 UNION ALL SELECT station, component, t, u, 'kolb', variance * exp(-abs(t - u) / 20.0::DOUBLE) * cos(abs(t - u) * 0.22) * CASE WHEN t = u THEN 1.01 ELSE 1 END FROM var0 CROSS JOIN tu
 UNION ALL SELECT v.station, v.component, x.t, x.u, 'theory_block', x.c + CASE WHEN x.t = x.u THEN variance ELSE 0 END FROM var0 v JOIN theory x ON x.station = v.station)
SELECT name, station, component, {R('sum(c * (u + 1) * (t + 2))', 3)} AS checksum FROM b GROUP BY 1, 2, 3""")
def covariance_registry(spark, sf_dir):
    cov = ensemble(spark, sf_dir).select(*KEYS, "k", "c")
    spread = theory(spark, sf_dir).join(cov.select(*KEYS).distinct(), "station")
    out = None
    for name in _CHOICES:
        options = {"noise_level": 2.0} if name == "noise_level" else {"theory": spread, "data": "empirical_diagonal"} if name == "theory_block" else {}
        rows = covariance(name, cov, KEYS, 64, **options)
        part = rows.groupBy(*KEYS).agg(rnd(F.sum(checksum("row") * (F.col("t") + 2)), 3).alias("checksum")).select(F.lit(name).alias("name"), *KEYS, "checksum")
        out = part if out is None else out.unionByName(part)
    return out


@query("noise_registry", ctes("rl") + f""", w AS (SELECT id, {R('sum(z * (k + 1)) * 0.5', 5)} AS white FROM (SELECT id, k, {normal_sql('id, k', 'registry')} AS z FROM tr CROSS JOIN generate_series(0, 63) q(k)) GROUP BY id),
n AS (SELECT id AS noise_id, row_number() OVER (ORDER BY id) - 1 AS idx FROM tr) SELECT w.id, white, 7::BIGINT AS real_idx, noise_id FROM w CROSS JOIN n WHERE idx = 7""")
def noise_registry(spark, sf_dir):
    t = traces(spark, sf_dir).select("id", "x")
    white = NOISE_MODELS["gaussian"](t.select("id"), ["id"], 64, "registry", noise_level=0.5)
    catalogue = t.select(F.col("id").alias("noise_id"), F.col("x").alias("noise"))
    real = NOISE_MODELS["real_noise"](t.select("id"), ["id"], 64, "registry", catalogue=catalogue, order=["noise_id"], fixed=7)
    return white.select("id", rnd(checksum("noise"), 5).alias("white")).join(real.select("id", F.col("noise_idx").alias("real_idx"), "noise_id"), "id")
