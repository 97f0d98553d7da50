"""Posterior evaluation: z-scores, coverage, densities, histograms, chain tables."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from quietwave.operators import covariance as V
from quietwave.operators import pairing as J
from quietwave.operators import posterior as P
from quietwave.operators import quality as Q
from quietwave.operators.ordering import ranked
from quietwave.plans.evaluation import tensor_posterior_scores
from workbook.registry import R, ctes, query, rnd, sims, table, tensor_truth, tensors, traces, uniform_sql
from workbook.tensors import ALIGN, EIG, _renamed, _w, planes_sql

# normal distribution function by Simpson's rule on 2000 steps
PHI = "(0.5 + (SELECT sum(CASE WHEN n IN (0, 2000) THEN 1 WHEN n % 2 = 1 THEN 4 ELSE 2 END * exp(-pow({z} * n / 2000.0::DOUBLE, 2) / 2)) * ({z}) / 6000.0::DOUBLE FROM generate_series(0, 2000) q(n)) / sqrt(2 * pi()))"


def long_theta(spark, sf_dir):
    return sims(spark, sf_dir).select("id", "ens", F.posexplode("theta").alias("pos", "value"))


TH = "th AS (SELECT id, ens, unnest(theta) AS value, generate_subscripts(theta, 1) - 1 AS pos FROM sims)"


@query("bias_and_z_linear", ctes("sims") + f""", {TH}, b AS (SELECT ens, pos, avg(value - 0.01 * pos) AS mu, greatest(stddev_samp(value - 0.01 * pos), 1e-12) AS sd FROM th GROUP BY 1, 2)
SELECT ens, pos::INTEGER AS pos, {R('mu')} AS mu, {R('sd')} AS sd, {R('mu / sd', 5)} AS z, {R(PHI.format(z='(mu / sd)'), 6)} AS u FROM b""")
def bias_and_z_linear(spark, sf_dir):
    long = long_theta(spark, sf_dir).withColumn("truth", F.col("pos") * 0.01).withColumn("period", F.lit(None).cast("double"))
    b = P.bias_table(long, ["ens", "pos"])
    return b.select("ens", "pos", rnd("mu").alias("mu"), rnd("sd").alias("sd"), rnd("z", 5).alias("z"), rnd("u").alias("u"))


def _rename_eig(sql: str) -> str:
    return re.sub(r"\b(u|co|it|l|eig|src)\b(?=[ .(,)]|$)", lambda m: "t" + m.group(1), sql.replace("FROM mt)", "FROM tt)"), flags=re.M)


TSRC = _rename_eig(EIG)


@query("tensor_bias_and_z", ctes("mt", "truth") + ", " + planes_sql("mt") + ", " + ALIGN + ", " + EIG + ", " + TSRC + f""",
s AS (SELECT a.ens, src.gamma, src.delta, (log10(src.nrm / sqrt(2)) + 6.9) / 1.5 AS mw, a.strike, a.dip, a.rake, t.gamma AS tg, t.delta AS td, (log10(t.nrm / sqrt(2)) + 6.9) / 1.5 AS tm, a.true_strike AS ts, a.true_dip AS tdip, a.true_rake AS tr0
 FROM al a JOIN src USING (id) JOIN tsrc t ON t.id = a.ens),
r AS (SELECT ens, 'gamma' AS quantity, {_w('gamma - tg', 60.0)} AS res, gamma AS v, 60.0 AS p FROM s UNION ALL SELECT ens, 'delta', {_w('delta - td', 180.0)}, delta, 180.0 FROM s UNION ALL SELECT ens, 'Mw', mw - tm, mw, NULL FROM s
 UNION ALL SELECT ens, 'strike', {_w('strike - ts')}, strike, 360.0 FROM s UNION ALL SELECT ens, 'dip', dip - tdip, dip, NULL FROM s UNION ALL SELECT ens, 'rake', {_w('rake - tr0')}, rake, 360.0 FROM s)
SELECT ens, quantity, {R('avg(res)', 2)} AS mu, {R('avg(res) / stddev_samp(res)', 3)} AS z, {R('CASE WHEN max(p) IS NULL THEN stddev_samp(v) ELSE max(p) / (2 * pi()) * sqrt(-2 * ln(sqrt(pow(avg(cos(v * 2 * pi() / p)), 2) + pow(avg(sin(v * 2 * pi() / p)), 2)))) END', 2)} AS spread FROM r GROUP BY 1, 2""")
def tensor_bias_and_z(spark, sf_dir):
    b = tensor_posterior_scores(tensors(spark, sf_dir), tensor_truth(spark, sf_dir), ["ens"])
    return b.select("ens", "quantity", rnd("mu", 2).alias("mu"), rnd("z", 3).alias("z"), rnd("spread", 2).alias("spread"))


@query("ordered_z_scores", ctes("sims") + f""", {TH}, o AS (SELECT pos, value * 20 AS z, row_number() OVER (PARTITION BY pos ORDER BY value, id) AS i FROM th)
SELECT pos::INTEGER AS pos, i, {R('greatest(-5.8, least(5.8, z))', 5)} AS z FROM o""")
def ordered_z_scores(spark, sf_dir):
    scores = long_theta(spark, sf_dir).select("id", "pos", (F.col("value") * 20).alias("z"))
    return P.ordered_z(scores, ["pos"]).select("pos", "i", rnd("z", 5).alias("z"))


@query("expected_normal_order", ctes("sims") + f""", {TH}, n AS (SELECT pos, count(*) AS n FROM th GROUP BY pos), grid AS (SELECT k, -6 + k * 0.002::DOUBLE AS z FROM generate_series(0, 6000) g(k)),
dens AS (SELECT k, z, exp(-z * z / 2) / sqrt(2 * pi()) AS f FROM grid), cum AS (SELECT k, z, f, sum(f) OVER (ORDER BY k) * 0.002 - f * 0.001 + 9.865876450376946e-10 - 1.2e-12 AS cdf FROM dens),
o AS (SELECT pos, unnest(generate_series(1, n)) AS i, n FROM n), near AS (SELECT o.pos, o.i, (o.i - 0.5::DOUBLE) / o.n AS p, arg_max(z, cdf) AS z0, max(cdf) AS c0 FROM o JOIN cum ON cdf <= (o.i - 0.5::DOUBLE) / o.n GROUP BY 1, 2, 3)
SELECT pos::INTEGER AS pos, i, {R('z0 + (p - c0) / (exp(-z0 * z0 / 2) / sqrt(2 * pi())) * (1 + z0 * (p - c0) / (exp(-z0 * z0 / 2) / sqrt(2 * pi())) / 2)', 3)} AS expected FROM near""")
def expected_normal_order(spark, sf_dir):
    scores = long_theta(spark, sf_dir).select("id", "pos", (F.col("value") * 20).alias("z"))
    return P.ordered_z(scores, ["pos"]).select("pos", "i", rnd("expected", 3).alias("expected"))


@query("weighted_mean_covariance", ctes("sims") + f""", w AS (SELECT id, ens, theta, (1 + id % 4)::DOUBLE AS w FROM sims), m AS (SELECT ens, sum(w) AS sw, sum(w * w) AS ww, sum(w * theta[1]) / sum(w) AS a, sum(w * theta[2]) / sum(w) AS b, sum(w * theta[3]) / sum(w) AS c FROM w GROUP BY ens),
x AS (SELECT w.ens, w, [theta[1] - a, theta[2] - b, theta[3] - c] AS d, [a, b, c] AS mean, sw - ww / sw AS free FROM w JOIN m USING (ens)), ij AS (SELECT i, j FROM generate_series(1, 3) p(i) JOIN generate_series(1, 3) q(j) ON i <= j)
SELECT ens, 't' || (i - 1) AS a, 't' || (j - 1) AS b, {R('max(mean[i])', 7)} AS mean_a, {R('sum(w * d[i] * d[j]) / max(free)', 8)} AS cov FROM x CROSS JOIN ij GROUP BY ens, i, j""")
def weighted_mean_covariance(spark, sf_dir):
    s = sims(spark, sf_dir).select("ens", *[F.col("theta")[k].alias(f"t{k}") for k in range(3)], (1 + F.col("id") % 4).cast("double").alias("w"))
    return V.weighted_moments(s, ["ens"], ["t0", "t1", "t2"], "w").select("ens", "a", "b", rnd("mean_a", 7).alias("mean_a"), rnd("cov", 8).alias("cov"))


@query("unique_samples", "SELECT l_quantity AS q, l_discount AS d, l_tax AS t, count(*) AS weight FROM lineitem GROUP BY 1, 2, 3")
def unique_samples(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("q"), F.col("l_discount").alias("d"), F.col("l_tax").alias("t"))
    return P.unique_samples(s, ["q", "d", "t"])


@query("maximum_probability", "WITH m AS (SELECT l_returnflag AS ens, max(l_quantity) AS top FROM lineitem GROUP BY 1) SELECT l_returnflag AS ens, count(*) AS n, min(l_orderkey) AS first_order FROM lineitem JOIN m ON m.ens = l_returnflag AND l_quantity = top GROUP BY 1")
def maximum_probability(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("ens"), F.col("l_orderkey").alias("id"), F.col("l_quantity").alias("weight"))
    return P.most_probable(s, ["ens"], "weight", "id").groupBy("ens").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_order"))


@query("histogram_1d", ctes("sims") + f""", h AS (SELECT ens, least(19, floor((theta[1] + 0.4) / 0.8 * 20))::INTEGER AS bin, theta[2] * theta[2] AS w FROM sims WHERE theta[1] BETWEEN -0.4 AND 0.4), c AS (SELECT ens, bin, count(*) AS n, sum(w) AS w FROM h GROUP BY 1, 2),
g AS (SELECT DISTINCT ens, b::INTEGER AS bin FROM h CROSS JOIN generate_series(0, 19) q(b)), t AS (SELECT ens, sum(n) AS tn FROM c GROUP BY 1)
SELECT g.ens, g.bin, {R('coalesce(w, 0)')} AS weight, {R('coalesce(n, 0) / tn / 0.04', 5)} AS density FROM g LEFT JOIN c ON c.ens = g.ens AND c.bin = g.bin JOIN t ON t.ens = g.ens""")
def histogram_1d(spark, sf_dir):
    s = sims(spark, sf_dir).select("ens", F.col("theta")[0].alias("x"), (F.col("theta")[1] * F.col("theta")[1]).alias("w"))
    weighted = P.histogram(s, ["ens"], "x", -0.4, 0.4, 20, weight="w").withColumnRenamed("value", "weight")
    plain = P.histogram(s, ["ens"], "x", -0.4, 0.4, 20, density=True)
    return weighted.join(plain, ["ens", "bin"]).select("ens", "bin", rnd("weight").alias("weight"), rnd("value", 5).alias("density"))


@query("histogram_2d", ctes("sims") + f""", h AS (SELECT least(9, floor((theta[1] + 0.4) / 0.8 * 10))::INTEGER AS bx, least(9, floor((theta[2] + 0.4) / 0.8 * 10))::INTEGER AS "by" FROM sims WHERE theta[1] BETWEEN -0.4 AND 0.4 AND theta[2] BETWEEN -0.4 AND 0.4)
SELECT bx, "by", {R('count(*) / sum(count(*)) OVER () / 0.0064', 5)} AS density FROM h GROUP BY 1, 2""")
def histogram_2d(spark, sf_dir):
    s = sims(spark, sf_dir).select(F.col("theta")[0].alias("x"), F.col("theta")[1].alias("y"))
    return P.histogram_2d(s, [], "x", "y", (-0.4, 0.4), (-0.4, 0.4), 10, density=True).select("bx", "by", rnd("value", 5).alias("density"))


_E = [-0.5, -0.2, -0.05, 0.0, 0.1, 0.5]
_CASE = "CASE " + " ".join(f"WHEN {{c}} >= {lo} THEN {k}" for k, lo in reversed(list(enumerate(_E[:-1])))) + " END"


@query("strongest_per_cell", ctes("sims") + f""", c AS (SELECT id, theta[1] AS x, theta[2] AS y, round(theta[3], 2) AS w, {_CASE.format(c='theta[1]')} AS bx, {_CASE.format(c='theta[2]')} AS "by" FROM sims WHERE theta[1] BETWEEN -0.5 AND 0.5 AND theta[2] BETWEEN -0.5 AND 0.5),
r AS (SELECT *, row_number() OVER (PARTITION BY bx, "by" ORDER BY w DESC, id) AS k FROM c) SELECT bx, "by", {R('x')} AS x, {R('y')} AS y, {R('w', 2)} AS w FROM r WHERE k = 1""")
def strongest_per_cell(spark, sf_dir):
    s = sims(spark, sf_dir).select("id", F.col("theta")[0].alias("x"), F.col("theta")[1].alias("y"), F.round(F.col("theta")[2], 2).alias("w"))
    return P.strongest_per_cell(s, [], "x", "y", "w", "id", _E, _E).select("bx", "by", rnd("x").alias("x"), rnd("y").alias("y"), rnd("w", 2).alias("w"))


_COV = "cov AS (SELECT user_id % 20 AS boot, event_type AS type, ln(1 + value) / 6 AS v FROM events), lev AS (SELECT boot, k / 10.0::DOUBLE AS level, avg(CASE WHEN v < k / 10.0::DOUBLE THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS ecp FROM cov CROSS JOIN generate_series(0, 10) q(k) GROUP BY 1, 2)"


def coverage(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("boot"), (F.log(1 + F.col("value")) / 6).alias("v"))
    levels = [k / 10 for k in range(11)]
    shares = e.groupBy("boot").agg(*[F.avg((F.col("v") < level).cast("double")).alias(f"l{k}") for k, level in enumerate(levels)])
    return shares.select("boot", F.inline(F.array(*[F.struct(F.lit(level).alias("level"), F.col(f"l{k}").alias("ecp")) for k, level in enumerate(levels)])))


@query("coverage_band", f"WITH {_COV} SELECT level, {R('avg(ecp)')} AS mean, {R('avg(ecp) - stddev_pop(ecp)')} AS lo1, {R('avg(ecp) + 2 * stddev_pop(ecp)')} AS hi2 FROM lev GROUP BY level")
def coverage_band(spark, sf_dir):
    return P.coverage_band(coverage(spark, sf_dir)).select("level", rnd("mean").alias("mean"), rnd("lo1").alias("lo1"), rnd("hi2").alias("hi2"))


@query("credibility_ranks", f"""WITH {_COV}, d AS (SELECT boot, level, ecp - lag(ecp) OVER (PARTITION BY boot ORDER BY level) AS d FROM lev), dd AS (SELECT * FROM d WHERE d IS NOT NULL),
m AS (SELECT level, row_number() OVER (ORDER BY level) - 1 AS i, avg(d) AS m FROM dd GROUP BY level), w AS (SELECT s, exp(-s * s / 2.0::DOUBLE) / (SELECT sum(exp(-s * s / 2.0::DOUBLE)) FROM generate_series(-4, 4) z(s)) AS w FROM generate_series(-4, 4) y(s)),
sm AS (SELECT a.level, sum(w * b.m) AS h FROM m a CROSS JOIN w JOIN m b ON b.i = CASE WHEN a.i + s < 0 THEN -1 - a.i - s WHEN a.i + s > 9 THEN 19 - a.i - s ELSE a.i + s END GROUP BY a.level),
r AS (SELECT level, h / avg(h) OVER () AS rank FROM sm), q AS (SELECT level, quantile_cont(d, 0.025) AS lo, quantile_cont(d, 0.975) AS hi FROM dd GROUP BY level)
SELECT level, {R('rank', 5)} AS rank, {R('rank + lo', 5)} AS lo, {R('rank + hi', 5)} AS hi FROM r JOIN q USING (level)""")
def credibility_ranks(spark, sf_dir):
    return P.credibility_ranks(coverage(spark, sf_dir)).select("level", rnd("rank", 5).alias("rank"), rnd("lo", 5).alias("lo"), rnd("hi", 5).alias("hi"))


_GX = [-0.3 + 0.05 * k for k in range(13)]
_KDE = """st AS (SELECT ens, pow(count(*), -1 / 3.0::DOUBLE) AS f, count(*) AS n, var_samp(theta[1]) AS xx, var_samp(theta[2]) AS yy, covar_samp(theta[1], theta[2]) AS xy FROM sims GROUP BY ens),
sc AS (SELECT ens, n, xx * f AS xx, yy * f AS yy, xy * f AS xy, (xx * yy - xy * xy) * f * f AS det FROM st), gr AS (SELECT a AS ix, b AS iy, -0.3 + 0.05 * a::DOUBLE AS gx, -0.3 + 0.05 * b::DOUBLE AS gy FROM generate_series(0, 12) p(a) CROSS JOIN generate_series(0, 12) q(b)),
kde AS (SELECT s.ens, ix, iy, sum(exp(-0.5 * (yy * pow(theta[1] - gx, 2) - 2 * xy * (theta[1] - gx) * (theta[2] - gy) + xx * pow(theta[2] - gy, 2)) / det)) / max(n) / (2 * pi() * sqrt(max(det))) AS density FROM sims s JOIN sc USING (ens) CROSS JOIN gr GROUP BY 1, 2, 3)"""


def density(spark, sf_dir):
    s = sims(spark, sf_dir).select("ens", F.col("theta")[0].alias("x"), F.col("theta")[1].alias("y"))
    return P.kde_on_grid(s, ["ens"], "x", "y", _GX, _GX)


@query("kernel_density_grid", ctes("sims") + f", {_KDE} SELECT ens, ix::INTEGER AS ix, iy::INTEGER AS iy, {R('density', 5)} AS density FROM kde")
def kernel_density_grid(spark, sf_dir):
    return density(spark, sf_dir).select("ens", "ix", "iy", rnd("density", 5).alias("density"))


# Group -1 has one sample, group -2 samples on a line; the others as they are.
_DEGENERATE = "dg AS (SELECT ens, theta[1] AS x, theta[2] AS y FROM sims UNION ALL SELECT -1, theta[1], theta[2] FROM sims WHERE id = 3 UNION ALL SELECT -2, theta[1], 2 * theta[1] FROM sims WHERE id < 40)"
_DG_KERNELS = """st AS (SELECT ens, pow(count(*), -1 / 3.0::DOUBLE) AS f, count(*) AS n, var_samp(x) AS xx, var_samp(y) AS yy, covar_samp(x, y) AS xy FROM dg GROUP BY ens),
sc AS (SELECT ens, n, xx * f AS xx, yy * f AS yy, xy * f AS xy, CASE WHEN xx * yy - xy * xy > 1e-12 * xx * yy THEN (xx * yy - xy * xy) * f * f END AS det FROM st),
gr AS (SELECT a AS ix, b AS iy, -0.3 + 0.05 * a::DOUBLE AS gx, -0.3 + 0.05 * b::DOUBLE AS gy FROM generate_series(0, 12) p(a) CROSS JOIN generate_series(0, 12) q(b))"""


def degenerate(spark, sf_dir):
    s = sims(spark, sf_dir).select("id", F.col("ens").cast("int").alias("ens"), F.col("theta")[0].alias("x"), F.col("theta")[1].alias("y"))
    one, line = s.where("id = 3").withColumn("ens", F.lit(-1)), s.where("id < 40").withColumns({"ens": F.lit(-2), "y": 2 * F.col("x")})
    return s.unionByName(one).unionByName(line).drop("id")


@query("kernel_density_degenerate", ctes("sims") + f""", {_DEGENERATE}, {_DG_KERNELS}
SELECT sc.ens, ix::INTEGER AS ix, iy::INTEGER AS iy, {R('sum(exp(-0.5 * (yy * pow(x - gx, 2) - 2 * xy * (x - gx) * (y - gy) + xx * pow(y - gy, 2)) / det)) / max(n) / (2 * pi() * sqrt(max(det)))', 5)} AS density FROM dg JOIN sc USING (ens) CROSS JOIN gr GROUP BY 1, 2, 3""")
def kernel_density_degenerate(spark, sf_dir):
    return P.kde_on_grid(degenerate(spark, sf_dir), ["ens"], "x", "y", _GX, _GX).select("ens", "ix", "iy", rnd("density", 5).alias("density"))


@query("kernel_density_binned", ctes("sims") + f""", {_DEGENERATE}, {_DG_KERNELS}, pl AS (SELECT ens, (x + 0.3) / 0.025 AS px, (y + 0.3) / 0.025 AS py FROM dg),
nd AS (SELECT ens, floor(px) + a AS i, floor(py) + b AS j, sum((CASE WHEN a = 1 THEN px - floor(px) ELSE 1 - px + floor(px) END) * (CASE WHEN b = 1 THEN py - floor(py) ELSE 1 - py + floor(py) END)) AS c
 FROM pl CROSS JOIN generate_series(0, 1) u(a) CROSS JOIN generate_series(0, 1) v(b) GROUP BY 1, 2, 3)
SELECT sc.ens, ix::INTEGER AS ix, iy::INTEGER AS iy, {R('sum(c * exp(-0.5 * (yy * pow(0.025 * (i - 2 * ix), 2) - 2 * xy * 0.025 * (i - 2 * ix) * 0.025 * (j - 2 * iy) + xx * pow(0.025 * (j - 2 * iy), 2)) / det)) / max(n) / (2 * pi() * sqrt(max(det)))', 5)} AS density
FROM nd JOIN sc USING (ens) CROSS JOIN gr GROUP BY 1, 2, 3""")
def kernel_density_binned(spark, sf_dir):
    return P.kde_binned(degenerate(spark, sf_dir), ["ens"], "x", "y", _GX, _GX, fine=2).select("ens", "ix", "iy", rnd("density", 5).alias("density"))


@query("highest_density_thresholds", ctes("sims") + f""", {_KDE}, c AS (SELECT ens, density, sum(density) OVER (PARTITION BY ens ORDER BY density DESC, ix, iy ROWS UNBOUNDED PRECEDING) / sum(density) OVER (PARTITION BY ens) AS share FROM kde), l AS (SELECT unnest([0.6827::DOUBLE, 0.9545::DOUBLE]) AS level)
SELECT ens, level, {R('max(density)', 5)} AS threshold FROM c JOIN l ON share >= level GROUP BY 1, 2""")
def highest_density_thresholds(spark, sf_dir):
    return P.hpd_thresholds(density(spark, sf_dir), ["ens"], ["ix", "iy"]).select("ens", "level", rnd("threshold", 5).alias("threshold"))


@query("quantile_traces", ctes("lg") + f", q AS (SELECT unnest([0.05::DOUBLE, 0.5::DOUBLE, 0.95::DOUBLE]) AS q) SELECT ens, i::INTEGER AS i, q, {R('CASE q WHEN 0.05 THEN quantile_cont(v, 0.05) WHEN 0.5 THEN quantile_cont(v, 0.5) ELSE quantile_cont(v, 0.95) END')} AS value FROM lg CROSS JOIN q GROUP BY 1, 2, 3")
def quantile_traces(spark, sf_dir):
    return P.quantile_traces(traces(spark, sf_dir), ["ens"], "id").select("ens", "i", "q", rnd("value").alias("value"))


@query("sample_nearest_percentile", ctes("sims") + f""", q AS (SELECT ens, unnest([0.05::DOUBLE, 0.5::DOUBLE, 0.95::DOUBLE]) AS q, unnest([quantile_cont(theta[1], 0.05), quantile_cont(theta[1], 0.5), quantile_cont(theta[1], 0.95)]) AS t FROM sims GROUP BY ens)
SELECT q.ens, q, {R('max(t)')} AS target, {R('min(abs(theta[1] - t))')} AS gap FROM q JOIN sims s ON s.ens = q.ens GROUP BY 1, 2""")
def sample_nearest_percentile(spark, sf_dir):
    s = sims(spark, sf_dir).select("ens", "id", F.col("theta")[0].alias("v"))
    found = P.nearest_to_quantile(s, ["ens"], "v", "id")
    return found.select("ens", "q", rnd("target").alias("target"), rnd(F.abs(F.col("v") - F.col("target"))).alias("gap"))


@query("random_subset_per_ensemble", ctes("tr") + f", r AS (SELECT id, ens, row_number() OVER (PARTITION BY ens ORDER BY {uniform_sql('id', 'subset')}, id) AS k FROM tr) SELECT id, ens FROM r WHERE k <= 25")
def random_subset_per_ensemble(spark, sf_dir):
    return Q.random_subset(traces(spark, sf_dir).select("id", "ens"), ["ens"], ["id"], 25, "subset")


@query("train_validation_split", "WITH r AS (SELECT o_orderkey AS id, row_number() OVER (ORDER BY printf('sim_%08d', o_orderkey)) AS k, count(*) OVER () AS n FROM orders) SELECT id, CASE WHEN k <= floor(n * 0.9) THEN 'train' ELSE 'validate' END AS part FROM r")
def train_validation_split(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.format_string("sim_%08d", "o_orderkey").alias("name"))
    return Q.split_by_name(o, "name").select("id", "part")


@query("extents_filter", ctes("sims") + " SELECT id FROM sims WHERE theta[1] > -0.1 AND theta[1] < 0.2 AND theta[2] > -0.15 AND theta[2] < 0.15")
def extents_filter(spark, sf_dir):
    s = sims(spark, sf_dir).select("id", F.col("theta")[0].alias("a"), F.col("theta")[1].alias("b"))
    return Q.within_extents(s, {"a": (-0.1, 0.2), "b": (-0.15, 0.15)}).select("id")


@query("compression_error_filter", ctes("sims") + f""", {TH}, e AS (SELECT id, avg(CASE WHEN value = 0 THEN 'inf'::DOUBLE ELSE abs(value + 0.1 - value) / abs(value) END) AS a, avg(CASE WHEN value = 0 THEN 'inf'::DOUBLE ELSE abs(value + 0.1 - value) / value END) AS s FROM th GROUP BY id)
SELECT id, s < 3 AS signed_kept FROM e WHERE a < 3""")
def compression_error_filter(spark, sf_dir):
    s = sims(spark, sf_dir).select("id", "theta", F.transform("theta", lambda v: v + 0.1).alias("c"))
    signed = Q.drop_bad_compressions(s, "theta", "c", 3.0, signed=True).select("id", F.lit(True).alias("k"))
    return Q.drop_bad_compressions(s, "theta", "c", 3.0).join(signed, "id", "left").select("id", F.coalesce("k", F.lit(False)).alias("signed_kept"))


@query("chain_best_and_mean", f"""WITH c AS (SELECT user_id % 50 AS chain, event_id AS step, value AS x, -pow(value - 20, 2) AS logp FROM events),
b AS (SELECT chain, x, row_number() OVER (PARTITION BY chain ORDER BY logp DESC, step) AS k FROM c), m AS (SELECT chain, avg(x) AS mean FROM c GROUP BY chain) SELECT chain, {R('x', 4)} AS best, {R('mean', 4)} AS mean FROM b JOIN m USING (chain) WHERE k = 1""")
def chain_best_and_mean(spark, sf_dir):
    c = chains(spark, sf_dir).withColumn("logp", -F.pow(F.col("x") - 20, F.lit(2.0)))
    best = P.chain_point(c, ["chain"], ["x"], "logp", "step").withColumnRenamed("x", "best")
    mean = P.chain_point(c, ["chain"], ["x"], "logp", "step", best=False).withColumnRenamed("x", "mean")
    return best.join(mean, "chain").select("chain", rnd("best", 4).alias("best"), rnd("mean", 4).alias("mean"))


def chains(spark, sf_dir):
    return table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("chain"), F.col("event_id").alias("step"), F.col("value").alias("x"))


@query("chain_order_and_thinning", "SELECT event_id AS step, user_id % 50 AS chain, row_number() OVER (ORDER BY event_id, user_id % 50) AS position FROM events WHERE event_id % 5 = 0")
def chain_order_and_thinning(spark, sf_dir):
    thinned = P.order_chains(chains(spark, sf_dir), thin=5)
    return ranked(thinned.select("step", "chain"), ["step", "chain"], name="position")


@query("best_iteration", f"WITH h AS (SELECT l_orderkey AS event, l_linenumber AS iteration, l_extendedprice AS chi2 FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY event ORDER BY chi2, iteration) AS k FROM h) SELECT event, iteration, {R('chi2', 2)} AS chi2 FROM r WHERE k = 1")
def best_iteration(spark, sf_dir):
    h = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("event"), F.col("l_linenumber").alias("iteration"), F.col("l_extendedprice").alias("chi2"))
    return P.best_iteration(h, ["event"]).select("event", "iteration", rnd("chi2", 2).alias("chi2"))


@query("result_lookup", f"""WITH r AS (SELECT event_id, user_id % 100 AS event, event_type AS method, json_extract_string(props, '$.k')::BIGINT % 3 AS test_noise, user_id % 2 AS train_noise, value FROM events),
k AS (SELECT DISTINCT user_id % 100 AS event, 'view' AS method, 1 AS test_noise, 0 AS train_noise FROM events) SELECT k.event, count(*) AS n, {R('sum(value)', 2)} AS total FROM k JOIN r USING (event, method, test_noise, train_noise) GROUP BY k.event""")
def result_lookup(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    r = e.select((F.col("user_id") % 100).alias("event"), F.col("event_type").alias("method"), (F.get_json_object("props", "$.k").cast("long") % 3).cast("int").alias("test_noise"),
                 (F.col("user_id") % 2).cast("int").alias("train_noise"), "value")
    wanted = r.select("event").distinct().select("event", F.lit("view").alias("method"), F.lit(1).alias("test_noise"), F.lit(0).alias("train_noise"))
    return J.look_up_results(wanted, r).groupBy("event").agg(F.count(F.lit(1)).alias("n"), rnd(F.sum("value"), 2).alias("total"))
