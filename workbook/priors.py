"""Prior draws, job tables, layered models, kernels."""

from __future__ import annotations

from pyspark.sql import functions as F

from quietwave.functions.normal import normal_cdf
from quietwave.operators import pairing as J
from quietwave.operators import priors as D
from quietwave.operators import quality as Q
from quietwave.plans.training import training_rows
from quietwave.sources.layers import stack_models
from workbook.compression import params
from workbook.posteriors import PHI
from workbook.registry import COMPONENTS, R, catalogue, ctes, layers, normal_sql, query, rnd, table, tensors, traces, uniform_sql
from workbook.traces import _PAIRED, checksum, noise_pairs


def ids(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))


IDS = "ids AS (SELECT o_orderkey AS id FROM orders)"


@query("uniform_prior_draws", f"WITH {IDS} SELECT id, 'sim_' || id AS name, {R('-5 + 15 * ' + uniform_sql('id', 'prior.location.0'), 7)} AS lat, {R('20 * ' + uniform_sql('id', 'prior.location.1'), 7)} AS depth, 3.5::DOUBLE AS magnitude FROM ids")
def uniform_prior_draws(spark, sf_dir):
    p = D.prior_table(ids(spark, sf_dir), "id", {"location": ("uniform", [[-5, 0], [10, 20]]), "magnitude": ("constant", [[3.5]])}, "prior")
    return p.select("id", F.format_string("sim_%d", "id").alias("name"), rnd(F.col("location")[0], 7).alias("lat"), rnd(F.col("location")[1], 7).alias("depth"), F.col("magnitude")[0].alias("magnitude"))


@query("gaussian_prior_draws", f"WITH {IDS} SELECT id, {R('1 + 2 * ' + normal_sql('id', 'prior.shift.0'), 6)} AS a, {R('-3 + 0.5 * ' + normal_sql('id', 'prior.shift.1'), 6)} AS b FROM ids")
def gaussian_prior_draws(spark, sf_dir):
    p = D.prior_table(ids(spark, sf_dir), "id", {"shift": ("gaussian", [[1, -3], [4, 0.25]])}, "prior")
    return p.select("id", rnd(F.col("shift")[0]).alias("a"), rnd(F.col("shift")[1]).alias("b"))


@query("truncated_gaussian_draws", f"WITH {IDS}, e AS (SELECT {PHI.format(z='(-0.75)')} AS a, {PHI.format(z='(1.5)')} AS b) SELECT id, {R('a + (b - a) * ' + uniform_sql('id', 'prior.depth.0'), 6)} AS cdf, true AS inside FROM ids CROSS JOIN e")
def truncated_gaussian_draws(spark, sf_dir):
    p = D.prior_table(ids(spark, sf_dir), "id", {"depth": ("truncated gaussian", [[10], [16], [7], [16]])}, "prior")
    v = F.col("depth")[0]
    return p.select("id", rnd(normal_cdf((v - 10) / 4)).alias("cdf"), v.between(7, 16).alias("inside"))


@query("homogeneous_tensor_draws", f"""WITH {IDS}, u AS (SELECT id, {', '.join(f"{uniform_sql('id', f'prior.tensor.{k}')} AS u{k}" for k in range(5))}, exp(ln(1e15) + (ln(1e18) - ln(1e15)) * {uniform_sql('id', 'prior.tensor.m')}) / 1e18 AS m0 FROM ids),
y AS (SELECT *, sqrt(u1) * u0 AS y1, sqrt(u1) AS y2 FROM u)
SELECT id, {R('sqrt(2) * m0 * sqrt(y2 - y1) * cos(2 * pi() * u3)', 7)} AS rr, {R('-m0 * sqrt(y2 - y1) * sin(2 * pi() * u3)', 7)} AS tp, {R('m0', 7)} AS m0 FROM y""")
def homogeneous_tensor_draws(spark, sf_dir):
    p = D.prior_table(ids(spark, sf_dir), "id", {"tensor": ("moment tensor log prior", [1e15, 1e18])}, "prior")
    t = [F.col("tensor")[k] / 1e18 for k in range(6)]
    size = F.sqrt(sum((v * v * (1 if k < 3 else 2) for k, v in enumerate(t)), F.lit(0.0)) / 2)
    return p.select("id", rnd(t[0], 7).alias("rr"), rnd(t[5], 7).alias("tp"), rnd(size, 7).alias("m0"))


@query("latin_hypercube_draws", f"""WITH {IDS}, u AS (SELECT id, row_number() OVER (ORDER BY {uniform_sql('id', 'lhc.order.0')}, id) AS r0, row_number() OVER (ORDER BY {uniform_sql('id', 'lhc.order.1')}, id) AS r1, count(*) OVER () AS n FROM ids)
SELECT id, {R('-1 + 2 * (r0 - ' + uniform_sql('id', 'lhc.in.0') + ') / n', 7)} AS a, {R('10 * (r1 - ' + uniform_sql('id', 'lhc.in.1') + ') / n', 7)} AS b FROM u""")
def latin_hypercube_draws(spark, sf_dir):
    p = D.latin_hypercube(ids(spark, sf_dir), "id", [-1, 0], [1, 10], "lhc")
    return p.select("id", rnd(F.col("draw")[0], 7).alias("a"), rnd(F.col("draw")[1], 7).alias("b"))


@query("prior_table", f"WITH {IDS} SELECT id, {R('-5 + 15 * ' + uniform_sql('id', 'mix.location.0'), 7)} AS lat, {R('2 * ' + normal_sql('id', 'mix.shift.0'), 6)} AS shift FROM ids")
def prior_table(spark, sf_dir):
    p = D.prior_table(ids(spark, sf_dir), "id", {"location": ("uniform", [[-5], [10]]), "shift": ("gaussian", [[0], [4]]), "tensor": ("moment tensor log prior", [1e15, 1e18])}, "mix")
    return p.select("id", rnd(F.col("location")[0], 7).alias("lat"), rnd(F.col("shift")[0]).alias("shift"))


@query("prior_box_rejection", f"WITH {IDS}, d AS (SELECT id, 2 * {normal_sql('id', 'box.location.0')} AS a, 2 * {normal_sql('id', 'box.location.1')} AS b FROM ids) SELECT id, {R('a')} AS a, {R('b')} AS b FROM d WHERE a > -1 AND a < 2 AND b > -1 AND b < 2 ORDER BY id LIMIT 300")
def prior_box_rejection(spark, sf_dir):
    p = D.prior_table(ids(spark, sf_dir), "id", {"location": ("gaussian", [[0, 0], [4, 4]])}, "box")
    flat = p.select("id", F.col("location")[0].alias("a"), F.col("location")[1].alias("b"))
    return Q.inside_prior_box(flat, {"a": (-1, 2), "b": (-1, 2)}, 300, "id").select("id", rnd("a").alias("a"), rnd("b").alias("b"))


@query("ensemble_size_sweep", f"""WITH {IDS}, r AS (SELECT repeat, id, row_number() OVER (PARTITION BY repeat ORDER BY {uniform_sql('id, repeat', 'sweep')}, id) AS k FROM ids CROSS JOIN generate_series(0, 2) q(repeat))
SELECT 'event_' || size || '_' || repeat AS result, count(*) AS n, sum(id)::BIGINT AS id_sum FROM r CROSS JOIN (SELECT unnest([100, 250, 1000]) AS size) WHERE k <= size GROUP BY size, repeat""")
def ensemble_size_sweep(spark, sf_dir):
    s = D.ensemble_size_sweep(ids(spark, sf_dir), "id", "event", [100, 250, 1000], 3, "sweep")
    return s.groupBy("result").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("id_sum"))


@query("clipped_statistics", ctes("sims") + f" SELECT id, {R('list_sum(list_transform(theta, lambda t: greatest(0.0, least(1.0, t * 5 + 0.5))))')} AS total FROM sims")
def clipped_statistics(spark, sf_dir):
    t = traces(spark, sf_dir).select("id", F.transform(F.slice("x", 1, 6), lambda t: t * 5 + 0.5).alias("u"))
    return t.select("id", rnd(F.aggregate(D.clip_unit("u"), F.lit(0.0), lambda a, v: a + v)).alias("total"))


@query("known_parameters", ctes("sims") + """, th AS (SELECT unnest(theta) AS v, generate_subscripts(theta, 1) - 1 AS pos FROM sims), par AS (SELECT pos, min(v) AS lo, max(v) AS hi, avg(v) AS t FROM th GROUP BY pos)
"""
       + f"SELECT pos::INTEGER AS pos, {R('CASE WHEN pos < 3 THEN t ELSE lo END')} AS lo, {R('CASE WHEN pos < 3 THEN t ELSE hi END')} AS hi, CASE WHEN pos < 3 THEN 'constant' ELSE 'uniform' END AS sampling FROM par")
def known_parameters(spark, sf_dir):
    p = params(spark, sf_dir)
    bounds = p.select("pos", "lo", "hi", F.when(F.col("pos") < 3, "uniform known").otherwise("uniform").alias("sampling"))
    pinned = J.pin_known(bounds, p.select("pos", F.col("fiducial").alias("value")), ["pos"])
    return pinned.select("pos", rnd("lo").alias("lo"), rnd("hi").alias("hi"), "sampling")


@query("job_table", ctes("tr", "catalogue") + """, n AS (SELECT unnest(['real_noise', 'gaussian_noise', 'no_noise']) AS noise), j AS (SELECT 'sim_' || id AS job, 'simulated' AS source, noise, NULL::DOUBLE AS mag FROM tr CROSS JOIN n UNION ALL SELECT 'event_' || event_id, 'real', noise, mag FROM catalogue CROSS JOIN n)
SELECT source, noise, count(*) AS jobs, count(mag) AS with_covariance, min(job) AS first_job FROM j GROUP BY 1, 2""")
def job_table(spark, sf_dir):
    tests = traces(spark, sf_dir).select(F.format_string("sim_%d", "id").alias("job"))
    real = catalogue(spark, sf_dir).select(F.format_string("event_%d", "event_id").alias("job"), F.col("mag").alias("covariance"))
    jobs = J.job_table(tests, real, ["real_noise", "gaussian_noise", "no_noise"])
    return jobs.groupBy("source", "noise").agg(F.count(F.lit(1)).alias("jobs"), F.count("covariance").alias("with_covariance"), F.min("job").alias("first_job"))


@query("mechanism_table", ctes("mt") + f""", b AS (SELECT ens, min(abs(m1)) + 1e13 AS lo, max(abs(m1)) AS hi FROM mt GROUP BY ens), m AS (SELECT ens, unnest([pow(10, log10(lo) + (log10(hi) - log10(lo)) / 3), pow(10, log10(lo) + (log10(hi) - log10(lo)) * 2 / 3)]) AS m0 FROM b),
k AS (SELECT unnest(['normal', 'strike_slip', 'thrust', 'pure_isotropic', 'pure_DC', 'pure_CLVD', 'rotated_strike']) AS mechanism, unnest([[1,-1,0,0,0,0], [0,-1,1,0,0,0], [0,1,-1,0,0,0], [1,1,1,0,0,0], [1,0,-1,0,0,0], [1,1,-2,0,0,0], [0,0,0,1,0,0]]) AS e)
SELECT ens, mechanism, mechanism || '_' || format('{{:.2f}}', (log10(m0) - 9.1) / 1.5) || 'M' AS name, {R("list_sum(list_transform(e, lambda v, i: v * i)) / sqrt(list_sum(list_transform(e, lambda v: v * v)) / 2.0) * m0 / 1e16", 6)} AS checksum FROM m CROSS JOIN k""")
def mechanism_table(spark, sf_dir):
    b = tensors(spark, sf_dir).groupBy("ens").agg((F.min(F.abs("m1")) + 1e13).alias("lo"), F.max(F.abs("m1")).alias("hi"))
    moments = b.select("ens", F.explode(D.mechanism_moments(F.col("lo"), F.col("hi"))).alias("m0"))
    made = D.mechanism_table(moments)
    return made.select("ens", "mechanism", "name", rnd(checksum("tensor") / 1e16).alias("checksum"))


@query("green_kernel_assembly", ctes("lg") + f""", g AS (SELECT id // 10 AS station, i, {', '.join(f'max(CASE WHEN id % 10 = {k} THEN v END) AS g{k}' for k in range(10))} FROM lg GROUP BY 1, 2),
t AS (SELECT *, radians(station * 13 % 360) AS a, radians(station * 29 % 360) AS z FROM g WHERE g9 IS NOT NULL),
s AS (SELECT station, i, z, [cos(2*a)*g5/2 - g0/6 + g8/3, -cos(2*a)*g5/2 - g0/6 + g8/3, g0/3 + g8/3, sin(2*a)*g5, cos(a)*g2, sin(a)*g2] AS v,
 [cos(2*a)*g6/2 - g1/6 + g9/3, -cos(2*a)*g6/2 - g1/6 + g9/3, g1/3 + g9/3, sin(2*a)*g6, cos(a)*g3, sin(a)*g3] AS r, [sin(2*a)*g7/2, -sin(2*a)*g7/2, 0.0, -cos(2*a)*g7, sin(a)*g4, -cos(a)*g4] AS t FROM t),
c AS (SELECT station, i, e, v[e] AS vz, -r[e] * cos(z) + t[e] * sin(z) AS vn, -r[e] * sin(z) - t[e] * cos(z) AS ve FROM s CROSS JOIN generate_series(1, 6) q(e)),
u AS (SELECT station, e, i, unnest(['Z', 'N', 'E']) AS component, unnest([vz, vn, ve]) AS k FROM c)
SELECT station, component, e::INTEGER AS element, {R('sum(k * (i + 1))', 5)} AS checksum FROM u GROUP BY 1, 2, 3""")
def green_kernel_assembly(spark, sf_dir):
    t = traces(spark, sf_dir).select(F.expr("id div 10").alias("station"), (F.col("id") % 10).cast("int").alias("response"), "x")
    t = t.withColumns({"az": F.pmod(F.col("station") * 13, F.lit(360)), "baz": F.pmod(F.col("station") * 29, F.lit(360))})
    k = D.assemble_kernels(t, ["station"], "az", "baz")
    return k.groupBy("station", "component", "element").agg(rnd(F.sum(F.col("value") * (F.col("i") + 1)), 5).alias("checksum"))


@query("density_and_velocity_limits", ctes("layers") + f" SELECT model, layer::INTEGER AS layer, {R('greatest(1.0, 1.6612 * vp - 0.4721 * vp * vp + 0.0671 * pow(vp, 3) - 0.0043 * pow(vp, 4) + 0.000106 * pow(vp, 5))')} AS rho, {R('CASE WHEN vs + 1 > vp / sqrt(2) THEN 0.99 * vp / sqrt(2) ELSE vs + 1 END')} AS vs FROM layers")
def density_and_velocity_limits(spark, sf_dir):
    return layers(spark, sf_dir).select("model", "layer", rnd(D.density_from_vp(F.col("vp"))).alias("rho"), rnd(D.limit_vs(F.col("vp"), F.col("vs") + 1)).alias("vs"))


@query("perturbed_layers_independent", ctes("layers") + f""", c AS (SELECT *, k FROM layers CROSS JOIN generate_series(0, 1) q(k)) SELECT model, layer::INTEGER AS layer, k::INTEGER AS copy,
{R('thickness * (1 + 0.05 * ' + normal_sql('model, layer, k', 'kappa.thickness') + ')', 5)} AS thickness, {R('vp * (1 + 0.05 * ' + normal_sql('model, layer, k', 'kappa.vp') + ')', 5)} AS vp FROM c""")
def perturbed_layers_independent(spark, sf_dir):
    p = D.perturb_independent(layers(spark, sf_dir), ["model", "layer"], 2, 5.0, "kappa")
    return p.select("model", "layer", "copy", rnd("thickness", 5).alias("thickness"), rnd("vp", 5).alias("vp"))


@query("perturbed_layers_smooth")
def perturbed_layers_smooth(spark, sf_dir):
    packed = layers(spark, sf_dir).groupBy("model").agg(F.sort_array(F.collect_list(F.struct("layer", "thickness", "vp", "vs"))).alias("l"))
    models = packed.select("model", *[F.col("l")[c].alias(c) for c in ("thickness", "vp", "vs")])
    p = D.perturb_smooth(models, 2, "smooth")
    return p.select("model", "copy", F.size("vp").alias("n"), rnd(checksum("thickness"), 5).alias("thickness"), rnd(checksum("vp"), 5).alias("vp"), rnd(checksum("vs"), 5).alias("vs"), rnd(checksum("rho"), 5).alias("rho"))


_FIELDS = ("shared", "p", "s", "h")


def _deep_sql():
    """Models of one part each, about 30 layers; fields smoothed by a sum over mirrored neighbours."""
    noise = " UNION ALL ".join(f"SELECT '{f}' AS field, model, copy, i, {normal_sql('model, copy, i', f'deep.{f}')} AS w FROM lc" for f in _FIELDS)
    return f"""WITH ly AS (SELECT l_partkey AS model, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_quantity::DOUBLE, 5.0::DOUBLE + l_discount * 20, 3.0::DOUBLE + l_tax * 20) - 1 AS i, l_quantity::DOUBLE AS h, 5.0::DOUBLE + l_discount * 20 AS vp, 3.0::DOUBLE + l_tax * 20 AS vs FROM lineitem),
md AS (SELECT model, count(*) AS n, coalesce(median(h) FILTER (WHERE i < m - 1), max(h)) AS spacing FROM (SELECT *, count(*) OVER (PARTITION BY model) AS m FROM ly) GROUP BY model),
si AS (SELECT model, n, greatest(0.5::DOUBLE, 5.0::DOUBLE / spacing) AS sigma, floor(4 * greatest(0.5::DOUBLE, 5.0::DOUBLE / spacing) + 0.5)::BIGINT AS radius FROM md),
lc AS (SELECT model, i, copy FROM ly CROSS JOIN range(0, 2) t(copy)), nz AS ({noise}),
kw AS (SELECT model, n, s, exp(-0.5::DOUBLE * (s / sigma) * (s / sigma)) AS k FROM (SELECT *, unnest(generate_series(-radius, radius)) AS s FROM si)),
nb AS (SELECT model, i, s, k, CASE WHEN pos < n THEN pos ELSE 2 * n - 1 - pos END AS j FROM (SELECT ly.model, i, s, k, n, ((i + s) % (2 * n) + 2 * n) % (2 * n) AS pos FROM ly JOIN kw USING (model))),
sm AS (SELECT field, nb.model, copy, nb.i, sum(k * w) / sum(k) AS f FROM nb JOIN nz ON nz.model = nb.model AND nz.i = nb.j GROUP BY 1, 2, 3, 4),
un AS (SELECT *, (f - avg(f) OVER q) / (stddev_pop(f) OVER q + 1e-16::DOUBLE) AS u FROM sm WINDOW q AS (PARTITION BY field, model, copy)),
wd AS (SELECT model, copy, i, max(CASE field WHEN 'h' THEN u END) AS uh, sqrt(0.9::DOUBLE) * max(CASE field WHEN 'shared' THEN u END) + sqrt(0.1::DOUBLE) * max(CASE field WHEN 'p' THEN u END) AS up,
 sqrt(0.9::DOUBLE) * max(CASE field WHEN 'shared' THEN u END) + sqrt(0.1::DOUBLE) * max(CASE field WHEN 's' THEN u END) AS us FROM un GROUP BY 1, 2, 3),
pe AS (SELECT model, copy, i, h * exp(0.03::DOUBLE * uh) AS h, vp * exp(0.03::DOUBLE * up / stddev_pop(up) OVER q) AS vp, vs * exp(0.03::DOUBLE * us / stddev_pop(us) OVER q) AS vs FROM wd JOIN ly USING (model, i) WINDOW q AS (PARTITION BY model, copy))
SELECT model, copy::INTEGER AS copy, count(*)::INTEGER AS n, {R('sum(h * (i + 1))', 4)} AS thickness, {R('sum(vp * (i + 1))', 4)} AS vp, {R('sum(CASE WHEN vs > vp / sqrt(2.0::DOUBLE) THEN 0.99 * vp / sqrt(2.0::DOUBLE) ELSE vs END * (i + 1))', 4)} AS vs FROM pe GROUP BY 1, 2"""


@query("perturbed_layers_smooth_deep", _deep_sql())
def perturbed_layers_smooth_deep(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    layer = F.struct("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("h"), (F.lit(5.0) + F.col("l_discount") * 20).alias("vp"), (F.lit(3.0) + F.col("l_tax") * 20).alias("vs"))
    packed = lines.groupBy(F.col("l_partkey").alias("model")).agg(F.sort_array(F.collect_list(layer)).alias("l"))
    models = packed.select("model", *[F.col("l")[c].alias(n) for c, n in (("h", "thickness"), ("vp", "vp"), ("vs", "vs"))])
    p = D.perturb_smooth(models, 2, "deep")
    return p.select("model", "copy", F.size("vp").alias("n"), rnd(checksum("thickness"), 4).alias("thickness"), rnd(checksum("vp"), 4).alias("vp"), rnd(checksum("vs"), 4).alias("vs"))


@query("stacked_models", ctes("layers") + f", c AS (SELECT model, layer, k, vp FROM layers CROSS JOIN generate_series(-1, 1) q(k)) SELECT model, k::INTEGER AS copy, count(*) AS n, {R('max(CASE WHEN k = -1 THEN vp END)', 5)} AS fiducial_vp FROM c GROUP BY 1, 2")
def stacked_models(spark, sf_dir):
    f = layers(spark, sf_dir)
    s = stack_models(f, D.perturb_independent(f, ["model", "layer"], 2, 5.0, "kappa"))
    return s.groupBy("model", "copy").agg(F.count(F.lit(1)).alias("n"), rnd(F.max(F.when(F.col("copy") == -1, F.col("vp"))), 5).alias("fiducial_vp"))


@query("stair_profile", ctes("layers") + f""", d AS (SELECT model, layer, vp, thickness, sum(thickness) OVER (PARTITION BY model ORDER BY layer ROWS UNBOUNDED PRECEDING) AS bottom FROM layers)
SELECT model, layer::INTEGER AS layer, e::INTEGER AS edge, {R('CASE WHEN e = 0 THEN bottom - thickness ELSE bottom END', 4)} AS depth, {R('vp', 4)} AS vp FROM d CROSS JOIN generate_series(0, 1) q(e)""")
def stair_profile(spark, sf_dir):
    s = D.stair_profile(layers(spark, sf_dir), ["model"], values=["vp"])
    return s.select("model", "layer", "edge", rnd("depth", 4).alias("depth"), rnd("vp", 4).alias("vp"))


@query("training_rows", ctes("tr") + ", " + _PAIRED + f""", sh AS (SELECT id, round_even({normal_sql('id', 'train.array')} * 2, 0)::INTEGER + trunc(-3 + 6 * {uniform_sql('id, ens', 'train.station')})::INTEGER AS s FROM tr),
y AS (SELECT p.id, p.ens AS station, (['Z', '1', '2'])[1 + p.id % 3] AS component, k, noise[k] + CASE WHEN k - s BETWEEN 1 AND 64 THEN x[k - s] ELSE 0 END AS v FROM pn p JOIN sh USING (id) CROSS JOIN generate_series(1, 64) q(k)),
c AS (SELECT id, station, component, sum(v * k) AS c FROM y GROUP BY 1, 2, 3), f AS (SELECT id, ens AS station, unnest(['Z', '1', '2']) AS component, (x[1] + 0.5) / 1.0 AS t1, (x[6] + 0.5) / 2.0 AS t6 FROM tr)
SELECT f.id, f.station, f.component, {R('coalesce(c, 0)', 5)} AS checksum, {R('t1')} AS theta_1, {R('t6')} AS theta_6 FROM f LEFT JOIN c USING (id, station, component)""")
def train_rows(spark, sf_dir):
    pick = F.array(*[F.lit(c) for c in COMPONENTS])
    p = noise_pairs(spark, sf_dir).select("id", F.col("ens").alias("station"), pick[(F.col("id") % 3).cast("int")].alias("component"), "x", "noise", F.slice("x", 1, 6).alias("theta"))
    rows = training_rows(p, ["id"], COMPONENTS, 64, 2.0, 3.0, "train", "theta", [-0.5] * 6, [0.5] * 5 + [1.5])
    return rows.select("id", "station", "component", rnd(checksum("x"), 5).alias("checksum"), rnd(F.col("theta")[0]).alias("theta_1"), rnd(F.col("theta")[5]).alias("theta_6"))


_MODEL = [[5.0, 5.5, 3.2, 2.5, 600, 300], [30.0, 7.5, 4.2, 3.1, 800, 400]]


@query("velocity_model_draws", f"WITH {IDS} SELECT id, {R('5 * (1 + 0.05 * ' + normal_sql('id', 'model.velocity_model.0.0') + ')')} AS h0, {R('4.2 * (1 + 0.05 * ' + normal_sql('id', 'model.velocity_model.1.2') + ')')} AS vs1, 3.1::DOUBLE AS rho1 FROM ids")
def velocity_model_draws(spark, sf_dir):
    p = D.prior_table(ids(spark, sf_dir), "id", {"velocity_model": ("velocity model", [_MODEL, 5.0])}, "model")
    m = F.col("velocity_model")
    return p.select("id", rnd(m[0][0]).alias("h0"), rnd(m[1][2]).alias("vs1"), m[1][3].alias("rho1"))
