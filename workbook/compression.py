"""Score compression, least squares, finite differences, parameter vectors."""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import functions as F

from quietwave.functions import arrays as A
from quietwave.functions import parameters as T
from quietwave.operators import compression as C
from quietwave.operators.covariance import mean_vectors, solve_toeplitz, toeplitz_rows
from quietwave.operators.factors import dense_factors, diagonal_factors, toeplitz_factors
from quietwave.operators.noise import damped_cosine_columns
from quietwave.operators.posterior import compression_quality as quality
from quietwave.plans.inversion import compress_ensemble
from quietwave.plans.registries import COMPRESSORS
from quietwave.session import materialise
from workbook.registry import CHECKS, N, P, R, ctes, gradients, query, rnd, sims, table
from workbook.traces import _PAIRED, checksum, noise_pairs

THETA = [0.01 * a for a in range(P)]
SCORE = "sc AS (SELECT id, ens, a, sum(g[a + 1] * (sl.v - d0) / gr.v) AS s FROM (SELECT i, g, v, d0 FROM grad) gr JOIN sl USING (i) CROSS JOIN generate_series(0, 5) q(a) GROUP BY 1, 2, 3)"
FISHER = "fi AS (SELECT a, b, sum(g[a + 1] * g[b + 1] / v) AS f FROM grad CROSS JOIN generate_series(0, 5) p(a) CROSS JOIN generate_series(0, 5) q(b) GROUP BY 1, 2)"


def rows(df, column, name="value", digits=4, keys=("id",)):
    """Array column as rows (keys, a, name)."""
    return df.select(*keys, F.posexplode(column).alias("a", name)).select(*keys, "a", rnd(name, digits).alias(name))


@query("fisher_matrix", ctes("grad") + f", {FISHER} SELECT a::INTEGER AS a, b::INTEGER AS b, {R('f + CASE WHEN a = b THEN 1 / (0.5 + a) ELSE 0 END', 4)} AS f FROM fi")
def fisher_matrix(spark, sf_dir):
    f = C.fisher_matrix(gradients(spark, sf_dir), P, prior_variance=[0.5 + a for a in range(P)])
    return spark.createDataFrame([(a, b, float(f[a, b])) for a in range(P) for b in range(P)], "a int, b int, f double").select("a", "b", rnd("f", 4).alias("f"))


@query("score_vector", ctes("grad") + f", {SCORE} SELECT id, a::INTEGER AS a, {R('s + (0.02 - 0.01 * a) / (0.5 + a)', 4)} AS score FROM sc")
def score_vector(spark, sf_dir):
    prior = [(0.02 - THETA[a]) / (0.5 + a) for a in range(P)]
    scored = C.scores(sims(spark, sf_dir).select("id", "d"), gradients(spark, sf_dir), P, "d", prior_term=prior)
    return rows(scored, "score", "score")


@query("score_vector_long_form", ctes("grad") + f", {SCORE} SELECT id, a::INTEGER AS a, {R('s', 4)} AS score FROM sc")
def score_vector_long_form(spark, sf_dir):
    return rows(C.scores(sims(spark, sf_dir).select("id", "d"), gradients(spark, sf_dir), P, "d", memory=0), "score", "score")


@query("unreduced_score", ctes("grad") + f" SELECT id, i::INTEGER AS i, {R('g[1] * (sl.v - d0) / gr.v', 5)} AS first, {R('g[6] * (sl.v - d0) / gr.v', 5)} AS last FROM (SELECT i, g, v, d0 FROM grad) gr JOIN sl USING (i)")
def unreduced_score(spark, sf_dir):
    t = C.score_terms(sims(spark, sf_dir).select("id", "d"), gradients(spark, sf_dir), ["id"], P, "d")
    return t.select("id", "i", rnd(F.col("terms")[0], 5).alias("first"), rnd(F.col("terms")[5], 5).alias("last"))


def _back(estimate, f, damping=0.0):
    """F (estimate - theta): the score an estimate answers to."""
    m = f + damping * np.diag(np.diag(f))
    return F.array(*[sum((F.lit(float(m[a, b])) * (F.col(estimate)[b] - F.lit(THETA[b])) for b in range(P)), F.lit(0.0)) for a in range(P)])


@query("estimate_from_score", ctes("grad") + f", {SCORE} SELECT id, a::INTEGER AS a, {R('s', 4)} AS plain, {R('s', 4)} AS damped FROM sc")
def estimate_from_score(spark, sf_dir):
    g = gradients(spark, sf_dir)
    f = C.fisher_matrix(g, P)
    scored = C.scores(sims(spark, sf_dir).select("id", "d"), g, P, "d")
    est = C.estimates(C.estimates(scored, f, THETA), f, THETA, damping=0.1, out="damped")
    both = est.select("id", F.posexplode(F.arrays_zip(_back("estimate", f).alias("plain"), _back("damped", f, 0.1).alias("damped"))).alias("a", "z"))
    return both.select("id", "a", rnd("z.plain", 4).alias("plain"), rnd("z.damped", 4).alias("damped"))


@query("compress_noisy_ensemble", ctes("grad") + ", " + _PAIRED + f""", ny AS (SELECT id, unnest(x[7:64]) + unnest(noise[7:64]) AS y, generate_subscripts(x[7:64], 1) - 1 AS i FROM pn),
ns AS (SELECT id, a, sum(g[a + 1] * (y - d0) / v) AS s FROM ny JOIN grad USING (i) CROSS JOIN generate_series(0, 5) q(a) GROUP BY 1, 2)
SELECT ns.id, a::INTEGER AS a, {R('theta[a + 1]')} AS truth, {R('s', 4)} AS score FROM ns JOIN sims USING (id)""")
def compress_noisy_ensemble(spark, sf_dir):
    pairs = noise_pairs(spark, sf_dir).select("id", F.slice("x", 1, P).alias("theta"), F.slice("x", P + 1, N).alias("x"), F.slice("noise", P + 1, N).alias("noise"))
    made, f = compress_ensemble(pairs, gradients(spark, sf_dir), THETA)
    both = made.select("id", F.posexplode(F.arrays_zip("theta", _back("estimate", f).alias("score"))).alias("a", "z"))
    return both.select("id", "a", rnd("z.theta").alias("truth"), rnd("z.score", 4).alias("score"))


@query("compression_quality", ctes("grad") + f", {SCORE}, q AS (SELECT a, theta[a + 1] AS t, s / 100 AS e FROM sc JOIN sims USING (id)) SELECT 'p' || a AS parameter, count(*) AS n, {R('avg(e - t)', 5)} AS bias, {R('sqrt(avg(pow(e - t, 2)))', 5)} AS rmse FROM q GROUP BY a")
def compression_quality(spark, sf_dir):
    scored = C.scores(sims(spark, sf_dir).select("id", "theta", "d"), gradients(spark, sf_dir), P, "d")
    pairs = scored.select("theta", F.transform("score", lambda v: v / 100).alias("estimate"))
    return quality(pairs, [f"p{a}" for a in range(P)], "theta").select("parameter", "n", rnd("bias", 5).alias("bias"), rnd("rmse", 5).alias("rmse"))


@query("stacked_statistics", ctes("grad") + f", {SCORE} SELECT id, (a + 6 * point)::INTEGER AS a, {R('s / (1 + point)', 4)} AS value FROM sc CROSS JOIN generate_series(0, 1) p(point)")
def stacked_statistics(spark, sf_dir):
    scored = C.scores(sims(spark, sf_dir).select("id", "d"), gradients(spark, sf_dir), P, "d")
    points = scored.select("id", F.lit(0).alias("point"), F.col("score").alias("estimate")).unionByName(
        scored.select("id", F.lit(1).alias("point"), F.transform("score", lambda v: v / 2).alias("estimate")))
    return rows(C.stack_estimates(points, ["id"], "point"), "stacked")


@query("second_order_statistics", ctes("grad") + f""", h AS (SELECT i, d0, v, list_concat(g, [g[1] * g[1], g[1] * g[2], g[2] * g[1], g[2] * g[2]]) AS g FROM grad)
SELECT id, a::INTEGER AS a, {R('sum(h.g[a + 1] * (sl.v - h.d0) / h.v)', 4)} AS delta FROM sl JOIN h USING (i) CROSS JOIN generate_series(0, 9) q(a) GROUP BY 1, 2""")
def second_order_statistics(spark, sf_dir):
    g = F.col("g")
    stacked = gradients(spark, sf_dir).withColumn("g", F.concat("g", F.array(g[0] * g[0], g[0] * g[1], g[1] * g[0], g[1] * g[1])))
    return rows(C.scores(sims(spark, sf_dir).select("id", "d"), stacked, P + 4, "d", out="delta"), "delta", "delta")


@query("linear_log_likelihood", ctes("grad") + f", {SCORE} SELECT id, {R('-3 + sum((theta[a + 1] - 0.01 * a) * s)', 4)} AS value FROM sc JOIN sims USING (id) GROUP BY id")
def linear_log_likelihood(spark, sf_dir):
    scored = C.scores(sims(spark, sf_dir).select("id", "theta", "d"), gradients(spark, sf_dir), P, "d")
    return scored.select("id", rnd(C.linear_log_likelihood(scored, "theta", THETA, base=-3.0), 4).alias("value"))


@query("linear_synthesis", ctes("grad") + f", xs AS (SELECT id, i, list_dot_product(theta, g) * 2 AS x FROM sims CROSS JOIN grad) SELECT id, {R('sum(x * (i + 1))', 4)} AS checksum, {R('sum(x * x)', 5)} AS power FROM xs GROUP BY id")
def linear_synthesis(spark, sf_dir, **way):
    made = C.synthesize(sims(spark, sf_dir).select("id", "theta"), gradients(spark, sf_dir), P, factor=2.0, **way)
    return made.select("id", rnd(checksum("x"), 4).alias("checksum"), rnd(A.power("x"), 5).alias("power"))


@query("candidate_log_likelihood", ctes("grad") + f""", xs AS (SELECT s.id, i, list_dot_product(theta, g) - d[i + 1] AS r, theta FROM sims s CROSS JOIN grad),
l AS (SELECT id, -sum(r * r) / 0.02 / 2 AS ll, list_aggregate(list_transform(max(theta), lambda t: (t + 0.3) / 0.6), 'min') >= 0 AND list_aggregate(list_transform(max(theta), lambda t: (t + 0.3) / 0.6), 'max') <= 1 AS inside, list_sum(list_transform(max(theta), lambda t: t * t)) AS tt FROM xs GROUP BY id)
SELECT id, inside, {R('CASE WHEN inside THEN ll END', 3)} AS log_likelihood, {R('CASE WHEN inside THEN ll - tt / 0.5 END', 3)} AS log_probability FROM l""")
def candidate_log_likelihood(spark, sf_dir):
    made = C.synthesize(sims(spark, sf_dir), gradients(spark, sf_dir), P).withColumns({
        "u": F.transform("theta", lambda t: (t + 0.3) / 0.6), "variance": F.lit(0.02)})
    flat = C.log_prior("u")
    shaped = C.log_prior("u", "theta", [0.0] * P, [0.25] * P)
    ll = C.log_likelihood("x", "d", "variance")
    inside = flat == 0.0
    return made.select("id", inside.alias("inside"), rnd(F.when(inside, ll), 3).alias("log_likelihood"), rnd(F.when(inside, ll + shaped), 3).alias("log_probability"))


def params(spark, sf_dir):
    """Six parameters with fiducial values and steps taken from the simulations."""
    long = sims(spark, sf_dir).select(F.posexplode("theta").alias("pos", "v"))
    return long.groupBy("pos").agg(F.avg("v").alias("fiducial"), F.stddev_samp("v").alias("delta"), F.min("v").alias("lo"), F.max("v").alias("hi"))


_PAR = "th AS (SELECT unnest(theta) AS v, generate_subscripts(theta, 1) - 1 AS pos FROM sims), par AS (SELECT pos, avg(v) AS fiducial, stddev_samp(v) AS delta, min(v) AS lo, max(v) AS hi FROM th GROUP BY pos)"


@query("stencil_candidates", ctes("sims") + f""", {_PAR}, mv AS (SELECT pos AS p, o AS offset FROM par CROSS JOIN (SELECT unnest([-2, -1, 1, 2]) AS o) UNION ALL SELECT NULL, 0)
SELECT p::INTEGER AS pos, "offset"::INTEGER AS "offset", {R('sum((par.pos + 1) * (fiducial + CASE WHEN par.pos = p THEN "offset" * delta ELSE 0 END))')} AS checksum FROM mv CROSS JOIN par GROUP BY 1, 2""".replace("o AS offset", 'o AS "offset"'))
def stencil_candidates(spark, sf_dir):
    return C.stencil_candidates(params(spark, sf_dir)).select("pos", "offset", rnd(checksum("theta")).alias("checksum"))


@query("mixed_stencil_candidates", ctes("sims") + f""", {_PAR}, mv AS (SELECT a.pos AS i, b.pos AS j, oi, oj FROM par a JOIN par b ON a.pos > b.pos CROSS JOIN (SELECT unnest([-1, 1]) AS oi) CROSS JOIN (SELECT unnest([-1, 1]) AS oj))
SELECT i::INTEGER AS i, j::INTEGER AS j, oi::INTEGER AS oi, oj::INTEGER AS oj, {R('sum((pos + 1) * (fiducial + CASE WHEN pos = i THEN oi * delta WHEN pos = j THEN oj * delta ELSE 0 END))')} AS checksum FROM mv CROSS JOIN par GROUP BY 1, 2, 3, 4""")
def mixed_stencil_candidates(spark, sf_dir):
    return C.mixed_candidates(params(spark, sf_dir)).select("i", "j", "oi", "oj", rnd(checksum("theta")).alias("checksum"))


def _curved(candidates):
    """A model with a known Hessian: kernels applied to theta, plus the product of the first two and a square."""
    t = F.col("theta")
    return F.transform("lin", lambda v: v + t[0] * t[1] + t[2] * t[2])


@query("stencil_derivatives", ctes("grad") + f""", {_PAR}, f AS (SELECT max(CASE WHEN pos = 0 THEN fiducial END) AS a, max(CASE WHEN pos = 1 THEN fiducial END) AS b, max(CASE WHEN pos = 2 THEN fiducial END) AS c FROM par)
SELECT p::INTEGER AS pos, i::INTEGER AS i, {R('g[p + 1] + CASE p WHEN 0 THEN b WHEN 1 THEN a WHEN 2 THEN 2 * c ELSE 0 END', 5)} AS gradient, {R('CASE WHEN p = 2 THEN 2 ELSE 0 END', 5)} AS curvature FROM grad CROSS JOIN f CROSS JOIN generate_series(0, 5) q(p)""")
def stencil_derivatives(spark, sf_dir, **way):
    p = params(spark, sf_dir)
    cand = C.synthesize(C.stencil_candidates(p), gradients(spark, sf_dir), P, out="lin", **way)
    d = C.first_and_second_derivatives(cand.withColumn("x", _curved(cand)), p)
    both = d.select("pos", F.posexplode(F.arrays_zip("gradient", "curvature")).alias("i", "z"))
    return both.select("pos", "i", rnd("z.gradient", 5).alias("gradient"), rnd("z.curvature", 5).alias("curvature"))


@query("hessian", ctes("grad") + f" SELECT a::INTEGER AS i, b::INTEGER AS j, {R('CASE WHEN a + b = 1 THEN 1 WHEN a = 2 AND b = 2 THEN 2 ELSE 0 END', 4)} AS value, count(*) AS n FROM grad CROSS JOIN generate_series(0, 5) p(a) CROSS JOIN generate_series(0, 5) q(b) GROUP BY a, b")
def hessian(spark, sf_dir, **way):
    p, g = params(spark, sf_dir), gradients(spark, sf_dir)
    cand = C.synthesize(C.stencil_candidates(p), g, P, out="lin", **way)
    d = C.first_and_second_derivatives(cand.withColumn("x", _curved(cand)), p)
    mixed = C.synthesize(C.mixed_candidates(p), g, P, out="lin", **way)
    h = C.hessian(mixed.withColumn("x", _curved(mixed)), d, p)
    return h.select("i", "j", F.explode("h").alias("v")).groupBy("i", "j").agg(rnd(F.avg("v"), 4).alias("value"), F.count(F.lit(1)).alias("n"))


@query("least_squares_linear", ctes("grad") + f", {SCORE}, {FISHER} SELECT id, a::INTEGER AS a, {R('s', 2)} AS score FROM sc")
def least_squares_linear(spark, sf_dir):
    g = gradients(spark, sf_dir)
    f = C.fisher_matrix(g, P)
    scored = C.scores(sims(spark, sf_dir).select("id", "d"), g, P, "d").withColumn("misfit", A.power("d") / N)
    solved = C.solve_linear(scored, f, THETA, N, "misfit", iterations=20, damping=1e-6)
    return rows(solved.withColumn("back", _back("theta_last", f)), "back", "score", 2)


@query("least_squares_iterative", ctes("grad") + f""", {_PAR}, ob AS (SELECT ens, i, avg(v) AS o FROM sl GROUP BY 1, 2), s0 AS (SELECT ens, a, sum(g[a + 1] * o) / 0.02 AS s, sum(o * o) / 0.02 / 58 AS chi FROM ob JOIN grad USING (i) CROSS JOIN generate_series(0, 5) q(a) GROUP BY 1, 2)
SELECT ens AS event, {R('max(chi)', 5)} AS first_chi2, true AS improved, 2 AS steps FROM s0 GROUP BY ens""")
def least_squares_iterative(spark, sf_dir):
    g = gradients(spark, sf_dir)
    obs = mean_vectors(sims(spark, sf_dir).select("ens", "d"), ["ens"], "d").select(F.col("ens").alias("event"), F.col("d").alias("obs"))
    start = obs.select("event", F.array_repeat(F.lit(0.0), P).alias("theta"))
    history = C.solve_iterative(obs, start, lambda c: C.synthesize(c, g, P), [0.1] * P, 0.02, single_step=True)
    first = F.max(F.when(F.col("iteration") == 0, F.col("chi2")))
    return history.groupBy("event").agg(rnd(first, 5).alias("first_chi2"), (F.min("chi2") < first).alias("improved"), F.count(F.lit(1)).cast("int").alias("steps"))


@query("fisher_constrained_bounds", ctes("sims") + f", {_PAR} SELECT pos::INTEGER AS pos, {R('CASE WHEN pos = 2 THEN greatest(0, greatest(lo, 0.01 * pos - 3 * 0.05 * (1 + pos))) ELSE greatest(lo, 0.01 * pos - 3 * 0.05 * (1 + pos)) END')} AS lo, {R('least(hi, 0.01 * pos + 3 * 0.05 * (1 + pos))')} AS hi, 'uniform' AS sampling FROM par")
def fisher_constrained_bounds(spark, sf_dir):
    f = np.diag([1 / (0.05 * (1 + a)) ** 2 for a in range(P)])
    bounds = params(spark, sf_dir).withColumns({"kind": F.when(F.col("pos") == 2, "depth").otherwise("other"), "sampling": F.lit("latin hypercube")})
    return C.fisher_bounds(bounds, THETA, f, 3.0).select("pos", rnd("lo").alias("lo"), rnd("hi").alias("hi"), "sampling")


_GROUPS = {"source_location": 2, "moment_tensor": 4}


def _groups(spark, sf_dir):
    s = sims(spark, sf_dir).select("id", "theta")
    return s.withColumn("groups", T.to_groups("theta", _GROUPS))


@query("parameter_vectors", ctes("sims") + f" SELECT id, {R('theta[2]', 7)} AS location_2, {R('theta[6]', 7)} AS tensor_4, 6::INTEGER AS n, {R('list_sum(theta) - theta[3] + 9', 6)} AS changed, true AS same FROM sims")
def parameter_vectors(spark, sf_dir):
    g = _groups(spark, sf_dir)
    back = T.to_vector("groups", list(_GROUPS))
    return g.select(
        "id", rnd(F.col("groups")["source_location"][1], 7).alias("location_2"), rnd(F.col("groups")["moment_tensor"][3], 7).alias("tensor_4"), F.size(back).alias("n"),
        rnd(A.total(T.change_entry("theta", 2, F.lit(9.0)))).alias("changed"), (back == F.col("theta")).alias("same"))


@query("simulation_inputs_with_nuisance", ctes("sims") + f" SELECT id, {R('theta[1]', 7)} AS location_1, {R('list_sum(d)', 5)} AS model_total FROM sims")
def simulation_inputs_with_nuisance(spark, sf_dir):
    s = sims(spark, sf_dir).withColumn("entries", F.concat(F.transform(F.slice("theta", 1, 2), lambda v: F.array(v)), F.array(F.col("d"))))
    groups = T.with_nuisance("entries", {"source_location": 2, "velocity_model": 1}, ["velocity_model"])
    return s.withColumn("g", groups).select("id", rnd(F.col("g")["source_location"][0], 7).alias("location_1"), rnd(A.total(F.col("g")["velocity_model"]), 5).alias("model_total"))


@query("parameter_fingerprint", "SELECT c_custkey AS id, substr(md5('location=' || c_custkey || ',' || c_nationkey || ';tensor=' || (c_custkey * 3)), 1, 8) AS fingerprint FROM customer")
def parameter_fingerprint(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    groups = F.create_map(F.lit("tensor"), F.array((F.col("c_custkey") * 3).cast("long")), F.lit("location"), F.array("c_custkey", F.col("c_nationkey").cast("long")))
    return c.select(F.col("c_custkey").alias("id"), T.fingerprint(groups, ["location", "tensor"]).alias("fingerprint"))


# two traces of 29 samples with an exponential covariance; its inverse is tridiagonal
_RHO = "exp(-1 / 20.0::DOUBLE)"
_BLOCK = f"""gw AS (SELECT i, g, d0, a, g[a + 1] AS ga, coalesce(lag(g[a + 1]) OVER (PARTITION BY a, i // 29 ORDER BY i), 0) AS gp, coalesce(lead(g[a + 1]) OVER (PARTITION BY a, i // 29 ORDER BY i), 0) AS gn FROM grad CROSS JOIN generate_series(0, 5) q(a)),
ws AS (SELECT i, a, d0, ga, ((CASE WHEN i % 29 IN (0, 28) THEN 1 ELSE 1 + {_RHO} * {_RHO} END) * ga - {_RHO} * (gp + gn)) / (1 - {_RHO} * {_RHO}) / (0.02 * (1 + i // 29)) AS w FROM gw)"""


def block_gradients(spark, sf_dir):
    g = gradients(spark, sf_dir).select("i", "g", "d0").withColumns({"trace": F.floor(F.col("i") / 29), "t": F.pmod("i", F.lit(29))})
    packed = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("t", c.alias("v")))), lambda s: s["v"])
    long = g.select("trace", "t", F.posexplode("g").alias("pos", "v"))
    derivatives = long.groupBy("trace", "pos").agg(packed(F.col("v")).alias("gradient"))
    fiducial = g.groupBy("trace").agg(packed(F.col("d0")).alias("x")).withColumn("ord", F.col("trace"))
    cov = damped_cosine_columns(g.select("trace").distinct().withColumn("variance", 0.02 * (1 + F.col("trace"))), 29, omega=0.0, jitter=0.0)
    solve = lambda d: solve_toeplitz(d, cov.select("trace", "k", "c"), ["trace"], x="gradient")
    return C.block_gradient_rows(derivatives, fiducial, solve, ["trace"], "ord", P)


@query("block_covariance_fisher", ctes("grad") + f", {_BLOCK} SELECT x.a::INTEGER AS a, y.a::INTEGER AS b, {R('sum(x.ga * y.w)', 3)} AS f FROM ws x JOIN ws y USING (i) GROUP BY 1, 2")
def block_covariance_fisher(spark, sf_dir):
    f = C.fisher_matrix(block_gradients(spark, sf_dir), P)
    return spark.createDataFrame([(a, b, float(f[a, b])) for a in range(P) for b in range(P)], "a int, b int, f double").select("a", "b", rnd("f", 3).alias("f"))


@query("block_covariance_compression", ctes("grad") + f", {_BLOCK} SELECT id, a::INTEGER AS a, {R('sum(w * (v - d0))', 3)} AS score FROM sl JOIN ws USING (i) GROUP BY 1, 2")
def block_covariance_compression(spark, sf_dir):
    g = materialise(block_gradients(spark, sf_dir), "gradients")
    made = COMPRESSORS["optimal_score"](sims(spark, sf_dir).select("id", F.col("d").alias("x")), g, THETA)
    return rows(made.withColumn("back", _back("estimate", C.fisher_matrix(g, P))), "back", "score", 3)


@query("multi_point_compression", ctes("grad") + f", {SCORE} SELECT id, point::INTEGER AS point, a::INTEGER AS a, {R('s', 3)} AS score FROM sc CROSS JOIN generate_series(0, 1) q(point)")
def multi_point_compression(spark, sf_dir):
    g = gradients(spark, sf_dir)
    f = C.fisher_matrix(g, P)
    points = [(g, THETA), (g, [0.0] * P)]
    made = COMPRESSORS["multi_optimal_score"](sims(spark, sf_dir).select("id", F.col("d").alias("x")), points, ["id"])
    first = made.select("id", F.slice("estimate", 1, P).alias("e"), F.lit(0).alias("point"))
    second = made.select("id", F.zip_with(F.slice("estimate", P + 1, P), F.array(*[F.lit(t) for t in THETA]), lambda a, b: a + b).alias("e"), F.lit(1).alias("point"))
    return rows(first.unionByName(second).withColumn("back", _back("e", f)), "back", "score", 3, keys=("id", "point"))


# --- covariances of two traces of 29 samples: diagonal, exponential, and exponential with growing amplitude ---

def _trace_variances(spark):
    return spark.range(2).select(F.col("id").cast("int").alias("trace"), (F.lit(0.02) * (1 + F.col("id"))).alias("variance"))


def _exponential_columns(spark):
    return damped_cosine_columns(_trace_variances(spark), 29, omega=0.0, jitter=0.0).select("trace", "k", "c")


def _growing_rows(spark):
    """amplitude_t C_tu amplitude_u with amplitude 1 + t / 10."""
    rows = toeplitz_rows(_exponential_columns(spark), ["trace"])
    return rows.withColumn("row", F.transform("row", lambda v, u: v * (1 + u / 10) * (1 + F.col("t") / 10)))


FACTORS = {
    "diagonal": lambda spark: diagonal_factors(_trace_variances(spark), ["trace"]),
    "toeplitz": lambda spark: toeplitz_factors(_exponential_columns(spark), ["trace"]),
    "dense": lambda spark: dense_factors(_growing_rows(spark), ["trace"]),
}


def halves(x):
    """(trace, x): the two traces of a record of 58 samples."""
    return F.posexplode(F.array(F.slice(x, 1, 29), F.slice(x, 30, 29))).alias("trace", "x")


def _whitened_sql(kind, rows, value, by):
    """Named selects: white(by, i, z) with sum(z * z) the quadratic form of each trace of 29; logs(l) the log determinant of both."""
    scaled = f"{value} / (1 + (i % 29) / 10.0::DOUBLE)" if kind == "dense" else value
    var = "(0.02::DOUBLE * (1 + i // 29))"
    before = f"lag(e) OVER (PARTITION BY {by}, i // 29 ORDER BY i)"
    step = "e" if kind == "diagonal" else f"CASE WHEN i % 29 = 0 THEN e ELSE (e - {_RHO} * {before}) / sqrt(1 - {_RHO} * {_RHO}) END"
    corr = "0" if kind == "diagonal" else f"56 * ln(1 - {_RHO} * {_RHO})"
    grow = "2 * 2 * (SELECT sum(ln(1 + t / 10.0::DOUBLE)) FROM generate_series(0, 28) q(t))" if kind == "dense" else "0"
    return {"scaled": f"SELECT {by}, i, {scaled} AS e FROM {rows}", "white": f"SELECT {by}, i, ({step}) / sqrt({var}) AS z FROM scaled",
            "logs": f"SELECT 29 * ln(0.02::DOUBLE) + 29 * ln(0.04::DOUBLE) + {corr} + {grow} AS l"}


def _candidate_query(kind):
    sql = ctes("grad", rs="SELECT id, i, list_dot_product(theta, g) - d[i + 1] AS r FROM sims CROSS JOIN grad", **_whitened_sql(kind, "rs", "r", "id")) + f"""
SELECT id, {R('sum(z * z)', 4)} AS chi2, {R('max(l)', 6)} AS log_det, {R('-sum(z * z) / 2', 4)} AS log_likelihood, {R('-(sum(z * z) + max(l) + 58 * ln(2 * pi())) / 2', 4)} AS normalised FROM white CROSS JOIN logs GROUP BY id"""

    def run(spark, sf_dir, **way):
        made = C.synthesize(sims(spark, sf_dir), gradients(spark, sf_dir), P)
        residuals = made.select("id", F.zip_with("x", "d", lambda a, b: a - b).alias("r")).select("id", halves("r"))
        found = C.candidate_log_likelihood(residuals, materialise(FACTORS[kind](spark), "factors"), ["id"], ["trace"], **way)
        return found.select("id", rnd("chi2", 4).alias("chi2"), rnd("log_det").alias("log_det"), rnd("log_likelihood", 4).alias("log_likelihood"), rnd("normalised", 4).alias("normalised"))

    query(f"candidate_log_likelihood_{kind}", sql)(run)
    query(f"candidate_log_likelihood_{kind}_grouped", sql)(partial(run, memory=0, part_samples=29 * 40))


for _kind in FACTORS:
    _candidate_query(_kind)


PRIOR = ([0.05 * (a - 2) for a in range(P)], [0.01 * (1 + a) for a in range(P)])


def _solve_sql(steps, damping, adaptive, prior, t=""):
    """Damped steps from theta 0 with the products b, q and f of an event; the 6 x 6 systems by elimination. `t` sets its names apart."""
    mean, inverse = [[repr(float(v)) for v in c] for c in (prior[0], [1 / v for v in prior[1]])] if prior else (["0.0"] * P, ["0.0"] * P)
    fixed = f"[{', '.join(mean)}]::DOUBLE[] AS pm, [{', '.join(inverse)}]::DOUBLE[] AS pi"
    out = [f"s{t}0 AS MATERIALIZED (SELECT event, list_transform(range(6), lambda j: 0.0::DOUBLE) AS th, {damping}::DOUBLE AS lam, 'inf'::DOUBLE AS prev, b, q, f, {fixed} FROM nb JOIN nq USING (event) CROSS JOIN nf)"]
    for k in range(steps):
        lam = "CASE WHEN chi > 0.99 * prev THEN lam * 1.2 ELSE lam / 1.5 END" if adaptive else "lam"
        out.append(f"c{t}{k} AS MATERIALIZED (SELECT *, chi0 / 58 AS chi FROM (SELECT *, q - 2 * list_dot_product(b, th) + list_dot_product(th, list_transform(f, lambda r: list_dot_product(r, th))) AS chi0 FROM s{t}{k}))")
        out.append(f"l{t}{k} AS MATERIALIZED (SELECT * REPLACE ({lam} AS lam) FROM c{t}{k})")
        out.append(f"""m{t}{k}_0 AS MATERIALIZED (SELECT event, r, list_append(list_transform(range(1, 7), lambda j: f[r][j] + CASE WHEN j = r THEN pi[r] + lam * (f[r][r] + pi[r]) ELSE 0 END),
  b[r] - list_dot_product(f[r], th) + pi[r] * (pm[r] - th[r])) AS row FROM l{t}{k} CROSS JOIN range(1, 7) u(r))""")
        for c in range(1, P + 1):
            out.append(f"""m{t}{k}_{c} AS MATERIALIZED (SELECT x.event, x.r, list_transform(range(1, 8), lambda j: CASE WHEN x.r = {c} THEN x.row[j] / y.row[{c}] ELSE x.row[j] - x.row[{c}] / y.row[{c}] * y.row[j] END) AS row
  FROM m{t}{k}_{c - 1} x JOIN m{t}{k}_{c - 1} y ON x.event = y.event AND y.r = {c})""")
        out.append(f"s{t}{k + 1} AS MATERIALIZED (SELECT l.* EXCLUDE (chi, chi0) REPLACE (list_transform(range(1, 7), lambda j: th[j] + move[j]) AS th, chi AS prev) FROM l{t}{k} l JOIN (SELECT event, list(row[7] ORDER BY r) AS move FROM m{t}{k}_6 GROUP BY event) USING (event))")
    union = " UNION ALL ".join(f"SELECT event, {k} AS iteration, th, chi, chi0 + list_sum(list_transform(range(1, 7), lambda j: pi[j] * (th[j] - pm[j]) * (th[j] - pm[j]))) AS objective FROM c{t}{k}" for k in range(steps))
    return ",\n" + ",\n".join(out) + f""", al AS MATERIALIZED ({union})
SELECT event, iteration::INTEGER AS iteration, a::INTEGER AS a, {R('th[a + 1]', 5)} AS theta, {R('chi', 5)} AS chi2, {R('objective', 3)} AS objective, iteration = arg_min(iteration, chi) OVER (PARTITION BY event) AS best
FROM al CROSS JOIN range(0, 6) t(a)"""


def _products_sql(kind):
    """nb(event, b), nq(event, q), nf(f): gradients and observations whitened trace by trace."""
    white = _whitened_sql(kind, "both0", "v", "who")
    return ctes("grad", ob="SELECT ens, i, avg(v) AS o FROM sl GROUP BY 1, 2",
                both0="SELECT 'g' || a AS who, i, g[a + 1] AS v FROM grad CROSS JOIN range(0, 6) t(a) UNION ALL SELECT 'e' || ens, i, o FROM ob", **white,
                gz="SELECT substr(who, 2)::INTEGER AS a, i, z FROM white WHERE who[1] = 'g'", ez="SELECT substr(who, 2)::INTEGER AS event, i, z FROM white WHERE who[1] = 'e'",
                nb="SELECT event, list(v ORDER BY a) AS b FROM (SELECT event, a, sum(ez.z * gz.z) AS v FROM ez JOIN gz USING (i) GROUP BY 1, 2) GROUP BY event",
                nq="SELECT event, sum(z * z) AS q FROM ez GROUP BY event",
                nf="SELECT list(r ORDER BY a) AS f FROM (SELECT a, list(v ORDER BY b) AS r FROM (SELECT x.a, y.a AS b, sum(x.z * y.z) AS v FROM gz x JOIN gz y USING (i) GROUP BY 1, 2) GROUP BY a)").rstrip("\n")


def _least_squares_query(name, kind, steps, prior, damping=0.0, adaptive=False, **way):
    @query(name, _products_sql(kind) + _solve_sql(steps, damping, adaptive, prior))
    def run(spark, sf_dir):
        g = materialise(gradients(spark, sf_dir), "gradients")
        means = mean_vectors(sims(spark, sf_dir).select("ens", "d"), ["ens"], "d").select(F.col("ens").alias("event"), "d")
        obs = means.select("event", halves("d")).withColumnRenamed("x", "obs")
        start = means.select("event", F.array_repeat(F.lit(0.0), P).alias("theta"))
        simulate = lambda c: C.synthesize(c, g, P, out="whole").select("event", "pos", "offset", halves("whole"))
        history = C.solve_iterative(obs, start, simulate, [0.1] * P, iterations=steps, damping=damping, adaptive=adaptive, trace=["trace"],
                                    factors=materialise(FACTORS[kind](spark), "factors"), factor_keys=["trace"], prior=prior, **way)
        best = history.groupBy("event").agg(F.min_by("iteration", F.struct("chi2", "iteration")).alias("_best"))
        both = history.join(best, "event").select("event", "iteration", F.posexplode("theta").alias("a", "theta"), "chi2", "objective", (F.col("iteration") == F.col("_best")).alias("best"))
        return both.select("event", "iteration", "a", rnd("theta", 5).alias("theta"), rnd("chi2", 5).alias("chi2"), rnd("objective", 3).alias("objective"), "best")


_least_squares_query("least_squares_prior", "diagonal", 4, PRIOR, damping=0.5, adaptive=True)
_least_squares_query("least_squares_toeplitz", "toeplitz", 2, None)
_least_squares_query("least_squares_toeplitz_prior", "toeplitz", 4, PRIOR, damping=0.3, adaptive=True)
_least_squares_query("least_squares_dense_prior_grouped", "dense", 2, PRIOR, memory=0, part_samples=29 * 7 * 4)


def _two_points(spark, sf_dir):
    """The fiducial point, and one with doubled gradients and other fiducial values."""
    g = materialise(gradients(spark, sf_dir), "gradients")
    other = g.select("i", F.transform("g", lambda v: 2 * v).alias("g"), "v", (F.col("d0") + 0.01 * F.pmod("i", F.lit(3))).alias("d0"))
    return [(g, THETA), (other, [0.0] * P)]


_POINTS_SQL = ctes("grad", nb=f"""SELECT id * 2 + k AS event, list(s ORDER BY a) AS b FROM (SELECT id, k, a, sum(g[a + 1] * (sl.v - d0 - k * 0.01::DOUBLE * (i % 3)) / grad.v) / (1 + k) AS s
  FROM sl JOIN (SELECT i, g, v, d0 FROM grad) grad USING (i) CROSS JOIN range(0, 2) u(k) CROSS JOIN range(0, 6) t(a) GROUP BY 1, 2, 3) GROUP BY 1""",
    nq="SELECT event, 0.0::DOUBLE AS q FROM nb",
    nf="SELECT list(r ORDER BY a) AS f FROM (SELECT a, list(v ORDER BY b) AS r FROM (SELECT a, b, sum(g[a + 1] * g[b + 1] / v) AS v FROM grad CROSS JOIN range(0, 6) t(a) CROSS JOIN range(0, 6) u(b) GROUP BY 1, 2) GROUP BY a)").rstrip("\n")


@query("multi_point_estimates", _POINTS_SQL + _solve_sql(1, 0.0, False, None).split(", al AS")[0] + f"""
SELECT event // 2 AS id, (a + 6 * (event % 2))::INTEGER AS a, {R('th[a + 1] + CASE WHEN event % 2 = 0 THEN 0.01 * a ELSE 0 END', 5)} AS estimate FROM s1 CROSS JOIN range(0, 6) t(a)""")
def multi_point_estimates(spark, sf_dir):
    made = COMPRESSORS["multi_optimal_score"](sims(spark, sf_dir).select("id", F.col("d").alias("x")), _two_points(spark, sf_dir), ["id"])
    return rows(made, "estimate", "estimate", 5)


@query("observed_information", ctes("grad") + f", {FISHER}, h AS (SELECT sl.id, a, b, sum(g[a + 1] * g[b + 1] * (sl.v - d0) / gr.v) AS h FROM (SELECT i, g, v, d0 FROM grad) gr JOIN sl USING (i) CROSS JOIN range(0, 6) p(a) CROSS JOIN range(0, 6) q(b) GROUP BY 1, 2, 3) SELECT id, (a * 6 + b)::INTEGER AS a, {R('f - h', 3)} AS information FROM h JOIN fi USING (a, b)")
def observed_information(spark, sf_dir):
    g = materialise(gradients(spark, sf_dir), "gradients")
    second = F.flatten(F.transform("g", lambda a: F.transform("g", lambda b: a * b)))
    made = C.observed_information(sims(spark, sf_dir).select("id", "d"), g.withColumn("g", F.concat("g", second)), C.fisher_matrix(g, P), P, "d")
    return rows(made, "information", "information", 3)


# Estimates themselves, against the normal equations solved by SQL; the score-side checks above would not see a wrong F.
_ONE_POINT_SQL = ctes("grad", nb="SELECT id AS event, list(s ORDER BY a) AS b FROM (SELECT id, a, sum(g[a + 1] * (sl.v - d0) / gr.v) AS s FROM (SELECT i, g, v, d0 FROM grad) gr JOIN sl USING (i) CROSS JOIN range(0, 6) t(a) GROUP BY 1, 2) GROUP BY 1",
    nq="SELECT id AS event, sum((sl.v - d0) * (sl.v - d0) / gr.v) AS q FROM (SELECT i, v, d0 FROM grad) gr JOIN sl USING (i) GROUP BY 1",
    nf="SELECT list(r ORDER BY a) AS f FROM (SELECT a, list(v ORDER BY b) AS r FROM (SELECT a, b, sum(g[a + 1] * g[b + 1] / v) AS v FROM grad CROSS JOIN range(0, 6) t(a) CROSS JOIN range(0, 6) u(b) GROUP BY 1, 2) GROUP BY a)").rstrip("\n")


@query("estimate_values", _ONE_POINT_SQL + _solve_sql(1, 0.1, False, None, "d").split(", al AS")[0] + _solve_sql(1, 0.0, False, None).split(", al AS")[0] + f"""
SELECT s1.event AS id, a::INTEGER AS a, {R('s1.th[a + 1] + 0.01 * a', 5)} AS plain, {R('sd1.th[a + 1] + 0.01 * a', 5)} AS damped FROM s1 JOIN sd1 ON s1.event = sd1.event CROSS JOIN range(0, 6) t(a)""")
def estimate_values(spark, sf_dir):
    g = materialise(gradients(spark, sf_dir), "gradients")
    f = C.fisher_matrix(g, P)
    scored = C.scores(sims(spark, sf_dir).select("id", "d"), g, P, "d")
    both = C.estimates(C.estimates(scored, f, THETA), f, THETA, damping=0.1, out="damped").select("id", F.posexplode(F.arrays_zip(F.col("estimate").alias("plain"), "damped")).alias("a", "z"))
    return both.select("id", "a", rnd("z.plain", 5).alias("plain"), rnd("z.damped", 5).alias("damped"))


@query("least_squares_linear_theta", _ONE_POINT_SQL + _solve_sql(3, 0.2, True, None).split(", al AS")[0] + f""", al AS (SELECT event, 0 AS k, th, chi FROM c0 UNION ALL SELECT event, 1, th, chi FROM c1 UNION ALL SELECT event, 2, th, chi FROM c2)
SELECT event AS id, a::INTEGER AS a, {R('arg_min(th, chi)[a + 1] + 0.01 * a', 5)} AS theta, {R('min(chi)', 5)} AS chi2, arg_min(k, chi)::BIGINT AS iteration FROM al CROSS JOIN range(0, 6) t(a) GROUP BY event, a""")
def least_squares_linear_theta(spark, sf_dir):
    g = materialise(gradients(spark, sf_dir), "gradients")
    s = sims(spark, sf_dir).select("id", "d")
    level = g.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "d0", "v"))), lambda r: F.struct(r["d0"].alias("d0"), r["v"].alias("v"))).alias("level"))
    misfit = F.aggregate(F.zip_with("d", "level", lambda x, r: (x - r["d0"]) * (x - r["d0"]) / r["v"]), F.lit(0.0), lambda a, v: a + v) / N
    scored = C.scores(s.crossJoin(level).withColumn("misfit", misfit).drop("level"), g, P, "d")
    solved = C.solve_linear(scored, C.fisher_matrix(g, P), THETA, N, "misfit", iterations=3, damping=0.2)
    return solved.select("id", F.posexplode("theta").alias("a", "theta"), "chi2", "iteration").select("id", "a", rnd("theta", 5).alias("theta"), rnd("chi2", 5).alias("chi2"), F.col("iteration").cast("long").alias("iteration"))


# The same results on the way that kernels beyond the broadcast size take.
for _name, _query in {"linear_synthesis": linear_synthesis, "stencil_derivatives": stencil_derivatives, "hessian": hessian}.items():
    query(f"{_name}_long_form", CHECKS[_name])(partial(_query, memory=0))
