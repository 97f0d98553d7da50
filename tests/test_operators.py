import numpy as np
import pytest
from pyspark.sql import functions as F

from quietwave.functions import arrays as A
from quietwave.functions import scalers as S
from quietwave.operators import compression as C
from quietwave.operators import covariance as V
from quietwave.operators import inference as N
from quietwave.operators import metrics as K
from quietwave.operators import noise as Z
from quietwave.operators import pairing as J
from quietwave.operators import posterior as P
from quietwave.operators import quality as Q
from quietwave.operators import traces as T


def test_every_with_every_by_slices_equals_inlining(spark):
    left, right = spark.range(40).withColumnRenamed("id", "a"), spark.range(25).withColumnRenamed("id", "b")
    want = {(a, b) for a in range(40) for b in range(25)}
    assert {tuple(r) for r in J.with_every(left, right).collect()} == want
    assert {tuple(r) for r in J.with_every(left, right, limit=4).collect()} == want


def hot_vectors(spark, n=900, size=12, seed=0):
    rng = np.random.default_rng(seed)
    rows = [("hot" if i % 3 == 0 else f"s{i % 7}", i, [float(v) for v in rng.normal(size=size)]) for i in range(n)]
    return rows, spark.createDataFrame(rows, "station string, id int, x array<double>")


def test_block_solves_agree_broadcast_salted_and_toeplitz(spark):
    rows, df = hot_vectors(spark)
    stations = df.select("station").distinct().withColumn("variance", F.lit(2.0))
    cov = Z.damped_cosine_columns(stations, 12).select("station", "k", "c")
    blocks = V.toeplitz_rows(cov, ["station"])
    first = {r["id"]: r["y"] for r in V.solve_toeplitz(df, cov, ["station"]).collect()}
    second = {r["id"]: r["y"] for r in V.apply_blocks(df, blocks, ["station"], "solve").collect()}
    third = {r["id"]: r["y"] for r in V.apply_blocks(df, blocks, ["station"], "solve", memory=0, part_samples=600).collect()}
    c = 2.0 * np.exp(-np.arange(12) / 20) * np.cos(0.22 * np.arange(12))
    c[0] *= 1.01
    dense = c[np.abs(np.subtract.outer(np.arange(12), np.arange(12)))]
    for _, i, x in rows:
        want = np.linalg.solve(dense, x)
        for got in (first, second, third):
            assert np.allclose(got[i], want, rtol=1e-8)


def test_gram_with_a_hot_key_and_flushes_equals_numpy(spark):
    rows, df = hot_vectors(spark, 700, 6)
    got = {(r["station"], r["t"]): (r["row"], r["n"]) for r in V.gram_rows(df, ["station"], memory=1).collect()}
    for station in {r[0] for r in rows}:
        block = np.array([x for s, _, x in rows if s == station])
        for t in range(6):
            assert np.allclose(got[(station, t)][0], (block.T @ block)[t]) and got[(station, t)][1] == len(block)


def test_theory_covariance_about_a_fiducial_trace(spark):
    rows, df = hot_vectors(spark, 200, 5)
    fiducial = df.select("station").distinct().withColumn("x", F.array(*[F.lit(0.1)] * 5))
    got = {(r["station"], r["t"]): r["row"] for r in V.theory_covariance(df, ["station"], fiducial).collect()}
    block = np.array([x for s, _, x in rows if s == "hot"]) - 0.1
    assert np.allclose([got[("hot", t)] for t in range(5)], block.T @ block / (len(block) - 1))


def test_moments_merge_in_any_split(spark):
    df = spark.range(1000).withColumn("x", F.sin("id") * 3 + 1).withColumn("b", F.pmod("id", F.lit(7)))
    states = Z.moments(df.withColumn("g", F.lit(1)), ["g", "b"], "x")
    row = Z.merge_moments(states.drop("b"), ["g"]).first()
    x = np.sin(np.arange(1000)) * 3 + 1
    assert row["n"] == 1000 and row["mean"] == pytest.approx(x.mean()) and row["sd"] == pytest.approx(x.std())


def test_nearest_draws_in_blocks_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    prior = [(i, [float(v) for v in rng.normal(size=3)]) for i in range(500)]
    observed = [(e, [float(v) for v in rng.normal(size=3)]) for e in range(11)]
    got = N.nearest_draws(spark.createDataFrame(prior, "id long, t array<double>").repartition(5), spark.createDataFrame(observed, "event long, t array<double>"),
                          "id", "event", "t", 7, block=3)
    rows = {(r["event"], r["rank"]): r["id"] for r in got.collect()}
    for e, t in observed:
        order = sorted((np.linalg.norm(np.array(p) - t), i) for i, p in prior)[:7]
        assert [rows[(e, k + 1)] for k in range(7)] == [i for _, i in order]


def test_weights_ignore_impossible_rows(spark):
    inf = float("-inf")
    df = spark.createDataFrame([("a", 0.0), ("a", inf), ("a", 0.0), ("b", inf), ("b", inf)], "event string, logp double")
    got = sorted((r["event"], r["weight"]) for r in N.posterior_weights(df, ["event"]).where("event = 'a'").collect())
    assert [w for _, w in got] == [0.0, 0.5, 0.5]
    assert N.posterior_weights(df, ["event"]).where("event = 'b' AND weight IS NOT NULL").count() == 0


def linear_problem(spark, seed=0):
    rng = np.random.default_rng(seed)
    g = rng.normal(size=(40, 3))
    rows = [(i, [float(v) for v in g[i]], 0.5, 0.0) for i in range(40)]
    gradients = spark.createDataFrame(rows, "i int, g array<double>, v double, d0 double")
    truth = rng.normal(size=(6, 3))
    data = truth @ g.T + 0.01 * rng.normal(size=(6, 40))
    obs = spark.createDataFrame([(e, [float(v) for v in data[e]]) for e in range(6)], "event int, obs array<double>")
    return g, gradients, data, obs


def test_iterative_least_squares_reaches_the_linear_solution(spark):
    g, gradients, data, obs = linear_problem(spark)
    start = obs.select("event", F.array(*[F.lit(0.0)] * 3).alias("theta"))
    history = C.solve_iterative(obs, start, lambda c: C.synthesize(c, gradients, 3), [0.1] * 3, 0.5, iterations=3, damping=1e-9)
    best = {r["event"]: r for r in P.best_iteration(history, ["event"], keep=["theta"]).collect()}
    closed = np.linalg.lstsq(g, data.T, rcond=None)[0].T
    for e in range(6):
        assert np.allclose(best[e]["theta"], closed[e], atol=1e-6)
    fisher = C.fisher_matrix(gradients, 3)
    assert np.allclose(fisher, g.T @ g / 0.5)
    scored = C.scores(obs, gradients, 3, "obs").withColumn("misfit", A.power("obs") / 0.5 / 40)
    direct = {r["event"]: r for r in C.solve_linear(scored, fisher, [0.0] * 3, 40, "misfit", 12, 1e-6).collect()}
    for e in range(6):
        assert np.allclose(direct[e]["theta"], closed[e], atol=1e-6)
        residual = data[e] - g @ closed[e]
        assert direct[e]["chi2"] == pytest.approx(residual @ residual / 0.5 / 40, rel=1e-4)


def test_long_and_broadcast_products_agree(spark):
    g, gradients, data, obs = linear_problem(spark, 3)
    a = {r["event"]: r["score"] for r in C.scores(obs, gradients, 3, "obs").collect()}
    b = {r["event"]: r["score"] for r in C.scores(obs, gradients, 3, "obs", memory=0).collect()}
    theta = obs.select("event", F.slice("obs", 1, 3).alias("theta"))
    x = {r["event"]: r["x"] for r in C.synthesize(theta, gradients, 3).collect()}
    y = {r["event"]: r["x"] for r in C.synthesize(theta, gradients, 3, memory=0).collect()}
    for e in range(6):
        assert np.allclose(a[e], b[e]) and np.allclose(x[e], y[e]) and np.allclose(a[e], data[e] @ g / 0.5)


def test_scalers_invert(spark):
    df = spark.createDataFrame([(v,) for v in (-80.0, -3.0, -0.2, 0.0, 0.4, 7.0, 99.0)], "x double")
    x, lo, hi = F.col("x"), F.lit(0.5), F.lit(100.0)
    rows = df.select(
        "x", S.from_unit(S.to_unit(x, F.lit(-100.0), hi), F.lit(-100.0), hi).alias("u"), S.signed_log_inverse(S.signed_log(x, lo, hi), lo, hi).alias("s"),
        S.to_unit(x, lo, lo).alias("pinned"), S.linear_log(F.lit(0.25), lo, hi).alias("l")).collect()
    for r in rows:
        assert r["u"] == pytest.approx(r["x"]) and r["pinned"] is None and r["l"] == pytest.approx(0.525)
        if abs(r["x"]) > 0.5:
            assert r["s"] == pytest.approx(r["x"])


def test_relative_error_sign_is_a_choice(spark):
    df = spark.createDataFrame([(1, [-0.1], [20.0]), (2, [0.5], [0.6]), (3, [0.0], [1.0])], "id int, t array<double>, c array<double>")
    ids = lambda d: {r["id"] for r in d.collect()}
    assert ids(Q.drop_bad_compressions(df, "t", "c")) == {2}
    assert ids(Q.drop_bad_compressions(df, "t", "c", signed=True)) == {1, 2}


def test_window_verdict_gives_the_first_reason(spark):
    full = [("w1", s, c, 10, 1.0) for s in "ab" for c in "Z12"]
    rows = full + [("w2", "a", c, 10, 0.0) for c in "Z12"] + [("w2", "b", c, 10, 1.0) for c in "Z1"] + [("w3", "a", c, 10, 1e-31 if c == "Z" else 1.0) for c in "Z12"] \
        + [("w4", "a", c, 0, None) for c in "Z12"] + [("w5", "a", c, 0 if c == "Z" else 5, 1.0) for c in "Z12"]
    got = {r["w"]: r["reason"] for r in Q.window_verdicts(spark.createDataFrame(rows, "w string, station string, component string, n int, variance double"), ["w"]).collect()}
    assert got == {"w1": None, "w2": "b comp", "w3": "a variance", "w4": "a empty", "w5": "a no data"}


def test_metric_registry_nan_and_empty_ensembles(spark):
    registry = K.standard_metrics()
    with pytest.raises(KeyError):
        registry.add_metric("mse", K.column_metric(K.mse()))
    registry.add_metric("broken", K.column_metric(F.lit(None).cast("double")))
    df = spark.createDataFrame([("a", 1, [1.0, 2.0], [1.0, 1.0])], "ens string, id int, x array<double>, obs array<double>")
    ensembles = spark.createDataFrame([("a",), ("empty",)], "ens string")
    got = {(r["ens"], r["metric"]): r["mean"] for r in K.summarise(registry.evaluate(df, ["ens", "id"]), ensembles).collect()}
    assert got[("a", "mse")] == 0.5 and np.isnan(got[("a", "broken")]) and np.isnan(got[("empty", "mse")])
    ranked = K.best_synthetics(spark.createDataFrame([("a", 1, float("nan")), ("a", 2, 3.0), ("a", 3, 3.0)], "ens string, id int, value double"), ["ens"], "id", 10)
    assert [r["id"] for r in ranked.orderBy("rank").collect()] == [2, 3, 1]


def test_constant_trace_has_no_correlation(spark):
    df = spark.createDataFrame([(1, [2.0] * 5, [1.0, 2.0, 3.0, 4.0, 5.0]), (2, [1.0, 2.0, 3.0, 4.0, 5.0], [2.0, 4.0, 6.0, 8.0, 10.0])], "id int, x array<double>, obs array<double>")
    got = {r["id"]: r["value"] for r in K.correlation_misfit(df, ["id"]).collect()}
    assert got[1] == pytest.approx(1.0) and got[2] == pytest.approx(0.0, abs=1e-9)


def test_zero_makes_a_metric_null_when_lower_is_better(spark):
    df = spark.createDataFrame([("a", "m", 0.0), ("b", "m", 2.0), ("a", "n", 1.0), ("b", "n", 4.0), ("a", "n_var", 9.0)], "ens string, metric string, mean double")
    got = {(r["ens"], r["metric"]): r["score"] for r in K.normalise_to_best(df).collect()}
    assert got == {("a", "m"): None, ("b", "m"): None, ("a", "n"): 1.0, ("b", "n"): 4.0}
    up = {(r["ens"], r["metric"]): r["score"] for r in K.normalise_to_best(df, ["n"]).collect()}
    assert up[("a", "n")] == 0.25


def test_bias_of_one_sample_uses_the_floor_and_angles_wrap(spark):
    rows = [("one", 1.0, 0.0, None), ("turn", 179.0, -179.0, 360.0), ("turn", -179.0, -179.0, 360.0)]
    got = {r["e"]: r for r in P.bias_table(spark.createDataFrame(rows, "e string, value double, truth double, period double"), ["e"]).collect()}
    assert got["one"]["sd"] == 1e-12 and got["one"]["u"] == 1.0
    assert got["turn"]["mu"] == pytest.approx(-1.0)
    assert got["turn"]["spread"] == pytest.approx(1.0, abs=1e-3)


def test_shift_pads_and_returns(spark):
    df = spark.createDataFrame([(s, [1.0, 2.0, 3.0, 4.0]) for s in (0, 1, -2, 9)], "s int, x array<double>")
    got = {r["s"]: (r["y"], r["z"]) for r in df.select("s", A.shift("x", "s").alias("y"), A.shift(A.shift("x", "s"), -F.col("s")).alias("z")).collect()}
    assert got[0][0] == [1, 2, 3, 4] and got[1][0] == [0, 1, 2, 3] and got[-2][0] == [3, 4, 0, 0] and got[9][0] == [0, 0, 0, 0]
    assert got[1][1] == [1, 2, 3, 0] and got[-2][1] == [0, 0, 3, 4]


def test_gap_takes_the_latest_value_and_conflicts_are_gaps(spark):
    rows = [("a", 0, 1.0), ("a", 1, 2.0), ("a", 1, 2.0), ("a", 4, 5.0), ("a", 6, 7.0), ("a", 6, 8.0), ("a", 7, 9.0)]
    got = {r["slot"]: (r["x"], r["filled"]) for r in T.fill_gaps(spark.createDataFrame(rows, "k string, ts long, x double"), ["k"], 1, rows_per_chunk=2).collect()}
    assert got == {0: (1.0, False), 1: (2.0, False), 2: (2.0, True), 3: (2.0, True), 4: (5.0, False), 5: (5.0, True), 6: (5.0, True), 7: (9.0, False)}


def test_hpd_threshold_and_last_bin(spark):
    cells = spark.createDataFrame([(0, k, float(v)) for k, v in enumerate([5, 1, 3, 1])], "g int, c int, density double")
    got = {r["level"]: r["threshold"] for r in P.hpd_thresholds(cells, ["g"], ["c"], levels=(0.5, 0.8, 1.0), rows_per_chunk=2).collect()}
    assert got == {0.5: 5.0, 0.8: 3.0, 1.0: 1.0}
    df = spark.createDataFrame([(0, v) for v in (0.0, 0.5, 1.0, 1.0001, -0.1)], "g int, x double")
    assert {r["bin"]: r["value"] for r in P.histogram(df, ["g"], "x", 0, 1, 2).collect()} == {0: 1.0, 1: 2.0}
