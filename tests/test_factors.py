"""Factored covariances, likelihoods and least squares with priors against direct linear algebra."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quietwave.operators import compression as C
from quietwave.operators import factors as X


def toeplitz(column):
    n = len(column)
    return column[np.abs(np.subtract.outer(np.arange(n), np.arange(n)))]


def columns(spark, by_key):
    return spark.createDataFrame([(k, i, float(v)) for k, c in by_key.items() for i, v in enumerate(c)], "k string, lag int, c double").withColumnRenamed("lag", "l")


WAYS = [{}, {"memory": 0}, {"memory": 0, "part_samples": 40}]


@pytest.mark.parametrize("way", WAYS)
def test_solve_keeps_every_vector(spark, way):
    rng = np.random.default_rng(0)
    column = 2.0 * np.exp(-np.arange(12) / 3)
    rows = [("hot", rng.normal(size=12).tolist()) for _ in range(30)] + [("hot", [1.0] * 12)] * 9 + [(None, [2.0] * 12), ("none", [1.0] * 12), ("hot", None), ("cold", [1.0] * 12)]
    df = spark.createDataFrame(rows, "k string, x array<double>")
    table = X.toeplitz_factors(columns(spark, {"hot": column, None: column, "cold": column}), ["k"], "l")
    got = X.solve(df, table, ["k"], **way).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["k"] == "none" or r["x"] is None:
            assert r["y"] is None
        else:
            assert np.allclose(toeplitz(column) @ r["y"], r["x"])


def test_long_toeplitz_by_fft(spark):
    n = 4096
    lag = np.arange(n)
    column = 3.0 * np.exp(-lag / 50) * np.cos(lag / 9) + 0.03 * (lag == 0)
    first, log_det = X.inverse_column(column)
    factor = X.Factor("toeplitz", n, log_det, np.concatenate([first, column]))
    x = np.random.default_rng(1).normal(size=(3, n))
    dense = toeplitz(column)
    assert np.allclose(dense @ factor.solve(x).T, x.T, atol=1e-9)
    assert log_det == pytest.approx(np.linalg.slogdet(dense)[1], rel=1e-9)


@pytest.mark.parametrize("way", WAYS)
def test_forms_of_every_kind(spark, way):
    rng = np.random.default_rng(2)
    a = rng.normal(size=(5, 5))
    dense, column, variances = a @ a.T + np.eye(5), np.exp(-np.arange(5) / 2), rng.uniform(1, 2, 5)
    blocks = spark.createDataFrame([("d", i, r.tolist()) for i, r in enumerate(dense)], "k string, t int, row array<double>")
    table = X.dense_factors(blocks, ["k"]).unionByName(X.toeplitz_factors(columns(spark, {"t": column}), ["k"], "l")).unionByName(
        X.diagonal_factors(spark.createDataFrame([("v", variances.tolist())], "k string, v array<double>"), ["k"], "v")).unionByName(
        X.diagonal_factors(spark.createDataFrame([("s", 4.0)], "k string, variance double"), ["k"]))
    matrices = {"d": dense, "t": toeplitz(column), "v": np.diag(variances), "s": 4 * np.eye(5)}
    rows = [(k, rng.normal(size=15).tolist()) for k in matrices for _ in range(6)]
    for r in X.quadratic_forms(spark.createDataFrame(rows, "k string, x array<double>"), table, ["k"], 3, **way).collect():
        stack, matrix = np.reshape(r["x"], (3, 5)), matrices[r["k"]]
        assert np.allclose(r["forms"], (stack @ np.linalg.solve(matrix, stack.T))[np.triu_indices(3)])
        assert r["log_det"] == pytest.approx(np.linalg.slogdet(matrix)[1])


def test_wrong_length_and_bad_matrices_stop(spark):
    table = X.toeplitz_factors(columns(spark, {"k": [1.0, 0.5]}), ["k"], "l")
    with pytest.raises(Exception, match="samples"):
        X.solve(spark.createDataFrame([("k", [1.0])], "k string, x array<double>"), table, ["k"]).collect()
    with pytest.raises(Exception, match="positive definite"):
        X.toeplitz_factors(columns(spark, {"k": [1.0, 2.0]}), ["k"], "l").collect()


def problem(spark, traces=40, n=15, p=3, events=3):
    """Events of many traces, each with a Toeplitz covariance of its station."""
    rng = np.random.default_rng(3)
    g = rng.normal(size=(traces, n, p))
    cov = {s: toeplitz((1 + s) * np.exp(-np.arange(n) / (2 + s))) for s in range(4)}
    data = np.einsum("tnp,ep->etn", g, rng.normal(size=(events, p))) + rng.normal(size=(events, traces, n))
    obs = [(e, t, t % 4, data[e, t].tolist()) for e in range(events) for t in range(traces)]
    kernels = spark.createDataFrame([(t, g[t].T.tolist()) for t in range(traces)], "t int, g array<array<double>>")
    columns = [(s, k, float(c[0, k])) for s, c in cov.items() for k in range(n)]
    return g, cov, data, spark.createDataFrame(obs, "event int, t int, station int, obs array<double>"), kernels, X.toeplitz_factors(spark.createDataFrame(columns, "station int, k int, c double"), ["station"])


def linear(kernels):
    def simulate(c):
        terms = F.zip_with("g", "theta", lambda row, m: F.transform(row, lambda v: v * m))
        return c.crossJoin(kernels).withColumn("_terms", terms).withColumn("x", F.aggregate(F.slice("_terms", 2, 9), F.col("_terms")[0], lambda a, b: F.zip_with(a, b, lambda x, y: x + y)))
    return simulate


@pytest.mark.parametrize("way", WAYS[:2])
def test_least_squares_with_prior_and_toeplitz_noise(spark, way):
    g, cov, data, obs, kernels, table = problem(spark)
    mean, spread = np.array([0.5, -0.5, 0.0]), np.array([[0.02, 0.01, 0.0], [0.01, 0.03, 0.0], [0.0, 0.0, 0.05]])
    start = obs.select("event").distinct().withColumn("theta", F.array(*[F.lit(0.1)] * 3))
    lost = spark.createDataFrame([(7, 0, 99, [0.0] * 15), (7, 1, 1, [0.0] * 15)], obs.schema)
    starts = start.unionByName(spark.createDataFrame([(7, [0.0] * 3), (8, [0.0] * 3)], "event int, theta array<double>"))
    history = C.solve_iterative(obs.unionByName(lost), starts, linear(kernels), [0.1] * 3, iterations=6, damping=1e-4, trace=["t"], factors=table,
                                factor_keys=["station"], prior=(mean, spread), tolerance=1e-8, **way).toPandas()
    for e in range(3):
        mine = history[history.event == e].sort_values("iteration")
        f = sum(g[t].T @ np.linalg.solve(cov[t % 4], g[t]) for t in range(40)) + np.linalg.inv(spread)
        s = sum(g[t].T @ np.linalg.solve(cov[t % 4], data[e, t]) for t in range(40)) + np.linalg.inv(spread) @ mean
        closed = np.linalg.solve(f, s)
        assert np.allclose(mine.theta.iloc[-1], closed, atol=1e-6) and mine.converged.iloc[-1] and not mine.converged.iloc[0] and len(mine) < 6
        residual = [data[e, t] - g[t] @ mine.theta.iloc[-1] for t in range(40)]
        chi = sum(r @ np.linalg.solve(cov[t % 4], r) for t, r in enumerate(residual))
        away = mine.theta.iloc[-1] - mean
        assert mine.chi2.iloc[-1] == pytest.approx(chi / 600) and mine.objective.iloc[-1] == pytest.approx(chi + away @ np.linalg.solve(spread, away))
    # a trace without a covariance, an event without traces: one step of nulls
    for e in (7, 8):
        mine = history[history.event == e]
        assert len(mine) == 1 and mine.chi2.isna().all() and mine.converged.all()


def test_candidates_of_several_traces(spark):
    g, cov, data, obs, kernels, table = problem(spark)
    rows = [(e, r["t"], r["station"], r["obs"]) for e in range(3) for r in obs.where(f"event = {e}").collect()] + [(9, 0, None, [1.0] * 15), (9, 1, 1, [1.0] * 15)]
    df = spark.createDataFrame(rows, "id int, t int, station int, x array<double>")
    got = {r["id"]: r for r in C.candidate_log_likelihood(df, table, ["id"], ["station"]).collect()}
    for e in range(3):
        chi = sum(data[e, t] @ np.linalg.solve(cov[t % 4], data[e, t]) for t in range(40))
        log_det = sum(np.linalg.slogdet(cov[t % 4])[1] for t in range(40))
        assert got[e]["chi2"] == pytest.approx(chi) and got[e]["log_det"] == pytest.approx(log_det)
        assert got[e]["normalised"] == pytest.approx(-(chi + log_det + 600 * np.log(2 * np.pi)) / 2)
    assert got[9]["log_likelihood"] is None
