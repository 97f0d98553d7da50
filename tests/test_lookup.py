"""Bracketing joins, first rows in an order, binned densities, failing metrics, several expansion points."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quietwave.operators import compression as C
from quietwave.operators import metrics as K
from quietwave.operators import ordering as O
from quietwave.operators import pairing as J
from quietwave.operators import posterior as P


def test_bracketed_on_an_irregular_grid(spark):
    grid = [0.0, 0.1, 0.15, 4.0, 50.0, 50.5]
    table = spark.createDataFrame([(b, d, d * d + (b or 7)) for b in (1, 2, None) for d in grid], "bin int, d double, v double")
    rng = np.random.default_rng(0)
    rows = [(i, [1, 2, 3, None][i % 4], float(x)) for i, x in enumerate(rng.uniform(-1, 52, 200))] + [(900, 1, 50.5), (901, 1, 0.0), (902, 2, None), (903, 1, 0.15)]
    left = spark.createDataFrame(rows, "id int, bin int, x double")
    got = {r["id"]: r["v"] for r in J.bracketed(left, table, "x", ["v"], ["bin"], "d").collect()}
    assert len(got) == len(rows)
    for i, b, x in rows:
        if b == 3 or x is None or not 0 <= x <= 50.5:
            assert got[i] is None
        else:
            assert got[i] == pytest.approx(np.interp(x, grid, [d * d + (b or 7) for d in grid]))


def test_arrivals_by_phase_and_without_a_bin(spark):
    table = spark.createDataFrame([(0.0, 0.0, 0.0), (10.0, 100.0, 180.0), (30.0, None, 500.0)], "distance double, P double, S double")
    pairs = spark.createDataFrame([(1, 5.0), (2, 20.0), (3, 31.0)], "id int, distance double")
    every = {r["id"]: (r["first"], r["last"]) for r in J.arrivals(pairs, table, "distance", phases=["P", "S"]).collect()}
    assert every == {1: (50.0, 90.0), 2: (340.0, 340.0), 3: (None, None)}
    alone = {r["id"]: (r["first"], r["last"]) for r in J.arrivals(pairs, table, "distance", first_p=True).collect()}
    assert alone == {1: (50.0, 50.0), 2: (None, None), 3: (None, None)}
    one = J.arrivals(pairs, table.where("distance = 0"), "distance", phases=["P", "S"])
    assert [r["first"] for r in one.collect()] == [None] * 3


@pytest.mark.parametrize("n", [0, 1, 700, 3000, 9000])
def test_first_n_by_counted_chunks(spark, n):
    rng = np.random.default_rng(1)
    values = [float(v) for v in rng.integers(0, 40, 4000)] + [7.0] * 1000
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, v double").repartition(6)
    got = O.first_n(df, ["v"], n, few=-1)
    assert got.columns == ["id", "v"]
    rows = got.collect()
    assert sorted(r["v"] for r in rows) == sorted(values)[:n] and len({r["id"] for r in rows}) == len(rows)
    exact = O.first_n(df, ["v", "id"], n, few=-1).collect()
    assert sorted((r["v"], r["id"]) for r in exact) == sorted((v, i) for i, v in enumerate(values))[:n]


def test_first_n_of_each_group(spark):
    rng = np.random.default_rng(2)
    rows = [(["a", "b", None][i % 3] if i < 900 else "a", i, float(rng.normal())) for i in range(3000)] + [("few", 9000, 1.0)]
    df = spark.createDataFrame(rows, "g string, id long, v double").repartition(5)
    got = O.first_n(df, ["v", "id"], 250, ["g"]).collect()
    for g in ("a", "b", None, "few"):
        assert sorted((r["v"], r["id"]) for r in got if r["g"] == g) == sorted((v, i) for k, i, v in rows if k == g)[:250]


def test_binned_density_nears_the_exact_sum(spark):
    rng = np.random.default_rng(3)
    rows = [("a", float(x), float(y)) for x, y in rng.multivariate_normal([0, 0], [[1, 0.6], [0.6, 2]], 400)]
    rows += [(None, float(x), float(y)) for x, y in rng.normal(size=(200, 2)) * [0.2, 3]] + [("one", 0.0, 0.0), ("line", 1.0, 2.0), ("line", 2.0, 4.0), ("line", 3.0, 6.0), ("far", 1e6, 1e6), ("far", 1e6 + 1, 1e6), ("far", 1e6, 1e6 + 1)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    grid = [-2.0 + 0.4 * k for k in range(11)]
    exact = {(r["g"], r["ix"], r["iy"]): r["density"] for r in P.kde_on_grid(df, ["g"], "x", "y", grid, grid).collect()}
    for fine, near in ((4, 0.1), (32, 0.004)):  # steps of 1.2 and 0.15 kernel widths of the narrow group
        binned = {(r["g"], r["ix"], r["iy"]): r["density"] for r in P.kde_binned(df, ["g"], "x", "y", grid, grid, fine).collect()}
        assert binned.keys() == exact.keys() and len(exact) == 5 * 121
        for g in ("a", None):
            top = max(v for k, v in exact.items() if k[0] == g)
            assert max(abs(binned[k] - v) for k, v in exact.items() if k[0] == g) < near * top
        assert all(v is None for k, v in binned.items() if k[0] in ("one", "line")) and all(v == 0 for k, v in binned.items() if k[0] == "far")
    assert all(v is None for k, v in exact.items() if k[0] in ("one", "line"))


def test_a_raising_metric_spares_the_others(spark):
    rows = [(1, [1.0, 2.0], [1.0, 1.0]), (2, [-1.0, 2.0], [1.0, 1.0]), (3, None, [1.0, 1.0]), (4, [1.0], [1.0, 1.0]), (5, [3.0, 4.0, 5.0], [0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "id int, x array<double>, obs array<double>")

    def picky(x, obs):
        if (x < 0).any():
            raise ValueError("negative")
        return x.sum(axis=1)

    registry = K.MetricRegistry()
    registry.add_metric("good", K.array_metric(lambda x, obs: (x - obs).sum(axis=1)))
    registry.add_metric("picky", K.array_metric(picky))
    registry.add_metric("wrong", K.array_metric(lambda x, obs: np.zeros(99)))
    registry.add_metric("broken", K.column_metric(F.col("nowhere")))
    got = {(r["id"], r["metric"]): (r["value"], r["error"]) for r in registry.evaluate(df, ["id"], errors=True).collect()}
    assert [got[i, "good"][0] for i in (1, 2, 5)] == [1.0, -1.0, 12.0] and np.isnan(got[3, "good"][0]) and np.isnan(got[4, "good"][0])
    assert got[1, "picky"] == (3.0, None) and got[5, "picky"] == (12.0, None) and np.isnan(got[2, "picky"][0]) and "negative" in got[2, "picky"][1]
    assert all(np.isnan(got[i, "broken"][0]) and got[i, "broken"][1] for i in range(1, 6))
    assert registry.evaluate(df, ["id"]).columns == ["id", "metric", "value"]


@pytest.mark.parametrize("way", [{}, {"memory": 0}])
def test_several_points_by_one_product(spark, way):
    rng = np.random.default_rng(4)
    n, p = 20, 2
    points, want = [], []
    data = rng.normal(size=(7, n))
    for theta in ([0.1, 0.2], [0.0, -1.0], [2.0, 3.0]):
        g, v, d0 = rng.normal(size=(n, p)), rng.uniform(1, 2, n), rng.normal(size=n)
        points.append((spark.createDataFrame([(i, g[i].tolist(), float(v[i]), float(d0[i])) for i in range(n)], "i int, g array<double>, v double, d0 double"), theta))
        f = (g / v[:, None]).T @ g + np.diag([1 / 0.5, 1 / 0.7])
        s = (data - d0) @ (g / v[:, None]) + (np.array([1.0, 2.0]) - theta) / [0.5, 0.7]
        want.append(theta + np.linalg.solve(f, s.T).T)
    records = spark.createDataFrame([(e, data[e].tolist()) for e in range(7)], "id int, x array<double>")
    made = C.estimates_at_points(records, points, prior=([1.0, 2.0], [0.5, 0.7]), **way)
    for r in made.collect():
        assert np.allclose(r["estimate"], np.concatenate([w[r["id"]] for w in want]))
    if not way:
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 0 and plan.count("ArrowEvalPython") == 1
