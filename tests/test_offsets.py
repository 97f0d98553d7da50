"""Statistics of data with a large offset, null keys, and keys without a block."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quietwave.operators import compression, covariance, factors, inference, intervals, noise, priors

OFFSET = 1e8


def test_merged_moments_keep_the_spread(spark):
    states = spark.createDataFrame([("a", 2, OFFSET, 0.5), ("a", 2, OFFSET + 1, 0.5), (None, 1, 3.0, 0.0), (None, 1, 5.0, 0.0)], "k string, n long, mean double, m2 double")
    got = {r["k"]: r for r in noise.merge_moments(states, ["k"]).collect()}
    assert got["a"]["m2"] == pytest.approx(2.0) and got["a"]["mean"] == OFFSET + 0.5 and got["a"]["n"] == 4
    assert got[None]["m2"] == pytest.approx(2.0)
    assert noise.merge_moments(states.where("k = 'a'"), []).first()["m2"] == pytest.approx(2.0)


def test_panes_keep_the_spread(spark):
    minute = intervals.MINUTE
    samples = spark.createDataFrame([("s", i * minute // 4, OFFSET + 0.01 * (i % 2)) for i in range(400)], "station string, ts long, x double")
    regions = spark.createDataFrame([(0, 90 * minute)], "s long, e long")
    rows = intervals.pane_statistics(samples, regions, ["station"], 29 * minute, 3 * minute, 5 * minute, minute).collect()
    assert rows and all(r["variance"] == pytest.approx(2.5e-5, rel=1e-2) and r["n"] == 117 for r in rows)


@pytest.mark.parametrize("memory", [0, 1 << 20])
def test_blocks_keep_every_vector(spark, memory):
    vectors = spark.createDataFrame([(1, [2.0, 4.0]), (None, [2.0, 4.0]), (9, [1.0, 1.0]), (9, [1.0, 1.0])], "k int, x array<double>")
    blocks = spark.createDataFrame([(1, 0, [4.0, 0.0]), (1, 1, [0.0, 4.0]), (None, 0, [1.0, 0.0]), (None, 1, [0.0, 1.0])], "k int, t int, row array<double>")
    got = sorted(((r["k"], r["y"]) for r in covariance.apply_blocks(vectors, blocks, ["k"], "solve", memory=memory).collect()), key=str)
    assert got == sorted([(1, [0.5, 1.0]), (None, [2.0, 4.0]), (9, None), (9, None)], key=str)
    none = covariance.apply_blocks(vectors.where("k = 9"), blocks, ["k"], "solve", memory=memory).collect()
    assert [r["y"] for r in none] == [None, None]


def test_gram_keeps_null_keys(spark):
    vectors = spark.createDataFrame([(None, [1.0, 2.0]), (None, [3.0, 1.0]), (1, [1.0, 0.0])], "k int, x array<double>")
    got = {(r["k"], r["t"]): r["row"] for r in covariance.gram_rows(vectors, ["k"]).collect()}
    assert got[None, 0] == [10.0, 5.0] and got[None, 1] == [5.0, 5.0] and got[1, 0] == [1.0, 0.0]


def test_nearest_draws_of_no_event(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0])], "i long, s array<double>")
    assert inference.nearest_draws(rows, rows.where("false").withColumnRenamed("i", "e"), "i", "e", "s", 3).count() == 0
    assert inference.nearest_draws(rows, rows.select(F.col("i").alias("e"), "s"), "i", "e", "s", 3).count() == 1


@pytest.mark.parametrize("memory", [1 << 20, 0])
def test_products_keep_every_row(spark, memory):
    """Null and repeated keys, null records and samples: one row each, whichever way is taken."""
    g = spark.createDataFrame([(0, [1.0, 2.0], 1.0, 0.0), (1, [3.0, 4.0], 2.0, 1.0)], "i int, g array<double>, v double, d0 double")
    rows = [(1, [1.0, 3.0]), (1, [1.0, 3.0]), (None, [2.0, 1.0]), (2, None), (3, [None, 1.0]), (4, [])]
    records = spark.createDataFrame(rows, "k int, x array<double>")
    got = compression.scores(records, g, 2, prior_term=[0.5, 0.0], memory=memory)
    by = {}
    for r in got.collect():
        by.setdefault(r["k"], []).append(r["score"])
    assert got.columns == ["k", "x", "score"] and by[1] == [[4.5, 6.0]] * 2 and by[None] == [[2.5, 4.0]] and by[2] == [None] and by[4] == [[]]
    assert np.isnan(by[3][0]).all()
    made = compression.synthesize(records, g, 2, "x", "y", factor=2.0, memory=memory)
    by = {}
    for r in made.collect():
        by.setdefault(r["k"], []).append(r["y"])
    assert made.columns == ["k", "x", "y"] and by[1] == [[14.0, 30.0]] * 2 and by[None] == [[8.0, 20.0]] and by[2] == [None] and by[4] == [[]]
    assert np.isnan(by[3][0]).all()
    short = spark.createDataFrame([(1, [1.0])], "k int, x array<double>")
    with pytest.raises(Exception):
        compression.scores(short, g, 2, memory=memory).collect()
    with pytest.raises(Exception):
        compression.synthesize(short, g, 2, "x", "y", memory=memory).collect()


def test_second_derivatives_keep_their_centre(spark):
    """The fiducial candidate has a null position; the long product keeps it."""
    p = spark.createDataFrame([(0, 1.0, 0.1), (1, 2.0, 0.1)], "pos int, fiducial double, delta double")
    g = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.0])], "i int, g array<double>")
    candidates = compression.stencil_candidates(p)
    ways = [compression.synthesize(candidates, g, 2, memory=m) for m in (1 << 20, 0)]
    assert ways[0].count() == ways[1].count() == 9
    for made in ways:
        for r in compression.first_and_second_derivatives(made, p).collect():
            assert np.allclose(r["gradient"], [[1, 3], [2, 4]][r["pos"]]) and np.allclose(r["curvature"], 0, atol=1e-9)


def test_hypercube_reads_grow_with_dimensions(spark):
    ids = spark.range(300)
    drawn = priors.latin_hypercube(ids, "id", [0.0] * 5, [1.0] * 5, "cube", rows_per_chunk=60)
    plan = drawn._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (") + plan.count("parquet") <= 4
    draws = np.array([r["draw"] for r in drawn.collect()])
    assert all(sorted(np.floor(draws[:, d] * 300).astype(int)) == list(range(300)) for d in range(5))
    one = {r["id"]: r["draw"] for r in priors.latin_hypercube(ids, "id", [0.0] * 5, [1.0] * 5, "cube").collect()}
    assert {r["id"]: r["draw"] for r in drawn.collect()} == one


@pytest.mark.parametrize("n", [1, 2, 3, 901])
def test_toeplitz_inverse(n):
    lag = np.arange(n)
    column = np.exp(-lag / 7) * np.cos(lag / 5) + 0.05 * (lag == 0)
    dense = column[np.abs(np.subtract.outer(lag, lag))]
    assert np.allclose(factors.toeplitz_inverse(column), np.linalg.inv(dense), rtol=1e-9, atol=1e-9)
    with pytest.raises(np.linalg.LinAlgError):
        factors.toeplitz_inverse(np.array([1.0, 2.0, 0.0]))
