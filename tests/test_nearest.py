"""The metric index against all distances."""

import numpy as np
import pytest

from quietwave.operators import inference as N


def brute(prior, observed, k):
    out = []
    for event, t in observed:
        d = sorted((float(np.sqrt(((np.array(t) - np.array(s)) ** 2).sum())), i) for i, s in prior)
        out += [(event, i, round(x, 9), r + 1) for r, (x, i) in enumerate(d[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("block_rows, pivots", [(50, 8), (1000, 8), (7, 1), (20_000, 1024)])
def test_index_equals_all_distances(spark, block_rows, pivots):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(6, 3)) * 10
    prior = [(i, (centres[i % 6] + rng.normal(size=3)).tolist()) for i in range(600)]
    prior += [(1000 + i, prior[0][1]) for i in range(40)]  # ties beyond a block
    observed = [("hot", (centres[0] + rng.normal(size=3)).tolist()) for _ in range(30)] + [(None, prior[0][1]), ("far", [99.0, 99.0, 99.0]), ("between", (centres[:2].mean(0)).tolist())]
    odd = [(2000, None), (2001, [float("nan"), 0.0, 0.0]), (2002, [None, 0.0, 0.0])]
    p = spark.createDataFrame(prior + odd, "id long, s array<double>").repartition(4)
    o = spark.createDataFrame(observed + [("null", None)], "e string, s array<double>").repartition(3)
    got = N.nearest_draws(p, o, "id", "e", "s", 9, block_rows=block_rows, pivots=pivots, part_rows=10).collect()
    assert sorted([(r["event"], r["id"], round(r["distance"], 9), r["rank"]) for r in got], key=str) == brute(prior, observed, 9)


def test_blocks_are_ruled_out(spark):
    rng = np.random.default_rng(1)
    centres = np.array([[0.0, 0.0], [100.0, 0.0], [0.0, 100.0], [100.0, 100.0]])
    prior = [(i, (centres[i % 4] + rng.normal(size=2)).tolist()) for i in range(800)]
    _, index = N.prior_index(spark.createDataFrame(prior, "id long, s array<double>"), "id", "s", 50, 16)
    least, greatest = index.bounds(np.array([[0.1, 0.1]]))
    seen = index.first_visit(greatest, 5)
    near = np.sort([np.hypot(s[0] - 0.1, s[1] - 0.1) for _, s in prior])[4]
    assert (seen | (least <= near)).sum() < len(index.count) / 2 and index.count.max() <= 50


def test_fewer_rows_than_wanted_and_none(spark):
    p = spark.createDataFrame([(1, [0.0]), (2, [3.0])], "id int, s array<double>")
    got = N.nearest_draws(p, spark.createDataFrame([("a", [1.0])], "e string, s array<double>"), "id", "e", "s", 5, block_rows=1).collect()
    assert [(r["id"], r["distance"], r["rank"]) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 1.0, 1), (2, 2.0, 2)]
    assert N.nearest_draws(p.where("false"), p.selectExpr("'a' e", "s"), "id", "e", "s", 5).collect() == []


@pytest.mark.parametrize("task_rows", [8, 50, 300])
def test_two_levels_of_boxes_equal_all_distances(spark, task_rows):
    rng = np.random.default_rng(4)
    prior = [(i, rng.normal(size=4).tolist()) for i in range(700)] + [(2000 + i, [0.5, 0.5, 0.5, 0.5]) for i in range(90)]
    observed = [(f"e{i}", (1.5 * rng.normal(size=4)).tolist()) for i in range(60)] + [("same", [0.5, 0.5, 0.5, 0.5])]
    p, o = spark.createDataFrame(prior, "id long, s array<double>").repartition(4), spark.createDataFrame(observed, "e string, s array<double>")
    got = N.nearest_draws(p, o, "id", "e", "s", 6, block_rows=5, pivots=5, part_rows=2, task_rows=task_rows).collect()
    assert sorted([(r["event"], r["id"], round(r["distance"], 9), r["rank"]) for r in got], key=str) == brute(prior, observed, 6)


def test_blocks_asked_for_do_not_grow_with_the_table(spark):
    rng = np.random.default_rng(6)
    points, asked = rng.normal(size=(16_000, 6)), 1.5 * rng.normal(size=(40, 6))
    visits = []
    for n in (4000, 16_000):
        _, index = N.prior_index(spark.createDataFrame([(i, points[i].tolist()) for i in range(n)], "id long, s array<double>"), "id", "s", 64, 5)
        kth = np.sort(np.sqrt(((asked[:, None] - points[None, :n]) ** 2).sum(axis=2)), axis=1)[:, 7]
        visits.append((index.bounds(asked)[0] <= kth[:, None]).sum(axis=1).mean())
    assert visits[1] < 2.5 * visits[0]  # in proportion to the table it would be 4
