import random

import numpy as np
from pyspark.sql import functions as F

from quietwave.operators.ordering import chunk_of, group_quantiles, order_cuts, ranked, running


def skewed(n=3000, seed=1):
    """A third of the rows in one group, half of them tied."""
    rng = random.Random(seed)
    return [(i, float(rng.randint(0, 40)), "hot" if i % 3 == 0 else f"g{i % 50}") for i in range(n)]


def test_rank_in_chunks_equals_sorting(spark):
    rows = skewed()
    df = spark.createDataFrame(rows, "id int, v double, g string")
    assert len(order_cuts(df, ["v", "id"], 200)) > 5
    got = {r["id"]: r["rank"] for r in ranked(df, ["v", "id"], ["g"], rows_per_chunk=200).collect()}
    want = {}
    for g in {r[2] for r in rows}:
        for k, (_, i) in enumerate(sorted((v, i) for i, v, gg in rows if gg == g)):
            want[i] = k + 1
    assert got == want


def test_rank_without_groups_is_the_global_position(spark):
    rows = skewed(2000, 3)
    df = spark.createDataFrame(rows, "id int, v double, g string")
    got = {r["id"]: r["rank"] for r in ranked(df, ["v", "id"], rows_per_chunk=150).collect()}
    assert got == {i: k + 1 for k, (_, i) in enumerate(sorted((v, i) for i, v, _ in rows))}


def test_running_aggregates_carry_across_chunks(spark):
    rows = [(i, None if i % 7 else float(i)) for i in range(1000)]
    df = spark.createDataFrame(rows, "i int, x double")
    out = running(df, ["i"], {"s": ("sum", "x"), "m": ("max", "x"), "l": ("last", "x"), "n": ("count", None)}, before=True, rows_per_chunk=90)
    for r in out.collect():
        seen = [x for i, x in rows if i < r["i"] and x is not None]
        assert r["n"] == r["i"]
        assert r["s"] == (sum(seen) if seen else None)
        assert r["m"] == (max(seen) if seen else None)
        assert r["l"] == (seen[-1] if seen else None)


def test_one_chunk_for_small_data_and_tree_depth(spark):
    df = spark.range(100)
    assert order_cuts(df, ["id"]) == []
    cut = spark.range(100).select("id", chunk_of(["id"], [(10,), (50,), (90,)]).alias("c")).groupBy("c").count().collect()
    assert {r["c"]: r["count"] for r in cut} == {0: 10, 1: 40, 2: 40, 3: 10}


def test_group_quantiles_match_numpy(spark):
    rows = skewed(1500, 5)
    df = spark.createDataFrame(rows, "id int, v double, g string")
    got = group_quantiles(df, ["g"], "v", "id", [0.05, 0.5, 0.95], rows_per_chunk=120).collect()
    for r in got:
        values = [v for _, v, g in rows if g == r["g"]]
        assert abs(r["value"] - np.quantile(values, r["q"])) < 1e-12
    assert len(got) == 3 * len({g for _, _, g in rows})


def test_many_cuts_use_a_search_with_the_same_answer(spark):
    from quietwave.operators.ordering import with_chunk

    rng = random.Random(8)
    df = spark.createDataFrame([(rng.randint(0, 500), f"n{rng.randint(0, 99):02d}") for _ in range(3000)], "v long, name string")
    cuts = sorted({(rng.randint(0, 500), f"n{rng.randint(0, 99):02d}") for _ in range(300)})
    rows = with_chunk(df, ["v", "name"], cuts).collect()
    assert all(r["_chunk"] == sum(c <= (r["v"], r["name"]) for c in cuts) for r in rows)


def test_null_keys_come_first(spark):
    df = spark.createDataFrame([(1, None), (2, 1.0), (3, 0.5)], "id int, v double")
    got = {r["id"]: r["rank"] for r in ranked(df, ["v", "id"]).collect()}
    assert got == {1: 1, 3: 2, 2: 3}
    assert df.where(F.col("v").isNull()).count() == 1
