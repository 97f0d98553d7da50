"""Draws of whole arrays in tasks equal the draws by column expressions."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quietwave.functions.draws import normal, normal_rows
from quietwave.operators import priors as D
from quietwave.sources import layers as L
from workbook import registry


def test_rows_of_draws_equal_the_column_expression(spark):
    keys = ["7|0", "123456789|1", "-3|0", "", "k" * 60 + "|1", "é|0"]
    counts = np.array([3, 120, 0, 1, 11, 2])
    df = spark.createDataFrame([(r, k, int(n)) for r, (k, n) in enumerate(zip(keys, counts)) if n], "r int, k string, n int")
    long = df.select("r", "k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    want = [r[0] for r in long.select("r", "i", normal(["k", "i"], "deep.h").alias("v")).orderBy("r", "i").select("v").collect()]
    assert np.allclose(normal_rows(pa.array(keys), counts, ["deep.p", "deep.h"])[1], want, rtol=1e-12, atol=1e-14)


def test_smooth_perturbation_draws_no_numbers_in_the_plan(spark):
    models = spark.createDataFrame([(1, [1.0, 2.0, 3.0], [5.0, 6.0, 7.0], [3.0, 3.5, 4.0]), (2, [1.0], [5.0], [3.0]), (3, [], [], []), (4, None, None, None)],
                                   "model long, thickness array<double>, vp array<double>, vs array<double>")
    made = D.perturb_smooth(models, 2, "smooth")
    assert "md5" not in made._jdf.queryExecution().toString().lower()
    sizes = {(r["model"], r["copy"]): None if r["vp"] is None else len(r["vp"]) for r in made.collect()}
    assert sizes == {(m, c): n for m, n in ((1, 3), (2, 1), (3, 0), (4, None)) for c in (0, 1)}


def test_layers_are_numbered_by_one_exchange(spark):
    plan = registry.layers(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_layer_lines_with_tabs_comments_and_line_ends(spark):
    lines = ["\t1 2\t3  4 5 6 # x\r", "# only\r", "   ", "7 8 9 10 11 12\r"]
    got = sorted(tuple(r) for r in L.parse_layer_lines(spark.createDataFrame([(x,) for x in lines], "value string")).collect())
    assert got == [(1.0, 2.0, 3.0, 4.0, 5.0, 6.0), (7.0, 8.0, 9.0, 10.0, 11.0, 12.0)]
