"""The long way of synthesis works on blocks of kernels, not on a row per sample."""

import numpy as np

from quietwave.operators import compression


def test_synthesis_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(compression, "BLOCK_SAMPLES", 3, raising=False)
    monkeypatch.setattr(compression, "GROUP_ROWS", 4, raising=False)
    rng = np.random.default_rng(3)
    kernels = spark.createDataFrame([(i, [float(v) for v in rng.normal(size=2)]) for i in range(11)], "i int, g array<double>")
    params = spark.createDataFrame([(k, [float(v) for v in rng.normal(size=2)]) for k in range(13)], "k int, theta array<double>")
    want = {r["k"]: r["x"] for r in compression.synthesize(params, kernels, 2, factor=2.0).collect()}
    made = compression.synthesize(params, kernels, 2, factor=2.0, memory=0)
    got = {r["k"]: r["x"] for r in made.collect()}
    assert made.columns == ["k", "theta", "x"] and len(got) == 13 and all(np.allclose(got[k], want[k]) for k in want)
    # vectors and kernels are not unnested, which kept a group of every row and sample in a task
    assert "Generate" not in made._jdf.queryExecution().optimizedPlan().toString()
