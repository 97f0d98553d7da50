"""Kernels from elementary responses, also of stations that lack some."""

import numpy as np

from quietwave.operators import priors as D


def test_unfinished_stations_give_no_kernels_and_gaps_are_null(spark):
    rng = np.random.default_rng(3)
    rows = [(s, r, rng.normal(size=4).tolist(), 40.0, 70.0) for s in (1, 2, 3) for r in range(10) if not (s == 2 and r > 5) and not (s == 3 and r == 4)]
    df = spark.createDataFrame(rows, "station long, response int, x array<double>, az double, baz double").repartition(5)
    got = {(r["station"], r["component"], r["element"], r["i"]): r["value"] for r in D.assemble_kernels(df, ["station"], "az", "baz").collect()}
    assert len(got) == 2 * 18 * 4 and {k[0] for k in got} == {1, 3}
    x = {(s, r): np.array(v) for s, r, v, _, _ in rows}
    a, z = np.radians(40.0), np.radians(70.0)
    north = -np.cos(a) * x[1, 3] * np.cos(z) + np.sin(a) * x[1, 4] * np.sin(z)
    assert np.allclose([got[1, "N", 5, i] for i in range(4)], north)
    assert all((v is None) == (k[0] == 3 and k[1] != "Z" and k[2] in (5, 6)) for k, v in got.items())
