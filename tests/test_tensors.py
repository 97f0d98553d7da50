import numpy as np
import pytest
from pyspark.sql import functions as F

from quietwave.functions import tensors as M
from quietwave.operators.priors import MECHANISMS, mechanism_table

CASES = {
    "explosion": [1, 1, 1, 0, 0, 0], "implosion": [-1, -1, -1, 0, 0, 0], "clvd": [1, 1, -2, 0, 0, 0], "minus clvd": [-1, -1, 2, 0, 0, 0],
    "dc": [1, 0, -1, 0, 0, 0], "sheared dc": [0, 0, 0, 1, 0, 0], "zero": [0, 0, 0, 0, 0, 0], "mixed": [1e16, -3e16, 2e16, 4e15, -1e15, 2.5e16],
}


def table(spark):
    rows = [(name, *[float(v) for v in m]) for name, m in CASES.items()]
    return spark.createDataFrame(rows, "name string, m1 double, m2 double, m3 double, m4 double, m5 double, m6 double")


def test_eigenvalues_and_source_type(spark):
    rows = {r["name"]: r for r in M.with_source_type(M.with_eigenvalues(table(spark))).collect()}
    for name, m in CASES.items():
        full = np.array([[m[0], m[3], m[4]], [m[3], m[1], m[5]], [m[4], m[5], m[2]]], float)
        lam = np.sort(np.linalg.eigvalsh(full))[::-1]
        got = [rows[name][f"lam{k}"] for k in (1, 2, 3)]
        assert np.allclose(got, lam, rtol=1e-7, atol=1e-7 * max(1e-9, np.abs(lam).max()))
    assert rows["explosion"]["delta"] == pytest.approx(90, abs=1e-4) and rows["explosion"]["gamma"] == 0
    assert rows["implosion"]["delta"] == pytest.approx(-90, abs=1e-4)
    assert rows["clvd"]["gamma"] == pytest.approx(30, abs=1e-4) and rows["minus clvd"]["gamma"] == pytest.approx(-30, abs=1e-4)
    assert rows["dc"]["gamma"] == pytest.approx(0, abs=1e-6) and rows["dc"]["theta_dc"] == pytest.approx(0, abs=1e-5)
    assert rows["zero"]["delta"] == 0 and rows["zero"]["gamma"] == 0 and rows["zero"]["m0"] == 0


def test_axis_conventions_round_trip(spark):
    df = table(spark)
    for source, target in [("use", "ned"), ("use", "enu"), ("enu", "ned"), ("use", "kernel")]:
        there = M.convert_axes(df, source, target, prefix="a")
        back = M.convert_axes(there, target, source, [f"a{k}" for k in range(1, 7)], prefix="b")
        assert back.where(" OR ".join(f"m{k} != b{k}" for k in range(1, 7))).count() == 0
    via = M.convert_axes(M.convert_axes(df, "use", "enu", prefix="a"), "enu", "ned", [f"a{k}" for k in range(1, 7)], prefix="b")
    both = M.convert_axes(via, "use", "ned", prefix="c")
    assert both.where(" OR ".join(f"b{k} != c{k}" for k in range(1, 7))).count() == 0


def test_planes_of_a_known_double_couple(spark):
    """Tensor elements from strike, dip, rake by the standard formulas, planes recovered."""
    given = [(30.0, 60.0, 40.0), (200.0, 45.0, -90.0), (350.0, 80.0, 170.0)]
    rows = []
    for s, d, r in given:
        p, q, k = np.radians([s, d, r])
        rows.append((
            -(np.sin(q) * np.cos(k) * np.sin(2 * p) + np.sin(2 * q) * np.sin(k) * np.sin(p) ** 2),
            np.sin(q) * np.cos(k) * np.sin(2 * p) - np.sin(2 * q) * np.sin(k) * np.cos(p) ** 2, np.sin(2 * q) * np.sin(k),
            np.sin(q) * np.cos(k) * np.cos(2 * p) + 0.5 * np.sin(2 * q) * np.sin(k) * np.sin(2 * p),
            -(np.cos(q) * np.cos(k) * np.cos(p) + np.cos(2 * q) * np.sin(k) * np.sin(p)),
            -(np.cos(q) * np.cos(k) * np.sin(p) - np.cos(2 * q) * np.sin(k) * np.cos(p)), s))
    df = spark.createDataFrame([tuple(float(v) for v in r) for r in rows], "nn double, ee double, dd double, ne double, nd double, ed double, s double")
    got = {r["s"]: r["p"] for r in df.select("s", M.nodal_planes("nn", "ee", "dd", "ne", "nd", "ed").alias("p")).collect()}
    for s, d, r in given:
        p = got[s]
        planes = [(p["strike1"], p["dip1"], p["rake1"]), (p["strike2"], p["dip2"], p["rake2"])]
        assert min(max(abs((a[0] - s + 180) % 360 - 180), abs(a[1] - d), abs((a[2] - r + 180) % 360 - 180)) for a in planes) < 1e-5


def test_mechanism_table_has_the_moment_and_name(spark):
    m0 = 10 ** (1.5 * 5.0 + 9.1)
    rows = mechanism_table(spark.createDataFrame([(m0,)], "m0 double")).collect()
    assert {r["name"] for r in rows} == {f"{k}_5.00M" for k in MECHANISMS}
    for r in rows:
        assert np.sqrt(np.sum(np.square(r["tensor"])) / 2) == pytest.approx(m0)


def test_double_couple_flag_and_hudson_corners(spark):
    df = M.with_hudson(M.with_source_type(table(spark))).withColumn("is_dc", M.is_double_couple())
    rows = {r["name"]: r for r in df.collect()}
    assert rows["dc"]["is_dc"] and rows["sheared dc"]["is_dc"] and not rows["clvd"]["is_dc"]
    assert rows["explosion"]["hudson_k"] == pytest.approx(1) and rows["explosion"]["hudson_v"] == pytest.approx(1)
    assert abs(rows["clvd"]["hudson_u"]) == pytest.approx(1) and rows["clvd"]["hudson_v"] == pytest.approx(0)


def test_projection_hides_the_other_hemisphere(spark):
    df = spark.createDataFrame([(0.6, 0.0, 0.8), (0.6, 0.0, -0.8), (0.0, 0.0, -1.0)], "x double, y double, z double")
    c = [F.col(v) for v in "xyz"]
    x, _ = M.project_sphere(*c)
    b, _ = M.project_sphere(*c, back_project=True)
    rows = df.select(x.alias("x1"), b.alias("b1")).collect()
    assert rows[0]["x1"] == pytest.approx(0.6 * np.sqrt(2 / 1.8)) and rows[1]["x1"] is None
    assert rows[1]["b1"] == pytest.approx(-0.6 * np.sqrt(2 / 1.8)) and rows[2]["b1"] == pytest.approx(0.0)
