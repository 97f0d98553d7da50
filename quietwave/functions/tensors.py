"""Moment tensors: six element columns (m1..m6) of [[m1,m4,m5],[m4,m2,m6],[m5,m6,m3]].

Magnitude, eigenvalues and source-type angles do not depend on the axes; planes and
axes do, so those functions take the axis convention as a parameter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quietwave.functions.types import DOUBLES, struct_of

M6 = ["m1", "m2", "m3", "m4", "m5", "m6"]

# Fixed values: (source element, sign) per target element, element 1 first.
# use = up, south, east; enu = east, north, up; ned = north, east, down.
CONVENTIONS = {
    ("use", "enu"): [(3, 1), (2, 1), (1, 1), (6, -1), (5, 1), (4, -1)],
    ("enu", "use"): [(3, 1), (2, 1), (1, 1), (6, -1), (5, 1), (4, -1)],
    ("enu", "ned"): [(2, 1), (1, 1), (3, 1), (4, 1), (6, -1), (5, -1)],
    ("ned", "enu"): [(2, 1), (1, 1), (3, 1), (4, 1), (6, -1), (5, -1)],
    ("use", "ned"): [(2, 1), (3, 1), (1, 1), (6, -1), (4, 1), (5, -1)],
    ("ned", "use"): [(3, 1), (1, 1), (2, 1), (5, 1), (6, -1), (4, -1)],
    # kernel order used before the kernels are applied: signs of elements 5 and 6 turn
    ("use", "kernel"): [(1, 1), (2, 1), (3, 1), (4, 1), (5, -1), (6, -1)],
    ("kernel", "use"): [(1, 1), (2, 1), (3, 1), (4, 1), (5, -1), (6, -1)],
    # order and signs under which posterior nodal planes are reported
    ("use", "planes"): [(2, -1), (3, -1), (1, -1), (5, -1), (6, -1), (4, -1)],
}


def convert_axes(df: DataFrame, source: str, target: str, m: list[str] = M6, prefix: str = "") -> DataFrame:
    """Add the six elements in another axis convention as `<prefix>1`..`<prefix>6`."""
    rule = CONVENTIONS[(source, target)]
    prefix = prefix or f"{target}_"
    return df.withColumns({
        f"{prefix}{i}": F.col(m[element - 1]) * F.lit(sign)
        for i, (element, sign) in enumerate(rule, start=1)
    })


def squared_norm(m: list[str] = M6) -> Column:
    c = [F.col(x) for x in m]
    return c[0] * c[0] + c[1] * c[1] + c[2] * c[2] + 2 * (c[3] * c[3] + c[4] * c[4] + c[5] * c[5])


def scalar_moment(m: list[str] = M6) -> Column:
    """M0 = |M| / sqrt 2."""
    return F.sqrt(squared_norm(m) / 2)


def magnitude(m: list[str] = M6, floor: float = 1e-30) -> Column:
    """Mw = (log10 M0 - 9.1) / 1.5, the moment held at `floor`."""
    return (F.log10(F.greatest(scalar_moment(m), F.lit(floor))) - F.lit(9.1)) / F.lit(1.5)


def with_eigenvalues(df: DataFrame, m: list[str] = M6, prefix: str = "lam") -> DataFrame:
    """Eigenvalues <prefix>1 >= <prefix>2 >= <prefix>3 by the trigonometric closed form."""
    a, b, c, d, e, f = (F.col(x) for x in m)
    df = df.withColumn("_q", (a + b + c) / 3)
    q = F.col("_q")
    df = df.withColumn("_p", F.sqrt(
        ((a - q) * (a - q) + (b - q) * (b - q) + (c - q) * (c - q) + 2 * (d * d + e * e + f * f)) / 6
    ))
    p = F.when(F.col("_p") > 0, F.col("_p"))
    for name, value in {"_a": (a - q) / p, "_b": (b - q) / p, "_c": (c - q) / p,
                        "_d": d / p, "_e": e / p, "_f": f / p}.items():
        df = df.withColumn(name, value)
    det = F.expr("_a*(_b*_c - _f*_f) - _d*(_d*_c - _f*_e) + _e*(_d*_f - _b*_e)") / 2
    df = df.withColumn("_phi", F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), det))) / 3)
    df = df.withColumn(f"{prefix}1", F.coalesce(q + 2 * F.col("_p") * F.cos("_phi"), q))
    df = df.withColumn(
        f"{prefix}3", F.coalesce(q + 2 * F.col("_p") * F.cos(F.col("_phi") + 2 * F.pi() / 3), q)
    )
    df = df.withColumn(f"{prefix}2", 3 * q - F.col(f"{prefix}1") - F.col(f"{prefix}3"))
    return df.drop("_q", "_p", "_a", "_b", "_c", "_d", "_e", "_f", "_phi")


def with_source_type(df: DataFrame, m: list[str] = M6, same: float = 1e-6) -> DataFrame:
    """Add gamma, delta, m0, theta_dc (degrees), iso and the deviatoric eigenvalues dev1..dev3."""
    df = with_eigenvalues(df, m, "_lam")
    l1, l2, l3 = F.col("_lam1"), F.col("_lam2"), F.col("_lam3")
    df = df.withColumn("_rho", F.sqrt(l1 * l1 + l2 * l2 + l3 * l3)).withColumn("_tr", l1 + l2 + l3)
    rho, tr = F.col("_rho"), F.col("_tr")

    def cosine(top: Column, bottom: Column) -> Column:
        return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(top, bottom)))

    return df.withColumns({
        "m0": rho / F.sqrt(F.lit(2.0)),
        "gamma": F.when(F.abs(l1 - l3) < same, F.lit(0.0)).otherwise(
            F.degrees(F.atan(F.try_divide(-l1 + 2 * l2 - l3, F.sqrt(F.lit(3.0)) * (l1 - l3))))),
        "delta": F.when((tr == 0) | (rho == 0), F.lit(0.0)).otherwise(
            F.lit(90.0) - F.degrees(F.acos(cosine(tr, F.sqrt(F.lit(3.0)) * rho)))),
        "theta_dc": F.degrees(F.acos(cosine(l1 - l3, F.sqrt(F.lit(2.0)) * rho))),
        "iso": tr / 3,
        "dev1": l1 - tr / 3, "dev2": l2 - tr / 3, "dev3": l3 - tr / 3,
    }).drop("_lam1", "_lam2", "_lam3", "_rho", "_tr")


def clvd_epsilon(dev1: str = "dev1", dev2: str = "dev2", dev3: str = "dev3") -> Column:
    """Middle deviatoric eigenvalue over the larger outer one."""
    return F.try_divide(F.col(dev2), F.greatest(F.abs(F.col(dev1)), F.abs(F.col(dev3))))


def with_hudson(df: DataFrame) -> DataFrame:
    """Add hudson_k, hudson_tau, hudson_u, hudson_v from iso and dev1..dev3.

    k = iso/(|iso|+D), T = 2 dev2/D, tau = T(1-|k|) with D the larger outer deviatoric
    eigenvalue; u, v are twice the middle deviatoric and the isotropic part over the
    largest eigenvalue in size.
    """
    iso, mid = F.col("iso"), F.col("dev2")
    outer = F.greatest(F.abs(F.col("dev1")), F.abs(F.col("dev3")))
    top = F.greatest(F.abs(F.col("dev1") + iso), F.abs(F.col("dev3") + iso))
    df = df.withColumn("hudson_k", F.try_divide(iso, F.abs(iso) + outer))
    return df.withColumns({
        "hudson_tau": F.coalesce(F.try_divide(2 * mid, outer), F.lit(0.0)) * (1 - F.abs("hudson_k")),
        "hudson_u": F.try_divide(2 * mid, top),
        "hudson_v": F.try_divide(iso, top),
    })


def is_double_couple(tolerance: float = 1e-6) -> Column:
    """True when the isotropic and the middle deviatoric part vanish beside the moment."""
    return (F.abs("iso") <= tolerance * F.col("m0")) & (F.abs("dev2") <= tolerance * F.col("m0"))


def _axes(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Eigenvalues (descending) and T, N, P unit vectors of (rows, 6) tensors."""
    full = m[:, [0, 3, 4, 3, 1, 5, 4, 5, 2]].reshape(-1, 3, 3)
    values, vectors = np.linalg.eigh(full)
    vectors = np.where(vectors[:, 2:3, :] < 0, -vectors, vectors)
    return values[:, ::-1], vectors[:, :, 2], vectors[:, :, 1], vectors[:, :, 0]


def _plane(normal: np.ndarray, slip: np.ndarray) -> np.ndarray:
    """Strike, dip, rake of fault normal and slip given as north, east, down."""
    turn = normal[:, 2:3] > 0
    n, d = np.where(turn, -normal, normal), np.where(turn, -slip, slip)
    dip = np.arccos(np.clip(-n[:, 2], -1.0, 1.0))
    flat = np.sin(dip) < 1e-9
    strike = np.where(flat, np.arctan2(-d[:, 0], d[:, 1]), np.arctan2(-n[:, 0], n[:, 1]))
    along = d[:, 0] * np.cos(strike) + d[:, 1] * np.sin(strike)
    up_dip = np.where(flat, d[:, 0] * np.sin(strike) - d[:, 1] * np.cos(strike),
                      -d[:, 2] / np.where(flat, 1.0, np.sin(dip)))
    return np.stack([np.degrees(strike) % 360.0, np.degrees(dip), np.degrees(np.arctan2(up_dip, along))], 1)


@F.pandas_udf(struct_of("strike1", "dip1", "rake1", "strike2", "dip2", "rake2"))
def nodal_planes(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """Both nodal planes of a north-east-down tensor, the smaller (strike, dip, rake) first."""
    for columns in batches:
        m = np.stack([c.to_numpy(float) for c in columns], 1)
        _, t, _, p = _axes(m)
        a, b = _plane((t + p) / np.sqrt(2), (t - p) / np.sqrt(2)), _plane((t - p) / np.sqrt(2), (t + p) / np.sqrt(2))
        swap = (a[:, 0] > b[:, 0])[:, None]
        first, second = np.where(swap, b, a), np.where(swap, a, b)
        yield pd.DataFrame(np.hstack([first, second]),
                           columns=["strike1", "dip1", "rake1", "strike2", "dip2", "rake2"])


@F.pandas_udf(struct_of("t", "n", "p", kind=DOUBLES))
def principal_axes(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """Unit vectors of the tension, null and pressure axes, third component >= 0."""
    for columns in batches:
        _, t, n, p = _axes(np.stack([c.to_numpy(float) for c in columns], 1))
        yield pd.DataFrame({"t": list(t), "n": list(n), "p": list(p)})


def with_kappa_h_sigma(df: DataFrame, planes: str = "planes") -> DataFrame:
    """Strike (radians), cos dip and rake (radians) of the plane whose |rake| is at most 90."""
    first = F.abs(F.col(f"{planes}.rake1")) <= 90

    def pick(name: str) -> Column:
        return F.when(first, F.col(f"{planes}.{name}1")).otherwise(F.col(f"{planes}.{name}2"))

    return df.withColumns({
        "kappa": F.radians(pick("strike")), "h": F.cos(F.radians(pick("dip"))),
        "sigma": F.radians(pick("rake")),
    })


def project_sphere(
    x: Column, y: Column, z: Column, kind: str = "area", lower: bool = True,
    full_sphere: bool = False, back_project: bool = False,
) -> tuple[Column, Column]:
    """Equal-area or equal-angle projection of unit vectors; the other hemisphere is null."""
    def scale(height: Column) -> Column:
        side = 1 + height if lower else 1 - height
        safe = F.when(side > 1e-15, side)
        return F.sqrt(2 / safe) if kind == "area" else 1 / safe

    hidden = F.lit(False) if full_sphere else (z < 0 if lower else z > 0)

    def one(component: Column) -> Column:
        direct = F.when(~hidden, component * scale(z))
        if back_project:
            return F.coalesce(direct, -component * scale(-z))
        return direct

    return one(x), one(y)


def lune_coordinates(gamma: Column, delta: Column) -> tuple[Column, Column]:
    """Equal-area (Hammer) map of gamma as longitude and delta as latitude, in degrees."""
    lon, lat = F.radians(gamma), F.radians(delta)
    z = F.sqrt(1 + F.cos(lat) * F.cos(lon / 2))
    return 2 * F.sqrt(F.lit(2.0)) * F.cos(lat) * F.sin(lon / 2) / z, F.sqrt(F.lit(2.0)) * F.sin(lat) / z


def radiation_pattern(df: DataFrame, resolution: int, m: list[str] = M6) -> DataFrame:
    """P amplitude of each tensor on a grid of directions, scaled to a largest size of 1.

    The grid is resolution x resolution directions; amplitudes of one tensor stay in one
    row until they are scaled, so no shuffle is needed.  Adds: direction, amplitude.
    """
    step = lambda hi: (F.lit(hi) - 0.002) / F.lit(float(resolution - 1))
    index = F.sequence(F.lit(0), F.lit(resolution * resolution - 1))
    a, b, c, d, e, f = (F.col(x) for x in m)

    def amplitude(k: Column) -> Column:
        phi = F.lit(0.001) + F.pmod(k, F.lit(resolution)) * step(2 * np.pi)
        theta = F.lit(0.001) + F.floor(k / resolution) * step(np.pi)
        x, y, z = F.sin(theta) * F.cos(phi), F.sin(theta) * F.sin(phi), F.cos(theta)
        return a * x * x + b * y * y + c * z * z + 2 * (d * x * y + e * x * z + f * y * z)

    out = df.withColumn("_amps", F.transform(index, amplitude))
    out = out.withColumn("_top", F.array_max(F.transform("_amps", lambda v: F.abs(v))))
    out = out.select(*df.columns, "_top", F.posexplode("_amps").alias("direction", "_amp"))
    return out.withColumn("amplitude", F.try_divide(F.col("_amp"), F.col("_top"))).drop("_top", "_amp")
