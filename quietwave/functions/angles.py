"""Angles and distances on the globe."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quietwave.functions.types import struct_of


def wrap(angle: Column, period: float) -> Column:
    """Angle wrapped to [-period/2, period/2)."""
    half = period / 2.0
    return F.pmod(angle + F.lit(half), F.lit(period)) - F.lit(half)


def distance_degrees(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in degrees on a sphere (stable for near and antipodal points)."""
    a, b = F.radians(lat1), F.radians(lat2)
    d = F.radians(lon2 - lon1)
    top = F.hypot(F.cos(b) * F.sin(d), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d))
    return F.degrees(F.atan2(top, F.sin(a) * F.sin(b) + F.cos(a) * F.cos(b) * F.cos(d)))


def azimuth_degrees(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Direction from point 1 to point 2, clockwise from north, 0 to 360."""
    a, b = F.radians(lat1), F.radians(lat2)
    d = F.radians(lon2 - lon1)
    return F.pmod(F.degrees(F.atan2(
        F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d)
    )), F.lit(360.0))


# WGS84 semi-major axis in metres and flattening.
WGS84_AXIS = 6378137.0
WGS84_FLATTENING = 1.0 / 298.257223563


def _vincenty(lat1, lon1, lat2, lon2, tolerance=1e-12, steps=200):
    """Inverse geodesic on the ellipsoid by Vincenty's series, on whole arrays."""
    f = WGS84_FLATTENING
    b = WGS84_AXIS * (1 - f)
    u1, u2 = (np.arctan((1 - f) * np.tan(np.radians(v))) for v in (lat1, lat2))
    span = np.radians(lon2 - lon1)
    lam = span.copy()
    for _ in range(steps):
        sl, cl = np.sin(lam), np.cos(lam)
        ss = np.hypot(np.cos(u2) * sl, np.cos(u1) * np.sin(u2) - np.sin(u1) * np.cos(u2) * cl)
        cs = np.sin(u1) * np.sin(u2) + np.cos(u1) * np.cos(u2) * cl
        sigma = np.arctan2(ss, cs)
        sa = np.divide(np.cos(u1) * np.cos(u2) * sl, ss, out=np.zeros_like(ss), where=ss > 0)
        ca2 = 1 - sa * sa
        c2m = np.divide(2 * np.sin(u1) * np.sin(u2), ca2, out=np.zeros_like(ca2), where=ca2 > 1e-15)
        c2m = np.where(ca2 > 1e-15, cs - c2m, 0.0)
        c = f / 16 * ca2 * (4 + f * (4 - 3 * ca2))
        new = span + (1 - c) * f * sa * (sigma + c * ss * (c2m + c * cs * (2 * c2m**2 - 1)))
        done = np.all(np.abs(new - lam) < tolerance)
        lam = new
        if done:
            break
    e2 = ca2 * (WGS84_AXIS**2 - b * b) / (b * b)
    big_a = 1 + e2 / 16384 * (4096 + e2 * (-768 + e2 * (320 - 175 * e2)))
    big_b = e2 / 1024 * (256 + e2 * (-128 + e2 * (74 - 47 * e2)))
    ds = big_b * ss * (c2m + big_b / 4 * (
        cs * (2 * c2m**2 - 1) - big_b / 6 * c2m * (4 * ss**2 - 3) * (4 * c2m**2 - 3)))
    sl, cl = np.sin(lam), np.cos(lam)
    fwd = np.arctan2(np.cos(u2) * sl, np.cos(u1) * np.sin(u2) - np.sin(u1) * np.cos(u2) * cl)
    back = np.arctan2(np.cos(u1) * sl, np.cos(u1) * np.sin(u2) * cl - np.sin(u1) * np.cos(u2))
    return (b * big_a * (sigma - ds), np.degrees(fwd) % 360.0, (np.degrees(back) + 180.0) % 360.0)


@F.pandas_udf(struct_of("metres", "azimuth", "back_azimuth"))
def ellipsoid_path(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """Metres, azimuth and back-azimuth between (lat1, lon1) and (lat2, lon2) on WGS84."""
    for columns in batches:
        metres, azimuth, back = _vincenty(*[c.to_numpy(float) for c in columns])
        yield pd.DataFrame({"metres": metres, "azimuth": azimuth, "back_azimuth": back})
