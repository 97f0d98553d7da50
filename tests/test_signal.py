import numpy as np
import pytest

from quietwave.functions import angles, signal as G
from quietwave.operators.priors import smooth_fields


def response(sections, f, rate):
    z = np.exp(-2j * np.pi * f / rate)
    out = 1.0
    for b0, b1, b2, a0, a1, a2 in sections:
        out = out * (b0 + b1 * z + b2 * z * z) / (a0 + a1 * z + a2 * z * z)
    return abs(out)


def test_butterworth_corners_pass_band_and_stop_band():
    s = G.butterworth_bandpass(0.02, 0.05, 1.0, 4)
    assert response(s, 0.02, 1.0) == pytest.approx(np.sqrt(0.5), abs=1e-9)
    assert response(s, 0.05, 1.0) == pytest.approx(np.sqrt(0.5), abs=1e-9)
    low, high = np.tan(np.pi * 0.02), np.tan(np.pi * 0.05)
    for f in (0.002, 0.01, 0.032, 0.04, 0.1, 0.2, 0.4):
        w = np.tan(np.pi * f)
        closed = 1 / np.sqrt(1 + ((w * w - low * high) / (w * (high - low))) ** 8)
        assert response(s, f, 1.0) == pytest.approx(closed, rel=1e-6)


def test_tone_inside_the_band_survives_and_outside_dies():
    t = np.arange(4000)
    tones = np.stack([np.sin(2 * np.pi * 0.03 * t), np.sin(2 * np.pi * 0.2 * t)])
    y = G.run_sections(G.butterworth_bandpass(0.02, 0.05, 1.0), tones)
    assert np.abs(y[0, 2000:]).max() == pytest.approx(1.0, abs=0.05)
    assert np.abs(y[1, 2000:]).max() < 2e-3


def test_autocovariance_by_transform_equals_direct_sum():
    x = np.random.default_rng(0).normal(size=(3, 37))
    direct = np.array([[np.sum(r[: 37 - k] * r[k:]) / (37 - k) for k in range(37)] for r in x])
    assert np.allclose(G.autocovariance_block(x), direct, atol=1e-12)
    spike = np.zeros((1, 16))
    spike[0, 5] = 2.0
    assert np.allclose(G.autocovariance_block(spike)[0], [4 / 16] + [0] * 15, atol=1e-15)


def test_envelope_of_a_tone_is_flat():
    t = np.arange(512)
    assert np.allclose(G.envelope_block(np.cos(2 * np.pi * 16 * t / 512)[None]), 1.0, atol=1e-9)


def test_welch_density_integrates_to_the_variance():
    x = np.random.default_rng(1).normal(size=(1, 1 << 15))
    f, p = G.welch_block(x, 4.0, 256)
    assert np.trapezoid(p[0], f) == pytest.approx(x.var(), rel=0.02)


def test_array_functions_in_spark(spark):
    t = np.arange(400)
    rows = [(1, [float(v) for v in np.sin(2 * np.pi * 0.05 * t / 2)]), (2, [1.0] * 400), (3, None)]
    df = spark.createDataFrame(rows, "id int, x array<double>")
    from pyspark.sql import functions as F

    out = {r["id"]: r for r in df.select(
        "id", G.fourier_resample(2.0, 1.0, window=False)("x").alias("half"), G.lanczos(2.0, 1.0, 150)(F.coalesce("x", F.array(F.lit(0.0))), F.lit(20.25)).alias("l")).collect()}
    assert np.allclose(out[1]["half"], np.sin(2 * np.pi * 0.05 * np.arange(200)), atol=1e-6)
    assert np.allclose(out[1]["l"], np.sin(2 * np.pi * 0.05 * (20.25 + np.arange(150))), atol=1e-3)
    assert out[3]["half"] is None


def test_smooth_field_equals_direct_reflected_convolution():
    rng = np.random.default_rng(3)
    white, spacing = rng.normal(size=(4, 6)), np.array([0.7, 2.0, 5.0, 40.0])
    got = smooth_fields(white, spacing, 5.0, 0.03)
    for row, h, g in zip(white, spacing, got):
        sigma = max(0.5, 5.0 / h)
        radius = int(4 * sigma + 0.5)
        w = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
        w /= w.sum()
        line = np.concatenate([row, row[::-1]])
        out = np.array([sum(w[d + radius] * line[(i + d) % 12] for d in range(-radius, radius + 1)) for i in range(6)])
        out = (out - out.mean()) / out.std() * 0.03
        assert np.allclose(out, g, atol=1e-9)


def test_ellipsoid_against_known_arcs():
    lat1, lon1 = np.array([0.0, 0.0, 10.0]), np.array([0.0, 0.0, 20.0])
    lat2, lon2 = np.array([0.0, 1.0, 10.0]), np.array([1.0, 0.0, 20.0])
    metres, az, back = angles._vincenty(lat1, lon1, lat2, lon2)
    assert metres[0] == pytest.approx(111319.4908, abs=1e-3)
    assert metres[1] == pytest.approx(110574.3886, abs=1e-3)
    assert metres[2] == pytest.approx(0.0, abs=1e-6)
    assert az[0] == pytest.approx(90.0) and back[0] == pytest.approx(270.0) and az[1] == pytest.approx(0.0) and back[1] == pytest.approx(180.0)
