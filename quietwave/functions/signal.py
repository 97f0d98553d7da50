"""Trace jobs as Arrow-batched column functions: array<double> in, array<double> out.

Every function works on whole batches of equally long traces with NumPy, needs no
shuffle, and keeps the number and order of rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quietwave.functions.batches import blocks, lists_of, on_blocks


def _array_job(job: Callable[[np.ndarray], np.ndarray]):
    @F.arrow_udf("array<double>")
    def run(traces: pa.Array) -> pa.Array:
        return on_blocks(traces, job)

    return run


def _fast_length(n: int) -> int:
    return 1 << max(0, int(n - 1).bit_length())


def autocovariance_block(x: np.ndarray, lags: int | None = None) -> np.ndarray:
    """acf[k] = sum_i x_i x_{i+k} / (n-k), mean not removed, by zero-padded FFT."""
    n = x.shape[1]
    lags = n if lags is None else min(lags, n)
    size = _fast_length(2 * n)
    power = np.abs(np.fft.rfft(x, size, axis=1)) ** 2
    return np.fft.irfft(power, size, axis=1)[:, :lags] / np.arange(n, n - lags, -1)


def autocovariance(lags: int | None = None):
    """Autocovariance by lag; `lags` keeps the first ones only."""
    return _array_job(lambda x: autocovariance_block(x, lags))


# --- recursive filters -----------------------------------------------------------

def _bilinear_sections(zeros, poles, gain, rate) -> np.ndarray:
    """Analogue zeros, poles, gain to second-order sections at sampling `rate`."""
    zeros, poles = np.atleast_1d(zeros).astype(complex), np.atleast_1d(poles).astype(complex)
    fs2 = 2.0 * rate
    gain = gain * np.real(np.prod(fs2 - zeros) / np.prod(fs2 - poles))
    z = np.concatenate([(fs2 + zeros) / (fs2 - zeros), -np.ones(len(poles) - len(zeros))])
    p = (fs2 + poles) / (fs2 - poles)

    def pairs(roots):
        upper = sorted(roots[roots.imag > 1e-12], key=lambda r: (abs(r), r.imag))
        real = sorted(roots[np.abs(roots.imag) <= 1e-12].real)
        out = [np.real(np.poly([r, np.conj(r)])) for r in upper]
        while len(real) >= 2:
            out.append(np.real(np.poly([real.pop(0), real.pop()])))
        if real:
            out.append(np.array([1.0, -real[0], 0.0]))
        return out

    tops, bottoms = pairs(z), pairs(p)
    while len(tops) < len(bottoms):
        tops.append(np.array([1.0, 0.0, 0.0]))
    sections = np.array([np.concatenate([b, a]) for b, a in zip(tops, bottoms)])
    sections[0, :3] *= gain
    return sections


def butterworth_bandpass(low: float, high: float, rate: float, corners: int = 4) -> np.ndarray:
    """Second-order sections of a Butterworth band-pass."""
    k = np.arange(1, corners + 1)
    prototype = np.exp(1j * np.pi * (2 * k + corners - 1) / (2 * corners))
    w1, w2 = (2 * rate * np.tan(np.pi * f / rate) for f in (low, high))
    width, centre = w2 - w1, np.sqrt(w1 * w2)
    half = prototype * width / 2
    root = np.sqrt(half**2 - centre**2)
    return _bilinear_sections(np.zeros(corners), np.concatenate([half + root, half - root]), width**corners, rate)


def run_sections(sections: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Causal cascade on all rows at once (transposed direct form II)."""
    y = x.T.copy()
    for b0, b1, b2, a0, a1, a2 in sections:
        z1, z2 = np.zeros(y.shape[1]), np.zeros(y.shape[1])
        for t in range(y.shape[0]):
            value = y[t]
            out = (b0 / a0) * value + z1
            z1 = (b1 / a0) * value - (a1 / a0) * out + z2
            z2 = (b2 / a0) * value - (a2 / a0) * out
            y[t] = out
    return y.T


def bandpass(low: float, high: float, rate: float, corners: int = 4, zerophase: bool = False):
    """Butterworth band-pass, causal, or forward and backward when `zerophase`."""
    sections = butterworth_bandpass(low, high, rate, corners)

    def job(x: np.ndarray) -> np.ndarray:
        y = run_sections(sections, x)
        return run_sections(sections, y[:, ::-1])[:, ::-1] if zerophase else y

    return _array_job(job)


def _lanczos_weights(n: int, positions: np.ndarray, half_width: int) -> np.ndarray:
    p = positions[:, None] - np.arange(n)[None, :]
    return np.where(np.abs(p) < half_width, np.sinc(p) * np.sinc(p / half_width), 0.0)


def fourier_resample(rate: float, new_rate: float, window: bool = True):
    """Change the sampling rate through the spectrum, optionally Hann-weighted."""
    def job(x: np.ndarray) -> np.ndarray:
        n = x.shape[1]
        count = int(n * new_rate / rate)
        spectrum = np.fft.rfft(x, axis=1)
        if window:
            hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
            spectrum = spectrum * np.fft.ifftshift(hann)[: n // 2 + 1]
        f = np.arange(n // 2 + 1) * rate / n
        g = np.arange(count // 2 + 1) * new_rate / count
        at = np.clip(np.searchsorted(f, g, side="right") - 1, 0, len(f) - 2)
        share = np.clip((g - f[at]) / (f[at + 1] - f[at]), 0.0, 1.0)
        resampled = spectrum[:, at] * (1 - share) + spectrum[:, at + 1] * share
        return np.fft.irfft(resampled, count, axis=1) * (count / n)

    return _array_job(job)


def lanczos(rate: float, new_rate: float, count: int, half_width: int = 20):
    """Column function (trace, start offset in seconds): `count` samples at `new_rate`."""
    @F.arrow_udf("array<double>")
    def run(traces: pa.Array, offset: pa.Array) -> pa.Array:
        starts = offset.to_numpy(zero_copy_only=False)
        parts = []
        for rows, block in blocks(traces):
            n = block.shape[1]
            for start in np.unique(starts[rows]):
                weights = _lanczos_weights(n, (start + np.arange(count) / new_rate) * rate, half_width)
                own = starts[rows] == start
                parts.append((rows[own], block[own] @ weights.T))
        return lists_of(len(traces), parts)

    return run


def envelope_block(x: np.ndarray) -> np.ndarray:
    """Size of the analytic signal."""
    n = x.shape[1]
    weight = np.zeros(n)
    weight[0] = 1
    weight[1:(n + 1) // 2] = 2
    if n % 2 == 0:
        weight[n // 2] = 1
    return np.abs(np.fft.ifft(np.fft.fft(x, axis=1) * weight, axis=1))


def envelope():
    return _array_job(envelope_block)


def welch_block(x: np.ndarray, rate: float, segment: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and one-sided Welch density: Hann, half overlap, mean removed per segment."""
    segment = min(segment, x.shape[1])
    step = segment - segment // 2
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(segment) / segment)
    starts = range(0, x.shape[1] - segment + 1, step)
    total = 0.0
    for s in starts:
        part = x[:, s:s + segment]
        part = (part - part.mean(axis=1, keepdims=True)) * w
        total = total + np.abs(np.fft.rfft(part, axis=1)) ** 2
    density = total / len(starts) / (rate * np.sum(w * w))
    density[:, 1:(-1 if segment % 2 == 0 else None)] *= 2
    return np.fft.rfftfreq(segment, 1 / rate), density


def band_power(rate: float, bands: list[tuple[float, float]]):
    """Welch density integrated by trapezoids over half-open bands, one value per band."""
    segment = max(256, int(rate))

    def job(x: np.ndarray) -> np.ndarray:
        f, density = welch_block(x, rate, segment)
        out = np.zeros((len(x), len(bands)))
        for i, (lo, hi) in enumerate(bands):
            keep = (f >= lo) & (f < hi)
            if keep.any():
                out[:, i] = np.trapezoid(density[:, keep], f[keep], axis=1)
        return out

    return _array_job(job)
