"""Short-time spectra as long tables: frames are cut and transformed batch by batch, no shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SLICE_ROWS = 256


def _nearest_power_of_two(x: float) -> int:
    low = 2.0 ** np.floor(np.log2(x))
    return int(low if abs(x - low) <= abs(2 * low - x) else 2 * low)


def _map_traces(df: DataFrame, keys: list[str], x: str, transform, columns: str) -> DataFrame:
    """Run `transform` (rows, n) -> dict of equally long 3-d arrays (rows, frames, bins)."""
    key_schema = StructType([f for f in df.select(*keys).schema.fields])

    def job(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # a trace becomes hundreds of rows, so a batch is worked on in slices
        for batch in (whole[at:at + SLICE_ROWS] for whole in batches for at in range(0, len(whole), SLICE_ROWS)):
            lengths = batch[x].map(len)
            for n, part in batch.groupby(lengths, sort=False):
                result = transform(np.stack([np.asarray(v, float) for v in part[x]]))
                if result is None:
                    continue
                shape = next(iter(result.values())).shape
                out = {k: np.repeat(part[k].to_numpy(), shape[1] * shape[2]) for k in keys}
                out.update({name: value.reshape(-1) for name, value in result.items()})
                yield pd.DataFrame(out)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in key_schema.fields)
    return df.select(*keys, x).mapInPandas(job, f"{schema}, {columns}")


def spectrogram(df: DataFrame, keys: list[str], rate: float, window_seconds: float, overlap: float = 0.9,
                decibel: bool = False, pad_factor: float | None = 8.0, x: str = "x") -> DataFrame:
    """Power per frame and frequency: mean removed, Hann frames, zero-padded, no zero frequency.

    Frames have the power of two nearest to window*rate samples (an eighth of the trace
    when that is longer).  Values are square roots, or 10 log10 with `decibel`.
    Columns: keys, frame, freq, time, power.
    """
    def transform(block: np.ndarray):
        n = block.shape[1]
        size = _nearest_power_of_two(window_seconds * rate)
        if size > n:
            size = _nearest_power_of_two(n / 8.0)
        padded = size if pad_factor is None else _nearest_power_of_two(pad_factor) * size
        step = size - int(size * overlap)
        taper = np.hanning(size)
        block = block - block.mean(axis=1, keepdims=True)
        frames = np.lib.stride_tricks.sliding_window_view(block, size, axis=1)[:, ::step]
        power = np.abs(np.fft.rfft(frames * taper, padded, axis=2)) ** 2 / (rate * np.sum(taper**2))
        power[:, :, 1:(-1 if padded % 2 == 0 else None)] *= 2
        power = power[:, :, 1:]
        with np.errstate(divide="ignore"):
            value = 10 * np.log10(power) if decibel else np.sqrt(power)
        freq = np.fft.rfftfreq(padded, 1 / rate)[1:]
        count = value.shape[1]
        time = (np.arange(count) * step + size / 2) / rate
        full = np.ones_like(value)
        return {"frame": (full * np.arange(count)[None, :, None]).astype(np.int64),
                "freq": full * freq, "time": full * time[None, :, None], "power": value}

    return _map_traces(df, keys, x, transform, "frame bigint, freq double, time double, power double")


def spectral_ratio(signal: DataFrame, noise: DataFrame, on: list[str]) -> DataFrame:
    """10 log10 of signal over noise at equal frame and frequency."""
    joined = signal.join(noise.select(*on, "frame", "freq", F.col("power").alias("_p")), [*on, "frame", "freq"])
    return joined.withColumn("ratio_db", 10 * F.log10(F.try_divide(F.col("power"), F.col("_p")))).drop("_p")


def band_stft(df: DataFrame, keys: list[str], rate: float, window: int = 20, hop: int = 10, size: int = 256,
              low: float = 0.025, high: float = 0.1, polar: bool = True, x: str = "x") -> DataFrame:
    """Centred short-time transform with a Hann window, kept between low and high frequency.

    The trace is mirrored by size/2 at both ends, so it must be longer than that.
    Columns: keys, frame, freq and magnitude, phase (or re, im).
    """
    first, second = ("magnitude", "phase") if polar else ("re", "im")

    def transform(block: np.ndarray):
        half = size // 2
        if block.shape[1] <= half:
            raise ValueError(f"a trace of {block.shape[1]} samples is too short for size {size}")
        hann = np.zeros(size)
        left = (size - window) // 2
        hann[left:left + window] = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(window) / window)
        wide = np.pad(block, ((0, 0), (half, half)), mode="reflect")
        frames = np.lib.stride_tricks.sliding_window_view(wide, size, axis=1)[:, ::hop]
        spectrum = np.fft.rfft(frames * hann, axis=2)
        freq = np.fft.rfftfreq(size, 1 / rate)
        keep = (freq >= low) & (freq <= high)
        spectrum = spectrum[:, :, keep]
        full = np.ones(spectrum.shape)
        pair = (np.abs(spectrum), np.angle(spectrum)) if polar else (spectrum.real, spectrum.imag)
        return {"frame": (full * np.arange(spectrum.shape[1])[None, :, None]).astype(np.int64),
                "freq": full * freq[keep], first: pair[0], second: pair[1]}

    return _map_traces(df, keys, x, transform, f"frame bigint, freq double, {first} double, {second} double")
