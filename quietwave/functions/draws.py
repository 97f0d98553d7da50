"""Reproducible draws: a pure function of the row key and a stream name.

Unlike rand(seed), the value does not depend on partitioning, so reruns, lost
executors and other engines with MD5 give the same numbers.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def _column(key) -> Column:
    return F.col(key) if isinstance(key, str) else key


def _digest(keys: list, stream: str) -> Column:
    text = F.concat_ws("|", *[_column(k).cast("string") for k in keys], F.lit(stream))
    return F.md5(text.cast("binary"))


def _unit(digest: Column, start: int) -> Column:
    bits = F.conv(F.substring(digest, start, 13), 16, 10).cast("long")
    return (bits + F.lit(0.5)) / F.lit(float(2**52))


def uniform(keys: list, stream: str) -> Column:
    """Uniform on (0, 1): the first 52 bits of md5(key|...|stream)."""
    return _unit(_digest(keys, stream), 1)


def normal(keys: list, stream: str) -> Column:
    """Standard normal by the Box-Muller transform of the first two 52-bit parts of the digest."""
    digest = _digest(keys, stream)
    u, v = _unit(digest, 1), _unit(digest, 14)
    return F.sqrt(F.lit(-2.0) * F.log(u)) * F.cos(F.lit(2.0) * F.pi() * v)


# Rotations and constants of MD5 (RFC 1321).
MD5_TURNS = [[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]]
MD5_ADD = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
MD5_START = [0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476]
SHORT = 55  # bytes of text that fit one block
SLICE = 8192


def _md5_block(words: np.ndarray) -> list[np.ndarray]:
    """The four words of the digests of texts padded to one block; `words` is 16 x texts."""
    a, b, c, d = (np.full(words.shape[1], v, np.uint32) for v in MD5_START)
    for i in range(64):
        turn = i // 16
        if turn == 0:
            f, g = d ^ (b & (c ^ d)), i
        elif turn == 1:
            f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif turn == 2:
            f, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, g = c ^ (b | ~d), 7 * i % 16
        f += a
        f += words[g]
        f += np.uint32(MD5_ADD[i])
        left = MD5_TURNS[turn][i % 4]
        turned = f << np.uint32(left)
        f >>= np.uint32(32 - left)
        turned |= f
        turned += b
        a, d, c, b = d, c, b, turned
    return [part + np.uint32(v) for part, v in zip((a, b, c, d), MD5_START)]


def _digests(prefixes: list[bytes], rows: np.ndarray, index: np.ndarray, suffixes: list[bytes]) -> np.ndarray:
    """MD5 of <prefix of the row><suffix of the index>: n x 2 big-endian halves."""
    sizes, end_sizes = np.array([len(p) for p in prefixes]), np.array([len(t) for t in suffixes])
    ends = np.zeros((len(suffixes), end_sizes.max() + 1), np.uint8)
    for i, text in enumerate(suffixes):
        ends[i, :len(text) + 1] = np.frombuffer(text + b"\x80", np.uint8)
    out = np.empty((len(rows), 2), np.uint64)
    for size in np.unique(sizes[rows]):
        own = np.flatnonzero(sizes[rows] == size)
        if size + ends.shape[1] - 1 > SHORT:
            long = b"".join(hashlib.md5(prefixes[r] + suffixes[i]).digest() for r, i in zip(rows[own].tolist(), index[own].tolist()))
            out[own] = np.frombuffer(long, ">u8").reshape(-1, 2)
            continue
        same = np.flatnonzero(sizes == size)
        place = np.zeros(len(prefixes), np.int64)
        place[same] = np.arange(len(same))
        heads = np.frombuffer(b"".join(prefixes[r] for r in same.tolist()), np.uint8).reshape(len(same), size)
        for at in range(0, len(own), SLICE):
            part = own[at:at + SLICE]
            block = np.zeros((len(part), 64), np.uint8)
            block[:, :size] = heads[place[rows[part]]]
            block[:, size:size + ends.shape[1]] = ends[index[part]]
            words = np.ascontiguousarray(block.view("<u4").T)
            words[14] = 8 * (size + end_sizes[index[part]])
            a, b, c, d = (w.byteswap().astype(np.uint64) for w in _md5_block(words))
            out[part, 0], out[part, 1] = (a << np.uint64(32)) | b, (c << np.uint64(32)) | d
    return out


def normal_rows(keys: pa.Array, counts: np.ndarray, streams: list[str]) -> np.ndarray:
    """The draws `normal([key, i], stream)` for i below the count of each key, end to end: one row per stream.

    `keys` are texts, parts of a key already put together by "|". Whole arrays are worked on at a time.
    """
    most = int(counts.max()) if len(counts) else 0
    rows = np.repeat(np.arange(len(keys)), counts)
    if not len(rows):
        return np.zeros((len(streams), 0))
    index = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
    suffixes = [b"|%d|%s" % (i, stream.encode()) for stream in streams for i in range(most)]
    every = (index + most * np.arange(len(streams))[:, None]).reshape(-1)
    halves = _digests([k.encode() for k in keys.to_pylist()], np.tile(rows, len(streams)), every, suffixes)
    first = halves[:, 0] >> np.uint64(12)
    second = ((halves[:, 0] & np.uint64(0xFFF)) << np.uint64(40)) | (halves[:, 1] >> np.uint64(24))
    u, v = ((bits.astype(float) + 0.5) / 2.0**52 for bits in (first, second))
    return (np.sqrt(-2.0 * np.log(u)) * np.cos(2.0 * np.pi * v)).reshape(len(streams), -1)
