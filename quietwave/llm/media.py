"""Media columns: Netpbm and BMP bytes to arrays, area resizing by integral images, NPY tiles, hashes.

Pictures are held in binary columns. Defined results: a null or empty text gives one row of zero
samples; a null or undecodable picture gives null features. Rows are independent, so repeated rows get
equal values, an empty table gives an empty table and other columns pass through.
"""

from __future__ import annotations

import hashlib
import io
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quietwave.llm.common import each_text

WIDTH = 64
TOKEN = re.compile(rb"(?:\s|#[^\n]*\n)*([^\s#]+)")


def encode_pgm(samples: np.ndarray) -> bytes:
    """A rows x columns array of 8-bit samples as binary PGM."""
    return b"P5\n%d %d\n255\n" % (samples.shape[1], samples.shape[0]) + samples.tobytes()


def encode_bmp(samples: np.ndarray) -> bytes:
    """A rows x columns (grey) or rows x columns x 3 (RGB) array as bottom-up BMP of 8 or 24 bits."""
    grey = samples.ndim == 2
    rows, columns = samples.shape[:2]
    body = samples[::-1] if grey else samples[::-1, :, ::-1]
    body = body.reshape(rows, -1)
    body = np.pad(body, ((0, 0), (0, -body.shape[1] % 4)))
    table = b"".join(bytes((i, i, i, 0)) for i in range(256)) if grey else b""
    start = 54 + len(table)
    head = [(start + body.size, 4), (0, 4), (start, 4), (40, 4), (columns, 4), (rows, 4), (1, 2), (8 if grey else 24, 2),
            (0, 4), (body.size, 4), (2835, 4), (2835, 4), (256 if grey else 0, 4), (0, 4)]
    return b"BM" + b"".join(value.to_bytes(size, "little") for value, size in head) + table + body.tobytes()


def decode_netpbm(raw: bytes) -> np.ndarray:
    """P1 to P6 as an array of samples; bitmaps as 0 (black) and 255. Samples wider than 8 bits stay 16-bit."""
    kind, place = raw[1:2], 2
    fields = []
    for _ in range(2 if kind in b"14" else 3):
        found = TOKEN.match(raw, place)
        fields.append(int(found[1]))
        place = found.end()
    columns, rows = fields[:2]
    depth = 3 if kind in b"36" else 1
    # a plain sample takes a byte at least, a packed one a bit
    if min(fields) < 0 or rows * columns * depth > 8 * len(raw) or not 0 < fields[-1 if kind not in b"14" else 0] or (kind not in b"14" and fields[2] > 65535):
        raise ValueError("a header that does not fit its file")
    if kind == b"1":
        values = np.frombuffer(re.sub(rb"[^01]", b"", raw[place:]), np.uint8)[:rows * columns] - 48
    elif kind == b"4":
        packed = np.frombuffer(raw, np.uint8, rows * (-(-columns // 8)), place + 1).reshape(rows, -1)
        values = np.unpackbits(packed, axis=1)[:, :columns]
    elif kind in b"23":
        values = np.array(raw[place:].split()[:rows * columns * depth], dtype=np.int64)
        values = values.astype(np.uint8 if fields[2] < 256 else np.uint16)
    else:
        values = np.frombuffer(raw, np.uint8 if fields[2] < 256 else ">u2", rows * columns * depth, place + 1)
    if kind in b"14":
        values = (1 - values).astype(np.uint8) * 255
    return values.reshape((rows, columns, 3) if depth == 3 else (rows, columns))


def decode_bmp(raw: bytes) -> np.ndarray:
    """Uncompressed BMP of 8 bits with a palette, 24 or 32 bits, bottom-up or top-down; grey palettes give one plane."""
    number = lambda at, size=4, signed=False: int.from_bytes(raw[at:at + size], "little", signed=signed)
    start, head, columns, rows, bits, packed = number(10), number(14), number(18), number(22, signed=True), number(28, 2), number(30)
    if packed or bits not in (8, 24, 32):
        raise ValueError("only uncompressed BMP of 8, 24 or 32 bits")
    if rows * columns and abs(rows) * columns * bits // 8 > len(raw):
        raise ValueError("a header that does not fit its file")
    stride = (columns * bits // 8 + 3) // 4 * 4
    body = np.frombuffer(raw, np.uint8, stride * abs(rows), start).reshape(abs(rows), stride)[:, :columns * bits // 8]
    body = body[::-1] if rows > 0 else body
    if bits > 8:
        return body.reshape(abs(rows), columns, bits // 8)[:, :, 2::-1]
    palette = np.frombuffer(raw, np.uint8, (number(46) or 256) * 4, 14 + head).reshape(-1, 4)[:, 2::-1]
    shown = palette[body]
    return shown[:, :, 0] if (palette == palette[:, :1]).all() else shown


def decode(raw: bytes) -> np.ndarray:
    return decode_bmp(raw) if raw[:2] == b"BM" else decode_netpbm(raw)


def grey(samples: np.ndarray) -> np.ndarray:
    return samples if samples.ndim == 2 else samples @ np.array([0.299, 0.587, 0.114])


def area_resize(samples: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Means over equal boxes of the picture, parts of samples counted by area, from its integral image."""
    height, width = samples.shape
    integral = np.zeros((height + 1, width + 1))
    np.cumsum(np.cumsum(samples, axis=0, dtype=float), axis=1, out=integral[1:, 1:])

    def at(table: np.ndarray, size: int, parts: int) -> np.ndarray:
        """The piecewise linear integral along the first axis at the box edges."""
        edges = np.arange(parts + 1) * size / parts
        low = np.minimum(edges.astype(int), size - 1)
        share = (edges - low)[:, None]
        return table[low] * (1 - share) + table[low + 1] * share

    cut = at(at(integral, height, rows).T, width, columns).T
    return np.diff(np.diff(cut, axis=0), axis=1) * (rows * columns / (height * width))


def difference_hash(samples: np.ndarray) -> str:
    """64 bits: whether each of 8 x 8 means is above its right neighbour; 16 hex digits."""
    means = area_resize(samples, 8, 9)
    return np.packbits(np.diff(means, axis=1) < -1e-9).tobytes().hex()


def tile(samples: np.ndarray, side: int) -> bytes:
    """The picture resized to side x side 8-bit samples, as the bytes of an NPY file."""
    out = io.BytesIO()
    np.save(out, np.clip(np.rint(area_resize(samples, side, side)), 0, 255).astype(np.uint8), allow_pickle=False)
    return out.getvalue()


def texts_to_media(docs: DataFrame, text: str = "text", form: str = "pgm", media: str = "media", n_bytes: str = "n_bytes") -> DataFrame:
    """Adds each text as a grey picture of 64 columns (zero bytes fill its last row) and its byte length."""
    write = {"pgm": encode_pgm, "bmp": encode_bmp}[form]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pictures, sizes = [], []
            for raw in each_text(batch.column(text)):
                padded = raw + bytes(-len(raw) % WIDTH or (WIDTH if not raw else 0))
                pictures.append(write(np.frombuffer(padded, np.uint8).reshape(-1, WIDTH)))
                sizes.append(len(raw))
            yield batch.append_column(n_bytes, pa.array(sizes, pa.int64())).append_column(media, pa.array(pictures, pa.binary()))

    docs = docs.drop(media, n_bytes)
    schema = T.StructType(docs.schema.fields + [T.StructField(n_bytes, T.LongType()), T.StructField(media, T.BinaryType())])
    return docs.mapInArrow(run, schema)


FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile binary"


def media_features(df: DataFrame, media: str = "media", side: int = 16, keep: list[str] | None = None) -> DataFrame:
    """Decodes each stored picture and adds digests of samples and file, the difference hash and an NPY tile."""
    added = T._parse_datatype_string(FEATURES)
    keep = [c for c in (df.columns if keep is None else keep) if c != media and c not in added.names]

    def one(raw: bytes) -> tuple:
        if raw is None:
            return (None,) * len(added)
        own = [len(raw), hashlib.sha256(raw).hexdigest()]
        try:
            samples = decode(raw)
        except (ValueError, TypeError, IndexError, OverflowError):
            return (None, None, None, *own, None, None)
        payload = samples.tobytes()
        shades = grey(samples)
        empty = not shades.size
        return (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), *own,
                None if empty else difference_hash(shades), None if empty else tile(shades, side))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
        for batch in batches:
            rows = [one(raw.as_py()) for raw in batch.column(media)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(types)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep] + [pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=[*keep, *added.names])

    return df.mapInArrow(run, T.StructType([df.schema[c] for c in keep] + added.fields))


def save_tiles(df: DataFrame, path: str, tile: str = "tile") -> None:
    """Writes the NPY tiles with their other columns as a table at `path`."""
    df.where(F.col(tile).isNotNull()).write.parquet(path)
