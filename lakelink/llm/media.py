"""Media columns: Netpbm and BMP to numpy, area resizing by integral images, NPY tiles, difference hashes.

Images are arrays of shape (height, width, channels) with 8-bit samples. decode() reads the plain
and raw forms of PBM, PGM and PPM (16-bit samples are scaled to 8) and uncompressed BMP of 8, 24
and 32 bits; bytes that are no such image give None. A payload column is stored without loss as a
raw PGM of 64 samples a row and read back from it.

Defined results: a null or empty text has a payload of 64 zero bytes. Equal texts have equal
values. A null media column decodes to null columns. Repeated rows are treated one by one.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import common

#: Samples of a row of stored payloads.
ROW = 64
#: Rows of an image that integral() sums at once; taller ones are summed in bands.
BAND = 1 << 14


def _header(data: bytes, n: int, at: int = 2) -> tuple[list[int], int]:
    """n numbers of a Netpbm header, comments skipped, and where the samples begin."""
    out = []
    for _ in range(n):
        m = re.compile(rb"(?:\s|#[^\n\r]*[\n\r])*(\d+)").match(data, at)
        if not m:
            raise ValueError("bad Netpbm header")
        out.append(int(m[1]))
        at = m.end()
    return out, at + 1


def _netpbm(data: bytes) -> np.ndarray:
    kind = data[1] - 48
    depth = 3 if kind in (3, 6) else 1
    (w, h, *rest), at = _header(data, 2 if kind in (1, 4) else 3)
    top = rest[0] if rest else 1
    if not (0 < w and 0 < h and 0 < top < 65536):
        raise ValueError("bad Netpbm size")
    if kind == 4:
        row = (w + 7) // 8
        bits = np.unpackbits(np.frombuffer(data, np.uint8, row * h, at).reshape(h, row), axis=1)[:, :w]
        return ((1 - bits) * 255).astype(np.uint8)[:, :, None]
    if kind in (5, 6):
        x = np.frombuffer(data, np.uint8 if top < 256 else ">u2", w * h * depth, at)
    elif kind == 1:
        bits = re.sub(rb"#[^\n\r]*|\s+", b"", data[at - 1 :])[: w * h]
        return (1 - (np.frombuffer(bits, np.uint8) - 48)).reshape(h, w, 1).astype(np.uint8) * 255
    else:
        x = np.array(re.sub(rb"#[^\n\r]*", b"", data[at - 1 :]).split()[: w * h * depth], np.int64)
    x = x.reshape(h, w, depth)
    return x.astype(np.uint8) if top == 255 else ((x.astype(np.int64) * 255 + top // 2) // top).astype(np.uint8)


def _bmp(data: bytes) -> np.ndarray:
    offset, size, w, h, _, bits, packed = struct.unpack_from("<I", data, 10) + struct.unpack_from("<IiiHHI", data, 14)
    if packed not in (0, 3) or bits not in (8, 24, 32) or w <= 0 or h == 0:
        raise ValueError("BMP of a kind that isn't supported")
    row = (w * bits // 8 + 3) // 4 * 4
    x = np.frombuffer(data, np.uint8, row * abs(h), offset).reshape(abs(h), row)[:, : w * bits // 8].reshape(abs(h), w, bits // 8)
    if bits == 8:
        used = struct.unpack_from("<I", data, 46)[0] or 256
        palette = np.zeros((256, 4), np.uint8)
        palette[:used] = np.frombuffer(data, np.uint8, used * 4, 14 + size).reshape(used, 4)
        x = palette[x[:, :, 0]]
    x = x[:, :, 2::-1]
    return np.ascontiguousarray(x[::-1] if h > 0 else x)


def decode(data: bytes | None) -> np.ndarray | None:
    """Samples of a Netpbm or BMP image; None if it is neither or is cut off."""
    try:
        if data and data[:1] == b"P" and data[1:2] in b"123456":
            return _netpbm(data)
        if data and data[:2] == b"BM":
            return _bmp(data)
    except (ValueError, struct.error, IndexError):
        pass
    return None


def encode_pgm(x: np.ndarray) -> bytes:
    """A raw PGM (one channel) or PPM (three) with 8-bit samples."""
    h, w = x.shape[:2]
    return b"P%d\n%d %d\n255\n" % (6 if x.ndim == 3 and x.shape[2] == 3 else 5, w, h) + x.astype(np.uint8).tobytes()


def encode_bmp(x: np.ndarray) -> bytes:
    """A BMP of 24 bits."""
    h, w = x.shape[:2]
    x = np.broadcast_to(x.reshape(h, w, -1), (h, w, 3))[::-1, :, ::-1]
    row = (w * 3 + 3) // 4 * 4
    rows = np.zeros((h, row), np.uint8)
    rows[:, : w * 3] = x.reshape(h, w * 3)
    return struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + row * h, 0, 0, 54, 40, w, h, 1, 24, 0, row * h, 2835, 2835, 0, 0) + rows.tobytes()


def _edges(n: int, to: int) -> np.ndarray:
    return np.arange(to + 1) * (n / to)


def _integral_at(x: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """The integral image of x (height, width) at fractional rows and columns, summed band by band."""
    h, w = x.shape

    def across(part: np.ndarray) -> np.ndarray:  # (rows, width) sums -> (rows, len(cols))
        s = np.zeros((part.shape[0], w + 1))
        np.cumsum(part, axis=1, out=s[:, 1:])
        lo = np.minimum(cols.astype(np.int64), w - 1)
        return s[:, lo] + (s[:, lo + 1] - s[:, lo]) * (cols - lo)

    out, total = np.zeros((len(rows), len(cols))), np.zeros(len(cols))
    for first in range(0, h, BAND):
        part = x[first : first + BAND]
        s = np.zeros((part.shape[0] + 1, len(cols)))
        np.cumsum(across(part), axis=0, out=s[1:])
        last = first + part.shape[0]
        own = (rows >= first) & ((rows < last) | (last == h))
        at = np.minimum(rows[own].astype(np.int64) - first, part.shape[0] - 1)
        out[own] = total + s[at] + (s[at + 1] - s[at]) * (rows[own] - first - at)[:, None]
        total = total + s[-1]
    return out


def area_resize(x: np.ndarray, height: int, width: int) -> np.ndarray:
    """Each target sample is the mean of the area that it covers."""
    h, w = x.shape[:2]
    ys, xs = _edges(h, height), _edges(w, width)
    planes = []
    for c in range(x.shape[2] if x.ndim == 3 else 1):
        s = _integral_at(x[:, :, c] if x.ndim == 3 else x, ys, xs)
        planes.append((s[1:, 1:] - s[:-1, 1:] - s[1:, :-1] + s[:-1, :-1]) * (height * width / (h * w)))
    return np.stack(planes, axis=2)


def gray(x: np.ndarray) -> np.ndarray:
    """Mean weights of red, green and blue (one channel stays)."""
    return x[:, :, :1] if x.shape[2] < 3 else (x[:, :, :3] @ np.array([0.299, 0.587, 0.114]))[:, :, None]


def difference_hash(x: np.ndarray) -> str:
    """64 bits: whether each of 9 samples in 8 rows is below its right neighbour; 16 hex digits."""
    s = np.round(area_resize(gray(x), 8, 9)[:, :, 0], 6)
    return np.packbits(s[:, 1:] > s[:, :-1]).tobytes().hex()


def npy_tile(x: np.ndarray, size: int = 8) -> bytes:
    """The image in size x size samples, as an NPY file."""
    out = io.BytesIO()
    np.save(out, np.clip(np.rint(area_resize(x, size, size)), 0, 255).astype(np.uint8))
    return out.getvalue()


def to_payload(text: str | None) -> tuple[int, bytes]:
    """Number of UTF-8 bytes, and these filled with zeros to a positive multiple of ROW."""
    data = (text or "").encode()
    return len(data), data + bytes(-len(data) % ROW or (0 if data else ROW))


def media_columns(df: DataFrame, text: str = "text", keep: list[str] | None = None, with_files: bool = False) -> DataFrame:
    """Stores each text as a PGM image, reads it back and describes it; with_files adds media and tile."""
    common.python_ready(df.sparkSession)
    made = [("n_bytes", "long"), ("payload_bytes", "long"), ("payload_sha256", "string"), ("tail_crc32", "long"), ("media_bytes", "long"), ("media_sha256", "string"), ("feature", "string")] + [("media", "binary"), ("tile", "binary")] * with_files
    keep = common.kept(df.columns if keep is None else keep, [n for n, _ in made])
    kind = {"long": T.LongType(), "string": T.StringType(), "binary": T.BinaryType()}
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(n, kind[t]) for n, t in made])

    def one(t: str | None) -> tuple:
        n, payload = to_payload(t)
        media = encode_pgm(np.frombuffer(payload, np.uint8).reshape(-1, ROW, 1))
        x = decode(media)
        back = x.tobytes()
        tile = npy_tile(x)
        out = (n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-ROW:]), len(media), hashlib.sha256(media).hexdigest(), f"{difference_hash(x)}-{zlib.crc32(tile):08x}")
        return (*out, media, tile) if with_files else out

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = pd.DataFrame([one(t) for t in frame[text]], columns=[n for n, _ in made], index=frame.index)
            yield pd.concat([frame[keep], out], axis=1)

    return df.mapInPandas(run, schema)


def decoded_column(df: DataFrame, media: str, prefix: str = "image_") -> DataFrame:
    """Decodes a binary column of Netpbm or BMP images: height, width, channels, dhash and NPY tile."""
    common.python_ready(df.sparkSession)
    names = [(prefix + n, t) for n, t in (("height", T.IntegerType()), ("width", T.IntegerType()), ("channels", T.IntegerType()), ("dhash", T.StringType()), ("tile", T.BinaryType()))]
    keep = common.kept(df.columns, [n for n, _ in names])
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(n, t) for n, t in names])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(None,) * 5 if (x := decode(d)) is None else (*x.shape, difference_hash(x), npy_tile(x)) for d in frame[media]]
            out = pd.DataFrame(rows, columns=[n for n, _ in names], index=frame.index, dtype=object)
            yield pd.concat([frame[keep], out], axis=1)

    return df.mapInPandas(run, schema)


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(common.table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
