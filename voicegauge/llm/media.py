"""Image columns: Netpbm and BMP bytes to numpy arrays, area resizing by integral images, NPY tiles and difference hashes."""

from __future__ import annotations

import io
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voicegauge.llm._store import Store

UNIT = 192  # bytes of a row of 64 RGB pixels
_TOKEN = re.compile(rb"(?:[\x20\x09-\x0D]|#[^\n]*\n)*([^\x20\x09-\x0D#]+)")


def decode(data: bytes) -> tuple[str, np.ndarray]:
    """(format, samples as height x width x channels); ValueError for what isn't such an image.

    Netpbm P1 to P6, of 8 or 16 bits a sample; bitmaps give 0 and 1, with 1 black.
    BMP: uncompressed, 8 (palette), 24 or 32 bits a pixel; rows come top first.
    """
    if data[:1] == b"P" and data[1:2] in b"123456" and len(data) > 2:
        return f"P{data[1] - 48}", _netpbm(data)
    if data[:2] == b"BM":
        return "BMP", _bmp(data)
    raise ValueError("neither Netpbm nor BMP")


def _netpbm(data: bytes) -> np.ndarray:
    kind, at, head = data[1] - 48, 2, []
    for _ in range(2 if kind in (1, 4) else 3):
        m = _TOKEN.match(data, at)
        if not m or not m[1].isdigit():
            raise ValueError("broken Netpbm header")
        head.append(int(m[1]))
        at = m.end()
    width, height, top = (*head, 1)[:3]
    channels = 3 if kind in (3, 6) else 1
    if not (width and height and 0 < top < 65536):
        raise ValueError("broken Netpbm header")
    n = width * height * channels
    if kind == 1:
        body = re.sub(rb"[\x20\x09-\x0D]", b"", data[at:])
        out = np.frombuffer(body[:n], np.uint8) - 48
    elif kind in (2, 3):
        out = np.array(data[at:].split()[:n], dtype=np.uint16 if top > 255 else np.uint8)
    elif kind == 4:
        row = (width + 7) // 8
        raw = np.frombuffer(data, np.uint8, offset=at + 1)[: row * height]
        if len(raw) < row * height:
            raise ValueError("too few samples")
        out = np.unpackbits(raw.reshape(height, row), axis=1)[:, :width].ravel()
    else:
        kind_of = np.dtype(">u2" if top > 255 else "u1")
        out = np.frombuffer(data, kind_of, offset=at + 1, count=min(n, (len(data) - at - 1) // kind_of.itemsize)).astype(kind_of.newbyteorder("="))
    if len(out) < n:
        raise ValueError("too few samples")
    return out.reshape(height, width, channels)


def _bmp(data: bytes) -> np.ndarray:
    if len(data) < 54:
        raise ValueError("broken BMP header")
    word = lambda at: int.from_bytes(data[at : at + 4], "little", signed=True)
    start, size, width, height, depth = word(10), word(14), word(18), word(22), word(28) & 0xFFFF
    if width <= 0 or not height or word(30) not in (0, 3) or depth not in (8, 24, 32):
        raise ValueError("a BMP of another kind")
    row = (width * depth // 8 + 3) // 4 * 4
    raw = np.frombuffer(data, np.uint8)[start : start + row * abs(height)]
    if len(raw) < row * abs(height):
        raise ValueError("too few samples")
    rows = raw.reshape(abs(height), row)[:, : width * depth // 8]
    if depth == 8:
        palette = np.frombuffer(data, np.uint8)[14 + size : start].reshape(-1, 4)[:, 2::-1]
        out = palette[np.minimum(rows, len(palette) - 1)]
    else:
        out = rows.reshape(abs(height), width, depth // 8)[:, :, 2::-1]
    return out[::-1] if height > 0 else out


def encode_ppm(samples: np.ndarray) -> bytes:
    return b"P6\n%d %d\n255\n" % (samples.shape[1], samples.shape[0]) + samples.tobytes()


def encode_bmp(samples: np.ndarray) -> bytes:
    height, width, _ = samples.shape
    pad = -width * 3 % 4
    rows = np.pad(samples[::-1, :, ::-1].reshape(height, width * 3), ((0, 0), (0, pad)))
    size = 54 + rows.size
    head = b"BM" + size.to_bytes(4, "little") + bytes(4) + (54).to_bytes(4, "little") + (40).to_bytes(4, "little") + width.to_bytes(4, "little") + height.to_bytes(4, "little")
    return head + (1).to_bytes(2, "little") + (24).to_bytes(2, "little") + bytes(4) + rows.size.to_bytes(4, "little") + bytes(16) + rows.tobytes()


def area_resize(samples: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over equal areas of the image, as floats.

    The integral image is read between its points, so areas need not fall on
    pixels; it is summed up at the points that are read only, so an image of
    any size needs no copy of its samples.
    """
    out = samples
    for axis, to in ((0, height), (1, width)):
        n = out.shape[axis]
        edge = np.arange(to + 1) * n / to
        low = np.minimum(edge.astype(int), n - 1)
        points, of = np.unique(low, return_inverse=True)
        sums = np.add.reduceat(out, points, axis=axis, dtype=np.float64)
        before = np.cumsum(sums, axis=axis) - sums
        part = (edge - low).reshape([-1 if a == axis else 1 for a in range(out.ndim)])
        at = before.take(of, axis) + out.take(low, axis) * part
        out = np.diff(at, axis=axis) * (to / n)
    return out


def difference_hash(samples: np.ndarray) -> int:
    """64 bits: whether each of 9 x 8 areas is darker than the one to its right."""
    small = area_resize(samples, 8, 9)
    grey = small @ np.array([0.299, 0.587, 0.114]) if samples.shape[2] == 3 else small[:, :, 0]
    grey = np.round(grey, 6)
    return int.from_bytes(np.packbits(grey[:, 1:] > grey[:, :-1]).tobytes(), "big")


def npy_tile(samples: np.ndarray, side: int) -> bytes:
    """The image resized to side x side, 8 bits a sample, as an NPY file."""
    out = io.BytesIO()
    np.save(out, np.clip(np.round(area_resize(samples, side, side)), 0, 255).astype(np.uint8))
    return out.getvalue()


def texts_as_images(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", form: str = "ppm") -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8 bytes, filled up with spaces to whole rows of 64 RGB pixels, as an image of the form ppm or bmp. Null: empty."""

    def rows(batches):
        encode = {"ppm": encode_ppm, "bmp": encode_bmp}[form]
        for b in batches:
            n, media = [], []
            for value in b.column(1):
                raw = (value.as_py() or "").encode()
                n.append(len(raw))
                full = raw + b" " * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))
                media.append(encode(np.frombuffer(full, np.uint8).reshape(-1, UNIT // 3, 3)))
            if n:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    Store(docs.sparkSession, "media")
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), text).mapInArrow(rows, "doc_id long, n_bytes long, media binary")


def media_columns(images: DataFrame, key: list[str], media: str = "media", side: int = 32) -> DataFrame:
    """key columns and (media, format, height, width, channels, samples, tile, dhash, error) of each row's image.

    samples: the decoded array's bytes, row by row; tile: an NPY file of
    side x side; dhash: 16 hex digits. Null media, and bytes that are no such
    image, give nulls and an error text. Repeated rows are each decoded; no
    column outside key is carried over, so names can't clash. Empty table:
    empty result.
    """
    kinds = dict(images.dtypes)
    names = ["media", "format", "height", "width", "channels", "samples", "tile", "dhash", "error"]
    types = [pa.binary(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.string(), pa.string()]

    def rows(batches):
        for b in batches:
            out = []
            for value in b.column(len(key)):
                data = value.as_py()
                try:
                    if data is None:
                        raise ValueError("no media")
                    form, samples = decode(data)
                    out.append((data, form, *samples.shape, samples.tobytes(), npy_tile(samples, side), f"{difference_hash(samples):016x}", None))
                except ValueError as e:
                    out.append((data, *[None] * 7, str(e)))
            if out:
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(key))), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True))], [*key, *names])

    Store(images.sparkSession, "media")
    return images.select(*key, media).mapInArrow(rows, ", ".join([*(f"`{k}` {kinds[k]}" for k in key), "media binary, format string, height int, width int, channels int, samples binary, tile binary, dhash string, error string"]))
