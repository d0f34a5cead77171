"""Media columns: Netpbm and BMP to arrays, area resizing, NPY tiles, difference hashes.

Null or empty media decode to nothing (a null result); malformed media raise
``ValueError`` in the codec and give a null result in the column operator.  A
null text is stored as an empty one; a very long text is a tall image.  Rows
are independent, so repeated rows repeat results, and equal texts are stored
alike.
"""

from __future__ import annotations

import hashlib
import io
import struct
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame

from .common import map_rows, texts

ROW = 64


def encode_pgm(samples: np.ndarray) -> bytes:
    """A two-dimensional uint8 array as a binary grey map."""
    height, width = samples.shape
    return b"P5\n%d %d\n255\n" % (width, height) + samples.tobytes()


def encode_bmp(samples: np.ndarray) -> bytes:
    """(h, w, 3) uint8 RGB as an uncompressed 24-bit bitmap, bottom row first."""
    height, width, _ = samples.shape
    stride = (width * 3 + 3) // 4 * 4
    body = np.zeros((height, stride), np.uint8)
    body[:, : width * 3] = samples[::-1, :, ::-1].reshape(height, width * 3)
    head = struct.pack("<2sIHHI", b"BM", 54 + body.size, 0, 0, 54)
    return head + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, body.size, 2835, 2835, 0, 0) + body.tobytes()


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as (h, w) or (h, w, 3); uint8, or uint16 where the maximum is over 255."""
    if len(data) < 3 or data[:1] != b"P" or data[1:2] not in b"123456":
        raise ValueError("not a Netpbm image")
    kind, at, numbers = data[1] - 48, 2, []
    while len(numbers) < (2 if kind in (1, 4) else 3):
        while at < len(data) and data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.find(b"\n", at) + 1 or len(data)
            continue
        start = at
        while at < len(data) and data[at : at + 1].isdigit():
            at += 1
        if start == at:
            raise ValueError("bad header")
        numbers.append(int(data[start:at]))
    width, height = numbers[:2]
    top = numbers[2] if len(numbers) > 2 else 1
    if not (width > 0 and height > 0 and 0 < top < 65536):
        raise ValueError("bad size")
    channels = 3 if kind in (3, 6) else 1
    dtype = np.dtype(np.uint8 if top < 256 else ">u2")
    count = width * height * channels
    if kind > 3:
        at += 1  # one white-space character ends the header
    if kind == 4:
        stride = (width + 7) // 8
        if len(data) - at < stride * height:
            raise ValueError("truncated")
        bits = np.unpackbits(np.frombuffer(data, np.uint8, stride * height, at).reshape(height, stride), axis=1)
        return (1 - bits[:, :width]).astype(np.uint8)
    if kind > 3:
        if len(data) - at < count * dtype.itemsize:
            raise ValueError("truncated")
        flat = np.frombuffer(data, dtype, count, at)
    elif kind == 1:
        digits = [c for c in data[at:] if c in b"01"]
        flat = 1 - np.array(digits[:count], np.int64) + 48
    else:
        flat = np.array(data[at:].split()[:count], np.int64)
    if len(flat) < count:
        raise ValueError("truncated")
    out = flat.astype(np.uint8 if top < 256 else np.uint16)
    return out.reshape((height, width, 3) if channels == 3 else (height, width))


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed 8-bit (palette), 24-bit and 32-bit bitmaps as (h, w, 3) RGB."""
    if len(data) < 54 or data[:2] != b"BM":
        raise ValueError("not a bitmap")
    at, head, width, height, _, depth, packing = struct.unpack_from("<IIiiHHI", data, 10)
    if packing or depth not in (8, 24, 32) or width <= 0 or height == 0:
        raise ValueError("this kind of bitmap isn't supported")
    rows, stride = abs(height), (width * depth // 8 + 3) // 4 * 4
    if len(data) - at < rows * stride:
        raise ValueError("truncated")
    body = np.frombuffer(data, np.uint8, rows * stride, at).reshape(rows, stride)[:, : width * depth // 8]
    if depth == 8:
        colours = struct.unpack_from("<I", data, 46)[0] or 256
        palette = np.frombuffer(data, np.uint8, colours * 4, 14 + head).reshape(colours, 4)[:, 2::-1]
        out = palette[body]
    else:
        out = body.reshape(rows, width, depth // 8)[:, :, 2::-1]
    return np.ascontiguousarray(out[::-1] if height > 0 else out)


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def grey(image: np.ndarray) -> np.ndarray:
    return image.astype(float) if image.ndim == 2 else image.astype(float) @ np.array([0.299, 0.587, 0.114])


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """The mean over each target cell, with fractional borders.

    The integral image is linear between its nodes along each axis, so reading
    it at fractional places gives exact areas.
    """
    h, w = image.shape
    integral = np.zeros((h + 1, w + 1))
    np.cumsum(np.cumsum(image, 0), 1, out=integral[1:, 1:])

    def at(table: np.ndarray, places: np.ndarray) -> np.ndarray:
        low = np.minimum(places.astype(np.int64), len(table) - 2)
        part = (places - low)[:, None]
        return table[low] * (1 - part) + table[low + 1] * part

    ys, xs = np.arange(height + 1) * (h / height), np.arange(width + 1) * (w / width)
    corner = at(at(integral, ys).T, xs).T
    sums = np.diff(np.diff(corner, axis=0), axis=1)
    return sums / ((h / height) * (w / width))


def difference_hash(image: np.ndarray, size: int = 8) -> str:
    """Hex of size x size bits: whether each cell is brighter than its right neighbour."""
    small = area_resize(grey(image), size, size + 1)
    # the margin makes a flat image flat, whatever the order of the sums was
    return np.packbits(small[:, :-1] - small[:, 1:] > 1e-6).tobytes().hex()


def npy_tile(image: np.ndarray, side: int = 32) -> bytes:
    """A side x side uint8 tile in NPY format."""
    out = io.BytesIO()
    np.save(out, np.clip(np.rint(area_resize(grey(image), side, side)), 0, 255).astype(np.uint8))
    return out.getvalue()


def tiles(media: DataFrame, id_col: str, bytes_col: str, side: int = 32) -> DataFrame:
    """(id, height, width, hash, tile) of a column of encoded images."""

    def make():
        def work(rows):
            for key, data in rows:
                try:
                    image = decode(data or b"")
                except ValueError:
                    yield key, None, None, None, None
                    continue
                yield key, image.shape[0], image.shape[1], difference_hash(image), npy_tile(image, side)

        return work

    kind = media.schema[id_col].dataType.simpleString()
    return map_rows(media.select(id_col, bytes_col), make, f"id {kind}, height int, width int, hash string, tile binary", step=64)


def pack_text(text: str) -> tuple[int, bytes]:
    """(bytes of the text, stored image) of the zero-padded text.

    A payload that fills rows of 64 RGB pixels is a bitmap, any other a grey
    map with rows of 64 samples.
    """
    raw = text.encode("utf-8", "replace")
    rows = max(1, -(-len(raw) // ROW))
    padded = np.frombuffer(raw.ljust(rows * ROW, b"\0"), np.uint8)
    return len(raw), encode_pgm(padded.reshape(rows, ROW)) if rows % 3 else encode_bmp(padded.reshape(rows // 3, ROW, 3))


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", side: int = 16) -> DataFrame:
    """Store each whole text as an image, read it back and describe what was read.

    ``feature`` is the difference hash, ``tile`` the side x side NPY tile.
    """

    def make():
        def work(rows):
            for doc_id, text in rows:
                n, stored = pack_text(text)
                image = decode(stored)
                payload = image.tobytes()
                yield (
                    doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), crc32(payload[-ROW:]), len(stored),
                    hashlib.sha256(stored).hexdigest(), difference_hash(image), npy_tile(image, side),
                )

        return work

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile binary"
    return map_rows(texts(docs, id_col, text_col), make, schema)
