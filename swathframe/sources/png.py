"""PNG label masks of a table (key, content), decoded in Arrow batches.

Greyscale and palette images of 1 to 16 bits give labels: palettes their entries' numbers,
greys of 2 and 4 bits their values spread to 0..255, as image libraries show them. Values 0
and 255 alone become 0 and 1. Images with colours or transparency are no masks; those and
damaged or missing ones are error rows, which have a reason and no labels.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Fixed: (first column, first row, step of columns, step of rows) of the passes of interlaced images.
PASSES = [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)]


def chunks(raw: bytes) -> dict[bytes, bytes]:
    """Contents of an image's chunks by name, those of one name joined. Checksums must agree."""
    if raw[:8] != SIGNATURE:
        raise ValueError("no PNG")
    found: dict[bytes, list[bytes]] = {}
    at = 8
    while b"IEND" not in found:
        if at + 12 > len(raw):
            raise ValueError("ends early")
        (size,), name = struct.unpack_from(">I", raw, at), raw[at + 4 : at + 8]
        body = raw[at + 8 : at + 8 + size]
        if len(body) < size or raw[at + 8 + size : at + 12 + size] != struct.pack(">I", zlib.crc32(name + body)):
            raise ValueError(f"damaged chunk {name.decode('latin-1')}")
        found.setdefault(name, []).append(body)
        at += 12 + size
    return {name: b"".join(parts) for name, parts in found.items()}


def unfiltered(raw: np.ndarray, rows: int, width: int, step: int) -> np.ndarray:
    """Rows of ``width`` bytes after their line filters are undone; ``step`` bytes make a pixel."""
    lines = raw.reshape(rows, width + 1)
    out = np.zeros((rows + 1, width + step), np.uint8)  # a row of zeros above and a pixel of zeros before
    for y, line in enumerate(lines, 1):
        kind, x = line[0], line[1:]
        up, own = out[y - 1, step:], out[y, step:]
        if kind == 0:
            own[:] = x
        elif kind == 1:
            for lane in range(step):
                own[lane::step] = np.cumsum(x[lane::step], dtype=np.uint64).astype(np.uint8)
        elif kind == 2:
            own[:] = x + up
        elif kind in (3, 4):
            own[:] = along(x.tolist(), out[y - 1].tolist(), step, kind)
        else:
            raise ValueError(f"unknown line filter {kind}")
    return out[1:, step:]


def along(x: list[int], above: list[int], step: int, kind: int) -> list[int]:
    """A line of the filters that need each pixel before the next: the mean (3), or the nearest of left, up and corner (4)."""
    own = [0] * (len(x) + step)
    for i, value in enumerate(x):
        left, up = own[i], above[i + step]
        if kind == 3:
            guess = (left + up) >> 1
        else:
            corner = above[i]
            far_left, far_up, far_corner = abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)
            guess = left if far_left <= far_up and far_left <= far_corner else up if far_up <= far_corner else corner
        own[i + step] = (value + guess) & 255
    return own[step:]


def samples(lines: np.ndarray, columns: int, bits: int) -> np.ndarray:
    """Lines of bytes as values of ``bits`` bits, the first in the highest bits."""
    if bits == 16:
        return lines[:, 0::2].astype(np.int32) << 8 | lines[:, 1::2]
    if bits == 8:
        return lines.astype(np.int32)
    parts = np.unpackbits(lines, axis=1).reshape(len(lines), -1, bits)
    return (parts @ (1 << np.arange(bits)[::-1])).astype(np.int32)[:, :columns]


def decode_mask(raw: bytes) -> np.ndarray:
    """(h, w) labels of an image; ValueError where there are none."""
    parts = chunks(raw)
    w, h, bits, colour, packing, filters, interlaced = struct.unpack(">IIBBBBB", parts.get(b"IHDR", b""))
    if colour not in (0, 3) or b"tRNS" in parts and colour == 0:
        raise ValueError("not one value a pixel")
    if not w or not h or bits not in (1, 2, 4, 8, 16) or colour == 3 and (bits == 16 or b"PLTE" not in parts) or packing or filters or interlaced > 1:
        raise ValueError("invalid header")
    grids = [(x, y, dx, dy, -(-(w - x) // dx), -(-(h - y) // dy)) for x, y, dx, dy in (PASSES if interlaced else [(0, 0, 1, 1)]) if x < w and y < h]
    need = sum(rows * (-(-columns * bits // 8) + 1) for *_, columns, rows in grids)
    # no more is inflated than the header speaks of
    data = np.frombuffer(zlib.decompressobj().decompress(parts.get(b"IDAT", b""), need), np.uint8)
    if len(data) < need:
        raise ValueError("too few pixels")
    image, at = np.zeros((h, w), np.int32), 0
    for x, y, dx, dy, columns, rows in grids:
        width = -(-columns * bits // 8)
        lines = unfiltered(data[at : at + rows * (width + 1)], rows, width, max(1, bits // 8))
        image[y::dy, x::dx] = samples(lines, columns, bits)
        at += rows * (width + 1)
    if colour == 0 and bits in (2, 4):
        image *= 255 // ((1 << bits) - 1)
    return (image == 255).astype(np.int32) if np.isin(image, (0, 255)).all() else image


def decode_masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {"h": [], "w": [], "label": [], "error": []}
        for raw in batch.column(1).to_pylist():
            try:
                mask, error = decode_mask(raw or b""), None
            except (ValueError, struct.error, zlib.error) as reason:
                mask, error = None, str(reason)
            h, w = (None, None) if mask is None else mask.shape
            for name, value in (("h", h), ("w", w), ("label", None if mask is None else mask.ravel()), ("error", error)):
                out[name].append(value)
        kinds = {"h": pa.int32(), "w": pa.int32(), "label": pa.list_(pa.int32()), "error": pa.string()}
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(out[k], kind) for k, kind in kinds.items()]], ["key", *kinds])


def read_masks(contents: DataFrame, key: str = "path") -> DataFrame:
    """(key, h, w, label, error): row-major labels of the masks of a table (key, content)."""
    kind = contents.schema[key].dataType.simpleString()
    return contents.select(F.col(key).alias("key"), "content").mapInArrow(decode_masks, f"key {kind}, h int, w int, label array<int>, error string")


def encode_mask(labels: np.ndarray, filters: list[int] | None = None) -> bytes:
    """An 8-bit greyscale image; ``filters`` has the line filter of each row, none by default."""
    h, w = labels.shape
    above, data = np.zeros(w + 1, np.int32), b""
    for y in range(h):
        own = np.concatenate([[0], labels[y].astype(np.int32)])
        left, up, corner = own[:-1], above[1:], above[:-1]
        far = np.stack([abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)])
        kind = filters[y] if filters else 0
        guess = [0, left, up, (left + up) // 2, np.choose(far.argmin(0), [left, up, corner])][kind]
        data += bytes([kind]) + (own[1:] - guess).astype(np.uint8).tobytes()
        above = own
    part = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    return SIGNATURE + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(data)) + part(b"IEND", b"")
