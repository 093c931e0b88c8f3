"""Small image kernels: packed colours, halving, block compression, mosaics.

Relational forms work on pixel rows; blocks and mosaics go through numpy in Arrow batches.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.ship import ship

# Weights of red and green against blue in colour distances, the colour of missing chunks, header fields.
RED, GREEN = 3, 6
MAGENTA = (255, 0, 255, 255)
FORMATS = {"BC1": (8, b"DXT1"), "BC3": (16, b"DXT5")}


def pack565(r: Column, g: Column, b: Column) -> Column:
    return F.shiftleft(F.shiftright(r, 3), 11).bitwiseOR(F.shiftleft(F.shiftright(g, 2), 5)).bitwiseOR(F.shiftright(b, 3))


def unpack565(c: Column) -> tuple[Column, Column, Column]:
    r, g, b = F.shiftright(c, 11).bitwiseAND(F.lit(31)), F.shiftright(c, 5).bitwiseAND(F.lit(63)), c.bitwiseAND(F.lit(31))
    return F.shiftleft(r, 3).bitwiseOR(F.shiftright(r, 2)), F.shiftleft(g, 2).bitwiseOR(F.shiftright(g, 4)), F.shiftleft(b, 3).bitwiseOR(F.shiftright(b, 2))


def halved(pixels: DataFrame) -> DataFrame:
    """(img, y, x, r, g, b, a) at half the size: means of two by two, cut to integers; an odd last row or column is left out."""
    g = pixels.groupBy("img", F.floor(F.col("y") / 2).cast("int").alias("y"), F.floor(F.col("x") / 2).cast("int").alias("x"))
    g = g.agg(F.count("*").alias("n"), *[F.floor(F.sum(c) / 4).cast("int").alias(c) for c in "rgba"])
    return g.where("n = 4").drop("n")


def data_size(width: Column, height: Column, kind: str, levels: int) -> Column:
    """Bytes of a texture and its halvings in blocks of four by four."""
    block = FORMATS[kind][0]
    side = lambda x, i: F.ceil(F.greatest(F.floor(x / F.pow(F.lit(2.0), i)), F.lit(1)) / 4)
    return F.aggregate(F.sequence(F.lit(0), F.lit(levels - 1)), F.lit(0).cast("long"), lambda s, i: s + side(width, i) * side(height, i) * block)


def _unpack(c: np.ndarray) -> np.ndarray:
    r, g, b = c >> 11 & 31, c >> 5 & 63, c & 31
    return np.stack([r << 3 | r >> 2, g << 2 | g >> 4, b << 3 | b >> 2], -1)


def bc1(blocks: np.ndarray) -> np.ndarray:
    """(n, 16, 4) bytes to (n, 8): the corners of the colours' box as endpoints, each pixel the nearest of four palette colours."""
    x = blocks[:, :, :3].astype(np.int64)
    pack = lambda c: c[:, 0] >> 3 << 11 | c[:, 1] >> 2 << 5 | c[:, 2] >> 3
    high, low = pack(x.max(1)), pack(x.min(1))
    high, low = np.maximum(high, low), np.minimum(high, low)
    a, b = _unpack(high), _unpack(low)
    palette = np.stack([a, b, (2 * a + b) // 3, (a + 2 * b) // 3], 1)
    d = (x[:, :, None, :] - palette[:, None]) * np.array([RED, GREEN, 1])
    pick = (d * d).sum(-1).argmin(-1)
    bits = (pick << 2 * np.arange(16)).sum(1)
    return np.concatenate([high.astype("<u2").view(np.uint8).reshape(-1, 2), low.astype("<u2").view(np.uint8).reshape(-1, 2), bits.astype("<u4").view(np.uint8).reshape(-1, 4)], 1)


def bc3(blocks: np.ndarray) -> np.ndarray:
    """(n, 16, 4) bytes to (n, 16): eight levels between the extreme alphas, then the colours."""
    alpha = blocks[:, :, 3].astype(np.int64)
    a, b = alpha.max(1), alpha.min(1)
    levels = np.stack([a, b, *[((7 - k) * a + k * b) // 7 for k in range(1, 7)]], 1)
    pick = np.abs(alpha[:, :, None] - levels[:, None]).argmin(-1)
    bits = (pick.astype(np.uint64) << (3 * np.arange(16)).astype(np.uint64)).sum(1, dtype=np.uint64)
    return np.concatenate([a.astype(np.uint8)[:, None], b.astype(np.uint8)[:, None], bits.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6], bc1(blocks)], 1)


def compressed(blocks: DataFrame, kind: str) -> DataFrame:
    """(id, rgba) with 64 bytes of a block, row by row, to (id, block)."""
    ship(blocks.sparkSession)
    encode = {"BC1": bc1, "BC3": bc3}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                raw = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(-1, 16, 4)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in encode(raw)], pa.binary())], ["id", "block"])

    return blocks.select("id", "rgba").mapInArrow(run, "id long, block binary")


def image_blocks(image: np.ndarray) -> np.ndarray:
    """(h, w, 4) to its blocks, row by row; pixels beyond the edge repeat the last."""
    h, w = image.shape[:2]
    x = np.pad(image, ((0, -h % 4), (0, -w % 4), (0, 0)), "edge")
    return x.reshape(x.shape[0] // 4, 4, x.shape[1] // 4, 4, 4).swapaxes(1, 2).reshape(-1, 16, 4)


def halvings(image: np.ndarray, levels: int | None = None) -> list[np.ndarray]:
    """The image and its halvings, down to one pixel or so many levels."""
    out = [image]
    while (levels is None or len(out) < levels) and max(out[-1].shape[:2]) > 1:
        x = out[-1]
        h, w = x.shape[0] // 2, x.shape[1] // 2
        if not h or not w:
            break
        out.append((x[: 2 * h, : 2 * w].reshape(h, 2, w, 2, 4).astype(np.uint16).sum((1, 3)) // 4).astype(np.uint8))
    return out


def header(width: int, height: int, kind: str, levels: int) -> bytes:
    """The 128 bytes before a texture's blocks."""
    block, code = FORMATS[kind]
    size = max(1, (width + 3) // 4) * max(1, (height + 3) // 4) * block
    flags = 0x1 | 0x2 | 0x4 | 0x1000 | 0x80000 | (0x20000 if levels > 1 else 0)
    caps = 0x1000 | (0x400008 if levels > 1 else 0)
    return b"DDS " + struct.pack("<7I44x", 124, flags, height, width, size, 0, levels) + struct.pack("<2I4s5I", 32, 0x4, code, 0, 0, 0, 0, 0) + struct.pack("<5I", caps, 0, 0, 0, 0)


def texture(image: np.ndarray, kind: str = "BC1", levels: int = 1) -> bytes:
    encode = {"BC1": bc1, "BC3": bc3}[kind]
    chain = halvings(image, levels)
    return header(image.shape[1], image.shape[0], kind, len(chain)) + b"".join(encode(image_blocks(x)).tobytes() for x in chain)


def mosaic(chunks: DataFrame, side: int = 256, across: int = 16) -> DataFrame:
    """(row, col, zoom, chunk_row, chunk_col, ok, data) with raw RGBA of each chunk to one image per tile; missing and failed ones are
    magenta. A tile has across * across chunks, a fixed number, so its group is bounded."""
    ship(chunks.sparkSession)
    pixels = side * side * 4

    def build(pdf):
        import pandas as pd

        out = np.empty((across, side, across, side, 4), np.uint8)
        out[:] = MAGENTA
        for r, c, ok, data in zip(pdf.chunk_row, pdf.chunk_col, pdf.ok, pdf.data):
            if ok and data is not None and len(data) == pixels:
                out[r, :, c] = np.frombuffer(data, np.uint8).reshape(side, side, 4)
        first = pdf.iloc[0]
        return pd.DataFrame({"row": [first.row], "col": [first.col], "zoom": [first.zoom], "image": [out.tobytes()]})

    return chunks.groupBy("row", "col", "zoom").applyInPandas(build, "row long, col long, zoom int, image binary")


def valid(data: Column, expected: Column) -> Column:
    """Whether bytes are a texture of the expected length."""
    return (F.substring(data, 1, 4) == F.lit(b"DDS ")) & (F.octet_length(data) == expected)
