"""Tile payloads: predictors, quantisation, containers, PNG heights; and tile tables over them.

Kernels work on one tile in NumPy; `encode_tiles` and `decode_tiles` run them over tile tables in Arrow batches. A corrupt
payload gives a null tile and its error text, never a failed job.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODATA = -32768
#: Container header: vmin int16, range uint16, bits uint8, flags uint8; fixed layout. Flags: bit 0-1 predictor, 2-3 compressor.
HEADER = struct.Struct("<hHBB")
LEFT, GRADIENT = 1, 2
ZLIB, ZSTD = 1, 2


class TileError(ValueError):
    """A payload that is not a tile."""


def predict(z: np.ndarray, kind: int) -> np.ndarray:
    """Residuals against the left neighbour, or against left + above - above-left."""
    out = np.array(z, np.int64)
    out[:, 1:] -= z[:, :-1].astype(np.int64)
    if kind == GRADIENT:
        rows = out.copy()
        out[1:] -= rows[:-1]
    return out


def reconstruct(residuals: np.ndarray, kind: int) -> np.ndarray:
    """Prefix sums undo the prediction: along rows, and for the gradient along columns too."""
    out = np.asarray(residuals, np.int64)
    if kind == GRADIENT:
        out = np.cumsum(out, axis=0)
    return np.cumsum(out, axis=1)


def bits_for(span: float) -> int:
    """Bits that hold a range of whole metres, 8 to 16."""
    return int(min(16, max(8, np.ceil(np.log2(span + 1))))) if span > 0 else 8


def encode(z: np.ndarray, bits: int | None = None, predictor: int = GRADIENT, compressor: int = ZSTD, level: int = 9) -> bytes:
    """A square tile of whole metres. At 16 bits values come back exactly; below, they are quantised over the tile's
    range. The top code stands for cells without data, so these survive at every depth."""
    z = np.asarray(z, np.int64)
    if z.ndim != 2 or z.shape[0] != z.shape[1]:
        raise TileError("a tile is square")
    valid = z != NODATA
    lo, hi = (int(z[valid].min()), int(z[valid].max())) if valid.any() else (0, 0)
    bits = bits or bits_for(hi - lo + 1)
    top = (1 << bits) - 2
    scale = min(1.0, top / (hi - lo)) if hi > lo else 1.0
    q = np.where(valid, np.rint((z - lo) * scale), top + 1).astype(np.int64)
    body = np.mod(predict(q, predictor), 1 << bits).astype("<u2").tobytes()
    if compressor == ZSTD:
        import zstandard

        body = zstandard.ZstdCompressor(level=level).compress(body)
    else:
        body = zlib.compress(body, level)
    return HEADER.pack(lo, hi - lo, bits, predictor | compressor << 2) + body


def decode(payload: bytes) -> np.ndarray:
    try:
        lo, span, bits, flags = HEADER.unpack_from(payload)
        predictor, compressor = flags & 3, flags >> 2 & 3
        body = payload[HEADER.size :]
        if compressor == ZSTD:
            import zstandard

            body = zstandard.ZstdDecompressor().decompress(body)
        else:
            body = zlib.decompress(body)
        side = int(np.sqrt(len(body) // 2))
        q = np.mod(reconstruct(np.frombuffer(body, "<u2").astype(np.int64).reshape(side, side), predictor), 1 << bits)
    except Exception as e:
        raise TileError(str(e)) from e
    top = (1 << bits) - 2
    scale = min(1.0, top / span) if span else 1.0
    return np.where(q > top, NODATA, np.rint(q / scale) + lo).astype(np.int64)


def quantised_rmse(z: np.ndarray, bits: int) -> float:
    """Root mean square error of a tile's cells with data after a round trip at `bits`; 0 without such cells."""
    known = z[z != NODATA]
    if not len(known):
        return 0.0
    lo, span, top = int(known.min()), int(known.max() - known.min()), (1 << bits) - 2
    scale = min(1.0, top / span) if span else 1.0
    back = np.rint(np.rint((known - lo) * scale) / scale) + lo
    return float(np.sqrt(np.mean((back - known) ** 2)))


def png_encode(rgb: np.ndarray) -> bytes:
    """8-bit RGB or RGBA image."""
    h, w, n = rgb.shape
    raw = np.concatenate([np.zeros((h, 1), np.uint8), rgb.reshape(h, w * n)], axis=1).tobytes()
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2 if n == 3 else 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def _undo_filter(kind: int, line: np.ndarray, above: np.ndarray) -> None:
    """Average (3) and Paeth (4) in place: each pixel needs the one before it, its channels go together."""
    before, over = np.zeros(line.shape[1], np.int64), np.zeros(line.shape[1], np.int64)
    for x in range(len(line)):
        up = above[x]
        if kind == 3:
            near = (before + up) >> 1
        else:
            left, top, corner = abs(up - over), abs(before - over), abs(before + up - 2 * over)
            near = np.where((left <= top) & (left <= corner), before, np.where(top <= corner, up, over))
        before = line[x] = (line[x] + near) & 255
        over = up


def png_decode(data: bytes) -> np.ndarray:
    """Pixels of an 8-bit RGB or RGBA image; all five row filters."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise TileError("not a PNG")
    at, body, w, h, n = 8, b"", 0, 0, 3
    while at < len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        part = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            w, h, depth, colour = struct.unpack_from(">IIBB", part)
            if depth != 8 or colour not in (2, 6):
                raise TileError("8-bit RGB or RGBA only")
            n = 3 if colour == 2 else 4
        elif kind == b"IDAT":
            body += part
        at += 12 + size
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + w * n)
    out, above = np.zeros((h, w * n), np.int64), np.zeros(w * n, np.int64)
    for y in range(h):
        kind, line = int(raw[y, 0]), raw[y, 1:].astype(np.int64)
        if kind == 1:
            line = np.cumsum(line.reshape(w, n), axis=0).reshape(-1) & 255
        elif kind in (3, 4):
            _undo_filter(kind, line.reshape(w, n), above.reshape(w, n))
        elif kind == 2:
            line = (line + above) & 255
        out[y] = above = line
    return out.reshape(h, w, n).astype(np.uint8)


def heights_to_png(z: np.ndarray) -> bytes:
    """Heights as red * 256 + green + blue / 256 - 32768; no data is black."""
    v = np.clip(np.nan_to_num(z, nan=-32768.0) + 32768.0, 0, 65535.996)
    v = np.where(np.isnan(z), 0.0, v)
    return png_encode(np.stack([v // 256, v % 256, (v % 1) * 256], axis=2).astype(np.uint8))


def png_to_heights(data: bytes) -> np.ndarray:
    p = png_decode(data).astype(float)
    return np.where(p[..., :3].any(axis=2), p[..., 0] * 256 + p[..., 1] + p[..., 2] / 256 - 32768, np.nan)


# ---------------------------------------------------------------- tile tables

TILE_SCHEMA = "tr int, tc int, payload binary, n_cells long"


def encode_tiles(cells: DataFrame, side: int = 64, bits: int | None = None, predictor: int = GRADIENT, compressor: int = ZSTD) -> DataFrame:
    """Cells (r, c, z) to tiles of side x side: one group a tile, so a group is bounded."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        z = np.full((side, side), NODATA, np.int64)
        z[pdf["r"] % side, pdf["c"] % side] = pdf["z"].fillna(NODATA).to_numpy().astype(np.int64)
        return pd.DataFrame({"tr": [key[0]], "tc": [key[1]], "payload": [encode(z, bits, predictor, compressor)], "n_cells": [int((z != NODATA).sum())]})

    tiled = cells.select("r", "c", "z", F.floor(F.col("r") / side).cast("int").alias("tr"), F.floor(F.col("c") / side).cast("int").alias("tc"))
    return tiled.groupBy("tr", "tc").applyInPandas(run, TILE_SCHEMA)


def decode_tiles(tiles: DataFrame, side: int = 64) -> DataFrame:
    """Tiles to cells with data: r, c, z; a corrupt tile gives one row with its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for tr, tc, payload in zip(pdf["tr"], pdf["tc"], pdf["payload"], strict=True):
                try:
                    z = decode(payload)
                except TileError as e:
                    yield pd.DataFrame({"r": [tr * side], "c": [tc * side], "z": [None], "error": [str(e)]})
                    continue
                r, c = np.nonzero(z != NODATA)
                yield pd.DataFrame({"r": (r + tr * side).astype(np.int32), "c": (c + tc * side).astype(np.int32), "z": z[r, c].astype(float), "error": None})

    return tiles.select("tr", "tc", "payload").mapInPandas(run, "r int, c int, z double, error string")


def manifest(tiles: DataFrame) -> DataFrame:
    """Tiles, cells and bytes by tile row."""
    return tiles.groupBy("tr").agg(F.count(F.lit(1)).alias("n_tiles"), F.sum("n_cells").alias("n_cells"), F.sum(F.length("payload")).alias("n_bytes"))
