"""Files of many raster chunks: an 8-byte magic, version, chunk rows and columns, an index, zlib chunks.

`read_chunks` reads such files through `binaryFile`, so they may lie in any store that Spark reads. A file is planned as
rows of its index first; only the chunks that are wanted are inflated, and a chunk's cells are one bounded batch.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed layout: magic 8 s, version u16, rows u8, columns u8; index of (offset u32, size u32), row by row.
_HEAD = struct.Struct("<8sHBB")
_ENTRY = struct.Struct("<II")
SIDE = 256
NODATA = -32768


def pack_chunks(chunks: dict[tuple[int, int], np.ndarray], magic: bytes, version: int = 1) -> bytes:
    """A file of SIDE x SIDE chunks. Version 1: int16 with left differences; 2: float32."""
    rows, cols = max(r for r, _ in chunks) + 1, max(c for _, c in chunks) + 1
    body, index, at = b"", b"", _HEAD.size + rows * cols * _ENTRY.size
    for r in range(rows):
        for c in range(cols):
            z = chunks[r, c]
            raw = np.diff(z.astype(np.int16), axis=1, prepend=np.int16(0)).astype("<i2") if version == 1 else z.astype("<f4")
            data = zlib.compress(raw.tobytes())
            index += _ENTRY.pack(at, len(data))
            body += data
            at += len(data)
    return _HEAD.pack(magic, version, rows, cols) + index + body


def unpack_chunk(data: bytes, row: int, col: int, magic: bytes | None = None) -> np.ndarray:
    found, version, rows, cols = _HEAD.unpack_from(data)
    if magic is not None and found != magic:
        raise ValueError("other magic")
    if not (0 <= row < rows and 0 <= col < cols):
        raise ValueError("no such chunk")
    at, size = _ENTRY.unpack_from(data, _HEAD.size + (row * cols + col) * _ENTRY.size)
    raw = zlib.decompress(data[at : at + size])
    if version == 1:
        return np.cumsum(np.frombuffer(raw, "<i2").reshape(SIDE, SIDE), axis=1, dtype=np.int16)
    return np.frombuffer(raw, "<f4").reshape(SIDE, SIDE)


def read_chunks(spark: SparkSession, path: str, wanted: DataFrame | None = None, magic: bytes | None = None) -> DataFrame:
    """path, r, c (place in the file), z of the cells with data. wanted: chunk_row, chunk_col to read, small and held
    against Spark's broadcast limit like any join side; all without it."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    head = files.select("path", "content", F.conv(F.hex(F.substring("content", 11, 1)), 16, 10).cast("int").alias("rows"), F.conv(F.hex(F.substring("content", 12, 1)), 16, 10).cast("int").alias("cols"))
    one = head.withColumn("chunk_row", F.explode(F.expr("sequence(0, rows - 1)"))).withColumn("chunk_col", F.explode(F.expr("sequence(0, cols - 1)")))
    if wanted is not None:
        one = one.join(wanted, ["chunk_row", "chunk_col"], "left_semi")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file, data, row, col in zip(pdf["path"], pdf["content"], pdf["chunk_row"], pdf["chunk_col"], strict=True):
                z = unpack_chunk(data, row, col, magic)
                r, c = np.nonzero((z != NODATA) & ~np.isnan(z.astype(float)))
                yield pd.DataFrame({"path": file, "r": (r + row * SIDE).astype(np.int32), "c": (c + col * SIDE).astype(np.int32), "z": z[r, c].astype(float)})

    return one.select("path", "content", "chunk_row", "chunk_col").mapInPandas(run, "path string, r int, c int, z double")
