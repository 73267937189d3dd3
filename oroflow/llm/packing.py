"""Variable-capacity best-fit packing of documents into sequences of several permitted lengths.

Documents longer than the largest length are cut into pieces of it. Pieces are dealt by a hash into shards of bounded
size (an error of a bin or two a shard, against thousands of bins), and each shard is packed for itself, largest piece
first: into the open bin with the least room that still fits, or else into a new bin of the length that costs least
per word, judged by how far the smaller pieces still to come can fill it. At the end every bin is cut down to the
smallest permitted length that holds its contents.

Defined results: a null or negative size is 0, and such a document takes part with an empty piece; rows that repeat
are packed each for itself, dealt apart by their number among equals; ties go by id; an empty table gives an empty
result; other columns of the input are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered_copies

PACKED_SCHEMA = "row_id long, size long, piece long, start long, length long, bin_id long, bin_capacity long, bin_used long, bin_offset long"
CAPACITIES = (512, 1024, 2048, 4096, 8192)


def bin_cost(capacity: float, linear: float = 1.0, quadratic: float = 1 / 65536) -> float:
    """Of a sequence of that length: a linear part, and one for attention that grows with its square."""
    return linear * capacity + quadratic * capacity * capacity


def pack(lengths: np.ndarray, capacities: tuple[int, ...] = CAPACITIES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin of each piece, its offset there, and the capacity of each bin. Every length is at most the largest one."""
    caps = sorted(capacities)
    costs = [bin_cost(c) for c in caps]
    order = np.argsort(-np.asarray(lengths, np.int64), kind="stable")
    ascending = np.sort(np.asarray(lengths, np.int64))
    below = np.concatenate([[0], np.cumsum(ascending)])
    n = len(order)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    used: list[int] = []
    room: list[tuple[int, int]] = []  # (room, bin) of open bins, ascending
    opened: list[int] = []
    for done, k in enumerate(order.tolist()):
        size = int(lengths[k])
        i = bisect_left(room, (size, -1))
        if i < len(room):
            left, b = room.pop(i)
        else:
            best = None
            for c, cost in zip(caps, costs, strict=True):
                if c < size:
                    continue
                small = min(int(np.searchsorted(ascending, c - size, "right")), n - done - 1)  # pieces to come that fit beside it
                fill = size + min(c - size, int(below[small]))
                key = (cost / max(fill, 1), c)
                if best is None or key < best[0]:
                    best = (key, c)
            left, b = best[1], len(used)
            used.append(0)
            opened.append(best[1])
        bins[k], offsets[k] = b, used[b]
        used[b] += size
        if left > size or size == 0:
            insort(room, (left - size, b))
    final = np.array([caps[bisect_left(caps, u)] for u in used], np.int64)
    return bins, offsets, final


def best_fit_pack(rows: DataFrame, capacities: tuple[int, ...] = CAPACITIES, shard_rows: int = 20_000) -> DataFrame:
    """rows: row_id long, size long. One row for each piece: where it starts in its document, its bin, that bin's
    final length and use, and the piece's offset in the bin."""
    top = max(capacities)
    size = F.greatest(F.coalesce("size", F.lit(0)).cast("long"), F.lit(0).cast("long"))
    rows = numbered_copies(rows.select(F.col("row_id").cast("long"), size.alias("size")))
    pieces = rows.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("size") / top) - 1, F.lit(0).cast("long")))))
    pieces = pieces.withColumn("start", F.col("piece") * top).withColumn("length", F.least(F.lit(top).cast("long"), F.col("size") - F.col("start")))
    total = rows.agg(F.sum(F.greatest(F.ceil(F.col("size") / top), F.lit(1)))).first()[0] or 0
    shards = max(1, -(-int(total) // shard_rows))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "row_id", "piece", "__copy"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        bins, offsets, caps = pack(pdf["length"].to_numpy(), capacities)
        used = np.bincount(bins, weights=pdf["length"].to_numpy(float), minlength=len(caps)).astype(np.int64)
        return pdf.assign(bin_id=bins + (int(key[0]) << 32), bin_capacity=caps[bins], bin_used=used[bins], bin_offset=offsets).drop(columns=["shard", "__copy"])

    return pieces.withColumn("shard", F.pmod(F.xxhash64("row_id", "piece", "size", "__copy"), F.lit(shards))).groupBy("shard").applyInPandas(run, PACKED_SCHEMA)
