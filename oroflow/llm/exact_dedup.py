"""Exact deduplication against an immutable snapshot, screened by static binary-fuse filters.

A snapshot's distinct digests are split by their leading bits into shards of bounded size; each shard gets a filter
that is built once. Incoming digests are first grouped among themselves (map-side combined, so a hot group of copies
is a few rows), then screened by the filter of their shard. Only positives join the snapshot's exact buckets. Groups
of more than one row are then held byte by byte against the row that stays.

Defined results: a null text is the empty text; rows that repeat id and text are indistinguishable and all get the
same result; a null id is the least one, so it stays only where its group has no other; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, materialise, mix64, spread_join

DIGEST_SCHEMA = "row_id long, digest binary"
FILTER_SCHEMA = "shard int, seed long, segment int, segments int, prints binary"


# ---------------------------------------------------------------- the filter

class FuseFilter:
    """Three-way binary fuse filter with 16-bit fingerprints: no false negatives, about 1.5e-5 false positives."""

    def __init__(self, seed: int, segment: int, segments: int, prints: np.ndarray):
        self.seed, self.segment, self.segments, self.prints = seed, segment, segments, prints

    @staticmethod
    def _places(keys: np.ndarray, seed: int, segment: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
        """Three slots in consecutive segments, and the fingerprint of each key."""
        h = mix64(keys ^ np.uint64(seed))
        first = (h >> np.uint64(40)) % np.uint64(segments)
        g = mix64(h + np.uint64(0x9E3779B97F4A7C15))
        mask = np.uint64(segment - 1)
        at = [(first + np.uint64(i)) * np.uint64(segment) + ((g >> np.uint64(20 * i)) & mask) for i in range(3)]
        return np.stack(at).astype(np.int64), (h & np.uint64(0xFFFF)).astype(np.uint16)

    @classmethod
    def build(cls, keys: np.ndarray) -> FuseFilter:
        """keys: distinct 64-bit words. Slots held by one key are peeled in rounds, then filled in reverse."""
        keys = np.unique(np.asarray(keys, np.uint64))
        n = len(keys)
        segment = 1 << max(2, int(np.log(max(n, 2)) / np.log(3.33) + 2.25))
        slots = int(n * max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))) + 3 * segment
        segments = max(1, -(-slots // segment) - 2)
        for seed in range(1, 200):
            at, prints = cls._places(keys, seed * 0x632BE59BD9B4E019 % (1 << 63), segment, segments)
            order = cls._peel(at, (segments + 2) * segment)
            if order is None:
                continue
            table = np.zeros((segments + 2) * segment, np.uint16)
            for rows, slot in reversed(order):  # within a round no key's slot is read by another key of that round's later fill
                table[slot] = prints[rows] ^ table[at[0, rows]] ^ table[at[1, rows]] ^ table[at[2, rows]]
            return cls(seed * 0x632BE59BD9B4E019 % (1 << 63), segment, segments, table)
        raise ValueError("no seed gives a filter; the keys are not distinct")

    @staticmethod
    def _peel(at: np.ndarray, slots: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
        n = at.shape[1]
        count = np.bincount(at.ravel(), minlength=slots)
        ids = np.zeros(slots, np.int64)
        np.add.at(ids, at.ravel(), np.tile(np.arange(n), 3))  # the sum of the ids of a slot is the id where one is left
        order, left = [], n
        alone = np.flatnonzero(count == 1)
        while len(alone):
            rows, first = np.unique(ids[alone], return_index=True)
            slot = alone[first]
            order.append((rows, slot))
            left -= len(rows)
            touched = at[:, rows].ravel()
            np.subtract.at(count, touched, 1)
            np.subtract.at(ids, touched, np.tile(rows, 3))
            touched = np.unique(touched)
            alone = touched[count[touched] == 1]
        return order if left == 0 else None

    def contains(self, keys: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros(0, bool)
        at, prints = self._places(np.asarray(keys, np.uint64), self.seed, self.segment, self.segments)
        return (self.prints[at[0]] ^ self.prints[at[1]] ^ self.prints[at[2]]) == prints


def _leading(digests: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(x[8:16] for x in digests), dtype=">u8").astype(np.uint64)


def build_filters(groups: DataFrame) -> DataFrame:
    """groups: shard, digest (distinct). One filter row for each shard."""

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        f = FuseFilter.build(_leading(pdf["digest"]))
        return pd.DataFrame({"shard": [int(key[0])], "seed": [f.seed], "segment": [f.segment], "segments": [f.segments], "prints": [f.prints.tobytes()]})

    return groups.select("shard", "digest").groupBy("shard").applyInPandas(build, FILTER_SCHEMA)


def screen(incoming: DataFrame, filters: DataFrame) -> DataFrame:
    """incoming: shard, digest. Adds maybe: false is a proof that the snapshot lacks the digest."""

    def probe(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame({"digest": [], "maybe": []})
        if not len(right):
            return pd.DataFrame({"digest": left["digest"], "maybe": False})
        r = right.iloc[0]
        f = FuseFilter(int(r.seed), int(r.segment), int(r.segments), np.frombuffer(r.prints, np.uint16))
        return pd.DataFrame({"digest": left["digest"], "maybe": f.contains(_leading(left["digest"]))})

    return incoming.select("shard", "digest").groupBy("shard").cogroup(filters.groupBy("shard")).applyInPandas(probe, "digest binary, maybe boolean")


# ---------------------------------------------------------------- the operator

def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", strength: int = 32) -> DataFrame:
    """row_id and the SHA-256 of the text with A-Z in lower case, as UTF-8; its first `strength` bytes, then zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in byte_slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([hashlib.sha256(t.lower()).digest()[:strength].ljust(32, b"\0") for t in texts], pa.binary())], names=["row_id", "digest"])

    return docs.select(F.col(id_col).cast("long").alias("row_id"), F.col(text_col).alias("text")).mapInArrow(run, DIGEST_SCHEMA)


def _grouped(rows: DataFrame) -> DataFrame:
    return rows.groupBy("digest").agg(F.max("row_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))


def differing(docs: DataFrame, groups: DataFrame, id_col: str, text_col: str, salt_rows: int = 256, strength: int = 32) -> DataFrame:
    """Rows of groups of several whose bytes differ from those of the row that stays: row_id, digest, other (a second
    digest). A group's texts meet in tasks of about salt_rows rows, each with a copy of the text that stays; rows are
    known by their texts' digests, so ids may repeat or be null."""
    several = groups.filter("n > 1").select("digest", "keep_id", F.ceil(F.col("n") / salt_rows).cast("int").alias("salts"), "n")
    lowered = F.translate(F.coalesce(F.col(text_col), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    texts = docs.select(F.col(id_col).cast("long").alias("row_id"), lowered.alias("bytes")).withColumn("digest", F.unhex(F.rpad(F.substring(F.sha2("bytes", 256), 1, 2 * strength), 64, "0")))
    full = spread_join(texts, several.drop("n"), "digest", counts=several.select("digest", "n"), deal="row_id", most=2048)
    full = full.withColumn("salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("salts").cast("long")).cast("int"))
    full = materialise(full.select("row_id", "digest", "salts", "salt", F.col("row_id").eqNullSafe(F.col("keep_id")).alias("stays"), "bytes"), "exact-copies")
    reps = full.filter("stays").groupBy("digest").agg(F.first("bytes").alias("kept_bytes"), F.first("salts").alias("salts"))
    reps = reps.select("digest", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "kept_bytes")
    return full.filter("not stays").join(reps, ["digest", "salt"]).filter(F.col("bytes") != F.col("kept_bytes")).select("row_id", "digest", F.sha2(F.reverse("bytes"), 512).alias("other"))


def exact_dedup(incoming: DataFrame, snapshot: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", shard_rows: int = 50_000, check_bytes: bool = True, strength: int = 32) -> DataFrame:
    """One row for each row of both tables: row_id, keep_id (the largest id of its group), group_size, kept, digest
    (binary), batch ('snapshot' or 'incoming'), known (an incoming text that the snapshot has). strength: bytes of the digest that count, fewer than 32 only to see what
    the byte check makes of digests that meet."""
    one = digests(incoming, id_col, text_col, strength).withColumn("batch", F.lit("incoming"))
    docs = incoming.select(id_col, text_col)
    if snapshot is not None:
        one = one.unionByName(digests(snapshot, id_col, text_col, strength).withColumn("batch", F.lit("snapshot")))
        docs = docs.unionByName(snapshot.select(id_col, text_col))
    rows = materialise(one, "exact-digests")
    new, old = (_grouped(rows.filter(F.col("batch") == b)) for b in ("incoming", "snapshot"))
    counts = {r["batch"]: r["n"] for r in rows.groupBy("batch").agg(F.count(F.lit(1)).alias("n")).collect()}
    shards = -(-max([1, *counts.values()]) // shard_rows)
    shard = F.pmod(F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long"), F.lit(shards)).cast("int")
    if counts.get("snapshot"):
        old = materialise(old.withColumn("shard", shard), "exact-snapshot")
        filters = materialise(build_filters(old), "exact-filters")
        new = new.withColumn("shard", shard)
        screened = new.join(screen(new, filters), "digest")
        maybe = screened.filter("maybe").select("digest", F.col("keep_id").alias("new_id"), F.col("n").alias("new_n"))
        hit = old.join(maybe, "digest", "full_outer")  # positives against exact buckets; a false positive has no bucket
        merged = hit.select("digest", F.greatest("keep_id", "new_id").alias("keep_id"), (F.coalesce("n", F.lit(0)) + F.coalesce("new_n", F.lit(0))).alias("n"), F.col("n").isNotNull().alias("in_snapshot"))
        groups = merged.unionByName(screened.filter("not maybe").select("digest", "keep_id", "n", F.lit(False).alias("in_snapshot")))
    else:
        groups = new.withColumn("in_snapshot", F.lit(False))
    groups = materialise(groups, "exact-groups")
    out = spread_join(rows, groups, "digest", counts=groups.select("digest", "n")).withColumn("other", F.lit(None).cast("string"))
    if check_bytes:
        odd = materialise(differing(docs, groups, id_col, text_col, strength=strength), "exact-differing")
        if not odd.isEmpty():  # digests met by chance: such rows form groups of their own
            odd = odd.select(F.col("row_id").alias("r"), F.col("digest").alias("d"), F.col("other").alias("o")).distinct()
            tagged = rows.join(odd, F.col("row_id").eqNullSafe(F.col("r")) & (F.col("digest") == F.col("d")), "left").select("row_id", "digest", "batch", F.col("o").alias("other"))
            own = tagged.groupBy("digest", "other").agg(F.max("row_id").alias("keep_id"), F.count(F.lit(1)).alias("n"), F.max((F.col("batch") == "snapshot")).alias("in_snapshot"))
            out = tagged.alias("t").join(own.alias("o"), (F.col("t.digest") == F.col("o.digest")) & F.col("t.other").eqNullSafe(F.col("o.other"))).select("t.row_id", "t.digest", "t.batch", "o.keep_id", "o.n", "o.in_snapshot")
    return out.select("row_id", "keep_id", F.col("n").alias("group_size"), F.col("row_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest", "batch", ((F.col("batch") == "incoming") & F.col("in_snapshot")).alias("known"))
