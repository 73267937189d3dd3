"""Token counts through a digest cache.

The cache is a Parquet table (tokenizer, digest, n_bytes, n_tokens): the digest of a whole text and that of the
tokenizer's file. Texts join it by digest; of those it lacks, one row each is fetched, encoded and appended. Only then
do all rows take their count from the cache. Duplicates meet as digests, combined on the map side, never as texts; the
rows of a frequent text are dealt apart. Calls may share a cache: a digest that two calls or a repeated job appended
counts once, as its rows are alike.

Defined results: a null text is the empty text (0 tokens); rows that repeat all get the count; an empty table gives an
empty result. A text is encoded whole; to make the library's work small, it is cut before single spaces between
visible characters, where byte-level pre-tokenisation always cuts, and counts of such pieces are kept by the worker.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, materialise, scratch_dir, spread_join

CACHE_SCHEMA = "tokenizer string, digest binary, n_bytes long, n_tokens long"
#: A lone space between characters that no pre-tokeniser counts as space.
_CUT = re.compile(r"(?<=[!-~À-ɏ]) (?=[!-~À-ɏ])")
PIECES_KEPT = 400_000


def tokenizer_digest(path: str) -> str:
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()


class PieceCounter:
    """Counts tokens of whole texts with one tokenizers file, remembering a bounded number of pieces."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), {}
        state = self.tokenizer.to_str()
        #: Pieces may be counted apart only for byte-level pre-tokenisation without a normaliser.
        self.cuts = '"normalizer":null' in state.replace(" ", "") and '"type":"ByteLevel","add_prefix_space":false' in state.replace(" ", "")
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def _encode(self, texts: list[str]) -> list[int]:
        return [len(x.ids) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, texts: list[str]) -> list[int]:
        if not self.cuts:
            return self._encode(texts)
        if len(self.known) > PIECES_KEPT:
            self.known.clear()
        known, cut = self.known, [_CUT.split(t) for t in texts]
        missing = list({p for pieces in cut for p in pieces[1:] if p not in known})
        known.update(zip(missing, self._encode([" " + p for p in missing]), strict=True))
        first = self._encode([pieces[0] for pieces in cut])
        return [n + sum(map(known.__getitem__, pieces[1:])) for n, pieces in zip(first, cut, strict=True)]


@lru_cache(2)
def counter(path: str) -> PieceCounter:
    """One for each worker, so its pieces last over tasks."""
    return PieceCounter(path)


def encode_counts(rows: DataFrame, path: str) -> DataFrame:
    """rows: digest binary, text string. digest, n_bytes, n_tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for part, texts in byte_slices(batches, "text", 2 << 20):
            n = count([t.decode() for t in texts])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, texts), pa.int64()), pa.array(n, pa.int64())], names=["digest", "n_bytes", "n_tokens"])

    return rows.select("digest", "text").mapInArrow(run, "digest binary, n_bytes long, n_tokens long")


def token_counts(docs: DataFrame, tokenizer_path: str, cache_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: row_id, n_bytes, n_tokens. cache_path: where the cache is, or is to be; without
    it a cache of this call's own in the shared folder."""
    spark = docs.sparkSession
    version = tokenizer_digest(tokenizer_path)
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).cast("long").alias("row_id"), text.alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    digests = materialise(keyed.select("row_id", "digest"), "token-digests")
    if cache_path is None:
        cache_path = f"{scratch_dir(spark)}/token-cache-{version[:12]}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache_path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        spark.createDataFrame([], CACHE_SCHEMA).write.parquet(cache_path)

    def cached() -> DataFrame:
        rows = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).filter(F.col("tokenizer") == version)
        return rows.groupBy("digest").agg(F.max("n_bytes").alias("n_bytes"), F.max("n_tokens").alias("n_tokens"))

    distinct = materialise(digests.groupBy("digest").agg(F.min("row_id").alias("row_id"), F.count(F.lit(1)).alias("n")), "token-distinct")
    misses = distinct.join(cached(), "digest", "left_anti")
    misses = misses.select(F.col("digest").alias("d"), F.col("row_id").alias("r"))
    wanted = keyed.join(misses, (F.col("digest") == F.col("d")) & F.col("row_id").eqNullSafe(F.col("r")), "left_semi")
    new = encode_counts(wanted, tokenizer_path).groupBy("digest").agg(F.max("n_bytes").alias("n_bytes"), F.max("n_tokens").alias("n_tokens"))
    new.select(F.lit(version).alias("tokenizer"), "digest", "n_bytes", "n_tokens").write.mode("append").parquet(cache_path)
    return spread_join(digests, cached(), "digest", counts=distinct.select("digest", "n")).select("row_id", "n_bytes", "n_tokens")
