"""Shared helpers: scratch tables, whole-text batches, words and digests."""

from __future__ import annotations

import tempfile
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Java and Python pattern of what separates words.
SPACE = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SCRATCH = "oroflow-scratch"


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where that is unset (local runs)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="oroflow-")
        spark.sparkContext.setCheckpointDir(found)
    return f"{found.rstrip('/')}/{_SCRATCH}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df into the shared folder and read it back: cuts the lineage, and no executor's loss can undo it."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the folder of a table that materialise wrote; only for when all that is made from it is written down."""
    spark, path = df.sparkSession, df.select("_metadata.file_path").first()
    if path:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path[0]).getParent()
        if f"/{_SCRATCH}/" in folder.toString():
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def hot_keys(counts: DataFrame, key: str, rows: int, share: float, floor: int, most: int, row_bytes: int) -> dict[int, list]:
    """Keys to be dealt out by the bits of their number of salts; see spread_join for the bounds."""
    if row_bytes:
        most = min(most, max(1, (256 << 20) // row_bytes))
    least = max(floor, min(int(rows * share), most), rows // 200_000)
    hot: dict[int, list] = defaultdict(list)
    for value, n in counts.filter((F.col("n") > least) & F.col(key).isNotNull()).select(key, "n").collect():
        hot[((n - 1) // least).bit_length()].append(value)
    return hot


def spread_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", counts: DataFrame | None = None, share: float = 1e-3, floor: int = 64, rows: int | None = None, deal: str | None = None, most: int = 100_000, row_bytes: int = 0) -> DataFrame:
    """left joined with right, which has one row a key, however many rows of left stand under one key. Keys that hold
    more than `share` of left's rows (and more than `floor`), or more than `most` rows, or more than 256 MB of rows of
    `row_bytes`, are dealt to as many salts as they hold that many rows, up to the next power of two, with a copy of
    right's row for each; all other keys have one salt, so the plan is the same whether there are such keys or not. The
    bound rises only where more than 200,000 keys would pass it (beyond 2 * 10^10 rows), so that the list of keys has a
    proven size; up to 1000 stand in an expression, more in a broadcast table. left is a written table, or has a column
    `deal` that tells rows of a key apart: a salt that a task run again might give anew would lose rows. counts: key and
    n, and rows: of left at most, where they are known."""
    rows = left.count() if rows is None else rows
    counts = left.groupBy(key).agg(F.count(F.lit(1)).alias("n")) if counts is None else counts
    hot = hot_keys(counts, key, rows, share, floor, most, row_bytes)
    if sum(map(len, hot.values())) <= 1000:
        salts = F.lit(1).cast("long")
        for bits, keys in sorted(hot.items()):
            salts = F.when(F.col(key).isin(keys), F.lit(1 << bits).cast("long")).otherwise(salts)
        mark = lambda df: df.withColumn("__salts", salts)
    else:
        schema = T.StructType([T.StructField(key, left.schema[key].dataType), T.StructField("__salts", T.LongType())])
        marks = left.sparkSession.createDataFrame([(k, 1 << bits) for bits, keys in hot.items() for k in keys], schema)
        mark = lambda df: df.join(F.broadcast(marks), key, "left").withColumn("__salts", F.coalesce("__salts", F.lit(1).cast("long")))
    here = mark(left).withColumn("__salt", F.pmod(F.xxhash64(F.col(deal) if deal else F.monotonically_increasing_id()), F.col("__salts"))).drop("__salts")
    there = mark(right).withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__salts") - 1))).drop("__salts")
    return here.join(there, [key, "__salt"], how).drop("__salt")


def numbered_copies(rows: DataFrame) -> DataFrame:
    """Rows with __copy, 0 onwards among those that are equal in all columns: repeated rows are counted (small, combined on
    the map side) and written out again, so that a hash of row and copy deals them apart, the same in every run."""
    counted = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("__n"))
    return counted.withColumn("__copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1))).drop("__n")


def clear_scratch(spark: SparkSession) -> None:
    """Delete all scratch tables of this application; only for when no frame made from them is used any more."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(scratch_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def split_words(text: str | Column) -> Column:
    """Array of the words of a text; null counts as empty."""
    return F.array_remove(F.split(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), SPACE), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is made once, however often body reads it. A column of its own would do, but for filters
    above: pushed down, they repeat its definition at each place."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def id_remainder(id_col: str, m: int) -> Column:
    """crc32 of the id as text, modulo m; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(m))


def most_frequent(counts: DataFrame, column: str, k: int) -> DataFrame:
    """The rows of the largest counts (1 or more), k at most: those from a bound upwards that a small histogram of the
    counts' sizes (a thousand bins) gives. A sorted limit would send k rows of every partition to the driver."""
    size = F.floor(F.log2(F.col(column)) * 16)
    left, bound = k, None
    for r in sorted(counts.groupBy(size.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r["b"]):
        left -= r["n"]
        if left < 0:
            break
        bound = r["b"]
    return counts.filter(size >= bound) if bound is not None else counts.limit(0)


def with_columns_schema(df: DataFrame, **extra: T.DataType) -> T.StructType:
    """Schema of df plus columns; a column of the input that has such a name gives way."""
    return T.StructType([f for f in df.schema if f.name not in extra] + [T.StructField(k, v) for k, v in extra.items()])


def byte_slices(batches: Iterator[pa.RecordBatch], text_col: str, max_bytes: int = 8 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Whole rows in slices of about max_bytes of text (one row at least), each with its texts as UTF-8; null is empty."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(text_col))
        sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = sizes[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(sizes, before + max_bytes, "right")))
            part = batch.slice(at, to - at)
            yield part, [x or b"" for x in texts.slice(at, to - at).cast(pa.binary()).to_pylist()]
            at = to


def append_columns(part: pa.RecordBatch, **extra: pa.Array) -> pa.RecordBatch:
    names = [n for n in part.schema.names if n not in extra]
    return pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(n)) for n in names), *extra.values()], names=[*names, *extra])


def encode_words(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Codes of all words in order, words per text, and the distinct words. bytes.split() splits at exactly the six
    ASCII spaces, bytes.lower() changes A-Z only."""
    docs = [(t.lower() if lower else t).split() for t in texts]
    lens = np.fromiter(map(len, docs), np.int64, len(docs))
    flat = list(chain.from_iterable(docs))
    words = list(dict.fromkeys(flat))
    ids = dict(zip(words, range(len(words)), strict=True))
    return np.fromiter(map(ids.__getitem__, flat), np.int32, len(flat)), lens, words


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def per_text(values: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Sum of the values of each text."""
    ends = np.cumsum(lens)
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return total[ends] - total[ends - lens]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x
