"""The corpus pipeline: toxicity filter, exact and near deduplication, mixing and packing, one operator a stage.

Each stage takes what its predecessor kept and returns the columns of documents; the last one returns the packing.

Defined results, for every stage: a null text is the empty text; a null id is an id like any other; rows that share an id
are told apart by their texts; rows that repeat id and text are one document after exact deduplication; columns of any
name pass through as they are, whatever the operators call theirs; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oroflow.llm.common import UPPER, id_remainder, materialise, split_words
from oroflow.llm.exact_dedup import exact_dedup
from oroflow.llm.mixing import balanced_mix
from oroflow.llm.near_dedup import near_dedup
from oroflow.llm.packing import best_fit_pack
from oroflow.llm.toxicity import learn_toxicity, score_toxicity


def _only(docs: DataFrame, kept: DataFrame, **keys: Column) -> DataFrame:
    """Rows of docs for which kept has a row of the same id and the same keys; null matches null. What is kept grows with
    the corpus, so it is merged at every size, not broadcast at small ones."""
    names = [f"__{k}" for k in keys]
    right = kept.select(F.col("row_id").alias("__row_id"), *[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)])
    same = F.col("doc_id").eqNullSafe(F.col("__row_id"))
    for value, name in zip(keys.values(), names, strict=True):
        same = same & (value == F.col(name))
    return docs.join(right.hint("merge"), same, "left_semi")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the segment scorer does not call toxic. It learns from the labels that op9 may learn from."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").filter(id_remainder("doc_id", 5) != 0)
    own = {c: f"__own_{k}" for k, c in enumerate(docs.columns) if c in ("score", "predicted", "passages")}  # not the scorer's
    scored = score_toxicity(docs.withColumnsRenamed(own), learn_toxicity(docs, labels)).filter("predicted = 0")
    return scored.select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id; of rows that repeat id and text, the first by its columns as JSON."""
    old = id_remainder("doc_id", 2) == 0
    kept = exact_dedup(docs.filter(~old), docs.filter(old)).filter("kept")
    kept = materialise(kept.groupBy("row_id", "digest").agg(F.count(F.lit(1)).alias("n")), "kept-ids")
    lowered = F.translate(F.coalesce("text", F.lit("")), UPPER, UPPER.lower())
    out = _only(docs, kept, digest=F.unhex(F.sha2(lowered, 256)))
    if kept.filter("n > 1").isEmpty():
        return out
    whole = F.struct(*docs.columns)
    one = out.groupBy(F.col("doc_id").alias("__id"), lowered.alias("__lowered")).agg(F.min_by(whole, F.to_json(whole)).alias("__row"))
    return one.select("__row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: that with the smallest id."""
    return _only(docs, near_dedup(docs).filter("kept"), mark=F.xxhash64(F.coalesce("text", F.lit(""))))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not, once or more often. Rows that repeat id, text and source are one
    document, the first by its columns as JSON, taken as often as the mix takes them together."""
    size = F.size(split_words("text")).cast("long")
    told = lambda c: F.concat(F.when(F.col(c).isNull(), "-").otherwise("="), F.coalesce(F.col(c).cast("string"), F.lit("")))
    key = F.xxhash64(told("doc_id"), F.coalesce("text", F.lit("")), told("source"))
    mixed = balanced_mix(docs.select(key.alias("row_id"), size.alias("size"), "source"))
    taken = mixed.groupBy("row_id").agg(F.sum("copies").alias("__copies"), F.count(F.lit(1)).alias("__rows")).filter("__copies > 0")
    taken = materialise(taken.withColumnRenamed("row_id", "__key"), "pipeline-taken")
    out = docs.withColumn("__key", key).join(taken.hint("merge"), "__key")
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))
    whole = F.struct(*docs.columns)
    once = out.filter("__rows = 1").withColumn("__each", each).select(*docs.columns)
    if taken.filter("__rows > 1").isEmpty():
        return once
    one = out.filter("__rows > 1").groupBy("__key", "__copies").agg(F.min_by(whole, F.to_json(whole)).alias("__row"))
    return once.unionByName(one.withColumn("__each", each).select("__row.*"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bin and place of each piece of each document taken."""
    return best_fit_pack(docs.select(F.col("doc_id").alias("row_id"), F.size(split_words("text")).cast("long").alias("size"))).withColumnRenamed("row_id", "doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Learned scores and sampled picks have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialise(docs, f"pipeline-{name}")
    return docs
