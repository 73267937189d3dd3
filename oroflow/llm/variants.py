"""Spelling variant grouping by wildcard groups, without pairs.

Words that differ by one replaced code point meet in exactly one group (position, prefix, suffix); a word and the word
that one deletion makes of it meet under the shorter one. A group is never expanded into pairs: it keeps its size and its
two first words by frequency, and each member takes from it how many others there are and the best of them. A group has
at most as many words as the alphabet has letters (times the places, for deletions), so none can grow with the corpus.

Defined results: a null text has no words; a null id counts as the empty text in the hash; rows that share an id are each
counted; equal frequencies are ordered by code points; an empty table gives no rows; other columns are not read. A word
of L code points makes 2 L rows of its length, one after the other, so that very long words cost time but no memory.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_slices, materialise

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", noise: int = 97, least_chars: int = 5, least_count: int = 3) -> DataFrame:
    """Words of at least least_chars code points with their number: word, n. Of a run whose hash with its id is divisible
    by `noise`, one code point is left out; the hash is the same at all places of a run in a document, so it is made once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in byte_slices(batches, "text"):
            found: Counter = Counter()
            for key, text in zip(part.column(0).to_pylist(), texts, strict=True):
                start = zlib.crc32(f"{key}:".encode())
                for run, n in Counter(RUN.findall(text.lower().decode("utf-8", "replace"))).items():
                    if len(run) < least_chars:
                        continue
                    h = zlib.crc32(run.encode(), start)
                    if h % noise == 0:
                        i = h % len(run)
                        run = run[:i] + run[i + 1 :]
                        if len(run) < least_chars:
                            continue
                    found[run] += n
            yield pa.RecordBatch.from_pydict({"word": pa.array(found.keys(), pa.string()), "n": pa.array(found.values(), pa.int64())})

    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("text"))
    counted = rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.filter(F.col("n") >= least_count)


def nearest_forms(words: DataFrame) -> DataFrame:
    """For each word how many words are near it and the most frequent of them: word, n, n_near, near, near_n."""
    places = words.select("word", "n", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("i"))
    before, after = F.expr("substring(word, 1, i - 1)"), F.expr("substring(word, i + 1)")
    replaced = places.select("word", "n", F.concat(before, F.lit("*"), after).alias("key"), F.lit(2).alias("role"))
    # a deletion within a run of one letter is the same at all its places: the first counts
    first = F.expr("i = 1 OR substring(word, i, 1) <> substring(word, i - 1, 1)")
    shorter = places.filter(first).select("word", "n", F.concat(before, after).alias("key"), F.lit(1).alias("role"))
    own = words.select("word", "n", F.col("word").alias("key"), F.lit(0).alias("role"))
    rows = replaced.unionByName(shorter).unionByName(own)
    group = Window.partitionBy("key").orderBy("role", F.desc("n"), "word")
    whole = group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    member = F.struct("role", "n", "word")
    seen = rows.select("*", F.row_number().over(group).alias("place"), F.count(F.lit(1)).over(whole).alias("size"), F.first(member).over(whole).alias("one"), F.nth_value(member, 2).over(whole).alias("two"))
    # a longer word has one neighbour here, the word itself; it comes first where there is one
    others = F.when(F.col("role") == 1, F.when(F.col("one.role") == 0, 1).otherwise(0)).otherwise(F.col("size") - 1)
    best = F.when(F.col("place") == 1, F.col("two")).otherwise(F.col("one"))
    told = seen.select("word", "n", others.cast("long").alias("others"), F.when(others > 0, F.struct((-best["n"]).alias("n"), best["word"].alias("word"))).alias("best"))
    told = told.filter((F.col("others") > 0) | (F.col("role") == 0))
    found = told.groupBy("word", "n").agg(F.sum("others").alias("n_near"), F.min("best").alias("best"))
    return found.select("word", "n", "n_near", F.col("best.word").alias("near"), (-F.col("best.n")).alias("near_n"))


def roots(links: DataFrame) -> DataFrame:
    """For words that have a form: the last word on the way over forms. One round a step; a form is twice as frequent as
    its word, so there are at most as many as the largest count has bits, and no word has more followers than neighbours."""
    ends = links.select(F.col("form").alias("word")).distinct().join(links.select("word"), "word", "left_anti")
    front, found = ends.select("word", F.col("word").alias("root")), []
    while True:
        step = links.join(front.select(F.col("word").alias("form"), "root"), "form").select("word", "root")
        front = materialise(step, "variant-roots")
        if front.isEmpty():
            break
        found.append(front)
    out = links.select("word", F.col("form").alias("root")).limit(0)
    for part in found:
        out = out.unionByName(part)
    return out


def group_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ratio: int = 2, **counting: int) -> DataFrame:
    """Every word with its form (the most frequent near word, if `ratio` times as frequent), its root, and numbers."""
    words = materialise(word_counts(docs, id_col, text_col, **counting), "variant-words")
    known = materialise(nearest_forms(words), "variant-forms")
    formed = F.col("near_n") >= F.col("n") * ratio
    known = known.select("word", "n", "n_near", F.when(formed, F.col("near")).alias("form"), F.when(formed, F.col("near_n")).alias("form_n"))
    last = roots(known.filter("form IS NOT NULL").select("word", "form"))
    return known.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
