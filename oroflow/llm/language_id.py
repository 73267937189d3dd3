"""Language identification by prediction by partial matching.

Each language has a context tree over bytes up to `ORDER` bytes deep, learned once from a bounded sample of labelled
texts (docs_per_lang, chosen by a hash of the id) and then frozen. A byte's code length comes from the longest context
that the tree has, with escapes to shorter ones (method C: a context seen n times with d different bytes escapes with
d / (n + d)) and with exclusion of the bytes that the longer contexts had; below the root, all 256 bytes are alike.
As the statistics are frozen, what a context takes from each shorter one is worked out once, so the exact code length of
a byte is that number and one count. A slice of texts is coded through its different runs of ORDER + 1 bytes, language
by language. The least code length wins; the score is its share of 2^-length over the languages. Nothing but the labelled
sample bounds a tree: every language that has a labelled text has its own, with all its contexts.

Defined results: a null text or one without a letter is `und` with score 0; without any labelled text every text is
`und`; ties go to the first language by code point; an empty table gives an empty result; rows that repeat get the
same result; a long text is read whole, in chunks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, byte_slices, materialise, with_columns_schema

ORDER = 3
PAD = b"\n" * ORDER


def gram_counts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """lang, gram (ORDER bytes of context and one more), n over all texts given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in byte_slices(batches, "text", 4 << 20):
            langs = part.column(1).to_pylist()
            for lang in dict.fromkeys(langs):
                buf = np.frombuffer(b"".join(PAD + t.lower() for t, x in zip(texts, langs, strict=True) if x == lang), np.uint8).astype(np.uint32)
                own = np.concatenate([np.arange(len(t) + ORDER) >= ORDER for t, x in zip(texts, langs, strict=True) if x == lang])
                code = np.zeros(len(buf), np.uint32)
                code[ORDER:] = buf[:-3] << 24 | buf[1:-2] << 16 | buf[2:-1] << 8 | buf[3:]
                grams, n = np.unique(code[own], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams)), pa.array(grams.astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("lang is not null and text is not null")
    return rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _last(keys: np.ndarray, n: int) -> np.ndarray:
    """The last n bytes of each run of bytes."""
    return keys & np.uint32((1 << 8 * n) - 1)


def _find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Place of each key in an ascending table; -1 where it is not there."""
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


@dataclass
class ContextTree:
    """One language. For each order k: the runs of k + 1 bytes and their counts, the contexts of k bytes, and for each
    context what one count of order k, k - 1, ..., 0 and a byte without any count are worth."""

    grams: list[np.ndarray]
    counts: list[np.ndarray]
    contexts: list[np.ndarray]
    shares: list[np.ndarray]

    @classmethod
    def build(cls, gram: np.ndarray, n: np.ndarray) -> ContextTree:
        """gram: runs of ORDER + 1 bytes as one number, first byte highest; n: how often each was seen."""
        grams, counts, contexts, total, kinds, below = [], [], [], [], [], []
        for k in range(ORDER + 1):
            g, where = np.unique(_last(gram.astype(np.uint32), k + 1), return_inverse=True)
            c = np.bincount(where, weights=n)
            ctx, of = np.unique(g >> np.uint32(8), return_inverse=True)
            grams, counts, contexts = [*grams, g], [*counts, c], [*contexts, ctx]
            total.append(np.bincount(of, weights=c))
            kinds.append(np.bincount(of).astype(float))
            # what the bytes seen after a context count in the next shorter one, where they are excluded
            below.append(np.bincount(of, weights=counts[k - 1][_find(grams[k - 1], _last(g, k))]) if k else None)
        shares = []
        for k in range(ORDER + 1):
            own = [_find(contexts[d], _last(contexts[k], d)) for d in range(k + 1)]
            left, part = np.ones(len(contexts[k])), np.zeros((len(contexts[k]), k + 2))
            for d in range(k, -1, -1):
                t, different = total[d][own[d]], kinds[d][own[d]]
                if d < k:
                    t, different = t - below[d + 1][own[d + 1]], different - kinds[d + 1][own[d + 1]]
                use = different > 0
                part[:, k - d] = np.where(use, left / np.maximum(t + different, 1), 0.0)
                left = np.where(use, part[:, k - d] * different, left)
            part[:, k + 1] = left / np.maximum(256 - kinds[0][0], 1)
            shares.append(part)
        return cls(grams, counts, contexts, shares)

    def bits(self, runs: np.ndarray) -> np.ndarray:
        """Code length of the last byte of each run of ORDER + 1 bytes."""
        p, left = np.zeros(len(runs)), np.arange(len(runs))
        for k in range(ORDER, -1, -1):  # the longest context that the tree has
            at = _find(self.contexts[k], _last(runs[left] >> np.uint32(8), k))
            here, share = left[at >= 0], self.shares[k][at[at >= 0]]
            left = left[at < 0]
            for d in range(k, -1, -1):  # the longest of its ends that was followed by the byte
                got = _find(self.grams[d], _last(runs[here], d + 1))
                seen = got >= 0
                p[here[seen]] = self.counts[d][got[seen]] * share[seen, k - d]
                here, share = here[~seen], share[~seen]
            p[here] = share[:, k + 1]
        return -np.log2(np.maximum(p, 1e-12))


@dataclass
class ContextTrees:
    langs: list[str]
    trees: list[ContextTree]

    @classmethod
    def build(cls, langs: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray) -> ContextTrees:
        """lang: index into langs, for each (gram, n)."""
        return cls(langs, [ContextTree.build(gram[lang == j], n[lang == j]) for j in range(len(langs))])

    def code_lengths(self, texts: list[bytes], chunk: int = 1 << 22) -> np.ndarray:
        """Bits of each text in each language."""
        out = np.zeros((len(texts), len(self.langs)))
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        buf = np.frombuffer(b"".join(PAD + t.lower() for t in texts), np.uint8).astype(np.uint32)
        doc = np.repeat(np.arange(len(texts), dtype=np.int32), lens)
        places = np.arange(len(doc)) + ORDER * (doc + 1)  # of each text's own bytes in buf
        for lo in range(0, len(doc), chunk):
            mine, at = doc[lo : lo + chunk], places[lo : lo + chunk]
            runs, which = np.unique(buf[at - 3] << np.uint32(24) | buf[at - 2] << np.uint32(16) | buf[at - 1] << np.uint32(8) | buf[at], return_inverse=True)
            for j, tree in enumerate(self.trees):
                out[:, j] += np.bincount(mine, weights=tree.bits(runs)[which], minlength=len(texts))
        return out


def learn_languages(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_lang: int = 1500) -> ContextTrees | None:
    """labelled: texts with their language. The sample of a language is the texts whose hashed id and text are under
    docs_per_lang / (its texts), so labelled texts of one language are learned from in that number at most, but for chance.
    The driver gets the sizes of the languages, which go to the texts as a broadcast, so no text is shuffled; and the
    counted runs of bytes of the sample."""
    rows = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = rows.groupBy(lang_col).agg(F.count(F.lit(1)).alias("__n")).collect()
    sizes = F.broadcast(labelled.sparkSession.createDataFrame(sizes, f"`{lang_col}` string, __n long"))
    part = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col), F.lit(3)), F.lit(1 << 20)) * F.col("__n") < docs_per_lang * (1 << 20)
    sample = rows.join(sizes, lang_col).filter(part)
    grams = materialise(gram_counts(sample, text_col, lang_col), "lang-grams").toPandas().sort_values(["lang", "gram"])
    if not len(grams):
        return None
    langs = sorted(grams["lang"].unique(), key=lambda x: x.encode())
    return ContextTrees.build(langs, grams["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(), grams["gram"].to_numpy(), grams["n"].to_numpy(float))


def identify_language(docs: DataFrame, trees: ContextTrees | None, text_col: str = "text") -> DataFrame:
    """docs with lang_pred string, score double and bits_per_byte double (of the language predicted)."""
    letter = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    schema = with_columns_schema(docs, lang_pred=T.StringType(), score=T.DoubleType(), bits_per_byte=T.DoubleType())
    if trees is None:
        keep = [c for c in docs.columns if c not in ("lang_pred", "score", "bits_per_byte")]
        return docs.select(*keep, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("bits_per_byte"))
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array([*model.langs, "und"], object)
        for part, texts in byte_slices(batches, text_col, 4 << 20):
            has = part.column(part.schema.get_field_index("__letter")).to_numpy(zero_copy_only=False).astype(bool)
            bits = model.code_lengths(texts)
            best = bits.argmin(1)
            low = bits[np.arange(len(best)), best]
            score = 1 / np.exp2(np.maximum(low[:, None] - bits, -1000)).sum(1)
            size = np.maximum(np.fromiter(map(len, texts), float, len(texts)), 1)
            kept = part.drop_columns(["__letter"])
            yield append_columns(kept, lang_pred=pa.array(names[np.where(has, best, len(model.langs))], pa.string()), score=pa.array(np.where(has, score, 0.0)), bits_per_byte=pa.array(low / size))

    return docs.withColumn("__letter", letter).mapInArrow(run, schema)
