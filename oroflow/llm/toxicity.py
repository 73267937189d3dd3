"""Toxic passages by maximum-scoring segments.

Words get log-odds of the toxic against the other labelled texts under an informative Dirichlet prior (pseudo-counts in
proportion to the word's share of all labelled texts, prior_share of their words in all). Words that the labels mark clearly (z at least min_z) keep their
log-odds as score; every other word scores `-drift`, so segments have a negative expectation and the linear-time scan
of Ruzzo and Tompa gives all maximal ones. Scores are calibrated as extreme values: lambda solves the Karlin-Altschul
equation on the words of texts that are not toxic (their frequencies under the same prior), K is the maximum-likelihood
one of the best segments of texts drawn from those frequencies (of texts of n words the best has P(S or more) = 1 -
exp(-K n exp(-lambda S))), a segment's bits are lambda S - ln(K n), and one is significant where its expected number by
chance is under max_e. A text is judged by two chances: that of its best
segment, and that of the sum of all segments with positive bits (the sum statistic of r segments). Its score is a
logistic function of the logarithms of the two, fitted on the labelled sample.

Labels come from a bounded sample (max_labelled rows, by a hash of the id). Defined results: a null text is the empty
text and gets a score; null labels are left out; without labels of both kinds every score is 0; rows that repeat get the
same result; an empty table gives an empty result; columns of the input that clash with the new ones give way.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from math import lgamma

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, byte_slices, encode_words, materialise, with_columns_schema

_EDGE = b".,;:!?\"'()[]{}*_-#$%&|<>"


def maximal_segments(scores: list[tuple[int, float]], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments of a sequence that scores -drift but at the given (place, score > 0): first place,
    last place, score. Linear: each candidate is merged once."""
    left: list[float] = []
    right: list[float] = []
    spans: list[tuple[int, int]] = []
    lower: list[int] = []  # the last earlier candidate with a smaller left sum
    total, last = 0.0, -1
    for place, s in scores:
        total -= drift * (place - last - 1)
        lo, total, last = total, total + s, place
        start = place
        while True:
            j = len(spans) - 1
            while j >= 0 and left[j] >= lo:
                j = lower[j]
            if j < 0 or right[j] >= total:
                left.append(lo)
                right.append(total)
                spans.append((start, place))
                lower.append(j)
                break
            lo, start = left[j], spans[j][0]
            del left[j:], right[j:], spans[j:], lower[j:]
    return [(a, b, r - lo) for (a, b), lo, r in zip(spans, left, right, strict=True)]


def normalise(words: list[bytes]) -> list[bytes]:
    return [w.strip(_EDGE) or w for w in words]


def best_chance(bits: float) -> float:
    """-ln of the chance that a text's best segment has so many bits or more."""
    return bits if bits > 30 else float(-np.log(-np.expm1(-np.exp(-bits))))


def sum_chance(bits: list[float]) -> float:
    """-ln of the chance that r segments have so many bits in all or more, e^-t t^(r-1) / (r! (r-1)!); at least 0."""
    t, r = sum(bits), len(bits)
    return max(0.0, t - (r - 1) * np.log(t) + lgamma(r + 1) + lgamma(r)) if r else 0.0


def fit_k(x: np.ndarray, words: np.ndarray) -> float:
    """K by maximum likelihood of the best segments: x is lambda S of each text, 0 for a text without a segment."""
    return max(float((x > 0).sum()), 1.0) / max(float(np.sum(words * np.exp(-x))), 1e-9)


def background_k(values: np.ndarray, p: np.ndarray, drift: float, lam: float, texts: int = 4000, words: int = 200, seed: int = 1) -> float:
    """K of texts whose words score values with chances p, and -drift else; of drawn texts, the same in every run."""
    rng = np.random.Generator(np.random.PCG64(seed))
    x = np.zeros(texts)
    hits = rng.random((texts, words)) < p.sum()
    for k in np.flatnonzero(hits.any(1)).tolist():
        at = np.flatnonzero(hits[k])
        drawn = values[rng.choice(len(values), len(at), p=p / p.sum())]
        x[k] = lam * max(s for *_, s in maximal_segments(list(zip(at.tolist(), drawn.tolist(), strict=True)), drift))
    return fit_k(x, np.full(texts, float(words)))


@dataclass
class ToxicModel:
    words: dict[bytes, float] = field(default_factory=dict)
    drift: float = 0.5
    lam: float = 1.0
    k: float = 1.0
    max_e: float = 0.5
    weights: tuple[float, ...] = (-50.0, 0.0, 0.0)

    def segments(self, texts: list[bytes]) -> tuple[np.ndarray, dict[int, list[tuple[int, int, float]]]]:
        """Words of each text, and the maximal segments of those that have any."""
        codes, lens, words = encode_words(texts)
        value = np.fromiter((self.words.get(w, 0.0) for w in normalise(words)), float, len(words))
        hits = np.flatnonzero(value[codes] > 0) if len(words) else np.zeros(0, int)
        ends = np.cumsum(lens)
        doc = np.searchsorted(ends, hits, "right")
        found: dict[int, list[tuple[int, int, float]]] = {}
        cuts = np.searchsorted(doc, np.arange(len(texts) + 1))
        for d in np.unique(doc).tolist():
            at = hits[cuts[d] : cuts[d + 1]]
            first = ends[d] - lens[d]
            found[d] = maximal_segments(list(zip((at - first).tolist(), value[codes[at]].tolist(), strict=True)), self.drift)
        return lens, found

    def features(self, texts: list[bytes]) -> tuple[np.ndarray, list[list[tuple[int, int, float]]]]:
        """For each text -ln of the two chances, on a log scale (a text made of insults must not set the scale); and the
        significant segments."""
        lens, segments = self.segments(texts)
        out, significant = np.zeros((len(texts), 2)), [[] for _ in texts]
        for d, found in segments.items():
            bits = [self.lam * s - np.log(self.k * lens[d]) for _, _, s in found]
            significant[d] = [x for x, e in zip(found, bits, strict=True) if np.exp(-e) < self.max_e]
            out[d] = np.log1p(best_chance(max(bits))), np.log1p(sum_chance([e for e in bits if e > 0]))
        return out, significant

    def score(self, features: np.ndarray) -> np.ndarray:
        w = np.array(self.weights)
        return 1 / (1 + np.exp(-np.clip(w[0] + features @ w[1:], -60, 60)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton steps with a small ridge; columns are scaled first."""
    scale = np.maximum(np.abs(x).max(0), 1e-9)
    a = np.column_stack([np.ones(len(x)), x / scale])
    w = np.zeros(a.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w))
        step = np.linalg.solve(h, a.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return np.concatenate([w[:1], w[1:] / scale])


def karlin_lambda(scores: np.ndarray, p: np.ndarray) -> float:
    """The positive root of sum p exp(lambda s) = 1."""
    lo, hi = 1e-6, 1.0
    f = lambda x: float(np.sum(p * np.exp(np.clip(x * scores, -700, 700))) - 1)
    while f(hi) < 0 and hi < 64:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return min(hi, 4.0)


def learn_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_labelled: int = 12_000, min_z: float = 3.0, prior_share: float = 0.05, drift: float = 0.5) -> ToxicModel:
    """labels: id, label 0/1, only rows that may be learned from. Word counts are made by the executors; the driver gets
    the clearly marked words of at most max_labelled texts, and one row of features for each of these. Of rows that share a
    labelled id, the first text in byte order counts, so rows that repeat cannot pass the bound."""
    spark = docs.sparkSession
    pick = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("int").alias("__y"))
    # a share that gives 95 % of max_labelled, so that it is not passed; a sorted limit would send that many rows of every partition
    n = pick.count()
    pick = pick.filter(F.pmod(F.xxhash64("__id", F.lit(9)), F.lit(1 << 30)) * F.lit(float(n)) < 0.95 * max_labelled * (1 << 30)) if n > max_labelled else pick
    chosen = spark.createDataFrame(pick.collect(), "__id long, __y int")
    sample = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "__id")
    sample = materialise(sample.groupBy("__id", "__y").agg(F.min("text").alias("text")).select("text", "__y"), "toxic-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in byte_slices(batches, "text"):
            y = part.column(1).to_numpy(zero_copy_only=False)
            codes, lens, words = encode_words(texts)
            toxic = np.bincount(codes, weights=np.repeat(y, lens), minlength=len(words)).astype(np.int64) if len(words) else np.zeros(0, np.int64)
            every = np.bincount(codes, minlength=len(words)) if len(words) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([w.decode("utf-8", "replace") for w in normalise(words)], pa.string()), pa.array(toxic), pa.array(every - toxic)], names=["word", "c1", "c0"])

    counts = materialise(sample.mapInArrow(count, "word string, c1 long, c0 long").groupBy("word").agg(F.sum("c1").alias("c1"), F.sum("c0").alias("c0")), "toxic-words")
    n1, n0 = (int(x or 0) for x in counts.agg(F.sum("c1"), F.sum("c0")).first())
    if not n1 or not n0:
        return ToxicModel()
    prior = prior_share * (n1 + n0)
    a = F.col("c1") + F.col("c0") + F.lit(0.0)
    alpha = F.lit(prior / (n1 + n0)) * a
    odds = lambda c, n: F.log((F.col(c) + alpha) / (F.lit(n + prior) - F.col(c) - alpha))
    delta = odds("c1", n1) - odds("c0", n0)
    z = delta / F.sqrt(1 / (F.col("c1") + alpha) + 1 / (F.col("c0") + alpha))
    top = counts.withColumn("delta", delta).withColumn("z", z).filter((F.col("z") >= min_z) & (F.col("delta") > 1.0)).toPandas().sort_values("word")
    words = {w.encode(): float(s) for w, s in zip(top["word"], top["delta"], strict=True)}
    p = (top["c0"].to_numpy(float) + prior * (top["c0"] + top["c1"]).to_numpy(float) / (n0 + n1)) / (n0 + prior)
    lam = karlin_lambda(np.concatenate([top["delta"].to_numpy(float), [-drift]]), np.concatenate([p, [max(0.0, 1 - p.sum())]]))
    k = background_k(top["delta"].to_numpy(float), p, drift, lam) if len(top) else 1.0
    model = ToxicModel(words, drift, lam, k)
    fitted = spark.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in byte_slices(batches, "text"):
            x, _ = fitted.value.features(texts)
            yield pa.RecordBatch.from_arrays([part.column(1), pa.array(x[:, 0]), pa.array(x[:, 1])], names=["y", "a", "b"])

    rows = sample.mapInArrow(measure, "y int, a double, b double").toPandas()  # bounded by max_labelled
    rows = rows.sort_values(["y", "a", "b"])
    model.weights = tuple(_logistic(rows[["a", "b"]].to_numpy(float), rows["y"].to_numpy(float)).tolist())
    return model


def score_toxicity(docs: DataFrame, model: ToxicModel, text_col: str = "text") -> DataFrame:
    """docs with score double, predicted int and passages (first and last word, bits) of the significant segments."""
    passages = T.ArrayType(T.StructType([T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()), T.StructField("score", T.DoubleType())]))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("first_word", pa.int64()), ("last_word", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in byte_slices(batches, text_col):
            x, found = shared.value.features(texts)
            s = shared.value.score(x)
            spans = pa.array([[{"first_word": a, "last_word": b, "score": v} for a, b, v in f] for f in found], kind)
            yield append_columns(part, score=pa.array(s), predicted=pa.array((s >= 0.5).astype(np.int32)), passages=spans)

    return docs.mapInArrow(run, with_columns_schema(docs, score=T.DoubleType(), predicted=T.IntegerType(), passages=passages))
