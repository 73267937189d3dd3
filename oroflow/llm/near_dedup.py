"""Near-duplicate classes by improved consistent weighted sampling over TF-IDF shingles, banded and verified.

A text's shingles are its runs of five words (A-Z in lower case; a shorter text is one shingle). A shingle weighs its
count in the text times its inverse document frequency, estimated as the mean of its words', on a scale of quarter
octaves. Document frequencies are exact over all texts. The inverse saturates: a word in a share of `idf_share` of the
texts or less counts as in that share, at every size of the corpus. So the words that need a number of their own are
fewer than the mean number of different words of a text over idf_share, however large the vocabulary is.
Each of bands * rows sampling functions picks a shingle by Ioffe's scheme (Gamma, Gamma, uniform variates drawn from a
fixed pool by a hash of the shingle); texts whose picks agree in all rows of a band are candidates. A candidate pair is
a link where the exact weighted Jaccard similarity, sum of the smaller over sum of the larger weights, is at least
`threshold`; classes are the connected components of links.

Exact copies (equal word sequences) are folded into one node first. In a bucket of `all_pairs` nodes or fewer all pairs
are verified. In a larger one (a family of copies) every node is held against the bucket's most central node, the one
with the most company over all its buckets, which is the text that the others were made from, and against one chosen by
a hash. Nodes that neither reached go on in rounds: the most central of them is the next one to be held against, for as
long as the bucket's last round linked anything. Where the nodes of a large bucket are then still in different classes,
every pair of them that can be a link is verified: those that share a shingle of their prefixes (see _verify_rest), which
is exact. So a family that its centres unite costs about its size, and texts that only share a passage meet by what else
they share; no candidate pair is left out. For a pair at similarity 0.8 the chance to share no band is 7e-5 (24 bands of 5
rows); it falls steeply above.

Defined results: null counts as the empty text; texts without a word form one class; rows that repeat fall into the
class of their text; the class id is the smallest id in it (null where it has none); rows that share an id are told apart
by their texts; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, encode_words, hash_words, materialise, mix64, spread_join

SHINGLE = 5
POOL_BITS = 11
LEVELS = 40  # quarter octaves of weight, from 2^0, whose picks are tabulated
MOST = 255  # the highest level: 2^63 is more than any text can reach
CACHED = 1 << 15  # shingles signed at a time
ORDER_SLOTS = 1 << 20  # places that count shingles for an order of them: 4 MB
_KEYS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


@dataclass
class Sampler:
    """Frozen variates: picks[h, level, p] are the ordered bits of ln a for weight level and pool place p; those of levels
    from LEVELS on are made from variates[:, h, p] when a text has them."""

    picks: np.ndarray
    variates: np.ndarray
    factors: np.ndarray
    bands: int
    rows: int

    @classmethod
    def draw(cls, bands: int, rows: int, seed: int = 1) -> Sampler:
        rng = np.random.Generator(np.random.PCG64(seed))
        n, pool = bands * rows, 1 << POOL_BITS
        r, c, beta = rng.gamma(2, 1, (n, 1, pool)), rng.gamma(2, 1, (n, 1, pool)), rng.random((n, 1, pool))
        picks = np.empty((n, LEVELS, pool), np.uint32)
        for i in range(n):  # the driver draws: all at once would take seven times the table
            picks[i] = ordered_picks(r[i], c[i], beta[i], np.arange(LEVELS)[:, None])
        return cls(picks.reshape(n, LEVELS * pool), np.stack([r[:, 0], c[:, 0], beta[:, 0]]), rng.integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), bands, rows)

    def band_keys(self, shingles: np.ndarray, levels: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """For each text with a shingle, bands 64-bit keys. shingles: distinct in each text. Some texts at a time, so that
        what each sampling function reads and writes stays in a core's cache."""
        ends = np.cumsum(lens)
        cuts = np.unique(np.minimum(np.searchsorted(ends, np.arange(CACHED, ends[-1] + CACHED, CACHED)) + 1, len(lens))) if len(lens) else []
        out, at = [np.empty((0, self.bands), np.uint64)], 0
        for to in cuts:
            part = slice(ends[at] - lens[at], ends[to - 1])
            out.append(self._band_keys(shingles[part], levels[part], lens[at:to]))
            at = to
        return np.concatenate(out)

    def _band_keys(self, shingles: np.ndarray, levels: np.ndarray, lens: np.ndarray) -> np.ndarray:
        starts = np.cumsum(lens) - lens
        place = np.minimum(levels, LEVELS - 1).astype(np.int64) << POOL_BITS
        heavy = np.flatnonzero(levels >= LEVELS)
        out = np.empty((len(lens), self.bands), np.uint64)
        for band in range(self.bands):
            key = np.full(len(lens), band + 1, np.uint64)
            for i in range(band * self.rows, (band + 1) * self.rows):
                x = shingles * self.factors[i]
                at = (x >> np.uint64(64 - POOL_BITS)).astype(np.int64)
                pick = self.picks[i][place + at].astype(np.uint64)
                if len(heavy):
                    pick[heavy] = ordered_picks(*self.variates[:, i, at[heavy]], levels[heavy])
                pick <<= np.uint64(32)
                pick |= x & np.uint64(0xFFFFFFFF)
                key = mix64(key ^ np.minimum.reduceat(pick, starts)) * np.uint64(0x9E3779B97F4A7C15)
            out[:, band] = key
        return out


def level_weight(level: np.ndarray) -> np.ndarray:
    return np.exp2(np.asarray(level, float) / 4)


def ordered_picks(r: np.ndarray, c: np.ndarray, beta: np.ndarray, level: np.ndarray) -> np.ndarray:
    t = np.floor(np.log(level_weight(level)) / r + beta)
    ln_a = np.log(c) - r * (t - beta + 1)
    return (ln_a + 4096.0).astype(np.float32).view(np.uint32)  # positive floats order like their bits


@dataclass
class Idf:
    hashes: np.ndarray  # ascending
    values: np.ndarray
    rare: float

    def of(self, h: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.full(len(h), self.rare)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.values[at], self.rare)


def weighted_shingles(texts: list[bytes], idf: Idf) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text in turn, their weight levels, and how many each text has."""
    codes, lens, words = encode_words(texts)
    if not len(codes):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint8), np.zeros(len(texts), np.int64)
    h = hash_words(words)
    value = idf.of(h)[codes]
    h = mix64(h)[codes]
    n = len(codes)
    pad = np.concatenate([h, np.zeros(SHINGLE, np.uint64)])
    idfs = np.concatenate([value, np.zeros(SHINGLE)])
    starts = np.cumsum(lens) - lens
    doc = np.repeat(np.arange(len(lens)), lens)
    left = (starts + lens)[doc] - np.arange(n)  # words from here to the text's end
    width = np.minimum(left, SHINGLE)
    s, w = np.zeros(n, np.uint64), np.zeros(n)
    for k in range(SHINGLE):
        there = width > k
        s += np.where(there, pad[k : n + k] * _KEYS[k], np.uint64(0))
        w += np.where(there, idfs[k : n + k], 0.0)
    whole = (left >= SHINGLE) | ((np.arange(n) == starts[doc]) & (lens[doc] < SHINGLE))
    s, w, doc = mix64(s[whole]), (w / width)[whole], doc[whole]
    both = s ^ mix64(doc.astype(np.uint64) + np.uint64(1))
    _, first, count = np.unique(both, return_index=True, return_counts=True)
    order = np.argsort(first)
    first, count = first[order], count[order]
    level = np.clip(np.rint(4 * np.log2(np.maximum(w[first] * count, 1.0))), 0, MOST).astype(np.uint8)
    return s[first], level, np.bincount(doc[first], minlength=len(texts))


def pack_vector(s: np.ndarray, level: np.ndarray) -> bytes:
    order = np.argsort(s)
    return s[order].tobytes() + level[order].tobytes()


def weighted_jaccard(a: bytes, b: bytes) -> float:
    n, m = len(a) // 9, len(b) // 9
    _, i, j = np.intersect1d(np.frombuffer(a, np.uint64, n), np.frombuffer(b, np.uint64, m), assume_unique=True, return_indices=True)
    wa, wb = level_weight(np.frombuffer(a, np.uint8, n, 8 * n)), level_weight(np.frombuffer(b, np.uint8, m, 8 * m))
    common = float(np.minimum(wa[i], wb[j]).sum())
    union = float(wa.sum() + wb.sum()) - common
    return common / union if union else 1.0


def order_slots(s: np.ndarray) -> np.ndarray:
    return (s % np.uint64(ORDER_SLOTS)).astype(np.int64)


# ---------------------------------------------------------------- distributed parts

def learn_idf(docs: DataFrame, idf_share: float = 1e-4) -> Idf:
    """docs: text. Document frequencies of all words are counted; the driver gets those in more than idf_share of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in byte_slices(batches, "text"):
            codes, lens, words = encode_words(texts)
            pairs = np.unique(np.repeat(np.arange(len(texts)), lens) * max(1, len(words)) + codes)
            df = np.bincount(pairs % max(1, len(words)), minlength=len(words))
            yield pa.RecordBatch.from_arrays([pa.array(hash_words(words).view(np.int64)), pa.array(df.astype(np.int64))], names=["h", "df"])

    n = docs.count()
    counts = docs.mapInArrow(run, "h long, df long").groupBy("h").agg(F.sum("df").alias("df"))
    top = materialise(counts.filter(F.col("df") > idf_share * n), "near-df").toPandas()
    h, df = top["h"].to_numpy(np.int64).view(np.uint64), top["df"].to_numpy(float)
    order = np.argsort(h)
    return Idf(h[order], np.log1p(n / df[order]), float(np.log1p(min(max(n, 1), 1 / idf_share))))


def components(links: DataFrame) -> DataFrame:
    """links: a, b (long). node, comp (the smallest node linked to it). Smallest labels go to the neighbours and then
    jump to their label's label, so long chains take few rounds; each round is written down."""
    both = materialise(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "near-links")
    first = materialise(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")), "near-labels")
    labels, degrees = first.select("node", F.least("node", "m").alias("comp")), first.select(F.col("node").alias("b"), "n")
    while True:
        seen = spread_join(both, labels.select(F.col("node").alias("b"), F.col("comp").alias("cb")), "b", counts=degrees).groupBy(F.col("a").alias("node")).agg(F.min("cb").alias("m"))
        near = materialise(labels.join(seen, "node").select("node", F.col("comp").alias("old"), F.least("comp", "m").alias("comp")), "near-least")
        up = labels.select(F.col("node").alias("comp"), F.col("comp").alias("top"))
        now = materialise(spread_join(near, up, "comp").select("node", "old", F.least("comp", "top").alias("comp")), "near-labels")
        labels = now.select("node", "comp")
        if now.filter("old != comp").isEmpty():
            return labels


def _verify(pairs: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """pairs: a, b. Those that are links, with their similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = [weighted_jaccard(x, y) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float64())], names=["a", "b", "similarity"])
            yield out.filter(pa.array([x >= threshold for x in s], pa.bool_()))

    # a centre's pairs are dealt apart, at either end, before any vector stands beside them
    n = pairs.count()
    left = spread_join(pairs, vectors.select(F.col("node").alias("a"), F.col("vector").alias("va")), "a", rows=n)
    full = spread_join(left, vectors.select(F.col("node").alias("b"), F.col("vector").alias("vb")), "b", counts=pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n")), rows=n, deal="a").select("a", "b", "va", "vb")
    return full.mapInArrow(run, "a long, b long, similarity double")


def _verify_rest(large: DataFrame, comps: DataFrame, pairs: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """large: key, node of the large buckets; pairs: a, b, verified already. Links between nodes of different comps, among
    all nodes of the buckets that hold more than one. Two texts can only be a link if they share a shingle of both prefixes:
    in an order from the rarest shingle to the most frequent one, the prefix of the heavier text goes as far as what follows
    still weighs t = `threshold` of the text, that of the lighter one as far as it still weighs 2 t / (1 + t). So texts meet
    by the rarest part of what they have in common, not by a shared passage. Any order that all texts share gives the same
    links; this one counts shingles by ORDER_SLOTS hashed places, a table of fixed size that goes to all tasks."""
    spark = large.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(ORDER_SLOTS, np.int64)
        for batch in batches:
            for v in batch.column(0).to_pylist():
                np.add.at(total, order_slots(np.frombuffer(v, np.uint64, len(v) // 9)), 1)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int64)), pa.array(total[used])], names=["slot", "n"])

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        for batch in batches:
            for node, comp, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n = len(v) // 9
                s, w = np.frombuffer(v, np.uint64, n), level_weight(np.frombuffer(v, np.uint8, n, 8 * n))
                df = often[order_slots(s)]
                order = np.lexsort((s, df))[::-1]
                rest, total = np.cumsum(w[order]), float(w.sum())
                order, rest = (x[(df[order] > 1) & (rest >= (threshold - 1e-9) * total)] for x in (order, rest))
                short = rest >= (2 * threshold / (1 + threshold) - 1e-9) * total
                columns = [s[order].view(np.int64), short, np.full(len(order), node), np.full(len(order), comp), np.full(len(order), total), rest]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["s", "short", "node", "comp", "total", "rest"])

    at = materialise(large.join(comps, "node", "left").select("key", "node", F.coalesce("comp", "node").alias("comp")), "near-placed")
    sizes = at.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("c"))
    open_ = materialise(sizes.filter("c > 1").select("key", "n"), "near-open")
    wanted = materialise(spread_join(at, open_.select("key"), "key", counts=open_).select("node", "comp").distinct(), "near-open-nodes")
    held = materialise(wanted.join(vectors, "node").select("node", "comp", "vector"), "near-open-vectors")
    counts = held.select("vector").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    often = np.zeros(ORDER_SLOTS, np.uint32)
    often[counts["slot"].to_numpy()] = np.minimum(counts["n"].to_numpy(), (1 << 32) - 1)
    shared = spark.sparkContext.broadcast(often)
    prefix = materialise(held.mapInArrow(prefixes, "s long, short boolean, node long, comp long, total double, rest double"), "near-prefixes")
    side = lambda x: prefix.select("s", "short", *[F.col(c).alias(f"{c}_{x}") for c in ("node", "comp", "total", "rest")])
    lighter = (F.col("total_a") < F.col("total_b")) | ((F.col("total_a") == F.col("total_b")) & (F.col("node_a") < F.col("node_b")))
    # from the first shingle that they share onwards, either text must hold as much as a link has in common
    near = F.least("rest_a", "rest_b") >= (threshold / (1 + threshold) - 1e-9) * (F.col("total_a") + F.col("total_b"))
    met = side("a").filter("short").drop("short").join(side("b").drop("short"), "s").filter(lighter & (F.col("comp_a") != F.col("comp_b")) & near)
    new = met.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti")
    return _verify(materialise(new, "near-rest-pairs"), vectors, threshold)


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, bands: int = 24, rows: int = 5, idf_share: float = 1e-4, all_pairs: int = 24) -> DataFrame:
    """One row for each row of docs: row_id, class_id, class_size, kept (it has the class id, and of rows with that id the
    text that stays), mark (a hash of its text)."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("row_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = texts.withColumn("mark", F.xxhash64("text"))  # beside the id, so that rows without one are not all one key
    shared = spark.sparkContext.broadcast((learn_idf(texts.select("text"), idf_share), Sampler.draw(bands, rows)))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, sampler = shared.value
        for part, slice_ in byte_slices(batches, "text", 1 << 20):
            s, level, lens = weighted_shingles(slice_, idf)
            keys = np.zeros((len(slice_), bands), np.uint64)
            if (lens > 0).any():
                keys[lens > 0] = sampler.band_keys(s, level, lens[lens > 0])
            at = pa.array((np.concatenate([[0], np.cumsum((lens > 0) * bands)])).astype(np.int32))
            flat = pa.ListArray.from_arrays(at, pa.array(keys[lens > 0].ravel().view(np.int64)))
            digests = pa.array([xxhash.xxh3_128_digest(b" ".join(t.lower().split())) for t in slice_], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), digests, flat], names=["row_id", "mark", "digest", "bands"])

    signed = materialise(texts.mapInArrow(sign, "row_id long, mark long, digest binary, bands array<long>"), "near-signed")
    first = F.min(F.struct(F.col("row_id").isNull().alias("none"), "row_id", "mark"))
    nodes = signed.groupBy("digest").agg(first.alias("x"), F.count(F.lit(1)).alias("n"), F.first("bands").alias("bands"))
    nodes = nodes.select("digest", F.col("x.row_id").alias("rep_id"), F.col("x.mark").alias("rep_mark"), "n", "bands")
    nodes = materialise(nodes.withColumn("node", F.monotonically_increasing_id()), "near-nodes")
    keyed = nodes.select("node", F.explode("bands").alias("key"))
    sizes = materialise(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1"), "near-buckets")
    members = materialise(spread_join(keyed, sizes, "key", counts=sizes.select("key", F.col("m").alias("n"))), "near-members")
    small, large = members.filter(F.col("m") <= all_pairs), members.filter(F.col("m") > all_pairs)
    one = small.select("key", F.col("node").alias("a"))
    pairs = one.join(small.select("key", F.col("node").alias("b")), "key").filter("a < b").select("a", "b")
    company = members.groupBy("node").agg(F.sum("m").alias("company"))
    tie = F.pmod(F.xxhash64("node"), F.lit(1 << 20)) / float(1 << 21)
    rest = materialise(large.join(company, "node").select("key", "node", (F.col("company") + tie).alias("central")), "near-large")
    first = rest.groupBy("key").agg(F.max_by("node", "central").alias("r"), F.min_by("node", F.xxhash64("node", "key")).alias("r2"))
    large_sizes = sizes.filter(F.col("m") > all_pairs).select("key", F.col("m").alias("n"))
    rest = materialise(spread_join(rest, first, "key", counts=large_sizes), "near-rest")
    star = rest.select("node", F.explode(F.array("r", "r2")).alias("r")).filter("node != r")
    pairs = materialise(pairs.unionByName(star.select(F.least("node", "r").alias("a"), F.greatest("node", "r").alias("b"))).distinct(), "near-pairs")

    def vectors_of(wanted: DataFrame) -> DataFrame:
        """node, vector of the wanted nodes: their texts are fetched by id and known again by digest."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            idf = shared.value[0]
            for part, slice_ in byte_slices(batches, "text", 1 << 20):
                keep = [xxhash.xxh3_128_digest(b" ".join(t.lower().split())) == d for t, d in zip(slice_, part.column(1).to_pylist(), strict=True)]
                s, level, lens = weighted_shingles(slice_, idf)
                ends = np.cumsum(lens)
                packed = [pack_vector(s[e - n : e], level[e - n : e]) for e, n in zip(ends, lens, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(packed, pa.binary())], names=["node", "vector"]).filter(pa.array(keep, pa.bool_()))

        at = nodes.join(wanted, "node", "left_semi").select("node", "digest", "rep_id", "rep_mark")
        found = texts.join(at, F.col("row_id").eqNullSafe(F.col("rep_id")) & (F.col("mark") == F.col("rep_mark"))).select("node", "digest", "text")
        return found.mapInArrow(run, "node long, vector binary")

    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    vectors = materialise(vectors_of(ends).dropDuplicates(["node"]), "near-vectors")
    links = materialise(_verify(pairs, vectors, threshold), "near-verified")
    comps = components(links)
    rest = rest.select("key", "node", "central", "r")
    while not rest.isEmpty():
        at = materialise(rest.join(comps, "node", "left").select("key", "node", "central", "r", F.coalesce("comp", "node").alias("comp")), "near-at")
        # the last centre's component goes; a bucket goes on if its last round linked anything
        centre = at.filter("node = r").select("key", F.col("comp").alias("main"))
        left = materialise(spread_join(at, centre, "key").withColumn("out", F.col("comp") != F.col("main")), "near-left")
        found = left.groupBy("key").agg(F.count_if(~F.col("out")).alias("k"), F.max_by("node", F.when(F.col("out"), F.col("central"))).alias("next")).filter("k > 1 and next is not null")
        rest = materialise(spread_join(left.filter("out"), found, "key").select("key", "node", "central", F.col("next").alias("r")), "near-rest")
        more = rest.filter("node != r").select(F.least("node", "r").alias("a"), F.greatest("node", "r").alias("b")).distinct()
        more = materialise(more.join(pairs, ["a", "b"], "left_anti"), "near-more")
        new = materialise(_verify(more, vectors, threshold), "near-verified")
        pairs = materialise(pairs.unionByName(more), "near-pairs")
        if not new.isEmpty():
            links = materialise(links.unionByName(new), "near-links-all")
            comps = components(links)
    new = materialise(_verify_rest(large.select("key", "node"), comps, pairs, vectors, threshold), "near-verified")
    if not new.isEmpty():
        comps = components(materialise(links.unionByName(new), "near-links-all"))
    classed = materialise(nodes.join(comps, "node", "left").select("digest", "rep_id", "rep_mark", "n", F.coalesce("comp", "node").alias("comp")), "near-classes")
    least = F.min(F.struct(F.col("rep_id").isNull().alias("none"), "rep_id", "rep_mark"))
    classes = classed.groupBy("comp").agg(least.alias("x"), F.sum("n").alias("class_size")).select("comp", F.col("x.rep_id").alias("class_id"), F.col("x.rep_mark").alias("class_mark"), "class_size")
    by_digest = spread_join(classed.select("digest", "comp"), classes, "comp").drop("comp")
    at = spread_join(signed.select("row_id", "mark", "digest"), by_digest, "digest", counts=classed.select("digest", "n"))
    shared.destroy()  # what is left to do reads written tables only; else the driver keeps the table until it collects its garbage
    return at.select("row_id", "class_id", "class_size", (F.col("row_id").eqNullSafe(F.col("class_id")) & (F.col("mark") == F.col("class_mark"))).alias("kept"), "mark")
