"""Phrase collocation mining: pieces with multiplicities, n-grams sieved and counted by hash bucket, parts looked up by
shuffled requests.

1. Texts are cut into pieces; identical pieces of a group (a language) become one row with a multiplicity. Pieces are
   packed into chunks of bounded size, the unit of all later work.
2. Sieve: every chunk asks the hash bucket of each of its distinct word pairs for the pair's weight in the whole corpus
   (64-bit hashes, packed). Buckets answer which hashes reach `least`; answers go back to the chunks that asked. Two pairs
   that share a hash only let more through; none that reaches the bound is lost, as every part of a frequent phrase is
   itself frequent.
3. Chunks write the distinct phrases whose pairs all passed, with weights, and all words. DuckDB counts them exactly, one
   hash bucket at a time, out of core (bounded memory, then the task's own temporary folder, removed at its end).
4. Each cut of a candidate sends two lookup requests, shuffled to the counts of its parts; frequent parts are dealt to
   salts. Longer candidates tell their sub-phrases how frequent they are in the same manner.

Defined results: a null text has no pieces; a null group is `und` (and is one with a group of that name); words are
compared byte by byte after lower-casing A-Z; equal scores and frequencies are ordered by the phrase's UTF-8 bytes; cuts
of equal score by the shorter first part; repeated rows count each; an empty table gives no rows; other columns, whatever
their names, are not read.
"""

from __future__ import annotations

import shutil
import tempfile
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import UPPER, hash_words, materialise, mix64, spread_join

#: What separates pieces, as a pattern of Java and Python; a full stop is a word of its own between the pieces of a chunk.
PIECE_END = r"[.,;:!?\x0A-\x0D]"
_STOP = b"."


def pieces(docs: DataFrame, text_col: str = "text", group_col: str = "lang") -> DataFrame:
    """Distinct pieces of each group with their multiplicity: grp, piece, m."""
    lowered = F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, UPPER.lower())
    rows = docs.select(F.coalesce(F.col(group_col).cast("string"), F.lit("und")).alias("grp"), F.explode(F.split(lowered, PIECE_END)).alias("piece"))
    rows = rows.select("grp", F.btrim("piece", F.lit(" \t")).alias("piece")).filter("piece <> ''")
    return rows.groupBy("grp", "piece").agg(F.count(F.lit(1)).alias("m"))


def _chunks(rows: DataFrame, chunk_bytes: int) -> DataFrame:
    """Pieces packed into chunks of one group and about chunk_bytes at most: chunk, grp, size, words, weights."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, weights, sizes = defaultdict(list), defaultdict(list), defaultdict(int)

        def flush(g: str) -> pa.RecordBatch:
            blob = b" . ".join(texts.pop(g))
            m = np.concatenate(weights.pop(g)).astype(np.int64).tobytes()
            return pa.RecordBatch.from_pydict({"grp": [g], "size": [sizes.pop(g)], "words": [blob], "weights": [m]}, schema=schema)

        for batch in batches:
            groups = batch.column(0).dictionary_encode()
            codes = groups.indices.to_numpy(zero_copy_only=False)
            lines, m = batch.column(1).cast(pa.binary()), batch.column(2).to_numpy()
            for code, g in enumerate(groups.dictionary.to_pylist()):
                at = np.flatnonzero(codes == code)
                own = lines.take(pa.array(at)).to_pylist()
                texts[g] += own
                weights[g].append(m[at])
                sizes[g] += sum(map(len, own))
                if sizes[g] >= chunk_bytes:
                    yield flush(g)
            while sum(sizes.values()) > 4 * chunk_bytes:
                yield flush(max(sizes, key=sizes.get))
        for g in list(texts):
            yield flush(g)

    schema = pa.schema([("grp", pa.string()), ("size", pa.int64()), ("words", pa.binary()), ("weights", pa.binary())])
    packed = rows.select("grp", "piece", "m").mapInArrow(pack, "grp string, size long, words binary, weights binary")
    return packed.withColumn("chunk", F.monotonically_increasing_id())  # written before it is used, so the ids stay


def _tokens(words: bytes, weights: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray, int]:
    """Distinct words of a chunk, the codes of all in order, their weights, and the code of the stop between pieces."""
    flat = words.split()
    distinct = list(dict.fromkeys(flat))
    codes = dict(zip(distinct, range(len(distinct)), strict=True))
    ids = np.fromiter(map(codes.__getitem__, flat), np.int64, len(flat))
    stop = codes.get(_STOP, -1)
    weight = np.frombuffer(weights, np.int64)[np.cumsum(ids == stop)]
    return distinct, ids, weight, stop


def _sums(keys: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the place of each row's key among them, and their whole weights."""
    distinct, place = np.unique(keys, return_inverse=True)
    order = np.argsort(place, kind="stable")
    starts = np.searchsorted(place[order], np.arange(len(distinct)))
    return distinct, place, np.add.reduceat(weight[order], starts) if len(starts) else np.zeros(0, np.int64)


def _pairs(grp: str, distinct: list[bytes], ids: np.ndarray, weight: np.ndarray, stop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions at which a pair of words starts, the place of each among the distinct pairs, and these' hashes, weights."""
    at = np.flatnonzero((ids[:-1] != stop) & (ids[1:] != stop))
    size = len(distinct)
    keys, place, total = _sums(ids[at] * size + ids[at + 1], weight[at])
    hashes = hash_words(distinct)
    seed = hash_words([grp.encode()])[0]
    return at, place, mix64(mix64(hashes[keys // size] ^ seed) + hashes[keys % size]), total


def _ask(chunks: DataFrame, buckets: int) -> DataFrame:
    """Lookup requests: of each chunk and bucket, the hashes of pairs with weight 1 and those with more."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, grp, words, weights in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                _, _, hashes, total = _pairs(grp, *_tokens(words, weights))
                bucket = (hashes % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                bucket, hashes, total = bucket[order], hashes[order], total[order]
                found = np.unique(bucket)
                ends = np.searchsorted(bucket, found, "right")
                out: dict[str, list] = {"bucket": found.tolist(), "chunk": [chunk] * len(found), "once": [], "more": [], "counts": []}
                for a, b in zip([0, *ends[:-1]], ends, strict=True):
                    many = total[a:b] > 1
                    out["once"].append(hashes[a:b][~many].tobytes())
                    out["more"].append(hashes[a:b][many].tobytes())
                    out["counts"].append(total[a:b][many].tobytes())
                yield pa.RecordBatch.from_pydict(out, schema=schema)

    schema = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("once", pa.binary()), ("more", pa.binary()), ("counts", pa.binary())])
    return chunks.select("chunk", "grp", "words", "weights").mapInArrow(ask, "bucket long, chunk long, once binary, more binary, counts binary")


def _answer(requests: DataFrame, least: int) -> DataFrame:
    """For each chunk that asked: the hashes of its pairs whose whole weight is `least` or more."""

    def answer(asked: pa.Table) -> pa.Table:
        hashes, weights, froms, chunks = [], [], [], asked.column("chunk").to_pylist()
        for i, (once, more, counts) in enumerate(zip(*(asked.column(c).to_pylist() for c in ("once", "more", "counts")), strict=True)):
            h = np.concatenate([np.frombuffer(once, np.uint64), np.frombuffer(more, np.uint64)])
            hashes.append(h)
            weights.append(np.concatenate([np.ones(len(once) // 8, np.int64), np.frombuffer(counts, np.int64)]))
            froms.append(np.full(len(h), i, np.int32))
        h, origin = np.concatenate(hashes), np.concatenate(froms)
        _, place, total = _sums(h, np.concatenate(weights))
        kept = total[place] >= least
        h, origin = h[kept], origin[kept]
        ends = np.searchsorted(origin, np.arange(len(chunks) + 1))  # still in the order of the requests
        out = [(c, h[a:b].tobytes()) for c, a, b in zip(chunks, ends[:-1], ends[1:], strict=True) if b > a]
        return pa.table({"chunk": pa.array([c for c, _ in out], pa.int64()), "passed": pa.array([p for _, p in out], pa.binary())})

    return requests.groupBy("bucket").applyInArrow(answer, "chunk long, passed binary")


def _phrases(chunks: DataFrame, answers: DataFrame, max_words: int) -> DataFrame:
    """Distinct phrases of each chunk whose pairs all passed, all its words, and the empty phrase for all occurrences."""
    schema = pa.schema([("grp", pa.string()), ("phrase", pa.string()), ("n_words", pa.int32()), ("f", pa.int64())])

    def phrases(chunk: pa.Table, passed: pa.Table) -> pa.Table:
        if not chunk.num_rows:
            return schema.empty_table()
        grp, words, weights = (chunk.column(c)[0].as_py() for c in ("grp", "words", "weights"))
        known = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(p, np.uint64) for p in passed.column("passed").to_pylist())])
        tokens = _tokens(words, weights)
        distinct, ids, weight, stop = tokens
        total = np.bincount(ids, minlength=len(distinct)) if (weight == 1).all() else _sums(ids, weight)[2]
        texts = np.array([*distinct, b""], object)
        shown = np.flatnonzero(np.arange(len(distinct)) != stop)
        out = [(b"", 0, int(total[shown].sum())), *((texts[i], 1, int(total[i])) for i in shown)]
        at, place, hashes, _ = _pairs(grp, *tokens)
        through = np.isin(hashes, known)
        pair = np.full(len(ids), -1, np.int64)  # by the position of its first word
        pair[at] = np.where(through[place], place, -1)
        firsts = np.flatnonzero(pair >= 0)
        key = pair[firsts]
        for n in range(2, max_words + 1):
            if not len(firsts):
                break
            found, place, total = _sums(key, weight[firsts])
            one = np.zeros(len(found), np.int64)
            one[place] = firsts  # any occurrence
            spelled = [b" ".join(row) for row in texts[ids[one[:, None] + np.arange(n)]]]
            out += zip(spelled, [n] * len(found), total.tolist(), strict=True)
            longer = np.flatnonzero(np.append(pair, -1)[np.minimum(firsts + n - 1, len(pair))] >= 0)
            firsts, key = firsts[longer], place[longer] * (len(hashes) + 1) + pair[firsts[longer] + n - 1]
        spelled, sizes, totals = zip(*out, strict=True)
        return pa.table({"grp": pa.array([grp] * len(out)), "phrase": pa.array(spelled, pa.binary()).cast(pa.string()), "n_words": pa.array(sizes, pa.int32()), "f": pa.array(totals, pa.int64())})

    both = chunks.select("chunk", "grp", "words", "weights").groupBy("chunk").cogroup(answers.groupBy("chunk"))
    return both.applyInArrow(phrases, "grp string, phrase string, n_words int, f long")


def _count(phrases: DataFrame, buckets: int, least: int, memory: str) -> DataFrame:
    """Whole frequencies of phrases, those of `least` or more, and of the empty phrase; each partition is a hash bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        folder = tempfile.mkdtemp(prefix="oroflow-count-")
        try:
            with duckdb.connect(config={"threads": 1, "memory_limit": memory, "temp_directory": folder, "preserve_insertion_order": False}) as db:
                rows = pa.RecordBatchReader.from_batches(schema, batches)  # noqa: F841, read by name below
                sums = db.sql(f"SELECT grp, phrase, n_words, CAST(sum(f) AS BIGINT) AS f FROM rows GROUP BY ALL HAVING sum(f) >= {int(least)} OR n_words = 0")
                for batch in sums.fetch_arrow_reader(100_000):
                    yield batch.cast(schema)
        finally:
            shutil.rmtree(folder, ignore_errors=True)

    schema = pa.schema([("grp", pa.string()), ("phrase", pa.string()), ("n_words", pa.int32()), ("f", pa.int64())])
    return phrases.repartition(buckets, "grp", "phrase").mapInArrow(count, "grp string, phrase string, n_words int, f long")


def count_phrases(docs: DataFrame, text_col: str = "text", group_col: str = "lang", max_words: int = 5, least: int = 100, chunk_bytes: int = 8 << 20, bucket_bytes: int = 8 << 20, memory: str = "256MB") -> DataFrame:
    """Exact frequencies of all phrases of 1 to max_words words that occur `least` times or more in a group, and of the
    empty phrase, which stands for all words: grp, phrase, n_words, f. The buckets are as many as the text has bucket_bytes."""
    chunks = materialise(_chunks(pieces(docs, text_col, group_col), chunk_bytes), "phrase-chunks")
    size = chunks.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    buckets = max(24, -(-size // bucket_bytes))
    answers = materialise(_answer(_ask(chunks, buckets), least), "phrase-answers")
    return materialise(_count(_phrases(chunks, answers, max_words), buckets, least, memory), "phrase-counts")


def _key(grp: str, part: str) -> F.Column:
    return F.concat(part, F.lit("\n"), F.col(grp))  # no part has a line break


def score_cuts(counts: DataFrame) -> DataFrame:
    """Candidates with their lowest-scoring cut: grp, phrase, n_words, a, l, r, n, score."""
    cands = counts.filter("n_words > 1").select("grp", "phrase", "n_words", F.col("f").alias("a"))
    words = F.split("phrase", " ", -1)
    cuts = cands.select("grp", "phrase", "n_words", "a", F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)).alias("k"))
    part = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.slice(words, F.lit(1), F.col("k")).alias("w")), F.struct(F.lit(1).alias("side"), F.slice(words, F.col("k") + 1, F.col("n_words") - F.col("k")).alias("w"))))
    asked = cuts.select("grp", "phrase", "n_words", "a", "k", part.alias("p")).select("*", _key("grp", F.array_join("p.w", " ")).alias("key"), F.xxhash64("grp", "phrase", "k").alias("deal"))
    known = counts.filter("n_words > 0").select(_key("grp", "phrase").alias("key"), "f")
    asked = spread_join(asked, known, "key", deal="deal")
    side = lambda i: F.max(F.when(F.col("p.side") == i, F.col("f")))
    cut = asked.groupBy("grp", "phrase", "n_words", "a", "k").agg(side(0).alias("l"), side(1).alias("r"))
    totals = counts.filter("n_words = 0").select("grp", F.col("f").alias("n"))
    cut = spread_join(cut.withColumn("deal", F.xxhash64("phrase", "k")), totals, "grp", deal="deal")
    wide = lambda c: F.col(c).cast("decimal(19,0)")  # noqa: E731  products of two have 38 digits
    cut = cut.withColumn("over", F.lit(1000).cast("decimal(4,0)") * F.col("a").cast("decimal(15,0)") * F.col("n").cast("decimal(17,0)")).withColumn("under", wide("l") * wide("r"))
    lowest = F.min(F.struct(F.expr("over div under").alias("score"), "k", "l", "r", "n")).alias("c")
    return cut.groupBy("grp", "phrase", "n_words", "a").agg(lowest).select("grp", "phrase", "n_words", "a", "c.l", "c.r", "c.n", "c.score")


def covered(counts: DataFrame, percent: int) -> DataFrame:
    """Phrases that lie inside a longer candidate of at least `percent` % of their own frequency."""
    words = F.split("phrase", " ", -1)
    long = counts.filter("n_words > 2").select("grp", F.col("f").alias("longer"), "n_words", words.alias("w"))
    long = long.select("*", F.explode(F.sequence(F.lit(2), F.col("n_words") - 1)).alias("size"))
    long = long.select("*", F.explode(F.sequence(F.lit(1), F.col("n_words") - F.col("size") + 1)).alias("i"))
    inner = long.select("grp", F.array_join(F.slice("w", F.col("i"), F.col("size")), " ").alias("phrase"), "longer")
    inner = inner.groupBy("grp", "phrase").agg(F.max("longer").alias("longer"))
    return inner.join(counts.select("grp", "phrase", "f"), ["grp", "phrase"]).filter(F.col("longer") * 100 >= F.col("f") * percent).select("grp", "phrase")


def mine_phrases(docs: DataFrame, text_col: str = "text", group_col: str = "lang", max_words: int = 5, least: int = 100, cover_percent: int = 100, top: int = 2000, **sizes: int) -> DataFrame:
    """The `top` phrases of each group by score: grp, rank, phrase, a, l, r, n, score (all numbers long)."""
    counts = count_phrases(docs, text_col, group_col, max_words, least, **sizes)
    scored = score_cuts(counts).join(covered(counts, cover_percent), ["grp", "phrase"], "left_anti")
    scored = materialise(scored, "phrase-scores")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parts = int((scored.count() / top) ** 0.5) + 1  # first the best of each part, then of all: both far below the whole
    first = Window.partitionBy("grp", "part").orderBy(*order)
    best = scored.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(parts))).withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("grp").orderBy(*order))).filter(F.col("rank") <= top)
    return ranked.select("grp", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
