"""A hashed maximum-entropy language model with a class-factored softmax.

P(word | history) = P(class | history) P(member | class, history) P(word | member). The HEAD most frequent words sit in
classes of MEMBERS words and are members themselves; every other word belongs to one of TAIL classes by its last letters
and to one of the class's MEMBERS groups by its hash, and has a static add-one share of its group, which leaves room for
unknown words. Classes and members are both told apart by a softmax over the history: the previous word, the previous
two, and the word before the previous one (a skip), hashed into `slots` rows of weights each. Weights start from the
words' frequencies, so that the untrained model is the add-one unigram model, and steps are damped where a row has seen
little.

Texts are cut into words once: a written table holds, for slices of texts, the slice's distinct words (hash and tail
class) and the texts as places among them. Counting, training and scoring read that table. Training is distributed: in
each round every partition starts from the shared weights, takes AdaGrad steps over its own texts (each round has other
texts, so all rounds together read each training text once), and the rows of weights are averaged by how often a
partition used them, in a tree of bounded groups. Scoring is in sparse numpy batches. Word counts are over all training
texts, exact but for words that share 64 bits of hash (0.03 pairs expected among 10^9 words); the counts of the `local`
most frequent words go to the workers, which changes no result: all other words meet their count in a join (a word there
is too rare to be a hot key).

Defined results: a null text is the empty text, whose only token is the end; without training texts every word is
unknown; rows that repeat get the same result; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, encode_words, hash_words, materialise, mix64, most_frequent

HEAD_CLASSES, MEMBERS, TAIL = 16, 16, 32
HEAD = HEAD_CLASSES * MEMBERS
CLASSES = HEAD_CLASSES + TAIL
CELLS = TAIL * MEMBERS
SLOTS = 4096
LOCAL = 1 << 18
END = b"\n"  # no word has it
BATCH = 1 << 15
RATE, DAMP = 0.3, 10.0


def tail_class(words: list[bytes]) -> np.ndarray:
    """By the last two letters, so that it says something of the language and the form, for unknown words too."""
    ends = np.frombuffer(b"".join((w.rstrip(b".,;:!?") or w)[-2:].rjust(2, b"\0") for w in words), ">u2").astype(np.uint64)
    return (mix64(ends + np.uint64(77)) % np.uint64(TAIL)).astype(np.int64)


def tail_cell(tail: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Tail class and group in one number."""
    return tail * MEMBERS + (h >> np.uint64(60)).astype(np.int64)


def tokens_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Codes with one end after each text, tokens per text, distinct tokens."""
    codes, lens, words = encode_words(texts)
    words = [*words, END]
    return np.insert(codes, np.cumsum(lens), len(words) - 1), lens + 1, words


def _slots(*parts: np.ndarray, salt: int, slots: int = SLOTS) -> np.ndarray:
    h = np.full(len(parts[0]), salt, np.uint64)
    for p in parts:
        h = (h ^ p) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (h % np.uint64(slots)).astype(np.uint16)  # short: sorts by radix


@dataclass
class Slice:
    """Texts as places among their distinct words."""

    codes: np.ndarray
    lens: np.ndarray
    h: np.ndarray
    tail: np.ndarray

    def only(self, texts: np.ndarray) -> Slice:
        """texts: bool."""
        return Slice(self.codes[np.repeat(texts, self.lens)], self.lens[texts], self.h, self.tail)


@dataclass
class Vocabulary:
    """What every worker knows: bounded by LOCAL."""

    hashes: np.ndarray  # of the most frequent words, ascending
    counts: np.ndarray
    rank: np.ndarray  # 0: the most frequent
    total: int  # N
    distinct: int  # V
    room: np.ndarray  # N + V + 1 of each tail cell, without the head's words

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each word: count (-1 where not local), place among the HEAD words (-1 else)."""
        if not len(self.hashes):
            return np.full(len(h), -1), np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        known = self.hashes[at] == h
        return np.where(known, self.counts[at], -1), np.where(known & (self.rank[at] < HEAD), self.rank[at], -1)


class Weights:
    """Class softmax: bias and three tables; member softmax: bias by class and two tables over (feature, class)."""

    def __init__(self, slots: int = SLOTS, vocab: Vocabulary | None = None):
        self.slots = slots
        shapes = {"bias": (1, CLASSES), "prev": (slots, CLASSES), "pair": (slots, CLASSES), "skip": (slots, CLASSES), "m_bias": (CLASSES, MEMBERS), "m_prev": (slots, MEMBERS), "m_skip": (slots, MEMBERS)}
        self.w = {k: np.zeros(s, np.float32) for k, s in shapes.items()}
        self.used = {k: np.zeros(s[0]) for k, s in shapes.items()}
        self.grad2 = {k: np.full(s, DAMP, np.float32) for k, s in shapes.items()}
        if vocab is not None:
            mass = np.full((CLASSES, MEMBERS), 1e-6)  # head places without a word
            head = vocab.rank < HEAD
            mass.reshape(-1)[vocab.rank[head]] = vocab.counts[head] + 1.0
            mass[HEAD_CLASSES:] = vocab.room.reshape(TAIL, MEMBERS)
            self.w["bias"][0] = np.log(mass.sum(1) / mass.sum())
            self.w["m_bias"][:] = np.log(mass / mass.sum(1, keepdims=True))

    def class_logits(self, x: dict[str, np.ndarray]) -> np.ndarray:
        z = self.w["prev"].take(x["prev"], 0)
        z += self.w["pair"].take(x["pair"], 0)
        z += self.w["skip"].take(x["skip"], 0)
        z += self.w["bias"][0]
        return z

    def member_logits(self, x: dict[str, np.ndarray]) -> np.ndarray:
        z = self.w["m_bias"].take(x["class"], 0)
        z += self.w["m_prev"].take(x["m_prev"], 0)
        z += self.w["m_skip"].take(x["m_skip"], 0)
        return z

    def _descend(self, name: str, rows: np.ndarray, g: np.ndarray) -> None:
        order = np.argsort(rows, kind="stable")
        ordered = rows[order]
        cuts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        at = ordered[cuts]
        total = np.add.reduceat(g.take(order, 0), cuts, axis=0)
        self.used[name][at] += np.diff(np.append(cuts, len(rows)))
        squares = self.grad2[name].take(at, 0)
        squares += total * total
        self.grad2[name][at] = squares
        self.w[name][at] -= RATE * total / np.sqrt(squares)

    def step(self, x: dict[str, np.ndarray]) -> None:
        n = np.arange(len(x["class"]))
        g = _softmax(self.class_logits(x))
        g[n, x["class"]] -= 1
        self.used["bias"] += len(n)
        total = g.sum(0)
        self.grad2["bias"][0] += total * total
        self.w["bias"][0] -= RATE * total / np.sqrt(self.grad2["bias"][0])
        for name in ("prev", "pair", "skip"):
            self._descend(name, x[name], g)
        g = _softmax(self.member_logits(x))
        g[n, x["member"]] -= 1
        for name, rows in (("m_bias", x["class"].astype(np.uint16)), ("m_prev", x["m_prev"]), ("m_skip", x["m_skip"])):
            self._descend(name, rows, g)


def _exp(z: np.ndarray) -> np.ndarray:
    """In place. Logits are held within what single precision can take, so no largest one has to be found first."""
    np.clip(z, -60, 60, out=z)
    return np.exp(z, out=z)


def _softmax(z: np.ndarray) -> np.ndarray:
    _exp(z)
    z *= (1 / (z @ np.ones(z.shape[1], z.dtype)))[:, None]
    return z


def _log_softmax_at(z: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Overwrites z."""
    _exp(z)
    return np.log(z[np.arange(len(z)), at]) - np.log(z @ np.ones(z.shape[1], z.dtype))


def examples(texts: Slice, head: np.ndarray, slots: int = SLOTS) -> Iterator[tuple[slice, dict[str, np.ndarray]]]:
    """Batches of tokens with their classes, members and feature rows. Texts start from two empty words."""
    cell = tail_cell(texts.tail, texts.h)
    cls = np.where(head >= 0, head // MEMBERS, HEAD_CLASSES + texts.tail)
    member = np.where(head >= 0, head % MEMBERS, cell % MEMBERS)
    starts = np.cumsum(texts.lens) - texts.lens
    w = texts.h[texts.codes]
    one, two = np.zeros_like(w), np.zeros_like(w)
    one[1:], two[2:] = w[:-1], w[:-2]
    one[starts] = 0
    two[starts] = 0
    two[(starts + 1)[texts.lens > 1]] = 0
    for lo in range(0, len(w), BATCH):
        s = slice(lo, lo + BATCH)
        c, a, b = cls[texts.codes[s]], one[s], two[s]
        k = c.astype(np.uint64)
        yield s, {
            "class": c, "member": member[texts.codes[s]], "prev": _slots(a, salt=1, slots=slots), "pair": _slots(a, b, salt=2, slots=slots), "skip": _slots(b, salt=3, slots=slots),
            "m_prev": _slots(a, k, salt=4, slots=slots), "m_skip": _slots(b, k, salt=5, slots=slots),
        }


def score_slice(texts: Slice, vocab: Vocabulary, model: Weights) -> dict[str, object]:
    """For each text, in log10 and apart from the counts of words that are not local: base, score; n_tokens, n_known;
    and those words as (text, hash, times)."""
    codes, lens = texts.codes, texts.lens
    count, head = vocab.find(texts.h)
    local = count >= 0
    plus = np.log10(np.where(local, count, 0) + 1.0)
    inside = np.where(head >= 0, 0.0, plus - np.log10(vocab.room[tail_cell(texts.tail, texts.h)]))
    lp = np.empty(len(codes))
    for s, x in examples(texts, head, model.slots):
        v = _log_softmax_at(model.class_logits(x), x["class"]).astype(np.float64)
        v += _log_softmax_at(model.member_logits(x), x["member"])
        lp[s] = v / np.log(10) + inside[codes[s]]
    starts = np.cumsum(lens) - lens
    add = lambda v: np.add.reduceat(v, starts) if len(starts) else np.zeros(0)
    doc = np.repeat(np.arange(len(lens)), lens)
    rare = ~local[codes]
    pair, times = np.unique(doc[rare] * len(texts.h) + codes[rare], return_counts=True)
    return {
        "n_tokens": lens, "n_known": add((count > 0)[codes].astype(np.int64)), "base": add(plus[codes]) - lens * np.log10(vocab.total + vocab.distinct + 1.0), "score": add(lp),
        "rare": (pair // len(texts.h), texts.h[pair % len(texts.h)], times),
    }


# ---------------------------------------------------------------- distributed parts

_SLICES = "row_ids array<long>, learn array<boolean>, lens array<int>, wide boolean, codes binary, hashes binary, tails binary"


def token_slices(docs: DataFrame) -> DataFrame:
    """docs: row_id, text, learn. Written: slices of texts (4 MB of text or one text), see _SLICES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in byte_slices(batches, "text", 4 << 20):
            codes, lens, words = tokens_of(texts)
            wide = len(words) > 1 << 16
            one = [
                pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([part.column(2).to_pylist()], pa.list_(pa.bool_())), pa.array([lens], pa.list_(pa.int32())), pa.array([wide]),
                pa.array([codes.astype("<u4" if wide else "<u2").tobytes()], pa.binary()), pa.array([hash_words(words).tobytes()], pa.binary()), pa.array([tail_class(words).astype(np.uint8).tobytes()], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(one, names=["row_ids", "learn", "lens", "wide", "codes", "hashes", "tails"])

    return materialise(docs.select("row_id", "text", "learn").mapInArrow(run, _SLICES), "lm-slices")


def read_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray, Slice]]:
    """Ids, which texts may be learned from, and the texts of each slice."""
    for batch in batches:
        for i in range(batch.num_rows):
            ids, learn, lens, wide, codes, h, tail = (c[i] for c in batch.columns)
            yield ids.as_py(), np.array(learn.as_py(), bool), Slice(
                np.frombuffer(codes.as_buffer(), "<u4" if wide.as_py() else "<u2").astype(np.int32), lens.values.to_numpy().astype(np.int64),
                np.frombuffer(h.as_buffer(), np.uint64), np.frombuffer(tail.as_buffer(), np.uint8).astype(np.int64),
            )


def word_counts(slices: DataFrame) -> DataFrame:
    """h, cell (of its tail class), n of every token of the texts to learn from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, learn, texts in read_slices(batches):
            n = np.bincount(texts.only(learn).codes, minlength=len(texts.h))
            there = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(texts.h[there].view(np.int64)), pa.array(tail_cell(texts.tail, texts.h)[there].astype(np.int32)), pa.array(n[there])], names=["h", "cell", "n"])

    return slices.mapInArrow(run, "h long, cell int, n long").groupBy("h").agg(F.min("cell").alias("cell"), F.sum("n").alias("n"))


def vocabulary(counts: DataFrame, local: int = LOCAL) -> Vocabulary:
    """counts: materialised. The driver gets `local` rows, the HEAD most frequent and one for each tail cell."""
    head = counts.orderBy(F.desc("n"), "h").limit(HEAD).toPandas()
    top = pd.concat([head, most_frequent(counts, "n", local).toPandas()]).drop_duplicates("h").sort_values(["n", "h"], ascending=[False, True]).reset_index(drop=True)
    sums = counts.groupBy("cell").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).toPandas()
    room = np.ones(CELLS)
    room[sums["cell"]] += sums["n"] + sums["v"]
    np.subtract.at(room, top["cell"][:HEAD].to_numpy(int), top["n"][:HEAD].to_numpy(float) + 1)
    h = top["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(h)
    return Vocabulary(h[order], top["n"].to_numpy(np.int64)[order], order, int(sums["n"].sum()), int(sums["v"].sum()), room)


_TREE = 24
_PART_SCHEMA = "name string, block int, part long, w binary, used binary"
_BLOCK = 512


def _averaged(parts: DataFrame) -> DataFrame:
    """Sum (weights times uses) and uses of each block over the partitions, _TREE at a time."""

    def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        w = sum(np.frombuffer(x, np.float32) for x in pdf["w"])
        used = sum(np.frombuffer(x, np.float64) for x in pdf["used"])
        return pd.DataFrame({"name": [key[0]], "block": [key[1]], "part": [key[2]], "w": [np.asarray(w, np.float32).tobytes()], "used": [used.tobytes()]})

    most = parts.agg(F.max("part")).first()[0]
    while most is not None:
        most //= _TREE
        parts = parts.withColumn("part", F.floor(F.col("part") / _TREE)).groupBy("name", "block", "part").applyInPandas(add, _PART_SCHEMA)
        if most == 0:
            break
        parts = materialise(parts, "lm-tree")
    return parts


def train(slices: DataFrame, vocab: Vocabulary, rounds: int = 2, slots: int = SLOTS) -> Weights:
    """rounds: how often the partitions' weights are averaged; each reads its own part of the texts."""
    spark = slices.sparkSession
    model = Weights(slots, vocab)
    words = spark.sparkContext.broadcast(vocab)
    for turn in range(rounds):
        start = spark.sparkContext.broadcast(model.w)

        def run(batches: Iterator[pa.RecordBatch], start=start, turn=turn) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            own = Weights(slots)
            own.w = {k: v.copy() for k, v in start.value.items()}
            for _, learn, texts in read_slices(batches):
                mine = texts.only(learn & (np.arange(len(learn)) % rounds == turn))
                for _, x in examples(mine, words.value.find(texts.h)[1], slots):
                    own.step(x)
            rows = []
            for name, used in own.used.items():
                for block in range(0, len(used), _BLOCK):
                    u = used[block : block + _BLOCK]
                    if u.any():
                        rows.append((name, block // _BLOCK, TaskContext.get().partitionId(), (own.w[name][block : block + _BLOCK] * u[:, None]).astype(np.float32).tobytes(), u.tobytes()))
            if rows:
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.binary()), pa.array(cols[4], pa.binary())], names=["name", "block", "part", "w", "used"])

        parts = materialise(slices.mapInArrow(run, _PART_SCHEMA), "lm-parts")
        for r in _averaged(parts).toLocalIterator():  # one row a block: the size of the model
            used = np.frombuffer(r["used"], np.float64)
            at = slice(r["block"] * _BLOCK, r["block"] * _BLOCK + len(used))
            w = np.frombuffer(r["w"], np.float32).reshape(len(used), -1)
            new = model.w[r["name"]][at]
            new[used > 0] = (w / np.maximum(used, 1)[:, None])[used > 0]
    return model


def score_texts(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", rounds: int = 2, slots: int = SLOTS, local: int = LOCAL) -> DataFrame:
    """learn: the condition on rows of docs that may be learned from. One row for each row of docs: row_id, n_tokens,
    n_known, train_tokens, base_score, score (log10 of the text's probability). slots: rows of each table of weights,
    65536 at most; the size of the model, which every worker holds."""
    spark = docs.sparkSession
    slices = token_slices(docs.select(F.col(id_col).cast("long").alias("row_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(learn, F.lit(False)).alias("learn")))
    counts = materialise(word_counts(slices), "lm-counts")
    vocab = vocabulary(counts, local)
    model = train(slices, vocab, rounds, slots)
    model.used, model.grad2 = {}, {}
    shared = spark.sparkContext.broadcast((vocab, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, texts in read_slices(batches):
            got = score_slice(texts, *shared.value)
            doc, h, times = got["rare"]
            at = pa.array(np.searchsorted(doc, np.arange(len(ids) + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(got["n_tokens"]), pa.array(got["n_known"]), pa.array(got["base"]), pa.array(got["score"]), pa.ListArray.from_arrays(at, pa.array(h.view(np.int64))), pa.ListArray.from_arrays(at, pa.array(times.astype(np.int32)))],
                names=["row_id", "n_tokens", "n_known", "base", "score", "rare", "times"],
            )

    schema = "row_id long, n_tokens long, n_known long, base double, score double, rare array<long>, times array<int>"
    rows = materialise(slices.mapInArrow(run, schema).withColumn("key", F.monotonically_increasing_id()), "lm-rows")
    rare = rows.select("key", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("key", F.col("x.rare").alias("h"), F.col("x.times").alias("times"))
    met = rare.join(counts.select("h", "n"), "h").groupBy("key").agg(F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("plus"), F.sum("times").alias("known"))
    plus = F.coalesce("plus", F.lit(0.0))
    return rows.drop("rare", "times").join(met, "key", "left").select(
        "row_id", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(vocab.total).cast("long").alias("train_tokens"),
        (F.col("base") + plus).alias("base_score"), (F.col("score") + plus).alias("score"),
    )
