"""Each operator against a brute-force version on a small fixture, and its defined results on odd rows."""

import collections
import hashlib
import itertools
import math
import random
import re
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from oroflow.llm import exact_dedup, language_id, line_dedup, lm_scoring, mixing, near_dedup, packing, quality_rules, token_counts, toxicity
from oroflow.llm.common import id_remainder, spread_join

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, digest string"


def prose(rng, n, vocab=400):
    return " ".join(f"w{rng.randrange(vocab)}" for _ in range(n))


ODD = [(None, None), (7001, None), (7002, ""), (7003, " \n\t "), (7004, "one"), (7004, "one"), (7005, "x" * 200_000), (7006, "a b c d e f " * 3000), (7007, "a b c d e f " * 3000), (None, "null id"), (7008, "Ünïcode ½ \x1c text\x01with. marks\nand lines. more")]


def rows(pairs, lang="en", source="s"):
    return [(i, t, lang, source, len(t or ""), 0.5, "clash") for i, t in pairs]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(rows(ODD), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# ---------------------------------------------------------------- 1 quality rules

def brute_rules(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    at = collections.defaultdict(list)
    for i in range(len(words) - 4):
        at[tuple(words[i : i + 5])].append(i)
    covered = {p for v in at.values() if len(v) > 1 for i in v for p in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark, odd, none):
    rng = random.Random(1)
    texts = [prose(rng, 30, 6) for _ in range(40)] + [prose(rng, 50) + "\n" + "same line here\n" * 4 + "### | % 5" for _ in range(5)]
    docs = spark.createDataFrame(rows(list(enumerate(texts)) + ODD), SCHEMA)
    out = quality_rules.ledger(docs).select("text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "fail_bits").collect()
    assert len(out) == len(texts) + len(ODD)
    for r in out:
        assert tuple(r)[1:6] == brute_rules(r["text"])
        n, chars, symbols, dup, rep = brute_rules(r["text"])
        assert bool(r["fail_bits"] & 1) == (n < 10) and bool(r["fail_bits"] & 2) == (100 * rep > 20 * n)
    assert quality_rules.ledger(none).count() == 0


def test_policies_and_ablations(spark):
    docs = spark.createDataFrame([(1, "a " * 50), (2, "one two"), (3, " ".join(f"w{i}" for i in range(30))), (4, "# " * 20 + " ".join(f"v{i}" for i in range(5)))], "doc_id long, text string")
    led = quality_rules.ledger(docs)
    kept = [r[0] for r in led.filter(quality_rules.passes(quality_rules.POLICIES[-1])).select("doc_id").collect()]
    assert kept == [3]
    got = {(r["policy"], r["version"], r["rule"]): (r["n_fail"], r["n_only"]) for r in quality_rules.ablations(led).collect()}
    bits = [r["fail_bits"] for r in led.collect()]
    for p in quality_rules.POLICIES:
        for i, (name, _) in enumerate(quality_rules.RULES):
            if name in p.rules:
                assert got[p.name, p.version, name] == (sum(bool(b >> i & 1) for b in bits), sum((b & p.mask) == 1 << i for b in bits))


# ---------------------------------------------------------------- 2 language model

def test_lm_scores(spark, odd, none):
    rng = random.Random(2)
    follow = {f"w{i}": [f"w{(7 * i + k) % 60}" for k in (1, 2)] for i in range(60)}

    def walk(n):
        out = ["w0"]
        while len(out) < n:
            out.append(rng.choice(follow[out[-1]]))
        return " ".join(out)

    train = spark.createDataFrame([(i, walk(120)) for i in range(400)], "doc_id long, text string")
    test = spark.createDataFrame([(1000 + i, walk(80) + " unseen") for i in range(20)] + ODD, "doc_id long, text string")
    learn = F.col("doc_id") < 400
    both = test.unionByName(train)
    out = [r for r in lm_scoring.score_texts(both, learn).collect() if r["row_id"] is None or r["row_id"] >= 400]
    assert len(out) == 20 + len(ODD)
    few = {str((r["row_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 6))) for r in lm_scoring.score_texts(both, learn, local=3).collect()}
    assert {str((r["row_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 6))) for r in out} <= few  # whichever way counts come
    counts = collections.Counter(w for r in train.collect() for w in [*r["text"].encode().lower().split(), b"\n"])
    n, v = sum(counts.values()), len(counts)
    texts = collections.defaultdict(list)
    for r in test.collect():
        words = [*(r["text"] or "").encode().lower().split(), b"\n"]
        texts[r["doc_id"]].append((len(words), sum(counts[w] > 0 for w in words), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words), 6)))
    got = collections.defaultdict(list)
    for r in out:
        got[r["row_id"]].append((r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)))
    for key in texts:
        for want, have in zip(sorted(texts[key]), sorted(got[key]), strict=True):
            assert want[:3] == have[:3] and want[3] == pytest.approx(have[3], abs=1e-4, rel=1e-8)
    held = [r for r in out if (r["row_id"] or 0) >= 1000 and (r["row_id"] or 0) < 1100]
    assert sum(r["score"] for r in held) > 0.8 * sum(r["base_score"] for r in held)  # both negative: the model is better
    assert all(r["score"] > r["base_score"] for r in held)
    assert lm_scoring.score_texts(none, learn).count() == 0
    assert lm_scoring.score_texts(odd.limit(3), F.lit(False)).count() == 3


def small_model(rng, words=300):
    """A vocabulary of more words than the head has, counts and a model over it."""
    known = [f"{'xyz'[i % 3]}{i}".encode() for i in range(words)] + [lm_scoring.END]
    n = rng.integers(1, 50, len(known))
    h, tail = lm_scoring.hash_words(known), lm_scoring.tail_class(known)
    cell = lm_scoring.tail_cell(tail, h)
    by = np.lexsort((h.view(np.int64), -n))
    room = np.ones(lm_scoring.CELLS)
    np.add.at(room, cell[by[lm_scoring.HEAD :]], n[by[lm_scoring.HEAD :]] + 1)
    order = np.argsort(h[by])
    return known, h, tail, cell, lm_scoring.Vocabulary(h[by][order], n[by][order], order, int(n.sum()), len(known), room)


def test_lm_is_a_distribution():
    """Over all words that can follow two words, and the unknown words of every cell, probabilities sum to one; weights
    without training are the unigram model's."""
    rng = np.random.default_rng(0)
    known, h, tail, cell, vocab = small_model(rng)
    fresh = lm_scoring.Weights(64, vocab)
    tuned = lm_scoring.Weights(64, vocab)
    for w in tuned.w.values():
        w += rng.normal(0, 1, w.shape).astype(np.float32)
    n = len(known)
    texts = lm_scoring.Slice(np.stack([np.full(n, 3), np.full(n, 7), np.arange(n)], 1).ravel(), np.full(n, 3), h, tail)
    before = lm_scoring.Slice(np.tile([3, 7], 1), np.array([2]), h, tail)
    for model in (fresh, tuned):
        p = 10 ** (lm_scoring.score_slice(texts, vocab, model)["score"] - lm_scoring.score_slice(before, vocab, model)["score"][0])
        _, head = vocab.find(h)
        unknown = 0.0
        for c in range(lm_scoring.CELLS):  # one count of a cell's room is its unknown words'
            mates = np.flatnonzero((cell == c) & (head < 0))
            if len(mates):
                unknown += p[mates[0]] / (vocab.counts[np.searchsorted(vocab.hashes, h[mates[0]])] + 1)
            else:
                x = {k: v[-1:] for k, v in next(lm_scoring.examples(lm_scoring.Slice(np.array([3, 7, 0]), np.array([3]), h, tail), head, 64))[1].items()}
                k = lm_scoring.HEAD_CLASSES + c // lm_scoring.MEMBERS
                x |= {"class": np.array([k]), "m_prev": lm_scoring._slots(h[[7]], np.array([k], np.uint64), salt=4, slots=64), "m_skip": lm_scoring._slots(h[[3]], np.array([k], np.uint64), salt=5, slots=64)}
                one = lm_scoring._softmax(model.class_logits(x))[0, k] * lm_scoring._softmax(model.member_logits(x))[0, c % lm_scoring.MEMBERS]
                unknown += one / vocab.room[c]
        assert p.sum() + unknown == pytest.approx(1, abs=1e-4)
    got = lm_scoring.score_slice(before, vocab, fresh)
    assert got["score"][0] == pytest.approx(got["base"][0], abs=2 * math.log10((vocab.total + n + lm_scoring.CELLS) / (vocab.total + n)) + 1e-3)


def test_lm_steps_follow_the_gradient():
    """A step's gradient, taken from what it adds to the squares, against finite differences of the log-likelihood."""
    rng = np.random.default_rng(1)
    _, h, tail, _, vocab = small_model(rng, 400)
    model = lm_scoring.Weights(64, vocab)
    for w in model.w.values():
        w += rng.normal(0, 0.5, w.shape).astype(np.float32)
    text = lm_scoring.Slice(rng.integers(0, 400, 50), np.array([30, 20]), h, tail)
    _, x = next(lm_scoring.examples(text, vocab.find(h)[1], 64))

    def loss():
        return -float(lm_scoring._log_softmax_at(model.class_logits(x).astype(float), x["class"]).sum() + lm_scoring._log_softmax_at(model.member_logits(x).astype(float), x["member"]).sum())

    want = {}
    for name, at in (("bias", (0, 5)), ("prev", (int(x["prev"][4]), int(x["class"][4]))), ("pair", (int(x["pair"][9]), 3)), ("skip", (int(x["skip"][20]), int(x["class"][20]))), ("m_bias", (int(x["class"][7]), 2)), ("m_prev", (int(x["m_prev"][7]), int(x["member"][7]))), ("m_skip", (int(x["m_skip"][40]), 1))):
        old = model.w[name][at]
        sides = []
        for d in (0.02, -0.02):
            model.w[name][at] = old + d
            sides.append(loss())
        model.w[name][at] = old
        want[name, at] = (sides[0] - sides[1]) / 0.04
    model.step(x)
    for (name, at), g in want.items():
        assert math.sqrt(max(0.0, float(model.grad2[name][at]) - lm_scoring.DAMP)) == pytest.approx(abs(g), rel=0.05, abs=5e-3)


# ---------------------------------------------------------------- 3 language

def test_language(spark, odd, none):
    rng = random.Random(3)
    make = {"aa": "the and of ing tion", "bb": "der die und ung keit", "cc": "le la et eau ment"}
    one = lambda lang: " ".join("".join(rng.choice(make[lang].split()) for _ in range(rng.randrange(1, 3))) for _ in range(25))
    train = spark.createDataFrame([(i, one(x), x) for i in range(60) for x in make] + [(999, "no label", None), (998, None, "aa")], "doc_id long, text string, lang string")
    trees = language_id.learn_languages(train)
    test = spark.createDataFrame([(i, one(x), x) for i in range(20) for x in make], "doc_id long, text string, score string")
    out = language_id.identify_language(test.withColumnRenamed("score", "truth"), trees).collect()
    assert all(r["lang_pred"] == r["truth"] and 0.5 < r["score"] <= 1 for r in out)
    got = language_id.identify_language(odd, trees).collect()
    assert len(got) == len(ODD) and all((r["lang_pred"] == "und") == (not any(ch.isalpha() for ch in r["text"] or "")) for r in got)
    assert language_id.identify_language(none, trees).count() == 0
    assert language_id.learn_languages(none) is None
    assert {r["lang_pred"] for r in language_id.identify_language(odd, None).collect()} == {"und"}


def brute_code_length(train, text, order=3):
    """Method C with exclusion, byte by byte."""
    counts = collections.defaultdict(collections.Counter)
    for t in train:
        b = b"\n" * order + t
        for i in range(order, len(b)):
            for k in range(order + 1):
                counts[b[i - k : i]][b[i]] += 1
    known = {c for t in train for c in t}
    bits, b = 0.0, b"\n" * order + text
    for i in range(order, len(b)):
        left, seen = 1.0, set()
        ctx = next((b[i - k : i] for k in range(order, -1, -1) if counts.get(b[i - k : i])))
        for k in range(len(ctx), -1, -1):
            c = {x: n for x, n in counts[ctx[len(ctx) - k :]].items() if x not in seen}
            total = sum(c.values()) + len(c)
            if b[i] in c:
                left *= c[b[i]] / total
                break
            if c:
                left *= len(c) / total
            seen |= set(c)
        else:
            left /= 256 - len(seen)
        bits -= math.log2(left)
    assert known
    return bits


def test_code_lengths_are_exact():
    rng = random.Random(4)
    train = [bytes(rng.choice(b"abcde ") for _ in range(60)) for _ in range(5)]
    grams = collections.Counter()
    for t in train:
        b = b"\n\n\n" + t
        for i in range(3, len(b)):
            grams[int.from_bytes(b[i - 3 : i + 1], "big")] += 1
    trees = language_id.ContextTrees.build(["x"], np.zeros(len(grams), int), np.array(list(grams)), np.array(list(grams.values()), float))
    texts = [bytes(rng.choice(b"abcdez ") for _ in range(n)) for n in (0, 1, 2, 5, 90, 300)]
    got = trees.code_lengths(texts, chunk=64)[:, 0]
    assert got == pytest.approx([brute_code_length(train, t) for t in texts], rel=1e-4, abs=1e-6)


# ---------------------------------------------------------------- 4 packing

def test_packing(spark, none):
    rng = random.Random(5)
    data = [(i, rng.choice([0, 3, 17, 200, 511, 512, 513, 4000, 9000, 30000])) for i in range(300)] + [(None, 5), (7, None), (8, 8), (8, 8)] + [(None, 6)] * 400
    docs = spark.createDataFrame(data, "row_id long, size long")
    out = packing.best_fit_pack(docs, shard_rows=100).toPandas()
    bins = out.groupby("bin_id").agg(used=("length", "sum"), said=("bin_used", "first"), cap=("bin_capacity", "first"))
    assert (bins.used == bins.said).all() and (bins.used <= bins.cap).all()
    assert all(c == min(x for x in packing.CAPACITIES if x >= u) for u, c in zip(bins.used, bins.cap))
    for _, b in out[out.length > 0].sort_values("bin_offset").groupby("bin_id"):
        assert (b.bin_offset.to_numpy()[1:] == (b.bin_offset + b.length).to_numpy()[:-1]).all()
    assert out.length.sum() == sum(s or 0 for _, s in data)
    assert len(out) == sum(max(1, -(-(s or 0) // 8192)) for _, s in data)
    assert out[out.row_id.isna() & (out["size"] == 6)].groupby(out.bin_id // (1 << 32)).size().max() < 200  # rows alike are dealt apart
    assert packing.best_fit_pack(spark.createDataFrame([], "row_id long, size long")).count() == 0


def test_packing_is_near_the_best():
    """Against the cheapest of all partitions, on sets small enough to try them all."""

    def partitions(items):
        if not items:
            yield []
            return
        for rest in partitions(items[1:]):
            yield [[items[0]], *rest]
            for i in range(len(rest)):
                yield [*rest[:i], [items[0], *rest[i]], *rest[i + 1 :]]

    caps, worst, rng = (4, 8, 16), 0.0, random.Random(6)
    for _ in range(25):
        items = [rng.randrange(1, 13) for _ in range(7)]
        fit = lambda s: min((c for c in caps if c >= s), default=None)
        best = min(sum(packing.bin_cost(fit(sum(b))) for b in p) for p in partitions(items) if all(fit(sum(b)) for b in p))
        _, _, got = packing.pack(np.array(items), caps)
        worst = max(worst, sum(map(packing.bin_cost, got)) / best)
    assert worst <= 1.35


# ---------------------------------------------------------------- 5 mixing

def brute_targets(sizes, share=1.5, cap=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, full = share * sum(sizes.values()), set()
    while True:
        level = (total - sum(cap * sizes[s] for s in full)) / max(1e-9, sum(weight[s] for s in names if s not in full))
        more = {s for s in names if s not in full and weight[s] * level >= cap * sizes[s]}
        if not more:
            return {s: cap * sizes[s] if s in full else weight[s] * level for s in names}
        full |= more


def test_mixing(spark, none):
    rng = random.Random(7)
    names = ["b", "a", "Z", "é", None, "c", "tiny", "empty"]
    data = [(i, rng.randrange(1, 400), rng.choice(names[:6])) for i in range(6000)] + [(9000, 3, "tiny"), (9001, 0, "empty"), (9002, None, "empty"), (None, 10, "a"), (5, 50, "a"), (5, 50, "a")] + [(None, 20, "b")] * 900
    docs = spark.createDataFrame(data, "row_id long, size long, source string")
    out = mixing.balanced_mix(docs, block_rows=300).toPandas()
    assert len(out) == len(data) and (out.taken <= 2 * out["size"]).all() and (out.taken == out.copies * out["size"]).all()
    sizes = collections.Counter()
    for _, n, s in data:
        sizes[s] += n or 0
    want = brute_targets(sizes)
    for s, g in out.groupby(out.source.map(lambda x: x if isinstance(x, str) else "NULL")):
        s = None if s == "NULL" else s
        assert g.target.iloc[0] == pytest.approx(want[s]) and g.source_size.iloc[0] == sizes[s]
        assert abs(g.taken.sum() - want[s]) <= max(2, 0.002 * want[s]) or s in ("tiny", "empty")
    again = mixing.balanced_mix(docs.orderBy(F.desc("row_id")).repartition(3), block_rows=300).toPandas()
    key = lambda x: sorted(map(str, x[["row_id", "size", "source", "taken"]].values.tolist()))
    assert key(out) == key(again)
    assert mixing.balanced_mix(docs.limit(0)).count() == 0


def test_flight_keeps_totals():
    rng = np.random.default_rng(8)
    size, pi = rng.integers(1, 90, 500).astype(float), rng.random(500)
    mean = np.zeros(500)
    for seed in range(60):
        out = mixing.flight(pi, size, seed)
        assert out.sum() == pytest.approx(pi.sum()) and (out * size).sum() == pytest.approx((pi * size).sum())
        assert ((out > 0) & (out < 1)).sum() <= 2
        mean += out / 60
    assert abs(mean - pi).mean() < 0.06  # each row is taken with its own probability


# ---------------------------------------------------------------- 6 tokens

def test_token_counts(spark, odd, none, tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    rng = random.Random(9)
    texts = [prose(rng, 40) for _ in range(20)] + ["a  b   c\n\n d", " lead", "trail ", "it's <|endoftext|> x<|endoftext|>y", "naïve café ½ x", "１２ ３", "日本 語 text", "  nb　sp ce", "tab\tand\x0bvt", "A" * 5000 + " " + "9" * 3000]
    docs = spark.createDataFrame(rows(list(enumerate(texts)) + ODD), SCHEMA)
    cache = f"file://{tmp_path}/cache"
    out = token_counts.token_counts(docs, path, cache).collect()
    assert len(out) == len(texts) + len(ODD)
    library = tokenizers.Tokenizer.from_file(path)
    want = sorted((i is None, i or 0, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in list(enumerate(texts)) + ODD)
    assert sorted((r[0] is None, r[0] or 0, r[1], r[2]) for r in out) == want
    size = spark.read.parquet(cache).count()
    assert size == len({t or "" for t in texts + [t for _, t in ODD]})
    assert token_counts.token_counts(docs, path, cache).count() == len(out) and spark.read.parquet(cache).count() == size  # all hits
    assert token_counts.token_counts(none, path).count() == 0


# ---------------------------------------------------------------- 7 exact copies

def test_exact_dedup(spark, odd, none):
    rng = random.Random(10)
    base = [prose(rng, 12) for _ in range(30)]
    pairs = [(i, rng.choice(base) if i % 3 else rng.choice(base).upper()) for i in range(400)] + ODD
    docs = spark.createDataFrame(rows(pairs), SCHEMA)
    old = F.coalesce(F.col("doc_id") % 2 == 0, F.lit(False))
    for out in (exact_dedup.exact_dedup(docs.filter(~old), docs.filter(old), shard_rows=7), exact_dedup.exact_dedup(docs)):
        groups = collections.defaultdict(list)
        low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        for i, t in pairs:
            groups[hashlib.sha256(low(t).encode()).digest()].append(i)
        got = out.collect()
        assert len(got) == len(pairs)
        for r in got:
            g = groups[bytes(r["digest"])]
            ids = [i for i in g if i is not None]
            assert r["group_size"] == len(g) and r["keep_id"] == (max(ids) if ids else None) and r["kept"] == (r["row_id"] == r["keep_id"])
    assert exact_dedup.exact_dedup(none, none).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 1000, 40_000])
def test_fuse_filter(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    f = exact_dedup.FuseFilter.build(keys)
    assert f.contains(keys).all()
    other = rng.integers(0, 1 << 63, 50_000, dtype=np.uint64)
    assert f.contains(other).mean() < 2e-3
    assert n < 40_000 or f.prints.nbytes < 2 * 1.5 * n


def test_rows_under_one_digest_with_other_bytes(spark):
    """Digests that meet (one byte of them counts): the byte check parts the texts."""
    rng = random.Random(11)
    pairs = [(i, f"text {rng.randrange(300)}") for i in range(900)]
    docs = spark.createDataFrame(pairs, "doc_id long, text string")
    groups = collections.defaultdict(list)
    for i, t in pairs:
        groups[t].append(i)
    want = {(i, max(groups[t]), len(groups[t]), i == max(groups[t])) for i, t in pairs}
    old = F.col("doc_id") % 2 == 0
    for out in (exact_dedup.exact_dedup(docs, strength=1), exact_dedup.exact_dedup(docs.filter(~old), docs.filter(old), strength=1)):
        assert {tuple(r) for r in out.select("row_id", "keep_id", "group_size", "kept").collect()} == want


def test_frequent_keys_are_dealt_apart(spark, tmp_path):
    left = spark.createDataFrame([(7 if i % 3 else i, i) for i in range(3000)] + [(None, -1)], "k long, v long")
    left.write.parquet(f"{tmp_path}/left")
    right = spark.range(0, 3000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    left = spark.read.parquet(f"{tmp_path}/left")
    for how in ("inner", "left"):
        got, want = (sorted(map(str, x.select("k", "v", "w").collect())) for x in (spread_join(left, right, "k", how), left.join(right, "k", how)))
        assert got == want
    dealt = spread_join(left, right, "k").filter("k = 7")
    assert "__salt" in dealt._jdf.queryExecution().toString() and dealt.count() == 2000


# ---------------------------------------------------------------- 8 lines

def test_line_dedup(spark, odd, none):
    rng = random.Random(11)
    line = lambda: prose(rng, 9, 5000) + ".\n"
    shared = [line() for _ in range(12)]
    pairs = []
    for i in range(30):
        pairs.append((i, "".join([line() for _ in range(rng.randrange(1, 4))] + shared + [line() for _ in range(3)])))
    pairs += [(100 + i, "".join(line() for _ in range(8))) for i in range(10)]
    docs = spark.createDataFrame(rows(pairs + ODD), SCHEMA)
    out = line_dedup.line_dedup(docs).collect()
    assert len(out) == len(pairs) + len(ODD)
    texts, by = dict(pairs), {r["row_id"]: r for r in out if r["row_id"] is not None and r["row_id"] < 7000}
    assert by[0]["text"] == texts[0] and all(by[i]["n_removed"] == 0 for i in range(100, 110))
    inside = set(shared)
    for i in range(1, 30):
        gone = [x for x in texts[i].splitlines(True) if x not in by[i]["text"].splitlines(True)]
        assert len(gone) >= 4 and set(gone) <= inside and by[i]["removed_chars"] == sum(map(len, gone))
    assert all(r["text"] is None for r in out if r["row_id"] == 7001)
    assert next(r for r in out if r["row_id"] == 7008)["text"] == ODD[-1][1]
    assert line_dedup.line_dedup(none).count() == 0


def test_line_dedup_finds_whole_passages(spark):
    """Passages of 50 to 60 words in few units between unlike neighbours, against the definition by brute force."""
    rng = random.Random(21)
    sentence = lambda n: prose(rng, n, 50_000) + rng.choice((". ", ".\n"))
    passages = [[sentence(55)], *([sentence(w) for w in sizes] for sizes in ((26, 25), (17, 17, 18), (11, 10, 10, 11, 10), (3, 2, 3), (30, 2, 2, 2, 15)))]
    texts = {}
    for i in range(60):
        around = [[sentence(rng.randrange(1, 20)) for _ in range(rng.randrange(1, 4))] for _ in range(2)]
        texts[i] = [*around[0], *passages[i % len(passages)], *(["\n"] if i % 5 == 0 else []), *around[1]]
    short = sentence(7)  # alone under the limits: stays everywhere
    texts |= {100 + i: [sentence(9), short, sentence(9)] for i in range(3)}
    n = lambda x: len(x.split())
    first = {}
    places = [(i, a, b) for i, u in texts.items() for a in range(len(u)) for b in range(a, len(u)) if n(u[a]) and n(u[b])]
    run = lambda i, a, b: "".join(texts[i][a : b + 1]).rstrip()
    fits = lambda u: sum(map(n, u)) >= (8 if sum(n(x) > 0 for x in u) > 1 else 50)
    gone = collections.defaultdict(set)
    for i, a, b in places:
        if fits(texts[i][a : b + 1]) and first.setdefault(run(i, a, b), (i, a)) != (i, a):
            gone[i] |= set(range(a, b + 1))
    docs = spark.createDataFrame(rows([(i, "".join(u)) for i, u in texts.items()]), SCHEMA)
    got = {r["row_id"]: r for r in line_dedup.line_dedup(docs).collect()}
    for i, u in texts.items():
        assert got[i]["text"] == "".join(x for k, x in enumerate(u) if k not in gone[i])
        assert got[i]["n_removed"] == sum(k - 1 not in gone[i] for k in gone[i])
    assert all(len(gone[i]) >= len(passages[i % len(passages)]) for i in range(len(passages), 60))


# ---------------------------------------------------------------- 9 toxicity

def test_segments_are_maximal():
    rng = random.Random(12)
    for _ in range(300):
        n, drift = rng.randrange(1, 14), rng.choice([0.3, 1.0])
        at = sorted(rng.sample(range(n), rng.randrange(0, n + 1)))
        scores = [(p, rng.choice([0.5, 1.0, 2.5])) for p in at]
        full = [-drift] * n
        for p, s in scores:
            full[p] = s

        def best(lo, hi):
            """The recursive definition: the best part first, then what is left of it and right of it."""
            found = max(((sum(full[i:j]), -(j - i), -i, j) for i in range(lo, hi) for j in range(i + 1, hi + 1)), default=None)
            if found is None or found[0] <= 1e-12:
                return []
            i, j = -found[2], found[3]
            return best(lo, i) + [(i, j - 1, round(found[0], 9))] + best(j, hi)

        got = toxicity.maximal_segments(scores, drift)
        assert sum(s for *_, s in got) == pytest.approx(sum(s for *_, s in best(0, n)))
        assert max((s for *_, s in got), default=0) == pytest.approx(max((s for *_, s in best(0, n)), default=0))


def test_toxicity(spark, odd, none):
    rng = random.Random(13)
    bad = ["vile", "nasty", "foul"]
    text = lambda y: " ".join(rng.choice(bad) + rng.choice(["", ","]) if y and rng.random() < 0.08 else f"w{rng.randrange(300)}" for _ in range(80))
    data = [(i, text(i % 4 == 0), int(i % 4 == 0)) for i in range(600)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in data if i < 450] + [(1, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.learn_toxicity(docs, labels)
    assert {w.decode() for w in model.words} >= set(bad)
    out = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, model).collect()}
    assert sum(out[i]["predicted"] == y for i, _, y in data if i >= 450) >= 0.95 * 150
    r = next(out[i] for i, t, y in data if y and out[i]["passages"])
    words = next(t for i, t, _ in data if i == r["doc_id"]).split()
    assert words[r["passages"][0]["first_word"]].strip(",") in bad
    got = toxicity.score_toxicity(odd, model)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "digest", "score", "predicted", "passages"]
    assert got.filter("score between 0 and 1").count() == len(ODD)
    assert toxicity.score_toxicity(none, model).count() == 0
    assert not toxicity.learn_toxicity(docs, labels.limit(0)).words
    for t, y in ((t, y) for _, t, y in data[:40]):  # score and significance again from the segments, word by word
        words_ = [w.strip(",") for w in t.split()]
        at = [(i, model.words[w.encode()]) for i, w in enumerate(words_) if w.encode() in model.words]
        e = [(a, b, s, model.lam * s - math.log(model.k * len(words_))) for a, b, s in toxicity.maximal_segments(at, model.drift)]
        positive = [x for *_, x in e if x > 0]
        best = -math.log(1 - math.exp(-math.exp(-max(x for *_, x in e)))) if e else 0.0
        r, total = len(positive), sum(positive)
        both = max(0.0, -math.log(math.exp(-total) * total ** (r - 1) / math.factorial(r) / math.factorial(r - 1))) if r else 0.0
        z = model.weights[0] + model.weights[1] * math.log1p(best) + model.weights[2] * math.log1p(both)
        x, found = model.features([t.encode()])
        assert model.score(x)[0] == pytest.approx(1 / (1 + math.exp(-z)), rel=1e-6)
        assert found[0] == [(a, b, s) for a, b, s, x in e if math.exp(-x) < model.max_e]


def test_extreme_value_parameters():
    """lambda solves its equation; best segments of texts drawn from the background follow the chances that K gives."""
    values, p = np.append(np.linspace(1, 4, 40), -0.5), np.append(np.full(40, 0.05 / 40), 0.95)
    lam = toxicity.karlin_lambda(values, p)
    assert float(np.sum(p * np.exp(lam * values))) == pytest.approx(1, abs=1e-6)
    rng = np.random.default_rng(16)
    best = []
    for _ in range(1500):
        drawn = rng.choice(41, 200, p=p)
        found = toxicity.maximal_segments([(i, float(values[x])) for i, x in enumerate(drawn) if x < 40], 0.5)
        best.append(max((s for *_, s in found), default=0.0))
    x, n = lam * np.array(best), np.full(len(best), 200.0)
    k = toxicity.fit_k(x, n)
    for q in (0.3, 0.1, 0.03):
        cut = np.quantile(x, 1 - q)
        assert math.exp(-toxicity.best_chance(cut - math.log(k * 200))) == pytest.approx(q, abs=0.06)


# ---------------------------------------------------------------- 10 near copies

def test_near_dedup(spark, odd, none):
    rng = random.Random(14)
    pairs, family = [], {}
    for f in range(25):
        words = prose(rng, 150, 3000).split()
        for k in range(rng.randrange(1, 30 if f < 2 else 4)):
            own = list(words)
            for _ in range(rng.randrange(0, 3) if k else 0):
                own[rng.randrange(len(own))] = f"z{rng.randrange(10**6)}"
            family[len(pairs)] = f
            pairs.append((len(pairs), " ".join(own)))
    docs = spark.createDataFrame(rows(pairs + ODD), SCHEMA)
    out = near_dedup.near_dedup(docs, all_pairs=6).collect()
    assert len(out) == len(pairs) + len(ODD)
    idf = near_dedup.learn_idf(docs.select(F.coalesce("text", F.lit("")).alias("text")))
    vec = [near_dedup.pack_vector(*near_dedup.weighted_shingles([t.encode()], idf)[:2]) for _, t in pairs]
    parent = list(range(len(pairs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(pairs)), 2):
        if family[a] == family[b] and near_dedup.weighted_jaccard(vec[a], vec[b]) >= 0.8:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = {r["row_id"]: r for r in out if r["row_id"] is not None and r["row_id"] < 7000}
    assert all(got[i]["class_id"] == root(i) for i in got)
    size = collections.Counter(root(i) for i in got)
    assert all(got[i]["class_size"] == size[root(i)] and got[i]["kept"] == (root(i) == i) for i in got)
    by = {(r["row_id"], r["class_id"]) for r in out if (r["row_id"] or 0) >= 7000}
    assert (7007, 7006) in by and (7003, 7001) in by and (7004, 7004) in by
    assert near_dedup.near_dedup(none).count() == 0


def test_picks_follow_weighted_similarity():
    """Share of equal band rows against the exact weighted Jaccard similarity."""
    rng = np.random.default_rng(15)
    sampler = near_dedup.Sampler.draw(400, 1)
    for same in (0.3, 0.8):
        a = rng.integers(1, 1 << 63, 300, dtype=np.uint64)
        b = a.copy()
        b[int(300 * 2 * same / (1 + same)) :] = rng.integers(1, 1 << 63, 300 - int(300 * 2 * same / (1 + same)), dtype=np.uint64)
        la, lb = rng.integers(2, 14, 300).astype(np.uint8), None
        lb = la.copy()
        lb[::9] += 2
        ka, kb = (sampler.band_keys(s, w, np.array([300]))[0] for s, w in ((a, la), (b, lb)))
        exact = near_dedup.weighted_jaccard(near_dedup.pack_vector(a, la), near_dedup.pack_vector(b, lb))
        assert abs((ka == kb).mean() - exact) < 0.09


def test_driver_draws_the_table_of_picks_in_little_more_than_its_size():
    tracemalloc.start()
    table = near_dedup.Sampler.draw(24, 5).picks
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 2 * table.nbytes


def test_near_dedup_in_a_template_family(spark):
    """Texts that share much of one template, most under the threshold to each other and to the centre, with true near
    copies among them: every pair at the threshold that shares a band is a link, against brute force."""
    rng = random.Random(22)
    template = prose(rng, 200, 5000).split()
    pairs = []
    for i in range(150):
        own = list(template)
        for at in rng.sample(range(200), 3):
            own[at] = f"z{i}x{at}"
        pairs.append((len(pairs), " ".join(own)))
        if i % 5 == 0:
            for at in rng.sample(range(200), 3):
                own[at] = f"y{i}x{at}"
            pairs.append((len(pairs), " ".join(own)))
    docs = spark.createDataFrame(rows(pairs), SCHEMA)
    idf = near_dedup.learn_idf(docs.select("text"))
    s, level, lens = near_dedup.weighted_shingles([t.encode() for _, t in pairs], idf)
    keys = near_dedup.Sampler.draw(4, 2).band_keys(s, level, lens)
    ends = np.cumsum(lens)
    vec = [near_dedup.pack_vector(s[e - n : e], level[e - n : e]) for e, n in zip(ends, lens, strict=True)]
    parent = list(range(len(pairs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    alike = [(a, b) for a, b in itertools.combinations(range(len(pairs)), 2) if near_dedup.weighted_jaccard(vec[a], vec[b]) >= 0.8 and (keys[a] == keys[b]).any()]
    for a, b in alike:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    assert 20 <= len(alike) and len({root(i) for i in range(len(pairs))}) > 50
    got = {r["row_id"]: r["class_id"] for r in near_dedup.near_dedup(docs, bands=4, rows=2, all_pairs=6).collect()}
    assert all(got[a] == got[b] for a, b in alike)
    for a, b in itertools.combinations(range(len(pairs)), 2):  # pairs without a band may be found too, but nothing else
        if near_dedup.weighted_jaccard(vec[a], vec[b]) >= 0.8:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    assert all(root(i) == root(got[i]) for i in got)


@pytest.mark.parametrize("n", [500])
def test_recall_against_all_pairs(spark, n):
    """Production bands: every pair at the threshold among all pairs is found, in buckets of any size: copies of many
    families, and 120 texts of one passage in 60 pairs at about 0.83, all others at about 0.79."""
    rng = random.Random(23)
    passage, pairs = prose(rng, 400, 6000).split(), []
    for i in range(60):
        two = [f"t{i}k{k}" for k in range(4)]
        for j in range(2):
            own = list(passage)
            for k, at in enumerate(range(10, 410, 100)):
                own[at - 10 : at - 9] = [passage[at - 10], two[k]]
            pairs.append((len(pairs), " ".join(own + [f"o{i}j{j}k{k}" for k in range(9)])))
    while len(pairs) < n:
        base = prose(rng, 120, 4000).split()
        for _ in range(rng.randrange(1, 5)):
            own = list(base)
            for at in rng.sample(range(120), rng.randrange(0, 3)):
                own[at] = f"q{rng.randrange(10**6)}"
            pairs.append((len(pairs), " ".join(own)))
    docs = spark.createDataFrame(rows(pairs), SCHEMA)
    idf = near_dedup.learn_idf(docs.select("text"))
    vec = []
    for _, t in pairs:
        s, level, _ = near_dedup.weighted_shingles([t.encode()], idf)
        vec.append(near_dedup.pack_vector(s, level))
    kinds = [set(np.frombuffer(v, np.uint64, len(v) // 9).tolist()) for v in vec]
    alike = [(a, b) for a, b in itertools.combinations(range(len(pairs)), 2) if len(kinds[a] & kinds[b]) > 20 and near_dedup.weighted_jaccard(vec[a], vec[b]) >= 0.8]
    got = {r["row_id"]: r["class_id"] for r in near_dedup.near_dedup(docs).collect()}
    assert len(alike) > 200 and sum(got[a] == got[b] for a, b in alike) / len(alike) > 0.995


def test_repetitive_texts_keep_their_counts():
    """One passage repeated a different number of times: true similarities are the ratios of the counts."""
    passage = " ".join(f"p{i}" for i in range(40)).encode()
    for idf, few, many in ((10.0, 100, 300), (5.0, 200, 2000), (2.0, 500, 6000)):
        s, level, lens = near_dedup.weighted_shingles([b" ".join([passage] * k) for k in (few, many)], near_dedup.Idf(np.zeros(0, np.uint64), np.zeros(0), idf))
        a, b = (near_dedup.pack_vector(s[lo:hi], level[lo:hi]) for lo, hi in ((0, lens[0]), (lens[0], lens.sum())))
        assert near_dedup.weighted_jaccard(a, b) == pytest.approx(few / many, rel=0.2)
        keys = near_dedup.Sampler.draw(60, 1).band_keys(s, level, lens)
        assert (keys[0] == keys[1]).mean() == pytest.approx(few / many, abs=0.2)


def test_components(spark):
    rng = random.Random(16)
    links = [(i, i + 1) for i in range(40)] + [(100 + rng.randrange(30), 100 + rng.randrange(30)) for _ in range(20)]
    links = [(a, b) for a, b in links if a != b]
    parent = {x: x for p in links for x in p}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {r["node"]: r["comp"] for r in near_dedup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}


def test_remainder_of_null(spark):
    assert spark.range(1).select(id_remainder("id", 7).alias("x"), id_remainder("id", 2)).first()["x"] == __import__("zlib").crc32(b"0") % 7


@pytest.mark.parametrize("many", [1, 5])
def test_line_dedup_compares_bytes(spark, monkeypatch, many):
    """With a few hashes only, all windows clash; what goes is what stands earlier byte by byte."""
    rng = random.Random(33)
    sentence = lambda: prose(rng, 9, 5000) + ". "
    shared = [sentence() for _ in range(3)]
    pairs = [(i, "".join([sentence(), *(shared if i % 2 else []), sentence(), sentence()])) for i in range(12)] + [(None, "".join(shared)), (1, "".join(shared) + "x")]
    docs = spark.createDataFrame(rows(pairs + ODD), SCHEMA)
    read = lambda: sorted(map(tuple, line_dedup.line_dedup(docs).collect()), key=str)
    want = read()
    few = lambda w: F.struct(w["place"].alias("place"), w["upto"].alias("upto"), F.pmod(w["h"], F.lit(many)).alias("h"))
    windows = line_dedup.windows
    monkeypatch.setattr(line_dedup, "windows", lambda *a: F.transform(windows(*a), few))
    assert read() == want and sum(r[2] > 0 for r in want if r[0] is not None and r[0] < 7000) == 7


def test_line_dedup_words_and_hashes_of_windows(spark):
    """Words counted by spaces equal split words; a passage is the same in plain texts and in texts with odd spaces, and
    only there where every unit but the space at its end is."""
    passage = "one two three four five six. seven eight nine ten eleven twelve. "
    texts = {1: "first here. " + passage + "tail one.", 2: "odd  spaces\there. " + passage + "x", 3: passage.rstrip() + "\n", 4: passage.replace("six", "sex"), 5: " lead\n \n" + passage, 6: "é ü. " + passage.strip()}
    units = ["", "\n", "a", "a b. ", "a b\n", "é ü ñ. ", "word"]
    plain = spark.createDataFrame([(x,) for x in units], "u string")
    found = plain.select("u", line_dedup.unit_words(plain["u"], F.lit(True)).alias("a"), line_dedup.unit_words(plain["u"], F.lit(False)).alias("b")).collect()
    assert all(r["a"] == r["b"] == len(r["u"].split()) for r in found)
    out = {r["row_id"]: r for r in line_dedup.line_dedup(spark.createDataFrame(rows(list(texts.items())), SCHEMA)).collect()}
    assert {i for i, r in out.items() if r["n_removed"]} == {2, 3, 5, 6}
    assert out[1]["text"] == texts[1] and out[4]["text"] == texts[4]
    assert out[2]["text"] == "odd  spaces\there. x" and out[5]["text"] == " lead\n \n" and out[6]["text"] == "é ü. " and out[3]["text"] == ""


@pytest.mark.parametrize("min_words, long_unit", [(8, 50), (1, 3), (20, 9)])
def test_line_dedup_windows(spark, min_words, long_unit):
    """Shortest windows onwards and backwards, and long units, by the definition; each once, equal hashes for equal texts only."""
    rng = random.Random(47)
    texts = ["", "\n", " ", *("".join(prose(rng, rng.choice((0, 1, 1, 2, 3, 4, 9, 55)), 9) + rng.choice((". ", "! ", ".\n", "\n", "  \n", "\t", "? ")) for _ in range(rng.randrange(1, 20))) for _ in range(150))]
    want, same = [], {}
    for t, text in enumerate(texts):
        u = re.findall(r".*?(?:\n|[.!?] )|.+", text)
        at = [i for i, x in enumerate(u) if x.split()]
        enough = lambda a, b: b > a and sum(len(u[i].split()) for i in at[a : b + 1]) >= min_words  # noqa: B023, E731
        pairs = [(a, b) for a in range(len(at)) for b in range(a, min(a + 1 + max(2, min_words), len(at))) if (enough(a, b) and not (enough(a, b - 1) and enough(a + 1, b))) or (a == b and len(u[at[a]].split()) >= long_unit)]
        want += [(t, at[a], at[b]) for a, b in pairs]
        same |= {(t, at[a], at[b]): "".join(u[at[a] : at[b] + 1]).rstrip(" \t\n") for a, b in pairs}
    docs = spark.createDataFrame([(t, t, x) for t, x in enumerate(texts)], "row_id long, doc_key long, text string")
    found = line_dedup._parts(docs, min_words, long_unit).collect()
    got = {tuple(r[1:4]): r["h"] for r in found}
    assert sorted(tuple(r[1:4]) for r in found) == sorted(want)
    assert len({(h, same[k]) for k, h in got.items()}) == len(set(got.values())) == len(set(same.values()))


def test_line_dedup_counts_a_window_once(spark, monkeypatch):
    """A window that is the shortest both from its first unit onwards and from its last backwards does not repeat by that."""
    written = {}
    keep = line_dedup.materialise
    monkeypatch.setattr(line_dedup, "materialise", lambda df, name: written.setdefault(name, keep(df, name)))
    docs = spark.createDataFrame(rows([(i, "".join(f"a{i} b{i}{k} c. " for k in range(9))) for i in range(20)]), SCHEMA)
    assert all(r["n_removed"] == 0 for r in line_dedup.line_dedup(docs).collect()) and written["line-repeated"].count() == 0
