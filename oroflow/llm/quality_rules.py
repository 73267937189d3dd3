"""Quality rules as a bitmask ledger, in DataFrame functions only.

`ledger` measures every text once and evaluates every rule once: bit i of fail_bits is set where rule i fails. Policies
are versioned sets of rules; applying one is a bitwise AND, and `ablations` counts in one aggregation what each rule of
each policy alone removes. Ledgers can be stored and judged later under other policies without reading a text again.

Defined results: a null text has no words and fails the base rules; texts are measured whole; rows that repeat get the
same row each; an empty table gives an empty ledger; other columns stay, but for those named like the ledger's own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, split_words

#: Name and condition of failure over the measurements; the place is the bit. New rules go to the end.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 10"),
    ("repeated_words", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "10 * n_symbols > 6 * n_words"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 20 * n_words"),
    ("repeated_lines", "10 * n_dup_lines > 5 * n_lines"),
    ("shouting", "2 * n_bangs > n_words"),
)
BASE = ("few_words", "repeated_words")
WINDOW = 5
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_bangs")


@dataclass(frozen=True)
class Policy:
    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << i for i, (name, _) in enumerate(RULES) if name in self.rules)


POLICIES = (
    Policy("base", 1, BASE),
    Policy("standard", 1, (*BASE, "symbols", "short_words", "long_words", "repeated_lines")),
    Policy("standard", 2, tuple(name for name, _ in RULES)),
)


def _repeated(words: Column) -> Column:
    """Words in windows that stand twice or more in the text. Only a text with a repeated window sorts its windows;
    neighbours that are equal in the sorted order are repeats, and each covers its words up to the next one."""
    windows = F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))
    in_order = lambda h: F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    same = lambda s, x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))
    places = lambda s: F.sort_array(F.transform(F.filter(s, lambda x, i: same(s, x, i)), lambda x: x["i"]))
    covers = lambda at: F.aggregate(F.transform(at, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)
    count = lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), let(let(in_order(h), places), covers)).otherwise(F.lit(0))
    return F.when(F.size(words) >= WINDOW, let(windows, count)).otherwise(F.lit(0))


def _measured(docs: DataFrame, text_col: str) -> DataFrame:
    """The measurements, as one expression over the text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    of_words = let(split_words(text_col), lambda w: F.struct(F.size(w).alias("n_words"), F.length(F.array_join(w, "")).alias("word_chars"), _repeated(w).alias("n_repeat_words")))
    of_lines = let(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")))
    out = docs.withColumn("__w", of_words).withColumn("__l", of_lines)
    symbols = F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))
    bangs = F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit("")))
    values = {"n_words": F.col("__w.n_words"), "word_chars": F.col("__w.word_chars"), "n_symbols": symbols, "n_bangs": bangs, "n_lines": F.col("__l.n_lines"), "n_dup_lines": F.col("__l.n_dup_lines"), "n_repeat_words": F.col("__w.n_repeat_words")}
    return out.withColumns({k: v.cast("long") for k, v in values.items()}).drop("__w", "__l")


def ledger(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the measurements and fail_bits."""
    docs = docs.select(*[c for c in docs.columns if c not in (*MEASURES, "fail_bits") or c == text_col])
    bits = [F.when(F.coalesce(F.expr(rule), F.lit(False)), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i, (_, rule) in enumerate(RULES)]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return _measured(docs, text_col).withColumn("fail_bits", total)


def passes(policy: Policy) -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(policy.mask).cast("long")) == 0


def ablations(rows: DataFrame, policies: tuple[Policy, ...] = POLICIES) -> DataFrame:
    """For each policy and rule: texts and words that fail it, and those that fail nothing else of the policy and so
    would stay without it. One pass: the ledger is first folded into counts of its distinct bit patterns."""
    patterns = rows.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"), F.sum("n_words").alias("words"))
    each = F.explode(F.array(*[F.struct(F.lit(p.name).alias("policy"), F.lit(p.version).alias("version"), F.lit(name).alias("rule"), F.lit(p.mask).cast("long").alias("mask"), F.lit(1 << i).cast("long").alias("bit")) for p in policies for i, (name, _) in enumerate(RULES) if name in p.rules]))
    at = patterns.select("*", each.alias("x")).select("fail_bits", "n", "words", "x.*").withColumn("hit", F.col("fail_bits").bitwiseAND(F.col("mask")))
    fails, alone = F.col("hit").bitwiseAND(F.col("bit")) != 0, F.col("hit") == F.col("bit")
    sums = {"n_fail": F.when(fails, F.col("n")), "words_fail": F.when(fails, F.col("words")), "n_only": F.when(alone, F.col("n")), "words_only": F.when(alone, F.col("words"))}
    return at.groupBy("policy", "version", "rule").agg(*[F.sum(F.coalesce(v, F.lit(0).cast("long"))).alias(k) for k, v in sums.items()])
