"""Secret scans: fixed patterns, and the guess cost of values that stand in credential contexts.

Patterns find assignments, access keys and runs of hexadecimal digits. A value that follows a credential word (`pwd: ...`,
`passphrase is ...`, `user:...@host`) and that no pattern found is cut into words, dates, repeats, keyboard walks and
brute-force characters so that the product of the guesses is smallest: a dynamic programme over its positions, linear in
its length. Values that cost `least_guesses` (log10) or more are secrets of kind `guess`. The ranks of words are counted
over the whole corpus; the `dictionary` most frequent ones go to the tasks, a bound that no corpus moves.

Defined results: a null or empty text has no secrets; every row, repeated or not, has its own result; all columns of the
input stay, those named like the result give way; an empty table gives no rows; values are read to their end.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, byte_slices, most_frequent, with_columns_schema

# The patterns of the contract, the order in which kinds are listed, and the rows of a keyboard.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "guess")
LEAST = {"assign": 12, "access": 18, "hex": 16}
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")

_ASSIGN = re.compile(ASSIGN, re.I | re.A)
_ACCESS, _HEX = re.compile(ACCESS), re.compile(HEX)
_KEYS = r"pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credentials?|auth"
_VALUE = r"""(?:"([^"\n]+)"|'([^'\n]+)'|([^\s"'<>,;]+))"""
_CONTEXT = re.compile(rf"(?<![A-Za-z])(?:{_KEYS})[\"']?(?:\x20{{0,3}}(?:=>|:=|[:=])|\x20(?:is|was))\x20{{0,3}}{_VALUE}", re.I | re.A)
_BEARER = re.compile(r"\bbearer\x20+([^\s\"'<>,;]+)", re.I | re.A)
_URL = re.compile(r"://[^\s:/@]+:([^\s/@]+)@", re.A)
_LEET = str.maketrans("430157@$", "aeoistas")
_DATE = re.compile(r"(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])([-/._]?)(?:0?[1-9]|1[0-2])\2(?:19|20)\d\d|(?:19|20)\d\d", re.A)


def _neighbours() -> frozenset:
    """Pairs of keys that touch: beside each other, or in the next row a little to the left or right."""
    pairs = set()
    for r, row in enumerate(ROWS):
        for i, key in enumerate(row):
            beside = row[i + 1 : i + 2]
            below = ROWS[r + 1][max(0, i - 1) : i + 1] if r + 1 < len(ROWS) else ""
            pairs |= {(key, x) for x in beside + below} | {(x, key) for x in beside + below}
    return frozenset(pairs)


_TOUCH = _neighbours()
_LONGEST = 24  # code points of a dictionary word


def _char_cost(value: str) -> list[float]:
    """Brute force: the size of the character's class; letters of a value that has nothing else, as prose has them, 10."""
    if value.isalpha():
        return [1.0] * len(value)
    size = lambda c: 10 if c.isdigit() else 26 if c.isalpha() else 33
    return [math.log10(size(c)) for c in value]


def segments(value: str, ranks: dict[str, int]) -> Iterator[tuple[int, int, float]]:
    """All matches (start, end, log10 of guesses) but brute force."""
    low = value.lower()
    if len(low) != len(value):  # a letter that lower-cases to two
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    plain = low.translate(_LEET)
    n = len(value)
    for i in range(n):
        for j in range(i + 3, min(n, i + _LONGEST) + 1):
            rank = ranks.get(low[i:j])
            swapped = 0
            if rank is None and plain[i:j] != low[i:j]:
                rank = ranks.get(plain[i:j])
                swapped = sum(a != b for a, b in zip(plain[i:j], low[i:j], strict=True))
            if rank is not None:
                upper = sum(a != b for a, b in zip(value[i:j], low[i:j], strict=True))
                case = 0 if not upper else 1 if upper == j - i or upper == 1 and value[i] != low[i] else upper
                yield i, j, math.log10(rank) + (swapped + case) * math.log10(2)
    for i in range(n):
        found = _DATE.match(value, i)
        if found:
            digits = sum(c.isdigit() for c in found[0])
            yield i, found.end(), math.log10(100) if digits == 4 else math.log10(100 * 366) + (math.log10(4) if digits < len(found[0]) else 0)
    cost = np.concatenate([[0], np.cumsum(_char_cost(value))])
    for period in range(1, 9):  # maximal runs of one period
        i = 0
        while i + period < n:
            j = i
            while j + period < n and value[j] == value[j + period]:
                j += 1
            times = (j - i) // period + 1
            if times > 2 or times > 1 and period > 2:
                yield i, i + times * period, float(cost[i + period] - cost[i]) + math.log10(times)
            i = max(j, i + 1)
    i = 0
    while i < n - 1:  # maximal walks
        j = i
        while j + 1 < n and (low[j], low[j + 1]) in _TOUCH:
            j += 1
        if j - i >= 3:
            steps = [(a, b) for a, b in zip(low[i:j], low[i + 1 : j + 1], strict=True)]
            straight = [any(b in row and a in row and row.index(b) - row.index(a) == d for row in ROWS) for d in (1, -1) for a, b in steps]
            turns = 1 + sum(1 for k in range(1, len(steps)) if (straight[k], straight[k + len(steps)]) != (straight[k - 1], straight[k - 1 + len(steps)]) or not (straight[k] or straight[k + len(steps)]))
            yield i, j + 1, math.log10(36 * (j - i + 1)) + turns * math.log10(6)
        i = max(j, i + 1)


def guess_cost(value: str, ranks: dict[str, int]) -> float:
    """log10 of the guesses of the cheapest way to cut the value into segments."""
    ending: dict[int, list[tuple[int, float]]] = {}
    for i, j, c in segments(value, ranks):
        ending.setdefault(j, []).append((i, c))
    best = [0.0]
    for j, c in enumerate(_char_cost(value), 1):
        best.append(min([best[j - 1] + c, *(best[i] + s for i, s in ending.get(j, ()))]))
    return best[-1]


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """Matches of the fixed patterns: start, kind, end; leftmost and not overlapping within a kind, short ones dropped."""
    found = [(m.start(), "assign", m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    found += [(m.start(), k, m.end()) for k, p in (("access", _ACCESS), ("hex", _HEX)) for m in p.finditer(text) if len(m[0]) >= LEAST[k]]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[1])))


def valued_spans(text: str, base: list[tuple[int, str, int]], ranks: dict[str, int], least_guesses: float, least_chars: int) -> list[tuple[int, int, float]]:
    """Values in credential contexts that the patterns do not touch and that are hard to guess: start, end, log10."""
    values = set()
    for m in _CONTEXT.finditer(text):
        values.add(next(m.span(g) for g in (1, 2, 3) if m[g] is not None))
    values |= {m.span(1) for p in (_BEARER, _URL) for m in p.finditer(text)}
    out, end = [], 0
    for a, b in sorted(values):
        value = text[a:b].rstrip(".!?)]}")
        b = a + len(value)
        if a < end or len(value) < least_chars or any(s < b and a < e for s, _, e in base):
            continue
        cost = guess_cost(value, ranks)
        if cost >= least_guesses:
            out.append((a, b, cost))
            end = b
    return out


def word_ranks(docs: DataFrame, text_col: str = "text", dictionary: int = 20_000) -> dict[str, int]:
    """Ranks of the most frequent words of three to 24 letters, counted over all texts; `dictionary` of them at most."""
    run = re.compile(rb"[a-z]{3,}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in byte_slices(batches, "text"):
            found: Counter = Counter()
            for text in texts:
                found.update(run.findall(text.lower()))
            kept = [(w, n) for w, n in found.items() if len(w) <= _LONGEST]
            yield pa.RecordBatch.from_pydict({"word": pa.array([w for w, _ in kept], pa.binary()).cast(pa.string()), "n": pa.array([n for _, n in kept], pa.int64())})

    counts = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    rows = most_frequent(counts.filter("n > 1"), "n", dictionary).orderBy(F.desc("n"), "word").limit(dictionary).collect()
    return {r["word"]: k for k, r in enumerate(rows, 1)}


def find_secrets(docs: DataFrame, text_col: str = "text", ranks: dict[str, int] | None = None, least_guesses: float = 10.0, least_chars: int = 8) -> DataFrame:
    """docs with `secrets`: array of (kind, start, end, guesses), by start and kind; places are code points, ends exclusive;
    guesses is null but for kind `guess`."""
    ranks = word_ranks(docs, text_col) if ranks is None else ranks
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    kind = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("guesses", T.DoubleType())]))
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("guesses", pa.float64())]))
    hint = rf"(?i:pass|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credential|auth|bearer)|://|AKIA|[0-9a-f]{{{LEAST['hex']}}}"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in byte_slices(batches, text_col):
            worth = pc.match_substring_regex(pa.array(texts, pa.binary()), hint).to_pylist()
            out = []
            for text, look in zip(texts, worth, strict=True):
                if not look:
                    out.append([])
                    continue
                text = text.decode("utf-8", "replace")
                base = base_spans(text)
                found = [(a, k, b, None) for a, k, b in base] + [(a, "guess", b, c) for a, b, c in valued_spans(text, base, shared.value, least_guesses, least_chars)]
                out.append([{"kind": k, "start": a, "end": b, "guesses": c} for a, k, b, c in sorted(found, key=lambda x: (x[0], KINDS.index(x[1])))])
            yield append_columns(part, secrets=pa.array(out, arrow))

    return docs.mapInArrow(scan, with_columns_schema(docs, secrets=kind))
