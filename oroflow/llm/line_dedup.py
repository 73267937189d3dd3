"""Removal of runs of units that repeat across the corpus, in DataFrame functions only.

A text's units are its lines, and the sentences of its lines. A run is two or more units in a row (units without a word
do not count) with min_words words or more, or one unit of long_unit words or more. A unit is removed where it lies in a
run that stands at an earlier (id, place) too, wherever the run begins or ends and however unlike its neighbours are: all
shortest runs, from each unit onwards and from each unit backwards, are windows; each longer common run is the union of
the windows in it. Units are measured once; windows, each once, and their rolling hashes over the hashes of their units are
compiled. Hashes are counted first (small rows, combined on the map side). Windows whose hash repeats are cut out of their
texts again and compared byte by byte: a hash only finds them, runs are the same where their bytes are. The white space that
ends a window is not compared.

Defined results: a null text stays null; one unit of fewer than long_unit words or a run of fewer than min_words words
alone is never removed; each removed unit stays at its first place; rows that repeat id and text are one row to the
operator: a run of theirs that stands nowhere else stays in all of them; rows that share an id but not a text are told
apart by a hash of the text, and one of them is first; a null id comes first; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, let, materialise, split_words, spread_join

_MARK = "\x01"
_BLANK = " \n\r\t\x0b\x0c"
_NEAR = 8  # units in a window that is found in compiled expressions, at most


def units(text: Column) -> Column:
    """Lines with their ends and sentences with the space after them; joined, they are the text again."""
    marked = text
    for end in ("\n", ". ", "! ", "? "):
        marked = F.replace(marked, F.lit(end), F.lit(end + _MARK))
    return F.when(F.contains(text, F.lit(_MARK)), F.split(text, r"(?<=\n|[.!?] )")).otherwise(F.split(marked, _MARK))


def unit_words(unit: Column, plain: Column) -> Column:
    """Words of a unit. In a plain text (single spaces only, none at the ends of a line) they are counted by spaces."""
    spaces = F.octet_length(unit) - F.octet_length(F.replace(unit, F.lit(" "), F.lit("")))
    last = F.when(unit.isin("", "\n") | unit.endswith(" "), 0).otherwise(1)
    return F.when(plain, spaces + last).otherwise(F.size(split_words(unit)))


def bare(x: Column) -> Column:
    return F.rtrim(x, F.lit(_BLANK))


def _pick(when: Column, then: Column, other: Column) -> Column:
    return F.call_function("if", when, then, other)


def _place(at: Column, k: Column) -> Column:
    return _pick(at.isNull(), k, F.get(at, k))


def measured(text: Column, min_words: int) -> Column:
    """What windows reads of a text, unit by unit that has a word: at (place, null where it is the index), n (words), h (hash
    of the unit and of those without a word after it), bare (hash without the white space at its end); and rest, the
    windows of more than _NEAR units (with min_words up to that: none). Null for a null text."""
    most = max(2, min_words)  # units in a window: each has a word
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("len"))
    full = lambda a: (a["n"] >= min_words) & (a["len"] >= 2)
    reach = lambda n: F.aggregate(n, start, lambda a, x: _pick(full(a), a, F.struct((a["n"] + x).alias("n"), (a["len"] + 1).alias("len"))), lambda a: F.when(full(a), a))
    # a unit of a plain text (single spaces only, none at the ends of a line) ends with one space or line break at most
    trimmed = lambda u, plain: _pick(plain, F.transform(u, lambda x: F.rtrim(F.substring_index(x, "\n", 1))), F.transform(u, bare))
    words = lambda t, plain: _pick(plain, F.transform(t, lambda x: unit_words(x, F.lit(True))), F.transform(t, lambda x: unit_words(x, F.lit(False))))
    hashes = lambda x: F.transform(x, lambda y: F.xxhash64(y))
    told = lambda u, plain: let(trimmed(u, plain), lambda t: F.struct(words(t, plain).alias("n"), hashes(u).alias("h"), hashes(t).alias("bare")))
    of = lambda at, n, h, bare: F.struct(at.cast("array<int>").alias("at"), n.alias("n"), h.alias("h"), bare.alias("bare"))
    worded = lambda n: F.filter(F.transform(n, lambda x, i: F.when(x > 0, i)), lambda i: i.isNotNull())
    joined = lambda t, at: F.transform(at, lambda i, k: _pick(F.coalesce(F.get(at, k + 1), i + 1) == i + 1, F.get(t["h"], i), F.xxhash64(F.slice(t["h"], i + 1, F.get(at, k + 1) - i))))
    sparse = lambda t: let(worded(t["n"]), lambda at: of(at, F.transform(at, lambda i: F.get(t["n"], i)), joined(t, at), F.transform(at, lambda i: F.get(t["bare"], i))))
    # most texts have a word in every unit, or in all but the last
    dense = lambda t: let(F.array_position(t["n"], 0), lambda z: _pick(z == 0, of(F.lit(None), t["n"], t["h"], t["bare"]), _pick(z == F.size(t["n"]), of(F.lit(None), F.slice(t["n"], 1, F.size(t["n"]) - 1), t["h"], t["bare"]), sparse(t))))
    few = lambda n: F.filter(F.transform(n, lambda x, k: F.when(reduce(lambda a, b: a + b, (F.get(n, k + j) for j in range(1, _NEAR)), x) < min_words, k)), lambda k: k.isNotNull())
    window = lambda p, a, b: F.struct(_place(p["at"], a).alias("place"), _place(p["at"], b).alias("upto"), F.xxhash64(F.slice(p["h"], a + 1, b - a), F.get(p["bare"], b)).alias("h"))
    onwards = lambda p, k: let(reach(F.slice(p["n"], k + 1, most)), lambda r: F.when(r.isNotNull(), window(p, k, k + r["len"] - 1)))
    # a window that is not enough without its last unit is one onwards already
    backwards = lambda p, k: let(reach(F.reverse(F.slice(p["n"], F.greatest(k - most + 2, F.lit(1)), F.least(k + 1, F.lit(most))))), lambda r: F.when(r["n"] - F.get(p["n"], k) >= min_words, window(p, k + 1 - r["len"], k)))
    rest = lambda p: let(few(p["n"]), lambda ks: F.filter(F.concat(F.transform(ks, lambda k: onwards(p, k)), F.transform(ks, lambda k: backwards(p, k + _NEAR - 1))), lambda w: w.isNotNull()))
    longer = rest if most > _NEAR else lambda p: F.lit(None).cast("array<struct<place:int,upto:int,h:bigint>>")
    plain = ~reduce(lambda a, b: a | b, (F.contains(text, F.lit(x)) for x in ("  ", "\t", "\r", "\x0b", "\x0c", "\n ", " \n"))) & ~text.startswith(" ")
    every = let(plain, lambda x: let(units(text), lambda u: let(let(told(u, x), dense), lambda p: F.struct(*(p[x].alias(x) for x in ("at", "n", "h", "bare")), longer(p).alias("rest")))))
    return F.when(text.isNotNull(), every)


def _lengths(told: DataFrame, min_words: int, long_unit: int) -> DataFrame:
    """told with k, each unit with a word, and len, the units of each window from it onwards: those that are enough, and of
    three units or more not without the first or not without the last; 1 for a long unit alone; 0 (once a text) for rest.
    Without lambdas, so that it is compiled."""
    near = min(_NEAR, max(2, min_words))
    # outer: of a plain explode Spark infers a filter that would measure every text twice
    told = told.select("*", F.posexplode_outer("n").alias("k", "s1"))
    for j in range(2, near + 1):
        told = told.withColumn(f"s{j}", F.col(f"s{j - 1}") + F.get("n", F.col("k") + (j - 1)))
    sums = [F.col(f"s{j}") for j in range(1, near + 1)]
    number = lambda conds: reduce(lambda a, b: a + b, (_pick(c, F.lit(1), F.lit(0)) for c in conds))
    told = told.withColumn("least", F.greatest(number(x < min_words for x in sums) + 1, F.lit(2))).withColumn("most", number(x - sums[0] < min_words for x in sums))
    told = told.withColumn("most", F.greatest("least", "most"))
    none = F.array().cast("array<int>")
    own = _pick(F.col("least") <= F.least(F.size("n") - F.col("k"), F.lit(near)), F.sequence("least", "most"), none)
    odd = F.concat(_pick(F.col("s1") >= long_unit, F.array(F.lit(1)), none), _pick((F.col("k") == 0) & F.col("rest").isNotNull(), F.array(F.lit(0)), none))
    lens = _pick((F.col("s1") >= long_unit) | (F.col("k") == 0), F.concat(own, odd), own)
    return told.drop(*(f"s{j}" for j in range(2, near + 1))).select("row_id", "doc_key", "k", "at", "h", "bare", "rest", F.explode_outer(lens).alias("len"))


def windows(k: Column, length: Column, at: Column, h: Column, bare: Column, rest: Column) -> Column:
    """Array of (place, upto, h): first and last unit of the window of so many units from the k-th with a word onwards, and a
    hash over the hashes of its units, of the last one without its white space; rest for no length."""
    last = k + length - 1
    # the hash of an array is the chained hash of its elements, so that both forms of two units agree
    rolled = _pick(length == 2, F.xxhash64(F.get(h, k), F.get(bare, last)), F.xxhash64(F.slice(h, k + 1, length - 1), F.get(bare, last)))
    return _pick(length == 0, rest, F.array(F.struct(_place(at, k).alias("place"), _place(at, last).alias("upto"), rolled.alias("h"))))


def _parts(rows: DataFrame, min_words: int, long_unit: int) -> DataFrame:
    """row_id, doc_key, place, upto and h: each window of each row, once."""
    told = rows.select("row_id", "doc_key", measured(F.col("text"), min_words).alias("m")).select("row_id", "doc_key", "m.*")
    lengths = _lengths(told, min_words, long_unit).filter("len is not null")
    found = lengths.select("row_id", "doc_key", F.explode_outer(windows(*map(F.col, ("k", "len", "at", "h", "bare", "rest")))).alias("w"))
    return found.filter("w.place is not null").select("row_id", "doc_key", "w.*")


def _runs(rows: DataFrame, met: DataFrame) -> DataFrame:
    """row_id, doc_key, place, upto, h and run, the text of each window in met, cut out of its row again."""
    wanted = met.groupBy("doc_key").agg(F.collect_set(F.struct("place", "upto", "h")).alias("w")).select(F.col("doc_key").alias("__k"), "w")
    at = rows.join(wanted.hint("merge"), F.col("doc_key") == F.col("__k"))
    run = lambda u, w: bare(F.array_join(F.slice(u, w["place"] + 1, w["upto"] - w["place"] + 1), ""))
    cut = let(units(F.col("text")), lambda u: F.transform("w", lambda w: F.struct(w["place"].alias("place"), w["upto"].alias("upto"), w["h"].alias("h"), run(u, w).alias("run"))))
    # outer: of a plain explode Spark infers a filter that would cut every text twice
    return at.select("row_id", "doc_key", F.explode_outer(cut).alias("x")).select("row_id", "doc_key", "x.*")


def _first(at: DataFrame, *keys: str) -> DataFrame:
    """keys, first: where each stands first, by id (null first), key of the row and place."""
    return at.groupBy(*keys).agg(F.min(F.struct(F.col("row_id").isNotNull().alias("known"), "row_id", "doc_key", "place")).alias("first"))


def _elsewhere() -> Column:
    return (F.col("doc_key") != F.col("first.doc_key")) | (F.col("place") != F.col("first.place"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 8, long_unit: int = 50) -> DataFrame:
    """One row for each row of docs: row_id, text (what is left), n_removed (runs), removed_chars."""
    rows = docs.select(F.col(id_col).cast("long").alias("row_id"), F.col(text_col).alias("text"))
    # 128 bits of id and text; what is null is told apart from what hashes alike by the id beside it
    rows = rows.withColumn("doc_key", F.struct(F.xxhash64("row_id", "text").alias("a"), F.xxhash64("text", F.lit(7), "row_id").alias("b")))
    parts = materialise(_parts(rows, min_words, long_unit), "line-windows")
    seen = materialise(parts.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "line-repeated")
    n_rows = seen.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    met = materialise(spread_join(parts, seen.select("h").hint("shuffle_hash"), "h", counts=seen, rows=n_rows).select("row_id", "doc_key", "place", "upto", "h"), "line-met")
    discard(parts)  # the largest table; nothing reads it any more
    # the texts of a hash, byte by byte: nearly always one, and then the first of the hash is the first of the text
    texts = _runs(rows, met).select("h", "run").distinct().groupBy("h").agg(F.count(F.lit(1)).alias("k"))
    classes = materialise(_first(met, "h").join(texts, "h"), "line-classes")
    one = spread_join(met, classes.filter("k = 1").select("h", "first").hint("shuffle_hash"), "h", counts=seen, rows=n_rows)
    other = one.filter(_elsewhere()).select("doc_key", "place", "upto")
    clash = classes.filter("k > 1").select("h")
    if not clash.isEmpty():  # a hash of several texts: each is a run of its own
        runs = materialise(_runs(rows, met.join(clash, "h", "left_semi")), "line-clashes")
        several = runs.join(_first(runs, "h", "run"), ["h", "run"]).filter(_elsewhere())
        other = other.unionAll(several.select("doc_key", "place", "upto"))
    gone = other.groupBy("doc_key").agg(F.collect_set(F.struct("place", "upto")).alias("w"))
    covered = F.array_distinct(F.flatten(F.transform("w", lambda w: F.sequence(w["place"], w["upto"]))))
    gone = materialise(gone.select(F.col("doc_key").alias("__k"), covered.alias("gone")), "line-gone")
    # the same plan at every size: as a broadcast, the list of what goes would grow with the corpus
    out = rows.join(gone.hint("merge"), F.col("doc_key") == F.col("__k"), "left").select("row_id", F.col("text").alias("whole"), "gone")
    kept = lambda u: F.transform(F.array_except(F.sequence(F.lit(0), F.size(u) - 1), F.col("gone")), lambda i: F.get(u, i))
    left = F.array_join(let(units(F.when(F.col("gone").isNotNull(), F.col("whole"))), kept), "")
    runs = F.size(F.array_except("gone", F.transform("gone", lambda i: i + 1)))
    out = out.select("row_id", F.when(F.col("gone").isNull(), F.col("whole")).otherwise(left).alias("text"), F.coalesce(F.when(F.col("gone").isNotNull(), runs), F.lit(0)).cast("long").alias("n_removed"), F.length("whole").alias("chars"))
    return out.select("row_id", "text", "n_removed", F.coalesce(F.col("chars") - F.length("text"), F.lit(0)).cast("long").alias("removed_chars"))
