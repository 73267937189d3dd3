"""Mixing sources to target weights by cube-method balanced sampling.

Targets: sources in code-point order (null last) weigh 5, 2, 1, repeating, and share a multiple of all sizes by weight;
a target stops at `cap` times its source's size and the excess is shared again by weight. A row's inclusion is then
target / source size: its whole part is taken as it is, its fraction by the cube method. The flight phase runs in
blocks of bounded size and moves the fractions along the null space of the constraints (words taken, rows taken) until
two rows of a block at most stay undecided; those go on to the next level, a thousandth as large, until one block a
source is left, whose last rows land on the choice nearest to the wanted words.

Defined results: a null size is 0; sources of size 0 take nothing; rows that repeat are drawn each for itself, dealt
apart by their number among equals; draws depend on ids, sizes and the seed only, so reruns agree; an empty table gives
an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, numbered_copies, spread_join

FLIGHT_SCHEMA = "row_id long, size long, source string, rank long, source_size long, target double, whole long, pi double, key long"


def global_rank(df: DataFrame, column: str, name: str) -> DataFrame:
    """Rows numbered from 0 in the order of a column, nulls last, without sorting all in one task: counts of the sorted
    partitions give each one's first number."""
    placed = materialise(df.orderBy(F.col(column).asc_nulls_last()).withColumn("__part", F.spark_partition_id()), "ranked")
    before, offsets = 0, []
    for r in placed.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).orderBy("__part").collect():
        offsets.append((r["__part"], before))
        before += r["n"]
    if not offsets:
        return placed.drop("__part").withColumn(name, F.lit(0).cast("long"))
    first = df.sparkSession.createDataFrame(offsets, "__part int, __first long")
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(F.col(column).asc_nulls_last()))
    return placed.withColumn("__in", inside).join(first, "__part").withColumn(name, F.col("__first") + F.col("__in") - 1).drop("__part", "__in", "__first")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """sizes: source, source_size, rows. Adds rank and target. The level of the fill is found by aggregates over the
    table of sources; each round caps at least one more source, and a few suffice."""
    ranked = global_rank(sizes, "source", "rank")
    by_place = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = materialise(ranked.withColumn("weight", by_place), "sources")
    limit = F.col("source_size") * cap
    total = float(ranked.agg(F.sum("source_size")).first()[0] or 0) * share
    level, known = None, -1
    while True:
        full = F.lit(False) if level is None else limit <= F.col("weight") * level
        r = ranked.agg(F.sum(F.when(full, limit).otherwise(0.0)).alias("held"), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open"), F.count_if(full).alias("n")).first()
        if r["n"] == known or not r["open"]:
            break
        known, level = r["n"], (total - r["held"]) / r["open"]
    return ranked.withColumn("target", F.least(limit, F.col("weight") * (level or 0.0)))


def _step(pi: list[float], a: list[float], b: list[float], toss: float) -> None:
    """Move two or three active fractions along the null space of rows (a, b) until one is 0 or 1."""
    if len(pi) == 3:
        u = [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
        if not any(u):  # the three constraint columns lie on one line
            u = [1.0, -1.0, 0.0] if a[0] == a[1] else [0.0, 1.0, -1.0]
    else:
        u = [1.0, -1.0]
    up = min(((1 - p) / v if v > 0 else p / -v) for p, v in zip(pi, u, strict=True) if v)
    down = min((p / v if v > 0 else (1 - p) / -v) for p, v in zip(pi, u, strict=True) if v)
    move = up if toss * (up + down) < down else -down
    for i, v in enumerate(u):
        p = pi[i] + move * v
        pi[i] = 0.0 if p < 1e-9 else 1.0 if p > 1 - 1e-9 else p


def flight(pi: np.ndarray, size: np.ndarray, seed: int) -> np.ndarray:
    """The flight phase over one block: sums of pi and of pi * size stay as they were; two fractions at most are left
    (more than one only where their sizes differ)."""
    pi = np.array(pi, float)
    pi[pi < 1e-9], pi[pi > 1 - 1e-9] = 0.0, 1.0
    scale = max(1.0, float(np.mean(size))) if len(size) else 1.0
    rng = np.random.Generator(np.random.PCG64(seed))
    active: list[int] = []
    waiting = iter(np.flatnonzero((pi > 0) & (pi < 1)).tolist())
    out, a = pi.tolist(), (np.asarray(size, float) / scale).tolist()
    while True:
        while len(active) < 3 and (k := next(waiting, None)) is not None:
            active.append(k)
        if len(active) < 3 and not (len(active) == 2 and a[active[0]] == a[active[1]]):
            return np.array(out)
        now = [out[k] for k in active]
        _step(now, [a[k] for k in active], [1.0] * len(active), rng.random())
        for k, p in zip(active, now, strict=True):
            out[k] = p
        active = [k for k in active if 0 < out[k] < 1]


def landing(pi: np.ndarray, size: np.ndarray, wanted: np.ndarray, flips: int = 8) -> np.ndarray:
    """Round the last fractions (two at most) to the choice whose words, then rows, come nearest to the wanted ones; then
    turn over a few rows that had a fraction at first, as long as that brings the words nearer still."""
    left = np.flatnonzero((pi > 0) & (pi < 1))
    best = None
    for choice in range(1 << len(left)):
        take = np.array([choice >> i & 1 for i in range(len(left))], float)
        off = (abs(float(np.dot(take - pi[left], size[left]))), abs(float(np.sum(take - pi[left]))), choice)
        if best is None or off < best[0]:
            best = (off, take)
    out = pi.copy()
    out[left] = best[1]
    free = np.flatnonzero((wanted > 1e-9) & (wanted < 1 - 1e-9))
    for _ in range(flips if len(free) else 0):
        off = float(np.dot(out - wanted, size))
        after = np.abs(off + size[free] * (1 - 2 * out[free]))
        k = int(after.argmin())
        if after[k] >= abs(off) - 0.5:
            break
        out[free[k]] = 1 - out[free[k]]
    return out


def _flyer(last: bool, level: int, seed: int, columns: list[str]):
    def fly(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "key", "row_id"], ascending=[False, True, True], kind="stable")  # the last to be decided are small
        size = pdf["size"].to_numpy(float)
        wanted = pdf["pi"].to_numpy(float)
        pi = flight(wanted, size, (seed + 1_000_003 * int(key[0]) + 7919 * int(key[1]) + level) % (1 << 63))
        return pdf.assign(pi=landing(pi, size, wanted) if last else pi)[columns]

    return fly


def balanced_mix(rows: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, block_rows: int = 2000, seed: int = 0) -> DataFrame:
    """rows: row_id long, size long, source string. Adds source_size, target, copies (times the row is taken), taken."""
    rows = materialise(numbered_copies(rows.select("row_id", F.coalesce("size", F.lit(0)).cast("long").alias("size"), "source")), "mix-rows")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    targets = materialise(source_targets(sizes, weights, share, cap), "mix-targets")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    named = F.concat(F.when(F.col("source").isNull(), "-").otherwise("="), F.coalesce("source", F.lit("")))  # null is a source
    blocks = targets.select(named.alias("s"), "rank", "source_size", "target", "n")
    at = spread_join(rows.withColumn("s", named), blocks, "s", counts=targets.select(named.alias("s"), "n"))
    at = at.withColumn("ratio", ratio).withColumn("whole", F.floor("ratio")).withColumn("pi", F.col("ratio") - F.col("whole")).withColumn("key", F.xxhash64(F.lit(seed), "row_id", "size", "__copy"))
    columns = ["row_id", "size", "source", "rank", "source_size", "target", "whole", "pi", "key"]
    most = int(targets.agg(F.max("n")).first()[0] or 0)
    parts = F.ceil(F.col("n") / block_rows)
    at = at.select(*columns, F.pmod("key", parts).alias("block"))
    done = []
    level = 0
    while True:
        last = most <= block_rows
        flown = materialise(at.groupBy("rank", "block").applyInPandas(_flyer(last, level, seed, columns), FLIGHT_SCHEMA), f"mix-level{level}")
        undecided = (F.col("pi") > 0) & (F.col("pi") < 1)
        done.append(flown.filter(~undecided))
        if last:
            break
        level += 1
        counts = flown.filter(undecided).groupBy("rank").agg(F.count(F.lit(1)).alias("n"))
        counts = materialise(counts, "mix-undecided")
        most = int(counts.agg(F.max("n")).first()[0] or 0)
        at = flown.filter(undecided).join(counts, "rank").select(*columns, F.pmod(F.xxhash64("key", F.lit(level)), F.ceil(F.col("n") / block_rows)).alias("block"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    copies = F.col("whole") + F.rint("pi").cast("long")
    return out.select("row_id", "size", "source", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
