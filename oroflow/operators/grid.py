"""Rasters as cell tables (r, c, z): terrain models, neighbours, moving windows and rays.

A cell table is long and sparse-safe: a cell without data is a row with null z, or no row. Windows never span a whole
row or column of a raster: cells are dealt into blocks of BLOCK, with copies of the cells that a block needs from its
neighbours, so a window's group is bounded however large the raster is, and all of it stays in whole-stage codegen. What
does not come apart into rows and columns (medians, rays) is worked out in NumPy over one block with its halo at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK = 512
#: Direction codes 0-7: row step, column step.
D8_STEPS = ((0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1))
NEIGHBOURS = {"e": (0, 1), "se": (1, 1), "s": (1, 0), "sw": (1, -1), "w": (0, -1), "nw": (-1, -1), "n": (-1, 0), "ne": (-1, 1)}


def terrain_model(spark: SparkSession, sf_dir: str, holes: bool = False) -> DataFrame:
    """The terrain that the test tables hold: vec_id is the row, the place in the vector the column, z the value in
    metres; with holes, cells without data on a fixed pattern. Joins sort and merge: the files' size is not that of the cells."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    cells = vectors.select(F.col("vec_id").cast("int").alias("r"), F.posexplode("embedding").alias("c", "e"))
    z = F.round(F.lit(500.0) + F.col("e").cast("double") * 1000.0)
    return cells.select("r", "c", (F.when((F.col("r") * 31 + F.col("c") * 17) % 97 != 0, z) if holes else z).alias("z")).hint("merge")


def _blocks(axis: str, halo: int) -> Column:
    """The blocks along an axis that need the cell: its own, and its neighbours' where it is within halo of them."""
    at = F.col(axis)
    return F.sequence(F.floor((at - halo) / BLOCK), F.floor((at + halo) / BLOCK))


def _dealt(cells: DataFrame, axis: str, halo: int) -> DataFrame:
    return cells.withColumn("__block", F.explode(_blocks(axis, halo)))


def _own(cells: DataFrame, axis: str) -> DataFrame:
    return cells.filter(F.col("__block") == F.floor(F.col(axis) / BLOCK)).drop("__block")


def with_neighbours(cells: DataFrame, value: str = "z") -> DataFrame:
    """Adds n, s, w, e, nw, ne, sw, se: the values of the eight neighbours, null where there is none."""
    down = Window.partitionBy("c", "__block").orderBy("r")
    step = lambda f, axis, by, what, over: F.when(f(axis, 1).over(over) == F.col(axis) + by, f(what, 1).over(over))
    rows = _dealt(cells, "r", 1).withColumns({"n": step(F.lag, "r", -1, value, down), "s": step(F.lead, "r", 1, value, down)})
    rows = _own(rows, "r")
    across = Window.partitionBy("r", "__block").orderBy("c")
    found = {}
    for f, by, side in ((F.lag, -1, "w"), (F.lead, 1, "e")):
        found |= {side: step(f, "c", by, value, across), f"n{side}": step(f, "c", by, "n", across), f"s{side}": step(f, "c", by, "s", across)}
    return _own(_dealt(rows, "c", 1).withColumns(found), "c")


def extent(cells: DataFrame) -> DataFrame:
    """One row: r0, r1, c0, c1."""
    return cells.agg(F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1"))


def mirrored(cells: DataFrame, half: int) -> DataFrame:
    """With the border's cells reflected (d c b a | a b c d) half cells outwards."""
    e = F.broadcast(extent(cells))  # one row
    for axis in ("r", "c"):
        inside = cells.columns
        at, lo, hi = F.col(axis), F.col(f"{axis}0"), F.col(f"{axis}1")
        places = F.array_compact(F.array(at, F.when(at - lo < half, 2 * lo - at - 1), F.when(hi - at < half, 2 * hi - at + 1)))
        cells = cells.join(e).withColumn("__at", F.explode(places)).withColumn(axis, F.col("__at")).select(*inside)
    return cells


def box(cells: DataFrame, half: int, aggregates: dict[str, tuple[str, str]], reflect: bool = True) -> DataFrame:
    """Separable moving aggregates over (2 half + 1)² cells: name -> (sum, count, min or max; column). Adds the names."""
    cells = cells.withColumn("__real", F.lit(True))
    e = F.broadcast(extent(cells))
    wide = mirrored(cells, half) if reflect else cells
    names = [c for c in cells.columns]
    combine = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}
    first = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}
    down = Window.partitionBy("c", "__block").orderBy("r").rangeBetween(-half, half)
    rows = _own(_dealt(wide, "r", half).withColumns({f"__{k}": first[f](col).over(down) for k, (f, col) in aggregates.items()}), "r")
    across = Window.partitionBy("r", "__block").orderBy("c").rangeBetween(-half, half)
    out = _own(_dealt(rows, "c", half).withColumns({k: combine[f](f"__{k}").over(across) for k, (f, _) in aggregates.items()}), "c")
    inside = F.col("r").between(F.col("r0"), F.col("r1")) & F.col("c").between(F.col("c0"), F.col("c1"))
    return out.join(e).filter(inside).select(*[c for c in names if c != "__real"], *aggregates)


Kernel = Callable[["Tile"], dict[str, np.ndarray]]


@dataclass
class Tile:
    """A block with its halo: absolute rows and columns, arrays over them (NaN: no data, or beyond the raster), which
    places have a row at all, and how wide the halo is."""

    rows: np.ndarray
    cols: np.ndarray
    values: dict[str, np.ndarray]
    on: np.ndarray
    halo: int

    def own(self, a: np.ndarray) -> np.ndarray:
        return a[self.halo : len(self.rows) - self.halo, self.halo : len(self.cols) - self.halo]

    def windows(self, name: str, half: int) -> np.ndarray:
        """Own cells by all values of their window."""
        a = self.values[name]
        cut = self.halo - half
        a = a[cut : len(self.rows) - cut, cut : len(self.cols) - cut]
        w = np.lib.stride_tricks.sliding_window_view(a, (2 * half + 1, 2 * half + 1))
        return w.reshape(*w.shape[:2], -1)

    def ray(self, dr: float, dc: float, steps: int, name: str = "z") -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each step k along a direction: k, the values there of all own cells, and whether there is a row. Steps
        round half to even."""
        rows, cols = (x[self.halo : len(x) - self.halo] for x in (self.rows, self.cols))
        for k in range(1, steps + 1):
            at = np.ix_(np.rint(rows + k * dr).astype(np.int64) - self.rows[0], np.rint(cols + k * dc).astype(np.int64) - self.cols[0])
            yield k, self.values[name][at], self.on[at]


def by_blocks(cells: DataFrame, halo: int, kernel: Kernel, schema: str, reflect: bool = False, side: int = BLOCK // 2) -> DataFrame:
    """cells: r, c and number columns. A bounded group for each block of side x side cells with a halo; kernel gives
    arrays over the block's own cells by name, of which the cells that have a row come out. schema: the names and types.
    reflect: places beyond the raster take the value of the place mirrored at its border."""
    e = extent(cells).first()  # one row
    lo, hi = (e["r0"], e["c0"]), (e["r1"], e["c1"])
    names = [c for c in cells.columns if c not in ("r", "c")]
    outs = [x.split()[0] for x in schema.split(",")]
    span = lambda axis: F.explode(F.sequence(F.floor((F.col(axis) - halo) / side), F.floor((F.col(axis) + halo) / side)))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        axes, folds = [], []
        for k in (0, 1):
            first, last = max(int(key[k]) * side, lo[k]), min(int(key[k]) * side + side - 1, hi[k])
            at = np.arange(first - halo, last + halo + 1)
            axes.append(at)
            folds.append(np.clip(np.where(at < lo[k], 2 * lo[k] - at - 1, np.where(at > hi[k], 2 * hi[k] - at + 1, at)) - at[0], 0, len(at) - 1))
        rows, cols = axes
        if len(rows) <= 2 * halo or len(cols) <= 2 * halo:  # a block beyond the raster
            return pd.DataFrame({"r": [], "c": [], **{x: [] for x in outs}})
        r, c = pdf["r"].to_numpy(np.int64) - rows[0], pdf["c"].to_numpy(np.int64) - cols[0]
        inside = (r >= 0) & (r < len(rows)) & (c >= 0) & (c < len(cols))
        on = np.zeros((len(rows), len(cols)), bool)
        on[r[inside], c[inside]] = True
        values = {}
        for name in names:
            a = np.full(on.shape, np.nan)
            a[r[inside], c[inside]] = pdf[name].to_numpy(float)[inside]
            values[name] = a[np.ix_(*folds)] if reflect else a
        tile = Tile(rows, cols, values, on, halo)
        with np.errstate(all="ignore"):
            found = kernel(tile)
        r, c = np.nonzero(tile.own(on))
        return pd.DataFrame({"r": rows[r + halo].astype(np.int32), "c": cols[c + halo].astype(np.int32), **{x: found[x][r, c] for x in outs}})

    dealt = cells.select("r", "c", *[F.col(x).cast("double").alias(x) for x in names]).withColumn("__br", span("r")).withColumn("__bc", span("c"))
    return dealt.groupBy("__br", "__bc").applyInPandas(run, f"r int, c int, {schema}")


def window_median(values: np.ndarray) -> np.ndarray:
    """Median along the last axis of what is no NaN; the mean of the middle two where their number is even."""
    s = np.sort(values, axis=-1)
    n = np.count_nonzero(~np.isnan(s), axis=-1)
    pick = lambda k: np.take_along_axis(s, np.maximum(k, 0)[..., None], -1)[..., 0]
    return np.where(n > 0, (pick((n - 1) // 2) + pick(n // 2)) / 2, np.nan)


def window_mode(values: np.ndarray) -> np.ndarray:
    """Most frequent of the numbers along the last axis; of equally frequent ones the least."""
    s = np.sort(values, axis=-1)
    place = np.arange(s.shape[-1])
    first = np.ones(s.shape, bool)
    first[..., 1:] = s[..., 1:] != s[..., :-1]
    run = place - np.maximum.accumulate(np.where(first, place, 0), axis=-1)
    return np.take_along_axis(s, np.where(np.isnan(s), -1, run).argmax(-1)[..., None], -1)[..., 0]


def window_sums(a: np.ndarray, halo: int, half: int) -> np.ndarray:
    """Sums of the windows of all own cells of an array with a halo, by running sums."""
    cut = halo - half
    a = np.nan_to_num(a[cut : a.shape[0] - cut, cut : a.shape[1] - cut])
    t = np.pad(a.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    k = 2 * half + 1
    return t[k:, k:] - t[:-k, k:] - t[k:, :-k] + t[:-k, :-k]
