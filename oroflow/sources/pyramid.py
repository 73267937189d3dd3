"""Tile pyramids in Web Mercator over a degree grid, and points looked up in stored payloads.

A store is a table of tiles: zoom, x, y, payload, n_valid. Row r of the degree grid is at lat0 - r dy, column c at
lon0 + c dx. The finest level is a join of pixels with the cells they fall on; each coarser level is made of the payloads
of four tiles at a time, so no group grows with the raster. Within a tile latitudes are linear, as in its pixels.
Payloads that cannot be read count as tiles that are not there.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..plans.scratch import written
from . import tiles

SCHEMA = "zoom int, x int, y int, payload binary, n_valid long"


def pixel_lat(zoom: int, side: int) -> str:
    """Latitude of a pixel's middle: tile row y, pixel row py."""
    north, south = geo.tile_lat("y", zoom), geo.tile_lat("(y + 1)", zoom)
    return f"({north} - (py + 0.5e0) * ({north} - {south}) / {side})"


def pixel_lon(zoom: int, side: int) -> str:
    return f"({geo.tile_lon('x', zoom)} + (px + 0.5e0) * {360.0 / (1 << zoom) / side!r}e0)"


def _packed(zoom: int, x: int, y: int, z: np.ndarray, bits: int | None = 16) -> dict:
    z = np.where(np.isnan(z), tiles.NODATA, np.rint(z)).astype(np.int64)
    return {"zoom": [zoom], "x": [x], "y": [y], "payload": [tiles.encode(z, bits)], "n_valid": [int((z != tiles.NODATA).sum())]}


def _grid(payload: bytes) -> np.ndarray | None:
    try:
        z = tiles.decode(payload)
    except (tiles.TileError, TypeError):
        return None
    return np.where(z == tiles.NODATA, np.nan, z.astype(float))


def resample(cells: DataFrame, ref: tuple[float, float, float, float], zoom: int, side: int = 256) -> DataFrame:
    """Tiles of one level: each pixel has the value of the nearest cell, halves to the even one. Only tiles with data."""
    lat0, lon0, dy, dx = ref
    known = cells.filter("z is not null").select("r", "c", "z")
    rows = [F.expr(geo.tile_y(f"({lat0!r}e0 - (r + {k}e0) * {dy!r}e0)", zoom)) for k in (-0.5, 0.5)]
    columns = [F.expr(geo.tile_x(f"({lon0!r}e0 + (c + {k}e0) * {dx!r}e0)", zoom)) for k in (-0.5, 0.5)]
    touched = known.select(F.explode(F.array_distinct(F.array(*rows))).alias("y"), F.array_distinct(F.array(*columns)).alias("xs")).select("y", F.explode("xs").alias("x")).distinct()
    line = touched.select("x", "y", F.explode(F.expr(f"sequence(0, {side - 1})")).alias("py")).withColumn("r", F.expr(f"CAST(rint(({lat0!r}e0 - {pixel_lat(zoom, side)}) / {dy!r}e0) AS INT)"))
    pixels = line.withColumn("px", F.explode(F.expr(f"sequence(0, {side - 1})"))).withColumn("c", F.expr(f"CAST(rint(({pixel_lon(zoom, side)} - {lon0!r}e0) / {dx!r}e0) AS INT)"))

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        z = np.full((side, side), np.nan)
        z[pdf["py"], pdf["px"]] = pdf["z"]
        return pd.DataFrame(_packed(zoom, *key, z))

    # merged: a tile is one row to Spark's size check until its pixels are made
    return pixels.join(known.hint("merge"), ["r", "c"]).select("x", "y", "py", "px", "z").groupBy("x", "y").applyInPandas(pack, SCHEMA)


def halve(level: DataFrame, side: int = 256) -> DataFrame:
    """The next coarser level: a pixel is the mean of those of its four that have data, in whole metres."""

    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        z = np.full((2 * side, 2 * side), np.nan)
        for x, y, payload in zip(pdf["x"], pdf["y"], pdf["payload"], strict=True):
            part = _grid(payload)
            if part is not None and part.shape == (side, side):
                z[(y & 1) * side : ((y & 1) + 1) * side, (x & 1) * side : ((x & 1) + 1) * side] = part
        four = z.reshape(side, 2, side, 2).transpose(0, 2, 1, 3).reshape(side, side, 4)
        known = ~np.isnan(four)
        n = known.sum(axis=2)
        mean = np.where(n > 0, np.where(known, four, 0.0).sum(axis=2) / np.maximum(n, 1), np.nan)
        return pd.DataFrame(_packed(int(key[0]) - 1, int(key[1]), int(key[2]), mean))

    return level.groupBy("zoom", F.shiftright("x", 1).alias("px"), F.shiftright("y", 1).alias("py")).applyInPandas(merge, SCHEMA)


def build(base: DataFrame, coarsest: int, finest: int, side: int = 256) -> DataFrame:
    """All levels from the finest (base) to the coarsest, each written before the next is made of it."""
    level = written(base, f"pyramid-{finest}")
    out = level
    for zoom in range(finest - 1, coarsest - 1, -1):
        level = written(halve(level, side), f"pyramid-{zoom}")
        out = out.unionByName(level)
    return out


def choose(first: DataFrame, second: DataFrame, side: int = 256, share: float = 0.05) -> DataFrame:
    """Of two stores the tiles of the first, but those of the second where the first has none or data in less than `share`
    of the tile's cells. source: 'first' or 'second'."""
    key = ["zoom", "x", "y"]
    other = second.select(*key, F.col("payload").alias("payload2"), F.col("n_valid").alias("n2"))
    both = first.join(other.hint("merge"), key, "full_outer")
    kept = F.coalesce(F.col("n_valid") >= F.lit(share * side * side), F.lit(False)) | F.col("n2").isNull()
    pick = lambda a, b: F.when(kept, F.col(a)).otherwise(F.col(b)).alias(a)
    return both.select(*key, pick("payload", "payload2"), pick("n_valid", "n2"), F.when(kept, "first").otherwise("second").alias("source"))


def statistics(store: DataFrame) -> DataFrame:
    """What the payloads hold: zoom, x, y, cells with data, sum, least and greatest height; nulls for an unreadable one."""

    def read(batches):
        for pdf in batches:
            rows = []
            for zoom, x, y, payload in zip(pdf["zoom"], pdf["x"], pdf["y"], pdf["payload"], strict=True):
                z = _grid(payload)
                known = z[~np.isnan(z)] if z is not None else np.zeros(0)
                rows.append((zoom, x, y, len(known) if z is not None else None, known.sum() if len(known) else None, known.min(initial=np.inf) if len(known) else None, known.max(initial=-np.inf) if len(known) else None))
            yield pd.DataFrame(rows, columns=["zoom", "x", "y", "n_valid", "z_sum", "z_min", "z_max"])

    return store.select("zoom", "x", "y", "payload").mapInPandas(read, "zoom int, x int, y int, n_valid long, z_sum double, z_min double, z_max double")


def manifest(store: DataFrame) -> DataFrame:
    """Tiles, their extent, cells with data and bytes by zoom."""
    return store.groupBy("zoom").agg(F.count(F.lit(1)).alias("n_tiles"), F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y"), F.sum("n_valid").alias("n_valid"), F.sum(F.length("payload")).alias("n_bytes"))


def _between(z: np.ndarray, fy: np.ndarray, fx: np.ndarray) -> np.ndarray:
    """Bilinear values at fractions of the tile; where a corner has no data, the first that has (nw, ne, sw, se)."""
    last = np.array(z.shape) - 1
    py, px = np.clip(fy * last[0], 0, last[0]), np.clip(fx * last[1], 0, last[1])
    y0, x0 = py.astype(int), px.astype(int)
    y1, x1 = np.minimum(y0 + 1, last[0]), np.minimum(x0 + 1, last[1])
    wy, wx = py - y0, px - x0
    corners = np.stack([z[y0, x0], z[y0, x1], z[y1, x0], z[y1, x1]])
    mixed = (corners * np.stack([(1 - wy) * (1 - wx), (1 - wy) * wx, wy * (1 - wx), wy * wx])).sum(axis=0)
    known = ~np.isnan(corners)
    first = corners[known.argmax(axis=0), np.arange(len(py))]
    return np.where(known.all(axis=0), mixed, first)


def elevation_at(points: DataFrame, store: DataFrame, zooms: tuple[int, ...] = (12, 11, 10, 9, 8, 7), tile_points: int = 20_000) -> DataFrame:
    """points: pid, lat, lon. pid, z (to 0.1) and the zoom that gave it, both null where no level has data.

    Points go to the tiles of the first zoom, a payload is read once for all points of its tile (for each tile_points of
    them, where one tile has more), and those that found no tile or no data go on to the next zoom."""
    rest = points.select("pid", "lat", "lon")
    found: list[DataFrame] = []
    for zoom in zooms:
        here = store.filter(F.col("zoom") == zoom).select("x", "y", "payload")
        n = float(1 << zoom)
        at = rest.withColumns({"x": F.expr(geo.tile_x("lon", zoom)), "y": F.expr(geo.tile_y("lat", zoom))})
        fy = f"(({geo.tile_lat('y', zoom)} - lat) / ({geo.tile_lat('y', zoom)} - {geo.tile_lat('(y + 1)', zoom)}))"
        at = at.withColumns({"fy": F.expr(fy), "fx": F.expr(f"((lon - {geo.tile_lon('x', zoom)}) * {n!r}e0 / 360e0)")})
        loads = at.groupBy("x", "y").agg(F.ceil(F.count(F.lit(1)) / tile_points).cast("int").alias("salts")).join(here.select("x", "y"), ["x", "y"])
        loads = written(loads, "tile-loads")
        placed = at.join(loads, ["x", "y"], "left").withColumn("salt", F.pmod(F.xxhash64("pid"), F.coalesce("salts", F.lit(1)).cast("long")).cast("int"))
        missed = placed.filter("salts is null").select("pid", "lat", "lon")
        copies = here.join(loads, ["x", "y"]).withColumn("salt", F.explode(F.expr("sequence(0, salts - 1)"))).select("x", "y", "salt", "payload")

        def read(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            grid = _grid(right["payload"].iloc[0]) if len(right) and len(left) else None
            z = _between(grid, left["fy"].to_numpy(float), left["fx"].to_numpy(float)) if grid is not None else np.full(len(left), np.nan)
            return pd.DataFrame({"pid": left["pid"], "lat": left["lat"], "lon": left["lon"], "z": [None if np.isnan(v) else float(v) for v in z]})

        types = {f.name: f.dataType.simpleString() for f in points.schema}
        schema = f"pid {types['pid']}, lat double, lon double, z double"
        met = placed.filter("salts is not null").select("pid", "lat", "lon", "x", "y", "salt", "fy", "fx").groupBy("x", "y", "salt").cogroup(copies.groupBy("x", "y", "salt")).applyInPandas(read, schema)
        step = written(met.unionByName(missed.withColumn("z", F.lit(None).cast("double"))), f"tile-points-{zoom}")
        found.append(step.filter("z is not null").select("pid", F.round("z", 1).alias("z"), F.lit(zoom).alias("zoom")))
        rest = step.filter("z is null").select("pid", "lat", "lon")
    out = rest.select("pid", F.lit(None).cast("double").alias("z"), F.lit(None).cast("int").alias("zoom"))
    for part in found:
        out = out.unionByName(part)
    return out


def mosaic(requests: DataFrame, radius: int, zoom: int, *stores: DataFrame, side: int = 256, tile_windows: int = 2_000, batch_cells: int = 100_000) -> DataFrame:
    """requests: pid, lat, lon. The square of 2 radius + 1 pixels around each, put together from the tiles of one zoom: pid,
    row, col (from the north-west), z, and source, the place in the list of the first store that has data there. Pixels
    without data have no row; squares end at the borders of the map.

    A request goes to the tiles that its square touches, a tile with more than tile_windows of them to several tasks; the
    payloads of a tile are read once for requests that follow each other, and squares leave together, some batch_cells at
    a time."""
    n = float(1 << zoom)
    pixel = requests.withColumns({"x": F.expr(geo.tile_x("lon", zoom)), "y": F.expr(geo.tile_y("lat", zoom))})
    down = f"(1e0 - ln(tan(radians(lat)) + 1e0 / cos(radians(lat))) / {np.pi!r}e0) / 2e0 * {n!r}e0"
    pixel = pixel.selectExpr("pid", f"x * {side} + CAST(floor(((lon + 180e0) / 360e0 * {n!r}e0 - x) * {side}) AS INT) - {radius} AS px", f"y * {side} + CAST(floor(({down} - y) * {side}) AS INT) - {radius} AS py")
    reach = lambda v: F.explode(F.sequence(F.floor(F.col(v) / side), F.floor((F.col(v) + 2 * radius) / side)))
    asked = pixel.withColumn("x", reach("px")).withColumn("y", reach("py"))
    ranked = [s.filter(F.col("zoom") == zoom).select(F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), F.struct(F.lit(k).alias("k"), "payload").alias("s")) for k, s in enumerate(stores)]
    tiles_of = ranked[0]
    for more in ranked[1:]:
        tiles_of = tiles_of.unionByName(more)
    tiles_of = tiles_of.groupBy("x", "y").agg(F.array_sort(F.collect_list("s")).alias("held"))
    loads = written(asked.groupBy("x", "y").agg(F.ceil(F.count(F.lit(1)) / tile_windows).cast("int").alias("salts")), "mosaic-loads")
    salted = asked.join(loads, ["x", "y"]).withColumn("salt", F.pmod(F.xxhash64("pid"), F.col("salts").cast("long")).cast("int"))
    copies = tiles_of.join(loads, ["x", "y"]).withColumn("salt", F.explode(F.expr("sequence(0, salts - 1)"))).select("x", "y", "salt", "held")
    met = salted.join(copies.hint("merge"), ["x", "y", "salt"]).select("pid", "px", "py", "x", "y", "held")

    def unfold(batches):
        last, z, source = None, None, None
        parts, held_cells = [], 0

        def together():
            pids = [x[0] for x in parts]
            sizes = [len(x[1]) for x in parts]
            return pd.DataFrame({"pid": pd.Series(pids).repeat(sizes).reset_index(drop=True), **{k: np.concatenate([x[i] for x in parts]) for i, k in enumerate(("row", "col", "z", "source"), 1)}})

        for pdf in batches:
            for pid, px, py, x, y, held in pdf.itertuples(index=False):
                if (x, y) != last:
                    last, z, source = (x, y), np.full((side, side), np.nan), np.full((side, side), -1)
                    for part in held:
                        grid = _grid(part["payload"])
                        if grid is not None and grid.shape == z.shape:
                            new = np.isnan(z) & ~np.isnan(grid)
                            z[new], source[new] = grid[new], part["k"]
                top, left = py - y * side, px - x * side
                rows, columns = slice(max(0, top), max(0, min(side, top + 2 * radius + 1))), slice(max(0, left), max(0, min(side, left + 2 * radius + 1)))
                r, c = np.nonzero(~np.isnan(z[rows, columns]))
                if len(r):
                    r, c = r + rows.start, c + columns.start
                    parts.append((pid, r - top, c - left, z[r, c], source[r, c]))
                    held_cells += len(r)
                    if held_cells >= batch_cells:
                        yield together()
                        parts, held_cells = [], 0
        if parts:
            yield together()

    kind = requests.schema["pid"].dataType.simpleString()
    return met.mapInPandas(unfold, f"pid {kind}, row int, col int, z double, source int")


def least_bits(cells: DataFrame, max_rmse: float = 1.0, side: int = 64) -> DataFrame:
    """Tiles at the least depth (8 to 16 bits) whose root mean square error is max_rmse or less: tr, tc, bits, rmse,
    payload. Quantisation alone decides, so only the depth that is taken is compressed."""

    def pick(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        z = np.full((side, side), tiles.NODATA, np.int64)
        z[pdf["r"] % side, pdf["c"] % side] = pdf["z"].fillna(tiles.NODATA).to_numpy().astype(np.int64)
        for bits in range(8, 17):
            rmse = tiles.quantised_rmse(z, bits)
            if rmse <= max_rmse:
                break
        return pd.DataFrame({"tr": [key[0]], "tc": [key[1]], "bits": [bits], "rmse": [rmse], "payload": [tiles.encode(z, bits)]})

    tiled = cells.select("r", "c", "z", F.floor(F.col("r") / side).cast("int").alias("tr"), F.floor(F.col("c") / side).cast("int").alias("tc"))
    return tiled.groupBy("tr", "tc").applyInPandas(pick, "tr int, tc int, bits int, rmse double, payload binary")
