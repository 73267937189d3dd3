"""Drainage: flow directions, depressions, accumulation, streams, basins and the indices made of them.

A drainage network is an edge table (id, parent, len) over cell ids; upstream and downstream questions are answered block
by block, then by doubled jumps over the ways that cross blocks (operators.graph). Depressions are filled block by block
too: each block is flooded from its edge, the areas that drain to one place of the edge and the heights at which they
spill into each other make a small graph, and the lowest way out of every area is found on that graph, first within
groups of blocks, then by Boruvka rounds among the few areas that touch two groups.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import written
from . import graph, grid, terrain

CELL = terrain.CELL
_STEP = {name: code for code, name in enumerate(grid.NEIGHBOURS)}  # the order of D8_STEPS
_SHIFT = 1 << 32


def cell_id(r: str | Column = "r", c: str | Column = "c") -> Column:
    as_col = lambda x: F.col(x) if isinstance(x, str) else x
    return as_col(r).cast("long") * _SHIFT + as_col(c).cast("long")


def place(cell: str = "id") -> dict[str, Column]:
    return {"r": F.floor(F.col(cell) / _SHIFT).cast("int"), "c": F.pmod(F.col(cell), F.lit(_SHIFT)).cast("int")}


def d8(cells: DataFrame) -> DataFrame:
    """Adds d8: code of the steepest way down by drop over distance, the lowest code of equal ones; -1 without one."""
    around = grid.with_neighbours(cells)
    ways = [F.when(F.col(x) < F.col("z"), F.struct(((F.col("z") - F.col(x)) / (1.0 if k % 2 == 0 else math.sqrt(2))).alias("slope"), F.lit(-k).alias("k"))) for x, k in _STEP.items()]
    best = F.array_max(F.array_compact(F.array(*ways)))
    return around.select(*cells.columns, F.coalesce(-best["k"], F.lit(-1)).alias("d8"))


def flow_edges(directed: DataFrame) -> DataFrame:
    """directed: r, c, d8. id, parent (null at pits), len in cells."""
    dr = F.element_at(F.array(*[F.lit(a) for a, _ in grid.D8_STEPS]), F.col("d8") + 1)
    dc = F.element_at(F.array(*[F.lit(b) for _, b in grid.D8_STEPS]), F.col("d8") + 1)
    down = F.col("d8") >= 0
    return directed.select(cell_id().alias("id"), F.when(down, cell_id(F.col("r") + dr, F.col("c") + dc)).alias("parent"), F.when(down, F.when(F.col("d8") % 2 == 0, 1.0).otherwise(math.sqrt(2))).alias("len"))


def flow_accumulation(directed: DataFrame) -> DataFrame:
    """r, c, accumulation: cells draining through each cell, itself among them."""
    acc = graph.accumulate(flow_edges(directed).withColumn("w", F.lit(1.0)))
    return acc.select(*[v.alias(k) for k, v in place().items()], F.col("acc").cast("long").alias("accumulation"))


def flow_length(directed: DataFrame) -> DataFrame:
    """r, c, downslope (metres to the end of the way) and upslope (the longest way ending here)."""
    down = written(graph.descend(flow_edges(directed)), "flow-length")
    # the longest way up is the largest distance to the root among all cells above, less the cell's own
    up = graph.accumulate(down.select("id", "parent", F.col("distance").alias("w")), combine="max")
    both = down.select("id", "distance", "root").join(up.select("id", "acc"), "id")
    return both.select(*[v.alias(k) for k, v in place().items()], F.round(F.col("distance") * CELL, 4).alias("downslope"), F.round((F.col("acc") - F.col("distance")) * CELL, 4).alias("upslope"), *[v.alias(f"root_{k}") for k, v in place("root").items()])


# ---------------------------------------------------------------- depressions

OUT = -1  # the label of what lies beyond the raster
GROUP_BITS = 3  # blocks to a side of a group: 8


def _grid_of(pdf: pd.DataFrame, *values: str) -> tuple[int, int, list[np.ndarray]]:
    """Row and column of the first place, and the values of a block's cells as arrays with a border of NaN."""
    r, c = pdf["r"].to_numpy(np.int64), pdf["c"].to_numpy(np.int64)
    r0, c0 = int(r.min()) - 1, int(c.min()) - 1
    shape = int(r.max()) - r0 + 2, int(c.max()) - c0 + 2
    out = []
    for v in values:
        grid_ = np.full(shape, np.nan)
        grid_[r - r0, c - c0] = pdf[v].to_numpy(float)
        out.append(grid_)
    return r0, c0, out


def flood(z: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[tuple[int, int], float]]:
    """Water rises from the seed places (bool) over a bordered array; NaN are walls. Level of each cell, the seed that it
    drains to (its place in the flat array; -1 for cells that no seed reaches), and the lowest height at which the areas of
    two seeds meet."""
    width = z.shape[1]
    near = (-1, 1, -width, width, -width - 1, -width + 1, width - 1, width + 1)
    level, edge = z.ravel().tolist(), seeds.ravel().tolist()
    state = np.where(np.isnan(z), 2, 0).ravel().tolist()  # 2: wall, 1: done
    label = [-1] * len(level)
    heap = [(level[i], i) for i in np.flatnonzero(seeds & ~np.isnan(z)).tolist()]
    heapq.heapify(heap)
    links: dict[tuple[int, int], float] = {}
    while heap:
        at, i = heapq.heappop(heap)
        if state[i]:
            continue
        state[i] = 1
        if label[i] < 0:
            label[i] = i
        own = label[i]
        for step in near:
            j = i + step
            if state[j] == 0:
                if label[j] < 0:
                    label[j] = own
                    if not edge[j]:
                        if level[j] < at:
                            level[j] = at
                        heapq.heappush(heap, (level[j], j))
            elif state[j] == 1 and label[j] != own:
                pair = (own, label[j]) if own < label[j] else (label[j], own)
                over = at if at > level[j] else level[j]
                if over < links.get(pair, math.inf):
                    links[pair] = over
    return np.array(level).reshape(z.shape), np.array(label).reshape(z.shape), links


def contract(a: list[int], b: list[int], spill: list[float], ends: set[int]) -> tuple[list[tuple[int, int, float]], list[tuple[int, int, float]]]:
    """A graph of areas (links by ascending spill height) without those that are no ends: for each such area the end (or
    OUT) that it drains to and over which height, and the links left among ends and OUT."""
    root: dict[int, int] = {}
    head: dict[int, int | None] = {}
    loose: dict[int, list[int]] = {}

    def find(x: int) -> int:
        if x not in root:
            root[x], head[x], loose[x] = x, (x if x in ends or x == OUT else None), ([] if x in ends or x == OUT else [x])
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    attached, left = [], []
    for p, q, over in zip(a, b, spill, strict=True):
        x, y = find(p), find(q)
        if x == y:
            continue
        hx, hy = head[x], head[y]
        if hx is not None and hy is not None:
            if (hx, hy) != (OUT, OUT):
                left.append((hx, hy, over))
        elif hx is not None or hy is not None:
            to, free = (hx, y) if hy is None else (hy, x)
            attached += [(n, to, over) for n in loose[free]]
            loose[free] = []
        if len(loose[x]) < len(loose[y]):
            x, y = y, x
        root[y] = x
        loose[x] += loose.pop(y)
        head[x] = OUT if OUT in (hx, hy) else hx if hx is not None else hy
    return attached, left


def fill_depressions(cells: DataFrame) -> DataFrame:
    """Cells with data, z raised to the lowest level over which water leaves the raster; cells without data are walls, and
    cells that they wall in stay as they are."""
    known = cells.filter("z is not null").select("r", "c", F.col("z").cast("double").alias("z"), cell_id().alias("id"))
    e = grid.extent(known).first()  # one row
    bits, last = graph.BLOCK_BITS, (1 << graph.BLOCK_BITS) - 1
    frame = (e["r0"], e["r1"], e["c0"], e["c1"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r0, c0, (z,) = _grid_of(pdf, "z")
        rows, cols = np.arange(z.shape[0]) + r0, np.arange(z.shape[1]) + c0
        on = lambda x, lo, hi: (x & last == 0) | (x & last == last) | (x == lo) | (x == hi)
        level, label, links = flood(z, on(rows, *frame[:2])[:, None] | on(cols, *frame[2:])[None, :])
        name = lambda flat: ((flat // z.shape[1] + r0) << graph.SHIFT) + flat % z.shape[1] + c0
        r, c = np.nonzero(~np.isnan(z))
        own = label[r, c]
        cell = pd.DataFrame({"link": False, "a": ((r + r0) << graph.SHIFT) + c + c0, "b": np.where(own >= 0, name(own), -2), "v": level[r, c]})
        pairs = np.array(list(links), np.int64).reshape(-1, 2)
        return pd.concat([cell, pd.DataFrame({"link": True, "a": name(pairs[:, 0]), "b": name(pairs[:, 1]), "v": np.array(list(links.values()), float)})])

    flooded = written(known.groupBy(*graph.block_of()).applyInPandas(run, "link boolean, a long, b long, v double"), "fill-blocks")
    level = flooded.filter("not link").select(F.col("a").alias("id"), F.col("b").alias("label"), F.col("v").alias("z"))
    at = place()
    border = (at["r"] == e["r0"]) | (at["r"] == e["r1"]) | (at["c"] == e["c0"]) | (at["c"] == e["c1"])
    edge = level.filter((graph.on_block_edge() | border) & (F.col("label") >= 0))
    steps = F.explode(F.array(*[F.lit((dr << graph.SHIFT) + dc) for dr, dc in ((0, 1), (1, -1), (1, 0), (1, 1))]))
    sent = edge.select("id", F.col("label").alias("a"), F.col("z").alias("za"), steps.alias("step")).select("id", "a", "za", (F.col("id") + F.col("step")).alias("to"))
    met = sent.join(edge.select(F.col("id").alias("to"), F.col("label").alias("b"), F.col("z").alias("zb")), "to").filter("a <> b")
    cross = met.select("a", "b", F.greatest("za", "zb").alias("spill"))
    out = edge.filter(border).select(F.col("label").alias("a"), F.lit(OUT).cast("long").alias("b"), F.col("z").alias("spill"))
    links = flooded.filter("link").select("a", "b", F.col("v").alias("spill")).unionByName(cross).unionByName(out)
    group = lambda x: [y.alias(f"{x}{y_}") for y, y_ in zip(graph.block_of(x, bits + GROUP_BITS), ("r", "c"), strict=True)]
    links = written(links.groupBy("a", "b").agg(F.min("spill").alias("spill")).select("*", *group("a"), *group("b")).withColumn("near", (F.col("b") == OUT) | ((F.col("ar") == F.col("br")) & (F.col("ac") == F.col("bc")))), "fill-links")
    far = links.filter("not near").select("a", "b", "spill")
    ends = links.filter("not near").select(F.col("a").alias("a"), F.col("ar"), F.col("ac")).unionByName(links.filter("not near").select(F.col("b").alias("a"), F.col("br").alias("ar"), F.col("bc").alias("ac"))).distinct()
    inner = links.filter("near").select("ar", "ac", "a", "b", "spill").unionByName(ends.select("ar", "ac", "a", F.lit(-3).cast("long").alias("b"), F.lit(None).cast("double").alias("spill")))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        stop = set(pdf["a"][pdf["b"] == -3].tolist())
        links_ = pdf[pdf["b"] != -3].sort_values(["spill", "a", "b"])
        attached, left = contract(links_["a"].tolist(), links_["b"].tolist(), links_["spill"].tolist(), stop)
        rows = [(False, *x) for x in attached] + [(True, *x) for x in left]
        return pd.DataFrame(rows, columns=["link", "a", "b", "v"])

    solved = written(inner.groupBy("ar", "ac").applyInPandas(solve, "link boolean, a long, b long, v double"), "fill-groups")
    areas = solved.filter("not link").select(F.col("a").alias("label"), F.col("b").alias("end"), F.col("v").alias("level"))
    levels = areas.select("label", "level")
    if not far.isEmpty():
        highest = _lowest_ways_out(solved.filter("link").select("a", "b", F.col("v").alias("spill")).unionByName(far), ends.select(F.col("a").alias("basin")))
        levels = areas.join(highest.select(F.col("basin").alias("end"), F.col("level").alias("l2")), "end", "left").select("label", F.greatest("level", "l2").alias("level")).unionByName(highest.select(F.col("basin").alias("label"), "level"))
    return level.join(levels, "label", "left").select(*[v.alias(k) for k, v in at.items()], F.greatest("z", "level").alias("z"))


def _lowest_ways_out(spills: DataFrame, basins: DataFrame) -> DataFrame:
    """spills: a, b (OUT: beyond the raster), spill; basins: basin. The level of each basin: the largest of the lowest exits
    of the groups that it is in on its way out. Boruvka rounds, each at least halving the open groups."""
    there = spills.select(F.col("a"), F.col("b"), "spill")
    both = there.unionByName(there.select(F.col("b").alias("a"), F.col("a").alias("b"), "spill")).filter(F.col("a") != OUT)
    links = written(both.groupBy("a", "b").agg(F.min("spill").alias("spill")), "fill-spills")
    levels = written(basins.distinct().select("basin", F.col("basin").alias("grp"), F.lit(float("-inf")).alias("level")), "fill-levels")
    while not levels.filter("grp >= 0").isEmpty():
        group = levels.select(F.col("basin"), "grp")
        open_links = links.join(group.select(F.col("basin").alias("a"), F.col("grp").alias("ga")), "a").join(group.select(F.col("basin").alias("b"), F.col("grp").alias("gb")), "b", "left").withColumn("gb", F.coalesce("gb", F.lit(OUT)))
        pick = open_links.filter("ga >= 0 and ga <> gb").groupBy("ga").agg(F.min(F.struct("spill", F.when(F.col("gb") < 0, OUT).otherwise(F.least("ga", "gb")).alias("lo"), F.greatest("ga", "gb").alias("hi"), "gb")).alias("x"))
        pick = written(pick.select("ga", F.col("x.spill").alias("spill"), F.col("x.gb").alias("to")), "fill-pick")
        if pick.isEmpty():  # a group walled in by cells without data keeps its level
            break
        back = pick.select(F.col("ga").alias("to"), F.col("to").alias("back"))
        roots = pick.join(back, "to", "left").select(F.col("ga").alias("id"), F.when((F.col("to") < 0) | ((F.col("back") == F.col("ga")) & (F.col("ga") < F.col("to"))), F.lit(None)).otherwise(F.col("to")).alias("parent"), (F.col("to") < 0).alias("out"), F.lit(1.0).alias("len"), F.lit(1).cast("long").alias("hops"))
        roots = written(roots, "fill-roots")
        merged = graph.leap(roots).select("id", "root").unionByName(roots.filter("parent is null").select("id", F.col("id").alias("root")))
        done = roots.filter("out").select(F.col("id").alias("root"), F.lit(True).alias("done"))
        into = merged.join(done, "root", "left").select(F.col("id").alias("grp"), F.when(F.col("done"), F.lit(OUT)).otherwise(F.col("root")).cast("long").alias("into"))
        new = levels.join(pick.select(F.col("ga").alias("grp"), "spill"), "grp", "left").join(into, "grp", "left")
        levels = written(new.select("basin", F.coalesce("into", "grp").alias("grp"), F.greatest("level", "spill").alias("level")), "fill-levels")
    return levels.select("basin", "level")


def depth_in_sink(cells: DataFrame) -> DataFrame:
    filled = fill_depressions(cells).withColumnRenamed("z", "filled")
    return cells.join(filled, ["r", "c"]).select("r", "c", F.round(F.col("filled") - F.col("z"), 6).alias("depth"))


def inundation(cells: DataFrame, level: float, fill_first: bool = True) -> DataFrame:
    """flooded flag and depth of water at a level."""
    base = fill_depressions(cells) if fill_first else cells.filter("z is not null")
    return base.select("r", "c", (F.col("z") < level).cast("int").alias("flooded"), F.greatest(F.lit(level) - F.col("z"), F.lit(0.0)).alias("depth"))


def depression_stats(cells: DataFrame, least_depth: float = 0.1) -> DataFrame:
    """Each 4-connected sink: its id (smallest cell), cells, greatest depth, volume, spill height; deepest first by rank."""
    deep = depth_in_sink(cells).filter(F.col("depth") > least_depth)
    found = written(deep.join(cells, ["r", "c"]).withColumn("id", cell_id()), "sinks")
    labels = connected(found)
    per = found.join(labels, "id").groupBy(F.col("comp").alias("sink")).agg(F.count(F.lit(1)).alias("n_cells"), F.max("depth").alias("max_depth"), F.round(F.sum("depth") * CELL * CELL, 2).alias("volume"), F.round(F.max(F.col("z") + F.col("depth")), 4).alias("spill"))
    return per.select(*[v.alias(f"sink_{k}") for k, v in place("sink").items()], "n_cells", "max_depth", "volume", "spill")


def connected(cells: DataFrame) -> DataFrame:
    """cells: r, c, id. 4-connected components: id, comp."""
    return graph.areas(cells.select("id", F.lit(0).alias("k"))).select("id", "comp")


def clump(cells: DataFrame, step: float = 100.0) -> DataFrame:
    """4-connected areas of equal class (z in steps): r, c, label (the smallest cell's place)."""
    found = graph.areas(cells.filter("z is not null").select(cell_id().alias("id"), F.floor(F.col("z") / step).alias("k")))
    return found.select(*[v.alias(k) for k, v in place().items()], "k", "comp")


def sieve(cells: DataFrame, min_size: int = 10, step: float = 100.0) -> DataFrame:
    """Areas under min_size cells take the most frequent class around them; of equally frequent ones the lowest."""
    areas = written(clump(cells, step), "sieve")
    size = areas.groupBy("comp").agg(F.count(F.lit(1)).alias("n"))
    placed = written(areas.join(size, "comp"), "sieve-sized")
    around = grid.with_neighbours(placed.select("r", "c", F.struct("comp", "k", "n").alias("z")))
    touch = around.filter(F.col("z.n") < min_size).select(F.col("z.comp").alias("comp"), F.explode(F.array("n", "s", "w", "e")).alias("o")).filter("o is not null and o.comp <> comp")
    votes = touch.groupBy("comp", F.col("o.k").alias("k")).agg(F.count(F.lit(1)).alias("v"))
    best = votes.groupBy("comp").agg(F.max(F.struct("v", (-F.col("k")).alias("k"))).alias("x")).select("comp", (-F.col("x.k")).alias("new"))
    return placed.join(best, "comp", "left").select("r", "c", F.coalesce("new", "k").alias("sieve"))


# ---------------------------------------------------------------- streams and basins

def streams(accumulated: DataFrame, threshold: int = 100) -> DataFrame:
    return accumulated.select("r", "c", (F.col("accumulation") >= threshold).cast("int").alias("stream"))


def stream_network(directed: DataFrame, accumulated: DataFrame, threshold: int = 100) -> DataFrame:
    """Edges among stream cells: id, parent (null where the stream ends), len, n_in (streams that flow in)."""
    on = accumulated.filter(F.col("accumulation") >= threshold).select(cell_id().alias("id"))
    edges = flow_edges(directed).join(on, "id", "left_semi")
    inside = edges.join(on.select(F.col("id").alias("parent"), F.lit(True).alias("in")), "parent", "left").withColumn("parent", F.when(F.col("in"), F.col("parent"))).drop("in")
    n_in = inside.filter("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("n_in"))
    return written(inside.join(n_in, "id", "left").withColumn("n_in", F.coalesce("n_in", F.lit(0))), "streams")


def stream_links(network: DataFrame) -> DataFrame:
    """Adds link: the cell where the stretch between junctions ends that the cell is on."""
    joint = network.filter("n_in > 1").select(F.col("id").alias("parent"), F.lit(True).alias("joint"))
    cut = network.join(joint, "parent", "left").select("id", F.when(F.col("joint").isNull(), F.col("parent")).alias("parent"), "len")
    ends = graph.descend(cut).select("id", F.col("root").alias("link"), "distance")
    return network.join(ends, "id")


def stream_order(network: DataFrame) -> DataFrame:
    """Strahler order of each stream cell. A cell has order k + 1 or more where its way in passes a cell that two cells of
    order k or more flow into; so there is one sum along the ways for each order, over the cells of the order before."""
    level = written(network.select("id", "parent"), "order")
    found, order = [], 1
    while True:
        met = level.filter("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        met = written(met.select("id", F.lit(1.0).alias("w")), "order-met")
        if met.isEmpty():
            found.append(level.select("id", F.lit(order).alias("stream_order")))
            break
        passed = graph.accumulate(level.join(met, "id", "left"), combine="max").select("id", "parent", F.coalesce(F.col("acc") > 0, F.lit(False)).alias("on"))
        passed = written(passed, "order")
        found.append(passed.filter("not on").select("id", F.lit(order).alias("stream_order")))
        level, order = passed.filter("on").select("id", "parent"), order + 1
    out = found[0]
    for rows in found[1:]:
        out = out.unionByName(rows)
    return out.select(*[v.alias(k) for k, v in place().items()], "stream_order")


def basins(directed: DataFrame) -> DataFrame:
    """r, c and the place of the pit or outlet each cell drains to."""
    down = graph.descend(flow_edges(directed))
    return down.select(*[v.alias(k) for k, v in place().items()], *[v.alias(f"outlet_{k}") for k, v in place("root").items()])


def watershed(directed: DataFrame, pour_points: DataFrame) -> DataFrame:
    """pour_points: p, r, c. Each cell with the first pour point on its way down."""
    at = pour_points.select(cell_id().alias("id"), "p")
    edges = flow_edges(directed).join(at, "id", "left")
    cut = edges.select("id", F.when(F.col("p").isNull(), F.col("parent")).alias("parent"), "len")
    down = graph.descend(cut).select("id", F.col("root"))
    found = down.join(at.select(F.col("id").alias("root"), "p"), "root")
    return found.select(*[v.alias(k) for k, v in place().items()], "p")


def watershed_summary(marked: DataFrame, cells: DataFrame) -> DataFrame:
    """Per pour point: cells, area in km², elevations, and cells on the boundary."""
    around = grid.with_neighbours(marked.withColumnRenamed("p", "z")).select("r", "c", F.col("z").alias("p"), F.greatest(*[(~F.col(x).eqNullSafe(F.col("z"))).cast("int") for x in ("n", "s", "w", "e")]).alias("edge"))
    return around.join(cells, ["r", "c"]).groupBy("p").agg(F.count(F.lit(1)).alias("n_cells"), F.round(F.count(F.lit(1)) * CELL * CELL / 1e6, 4).alias("area_km2"), F.min("z").alias("min_z"), F.max("z").alias("max_z"), F.round(F.avg("z"), 4).alias("mean_z"), F.sum("edge").alias("boundary_cells"))


def sub_basins(directed: DataFrame, links: DataFrame) -> DataFrame:
    """Each cell with the stream link it first reaches (place of the link's end)."""
    on = links.select("id", "link")
    edges = flow_edges(directed).join(on, "id", "left")
    down = graph.descend(edges.select("id", F.when(F.col("link").isNull(), F.col("parent")).alias("parent"), "len")).select("id", "root")
    found = down.join(on.select(F.col("id").alias("root"), "link"), "root")
    return found.select(*[v.alias(k) for k, v in place().items()], *[v.alias(f"link_{k}") for k, v in place("link").items()])


def height_above_stream(cells: DataFrame, directed: DataFrame, accumulated: DataFrame, threshold: int = 100) -> DataFrame:
    """z less the z of the stream cell first reached on the way down; null where no stream is reached."""
    on = accumulated.filter(F.col("accumulation") >= threshold).select(cell_id().alias("id"), F.lit(True).alias("on"))
    edges = flow_edges(directed).join(on, "id", "left")
    down = graph.descend(edges.select("id", F.when(F.col("on").isNull(), F.col("parent")).alias("parent"), "len")).select("id", "root")
    z = cells.select(cell_id().alias("id"), "z")
    met = down.join(on.select(F.col("id").alias("root"), "on"), "root", "left").join(z, "id").join(z.select(F.col("id").alias("root"), F.col("z").alias("zs")), "root")
    return met.select(*[v.alias(k) for k, v in place().items()], F.when(F.col("on"), F.col("z") - F.col("zs")).alias("above_stream"))


def snap_pour_points(points: DataFrame, accumulated: DataFrame, search: int = 5) -> DataFrame:
    """points: p, r, c. The cell in the search window with the largest accumulation share over (Manhattan distance + 1)."""
    top = F.broadcast(accumulated.agg(F.max("accumulation").alias("top")))
    span = F.sequence(F.lit(-search), F.lit(search))
    near = points.withColumn("dr", F.explode(span)).withColumn("dc", F.explode(span)).select("p", (F.col("r") + F.col("dr")).alias("r"), (F.col("c") + F.col("dc")).alias("c"), (F.abs("dr") + F.abs("dc")).alias("d"))
    scored = near.join(accumulated, ["r", "c"]).join(top).withColumn("score", F.round(F.col("accumulation") / F.col("top") / (F.col("d") + 1), 9))
    best = scored.groupBy("p").agg(F.max(F.struct("score", (-F.col("r")).alias("r"), (-F.col("c")).alias("c"))).alias("x"))
    return best.select("p", (-F.col("x.r")).alias("r"), (-F.col("x.c")).alias("c"), F.col("x.score").alias("score"))


def trace(directed: DataFrame, cells: DataFrame, starts: DataFrame) -> DataFrame:
    """starts: p, r, c. The way down from each start: p, step, r, c, z, distance in metres."""
    edges = flow_edges(directed)
    ways = graph.walk(edges, starts.select(F.col("p").cast("long").alias("p"), cell_id().alias("id")))
    so_far = Window.partitionBy("p").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    at = ways.join(edges.select("id", "len"), "id").join(cells.select(cell_id().alias("id"), "z"), "id")
    return at.select("p", "step", *[v.alias(k) for k, v in place().items()], "z", F.round(F.coalesce(F.sum("len").over(so_far), F.lit(0.0)) * CELL, 4).alias("distance_m"))


def _spread(z: np.ndarray, own: np.ndarray, known: np.ndarray, by_slope: bool, level: bool = False) -> np.ndarray:
    """Least costs over the own cells (bool) of a bordered array from the known ones (NaN: unknown)."""
    width = z.shape[1]
    near = [(dr * width + dc, 1.0 if level else math.sqrt(dr * dr + dc * dc)) for dr, dc in grid.NEIGHBOURS.values()]
    high, mine = z.ravel().tolist(), (own & ~np.isnan(z)).ravel().tolist()
    best = np.where(np.isnan(known), np.inf, known).ravel().tolist()
    heap = [(best[i], i) for i in np.flatnonzero(~np.isnan(known) & ~np.isnan(z)).tolist()]
    heapq.heapify(heap)
    while heap:
        d, i = heapq.heappop(heap)
        if d > best[i]:
            continue
        for step, length in near:
            j = i + step
            if mine[j] and (not level or high[i] == high[j]):
                to = d + (abs(high[i] - high[j]) * length if by_slope else length)
                if to < best[j] - 1e-9:
                    best[j] = to
                    heapq.heappush(heap, (to, j))
    return np.array(best).reshape(z.shape)


def cost_distance(cells: DataFrame, outlets: DataFrame, by_slope: bool = True, level: bool = False) -> DataFrame:
    """Least cost from any outlet (r, c) over eight-neighbour steps; a step costs |dz| times its length, or its length; with
    `level` only steps between cells of equal height are taken, and each costs 1. A block of cells (some million, as wide
    as the raster where that is narrow) is packed once and solved in one group from what is known on it and around it;
    only costs on blocks' edges go to the next round, in which the blocks beside those that another block improved take
    part, and only the files of their rows of blocks are read. Cells that no way reaches have no row."""
    ground = cells.filter("z is not null").select("r", "c", F.col("z").cast("double").alias("z"))
    e = grid.extent(ground).first()  # one row
    if e["r0"] is None:
        return ground.select("r", "c", F.col("z").alias("cost"))
    bits = graph.BLOCK_BITS
    wide = min(e["c1"] - e["c0"] + 1, 4 << bits)
    axes = {"r": (e["r0"], e["r1"], (16 << 2 * bits) // wide, "br"), "c": (e["c0"], e["c1"], wide, "bc")}

    def dealt(rows: DataFrame) -> DataFrame:
        """Rows for each block that they lie in or beside."""
        for axis, (first, last, size, name) in axes.items():
            low, high = F.floor((F.col(axis) - first - 1) / size), F.floor((F.col(axis) - first + 1) / size)
            rows = rows.withColumn(name, F.explode(F.sequence(F.greatest(low, F.lit(0)).cast("int"), F.least(high, F.lit((last - first) // size)).cast("int"))))
        return rows

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        r0, c0, (z,) = _grid_of(pdf, "z")
        return pd.DataFrame({"br": [key[0]], "bc": [key[1]], "r0": [r0], "c0": [c0], "width": [z.shape[1]], "z": [z.tobytes()]})

    packed = dealt(ground).groupBy("br", "bc").applyInPandas(pack, "br int, bc int, r0 int, c0 int, width int, z binary")
    packed = written(packed, "cost-blocks", "br")
    best = written(outlets.select("r", "c", F.lit(0.0).alias("d")).join(ground.select("r", "c").hint("merge"), ["r", "c"]).distinct(), "cost")

    def run(left: pd.DataFrame, right: pd.DataFrame, whole: bool) -> pd.DataFrame:
        empty = pd.DataFrame({"r": [], "c": [], "d": [], "br": [], "bc": []})
        if not len(left) or not len(right):
            return empty
        br, bc, r0, c0, width, z = left[["br", "bc", "r0", "c0", "width", "z"]].iloc[0]
        z = np.frombuffer(z).reshape(-1, width)
        known = np.full(z.shape, np.nan)
        known[right["r"].to_numpy(int) - r0, right["c"].to_numpy(int) - c0] = right["d"].to_numpy(float)
        own, edge = [], []
        for at, k, (first, last, size, _) in ((np.arange(z.shape[0]) + r0, br, axes["r"]), (np.arange(z.shape[1]) + c0, bc, axes["c"])):
            low, high = first + k * size, first + (k + 1) * size - 1
            own.append((at >= low) & (at <= high))
            edge.append(((at == low) & (k > 0)) | ((at == high) & (high < last)))
        own = own[0][:, None] & own[1][None, :]
        d = _spread(z, own, known, by_slope and not level, level)
        r, c = np.nonzero(own & np.isfinite(d) & (True if whole else edge[0][:, None] | edge[1][None, :]))
        return pd.DataFrame({"r": (r + r0).astype(np.int32), "c": (c + c0).astype(np.int32), "d": d[r, c], "br": br, "bc": bc}) if len(r) else empty

    def solved(here: DataFrame, costs: DataFrame, whole: bool) -> DataFrame:
        return here.groupBy("br", "bc").cogroup(costs.groupBy("br", "bc")).applyInPandas(lambda a, b: run(a, b, whole), "r int, c int, d double, br int, bc int")

    active = written(dealt(best).select("br", "bc").distinct(), "cost-active")
    while rows := [x["br"] for x in active.select("br").distinct().collect()]:  # rows of blocks: few numbers
        here = packed.filter(F.col("br").isin(rows)).join(active, ["br", "bc"], "left_semi")
        found = solved(here, dealt(best).join(active, ["br", "bc"], "left_semi"), False).select("r", "c", F.col("d").alias("nd"), F.col("br").alias("by_r"), F.col("bc").alias("by_c"))
        step = best.join(found, ["r", "c"], "full_outer").withColumn("new", F.col("nd").isNotNull() & (F.col("d").isNull() | (F.col("nd") < F.col("d") - 1e-9)))
        step = written(step.select("r", "c", F.least("d", "nd").alias("d"), "new", "by_r", "by_c"), "cost")
        best = step.select("r", "c", "d")
        # a block knows what it has found itself
        active = written(dealt(step.filter("new")).filter("br <> by_r or bc <> by_c").select("br", "bc").distinct(), "cost-active")
    return solved(packed, dealt(best), True).select("r", "c", F.round("d", 4).alias("cost"))


def flow_truncation(directed: DataFrame, max_slope: float = 45.0) -> DataFrame:
    """One row: share of draining cells whose way down is steeper than max_slope. directed: r, c, z, d8."""
    edges = flow_edges(directed)
    z = directed.select(cell_id().alias("id"), "z")
    drop = edges.filter("parent is not null").join(z, "id").join(z.select(F.col("id").alias("parent"), F.col("z").alias("zp")), "parent")
    steep = ((F.col("z") - F.col("zp")) / (F.col("len") * CELL)) > math.tan(math.radians(max_slope))
    return drop.agg(F.round(F.coalesce(F.avg(steep.cast("double")), F.lit(0.0)), 6).alias("truncation"))


#: Indices from z's slope (degrees) and accumulation a; SQL.
INDICES: dict[str, str] = {
    "twi": f"CASE WHEN slope >= 0.1 THEN least(greatest(ln(a * {CELL * CELL!r} / tan(radians(slope))), 0.0), 25.0) END",
    "stream_power_index": f"ln(greatest(a * {CELL * CELL!r}, 1e-10) * greatest(tan(radians(slope)), 1e-10)) + 0 * slope",
    "sediment_transport_index": f"power(a * {CELL!r} / 22.13, 0.4) * power(sin(radians(greatest(slope, 0.001))) / 0.0896, 1.3) + 0 * slope",
    "ls_factor": f"power(a * {CELL!r} / 22.13, 0.4 * (tan(radians(slope)) * 100 / (tan(radians(slope)) * 100 + 1))) * power(tan(radians(slope)) * 100 / 22.13, 0.4 * (tan(radians(slope)) * 100 / (tan(radians(slope)) * 100 + 1)) + 1)",
    "slope_area_ratio": "tan(radians(slope)) / sqrt(a + 1.0)",
    "slope_area_power": f"CASE WHEN a > 0 THEN slope / (a * {CELL!r}) END",
    "specific_catchment_area": f"a * {CELL!r}",
    "chi": f"sqrt(a) * {CELL!r}",
}


def index(cells: DataFrame, accumulated: DataFrame, *names: str) -> DataFrame:
    """Named indices of every cell; slope and accumulation are made once for all of them."""
    base = terrain.derive(cells, "slope", digits=9).join(accumulated.select("r", "c", F.col("accumulation").cast("double").alias("a")).hint("merge"), ["r", "c"])
    return base.select("r", "c", *[F.expr(f"round({INDICES[x]}, 4)").alias(x) for x in names])


def hack(directed: DataFrame, accumulated: DataFrame, least: int = 100) -> DataFrame:
    """One row: exponent and coefficient of ln(length + 1) against ln(accumulation) over cells above least."""
    down = graph.descend(flow_edges(directed)).select("id", (F.col("distance") * CELL).alias("m"))
    at = accumulated.filter(F.col("accumulation") > least).select(cell_id().alias("id"), F.ln("accumulation").alias("x")).join(down, "id").withColumn("y", F.ln(F.col("m") + 1))
    return at.agg(F.round(F.regr_slope("y", "x"), 4).alias("hack_exponent"), F.round(F.exp(F.regr_intercept("y", "x")), 2).alias("k_coefficient"), F.count(F.lit(1)).alias("n_cells"))


def drainage_density(accumulated: DataFrame, half: int = 5) -> DataFrame:
    """Share of stream cells (accumulation at least the root of the cell count) in the window, per km² of a cell."""
    n = F.broadcast(accumulated.agg(F.sqrt(F.count(F.lit(1))).alias("least")))
    flagged = accumulated.join(n).select("r", "c", (F.col("accumulation") >= F.col("least")).cast("double").alias("z"))
    out = grid.box(flagged, half, {"t": ("sum", "z")})
    return out.select("r", "c", F.round(F.col("t") / (2 * half + 1) ** 2 / (CELL * CELL / 1e6), 4).alias("drainage_density"))


def cross_section_area(profile: DataFrame) -> DataFrame:
    """profile: line, i, x, z. Sum of |dz| |dx| over consecutive points."""
    order = Window.partitionBy("line").orderBy("i")
    part = F.abs(F.col("z") - F.lag("z").over(order)) * F.abs(F.col("x") - F.lag("x").over(order))
    return profile.withColumn("part", part).groupBy("line").agg(F.round(F.sum("part"), 4).alias("area"))
