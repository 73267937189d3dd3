"""Lines and rings out of directed pieces: contour lines, boundaries of areas, stream lines, ways upstream.

Pieces (a contour's segment in a square, a cell's side) know the piece that follows them, and each follows at most one.
`chain` puts them in order: within a block of squares one bounded group links them in NumPy, and only the chains that
leave a block go through rounds of joins by doubled jumps. A closed line starts at its least key. No line is ever gathered
into one row or task, so a coast may be as long as the raster allows; `line_strings` gathers those that fit.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import written
from . import graph, grid, hydro

_LINKED = "k long, e long, nxt long, head long, place long, size long, last long"


def _link(pdf: pd.DataFrame) -> pd.DataFrame:
    """The pieces of a block with the first of their chain, their place in it, its size and the key after it (NONE where
    it closes or ends). A chain that closes in the block starts at its least key."""
    pdf = pdf.sort_values(["k", "e"]).reset_index(drop=True)
    k, e, nxt = (pdf[c].to_numpy(np.int64) for c in ("k", "e", "nxt"))
    n = len(pdf)
    keys = pd.MultiIndex.from_arrays([k, e])
    at = keys.get_indexer(pd.MultiIndex.from_arrays([k, nxt]))
    before = np.full(n, -1)
    before[at[at >= 0]] = np.flatnonzero(at >= 0)
    # back to the first piece; in a ring the jumps go round, and the least place passed is its start
    jump, least, hops = before.copy(), np.arange(n), np.zeros(n, np.int64)
    head = np.where(before < 0, np.arange(n), -1)
    for _ in range(int(n).bit_length() + 1):
        on = np.flatnonzero(jump >= 0)
        if not len(on):
            break
        least[on] = np.minimum(least[on], least[jump[on]])
        jump[on] = jump[jump[on]]
    ring = jump >= 0
    cut = ring & (least == np.arange(n))
    before[cut] = -1
    jump = np.where(before >= 0, before, np.arange(n))
    hops = (before >= 0).astype(np.int64)
    while True:
        far = jump[jump]
        if (far == jump).all():
            break
        hops, jump = hops + hops[jump], far
    head = jump
    size = np.bincount(head, minlength=n)[head]
    last = np.full(n, graph.NONE)
    end = hops == size - 1
    last[head[end]] = np.where(ring[end], graph.NONE, nxt[end])
    return pd.DataFrame({"k": k, "e": e, "nxt": nxt, "head": e[head], "place": hops, "size": size, "last": last[head]})


def _rings_cut(links: DataFrame) -> DataFrame:
    """links: id, parent, of paths and rings. Each ring loses the link into its least id: doubled jumps see ever longer
    stretches, and rows that reach an end leave, so after as many rounds as n has bits only rings are left."""
    moving = written(links.filter("parent is not null").select("id", F.col("parent").alias("jump"), F.col("id").alias("least")), "rings")
    rounds = int(moving.count()).bit_length() + 1
    for _ in range(rounds):
        to = moving.select(F.col("id").alias("jump"), F.col("jump").alias("far"), F.col("least").alias("l2"))
        moving = written(moving.join(to, "jump").select("id", F.col("far").alias("jump"), F.least("least", "l2").alias("least")), "rings")
        if moving.isEmpty():
            return links
    starts = moving.filter("id = least").select(F.col("id").alias("parent"), F.lit(True).alias("cut"))
    return links.join(starts, "parent", "left").withColumn("parent", F.when(F.col("cut").isNull(), F.col("parent")))


def chain(pieces: DataFrame) -> DataFrame:
    """pieces: k (a level or label), e (the piece's key, once in its k), nxt (the key that follows), br, bc (its block).
    Adds line (the key of its line's first piece), seq (0 onwards), n_pieces and closed."""
    packed = pieces.select("k", "e", F.coalesce("nxt", F.lit(graph.NONE)).alias("nxt"), "br", "bc")
    local = written(packed.groupBy("br", "bc").applyInPandas(_link, _LINKED), "chains")
    whole = local.filter("place = 0").select("k", "head", "size", F.when(F.col("last") != graph.NONE, F.col("last")).alias("last"))
    whole = written(whole, "chain-heads")
    ident = lambda e: F.struct(F.col("k"), F.col(e).alias("e"))
    known = whole.select("k", F.col("head").alias("last"), F.lit(True).alias("there"))
    edges = whole.join(known, ["k", "last"], "left").select(ident("head").alias("id"), F.when(F.col("there"), ident("last")).alias("parent"), "size")
    edges = written(edges, "chain-edges")
    cut = written(_rings_cut(edges.select("id", "parent")), "chain-cut")
    sized = cut.join(edges.select("id", "size", F.col("parent").alias("whole_parent")), "id")
    ranked = graph.leap(sized.select("id", "parent", F.col("size").cast("double").alias("len"), F.lit(1).alias("hops")))
    ranked = sized.join(ranked.select("id", "root", "distance"), "id", "left").select("id", "size", "whole_parent", "parent", F.coalesce("root", "id").alias("root"), F.coalesce("distance", F.lit(0.0)).cast("long").alias("ahead"))
    ranked = written(ranked, "chain-ranked")
    # the first chain of a line has most ahead of it; the last one's own link back to it tells a ring
    lines = ranked.groupBy("root").agg(F.max(F.struct("ahead", "id")).alias("first"), F.max(F.when(F.col("id") == F.col("root"), F.col("size"))).alias("last_size"), F.max(F.when(F.col("id") == F.col("root"), F.col("whole_parent"))).alias("back"))
    lines = lines.select("root", F.col("first.id").alias("start"), (F.col("first.ahead") + F.col("last_size")).alias("n_pieces"), F.col("back").isNotNull().alias("ring"), F.col("first.ahead").alias("most"))
    placed = ranked.join(lines, "root").select(F.col("id.k").alias("k"), F.col("id.e").alias("head"), F.col("start.e").alias("line"), (F.col("most") - F.col("ahead")).alias("before"), "n_pieces", "ring")
    closed_here = local.groupBy("k", "head").agg(F.max_by("nxt", "place").alias("after")).filter("after = head").select("k", "head", F.lit(True).alias("own"))
    placed = placed.join(closed_here, ["k", "head"], "left").withColumn("closed", F.col("ring") | F.coalesce("own", F.lit(False)))
    placed = local.join(placed, ["k", "head"]).select("k", "e", "line", (F.col("before") + F.col("place")).alias("seq"), "n_pieces", "closed", "ring")
    placed = written(placed, "chain-placed")
    # a ring over several blocks starts at the head of a chain: turn it to its least key, whatever the blocks are
    turn = placed.filter("ring").groupBy("k", "line").agg(F.min(F.struct("e", "seq")).alias("least"))
    turned = placed.join(turn, ["k", "line"], "left")
    line = F.coalesce("least.e", "line").alias("line")
    seq = F.when(F.col("least").isNull(), F.col("seq")).otherwise(F.pmod(F.col("seq") - F.col("least.seq"), F.col("n_pieces"))).alias("seq")
    return turned.select("k", "e", line, seq, "n_pieces", "closed")


def edge_id(r: Column, c: Column, kind: int) -> Column:
    """Key of a grid edge: from (r, c) to the right (0) or down (1)."""
    return F.shiftleft(r.cast("long"), 33).bitwiseOR(F.shiftleft(c.cast("long"), 1)).bitwiseOR(F.lit(kind).cast("long"))


def _blocks(r: str = "r", c: str = "c") -> list[Column]:
    return [F.shiftright(r, graph.BLOCK_BITS).alias("br"), F.shiftright(c, graph.BLOCK_BITS).alias("bc")]


def contour_pieces(cells: DataFrame, interval: float) -> DataFrame:
    """Directed marching squares: k (level / interval), e and nxt (keys of the grid edges where a segment begins and
    ends), y1, x1, y2, x2, br, bc. Higher ground is on the same side all along, so the square on the other side of an edge
    goes on where this one ends. A saddle has two segments, split by the square's mean."""
    square = grid.with_neighbours(cells).select("r", "c", F.col("z").alias("a"), F.col("e").alias("b"), F.col("se").alias("d"), F.col("s").alias("g")).filter("a + b + d + g is not null")
    lo, hi = F.least("a", "b", "d", "g"), F.greatest("a", "b", "d", "g")
    first, top = F.floor(lo / interval) + 1, F.floor(hi / interval)
    at = square.filter(top >= first).withColumn("k", F.explode(F.sequence(first, top))).withColumn("level", F.col("k") * F.lit(interval))
    r, c = F.col("r"), F.col("c")

    def side(p: str, q: str, key: Column, low: str, high: str, y, x, step: bool) -> Column:
        """Where the level crosses the side from p to q, clockwise; the place is counted from `low` to `high`, as the
        neighbour counts it. up: the side rises on the way."""
        part = (F.col("level") - F.col(low)) / (F.col(high) - F.col(low))
        here = F.struct(key.alias("key"), F.round(y + part if step else y, 6).alias("y"), F.round(x if step else x + part, 6).alias("x"), (F.col(q) >= F.col("level")).alias("up"), F.lit(low + high).alias("name"))
        return F.when((F.col(p) >= F.col("level")) != (F.col(q) >= F.col("level")), here)

    y, x = r.cast("double"), c.cast("double")
    sides = F.array_compact(F.array(
        side("a", "b", edge_id(r, c, 0), "a", "b", y, x, False), side("b", "d", edge_id(r, c + 1, 1), "b", "d", y, x + 1, True),
        side("d", "g", edge_id(r + 1, c, 0), "g", "d", y + 1, x, False), side("g", "a", edge_id(r, c, 1), "a", "g", y, x, True),
    ))
    # where the middle goes with a, the corners b and g are cut off: their sides go together
    with_b = F.when(F.expr("(a >= level) = ((a + b + d + g) / 4 >= level)"), F.array(F.lit("ab"), F.lit("bd"))).otherwise(F.array(F.lit("ab"), F.lit("ag")))
    # a segment runs from a side that rises to one that falls; a saddle has two of each
    together = lambda p, q, t: F.array_contains(t, p["name"]) == F.array_contains(t, q["name"])
    ends = lambda known, t, p: F.get(F.filter(known, lambda q: ~q["up"] & ((F.size(known) == 2) | together(p, q, t))), F.lit(0))
    runs = lambda v: F.transform(F.filter(v["known"], lambda p: p["up"]), lambda p: F.struct(p.alias("p"), ends(v["known"], v["t"], p).alias("q")))
    found = at.select("r", "c", "k", F.explode(F.flatten(F.transform(F.array(F.struct(sides.alias("known"), with_b.alias("t"))), runs))).alias("s"))
    return found.select(F.col("k").cast("long").alias("k"), F.col("s.p.key").alias("e"), F.col("s.q.key").alias("nxt"), F.col("s.p.y").alias("y1"), F.col("s.p.x").alias("x1"), F.col("s.q.y").alias("y2"), F.col("s.q.x").alias("x2"), *_blocks())


def contour_lines(cells: DataFrame, interval: float) -> DataFrame:
    """Contours as lines: level, line, seq, y1, x1, y2, x2 of every segment in order, n_pieces and closed."""
    pieces = written(contour_pieces(cells, interval), "contour-pieces")
    placed = chain(pieces)
    return pieces.join(placed, ["k", "e"]).select((F.col("k") * F.lit(interval)).alias("level"), "line", "seq", "y1", "x1", "y2", "x2", "n_pieces", "closed")


def line_strings(lines: DataFrame, most: int = 1_000_000) -> DataFrame:
    """One row a line of at most `most` pieces: level, line, closed, coordinates (y, x) in order; a ring ends where it began."""
    fits = lines.filter(F.col("n_pieces") <= most)
    rows = fits.groupBy("level", "line", "closed").agg(F.sort_array(F.collect_list(F.struct("seq", F.struct(F.col("y1").alias("y"), F.col("x1").alias("x")).alias("at")))).alias("p"), F.max_by(F.struct(F.col("y2").alias("y"), F.col("x2").alias("x")), "seq").alias("end"))
    return rows.select("level", "line", "closed", F.concat(F.transform("p", lambda v: v["at"]), F.array("end")).alias("coordinates"))


def area_sides(marked: DataFrame) -> DataFrame:
    """marked: r, c, p (a label). The sides of cells at which the label changes, clockwise around the area: k (the label),
    e and nxt (cell and side: top 0, right 1, bottom 2, left 3), y1, x1, y2, x2 (corners), br, bc. At a corner that two
    cells of the area only touch in, the boundary stays with its cell, so areas are 4-connected."""
    # cells may be missing, so a corner is looked up by way of the cell ahead: that matters only where it is there
    one = grid.with_neighbours(marked.filter("p is not null").select("r", "c", F.col("p").cast("long").alias("z")))
    one = one.select("r", "c", F.col("z").alias("k"), *[F.col(x).alias(f"_{x}") for x in ("n", "s", "w", "e", "ne", "sw")], F.struct("e", "w").alias("z"))
    around = grid.with_neighbours(one).select("*", F.col("s.e").alias("_se"), F.col("n.w").alias("_nw"))
    same = {x: F.coalesce(F.col(f"_{x}") == F.col("k"), F.lit(False)) for x in ("n", "ne", "e", "se", "s", "sw", "w", "nw")}
    key = lambda dr, dc, side: F.shiftleft((F.col("r") + dr).cast("long"), 34).bitwiseOR(F.shiftleft((F.col("c") + dc).cast("long"), 2)).bitwiseOR(F.lit(side).cast("long"))
    y, x = F.col("r").cast("double") - 0.5, F.col("c").cast("double") - 0.5
    # side: the neighbour beyond it; the one ahead along the side and the one ahead beyond, with their offsets; its corners
    turns = [
        (0, "n", ("e", 0, 1), ("ne", -1, 1), (y, x, y, x + 1)), (1, "e", ("s", 1, 0), ("se", 1, 1), (y, x + 1, y + 1, x + 1)),
        (2, "s", ("w", 0, -1), ("sw", 1, -1), (y + 1, x + 1, y + 1, x)), (3, "w", ("n", -1, 0), ("nw", -1, -1), (y + 1, x, y, x)),
    ]
    rows = []
    for side, beyond, (ahead, dr, dc), (corner, er, ec), ends in turns:
        follows = F.when(~same[ahead], key(0, 0, (side + 1) % 4)).when(~same[corner], key(dr, dc, side)).otherwise(key(er, ec, (side + 3) % 4))
        rows.append(F.when(~same[beyond], F.struct(key(0, 0, side).alias("e"), follows.alias("nxt"), *[v.alias(n) for v, n in zip(ends, ("y1", "x1", "y2", "x2"), strict=True)])))
    found = around.select("r", "c", "k", F.explode(F.array_compact(F.array(*rows))).alias("s"))
    return found.select("k", "s.*", *_blocks())


def area_rings(marked: DataFrame) -> DataFrame:
    """Boundaries of labelled areas as rings: p, line, seq, y1, x1, y2, x2, n_pieces. Outer rings run clockwise (rows grow
    downwards), holes the other way round."""
    sides = written(area_sides(marked), "area-sides")
    return sides.join(chain(sides), ["k", "e"]).select(F.col("k").alias("p"), "line", "seq", "y1", "x1", "y2", "x2", "n_pieces")


def ring_summary(rings: DataFrame) -> DataFrame:
    """Per ring: pieces, the area in cells (negative for a hole) and its extent."""
    twice = F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1"))
    return rings.groupBy("p", "line").agg(F.count(F.lit(1)).alias("n_pieces"), F.round(twice / 2, 3).alias("area"), F.min("y1").alias("min_y"), F.max("y1").alias("max_y"), F.min("x1").alias("min_x"), F.max("x1").alias("max_x"))


def stream_lines(network: DataFrame) -> DataFrame:
    """The cells of every stretch between junctions, from its upper end down to the cell it ends in: link_r, link_c, seq,
    r, c, n_cells. The junction itself begins the next stretch; a stretch that flows into one has its cell at the end."""
    joint = network.filter("n_in > 1").select(F.col("id").alias("parent"), F.lit(True).alias("joint"))
    cut = written(network.join(joint, "parent", "left").select("id", F.when(F.col("joint").isNull(), F.col("parent")).alias("parent"), F.col("parent").alias("into"), "len"), "stream-cut")
    down = written(graph.descend(cut.select("id", "parent", "len")).select("id", "root", "hops"), "stream-down")
    longest = down.groupBy("root").agg(F.max("hops").alias("most"))
    inner = down.join(longest, "root").select("root", "id", (F.col("most") - F.col("hops")).alias("seq"), (F.col("most") + 1).alias("n_cells"))
    last = cut.filter("parent is null and into is not null").select(F.col("id").alias("root"), F.col("into").alias("id")).join(longest, "root").select("root", "id", (F.col("most") + 1).alias("seq"), (F.col("most") + 1).alias("n_cells"))
    rows = inner.unionByName(last)
    return rows.select(*[v.alias(f"link_{k}") for k, v in hydro.place("root").items()], F.col("seq").cast("long").alias("seq"), *[v.alias(k) for k, v in hydro.place().items()], F.col("n_cells").cast("long").alias("n_cells"))


def main_stems(directed: DataFrame, accumulated: DataFrame) -> DataFrame:
    """The way upstream from every outlet or pit, at each cell into the neighbour that most cells drain through (of equal
    ones the first in row order): outlet_r, outlet_c, step, r, c. These are the heavy paths of the drainage forest that
    end at its roots."""
    edges = hydro.flow_edges(directed)
    weighed = edges.join(accumulated.select(hydro.cell_id().alias("id"), "accumulation"), "id")
    heavy = weighed.filter("parent is not null").groupBy("parent").agg(F.max_by("id", F.struct("accumulation", -F.col("id"))).alias("id")).select("id", F.lit(True).alias("heavy"))
    cut = written(edges.join(heavy, "id", "left").select("id", F.when(F.col("heavy"), F.col("parent")).alias("parent"), "len", F.col("parent").isNull().alias("outlet")), "stems")
    down = graph.descend(cut.select("id", "parent", "len"))
    roots = cut.filter("outlet").select(F.col("id").alias("root"))
    return down.join(roots, "root").select(*[v.alias(f"outlet_{k}") for k, v in hydro.place("root").items()], F.col("hops").cast("long").alias("step"), *[v.alias(k) for k, v in hydro.place().items()])
