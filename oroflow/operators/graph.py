"""Forests and areas of raster cells, solved block by block first.

A cell's id holds its row and column, and its parent is one of its neighbours. Within a block of BLOCK x BLOCK cells one
bounded group follows all ways in NumPy up to where they leave the block. What is left is a graph of the cells at which
ways cross from block to block, a small share of all cells (1 / 64 at most have a place on a block's edge); only that
graph goes through rounds of joins, by doubled jumps, and rows that have come to their end leave the rounds. A last pass
brings the results back to the cells of each block. Each round is written to the shared folder.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import written

BLOCK_BITS = 8
SHIFT = 32
NONE = -1 << 62  # in place of a parent while rows are in NumPy, where a null would make numbers of 64 bits inexact


def block_of(cell: str = "id", bits: int | None = None) -> list[Column]:
    """Block row and column of a cell id."""
    bits = BLOCK_BITS if bits is None else bits
    return [F.shiftright(F.col(cell), SHIFT + bits).alias("br"), F.shiftright(F.col(cell).bitwiseAND(F.lit((1 << SHIFT) - 1)), bits).alias("bc")]


def on_block_edge(cell: str = "id", bits: int | None = None) -> Column:
    """Whether a cell has a neighbour in another block."""
    last = (1 << (BLOCK_BITS if bits is None else bits)) - 1
    r, c = F.shiftright(F.col(cell), SHIFT).bitwiseAND(F.lit(last)), F.col(cell).bitwiseAND(F.lit(last))
    return r.isin(0, last) | c.isin(0, last)


def _packed() -> Column:
    return F.coalesce("parent", F.lit(NONE)).alias("parent")


def _opened(name: str = "parent") -> Column:
    return F.when(F.col(name) != NONE, F.col(name)).alias(name)


def _inside(ids: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Place of each target among the ascending ids; -1 where it is not there."""
    at = np.minimum(np.searchsorted(ids, to), len(ids) - 1)
    return np.where(ids[at] == to, at, -1)


def _parents(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids (pdf is sorted by them), parents (NONE where there is none), place of each parent in the block."""
    ids = pdf["id"].to_numpy(np.int64)
    parent = pdf["parent"].to_numpy(np.int64)
    return ids, parent, _inside(ids, parent)


def _follow(pdf: pd.DataFrame) -> pd.DataFrame:
    """For each cell of a block: the last cell of its way in the block, distance and hops to there."""
    pdf = pdf.sort_values("id").reset_index(drop=True)
    ids, parent, at = _parents(pdf)
    jump = np.where(at >= 0, at, np.arange(len(ids)))
    distance, hops = np.where(at >= 0, pdf["len"].fillna(0.0).to_numpy(float), 0.0), (at >= 0).astype(np.int64)
    while True:
        far = jump[jump]
        if (far == jump).all():
            break
        distance, hops, jump = distance + distance[jump], hops + hops[jump], far
    return pdf.assign(exit=ids[jump], distance=distance, hops=hops)[["id", "parent", "len", "exit", "distance", "hops"]]


def leap(edges: DataFrame) -> DataFrame:
    """edges: id, parent (null at a root), len, hops, of any forest. id, root, distance, hops of every id with a parent, by
    doubled jumps. A row whose target has come to its end ends too and takes no part in further rounds."""
    moving = written(edges.filter("parent is not null").select("id", F.col("parent").alias("root"), F.col("len").alias("distance"), "hops"), "leap")
    ended: list[DataFrame] = []
    while not moving.isEmpty():
        targets = moving.withColumn("end", F.lit(False))
        for rows in ended:
            targets = targets.unionByName(rows.withColumn("end", F.lit(True)))
        to = targets.select(F.col("id").alias("root"), F.col("root").alias("far"), F.col("distance").alias("d2"), F.col("hops").alias("h2"), "end")
        step = moving.join(to, "root", "left").select("id", F.coalesce("far", "root").alias("root"), (F.col("distance") + F.coalesce("d2", F.lit(0.0))).alias("distance"), (F.col("hops") + F.coalesce("h2", F.lit(0))).alias("hops"), F.coalesce("end", F.lit(True)).alias("end"))
        step = written(step, "leap")
        ended.append(step.filter("end").drop("end"))
        moving = step.filter("not end").drop("end")
    out = moving
    for rows in ended:
        out = out.unionByName(rows)
    return out


def descend(edges: DataFrame) -> DataFrame:
    """edges: id, parent (null at a root), len double. Adds root, distance (sum of len on the way) and hops."""
    schema = "id long, parent long, len double, exit long, distance double, hops long"
    edges = edges.select("id", _packed(), F.col("len").cast("double").alias("len"))
    local = written(edges.groupBy(*block_of()).applyInPandas(_follow, schema).withColumn("parent", _opened()), "descend")
    portals = local.filter("id = exit and parent is not null").select("id", "parent", "len")
    if portals.isEmpty():
        return local.select("id", "parent", F.col("exit").alias("root"), "distance", "hops")
    entries = local.filter(on_block_edge()).select(F.col("id").alias("parent"), "exit", "distance", "hops")
    links = portals.join(entries, "parent").select("id", F.col("exit").alias("parent"), (F.col("len") + F.col("distance")).alias("len"), (F.col("hops") + 1).alias("hops"))
    far = leap(links).select(F.col("id").alias("exit"), F.col("root").alias("far"), F.col("distance").alias("d2"), F.col("hops").alias("h2"))
    return local.join(far, "exit", "left").select("id", "parent", F.coalesce("far", "exit").alias("root"), (F.col("distance") + F.coalesce("d2", F.lit(0.0))).alias("distance"), (F.col("hops") + F.coalesce("h2", F.lit(0))).alias("hops"))


# ---------------------------------------------------------------- sums along the ways

def _gathered(at: np.ndarray, w: np.ndarray, combine: str) -> np.ndarray:
    """Sum or max of w over all cells of a block whose way passes the cell, itself among them. Round k adds what lies 2^k
    to 2^(k+1) - 1 steps up, through the cells whose 2^k-th ancestor the cell is."""
    acc, jump = w.astype(float), at.copy()
    while True:
        src = np.flatnonzero(jump >= 0)
        if not len(src):
            return acc
        if combine == "sum":
            acc = acc + np.bincount(jump[src], weights=acc[src], minlength=len(acc))
        else:
            more = acc.copy()
            np.maximum.at(more, jump[src], acc[src])
            acc = more
        jump[src] = jump[jump[src]]


def _pull(edges: DataFrame, combine: str) -> DataFrame:
    """As accumulate, for any forest, by rounds of joins: id, acc."""
    total = {"sum": lambda a, b: a + F.coalesce(b, F.lit(0.0)), "max": F.greatest}[combine]
    state = written(edges.select("id", F.col("parent").alias("jump"), F.col("w").alias("acc")), "accumulate")
    while not state.filter("jump is not null").isEmpty():
        up = state.filter("jump is not null").groupBy(F.col("jump").alias("id")).agg((F.sum if combine == "sum" else F.max)("acc").alias("more"))
        far = state.filter("jump is not null").select(F.col("id").alias("jump"), F.col("jump").alias("far"))
        step = state.join(up, "id", "left").join(far, "jump", "left").select("id", F.col("far").alias("jump"), total(F.col("acc"), F.col("more")).alias("acc"))
        state = written(step, "accumulate")
    return state.select("id", "acc")


def accumulate(edges: DataFrame, weight: str = "w", combine: str = "sum") -> DataFrame:
    """edges: id, parent, weight. Adds acc: the sum (or max) of the weights of all ids whose way passes the id, itself
    among them. A null weight counts as nothing."""
    nothing = 0.0 if combine == "sum" else float("-inf")
    cells = written(edges.select("id", _packed(), F.coalesce(F.col(weight).cast("double"), F.lit(nothing)).alias("w")), "accumulate-cells")  # read twice
    last = (1 << BLOCK_BITS) - 1

    def at_edges(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id").reset_index(drop=True)
        ids, parent, at = _parents(pdf)
        jump = np.where(at >= 0, at, np.arange(len(ids)))
        while not ((far := jump[jump]) == jump).all():
            jump = far
        acc = _gathered(at, pdf["w"].to_numpy(float), combine)
        r, c = (ids >> SHIFT) & last, ids & last
        edge = (r == 0) | (r == last) | (c == 0) | (c == last)
        return pd.DataFrame({"id": ids, "parent": pdf["parent"], "exit": ids[jump], "leaves": (at < 0) & (parent != NONE), "w": acc})[edge]

    edge = written(cells.groupBy(*block_of()).applyInPandas(at_edges, "id long, parent long, exit long, leaves boolean, w double"), "accumulate-edges")
    portals = edge.filter("leaves").select("id", "parent", "w")
    to = edge.select(F.col("id").alias("parent"), F.col("exit"))
    ends = portals.select(F.col("id").alias("exit"), F.lit(True).alias("on"))
    links = portals.join(to, "parent").join(ends, "exit", "left").select("id", F.when(F.col("on"), F.col("exit")).alias("parent"), "w")
    totals = _pull(links, combine)
    into = totals.join(portals.select("id", "parent"), "id").groupBy(F.col("parent").alias("id")).agg((F.sum if combine == "sum" else F.max)("acc").alias("more"))

    def whole(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame({"id": [], "parent": [], "acc": []})
        left = left.sort_values("id").reset_index(drop=True)
        ids, _, at = _parents(left)
        w = left["w"].to_numpy(float).copy()
        k = _inside(ids, right["id"].to_numpy(np.int64)) if len(right) else np.zeros(0, np.int64)
        w[k] = w[k] + right["more"].to_numpy(float) if combine == "sum" else np.maximum(w[k], right["more"].to_numpy(float))
        acc = _gathered(at, w, combine)
        return pd.DataFrame({"id": ids, "parent": left["parent"], "acc": np.where(np.isneginf(acc), np.nan, acc)})

    cells = cells.select("*", *block_of()).groupBy("br", "bc")
    return cells.cogroup(into.select("id", "more", *block_of()).groupBy("br", "bc")).applyInPandas(lambda a, b: whole(a[["id", "parent", "w"]], b[["id", "more"]]), "id long, parent long, acc double").withColumn("parent", _opened())


# ---------------------------------------------------------------- ways from some cells

def walk(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """edges: id, parent; starts: p, id. Every cell on the way down from each start: p, id, step. A round follows the ways
    through one block each; only blocks that a way enters take part."""
    cells = written(edges.select("id", _packed(), *block_of()), "walk-edges")
    now = starts.select("p", "id", F.lit(0).cast("long").alias("step"))
    found: list[DataFrame] = []

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"p": [], "id": [], "step": [], "next": []})
        left = left.sort_values("id").reset_index(drop=True)
        ids, parent, at = _parents(left)
        right = right[_inside(ids, right["id"].to_numpy(np.int64)) >= 0]
        p, place, step = right["p"].to_numpy(np.int64), _inside(ids, right["id"].to_numpy(np.int64)), right["step"].to_numpy(np.int64)
        parts = []
        while len(p):
            on = at[place] >= 0
            parts.append(pd.DataFrame({"p": p, "id": ids[place], "step": step, "next": np.where(on, NONE, parent[place])}))
            p, place, step = p[on], at[place][on], step[on] + 1
        return pd.concat(parts) if parts else pd.DataFrame({"p": [], "id": [], "step": [], "next": []})

    while True:
        ways = written(now.select("*", *block_of()), "walk-at")
        if ways.isEmpty():
            break
        active = cells.join(ways.select("br", "bc").distinct(), ["br", "bc"], "left_semi")
        step = active.groupBy("br", "bc").cogroup(ways.groupBy("br", "bc")).applyInPandas(lambda a, b: run(a[["id", "parent"]], b[["p", "id", "step"]]), "p long, id long, step long, next long")
        step = written(step.withColumn("next", _opened("next")), "walk")
        found.append(step.select("p", "id", "step"))
        now = step.filter("next is not null").select("p", F.col("next").alias("id"), (F.col("step") + 1).alias("step"))
    out = found[0] if found else now
    for rows in found[1:]:
        out = out.unionByName(rows)
    return out


# ---------------------------------------------------------------- areas

def components(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """links: a, b; nodes: id. id, comp (the smallest linked id): smallest labels of neighbours, then jumps."""
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = written(nodes.select("id", F.col("id").alias("comp")), "labels")
    while True:
        seen = both.join(labels.select(F.col("id").alias("b"), F.col("comp").alias("cb")), "b").groupBy(F.col("a").alias("id")).agg(F.min("cb").alias("m"))
        near = labels.join(seen, "id", "left").select("id", F.col("comp").alias("old"), F.least("comp", "m").alias("comp"))
        up = labels.select(F.col("id").alias("comp"), F.col("comp").alias("top"))
        step = written(near.join(up, "comp").select("id", "old", F.least("comp", "top").alias("comp")), "labels")
        labels = step.select("id", "comp")
        if step.filter("old <> comp").isEmpty():
            return labels


def _areas(pdf: pd.DataFrame) -> pd.DataFrame:
    """4-connected areas of equal k in a block: comp, the smallest id of each."""
    pdf = pdf.sort_values("id").reset_index(drop=True)
    ids, k = pdf["id"].to_numpy(np.int64), pdf["k"].to_numpy()
    a, b = [], []
    for step in (1, 1 << SHIFT):
        to = _inside(ids, ids + step)
        own = np.flatnonzero(to >= 0)
        own = own[k[own] == k[to[own]]]
        a, b = [*a, own], [*b, to[own]]
    a, b = np.concatenate(a), np.concatenate(b)
    label = np.arange(len(ids))
    while len(a):
        la, lb = label[a], label[b]
        differ = la != lb
        if not differ.any():
            break
        np.minimum.at(label, np.maximum(la, lb)[differ], np.minimum(la, lb)[differ])
        while not ((far := label[label]) == label).all():
            label = far
    return pd.DataFrame({"id": ids, "k": k, "comp": ids[label]})


def areas(cells: DataFrame) -> DataFrame:
    """cells: id, k. id, k, comp: the 4-connected area of equal k, named by its smallest id."""
    local = written(cells.select("id", F.col("k").cast("long").alias("k")).groupBy(*block_of()).applyInPandas(_areas, "id long, k long, comp long"), "areas")
    last = (1 << BLOCK_BITS) - 1
    edge = local.filter(on_block_edge())
    right = edge.filter(F.col("id").bitwiseAND(F.lit(last)) == last).select((F.col("id") + 1).alias("to"), "k", F.col("comp").alias("a"))
    down = edge.filter(F.shiftright("id", SHIFT).bitwiseAND(F.lit(last)) == last).select((F.col("id") + (1 << SHIFT)).alias("to"), "k", F.col("comp").alias("a"))
    links = written(right.unionByName(down).join(edge.select(F.col("id").alias("to"), "k", F.col("comp").alias("b")), ["to", "k"]).select("a", "b").distinct(), "areas-links")
    if links.isEmpty():
        return local
    nodes = links.select(F.col("a").alias("id")).unionByName(links.select(F.col("b").alias("id"))).distinct()
    far = components(links, nodes).select(F.col("id").alias("comp"), F.col("comp").alias("far"))
    return local.join(far, "comp", "left").select("id", "k", F.coalesce("far", "comp").alias("comp"))
