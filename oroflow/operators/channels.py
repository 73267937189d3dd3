"""Channels: sections across them, gradients along them, and terrain carved so that water runs through it.

Streams are the cells whose accumulation reaches a threshold; a stream is a 4-connected set of them, named by its first
cell in reading order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import written
from . import graph, grid, hydro

CELL = hydro.CELL


def stream_cells(cells: DataFrame, accumulated: DataFrame, threshold: int = 100) -> DataFrame:
    """r, c, z, id, comp (the stream) of each stream cell with data."""
    on = accumulated.filter(F.col("accumulation") >= threshold).select("r", "c")
    found = written(cells.filter("z is not null").join(on, ["r", "c"]).withColumn("id", hydro.cell_id()), "stream-cells")
    return found.join(hydro.connected(found), "id")


def cross_sections(cells: DataFrame, directed: DataFrame, points: DataFrame, half_width: int = 10, bank: float = 2.0) -> DataFrame:
    """points: p, r, c. The section across the flow through each point, half_width cells to either side. A bank is the
    first cell of its side that stands more than `bank` above the channel, else the side's last cell with data; depths
    are below the lower bank. Cells without data are left out; a point without data has no row, one that drains nowhere
    is crossed as if it drained east."""
    code = F.when(F.col("d8") < 0, 0).otherwise(F.col("d8"))
    turned = [grid.D8_STEPS[(k + 2) % 8] for k in range(8)]
    step = lambda axis: F.element_at(F.array(*[F.lit(t[axis]) for t in turned]), code + 1)
    at = points.join(directed.select("r", "c", "d8", F.col("z").alias("z0")), ["r", "c"]).filter("z0 is not null")
    at = at.withColumns({"dr": step(0), "dc": step(1)}).withColumn("k", F.explode(F.sequence(F.lit(-half_width), F.lit(half_width))))
    at = at.select("p", "k", "z0", F.when(F.col("dr") * F.col("dc") != 0, CELL * 2**0.5).otherwise(CELL).alias("len"), (F.col("r") + F.col("k") * F.col("dr")).alias("r"), (F.col("c") + F.col("k") * F.col("dc")).alias("c"))
    line = at.join(cells.filter("z is not null"), ["r", "c"]).select("p", "k", "z0", "len", "z")
    high = F.col("z") > F.col("z0") + bank
    sides = line.groupBy("p").agg(
        F.coalesce(F.max(F.when((F.col("k") < 0) & high, F.col("k"))), F.min("k")).alias("left"),
        F.coalesce(F.min(F.when((F.col("k") > 0) & high, F.col("k"))), F.max("k")).alias("right"),
    )
    inside = line.join(sides, "p").filter(F.col("k").between(F.col("left"), F.col("right")))
    level = inside.filter("k = left or k = right").groupBy("p").agg(F.min("z").alias("level"))
    depth = F.greatest(F.col("level") - F.col("z"), F.lit(0.0))
    out = inside.join(level, "p").groupBy("p").agg(F.first("left").alias("left"), F.first("right").alias("right"), F.first("level").alias("bank_z"), F.first("z0").alias("channel_z"), ((F.first("right") - F.first("left")) * F.first("len")).alias("w"), F.avg(depth).alias("d"), F.max(depth).alias("max_depth"))
    area = F.col("w") * F.col("d")
    radius = F.when(F.col("w") > 0, area / (F.col("w") + 2 * F.col("d"))).otherwise(0.0)
    return out.select("p", "left", "right", "bank_z", "channel_z", F.round("w", 2).alias("width_m"), "max_depth", F.round(area, 2).alias("area_m2"), F.round(radius, 4).alias("hydraulic_radius_m"))


def stream_gradients(network: DataFrame, cells: DataFrame) -> DataFrame:
    """r, c, gradient: fall to the stream cell below over the way to it; null where the stream ends."""
    z = cells.select(hydro.cell_id().alias("id"), "z")
    met = network.join(z, "id").join(z.select(F.col("id").alias("parent"), F.col("z").alias("zp")), "parent", "left")
    return met.select(*[v.alias(k) for k, v in hydro.place().items()], F.round(F.abs(F.col("z") - F.col("zp")) / (F.col("len") * CELL), 6).alias("gradient"))


def distributary_slope(streams: DataFrame) -> DataFrame:
    """streams: as from stream_cells. Each stream's first cell (reading order), its cells, and the mean slope from its
    first to its last cell."""
    per = streams.groupBy("comp").agg(F.count(F.lit(1)).alias("n_cells"), F.min_by("z", "id").alias("z0"), F.max_by("z", "id").alias("z1"))
    return per.select(*[v.alias(f"stream_{k}") for k, v in hydro.place("comp").items()], "n_cells", F.round((F.col("z0") - F.col("z1")) / (F.col("n_cells") * CELL), 6).alias("slope"))


def _lowest(streams: DataFrame) -> DataFrame:
    low = streams.groupBy("comp").agg(F.min("z").alias("low"))
    return streams.join(low, "comp").select("r", "c", "z", "low")


def burn_streams(cells: DataFrame, streams: DataFrame) -> DataFrame:
    """Each stream cell takes the lowest z of its stream."""
    return cells.join(_lowest(streams).select("r", "c", "low"), ["r", "c"], "left").select("r", "c", F.coalesce("low", "z").alias("z"))


def fill_burn(cells: DataFrame, streams: DataFrame) -> DataFrame:
    return hydro.fill_depressions(burn_streams(cells, streams))


def breach_bridges(cells: DataFrame, streams: DataFrame, max_width: int = 10) -> DataFrame:
    """A stream cell more than a metre above its stream's lowest takes that height where at most max_width stream cells
    lie within max_width columns of it."""
    across = Window.partitionBy("r", "__block").orderBy("c").rangeBetween(-max_width, max_width)
    wide = grid._own(grid._dealt(_lowest(streams), "c", max_width).withColumn("n", F.count(F.lit(1)).over(across)), "c")
    cut = wide.filter((F.col("z") > F.col("low") + 1.0) & (F.col("n") <= max_width)).select("r", "c", "low")
    return cells.join(cut, ["r", "c"], "left").select("r", "c", F.coalesce("low", "z").alias("z"))


def breach_to_outlets(cells: DataFrame, outlets: DataFrame, max_cost: float = 100.0) -> DataFrame:
    """outlets: r, c. A cell above the lowest outlet takes that height where the distance in cells to some outlet, plus
    ten for each metre above, is at most max_cost. Cells meet outlets by blocks of max_cost cells."""
    side = max(1, int(max_cost))
    on = F.broadcast(outlets.join(cells, ["r", "c"]).agg(F.min("z").alias("low")))  # one row
    near = F.sequence(F.lit(-1), F.lit(1))
    spread = outlets.select(F.col("r").alias("ro"), F.col("c").alias("co"), F.explode(near).alias("i")).withColumn("j", F.explode(near))
    spread = spread.select("ro", "co", (F.floor(F.col("ro") / side) + F.col("i")).alias("br"), (F.floor(F.col("co") / side) + F.col("j")).alias("bc"))
    high = cells.join(on).filter("z > low").withColumns({"br": F.floor(F.col("r") / side), "bc": F.floor(F.col("c") / side)})
    away = F.sqrt(F.pow(F.col("h.r") - F.col("o.ro"), 2) + F.pow(F.col("h.c") - F.col("o.co"), 2))
    meets = (F.col("h.br") == F.col("o.br")) & (F.col("h.bc") == F.col("o.bc")) & (away + (F.col("h.z") - F.col("h.low")) * 10.0 <= max_cost)
    cut = high.alias("h").join(spread.alias("o"), meets, "left_semi").select("r", "c", "low")
    cut = cut.join(outlets.select("r", "c"), ["r", "c"], "left_anti")
    return cells.join(cut, ["r", "c"], "left").select("r", "c", F.coalesce("low", "z").alias("z"))


def clean(cells: DataFrame) -> DataFrame:
    """Filled terrain; cells without a way down in it take the lowest z that the terrain has among their four neighbours."""
    filled = hydro.d8(hydro.fill_depressions(cells)).select("r", "c", F.col("z").alias("filled"), "d8")
    around = grid.with_neighbours(cells.filter("z is not null")).select("r", "c", F.least("n", "s", "w", "e").alias("low"))
    return filled.join(around, ["r", "c"]).select("r", "c", F.when(F.col("d8") < 0, F.coalesce("low", "filled")).otherwise(F.col("filled")).alias("z"))


def breach_depressions(cells: DataFrame, max_depth: float = 100.0) -> DataFrame:
    """Carved terrain: along the ways that water takes over the filled terrain no cell stays above the lowest one
    upstream of it, by max_depth at most. Flats of the filled terrain drain to the nearest cell where they are left, over
    the first way (by code) that is a step nearer; steps are counted block by block. Flats walled in by cells without data
    drain nowhere."""
    e = F.broadcast(grid.extent(cells.filter("z is not null")))
    filled = written(hydro.d8(hydro.fill_depressions(cells)), "breach-filled")
    edge = (F.col("r") == F.col("r0")) | (F.col("r") == F.col("r1")) | (F.col("c") == F.col("c0")) | (F.col("c") == F.col("c1"))
    state = filled.join(e).select("r", "c", F.col("z").alias("level"), "d8", edge.alias("edge"))
    down = state.filter("d8 >= 0 or edge")
    flat = written(state.filter("d8 < 0 and not edge").select("r", "c", "level"), "breach-flat")
    ways = F.explode(F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc"), F.lit(k).alias("d8")) for k, (dr, dc) in enumerate(grid.D8_STEPS)]))
    to = [(F.col("r") + F.col("w.dr")).alias("r"), (F.col("c") + F.col("w.dc")).alias("c"), "level"]
    beside = flat.withColumn("w", ways).select(*to).distinct()
    exits = written(down.join(beside, ["r", "c", "level"], "left_semi").select("r", "c", "level"), "breach-exits")
    ground = flat.unionByName(exits)
    steps = hydro.cost_distance(ground.withColumnRenamed("level", "z"), exits, level=True)
    steps = written(ground.join(steps.hint("merge"), ["r", "c"]).select("r", "c", "level", F.col("cost").cast("long").alias("steps")), "breach-steps")
    sent = steps.filter("steps > 0").withColumn("w", ways).select(F.col("r").alias("fr"), F.col("c").alias("fc"), *to, (F.col("steps") - 1).alias("steps"), F.col("w.d8").alias("d8"))
    first = sent.join(steps, ["r", "c", "level", "steps"], "left_semi").groupBy(F.col("fr").alias("r"), F.col("fc").alias("c")).agg(F.min("d8").alias("d8"))
    known = hydro.flow_edges(down).unionByName(hydro.flow_edges(flat.join(first, ["r", "c"], "left").select("r", "c", F.coalesce("d8", F.lit(-1)).alias("d8"))))
    z = cells.select(hydro.cell_id().alias("id"), "z").hint("merge")
    low = graph.accumulate(known.join(z, "id").withColumn("w", -F.col("z")), combine="max").select("id", (-F.col("acc")).alias("low"))
    carved: Column = F.greatest(F.col("low"), F.col("z") - max_depth)
    return z.join(low, "id").select(*[v.alias(k) for k, v in hydro.place().items()], carved.alias("z"))
