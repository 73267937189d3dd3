"""Points, lines and polygons over rasters and among themselves.

Georeference of a raster: (lat0, lon0, dy, dx): row r is at lat0 - r dy, column c at lon0 + c dx. Spatial joins are
equi-joins on blocks of space, with the exact test after it, so neither side is broadcast and no pair of far things
meets. Polygons come as edges (zone, x1, y1, x2, y2), outer rings only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..plans.scratch import written
from . import grid, terrain

GEO = (0.0, 0.0, 0.001, 0.001)
_PIECE = 65_536  # cells of a segment that are laid out at once


def to_cell(lat: str, lon: str, ref: tuple[float, float, float, float] = GEO) -> dict[str, str]:
    """SQL of the nearest cell; halves go to the even one."""
    lat0, lon0, dy, dx = ref
    return {"r": f"CAST(rint(({lat0} - {lat}) / {dy}) AS INT)", "c": f"CAST(rint(({lon} - {lon0}) / {dx}) AS INT)"}


def extract_at_points(points: DataFrame, cells: DataFrame, *derived: str) -> DataFrame:
    """points: pid, r, c. Elevation and derivatives at each point's cell; null outside the raster."""
    at = cells.join(terrain.derive(cells, *derived), ["r", "c"]) if derived else cells
    return points.join(at, ["r", "c"], "left").select("pid", "r", "c", "z", *derived)


def bilinear(points: DataFrame, cells: DataFrame) -> DataFrame:
    """points: pid, y, x in cell units. Interpolated z, rounded to 1; where a corner has no data, the first corner that
    has (nw, ne, sw, se)."""
    at = points.withColumns({"r": F.floor("y").cast("int"), "c": F.floor("x").cast("int")})
    around = grid.with_neighbours(cells).select("r", "c", "z", "e", "s", "se")
    met = at.join(around, ["r", "c"], "left").withColumns({"fy": F.col("y") - F.col("r"), "fx": F.col("x") - F.col("c")})
    mixed = F.expr("z * (1 - fy) * (1 - fx) + e * (1 - fy) * fx + s * fy * (1 - fx) + se * fy * fx")
    return met.select("pid", F.round(F.coalesce(mixed, "z", "e", "s", "se"), 1).alias("z"))


def points_in_polygons(points: DataFrame, edges: DataFrame, block: float = 16.0) -> DataFrame:
    """points: pid, x, y. pid, zone where the even-odd rule has the point inside. Polygons are dealt to the blocks of
    their boxes; an edge counts where the ray to the right crosses it."""
    boxes = edges.groupBy("zone").agg(F.least(F.min("x1"), F.min("x2")).alias("xa"), F.greatest(F.max("x1"), F.max("x2")).alias("xb"), F.least(F.min("y1"), F.min("y2")).alias("ya"), F.greatest(F.max("y1"), F.max("y2")).alias("yb"))
    span = lambda a, b: F.sequence(F.floor(F.col(a) / block), F.floor(F.col(b) / block))
    dealt = boxes.withColumn("bx", F.explode(span("xa", "xb"))).withColumn("by", F.explode(span("ya", "yb")))
    near = points.withColumns({"bx": F.floor(F.col("x") / block), "by": F.floor(F.col("y") / block)}).join(dealt, ["bx", "by"])
    near = near.filter("x >= xa AND x <= xb AND y >= ya AND y <= yb").select("pid", "x", "y", "zone", "by")
    bands = edges.withColumn("by", F.explode(F.sequence(F.floor(F.least("y1", "y2") / block), F.floor(F.greatest("y1", "y2") / block))))
    hits = near.join(bands, ["zone", "by"]).filter("(y1 > y) <> (y2 > y)").filter("x < (x2 - x1) * (y - y1) / (y2 - y1) + x1")
    return hits.groupBy("pid", "zone").agg(F.count(F.lit(1)).alias("k")).filter("k % 2 = 1").select("pid", "zone")


def spans(edges: DataFrame) -> DataFrame:
    """Polygons as runs of cells (x = column, y = row): zone, r, first and last column. Between each second crossing of a
    row with the outline and the next one lies a run."""
    at = edges.withColumn("r", F.explode(F.filter(F.sequence(F.ceil(F.least("y1", "y2")), F.ceil(F.greatest("y1", "y2"))), lambda r: r < F.greatest("y1", "y2"))))
    crossings = at.groupBy("zone", "r").agg(F.array_sort(F.collect_list(F.expr("(x2 - x1) * (r - y1) / (y2 - y1) + x1"))).alias("x"))
    run = lambda i: F.struct(F.ceil(F.get("x", 2 * i)).alias("a"), (F.ceil(F.get("x", 2 * i + 1)) - 1).alias("b"))
    runs = F.transform(F.sequence(F.lit(0), (F.size("x") / 2).cast("int") - 1), run)
    return crossings.filter(F.size("x") > 1).select("zone", F.col("r").cast("int").alias("r"), F.explode(runs).alias("run")).select("zone", "r", F.col("run.a").alias("first"), F.col("run.b").alias("last")).filter("first <= last")


def zonal_stats(cells: DataFrame, edges: DataFrame, block: int = 512) -> DataFrame:
    """Statistics of the cells with data inside each polygon (x = column, y = row). A cell meets only the runs that touch
    its block of its row."""
    dealt = spans(edges).withColumn("b", F.explode(F.sequence(F.floor(F.col("first") / block), F.floor(F.col("last") / block))))
    inside = cells.filter("z is not null").withColumn("b", F.floor(F.col("c") / block)).join(dealt, ["r", "b"]).filter(F.col("c").between(F.col("first"), F.col("last")))
    two = lambda x: F.round(x, 2)
    return inside.groupBy("zone").agg(two(F.avg("z")).alias("mean"), two(F.min("z")).alias("min"), two(F.max("z")).alias("max"), two(F.sum("z")).alias("sum"), two(F.stddev_pop("z")).alias("std"), F.count(F.lit(1)).alias("count"))


def rasterize_lines(segments: DataFrame) -> DataFrame:
    """segments: line, r1, c1, r2, c2. Cells a digital line passes, each once for a line. A segment's own cells differ, so
    only cells of lines with several segments are held against each other, dealt by line and cell; a task
    lays out or compares some million. Long segments are laid out piece by piece."""
    n = F.coalesce(F.greatest(F.abs(F.col("r2") - F.col("r1")), F.abs(F.col("c2") - F.col("c1"))), F.lit(0))
    parts = segments.select("line", "r1", "c1", "r2", "c2", n.alias("n"))
    lines = parts.groupBy("line").agg(F.count(F.lit(1)).alias("m"), F.sum(F.col("n").cast("long") + 1).alias("cells"))
    several = lines.filter("m > 1").select(F.col("line").alias("of"))
    n_one, n_met = lines.agg(F.sum(F.when(F.col("m") == 1, F.col("cells"))), F.sum(F.when(F.col("m") > 1, F.col("cells")))).first()  # one row

    def laid(rows: DataFrame) -> DataFrame:
        at = rows.withColumn("k0", F.explode(F.expr(f"sequence(0, n, {_PIECE})"))).withColumn("k", F.explode(F.expr(f"sequence(k0, least(n, k0 + {_PIECE - 1}))")))
        step = lambda a, b: F.rint(F.col(a) + (F.col(b) - F.col(a)) * F.col("k") / F.greatest("n", F.lit(1))).cast("int")
        return at.select("line", step("r1", "r2").alias("r"), step("c1", "c2").alias("c"))

    same = F.col("line").eqNullSafe(F.col("of"))
    tasks = lambda cells: max(1, math.ceil((cells or 0) / 1e6))
    ones = laid(parts.join(several.hint("merge"), same, "left_anti").repartition(tasks(n_one)))
    if not n_met:
        return ones
    met = laid(parts.join(several.hint("merge"), same, "left_semi")).repartition(tasks(n_met), "line", "r", "c")
    return ones.unionByName(met.distinct())


def contour_segments(cells: DataFrame, interval: float) -> DataFrame:
    """Marching squares: level, r, c and the segment's ends (y1, x1, y2, x2) in each square of four cells. A saddle has
    two segments, split by the square's mean."""
    square = grid.with_neighbours(cells).select("r", "c", F.col("z").alias("a"), F.col("e").alias("b"), F.col("se").alias("d"), F.col("s").alias("g")).filter("a + b + d + g is not null")
    lo, hi = F.least("a", "b", "d", "g"), F.greatest("a", "b", "d", "g")
    first = F.floor(lo / interval) + 1
    at = square.withColumn("k", F.explode(F.filter(F.sequence(first, F.greatest(first, F.ceil(hi / interval) - 0)), lambda k: k * interval <= hi))).withColumn("level", F.col("k") * F.lit(interval))
    cut = lambda p, q: F.when((F.col(p) >= F.col("level")) != (F.col(q) >= F.col("level")), (F.col("level") - F.col(p)) / (F.col(q) - F.col(p)))
    point = lambda y, x, has: F.when(has.isNotNull(), F.struct(F.round(y, 6).alias("y"), F.round(x, 6).alias("x")))
    r, c = F.col("r").cast("double"), F.col("c").cast("double")
    top, right, bottom, left = cut("a", "b"), cut("b", "d"), cut("g", "d"), cut("a", "g")
    sides = at.select("level", "r", "c", "a", "b", "d", "g", point(r, c + top, top).alias("t"), point(r + right, c + 1, right).alias("e"), point(r + 1, c + bottom, bottom).alias("o"), point(r + left, c, left).alias("l"))
    saddle = F.expr("t is not null AND e is not null AND o is not null AND l is not null")
    turned = F.expr("(a >= level) = ((a + b + d + g) / 4 >= level)")  # the middle goes with a: cut off the corners b and g
    pair = lambda p, q: F.struct(F.col(p).alias("p"), F.col(q).alias("q"))
    known = F.array_compact(F.array("t", "e", "o", "l"))
    segs = F.when(saddle & turned, F.array(pair("t", "e"), pair("o", "l"))).when(saddle, F.array(pair("t", "l"), pair("e", "o"))).otherwise(F.array(F.struct(F.get(known, F.lit(0)).alias("p"), F.get(known, F.lit(1)).alias("q"))))
    return sides.select("level", "r", "c", F.explode(segs).alias("s")).select("level", "r", "c", F.col("s.p.y").alias("y1"), F.col("s.p.x").alias("x1"), F.col("s.q.y").alias("y2"), F.col("s.q.x").alias("x2"))


def cluster_points(points: DataFrame, zoom: int, box: tuple[float, float, float, float]) -> DataFrame:
    """points: pid, lon, lat, weight. Screen clusters in a box (west, south, east, north): points of a cell of 60 of 256
    pixels become their centroid; a point alone stays. From zoom 14 on nothing is clustered."""
    west, south, east, north = box
    gx, gy = 360.0 / (1 << zoom) * 60 / 256, 180.0 / (1 << zoom) * 60 / 256
    inside = points.filter(F.col("lon").between(west, east) & F.col("lat").between(south, north))
    if zoom >= 14:
        return inside.select("lon", "lat", F.lit(1).cast("long").alias("n"), F.col("weight").alias("top"))
    cell = {"gx": F.floor((F.col("lon") - west) / gx), "gy": F.floor((F.col("lat") - south) / gy)}
    return inside.withColumns(cell).groupBy("gx", "gy").agg(F.round(F.avg("lon"), 6).alias("lon"), F.round(F.avg("lat"), 6).alias("lat"), F.count(F.lit(1)).alias("n"), F.max("weight").alias("top")).drop("gx", "gy")


#: Tables of at most so many rows (of a few numbers each) are sent whole to each executor; larger ones are joined by shuffle.
SENT = 200_000
_BLOCK_LEVEL = 6


def _sized(table: DataFrame, n: int) -> DataFrame:
    return F.broadcast(table) if n <= SENT else table


def _on_sphere(lat: str, lon: str) -> dict:
    return {"x": F.expr(f"cos(radians({lat})) * cos(radians({lon}))"), "y": F.expr(f"cos(radians({lat})) * sin(radians({lon}))"), "z": F.expr(f"sin(radians({lat}))")}


def _cube(level: int) -> Column:
    """Number of the cube of side 2 / 2**level that holds a place of the unit sphere: level bits for each axis."""
    i = [F.least(F.floor((F.col(v) + 1.0) * (1 << level) / 2).cast("long"), F.lit((1 << level) - 1).cast("long")) for v in "xyz"]
    return F.shiftleft(i[0], 2 * level).bitwiseOR(F.shiftleft(i[1], level)).bitwiseOR(i[2])


def _descend(asked: DataFrame, tree: DataFrame, sizes: dict[int, int], hops: list[tuple[int, int]]) -> DataFrame:
    """asked: q, x, y, z, reach, cubes (of the first hop's level) -> the same with those cubes of the last hop's that may hold
    the nearest place of some point within reach: none whose least distance is above the least of all greatest distances."""
    for level, to in hops:
        side, mask = 2.0 / (1 << to), (1 << to) - 1
        kids = tree.filter(F.col("level") == level).select(F.col("cube").alias("up"), "kids")
        met = asked.withColumn("up", F.explode("cubes")).join(_sized(kids, sizes[level]), "up").withColumn("cube", F.explode("kids"))
        near, far = F.lit(0.0), F.lit(0.0)
        for axis, shift in (("x", 2 * to), ("y", to), ("z", 0)):
            low = F.shiftright("cube", shift).bitwiseAND(F.lit(mask).cast("long")) * F.lit(side) - 1.0
            over, under = F.col(axis) - low, low + side - F.col(axis)
            near, far = near + F.pow(F.greatest(-over, -under, F.lit(0.0)), 2), far + F.pow(F.greatest(over, under), 2)
        met = met.select("q", "x", "y", "z", "reach", "cube", (F.sqrt(near) - F.col("reach")).alias("near"), (F.sqrt(far) + F.col("reach")).alias("far"))
        held = met.groupBy("q", "x", "y", "z", "reach").agg(F.min("far").alias("far"), F.collect_list(F.struct("near", "cube")).alias("c"))
        asked = held.select("q", "x", "y", "z", "reach", F.transform(F.filter("c", lambda c: c.near <= F.col("far") + 1e-9), lambda c: c.cube).alias("cubes"))
    return asked


def nearest(points: DataFrame, stations: DataFrame) -> DataFrame:
    """points: pid, lat, lon; stations: sid, slat, slon. One row a point: the nearest station in nautical miles, the
    smallest id of equally near ones; null for a point without a place, or without any station.

    Stations lie in a tree of cubes around the unit sphere, so poles and the date line are like any other place. Cubes of
    points (some 40,000 on the sphere at most) go down the tree first, points then go on from what their cube kept. A step
    keeps the cubes that may hold the nearest station, a few for each point; stations at one place count once."""
    here = stations.filter("slat is not null and slon is not null").groupBy("slat", "slon").agg(F.min("sid").alias("sid"))
    here = written(here.withColumns(_on_sphere("slat", "slon")), "stations")
    asked = written(points.withColumn("q", F.monotonically_increasing_id()), "nearest-points")
    n = here.count()
    if n == 0:
        return asked.select("pid", F.lit(None).cast(stations.schema["sid"].dataType).alias("sid"), F.lit(None).cast("double").alias("distance_nm"))
    depth = min(14, max(1, math.ceil(math.log2(n) / 2) + 1))
    middle = min(_BLOCK_LEVEL, depth)
    above, below = [(k, min(k + 2, middle)) for k in range(0, middle, 2)], [(k, k + 1) for k in range(middle, depth)]
    up = [F.struct(F.lit(k).alias("level"), _cube(k).alias("cube"), _cube(to).alias("kid")) for k, to in above + below]
    tree = written(here.select(F.explode(F.array(*up)).alias("s")).groupBy("s.level", "s.cube").agg(F.collect_set("s.kid").alias("kids")), "station-tree")
    sizes = {r["level"]: r["count"] for r in tree.groupBy("level").count().collect()}
    placed = asked.filter("lat is not null and lon is not null").select("q", "lat", "lon").withColumns(_on_sphere("lat", "lon")).withColumn("block", _cube(middle))
    root = F.array(F.lit(0).cast("long")).alias("cubes")
    side = 2.0 / (1 << middle)
    centre = [((F.shiftright("block", s).bitwiseAND(F.lit((1 << middle) - 1).cast("long")) + 0.5) * side - 1.0).alias(v) for v, s in (("x", 2 * middle), ("y", middle), ("z", 0))]
    blocks = placed.select("block").distinct().select(F.col("block").alias("q"), *centre, F.lit(side * math.sqrt(3) / 2).alias("reach"), root)
    kept = written(_descend(blocks, tree, sizes, above).select(F.col("q").alias("block"), "cubes"), "nearest-blocks")
    rows = kept.agg(F.sum(F.size("cubes"))).first()[0] or 0
    begun = placed.join(_sized(kept, rows), "block").select("q", "x", "y", "z", F.lit(0.0).alias("reach"), "cubes")
    ended = _descend(begun, tree, sizes, below).select("q", F.explode("cubes").alias("cube"))
    if depth > middle:
        ended = written(ended, "nearest-cubes")
    leaves = here.select(_cube(depth).alias("cube"), "sid", "slat", "slon")
    dist = F.expr(geo.haversine("lat", "lon", "slat", "slon", geo.EARTH_NM))
    met = ended.join(placed.select("q", "lat", "lon"), "q").join(_sized(leaves, n), "cube")
    found = met.groupBy("q").agg(F.min(F.struct(dist.alias("d"), "sid")).alias("best"))
    return asked.join(found, "q", "left").select("pid", "best.sid", F.round("best.d", 1).alias("distance_nm"))


def densified_path(points: DataFrame, step_m: float = 90.0) -> DataFrame:
    """points: line, i, lat, lon. Points along each leg at step_m at most, with the distance from the start."""
    order = Window.partitionBy("line").orderBy("i")
    legs = points.withColumns({"lat2": F.lead("lat").over(order), "lon2": F.lead("lon").over(order)})
    legs = legs.withColumn("leg", F.expr(geo.haversine("lat", "lon", "lat2", "lon2"))).withColumn("before", F.coalesce(F.sum("leg").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    at = legs.withColumn("n", F.when(F.col("leg").isNull(), 1).otherwise(F.greatest(F.ceil(F.col("leg") / step_m), F.lit(1)))).withColumn("k", F.explode(F.expr("sequence(0L, n - 1)")))
    f = F.col("k") / F.col("n")
    return at.select("line", "i", "k", F.round(F.col("lat") + F.coalesce(f * (F.col("lat2") - F.col("lat")), F.lit(0.0)), 7).alias("lat"), F.round(F.col("lon") + F.coalesce(f * (F.col("lon2") - F.col("lon")), F.lit(0.0)), 7).alias("lon"), F.round(F.col("before") + F.coalesce(f * F.col("leg"), F.lit(0.0)), 2).alias("distance_m"))


def path_profile(samples: DataFrame) -> DataFrame:
    """samples: line, distance_m, z. One row a line: length, gain, loss, extremes."""
    order = Window.partitionBy("line").orderBy("distance_m")
    d = F.col("z") - F.lag("z").over(order)
    return samples.withColumn("d", d).groupBy("line").agg(F.max("distance_m").alias("length_m"), F.round(F.sum(F.greatest("d", F.lit(0.0))), 2).alias("gain"), F.round(F.sum(F.greatest(-F.col("d"), F.lit(0.0))), 2).alias("loss"), F.min("z").alias("min_z"), F.max("z").alias("max_z"))


def polygon_measure(vertices: DataFrame) -> DataFrame:
    """vertices: zone, i, lat, lon (closed by the first). Spherical area in km² and perimeter in km."""
    order = Window.partitionBy("zone").orderBy("i")
    whole = Window.partitionBy("zone").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = {f"{x}2": F.coalesce(F.lead(x).over(order), F.first(x).over(whole)) for x in ("lat", "lon")}
    part = F.expr(f"radians(lon2 - lon) * (2 + sin(radians(lat)) + sin(radians(lat2))) * {geo.EARTH_M ** 2 / 2!r}")
    return vertices.withColumns(nxt).groupBy("zone").agg(F.round(F.abs(F.sum(part)) / 1e6, 3).alias("area_km2"), F.round(F.sum(F.expr(geo.haversine("lat", "lon", "lat2", "lon2"))) / 1e3, 3).alias("perimeter_km"))


def grid_to_geojson(cells: DataFrame, ref: tuple[float, float, float, float] = GEO, digits: int = 2) -> DataFrame:
    """One GeoJSON Point feature a cell with data, as text."""
    lat0, lon0, dy, dx = ref
    geometry = F.struct(F.lit("Point").alias("type"), F.array(F.round(lon0 + F.col("c") * dx, 6), F.round(lat0 - F.col("r") * dy, 6)).alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(F.round("z", digits).alias("value")).alias("properties"))
    return cells.filter("z is not null").select("r", "c", F.to_json(feature).alias("feature"))


def mesh(cells: DataFrame) -> DataFrame:
    """Two triangles for each square whose four cells have data: corner places and heights."""
    square = grid.with_neighbours(cells).filter("z + e + s + se is not null").select("r", "c", "z", "e", "s", "se")
    corner = lambda dr, dc, z: F.struct((F.col("r") + dr).alias("r"), (F.col("c") + dc).alias("c"), F.col(z).alias("z"))
    two = F.array(F.struct(F.lit(0).alias("half"), corner(0, 0, "z").alias("p"), corner(1, 0, "s").alias("q"), corner(0, 1, "e").alias("o")), F.struct(F.lit(1).alias("half"), corner(0, 1, "e").alias("p"), corner(1, 0, "s").alias("q"), corner(1, 1, "se").alias("o")))
    return square.select("r", "c", F.explode(two).alias("t")).select("r", "c", "t.half", F.col("t.p.z").alias("z1"), F.col("t.q.z").alias("z2"), F.col("t.o.z").alias("z3"))
