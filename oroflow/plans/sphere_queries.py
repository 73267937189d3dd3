"""Queries over fields, shapes and cells on the globe, and over what rasters lose, with their SQL oracles."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import accuracy, fields
from ..sources import shapes
from .feature_queries import _CORNER, PLACES, _corners, places
from .scratch import scratch_dir, written
from .terrain_queries import AROUND, HOLES, dem

#: Drifting paths, one a user: a home and steps of a few degrees around it, in the order of events.
_HOME = {"lon": "CAST(user_id * 37 % 300 - 150 AS DOUBLE) + (event_id * 7919 % 200) / 20e0", "lat": "CAST(user_id * 17 % 150 - 75 AS DOUBLE) + (event_id * 104729 % 160) / 20e0"}


def drifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").filter("user_id IS NOT NULL").selectExpr("user_id AS line", "event_id AS i", *[f"{x} AS {n}" for n, x in _HOME.items()])


FIELD = f"""d AS (SELECT user_id AS line, event_id AS i, {_HOME['lon']} AS lon, {_HOME['lat']} AS lat FROM events WHERE user_id IS NOT NULL),
l AS (SELECT *, lead(lon) OVER w - lon AS dx, lead(lat) OVER w - lat AS dy FROM d WINDOW w AS (PARTITION BY line ORDER BY i)),
u AS (SELECT lon, lat, dx, dy, sqrt(dx * dx + dy * dy) AS len FROM l WHERE abs(dx) <= 180),
a AS (SELECT *, dx / len AS ux, dy / len AS uy, CAST(ceil(len / 0.5) AS INT) AS steps FROM u WHERE len >= 0.01),
b AS (SELECT *, unnest(range(0, steps + 1)) AS s FROM a),
c AS (SELECT ux, uy, lon + CAST(s AS DOUBLE) / steps * dx AS cx, lat + CAST(s AS DOUBLE) / steps * dy AS cy FROM b),
e AS (SELECT ux, uy, CAST(floor(cx - uy * (p * 0.5e0) + 180) AS INT) AS gx, CAST(floor(90 - (cy + ux * (p * 0.5e0))) AS INT) AS gy, pow(1 - abs(p * 0.5e0) / 8, 1.5) AS w FROM c, range(-16, 17) t(p)),
f AS (SELECT gx, gy, sum(ux * w) AS sx, sum(uy * w) AS sy, sqrt(pow(sum(ux * w), 2) + pow(sum(uy * w), 2)) AS mag FROM e WHERE gx BETWEEN 0 AND 359 AND gy BETWEEN 0 AND 179 GROUP BY gx, gy),
field AS (SELECT gx, gy, CASE WHEN mag > 0.001 THEN sx / mag ELSE sx END AS dx, CASE WHEN mag > 0.001 THEN sy / mag ELSE sy END AS dy, mag FROM f)"""
#: A vector's direction is told where its magnitude is beyond the noise of sums.
_TOLD = "CASE WHEN mag > 0.01e0 THEN round({v}, 5) + 0e0 END AS {v}"
_BOX = (-70.0, -35.0, 85.0, 52.0)
_HEX_LEVEL, _HEX_EDGE = 0, 20_000.0
_SIDES, _REACH = 8, 0.01
_RASTER = 32


def _plots_in_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers' plots as a folder of shapefiles, those that meet a box read back."""
    corners = _corners(spark, sf_dir)
    ring = corners.groupBy("zone").agg(F.array_sort(F.collect_list(F.struct("i", F.col("lon").alias("x"), F.col("lat").alias("y")))).alias("v"))
    ring = ring.select(F.col("zone").alias("ID"), F.array(F.concat("v", F.slice("v", 1, 1))).alias("parts")).join(places(spark, sf_dir).select(F.col("pid").alias("ID"), F.col("segment").alias("SEGMENT")), "ID")
    folder = f"{scratch_dir(spark)}/shapes-{uuid.uuid4().hex}"
    shapes.write_shapes(ring, folder, "polygon")
    found = shapes.read_shapes(spark, folder, _BOX)
    return found.select(F.col("attributes")["ID"].cast("long").alias("zone"), F.col("attributes")["SEGMENT"].alias("segment"), F.size(F.flatten("parts")).alias("n_points"), *[F.round(c, 9).alias(c) for c in ("x_min", "y_min", "x_max", "y_max")])


PLOTS_IN_BOX = f"""WITH {PLACES}, v AS (SELECT zone, segment, {_CORNER[0]} AS y, {_CORNER[1]} AS x FROM (SELECT pid AS zone, segment, lat, lon, unnest(range(0, 5)) AS i FROM places)),
b AS (SELECT zone, segment, CAST(count(*) + 1 AS INT) AS n_points, min(x) AS x_min, min(y) AS y_min, max(x) AS x_max, max(y) AS y_max FROM v GROUP BY zone, segment)
SELECT zone, segment, n_points, round(x_min, 9) AS x_min, round(y_min, 9) AS y_min, round(x_max, 9) AS x_max, round(y_max, 9) AS y_max FROM b WHERE x_min <= {_BOX[2]} AND x_max >= {_BOX[0]} AND y_min <= {_BOX[3]} AND y_max >= {_BOX[1]}"""


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Web-Mercator tiles of zoom 6 that hold a place, by their edges."""
    xy = places(spark, sf_dir).select(F.expr(geo.tile_x("lon", 6)).alias("x"), F.expr(geo.tile_y("lat", 6)).alias("y")).distinct()
    edges = {"south": geo.tile_lat("(y + 1)", 6), "west": geo.tile_lon("x", 6), "north": geo.tile_lat("y", 6), "east": geo.tile_lon("(x + 1)", 6)}
    return xy.select("x", "y", *[F.expr(f"CAST({e} AS DOUBLE)").alias(k) for k, e in edges.items()])


def _hexagons(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = places(spark, sf_dir).withColumn("cell", F.expr(geo.cell_id("lat", "lon", _HEX_LEVEL)))
    held = p.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
    corners = held.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(6))))
    return corners.select("cell", "n", "k", *[F.round(F.expr(x), 6).alias(c) for c, x in geo.hexagon_corner("lat", "lon", "k", _HEX_EDGE).items()])


def _terminators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The border of day and night on each day that has events, by 10 degrees."""
    days = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("CAST(dayofyear(ts) AS INT) AS day").distinct()
    at = days.withColumn("dec", F.expr(geo.solar_declination("day"))).withColumn("lon", F.explode(F.sequence(F.lit(-180), F.lit(180), F.lit(10))))
    return at.select("day", "lon", F.round(F.expr(geo.terminator_lat("dec", "lon")), 5).alias("lat"))


def _directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = places(spark, sf_dir).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(_SIDES - 1))))
    return at.select("pid", "k", *[F.round(F.expr(x), 6).alias(c) for c, x in geo.sphere_offsets("lat", f"(k * {360.0 / _SIDES!r}e0)", _REACH).items()])


def _properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = places(spark, sf_dir)
    return accuracy.property_summary(p.select(F.create_map(F.lit("segment"), "segment", F.lit("lat"), F.col("lat").cast("string"), F.lit("rank"), F.when(F.col("pid") % 3 == 0, F.concat(F.lit("no "), "segment")).otherwise((F.col("pid") % 50).cast("string"))).alias("properties")))


def _drowned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terrain with every third tile lowered or made flat, so that all classes occur."""
    tile = f"(r DIV {_RASTER} + c DIV {_RASTER}) % 6"
    return dem(spark, sf_dir, True).withColumn("z", F.expr(_FLATTENED.format(t=tile)))


_FLATTENED = "CASE {t} WHEN 0 THEN z - 5000 WHEN 1 THEN round(z / 100) WHEN 2 THEN round(z / 25) WHEN 3 THEN z * 2 WHEN 4 THEN z * 4 ELSE NULL END"


def build() -> dict[str, tuple]:
    q: dict[str, tuple] = {}
    told = ", ".join(_TOLD.format(v=v) for v in ("dx", "dy"))
    q["flow_field"] = (lambda s, d: fields.flow_field(drifts(s, d)).selectExpr("gx", "gy", *[_TOLD.format(v=v) for v in ("dx", "dy")], "round(mag, 5) AS mag"), f"WITH {FIELD} SELECT gx, gy, {told}, round(mag, 5) AS mag FROM field")
    q["flow_at_points"] = (
        lambda s, d: fields.flow_at(places(s, d), written(fields.flow_field(drifts(s, d)), "flow-field")).selectExpr("pid", *[_TOLD.format(v=v) for v in ("dx", "dy")], "round(mag, 5) AS mag"),
        f"WITH {PLACES}, {FIELD}, k AS (SELECT pid, coalesce(dx, 0) AS dx, coalesce(dy, 0) AS dy, coalesce(mag, 0) AS mag FROM places LEFT JOIN field ON gx = CAST(floor(lon + 180.5) AS INT) AND gy = CAST(floor(90.5 - lat) AS INT)) SELECT pid, {told}, round(mag, 5) AS mag FROM k",
    )
    q["shapefile_box"] = (_plots_in_box, PLOTS_IN_BOX)
    q["overlapping_degree_tiles"] = (
        lambda s, d: accuracy.overlapping_degree_tiles(_boxes(s, d)).select("x", "y", "name"),
        f"""WITH {PLACES}, t AS (SELECT DISTINCT CAST(floor((lon + 180) / 360 * 64) AS INT) AS x, CAST(floor((1 - asinh(tan(radians(lat))) / pi()) / 2 * 64) AS INT) AS y FROM places),
e AS (SELECT x, y, x / 64 * 360 - 180 AS west, (x + 1) / 64 * 360 - 180 AS east, degrees(atan(sinh(pi() * (1 - 2 * y / 64)))) AS north, degrees(atan(sinh(pi() * (1 - 2 * (y + 1) / 64)))) AS south FROM t),
n AS (SELECT x, y, la, lo FROM e, range(-90, 90) a(la), range(-180, 180) b(lo) WHERE la + 1 > south + 0.001 AND la <= north - 0.001 AND lo + 1 > west + 0.001 AND lo <= east - 0.001)
SELECT x, y, CASE WHEN la < 0 THEN 'S' ELSE 'N' END || lpad(CAST(abs(la) AS VARCHAR), 2, '0') || CASE WHEN lo < 0 THEN 'W' ELSE 'E' END || lpad(CAST(abs(lo) AS VARCHAR), 3, '0') AS name FROM n""",
    )
    compat = geo.degree_bounds("name", compat=True)
    q["degree_tile_bounds"] = (
        lambda s, d: places(s, d).select("pid", F.expr(geo.degree_tile("lat", "lon")).alias("name")).select("pid", "name", *[F.expr(x).alias(k) for k, x in geo.degree_bounds("name").items()], *[F.expr(compat[k]).alias(f"compat_{k}") for k in ("south", "west")]),
        f"WITH {PLACES}, k AS (SELECT pid, {geo.degree_tile('lat', 'lon')} AS name, CAST(floor(lat) AS INT) AS south, CAST(floor(lon) AS INT) AS west FROM places) SELECT pid, name, south, west, south + 1 AS north, west + 1 AS east, CASE WHEN south < 0 THEN south - 1 ELSE south END AS compat_south, CASE WHEN west < 0 THEN west - 1 ELSE west END AS compat_west FROM k",
    )
    q["hexagon_cells"] = (
        _hexagons,
        f"""WITH {PLACES}, h AS (SELECT 'cell-0-' || CAST(CAST(floor(lat + 0.5) AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(floor(lon + 0.5) AS BIGINT) AS VARCHAR) AS cell, count(*) AS n, avg(lat) AS lat, avg(lon) AS lon FROM places GROUP BY 1)
SELECT cell, n, CAST(k AS INT) AS k, round(lat + degrees(20000 / 6371000.0) * cos(radians(60 * (k % 6) - 30)), 6) AS corner_lat, round(lon + degrees(20000 / 6371000.0) / cos(radians(lat)) * sin(radians(60 * (k % 6) - 30)), 6) AS corner_lon FROM h, range(0, 7) t(k)""",
    )
    q["terminator"] = (
        _terminators,
        "WITH k AS (SELECT DISTINCT CAST(dayofyear(ts) AS INT) AS day FROM events), s AS (SELECT day, radians(-23.45 * cos(radians(360.0 / 365 * (day + 10)))) AS dec FROM k) SELECT day, CAST(lon AS INT) AS lon, round(degrees(atan2(-cos(radians(lon)) * sign(dec), tan(abs(dec)))), 5) AS lat FROM s, range(-180, 181, 10) t(lon)",
    )
    q["sphere_directions"] = (
        _directions,
        f"""WITH {PLACES}, t AS (SELECT pid, k, radians(lat) AS p, lat, radians(45 * k) AS a FROM places, range(0, 8) t(k)), u AS (SELECT *, asin(sin(p) * cos(0.01) + cos(p) * sin(0.01) * cos(a)) AS p2 FROM t)
SELECT pid, CAST(k AS INT) AS k, round(degrees(p2) - lat, 6) AS d_lat, round(degrees(atan2(sin(a) * sin(0.01) * cos(p), cos(0.01) - sin(p) * sin(p2))), 6) AS d_lon FROM u""",
    )
    q["view_zones"] = (
        lambda s, d: s.read.parquet(f"{d}/orders.parquet").selectExpr("o_orderkey", f"{geo.view_zone('(CAST(o_totalprice AS DOUBLE) * (o_orderkey % 400) - 10)')} AS zone"),
        "SELECT o_orderkey, CASE WHEN m >= 0 AND m < 500000 THEN 'earth' WHEN m >= 500000 AND m < 5000000 THEN 'low-orbit' WHEN m >= 5000000 AND m < 50000000 THEN 'high-orbit' ELSE 'deep-space' END AS zone FROM (SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) * (o_orderkey % 400) - 10 AS m FROM orders)",
    )
    q["property_summary"] = (
        _properties,
        f"""WITH {PLACES}, k AS (SELECT 'segment' AS name, segment AS value FROM places UNION ALL SELECT 'lat', CAST(lat AS VARCHAR) FROM places UNION ALL SELECT 'rank', CASE WHEN pid % 3 = 0 THEN 'no ' || segment ELSE CAST(pid % 50 AS VARCHAR) END FROM places)
SELECT name, count(*) AS n_features, count(TRY_CAST(value AS DOUBLE)) AS n_numbers, min(TRY_CAST(value AS DOUBLE)) AS least, max(TRY_CAST(value AS DOUBLE)) AS greatest, count(DISTINCT value) AS n_values FROM k GROUP BY name""",
    )
    q["terrain_classes"] = (
        lambda s, d: accuracy.terrain_classes(_drowned(s, d), _RASTER),
        f"""WITH {HOLES}, k AS (SELECT CAST(r // {_RASTER} AS INT) AS tr, CAST(c // {_RASTER} AS INT) AS tc, {_FLATTENED.format(t=f'(r // {_RASTER} + c // {_RASTER}) % 6')} AS z FROM dem), s AS (SELECT tr, tc, count(z) AS n, max(z) AS hi, max(z) - min(z) AS span, stddev_pop(z) AS sd FROM k GROUP BY tr, tc)
SELECT tr, tc, CASE WHEN n = 0 THEN 'nodata' WHEN hi < 0 THEN 'ocean' WHEN span < 50 AND sd < 15 THEN 'flat_lowland' WHEN span < 200 AND sd < 50 THEN 'lowland' WHEN span < 1000 THEN 'hills' WHEN span < 3000 THEN 'mountain' ELSE 'high_mountain' END AS class FROM s""",
    )
    steep = "degrees(atan(sqrt(pow(coalesce((s - n) / 2, s - z, z - n, 0) / 30, 2) + pow(coalesce((e - w) / 2, e - z, z - w, 0) / 30, 2))))"
    around = AROUND.replace("v AS", "v2 AS").replace("h AS", "h2 AS").replace("FROM dem)", "FROM coarse)").replace("FROM v ", "FROM v2 ")
    q["slope_deviation"] = (
        lambda s, d: accuracy.slope_deviation(dem(s, d, True), dem(s, d, True).withColumn("z", F.rint(F.col("z") / 8) * 8), _RASTER).select("tr", "tc", "n", *[F.round(c, 6).alias(c) for c in ("rmse", "mean", "greatest", "p95")]),
        f"""WITH {HOLES}, coarse AS (SELECT r, c, round_even(z / 8, 0) * 8 AS z FROM dem), {AROUND}, {around},
a AS (SELECT r, c, {steep} AS slope FROM h WHERE z IS NOT NULL), b AS (SELECT r, c, {steep} AS slope2 FROM h2 WHERE z IS NOT NULL), d AS (SELECT CAST(r // {_RASTER} AS INT) AS tr, CAST(c // {_RASTER} AS INT) AS tc, abs(slope - slope2) AS d FROM a JOIN b USING (r, c))
SELECT tr, tc, count(*) AS n, round(sqrt(avg(d * d)), 6) AS rmse, round(avg(d), 6) AS mean, round(max(d), 6) AS greatest, round(quantile_cont(d, 0.95), 6) AS p95 FROM d GROUP BY tr, tc""",
    )
    return q
