"""Queries over the tile store, with their SQL oracles: the terrain as a degree grid of hundredths, from 10 N 20 E."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..sources import chunk_store, pyramid
from .scratch import scratch_dir, written
from .terrain_queries import HOLES, dem

REF = (10.0, 20.0, 0.01, 0.01)
SIDE, FINEST, COARSEST = 32, 10, 7

#: Pixels (zoom, gy, gx, z) of all levels, by the pixel's own row and column of the whole level.
_FIRST = f"""ext AS (SELECT max(r) AS rm, max(c) AS cm FROM dem),
ty AS (SELECT unnest(range(CAST({geo.tile_y('10.1e0', FINEST)} AS BIGINT), CAST({geo.tile_y('(9.9e0 - rm * 0.01e0)', FINEST)} AS BIGINT) + 1)) AS y FROM ext),
tx AS (SELECT unnest(range(CAST({geo.tile_x('19.9e0', FINEST)} AS BIGINT), CAST({geo.tile_x('(20.1e0 + cm * 0.01e0)', FINEST)} AS BIGINT) + 1)) AS x FROM ext),
prow AS (SELECT y, py, CAST(round_even((10e0 - {pyramid.pixel_lat(FINEST, SIDE)}) / 0.01e0, 0) AS INT) AS r FROM ty, range(0, {SIDE}) t(py)),
pcol AS (SELECT x, px, CAST(round_even(({pyramid.pixel_lon(FINEST, SIDE)} - 20e0) / 0.01e0, 0) AS INT) AS c FROM tx, range(0, {SIDE}) t(px)),
p{FINEST} AS (SELECT y * {SIDE} + py AS gy, x * {SIDE} + px AS gx, z FROM prow JOIN dem USING (r) JOIN pcol USING (c) WHERE z IS NOT NULL)"""
PIXELS = f"{HOLES}, {_FIRST}, " + ", ".join(f"p{k} AS (SELECT gy // 2 AS gy, gx // 2 AS gx, round_even(avg(z), 0) AS z FROM p{k + 1} GROUP BY 1, 2)" for k in range(FINEST - 1, COARSEST - 1, -1)) + ", pix AS (" + " UNION ALL ".join(f"SELECT {k} AS zoom, gy, gx, z FROM p{k}" for k in range(COARSEST, FINEST + 1)) + ")"
#: Every fifth tile of the finest level is not in the store.
_GONE = f"zoom = {FINEST} AND (x * 7 + y) % 5 = 0"
STORED = PIXELS + f", stored AS (SELECT * FROM (SELECT *, gx // {SIDE} AS x, gy // {SIDE} AS y FROM pix) WHERE NOT ({_GONE}))"


def store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pyramid.build(pyramid.resample(dem(spark, sf_dir, True), REF, FINEST, SIDE), COARSEST, FINEST, SIDE)


def sights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point for each event, some beyond the terrain."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.selectExpr("event_id AS pid", "10.02e0 - (event_id * 7919 % 50500) / 10000e0 AS lat", "19.98e0 + (event_id * 104729 % 6800) / 10000e0 AS lon")


SIGHTS = "sights AS (SELECT event_id AS pid, 10.02e0 - (event_id * 7919 % 50500) / 10000e0 AS lat, 19.98e0 + (event_id * 104729 % 6800) / 10000e0 AS lon FROM events)"


def _looked_up() -> str:
    parts = []
    for k in range(FINEST, COARSEST - 1, -1):
        rest = "sights" if k == FINEST else f"(SELECT sights.* FROM sights JOIN got{k + 1} g USING (pid) WHERE g.z IS NULL)"
        north, south = geo.tile_lat("y", k), geo.tile_lat("(y + 1)", k)
        parts.append(f"""t{k} AS (SELECT *, CAST({geo.tile_x('lon', k)} AS BIGINT) AS x, CAST({geo.tile_y('lat', k)} AS BIGINT) AS y FROM {rest}),
f{k} AS (SELECT *, ({north} - lat) / ({north} - {south}) * {SIDE - 1} AS fy, ((lon - {geo.tile_lon('x', k)}) * {float(1 << k)!r}e0 / 360e0) * {SIDE - 1} AS fx FROM t{k}),
g{k} AS (SELECT *, fy - floor(fy) AS wy, fx - floor(fx) AS wx, y * {SIDE} + CAST(floor(fy) AS BIGINT) AS y0, x * {SIDE} + CAST(floor(fx) AS BIGINT) AS x0, y * {SIDE} + least(CAST(floor(fy) AS BIGINT) + 1, {SIDE - 1}) AS y1, x * {SIDE} + least(CAST(floor(fx) AS BIGINT) + 1, {SIDE - 1}) AS x1 FROM f{k}),
got{k} AS (SELECT pid, {k} AS zoom, CASE WHEN a.z + b.z + c.z + d.z IS NULL THEN coalesce(a.z, b.z, c.z, d.z) ELSE round(a.z * (1 - wy) * (1 - wx) + b.z * (1 - wy) * wx + c.z * wy * (1 - wx) + d.z * wy * wx, 1) END AS z FROM g{k}
  LEFT JOIN stored a ON a.zoom = {k} AND a.gy = y0 AND a.gx = x0 LEFT JOIN stored b ON b.zoom = {k} AND b.gy = y0 AND b.gx = x1
  LEFT JOIN stored c ON c.zoom = {k} AND c.gy = y1 AND c.gx = x0 LEFT JOIN stored d ON d.zoom = {k} AND d.gy = y1 AND d.gx = x1)""")
    every = " UNION ALL ".join(f"SELECT pid, z, zoom FROM got{k} WHERE z IS NOT NULL" for k in range(COARSEST, FINEST + 1))
    return f"WITH {STORED}, {SIGHTS}, {', '.join(parts)} {every} UNION ALL SELECT pid, NULL, NULL FROM got{COARSEST} WHERE z IS NULL"


def _chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The high ground as one source, all of it as the other."""
    z = dem(spark, sf_dir, True)
    first = pyramid.resample(z.filter("z > 690"), REF, FINEST, SIDE)
    return pyramid.choose(first, pyramid.resample(z, REF, FINEST, SIDE), SIDE).select("zoom", "x", "y", "n_valid", "source")


def _steep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dem(spark, sf_dir, True).select("r", "c", F.rint(F.col("z") * F.col("z") / 100).alias("z"))


STEEP = f"{HOLES}, steep AS (SELECT r, c, round_even(z * z / 100, 0) AS z FROM dem WHERE z IS NOT NULL)"


_PIXELS, _CHUNK = 100, 16


def chunk_folder(spark: SparkSession, sf_dir: str) -> str:
    """The terrain as chunk files by degree; pixels on a tile's edge are in both tiles. Of tiles that share a name (S10 is
    100 to 109 degrees south, too) the one nearest to the equator comes first."""
    folder = f"{scratch_dir(spark)}/chunk-store-{uuid.uuid4().hex}"
    z = dem(spark, sf_dir, True).filter("z is not null")
    south = F.array(F.struct((F.lit(10) - F.ceil(F.col("r") / 100)).alias("d"), (F.col("r") - (F.ceil(F.col("r") / 100) - 1) * 100).alias("p")), F.when(F.col("r") % 100 == 0, F.struct((F.lit(9) - F.ceil(F.col("r") / 100)).alias("d"), F.lit(0).cast("long").alias("p"))))
    west = F.array(F.struct((F.lit(20) + F.floor(F.col("c") / 100)).alias("d"), (F.col("c") % 100).cast("long").alias("p")), F.when(F.col("c") % 100 == 0, F.struct((F.lit(19) + F.floor(F.col("c") / 100)).alias("d"), F.lit(100).cast("long").alias("p"))))
    at = z.select("z", F.explode(F.array_compact(south)).alias("y"), F.array_compact(west).alias("xs")).select("z", "y", F.explode("xs").alias("x"))
    named = at.select(F.expr(geo.degree_tile("y.d", "x.d")).alias("name"), F.col("y.p").cast("int").alias("py"), F.col("x.p").cast("int").alias("px"), "z", F.abs("y.d").alias("rank"))
    chunk_store.write_store(named, folder, _CHUNK).count()
    return folder


def _chunk_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_store.read_points(sights(spark, sf_dir), chunk_folder(spark, sf_dir), _CHUNK, _PIXELS).select("pid", "z")


_PX = "CAST(least(100, greatest(0, round_even({v}, 0))) AS INT)"
CHUNK_POINTS = f"""WITH {HOLES}, {SIGHTS}, p AS (SELECT pid, CAST(floor(lat) AS INT) AS la, CAST(floor(lon) AS INT) AS lo, {_PX.format(v='(1e0 - (lat - floor(lat))) * 100')} AS py, {_PX.format(v='(lon - floor(lon)) * 100')} AS px FROM sights)
SELECT pid, z FROM p LEFT JOIN dem ON r = py + (9 - la) * 100 AND c = px + (lo - 20) * 100"""
CHUNK_AUDIT = f"""WITH {HOLES}, y AS (SELECT r, 10 - CAST(ceil(r / 100) AS INT) AS la FROM (SELECT DISTINCT r FROM dem) UNION ALL SELECT r, 9 - r // 100 FROM (SELECT DISTINCT r FROM dem) WHERE r % 100 = 0),
x AS (SELECT c, 20 + c // 100 AS lo FROM (SELECT DISTINCT c FROM dem) UNION ALL SELECT c, 19 + c // 100 FROM (SELECT DISTINCT c FROM dem) WHERE c % 100 = 0),
k AS (SELECT {geo.degree_tile('la', 'lo')} AS name, r - (9 - la) * 100 AS py, c - (lo - 20) * 100 AS px FROM dem JOIN y USING (r) JOIN x USING (c) WHERE z IS NOT NULL)
SELECT name, CAST(max(py // 16) + 1 AS INT) AS rows, CAST(max(px // 16) + 1 AS INT) AS cols, count(DISTINCT (py // 16) * 1000 + px // 16) AS n_chunks, (max(py // 16) + 1) * (max(px // 16) + 1) - count(DISTINCT (py // 16) * 1000 + px // 16) AS n_empty, CAST(0 AS BIGINT) AS n_bad, count(*) AS n_valid FROM k GROUP BY name"""


_RADIUS = 20


def centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").selectExpr("s_suppkey AS pid", "10.013e0 - (s_suppkey * 7919 % 50500) / 10000e0 AS lat", "19.987e0 + (s_suppkey * 104729 % 6800) / 10000e0 AS lon")


def _mosaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squares around the suppliers' places, from the high ground where it has data and from all of it elsewhere."""
    z = dem(spark, sf_dir, True)
    levels = [written(pyramid.resample(part, REF, FINEST, SIDE), "mosaic-store") for part in (z.filter("z > 690"), z)]
    return pyramid.mosaic(centres(spark, sf_dir), _RADIUS, FINEST, *levels, side=SIDE)


_DOWN = f"(1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * {1 << FINEST}"
MOSAIC = f"""WITH {HOLES}, {_FIRST}, s AS (SELECT s_suppkey AS pid, 10.013e0 - (s_suppkey * 7919 % 50500) / 10000e0 AS lat, 19.987e0 + (s_suppkey * 104729 % 6800) / 10000e0 AS lon FROM supplier),
w AS (SELECT pid, CAST(floor((lon + 180) / 360 * {1 << FINEST} * {SIDE}) AS BIGINT) - {_RADIUS} AS px, CAST(floor({_DOWN} * {SIDE}) AS BIGINT) - {_RADIUS} AS py FROM s)
SELECT pid, CAST(gy - py AS INT) AS row, CAST(gx - px AS INT) AS col, z, CASE WHEN z > 690 THEN 0 ELSE 1 END AS source FROM w JOIN p{FINEST} ON gy BETWEEN py AND py + {2 * _RADIUS} AND gx BETWEEN px AND px + {2 * _RADIUS}"""


def build() -> dict[str, tuple]:
    q: dict[str, tuple] = {}
    q["elevation_mosaic"] = (_mosaic, MOSAIC)
    q["chunk_points"] = (_chunk_points, CHUNK_POINTS)
    q["chunk_audit"] = (lambda s, d: chunk_store.audit(s, chunk_folder(s, d), _CHUNK).drop("error"), CHUNK_AUDIT)
    per_tile = f"SELECT CAST(zoom AS INT) AS zoom, CAST(gx // {SIDE} AS INT) AS x, CAST(gy // {SIDE} AS INT) AS y, count(*) AS n_valid, sum(z) AS z_sum, min(z) AS z_min, max(z) AS z_max FROM pix GROUP BY ALL"
    q["tile_pyramid"] = (lambda s, d: pyramid.statistics(store(s, d)), f"WITH {PIXELS} {per_tile}")
    q["tile_pyramid_manifest"] = (lambda s, d: pyramid.manifest(store(s, d)).drop("n_bytes"), f"WITH {PIXELS}, tiles AS ({per_tile}) SELECT zoom, count(*) AS n_tiles, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, CAST(sum(n_valid) AS BIGINT) AS n_valid FROM tiles GROUP BY zoom")
    q["tile_elevation"] = (lambda s, d: pyramid.elevation_at(sights(s, d), store(s, d).filter(f"NOT ({_GONE})"), tuple(range(FINEST, COARSEST - 1, -1))), _looked_up())
    q["tile_source_choice"] = (_chosen, f"WITH {HOLES}, {_FIRST}, b AS (SELECT gx // {SIDE} AS x, gy // {SIDE} AS y, count(*) AS n2, count(*) FILTER (z > 690) AS n1 FROM p{FINEST} GROUP BY ALL) SELECT {FINEST} AS zoom, CAST(x AS INT) AS x, CAST(y AS INT) AS y, CASE WHEN n1 >= 0.05 * {SIDE * SIDE} THEN n1 ELSE n2 END AS n_valid, CASE WHEN n1 >= 0.05 * {SIDE * SIDE} THEN 'first' ELSE 'second' END AS source FROM b")
    q["tile_least_bits"] = (
        lambda s, d: pyramid.least_bits(_steep(s, d), 1.0, 32).select("tr", "tc", "bits", F.round("rmse", 6).alias("rmse")),
        f"WITH {STEEP}, e AS (SELECT r // 32 AS tr, c // 32 AS tc, min(z) AS lo, max(z) - min(z) AS span FROM steep GROUP BY ALL), s AS (SELECT tr, tc, lo, b, CASE WHEN span > 0 THEN least(1.0, ((1 << b) - 2)::DOUBLE / span) ELSE 1.0 END AS k FROM e, range(8, 17) t(b)), m AS (SELECT tr, tc, b, sqrt(avg(pow(round_even(round_even((z - lo) * k, 0) / k, 0) + lo - z, 2))) AS rmse FROM s JOIN steep ON r // 32 = tr AND c // 32 = tc GROUP BY ALL) SELECT CAST(tr AS INT) AS tr, CAST(tc AS INT) AS tc, CAST(min(b) AS INT) AS bits, round(arg_min(rmse, b), 6) AS rmse FROM m WHERE rmse <= 1.0 GROUP BY tr, tc",
    )
    return q
