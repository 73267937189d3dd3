"""Queries over points, lines, polygons, feeds, tiles and streams, with their SQL oracles."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import feeds, vector
from ..sources import tiles
from ..streaming import live
from .scratch import scratch_dir
from .terrain_queries import DEM, EDGES, HOLES, dem, zone_edges


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points made of the customers' keys."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return c.selectExpr("c_custkey AS pid", "CAST((c_custkey * 37) % 360 - 180 AS DOUBLE) + 0.25e0 AS lon", "CAST((c_custkey * 17) % 170 - 85 AS DOUBLE) + 0.125e0 AS lat", "c_acctbal AS weight", "c_mktsegment AS segment")


PLACES = "places AS (SELECT c_custkey AS pid, CAST((c_custkey * 37) % 360 - 180 AS DOUBLE) + 0.25e0 AS lon, CAST((c_custkey * 17) % 170 - 85 AS DOUBLE) + 0.125e0 AS lat, c_acctbal AS weight, c_mktsegment AS segment FROM customer)"


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").selectExpr("s_suppkey AS sid", "CAST((s_suppkey * 41) % 170 - 85 AS DOUBLE) AS slat", "CAST((s_suppkey * 73) % 360 - 180 AS DOUBLE) AS slon")


STATIONS = "stations AS (SELECT s_suppkey AS sid, CAST((s_suppkey * 41) % 170 - 85 AS DOUBLE) AS slat, CAST((s_suppkey * 73) % 360 - 180 AS DOUBLE) AS slon FROM supplier)"


def fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.selectExpr("user_id AS key", "event_id AS id", "ts", "CAST((event_id * 7919) % 3600 AS DOUBLE) / 20e0 - 90e0 AS lat", "CAST((event_id * 104729) % 7200 AS DOUBLE) / 20e0 - 180e0 AS lon", "value")


FIXES = "fixes AS (SELECT user_id AS key, event_id AS id, ts, CAST((event_id * 7919) % 3600 AS DOUBLE) / 20e0 - 90e0 AS lat, CAST((event_id * 104729) % 7200 AS DOUBLE) / 20e0 - 180e0 AS lon, value FROM events)"

_SCALARS = {
    "tile_x": geo.tile_x("lon", 8), "tile_y": geo.tile_y("lat", 8), "degree_tile": geo.degree_tile("lat", "lon"), "quad": geo.quadrant("lat", "lon"),
    "north_edge": f"round({geo.tile_lat(geo.tile_y('lat', 8), 8)}, 6)", "west_edge": f"round(CAST({geo.tile_lon(geo.tile_x('lon', 8), 8)} AS DOUBLE), 6)",
    "zone": geo.utm_zone("lon"), "dms": geo.dms("lat", "N", "S"), "wrapped": f"round({geo.wrap_lon('lon + 400e0')}, 6)",
    "to_origin_km": f"round({geo.haversine('lat', 'lon', '0e0', '0e0')} / 1000, 3)", "to_pole": f"round({geo.bearing('lat', 'lon', '80e0', '10e0')}, 4)",
    "compass": geo.compass("(lon + 180)"), "feet": f"round(CAST({geo.units('weight', 'ft')} AS DOUBLE), 4)", "declination": f"round(CAST({geo.solar_declination('(pid % 365)')} AS DOUBLE), 6)",
}
_LADDERS = {"storm": geo.storm_class("value"), "air": geo.air_class("value * 3"), "quake": geo.quake_class("value / 15"), "depth": geo.quake_depth_class("value"), "orbit": geo.orbit_class("value * 500")}


_SEGMENT = "c_custkey AS line, CAST(c_custkey * 7 % 3000 AS INT) AS r1, CAST(c_custkey % 11 AS INT) AS c1, CAST(c_custkey * 7 % 3000 + c_custkey % 83 - 40 AS INT) AS r2, CAST(40 + c_custkey % 23 AS INT) AS c2"


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line for each customer."""
    return spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr(*_SEGMENT.split(", "))


def _chain(spark: SparkSession, sf_dir: str) -> dict:
    z = dem(spark, sf_dir, True)
    key = F.concat_ws("/", "r", "c")
    points = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("pid"), F.concat_ws("/", F.col("event_id") % 520, F.col("event_id") % 70).alias("key"))
    land = z.filter("z > 550").select(key.alias("key"), "z")
    sea = z.filter("z is not null").select(key.alias("key"), (-F.col("z")).alias("z"))
    return feeds.with_fallback(points, ("land", land), ("ocean", sea))


def _page(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = places(spark, sf_dir).withColumnRenamed("pid", "fid")
    return feeds.feature_query(p, (-100, -40, 100, 60), "segment = 'BUILDING' AND weight > 1000", 20, 10).select("fid", "lon", "lat", "weight", "number_matched")


def _sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    pts = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id AS pid", "event_id % 2000 * 0.2475e0 AS y", "event_id % 63 + 0.3713e0 AS x")
    return vector.bilinear(pts, dem(spark, sf_dir))


def _rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = tiles.decode_tiles(tiles.encode_tiles(dem(spark, sf_dir, True)))
    return back.filter("error is null").select("r", "c", "z")


def _quantised_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = dem(spark, sf_dir, True)
    back = tiles.decode_tiles(tiles.encode_tiles(z, bits=8)).select("r", "c", F.col("z").alias("got"))
    return feeds.error_stats(z.join(back, ["r", "c"]).select(F.col("z").alias("expected"), "got"))


def _grid_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = places(spark, sf_dir)
    for step in geo.utm_steps("lat", "lon"):
        p = p.withColumns({k: F.expr(x) for k, x in step.items()})
    return p.select("pid", "zone", F.round("easting", 3).alias("easting"), F.round("northing", 3).alias("northing"), F.expr(geo.mgrs("lat")).alias("mgrs"))


def _grid_sql() -> str:
    """The same projection by Snyder's powers of the longitude difference, for the zone; the reference from its metres."""
    return f"""WITH {PLACES}, u AS (SELECT *, CASE WHEN lat BETWEEN -80 AND 84 THEN CAST(floor((lon + 180) / 6) AS INT) + 1 END AS zone FROM places),
k AS (SELECT *, 0.00669437999014131699614 AS e2, 0.00673949674227643495478 AS ep2, radians(lat) AS p, radians(lon - (zone * 6 - 183)) * cos(radians(lat)) AS a FROM u),
m AS (SELECT *, 6378137 / sqrt(1 - e2 * pow(sin(p), 2)) AS nu, pow(tan(p), 2) AS t, ep2 * pow(cos(p), 2) AS c, 6378137 * ((1 - e2 / 4 - 3 * pow(e2, 2) / 64 - 5 * pow(e2, 3) / 256) * p - (3 * e2 / 8 + 3 * pow(e2, 2) / 32 + 45 * pow(e2, 3) / 1024) * sin(2 * p) + (15 * pow(e2, 2) / 256 + 45 * pow(e2, 3) / 1024) * sin(4 * p) - 35 * pow(e2, 3) / 3072 * sin(6 * p)) AS m FROM k),
g AS (SELECT pid, lat, zone, 500000 + 0.9996 * nu * (a + (1 - t + c) * pow(a, 3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep2) * pow(a, 5) / 120) AS easting,
  CASE WHEN lat < 0 THEN 10000000 ELSE 0 END + 0.9996 * (m + nu * tan(p) * (a * a / 2 + (5 - t + 9 * c + 4 * c * c) * pow(a, 4) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep2) * pow(a, 6) / 720)) AS northing FROM m)
SELECT pid, zone, CAST(round(easting / 10) * 10 AS BIGINT) AS easting, CAST(round(northing / 10) * 10 AS BIGINT) AS northing FROM g"""


def _corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A five-sided plot around each place, its corners by the place's key."""
    p = places(spark, sf_dir).select(F.col("pid").alias("zone"), "lat", "lon", F.explode(F.expr("sequence(0, 4)")).alias("i"))
    return p.select("zone", "i", F.expr(f"{_CORNER[0]} AS lat"), F.expr(f"{_CORNER[1]} AS lon"))


_CORNER = ("lat + (1 + zone % 3) * 0.2e0 * sin(radians(72e0 * i))", "lon + (1 + zone % 4) * 0.3e0 * cos(radians(72e0 * i))")
_PLOTS = f"""WITH {PLACES}, v AS (SELECT zone, i, {_CORNER[0]} AS lat, {_CORNER[1]} AS lon FROM (SELECT pid AS zone, lat, lon, unnest(range(0, 5)) AS i FROM places)),
e AS (SELECT a.zone, a.lat, a.lon, b.lat AS lat2, b.lon AS lon2 FROM v a JOIN v b ON b.zone = a.zone AND b.i = (a.i + 1) % 5)
SELECT zone, round(abs(sum((radians(lon2) - radians(lon)) * (2 + sin(radians(lat)) + sin(radians(lat2))))) * 6371.0 * 6371.0 / 2) AS area_km2,
  round(sum(2 * 6371.0 * asin(sqrt(pow(sin((radians(lat2) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(lat2)) * pow(sin((radians(lon2) - radians(lon)) / 2), 2))))) AS perimeter_km FROM e GROUP BY zone"""
_STEP = 2_000_000.0
_DENSE = f"""WITH {FIXES}, l AS (SELECT key AS line, id AS i, lat, lon, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2 FROM fixes WINDOW w AS (PARTITION BY key ORDER BY id)),
d AS (SELECT *, {geo.haversine('lat', 'lon', 'lat2', 'lon2')} AS leg FROM l),
c AS (SELECT *, coalesce(sum(leg) OVER (PARTITION BY line ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, CASE WHEN leg IS NULL THEN 1 ELSE greatest(CAST(ceil(leg / {_STEP!r}) AS BIGINT), 1) END AS n FROM d),
k AS (SELECT *, unnest(range(0, n)) AS k FROM c)
SELECT line, i, k, round(lat + coalesce(k / n * (lat2 - lat), 0), 7) AS lat, round(lon + coalesce(k / n * (lon2 - lon), 0), 7) AS lon, round(round(before + coalesce(k / n * leg, 0), 2) / 100) AS distance_hm FROM k"""


_SESSIONS = "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), k AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM k GROUP BY user_id, s"
_POLLS = 3
_ACTIVE = 40


def _polled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three polls, each the newest of a third of the events by key; what changed between them."""
    f = fixes(spark, sf_dir)
    store = live.Snapshots(spark, f"{scratch_dir(spark)}/snapshots-{uuid.uuid4().hex}", "key", ["lat", "lon"])
    out = None
    for v in range(_POLLS):
        store.poll(v, feeds.latest_fix(f.filter((F.col("id") + F.floor(F.col("id") / 7)) % _POLLS == v)))
        told = store.changes(v).select(F.lit(v).alias("version"), "*")
        out = told if out is None else out.unionByName(told)
    return out


def build() -> dict[str, tuple]:
    q: dict[str, tuple] = {}
    text = ", ".join(f"{x} AS {k}" for k, x in _SCALARS.items())
    q["coordinate_functions"] = (lambda s, d: places(s, d).select("pid", *[F.expr(x).alias(k) for k, x in _SCALARS.items()]), f"WITH {PLACES} SELECT pid, {text} FROM places")
    text = ", ".join(f"{x} AS {k}" for k, x in _LADDERS.items())
    q["classification_ladders"] = (lambda s, d: s.read.parquet(f"{d}/events.parquet").select("event_id", *[F.expr(x).alias(k) for k, x in _LADDERS.items()]), f"SELECT event_id, {text} FROM events")
    q["extract_at_points"] = (
        lambda s, d: vector.extract_at_points(places(s, d).select("pid", F.expr("CAST(rint(lat * 5 + 0.1e0) AS INT)").alias("r"), F.expr("CAST(rint(abs(lon) / 3) AS INT)").alias("c")), dem(s, d, True)),
        f"WITH {HOLES}, {PLACES}, p AS (SELECT pid, CAST(round_even(lat * 5 + 0.1e0, 0) AS INT) AS r, CAST(round_even(abs(lon) / 3, 0) AS INT) AS c FROM places) SELECT pid, p.r, p.c, z FROM p LEFT JOIN dem USING (r, c)",
    )
    q["bilinear_sample"] = (_sampled, f"WITH {DEM}, p AS (SELECT event_id AS pid, event_id % 2000 * 0.2475e0 AS y, event_id % 63 + 0.3713e0 AS x FROM events) SELECT pid, round(a.z * (1 - (y - floor(y))) * (1 - (x - floor(x))) + b.z * (1 - (y - floor(y))) * (x - floor(x)) + g.z * (y - floor(y)) * (1 - (x - floor(x))) + h.z * (y - floor(y)) * (x - floor(x)), 1) AS z FROM p JOIN dem a ON a.r = CAST(floor(y) AS INT) AND a.c = CAST(floor(x) AS INT) JOIN dem b ON b.r = a.r AND b.c = a.c + 1 JOIN dem g ON g.r = a.r + 1 AND g.c = a.c JOIN dem h ON h.r = a.r + 1 AND h.c = a.c + 1")
    q["points_in_polygons"] = (lambda s, d: vector.points_in_polygons(places(s, d).selectExpr("pid", "abs(lon) / 3 AS x", "lat * 2 + 170 AS y"), zone_edges(s)), f"WITH {PLACES}, {EDGES} SELECT pid, zone FROM (SELECT pid, abs(lon) / 3 AS x, lat * 2 + 170 AS y FROM places) p JOIN edges ON (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 GROUP BY pid, zone HAVING count(*) % 2 = 1")
    q["rasterize_lines"] = (lambda s, d: vector.rasterize_lines(_segments(s, d)), f"WITH seg AS (SELECT {_SEGMENT} FROM customer), n AS (SELECT *, greatest(abs(r2 - r1), abs(c2 - c1), 1) AS n FROM seg), k AS (SELECT *, unnest(range(0, n + 1)) AS k FROM n) SELECT DISTINCT line, CAST(round_even(r1 + CAST((r2 - r1) * k AS DOUBLE) / n, 0) AS INT) AS r, CAST(round_even(c1 + CAST((c2 - c1) * k AS DOUBLE) / n, 0) AS INT) AS c FROM k")
    gx, gy = 360.0 / 8 * 60 / 256, 180.0 / 8 * 60 / 256
    q["cluster_points"] = (lambda s, d: vector.cluster_points(places(s, d), 3, (-120.0, -60.0, 120.0, 60.0)), f"WITH {PLACES} SELECT round(avg(lon), 6) AS lon, round(avg(lat), 6) AS lat, count(*) AS n, max(weight) AS top FROM places WHERE lon BETWEEN -120 AND 120 AND lat BETWEEN -60 AND 60 GROUP BY floor((lon + 120) / {gx!r}), floor((lat + 60) / {gy!r})")
    dist = geo.haversine("lat", "lon", "slat", "slon", geo.EARTH_NM)
    q["nearest_station"] = (lambda s, d: vector.nearest(places(s, d), stations(s, d)), f"WITH {PLACES}, {STATIONS}, x AS (SELECT pid, sid, {dist} AS d, row_number() OVER (PARTITION BY pid ORDER BY {dist}, sid) AS k FROM places, stations) SELECT pid, sid, round(d, 1) AS distance_nm FROM x WHERE k = 1")
    q["path_profile"] = (
        lambda s, d: vector.path_profile(dem(s, d).select(F.col("r").alias("line"), (F.col("c") * 111.32).alias("distance_m"), "z")),
        f"WITH {DEM}, g AS (SELECT r AS line, c * 111.32e0 AS distance_m, z, z - lag(z) OVER (PARTITION BY r ORDER BY c) AS d FROM dem) SELECT line, max(distance_m) AS length_m, round(sum(greatest(d, 0)), 2) AS gain, round(sum(greatest(-d, 0)), 2) AS loss, min(z) AS min_z, max(z) AS max_z FROM g GROUP BY line",
    )
    legs = f"{FIXES}, o AS (SELECT *, lag(lat) OVER w AS lat0, lag(lon) OVER w AS lon0, lag(ts) OVER w AS ts0 FROM fixes WINDOW w AS (PARTITION BY key ORDER BY ts, id)), l AS (SELECT key, id, round({geo.haversine('lat0', 'lon0', 'lat', 'lon')}, 2) AS leg_m, CASE WHEN lat0 = lat AND lon0 = lon THEN NULL ELSE round({geo.bearing('lat0', 'lon0', 'lat', 'lon')}, 4) END AS bearing, CAST(floor(epoch(ts)) - floor(epoch(ts0)) AS BIGINT) AS seconds FROM o)"
    q["track_legs"] = (lambda s, d: feeds.track_legs(fixes(s, d)), f"WITH {legs} SELECT * FROM l")
    q["latest_fix"] = (lambda s, d: feeds.latest_fix(fixes(s, d)), f"WITH {FIXES} SELECT key, id, ts, lat, lon, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, id DESC) AS k FROM fixes) WHERE k = 1")
    q["storm_tracks"] = (lambda s, d: feeds.tracks(fixes(s, d)), f"WITH {legs}, p AS (SELECT key, round(sum(leg_m) / 1000, 2) AS length_km FROM l GROUP BY key), h AS (SELECT key, count(*) AS n_fixes, max(value) AS peak, min(ts) AS first_ts, max(ts) AS last_ts FROM fixes GROUP BY key) SELECT h.key, n_fixes, peak, first_ts, last_ts, length_km, {geo.storm_class('peak')} AS category FROM h JOIN p USING (key)")
    q["feature_page"] = (_page, f"WITH {PLACES}, f AS (SELECT pid AS fid, lon, lat, weight FROM places WHERE lon BETWEEN -100 AND 100 AND lat BETWEEN -40 AND 60 AND segment = 'BUILDING' AND weight > 1000) SELECT *, (SELECT count(*) FROM f) AS number_matched FROM f ORDER BY fid LIMIT 20 OFFSET 10")
    near = geo.haversine("40e0", "10e0", "lat", "lon", geo.EARTH_NM)
    q["within_radius"] = (lambda s, d: feeds.within_radius(places(s, d), 40.0, 10.0, 900.0).select("pid", "distance_nm"), f"WITH {PLACES} SELECT pid, round({near}, 3) AS distance_nm FROM places WHERE round({near}, 3) <= 900")
    q["elevation_fallback"] = (_chain, f"WITH {HOLES}, p AS (SELECT event_id AS pid, event_id % 520 AS r, event_id % 70 AS c FROM events) SELECT pid, CASE WHEN z > 550 THEN z ELSE -z END AS z, CASE WHEN z IS NULL THEN 'none' WHEN z > 550 THEN 'land' ELSE 'ocean' END AS source FROM p LEFT JOIN dem ON dem.r = p.r AND dem.c = p.c")
    q["tile_roundtrip"] = (_rebuilt, f"WITH {HOLES} SELECT r, c, z FROM dem WHERE z IS NOT NULL")
    q["tile_quantised_error"] = (_quantised_error, None)
    q["tile_manifest"] = (lambda s, d: tiles.manifest(tiles.encode_tiles(dem(s, d, True))).select("tr", "n_tiles", "n_cells"), f"WITH {HOLES} SELECT CAST(r // 64 AS INT) AS tr, count(DISTINCT c // 64) AS n_tiles, count(z) AS n_cells FROM dem GROUP BY 1")
    q["stream_windows"] = (lambda s, d: live.drained(live.windowed(live.read_events(s, d)), "complete", "windows").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total"), "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE user_id IS NOT NULL GROUP BY 1, 2")
    q["stream_last_known"] = (lambda s, d: live.drained(live.last_known(live.read_events(s, d)), "complete", "last").select("user_id", "event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "event_type", "value"), "SELECT user_id, event_id, ts, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
    q["stream_live_positions"] = (lambda s, d: live.drained(live.live_positions(live.read_events(s, d)), "update", "live").filter("not expired").groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id")), "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts) DESC, event_id DESC) AS k FROM events) WHERE k = 1")
    q["polygon_measure"] = (lambda s, d: vector.polygon_measure(_corners(s, d)).select("zone", F.round("area_km2").alias("area_km2"), F.round("perimeter_km").alias("perimeter_km")), _PLOTS)
    q["densified_path"] = (lambda s, d: vector.densified_path(fixes(s, d).select(F.col("key").alias("line"), F.col("id").alias("i"), "lat", "lon"), _STEP).select("line", "i", "k", "lat", "lon", F.round(F.col("distance_m") / 100).alias("distance_hm")), _DENSE)
    q["grid_references"] = (lambda s, d: _grid_references(s, d).select("pid", "zone", *[(F.round(F.col(c) / 10) * 10).cast("long").alias(c) for c in ("easting", "northing")]), _grid_sql())
    q["stream_active_set"] = (lambda s, d: live.merge_active(live.drained(live.active_set(live.read_events(s, d), _ACTIVE), "update", "active"), _ACTIVE).select("user_id", "event_id", F.col("ts").cast("timestamp_ntz").alias("ts")), f"SELECT user_id, event_id, date_trunc('millisecond', ts) AS ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts) DESC, event_id DESC) AS k FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL) WHERE k = 1 ORDER BY epoch_ms(ts) DESC, event_id DESC, user_id DESC LIMIT {_ACTIVE}")
    q["snapshot_changes"] = (_polled, f"WITH {FIXES}, p AS (SELECT CAST((id + id // 7) % 3 AS INT) AS version, key, arg_max(lat, (ts, id)) AS lat, arg_max(lon, (ts, id)) AS lon FROM fixes GROUP BY 1, 2), v AS (SELECT unnest(range(0, 3)) AS version), b AS (SELECT v.version, coalesce(n.key, o.key) AS key, CASE WHEN o.key IS NULL THEN 'added' WHEN n.key IS NULL THEN 'gone' ELSE 'moved' END AS change, coalesce(n.lat, o.lat) AS lat, coalesce(n.lon, o.lon) AS lon, n.key IS NOT NULL AND o.key IS NOT NULL AND n.lat = o.lat AND n.lon = o.lon AS same FROM v JOIN (SELECT DISTINCT version AS w, key FROM p) k ON k.w IN (v.version, v.version - 1) LEFT JOIN p n ON n.version = v.version AND n.key = k.key LEFT JOIN p o ON o.version = v.version - 1 AND o.key = k.key) SELECT DISTINCT CAST(version AS INT) AS version, key, change, lat, lon FROM b WHERE NOT same")
    q["stream_sessions"] = (lambda s, d: live.drained(live.sessions(live.read_events(s, d)).select(F.col("start").cast("timestamp_ntz").alias("start"), "user_id", "n"), "complete", "sessions"), _SESSIONS)
    q["session_windows"] = (lambda s, d: s.read.parquet(f"{d}/events.parquet").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), "n"), _SESSIONS)
    return q
