"""Queries over the terrain model, with their SQL oracles."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import grid, terrain, vector

DEM = """dem AS (SELECT CAST(vec_id AS INT) AS r, CAST(i - 1 AS INT) AS c, round(500 + CAST(embedding[i] AS DOUBLE) * 1000) AS z
  FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))"""
HOLES = DEM.replace("dem AS", "full_dem AS") + ", dem AS (SELECT r, c, CASE WHEN (r * 31 + c * 17) % 97 <> 0 THEN z END AS z FROM full_dem)"
AROUND = """v AS (SELECT r, c, z, lag(z) OVER (PARTITION BY c ORDER BY r) AS n, lead(z) OVER (PARTITION BY c ORDER BY r) AS s FROM dem),
h AS (SELECT r, c, z, n, s, lag(z) OVER o AS w, lead(z) OVER o AS e, lag(n) OVER o AS nw, lead(n) OVER o AS ne, lag(s) OVER o AS sw, lead(s) OVER o AS se FROM v WINDOW o AS (PARTITION BY r ORDER BY c))"""
#: Cells that rays and lines of sight of the queries go.
FAR = 100
BLOCK = "ext AS (SELECT max(r) AS rm, max(c) AS cm FROM dem)"

#: Full of data: sums of many cells and paths; with holes: whatever has to respect missing neighbours.
WITH_HOLES = {"slope", "slope_fast", "aspect", "hillshade", "tpi", "tri", "roughness", "highland", "edge_contamination", "edge_density", "curvature"}


def dem(spark: SparkSession, sf_dir: str, holes: bool = False) -> DataFrame:
    return grid.terrain_model(spark, sf_dir, holes)


def pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rasters: the terrain, and itself moved by one row and mirrored in value."""
    z = dem(spark, sf_dir, True)
    other = dem(spark, sf_dir).select((F.col("r") + 1).alias("r"), "c", (F.lit(1000.0) - F.col("z")).alias("y"))
    return z.join(other, ["r", "c"], "left")


PAIR = f"{HOLES}, two AS (SELECT dem.r, dem.c, dem.z, 1000.0 - o.z AS y FROM dem LEFT JOIN full_dem o ON o.r + 1 = dem.r AND o.c = dem.c)"


def _around(size: int, reflect: bool = True) -> str:
    """SQL of (r, c, v): every cell with all values of its window, the border reflected."""
    h = size // 2
    fold = lambda x, m: f"CASE WHEN {x} < 0 THEN -({x}) - 1 WHEN {x} > {m} THEN 2 * {m} + 1 - ({x}) ELSE {x} END"
    return f"""off AS (SELECT a AS dr, b AS dc FROM range({-h}, {h + 1}) t(a), range({-h}, {h + 1}) u(b)), {BLOCK},
pos AS (SELECT r, c, z, {fold('r + dr', 'rm')} AS sr, {fold('c + dc', 'cm')} AS sc FROM dem, off, ext),
win AS (SELECT pos.r, pos.c, pos.z, d.z AS v FROM pos JOIN dem d ON d.r = pos.sr AND d.c = pos.sc)"""


def _ray(dr: float, dc: float, steps: int) -> str:
    """SQL of (r, c, z, k, zk, gap, off): steps along a direction; gap and off are the first k without data, off the grid."""
    return f"""k AS (SELECT k FROM range(1, {steps + 1}) t(k)), far AS (SELECT d.r, d.c, d.z, k, o.z AS zk, o.r IS NULL AS away
  FROM dem d CROSS JOIN k LEFT JOIN dem o ON o.r = CAST(round_even(d.r + k * CAST({dr!r} AS DOUBLE), 0) AS INT) AND o.c = CAST(round_even(d.c + k * CAST({dc!r} AS DOUBLE), 0) AS INT) WHERE d.z IS NOT NULL),
ray AS (SELECT *, min(CASE WHEN zk IS NULL THEN k END) OVER (PARTITION BY r, c) AS gap, min(CASE WHEN away THEN k END) OVER (PARTITION BY r, c) AS off FROM far)"""


ZONES = {0: ((2.5, 10.5), (30.5, 12.5), (20.5, 90.5), (5.5, 70.5)), 1: ((35.5, 100.5), (60.5, 100.5), (60.5, 160.5), (47.5, 120.5), (35.5, 160.5)), 2: ((10.5, 200.5), (50.5, 210.5), (30.5, 300.5))}


def zone_edges(spark: SparkSession) -> DataFrame:
    rows = [(z, *p, *q) for z, ring in ZONES.items() for p, q in zip(ring, ring[1:] + ring[:1], strict=True)]
    return spark.createDataFrame([(z, float(a), float(b), float(c), float(d)) for z, a, b, c, d in rows], "zone int, x1 double, y1 double, x2 double, y2 double")


EDGES = "edges(zone, x1, y1, x2, y2) AS (VALUES " + ", ".join(f"({z}, {p[0]}, {p[1]}, {q[0]}, {q[1]})" for z, ring in ZONES.items() for p, q in zip(ring, ring[1:] + ring[:1], strict=True)) + ")"


def slope_zonal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slope by row zone (the label of the row): mean, greatest, cells."""
    slope = terrain.derive(dem(spark, sf_dir), "slope", digits=4).filter("slope is not null")
    zones = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("int").alias("r"), F.col("label").alias("zone"))
    return slope.join(zones, "r").groupBy("zone").agg(F.round(F.avg("slope"), 4).alias("mean_slope"), F.max("slope").alias("max_slope"), F.count(F.lit(1)).alias("n_cells"))


def build() -> dict[str, tuple]:
    """name -> (query, SQL or None)."""
    q: dict[str, tuple] = {}
    q["slope_zonal"] = (slope_zonal, f"WITH {DEM}, {AROUND}, g AS (SELECT r, round(CAST({terrain.formula('slope')} AS DOUBLE), 4) AS slope FROM h) SELECT label AS zone, round(avg(slope), 4) AS mean_slope, max(slope) AS max_slope, count(*) AS n_cells FROM g JOIN embeddings ON vec_id = r WHERE slope IS NOT NULL GROUP BY label")
    for name in terrain.FORMULAS:
        holes = name in WITH_HOLES
        q[name] = (lambda s, d, x=name, holes=holes: terrain.derive(dem(s, d, holes), x), f"WITH {HOLES if holes else DEM}, {AROUND} SELECT r, c, round(CAST({terrain.formula(name)} AS DOUBLE), 6) AS {name} FROM h")
    sums = ", ".join(f"sum(s{k}) OVER w{k} AS s{k}, sum(n{k}) OVER w{k} AS n{k}" for k in (2, 5, 10))
    down = ", ".join(f"sum(z) OVER v{k} AS s{k}, count(z) OVER v{k} AS n{k}" for k in (2, 5, 10))
    over = lambda name, part, order: ", ".join(f"{name}{k} AS (PARTITION BY {part} ORDER BY {order} RANGE BETWEEN {k} PRECEDING AND {k} FOLLOWING)" for k in (2, 5, 10))
    index = ", ".join(f"CASE WHEN z IS NOT NULL AND n{k} > 1 THEN z - (s{k} - z) / (n{k} - 1) END AS t{k}" for k in (2, 5, 10))
    q["mstp"] = (
        lambda s, d: terrain.mstp(dem(s, d, True)),
        f"WITH {HOLES}, dn AS (SELECT r, c, z, {down} FROM dem WINDOW {over('v', 'c', 'r')}), ac AS (SELECT r, c, z, {sums} FROM dn WINDOW {over('w', 'r', 'c')}), ix AS (SELECT r, c, {index} FROM ac) SELECT r, c, CAST(CASE WHEN t10 IS NULL THEN -1 WHEN t10 > 0.5 AND t2 > 0.3 THEN 0 WHEN t10 > 0.2 AND t5 > 0.2 THEN 1 WHEN abs(t10) < 0.3 THEN 2 WHEN t10 < -0.2 AND t5 < -0.1 THEN 3 WHEN t10 < -0.5 AND t2 < -0.3 THEN 4 WHEN t10 > 0 THEN 0 ELSE 4 END AS INT) AS mstp FROM ix",
    )
    q["slope_at_latitude"] = (lambda s, d: terrain.derive(dem(s, d), "slope", cell_x=terrain.width_at(46.5)), f"WITH {DEM}, {AROUND} SELECT r, c, round(CAST({terrain.formula('slope', terrain.width_at(46.5))} AS DOUBLE), 6) AS slope FROM h")
    q["slope_stats"] = (
        lambda s, d: terrain.derive(dem(s, d), "slope").agg(F.round(F.avg("slope"), 4).alias("mean"), F.round(F.percentile("slope", F.lit(0.5)), 4).alias("median"), F.min("slope").alias("min"), F.max("slope").alias("max"), F.round(F.stddev_pop("slope"), 4).alias("std")),
        f"WITH {DEM}, {AROUND}, g AS (SELECT round(CAST({terrain.formula('slope')} AS DOUBLE), 6) AS slope FROM h) SELECT round(avg(slope), 4) AS mean, round(quantile_cont(slope, 0.5), 4) AS median, min(slope) AS min, max(slope) AS max, round(stddev_pop(slope), 4) AS std FROM g",
    )
    for name in terrain.ALGEBRA:
        q[name] = (lambda s, d, x=name: terrain.algebra(pair(s, d), x), f"WITH {PAIR} SELECT r, c, round(CAST({terrain.algebra_sql(name)} AS DOUBLE), 6) AS {name} FROM two")
    q["color_relief"] = (lambda s, d: terrain.color_relief(dem(s, d, True)), f"WITH {HOLES} SELECT r, c, " + ", ".join(f"CAST(floor({terrain.ramp_channel(k)}) AS INT) AS {x}" for k, x in enumerate(("red", "green", "blue"))) + ", CASE WHEN z IS NULL THEN 0 ELSE 255 END AS alpha FROM dem")
    stats = f"{BLOCK}, st AS (SELECT avg(z) AS mean_z, min(z) AS min_z, max(z) AS max_z, min(CASE WHEN r = 0 OR c = 0 OR r = rm OR c = cm THEN z END) AS edge_z FROM dem, ext)"
    for name in terrain.GLOBAL:
        q[name] = (lambda s, d, x=name: terrain.against_whole(dem(s, d, True), x), f"WITH {HOLES}, {stats} SELECT r, c, round({terrain.GLOBAL[name]}, 6) AS {name} FROM dem, st")
    q["pct_beyond_thresh"] = (lambda s, d: terrain.share_beyond(dem(s, d, True), 600.0), f"WITH {HOLES} SELECT round(avg(CASE WHEN z > 600 THEN 1.0 ELSE 0.0 END), 6) AS pct_above, round(avg(CASE WHEN z < 600 THEN 1.0 ELSE 0.0 END), 6) AS pct_below FROM dem WHERE z IS NOT NULL")
    q["annual_heinardh"] = (lambda s, d: terrain.relief_energy(dem(s, d)), f"WITH {DEM}, {AROUND}, st AS (SELECT min(z) AS lo, max(z) AS hi FROM dem) SELECT r, c, round((z - lo) / (hi - lo) * round(CAST({terrain.formula('slope')} AS DOUBLE), 9), 6) AS annual_heinardh FROM h, st")

    box = lambda size, agg, name, having="": f"WITH {HOLES}, {_around(size)} SELECT r, c, {agg} AS {name} FROM win GROUP BY r, c, z{having}"
    q["mean_filter"] = (lambda s, d: terrain.mean_filter(dem(s, d, True), 5), box(5, "round(CASE WHEN z IS NOT NULL THEN avg(v) END, 6)", "mean_filter"))
    for kind in ("max", "min"):
        q[f"{kind}_filter"] = (lambda s, d, k=kind: terrain.extreme_filter(dem(s, d, True), k, 5), box(5, f"CASE WHEN z IS NOT NULL THEN {kind}(v) END", f"{kind}_filter"))
    q["median_filter"] = (lambda s, d: terrain.median_filter(dem(s, d, True), 3), box(3, "round(CASE WHEN z IS NOT NULL THEN quantile_cont(v, 0.5) END, 6)", "median_filter"))
    q["remove_off_terrain"] = (lambda s, d: terrain.remove_off_terrain(dem(s, d, True)), box(5, "round(CASE WHEN z - quantile_cont(v, 0.5) > 5 THEN quantile_cont(v, 0.5) ELSE z END, 6)", "remove_off_terrain"))
    q["elevation_percentile"] = (lambda s, d: terrain.elevation_percentile(dem(s, d, True)), box(5, "round(avg(CASE WHEN v <= z THEN 1.0 ELSE 0.0 END) FILTER (v IS NOT NULL), 6)", "elevation_percentile", " HAVING z IS NOT NULL"))
    q["majority_filter"] = (lambda s, d: terrain.majority_filter(dem(s, d, True)), f"WITH {HOLES}, {_around(3)}, votes AS (SELECT r, c, CAST(floor(v / 100) AS BIGINT) AS k, count(*) AS n FROM win WHERE v IS NOT NULL AND z IS NOT NULL GROUP BY 1, 2, 3) SELECT r, c, arg_max(k, n * 100000 - k) AS majority_filter FROM votes GROUP BY r, c")
    for name, one, two in (("opening", "min", "max"), ("closing", "max", "min")):
        second = _around(3).replace("off AS", "off2 AS").replace(", off,", ", off2,").replace("pos AS", "pos2 AS").replace("FROM pos JOIN dem d ON d.r = pos.sr AND d.c = pos.sc", "FROM pos2 AS pos JOIN e1 d ON d.r = pos.sr AND d.c = pos.sc").replace("win AS", "win2 AS").replace(BLOCK + ",", "")
        q[name] = (lambda s, d, f=getattr(terrain, name): f(dem(s, d, True)), f"WITH {HOLES}, {_around(3)}, e1 AS (SELECT r, c, {one}(v) AS z FROM win GROUP BY r, c), {second} SELECT r, c, CASE WHEN z IS NOT NULL THEN {two}(v) END AS {name} FROM win2 GROUP BY r, c, z")
    q["adaptive_filter"] = (lambda s, d: terrain.adaptive_filter(dem(s, d)), f"WITH {DEM}, {_around(5)}, gv AS (SELECT var_pop(z) AS gv FROM dem), m AS (SELECT r, c, z, avg(v) AS mv, sum(v * v) / count(v) - (sum(v) / count(v)) * (sum(v) / count(v)) AS lv FROM win GROUP BY r, c, z) SELECT r, c, round(mv + greatest(0.0, (gv - lv) / (gv + lv)) * (z - mv), 6) AS adaptive_filter FROM m, gv")
    smooth_around = _around(9).replace("d.z AS v", "d.wt AS wt, d.wt * d.z AS wz").replace("JOIN dem d", "JOIN rg d")
    q["feature_preserving_smooth"] = (lambda s, d: terrain.feature_preserving_smooth(dem(s, d, True)), f"WITH {HOLES}, {AROUND}, rg AS (SELECT r, c, z, CASE WHEN z IS NOT NULL AND {terrain.formula('highland')} < 200 THEN 1 / ({terrain.formula('highland')} + 0.1) END AS wt FROM h), {smooth_around} SELECT r, c, round(CASE WHEN z IS NULL THEN NULL WHEN sum(wt) > 0 THEN sum(wz) / sum(wt) ELSE z END, 4) AS feature_preserving_smooth FROM win GROUP BY r, c, z")
    corr_around = _around(5).replace("d.z AS v", "d.z AS a, d.y AS b").replace("dem", "both2")
    q["image_correlation"] = (
        lambda s, d: terrain.image_correlation(_square_pair(s, d)),
        f"WITH {DEM}, both2 AS (SELECT dem.r - 1 AS r, dem.c, dem.z, 1000.0 - o.z AS y FROM dem JOIN dem o ON o.r + 1 = dem.r AND o.c = dem.c), {corr_around}, m AS (SELECT r, c, count(*) AS k, sum(a) AS sa, sum(b) AS sb, sum(a * a) AS saa, sum(b * b) AS sbb, sum(a * b) AS sab FROM win GROUP BY r, c) SELECT r, c, round(CASE WHEN k * saa - sa * sa > 1e-6 AND k * sbb - sb * sb > 1e-6 THEN (k * sab - sa * sb) / sqrt((k * saa - sa * sa) * (k * sbb - sb * sb)) END, 5) AS image_correlation FROM m",
    )
    q["image_autocorrelation"] = (lambda s, d: terrain.local_moran(dem(s, d)), f"WITH {DEM}, {_around(5)}, st AS (SELECT avg(z) AS m, var_pop(z) AS vv FROM dem), w AS (SELECT r, c, z, sum(v) AS t, count(v) AS k FROM win GROUP BY r, c, z) SELECT r, c, round((z - m) * ((t - z) / (k - 1) - m) / vv, 6) AS image_autocorrelation FROM w, st")

    a = math.radians(30.0)
    q["directional_relief"] = (lambda s, d: terrain.directional_relief(dem(s, d, True), 30.0, FAR), f"WITH {HOLES}, {_ray(-math.sin(a), math.cos(a), FAR)} SELECT r, c, round(coalesce(avg(CASE WHEN zk < z THEN 1.0 ELSE 0.0 END) FILTER (zk IS NOT NULL AND (off IS NULL OR k < off)), 0), 6) AS directional_relief FROM ray GROUP BY r, c")
    q["max_elevation_from_direction"] = (lambda s, d: terrain.max_elevation_from_direction(dem(s, d, True), 30.0, 50), f"WITH {HOLES}, {_ray(-math.sin(a), math.cos(a), 50)} SELECT r, c, greatest(max(z), max(zk) FILTER (gap IS NULL OR k < gap)) AS max_elevation FROM ray GROUP BY r, c")
    b = math.radians(315.0)
    q["fetch_analysis"] = (lambda s, d: terrain.fetch_analysis(dem(s, d, True), 315.0, FAR), f"WITH {HOLES}, {_ray(math.sin(b), -math.cos(b), FAR)} SELECT r, c, CAST(coalesce(min(k) FILTER (zk IS NULL OR zk >= z), {FAR}) AS INT) AS fetch FROM ray GROUP BY r, c")
    q["horizon_angle"] = (lambda s, d: terrain.horizon_angle(dem(s, d, True), 315.0, FAR), f"WITH {HOLES}, {_ray(math.sin(b), -math.cos(b), FAR)} SELECT r, c, round(greatest(0.0, max(degrees(atan2(zk - z, k * {terrain.CELL!r}))) FILTER (gap IS NULL OR k < gap)), 6) AS horizon_angle FROM ray GROUP BY r, c")
    q["viewshed"] = (lambda s, d: terrain.viewshed(dem(s, d), observers(s, d), FAR), _viewshed_sql(FAR) + " SELECT o, r, c, visible FROM seen")
    q["visibility_index"] = (lambda s, d: terrain.visibility_index(dem(s, d), observers(s, d), FAR), _viewshed_sql(FAR) + " SELECT r, c, count(*) FILTER (visible) AS visibility_index FROM seen GROUP BY r, c")
    q["profile"] = (lambda s, d: terrain.profile(dem(s, d), s.range(0, 40).select((F.col("id") % 4).alias("line"), F.floor(F.col("id") / 4).alias("i"), (F.col("id") * 3).cast("int").alias("r"), (F.col("id") % 7 * 5).cast("int").alias("c"))), f"WITH {DEM}, p AS (SELECT i % 4 AS line, i // 4 AS i, CAST(i * 3 AS INT) AS r, CAST(i % 7 * 5 AS INT) AS c FROM range(0, 40) t(i)), g AS (SELECT *, coalesce(sqrt(power(r - lag(r) OVER o, 2) + power(c - lag(c) OVER o, 2)), 0) * {terrain.CELL!r} AS leg FROM p WINDOW o AS (PARTITION BY line ORDER BY i)) SELECT line, i, g.r, g.c, z, round(sum(leg) OVER (PARTITION BY line ORDER BY i), 1) AS distance_m FROM g LEFT JOIN dem USING (r, c)")

    q["zonal_stats"] = (lambda s, d: vector.zonal_stats(dem(s, d, True), zone_edges(s)), f"WITH {HOLES}, {EDGES}, ins AS (SELECT zone, r, c, z FROM dem JOIN edges ON (y1 > r) <> (y2 > r) AND c < (x2 - x1) * (r - y1) / (y2 - y1) + x1 WHERE z IS NOT NULL GROUP BY zone, r, c, z HAVING count(*) % 2 = 1) SELECT zone, round(avg(z), 2) AS mean, round(min(z), 2) AS min, round(max(z), 2) AS max, round(sum(z), 2) AS sum, round(stddev_pop(z), 2) AS std, count(*) AS count FROM ins GROUP BY zone")
    q["contour_segments"] = (lambda s, d: vector.contour_segments(dem(s, d), 50.0), _contour_sql(50.0))
    q["grid_to_geojson"] = (lambda s, d: vector.grid_to_geojson(dem(s, d, True)).select("r", "c", F.get_json_object("feature", "$.properties.value").cast("double").alias("value"), F.get_json_object("feature", "$.geometry.coordinates[0]").cast("double").alias("lon")), f"WITH {HOLES} SELECT r, c, round(z, 2) AS value, round(c * 0.001, 6) AS lon FROM dem WHERE z IS NOT NULL")
    q["terrain_mesh"] = (lambda s, d: vector.mesh(dem(s, d, True)), f"WITH {HOLES}, {AROUND} SELECT r, c, half, CASE half WHEN 0 THEN z ELSE e END AS z1, s AS z2, CASE half WHEN 0 THEN e ELSE se END AS z3 FROM h, (VALUES (0), (1)) t(half) WHERE z + e + s + se IS NOT NULL")
    q["compute_rmse"] = (lambda s, d: _smoothing_error(s, d), f"WITH {HOLES}, {_around(3)}, m AS (SELECT z AS a, round(avg(v), 6) - z AS e FROM win WHERE z IS NOT NULL GROUP BY r, c, z) SELECT count(*) AS n, round(sqrt(avg(e * e)), 6) AS rmse, round(avg(abs(e)), 6) AS mae, round(max(abs(e)), 6) AS max_error, round(avg(e), 6) AS bias, round(stddev_pop(e), 6) AS std, round(quantile_cont(abs(e), 0.5), 6) AS p50, round(quantile_cont(abs(e), 0.95), 6) AS p95 FROM m")
    return q


def _square_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = dem(spark, sf_dir)
    other = z.select((F.col("r") + 1).alias("r"), "c", (F.lit(1000.0) - F.col("z")).alias("y"))
    return z.join(other, ["r", "c"]).select((F.col("r") - 1).alias("r"), "c", "z", "y")


def observers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The highest cell of every 256 rows, the first of equal ones."""
    top = dem(spark, sf_dir).groupBy(F.floor(F.col("r") / 256).cast("int").alias("o")).agg(F.max(F.struct("z", (-F.col("r")).alias("r"), (-F.col("c")).alias("c"))).alias("x"))
    return top.select("o", (-F.col("x.r")).alias("orow"), (-F.col("x.c")).alias("ocol"), F.lit(1.75).alias("height"))


def _viewshed_sql(radius: int) -> str:
    return f"""WITH {DEM}, {AROUND}, obs AS (SELECT CAST(r // 256 AS INT) AS o, r AS orow, c AS ocol FROM dem QUALIFY row_number() OVER (PARTITION BY r // 256 ORDER BY z DESC, r, c) = 1), eye AS (SELECT obs.*, z + 1.75 AS eye FROM obs JOIN dem ON r = orow AND c = ocol),
near AS (SELECT o, orow, ocol, eye, r, c, sqrt(power(r - orow, 2) + power(c - ocol, 2)) AS d FROM eye JOIN dem ON abs(r - orow) <= {radius} AND abs(c - ocol) <= {radius}),
smp AS (SELECT *, greatest(CAST(floor(2 * d) AS BIGINT), 2) AS steps, unnest(range(1, greatest(CAST(floor(2 * d) AS BIGINT), 2) + 1)) AS i FROM near WHERE d > 0 AND d <= {radius}),
pos AS (SELECT *, CAST(i AS DOUBLE) / steps AS t, orow + CAST(i AS DOUBLE) / steps * (r - orow) AS pr, ocol + CAST(i AS DOUBLE) / steps * (c - ocol) AS pc FROM smp),
cor AS (SELECT pos.*, h.z AS z00, coalesce(h.e, h.z) AS z01, coalesce(h.s, h.z) AS z10, coalesce(h.se, h.s, h.e, h.z) AS z11, pr - floor(pr) AS fr, pc - floor(pc) AS fc FROM pos JOIN h ON h.r = CAST(floor(pr) AS INT) AND h.c = CAST(floor(pc) AS INT)),
slp AS (SELECT o, r, c, i, steps, (z00 * (1 - fr) * (1 - fc) + z01 * (1 - fr) * fc + z10 * fr * (1 - fc) + z11 * fr * fc - eye) / (t * d * {terrain.CELL!r}) AS sl FROM cor),
lin AS (SELECT o, r, c, max(sl) FILTER (i < steps) AS bef, max(sl) FILTER (i = steps) AS tgt FROM slp GROUP BY o, r, c),
seen AS (SELECT o, r, c, tgt >= bef - 1e-10 AS visible FROM lin UNION ALL SELECT o, orow, ocol, true FROM eye)"""


def _contour_sql(interval: float) -> str:
    at = lambda p, q, y, x: f"CASE WHEN ({p} >= level) <> ({q} >= level) THEN {{'y': round(CAST({y.replace('F', f'(level - {p}) / ({q} - {p})')} AS DOUBLE), 6), 'x': round(CAST({x.replace('F', f'(level - {p}) / ({q} - {p})')} AS DOUBLE), 6)}} END"
    return f"""WITH {DEM}, {AROUND}, sq AS (SELECT r, c, z AS a, e AS b, se AS d, s AS g FROM h WHERE z + e + se + s IS NOT NULL),
lv AS (SELECT *, unnest(range(CAST(floor(least(a, b, d, g) / {interval}) AS BIGINT) + 1, CAST(floor(greatest(a, b, d, g) / {interval}) AS BIGINT) + 1)) * CAST({interval} AS DOUBLE) AS level FROM sq),
p AS (SELECT level, r, c, (a >= level) = ((a + b + d + g) / 4 >= level) AS turned, {at('a', 'b', 'r', 'c + F')} AS t, {at('b', 'd', 'r + F', 'c + 1')} AS i, {at('g', 'd', 'r + 1', 'c + F')} AS o, {at('a', 'g', 'r + F', 'c')} AS l FROM lv),
s AS (SELECT level, r, c, unnest(CASE WHEN t IS NOT NULL AND i IS NOT NULL AND o IS NOT NULL AND l IS NOT NULL THEN CASE WHEN turned THEN [[t, i], [o, l]] ELSE [[t, l], [i, o]] END ELSE [list_filter([t, i, o, l], lambda q: q IS NOT NULL)] END) AS sg FROM p)
SELECT level, r, c, sg[1].y AS y1, sg[1].x AS x1, sg[2].y AS y2, sg[2].x AS x2 FROM s"""


def _smoothing_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import feeds

    z = dem(spark, sf_dir, True)
    return feeds.error_stats(terrain.mean_filter(z, 3).join(z, ["r", "c"]).select(F.col("z").alias("expected"), F.col("mean_filter").alias("got")))
