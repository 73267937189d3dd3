"""Queries over drainage, with their SQL oracles. Flow is that of the terrain as it is; filling has queries of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, hydro, terrain
from .scratch import written
from .terrain_queries import AROUND, DEM, HOLES, _around, dem

CELL = hydro.CELL


def _directed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hydro.d8(dem(spark, sf_dir))


def base(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Directed cells and accumulation, written down, as several parts of a query read them."""
    directed = written(_directed(spark, sf_dir), "d8")
    return directed, written(hydro.flow_accumulation(directed), "accumulation")


_CODES = (("e", 0, 1), ("se", 1, 1), ("s", 1, 0), ("sw", 1, -1), ("w", 0, -1), ("nw", -1, -1), ("n", -1, 0), ("ne", -1, 1))
_WAYS = " UNION ALL ".join(f"SELECT r, c, z, {k} AS k, (z - {x}) / {1.0 if k % 2 == 0 else 'sqrt(2)'} AS sl, r + {dr} AS pr, c + {dc} AS pc, {1.0 if k % 2 == 0 else 'sqrt(2)'} AS len FROM h WHERE {x} < z" for k, (x, dr, dc) in enumerate(_CODES))
FLOW = f"""{DEM}, {AROUND}, ways AS ({_WAYS}), best AS (SELECT r, c, arg_max(k, sl - k * 1e-12) AS k FROM ways GROUP BY r, c),
flow AS (SELECT dem.r, dem.c, dem.z, coalesce(best.k, -1) AS d8, w.pr, w.pc, w.len FROM dem LEFT JOIN best USING (r, c) LEFT JOIN ways w ON w.r = dem.r AND w.c = dem.c AND w.k = best.k),
walk AS (SELECT r AS sr, c AS sc, r, c, 0 AS hop, CAST(0 AS DOUBLE) AS d, pr, pc, len FROM flow
  UNION ALL SELECT sr, sc, f.r, f.c, hop + 1, d + walk.len, f.pr, f.pc, f.len FROM walk JOIN flow f ON f.r = walk.pr AND f.c = walk.pc),
acc AS (SELECT r, c, count(*) AS accumulation, max(d) AS up FROM walk GROUP BY r, c),
fin AS (SELECT sr AS r, sc AS c, r AS root_r, c AS root_c, d AS down FROM walk WHERE pr IS NULL)"""
THRESHOLD = 20
STREAM = f"""{FLOW}, st AS (SELECT r, c FROM acc WHERE accumulation >= {THRESHOLD}),
net AS (SELECT f.r, f.c, CASE WHEN t.r IS NOT NULL THEN f.pr END AS pr, CASE WHEN t.r IS NOT NULL THEN f.pc END AS pc FROM flow f JOIN st USING (r, c) LEFT JOIN st t ON t.r = f.pr AND t.c = f.pc),
nin AS (SELECT pr AS r, pc AS c, count(*) AS n_in FROM net WHERE pr IS NOT NULL GROUP BY 1, 2),
cut AS (SELECT net.r, net.c, CASE WHEN coalesce(n_in, 0) <= 1 THEN net.pr END AS pr, CASE WHEN coalesce(n_in, 0) <= 1 THEN net.pc END AS pc FROM net LEFT JOIN nin ON nin.r = net.pr AND nin.c = net.pc),
lw AS (SELECT r AS sr, c AS sc, r, c, pr, pc FROM cut UNION ALL SELECT sr, sc, cut.r, cut.c, cut.pr, cut.pc FROM lw JOIN cut ON cut.r = lw.pr AND cut.c = lw.pc),
lnk AS (SELECT sr AS r, sc AS c, r AS link_r, c AS link_c FROM lw WHERE pr IS NULL)"""
#: Terrain dem filled by relaxation: f(r, c, z).
FILL = """ext AS (SELECT (SELECT max(r) FROM dem) AS rm, (SELECT max(c) FROM dem) AS cm), nb AS (SELECT a.r, a.c, b.r AS br, b.c AS bc, b.z AS bz FROM dem a CROSS JOIN (SELECT x AS dr, y AS dc FROM range(-1, 2) t(x), range(-1, 2) u(y) WHERE x <> 0 OR y <> 0) JOIN dem b ON b.r = a.r + dr AND b.c = a.c + dc),
f(r, c, z) USING KEY (r, c) AS (SELECT r, c, z FROM dem, ext WHERE r = 0 OR c = 0 OR r = rm OR c = cm
  UNION SELECT nb.br, nb.bc, min(greatest(f.z, nb.bz)) FROM f JOIN nb ON nb.r = f.r AND nb.c = f.c LEFT JOIN recurring.f AS o ON o.r = nb.br AND o.c = nb.bc WHERE o.z IS NULL OR greatest(f.z, nb.bz) < o.z GROUP BY nb.br, nb.bc)"""
_ID = "CAST({r} AS BIGINT) * 4294967296 + {c}"


def _starts(spark: SparkSession) -> DataFrame:
    return spark.range(0, 25).select(F.col("id").alias("p"), (F.col("id") * 17 + 5).cast("int").alias("r"), (F.col("id") * 7 % 64).cast("int").alias("c"))


STARTS = "starts AS (SELECT i AS p, CAST(i * 17 + 5 AS INT) AS r, CAST(i * 7 % 64 AS INT) AS c FROM range(0, 25) t(i))"


def _pours(accumulated: DataFrame) -> DataFrame:
    """Each row's cell of the largest accumulation, the first of equal ones."""
    top = accumulated.groupBy("r").agg(F.max(F.struct("accumulation", (-F.col("c")).alias("c"))).alias("x"))
    return top.select(F.col("r").cast("long").alias("p"), "r", (-F.col("x.c")).cast("int").alias("c"))


POURS = "pours AS (SELECT CAST(r AS BIGINT) AS p, r, arg_max(c, accumulation * 1000 - c) AS c FROM acc GROUP BY r)"


def _watersheds(spark: SparkSession, sf_dir: str) -> DataFrame:
    directed, accumulated = base(spark, sf_dir)
    return hydro.watershed(directed, _pours(accumulated))


def build() -> dict[str, tuple]:
    q: dict[str, tuple] = {}
    q["d8_flow_direction"] = (lambda s, d: _directed(s, d).select("r", "c", "d8"), f"WITH RECURSIVE {FLOW} SELECT r, c, d8 FROM flow")
    q["flow_accumulation"] = (lambda s, d: base(s, d)[1], f"WITH RECURSIVE {FLOW} SELECT r, c, accumulation FROM acc")
    q["flow_length"] = (lambda s, d: hydro.flow_length(_directed(s, d)), f"WITH RECURSIVE {FLOW} SELECT r, c, round(down * {CELL!r}, 4) AS downslope, round(up * {CELL!r}, 4) AS upslope, root_r, root_c FROM fin JOIN acc USING (r, c)")
    q["flow_width"] = (lambda s, d: _directed(s, d).select("r", "c", F.expr(f"round(CASE WHEN d8 < 0 THEN NULL WHEN d8 % 2 = 1 THEN {CELL!r} * sqrt(2) ELSE {CELL!r} END, 6)").alias("flow_width")), f"WITH RECURSIVE {FLOW} SELECT r, c, round(CASE WHEN d8 < 0 THEN NULL WHEN d8 % 2 = 1 THEN {CELL!r} * sqrt(2) ELSE {CELL!r} END, 6) AS flow_width FROM flow")
    q["extract_streams"] = (lambda s, d: hydro.streams(base(s, d)[1], THRESHOLD), f"WITH RECURSIVE {FLOW} SELECT r, c, CASE WHEN accumulation >= {THRESHOLD} THEN 1 ELSE 0 END AS stream FROM acc")
    q["stream_links"] = (lambda s, d: _links(s, d).select("r", "c", "link_r", "link_c"), f"WITH RECURSIVE {STREAM} SELECT r, c, link_r, link_c FROM lnk")
    q["stream_order"] = (lambda s, d: hydro.stream_order(_network(s, d)), None)
    q["sub_basins"] = (lambda s, d: hydro.sub_basins(_directed(s, d), hydro.stream_links(_network(s, d))), f"WITH RECURSIVE {STREAM}, hit AS (SELECT sr AS r, sc AS c, arg_min(link_r, hop) AS link_r, arg_min(link_c, hop) AS link_c FROM walk JOIN lnk USING (r, c) GROUP BY sr, sc) SELECT r, c, link_r, link_c FROM hit")
    q["basins"] = (lambda s, d: hydro.basins(_directed(s, d)), f"WITH RECURSIVE {FLOW} SELECT r, c, root_r AS outlet_r, root_c AS outlet_c FROM fin")
    q["watershed"] = (lambda s, d: _watersheds(s, d), f"WITH RECURSIVE {FLOW}, {POURS} SELECT sr AS r, sc AS c, arg_min(p, hop) AS p FROM walk JOIN pours USING (r, c) GROUP BY sr, sc")
    q["watershed_summary"] = (
        lambda s, d: hydro.watershed_summary(_watersheds(s, d), dem(s, d)),
        f"WITH RECURSIVE {FLOW}, {POURS}, ws AS (SELECT sr AS r, sc AS c, arg_min(p, hop) AS p FROM walk JOIN pours USING (r, c) GROUP BY sr, sc), bd AS (SELECT a.r, a.c, a.p, CASE WHEN count(b.p) < 4 THEN 1 ELSE 0 END AS edge FROM ws a LEFT JOIN ws b ON b.p = a.p AND abs(a.r - b.r) + abs(a.c - b.c) = 1 AND b.r BETWEEN a.r - 1 AND a.r + 1 GROUP BY a.r, a.c, a.p) SELECT p, count(*) AS n_cells, round(count(*) * {CELL!r} * {CELL!r} / 1e6, 4) AS area_km2, min(z) AS min_z, max(z) AS max_z, round(avg(z), 4) AS mean_z, CAST(sum(edge) AS BIGINT) AS boundary_cells FROM bd JOIN dem USING (r, c) GROUP BY p",
    )
    q["height_above_stream"] = (lambda s, d: hydro.height_above_stream(dem(s, d), *base(s, d), THRESHOLD), f"WITH RECURSIVE {FLOW}, st AS (SELECT r, c FROM acc WHERE accumulation >= {THRESHOLD}), hit AS (SELECT sr, sc, arg_min(dem.z, hop) AS zs FROM walk JOIN st USING (r, c) JOIN dem USING (r, c) GROUP BY sr, sc) SELECT dem.r, dem.c, dem.z - zs AS above_stream FROM dem LEFT JOIN hit ON sr = dem.r AND sc = dem.c")
    q["snap_pour_point"] = (lambda s, d: hydro.snap_pour_points(_starts(s), base(s, d)[1], 4), f"WITH RECURSIVE {FLOW}, {STARTS}, top AS (SELECT max(accumulation) AS top FROM acc), sc AS (SELECT p, acc.r, acc.c, round(accumulation / top / (abs(acc.r - starts.r) + abs(acc.c - starts.c) + 1.0), 9) AS score FROM starts JOIN acc ON abs(acc.r - starts.r) <= 4 AND abs(acc.c - starts.c) <= 4, top) SELECT p, r, c, score FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY score DESC, r, c) AS k FROM sc) WHERE k = 1")
    q["trace_downstream"] = (lambda s, d: hydro.trace(_directed(s, d), dem(s, d), _starts(s)), f"WITH RECURSIVE {FLOW}, {STARTS} SELECT p, CAST(hop AS BIGINT) AS step, walk.r, walk.c, z, round(d * {CELL!r}, 4) AS distance_m FROM walk JOIN starts ON sr = starts.r AND sc = starts.c JOIN dem ON dem.r = walk.r AND dem.c = walk.c")
    q["hillslope_profile"] = (lambda s, d: hydro.trace(_directed(s, d), dem(s, d), _starts(s)).groupBy("p").agg(F.max("step").alias("steps"), F.max("distance_m").alias("length_m"), F.round(F.max("z") - F.min("z"), 4).alias("drop_m")), f"WITH RECURSIVE {FLOW}, {STARTS} SELECT p, CAST(max(hop) AS BIGINT) AS steps, max(round(d * {CELL!r}, 4)) AS length_m, round(max(z) - min(z), 4) AS drop_m FROM walk JOIN starts ON sr = starts.r AND sc = starts.c JOIN dem ON dem.r = walk.r AND dem.c = walk.c GROUP BY p")
    q["average_flow_truncation"] = (lambda s, d: hydro.flow_truncation(_directed(s, d), 60.0), f"WITH RECURSIVE {FLOW} SELECT round(avg(CASE WHEN (flow.z - o.z) / (flow.len * {CELL!r}) > tan(radians(60)) THEN 1.0 ELSE 0.0 END), 6) AS truncation FROM flow JOIN dem o ON o.r = flow.pr AND o.c = flow.pc")
    slope = f"sl AS (SELECT r, c, round(CAST({terrain.formula('slope')} AS DOUBLE), 9) AS slope FROM h), ix AS (SELECT r, c, slope, CAST(accumulation AS DOUBLE) AS a FROM sl JOIN acc USING (r, c))"
    for name in hydro.INDICES:
        q[name] = (lambda s, d, x=name: hydro.index(dem(s, d), base(s, d)[1], x), f"WITH RECURSIVE {FLOW}, {slope} SELECT r, c, round({hydro.INDICES[name]}, 4) AS {name} FROM ix")
    q["hack_integral"] = (lambda s, d: hydro.hack(*base(s, d), THRESHOLD), f"WITH RECURSIVE {FLOW}, xy AS (SELECT ln(accumulation) AS x, ln(down * {CELL!r} + 1) AS y FROM acc JOIN fin USING (r, c) WHERE accumulation > {THRESHOLD}) SELECT round(regr_slope(y, x), 4) AS hack_exponent, round(exp(regr_intercept(y, x)), 2) AS k_coefficient, count(*) AS n_cells FROM xy")
    q["flow_accumulation_max"] = (lambda s, d: graph.accumulate(hydro.flow_edges(_directed(s, d)).join(base(s, d)[1].select(hydro.cell_id().alias("id"), F.col("accumulation").cast("double").alias("w")), "id"), combine="max").select(*[v.alias(k) for k, v in hydro.place().items()], F.col("acc").cast("long").alias("top")), f"WITH RECURSIVE {FLOW} SELECT w.r, w.c, max(acc.accumulation) AS top FROM walk w JOIN acc ON acc.r = w.sr AND acc.c = w.sc GROUP BY w.r, w.c")
    q["drainage_density"] = (lambda s, d: hydro.drainage_density(base(s, d)[1]), f"WITH RECURSIVE {FLOW}, fl AS (SELECT r, c, CASE WHEN accumulation >= (SELECT sqrt(count(*)) FROM acc) THEN 1.0 ELSE 0.0 END AS z FROM acc), {_around(11).replace('dem', 'fl')} SELECT r, c, round(CAST(sum(v) AS DOUBLE) / 121 / {CELL * CELL / 1e6!r}, 4) AS drainage_density FROM win GROUP BY r, c")
    fill = f"{DEM}, {FILL}"
    q["fill_depressions"] = (lambda s, d: _filled(s, d), f"WITH RECURSIVE {fill} SELECT r, c, z FROM f")
    q["depth_in_sink"] = (lambda s, d: dem(s, d).join(_filled(s, d).withColumnRenamed("z", "filled"), ["r", "c"]).select("r", "c", F.round(F.col("filled") - F.col("z"), 6).alias("depth")), f"WITH RECURSIVE {fill} SELECT r, c, round(f.z - dem.z, 6) AS depth FROM f JOIN dem USING (r, c)")
    q["inundation_depth"] = (lambda s, d: _filled(s, d).select("r", "c", (F.col("z") < 520).cast("int").alias("flooded"), F.greatest(F.lit(520.0) - F.col("z"), F.lit(0.0)).alias("depth")), f"WITH RECURSIVE {fill} SELECT r, c, CASE WHEN z < 520 THEN 1 ELSE 0 END AS flooded, greatest(520.0 - z, 0.0) AS depth FROM f")
    q["depression_depth_stats"] = (lambda s, d: hydro.depression_stats(dem(s, d)), None)
    q["clump"] = (lambda s, d: hydro.clump(dem(s, d, True)).groupBy("comp").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("k")).select(*[v.alias(f"label_{x}") for x, v in hydro.place("comp").items()], "n", "k"), _clump_sql())
    q["sieve"] = (lambda s, d: hydro.sieve(dem(s, d, True)), None)
    outlets = lambda s: s.createDataFrame([(0, 0), (250, 31), (499, 63)], "r int, c int")
    q["cost_distance"] = (lambda s, d: hydro.cost_distance(dem(s, d), outlets(s)), _cost_sql())
    q["cross_section_area"] = (lambda s, d: hydro.cross_section_area(dem(s, d).select(F.col("r").alias("line"), F.col("c").alias("i"), (F.col("c") * CELL).alias("x"), "z")), f"WITH {DEM}, g AS (SELECT r AS line, abs(z - lag(z) OVER o) * abs(c * {CELL!r} - lag(c * {CELL!r}) OVER o) AS part FROM dem WINDOW o AS (PARTITION BY r ORDER BY c)) SELECT line, round(sum(part), 4) AS area FROM g GROUP BY line")
    return q


def _cost_sql() -> str:
    return f"""WITH RECURSIVE {DEM}, nb AS (SELECT a.r, a.c, b.r AS br, b.c AS bc, abs(a.z - b.z) * sqrt(CAST(dr * dr + dc * dc AS DOUBLE)) AS w FROM dem a CROSS JOIN (SELECT x AS dr, y AS dc FROM range(-1, 2) t(x), range(-1, 2) u(y) WHERE x <> 0 OR y <> 0) JOIN dem b ON b.r = a.r + dr AND b.c = a.c + dc),
f(r, c, d) USING KEY (r, c) AS (SELECT r, c, CAST(0 AS DOUBLE) FROM dem WHERE (r = 0 AND c = 0) OR (r = 250 AND c = 31) OR (r = 499 AND c = 63)
  UNION SELECT nb.br, nb.bc, min(f.d + nb.w) FROM f JOIN nb ON nb.r = f.r AND nb.c = f.c LEFT JOIN recurring.f AS o ON o.r = nb.br AND o.c = nb.bc WHERE o.d IS NULL OR f.d + nb.w < o.d - 1e-9 GROUP BY nb.br, nb.bc)
SELECT r, c, round(d, 4) AS cost FROM f"""


def _clump_sql() -> str:
    return f"""WITH RECURSIVE {HOLES}, k AS (SELECT r, c, CAST(floor(z / 100) AS BIGINT) AS k, CAST(r AS BIGINT) * 4294967296 + c AS id FROM dem WHERE z IS NOT NULL),
nb AS (SELECT a.id, b.id AS bid FROM k a JOIN k b ON b.k = a.k AND ((b.r = a.r AND b.c IN (a.c - 1, a.c + 1)) OR (b.c = a.c AND b.r IN (a.r - 1, a.r + 1))) WHERE b.r BETWEEN a.r - 1 AND a.r + 1),
f(id, comp) USING KEY (id) AS (SELECT id, id FROM k UNION SELECT nb.bid, min(f.comp) FROM f JOIN nb ON nb.id = f.id JOIN recurring.f AS o ON o.id = nb.bid WHERE f.comp < o.comp GROUP BY nb.bid)
SELECT CAST(comp // 4294967296 AS INT) AS label_r, CAST(comp % 4294967296 AS INT) AS label_c, count(*) AS n, min(k.k) AS k FROM f JOIN k USING (id) GROUP BY comp"""


def _filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hydro.fill_depressions(dem(spark, sf_dir))


def _network(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hydro.stream_network(*base(spark, sf_dir), THRESHOLD)


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    on = hydro.stream_links(_network(spark, sf_dir))
    return on.select(*[v.alias(k) for k, v in hydro.place().items()], *[v.alias(f"link_{k}") for k, v in hydro.place("link").items()])
