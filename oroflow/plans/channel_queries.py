"""Queries over channels and carved terrain, with their SQL oracles; sections and burnt terrain have none (too slow as
SQL on whole tables), nor has breached terrain: tests hold them against small fixtures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import channels, grid, hydro
from .hydro_queries import FILL, STREAM, THRESHOLD, _network, _starts, base
from .terrain_queries import AROUND, DEM, dem

CELL = hydro.CELL
_COMP = f"""{STREAM}, sid AS (SELECT st.r, st.c, z, CAST(st.r AS BIGINT) * 4294967296 + st.c AS id FROM st JOIN dem USING (r, c)),
snb AS (SELECT a.id, b.id AS bid FROM sid a JOIN sid b ON (b.r = a.r AND b.c IN (a.c - 1, a.c + 1)) OR (b.c = a.c AND b.r IN (a.r - 1, a.r + 1))),
scc(id, comp) USING KEY (id) AS (SELECT id, id FROM sid UNION SELECT snb.bid, min(scc.comp) FROM scc JOIN snb ON snb.id = scc.id JOIN recurring.scc AS o ON o.id = snb.bid WHERE scc.comp < o.comp GROUP BY snb.bid),
sc AS (SELECT id, r, c, z, comp, min(z) OVER (PARTITION BY comp) AS low FROM sid JOIN scc USING (id))"""
OUTLETS = ((40, 3), (250, 31), (460, 50))


def _streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return channels.stream_cells(dem(spark, sf_dir), base(spark, sf_dir)[1], THRESHOLD)


def _link_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stretch between junctions: where it ends, its cells, its Strahler order."""
    network = _network(spark, sf_dir)
    links = hydro.stream_links(network).select(*[v.alias(k) for k, v in hydro.place().items()], *[v.alias(f"link_{k}") for k, v in hydro.place("link").items()])
    return links.join(hydro.stream_order(network), ["r", "c"]).groupBy("link_r", "link_c").agg(F.count(F.lit(1)).alias("n_cells"), F.max("stream_order").alias("link_class"))


def build() -> dict[str, tuple]:
    q: dict[str, tuple] = {}
    q["cross_section"] = (
        lambda s, d: channels.cross_sections(dem(s, d), base(s, d)[0], _starts(s), 8),
        None,
    )
    q["stream_gradients"] = (lambda s, d: channels.stream_gradients(_network(s, d), dem(s, d)), f"WITH RECURSIVE {STREAM} SELECT net.r, net.c, round(abs(f.z - o.z) / (f.len * {CELL!r}), 6) AS gradient FROM net JOIN flow f USING (r, c) LEFT JOIN dem o ON o.r = net.pr AND o.c = net.pc")
    q["average_distributary_slope"] = (lambda s, d: channels.distributary_slope(_streams(s, d)), f"WITH RECURSIVE {_COMP} SELECT CAST(comp // 4294967296 AS INT) AS stream_r, CAST(comp % 4294967296 AS INT) AS stream_c, count(*) AS n_cells, round((arg_min(z, id) - arg_max(z, id)) / (count(*) * {CELL!r}), 6) AS slope FROM sc GROUP BY comp")
    q["breach_bridges"] = (
        lambda s, d: channels.breach_bridges(dem(s, d), _streams(s, d), 3),
        f"WITH RECURSIVE {_COMP}, wd AS (SELECT r, c, z, low, count(*) OVER (PARTITION BY r ORDER BY c RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS n FROM sc) SELECT dem.r, dem.c, CASE WHEN wd.z > low + 1 AND n <= 3 THEN low ELSE dem.z END AS z FROM dem LEFT JOIN wd ON wd.r = dem.r AND wd.c = dem.c",
    )
    q["fill_burn"] = (lambda s, d: channels.fill_burn(dem(s, d), _streams(s, d)), None)
    outlets = lambda s: s.createDataFrame(list(OUTLETS), "r int, c int")
    q["breach_least_cost_path"] = (
        lambda s, d: channels.breach_to_outlets(dem(s, d), outlets(s), 900.0),
        f"WITH {DEM}, o(r, c) AS (VALUES {', '.join(map(str, OUTLETS))}), lo AS (SELECT min(z) AS low FROM dem JOIN o USING (r, c)), ds AS (SELECT dem.r, dem.c, dem.z, min(sqrt(power(dem.r - o.r, 2) + power(dem.c - o.c, 2))) AS away FROM dem, o GROUP BY 1, 2, 3) SELECT r, c, CASE WHEN away > 0 AND z > low AND away + (z - low) * 10 <= 900 THEN low ELSE z END AS z FROM ds, lo",
    )
    ways = ", ".join(f"f{k}.z" for k in range(8))
    lower = " ".join(f"LEFT JOIN f f{k} ON f{k}.r = f.r + {dr} AND f{k}.c = f.c + {dc}" for k, (dr, dc) in enumerate(grid.D8_STEPS))
    q["clean_dem"] = (lambda s, d: channels.clean(dem(s, d)), f"WITH RECURSIVE {DEM}, {AROUND}, {FILL} SELECT f.r, f.c, CASE WHEN least({ways}) < f.z THEN f.z ELSE least(h.n, h.s, h.w, h.e) END AS z FROM f JOIN h ON h.r = f.r AND h.c = f.c {lower}")
    q["breach_depressions"] = (lambda s, d: channels.breach_depressions(dem(s, d)), None)
    q["stream_link_class"] = (_link_class, None)
    q["depth_to_water"] = (
        lambda s, d: hydro.height_above_stream(dem(s, d), *base(s, d), THRESHOLD).filter("above_stream is not null").select("r", "c", F.greatest("above_stream", F.lit(0.0)).alias("depth_to_water")),
        f"WITH RECURSIVE {STREAM}, hit AS (SELECT sr, sc, arg_min(dem.z, hop) AS zs FROM walk JOIN st USING (r, c) JOIN dem USING (r, c) GROUP BY sr, sc) SELECT dem.r, dem.c, greatest(dem.z - zs, 0.0) AS depth_to_water FROM dem JOIN hit ON sr = dem.r AND sc = dem.c",
    )
    return q
