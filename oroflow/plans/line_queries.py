"""Queries over lines and rings, with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lines
from .hydro_queries import FLOW, POURS, STREAM, _network, _watersheds, base
from .terrain_queries import AROUND, HOLES, dem

INTERVAL = 150.0


def _ring_walk(pieces: str, walk: str = "k, e, nxt") -> str:
    """SQL over pieces (k, e, nxt): walk(k, line, e, nxt, seq, closed) of all lines, rings from their least key."""
    return f"""op AS (SELECT p.k, p.e, p.nxt FROM {pieces} p WHERE NOT EXISTS (SELECT 1 FROM {pieces} q WHERE q.k = p.k AND q.nxt = p.e)),
ow AS (SELECT k, e AS line, e, nxt, CAST(0 AS BIGINT) AS seq FROM op UNION ALL SELECT ow.k, line, p.e, p.nxt, seq + 1 FROM ow JOIN {pieces} p ON p.k = ow.k AND p.e = ow.nxt),
rg AS (SELECT p.* FROM {pieces} p ANTI JOIN ow ON ow.k = p.k AND ow.e = p.e),
rl(k, e, m) USING KEY (k, e) AS (SELECT k, e, e FROM rg UNION SELECT rg.k, rg.nxt, min(rl.m) FROM rl JOIN rg ON rg.k = rl.k AND rg.e = rl.e JOIN recurring.rl AS o ON o.k = rg.k AND o.e = rg.nxt WHERE rl.m < o.m GROUP BY rg.k, rg.nxt),
rw AS (SELECT rg.k, rg.e AS line, rg.e, rg.nxt, CAST(0 AS BIGINT) AS seq FROM rg JOIN rl ON rl.k = rg.k AND rl.e = rg.e WHERE rl.m = rg.e
  UNION ALL SELECT rw.k, line, rg.e, rg.nxt, seq + 1 FROM rw JOIN rg ON rg.k = rw.k AND rg.e = rw.nxt WHERE rw.nxt <> line),
every AS (SELECT *, false AS closed FROM ow UNION ALL SELECT *, true FROM rw)"""


_EDGE = "CAST({r} AS BIGINT) * 8589934592 + CAST({c} AS BIGINT) * 2 + {k}"
_SIDES = (  # clockwise: from, to; the grid edge; the ends as the place is counted, along a row or a column
    ("t", "a", "b", _EDGE.format(r="r", c="c", k=0), "a", "b", "r", "c + p"), ("e", "b", "d", _EDGE.format(r="r", c="(c + 1)", k=1), "b", "d", "r + p", "c + 1"),
    ("o", "d", "g", _EDGE.format(r="(r + 1)", c="c", k=0), "g", "d", "r + 1", "c + p"), ("l", "g", "a", _EDGE.format(r="r", c="c", k=1), "a", "g", "r + p", "c"),
)
_CROSSED = " UNION ALL ".join(f"SELECT r, c, k, '{n}' AS side, {key} AS key, {q} >= lv AS up, {y} AS y, {x} AS x, saddle, turned FROM (SELECT *, (lv - {lo}) / ({hi} - {lo}) AS p FROM lev WHERE ({p} >= lv) <> ({q} >= lv))" for n, p, q, key, lo, hi, y, x in _SIDES)
CONTOURS = f"""{HOLES}, {AROUND}, sq AS (SELECT r, c, z AS a, e AS b, se AS d, s AS g FROM h WHERE z + e + se + s IS NOT NULL),
lev AS (SELECT *, k * {INTERVAL!r}::DOUBLE AS lv, (a >= k * {INTERVAL!r}) = (d >= k * {INTERVAL!r}) AND (b >= k * {INTERVAL!r}) = (g >= k * {INTERVAL!r}) AND (a >= k * {INTERVAL!r}) <> (b >= k * {INTERVAL!r}) AS saddle, (a >= k * {INTERVAL!r}) = ((a + b + d + g) / 4 >= k * {INTERVAL!r}) AS turned
  FROM (SELECT *, unnest(range(CAST(floor(least(a, b, d, g) / {INTERVAL!r}) AS BIGINT) + 1, CAST(floor(greatest(a, b, d, g) / {INTERVAL!r}) AS BIGINT) + 1)) AS k FROM sq)),
crossed AS ({_CROSSED}),
seg AS (SELECT i.k, i.key AS e, j.key AS nxt, round(i.y, 6) AS y1, round(i.x, 6) AS x1 FROM crossed i JOIN crossed j ON i.r = j.r AND i.c = j.c AND i.k = j.k AND i.up AND NOT j.up
  AND (NOT i.saddle OR CASE WHEN i.turned THEN (i.side IN ('t', 'e')) = (j.side IN ('t', 'e')) ELSE (i.side IN ('t', 'l')) = (j.side IN ('t', 'l')) END))"""

_AHEAD = {"n": (-1, 0), "ne": (-1, 1), "e": (0, 1), "se": (1, 1), "s": (1, 0), "sw": (1, -1), "w": (0, -1), "nw": (-1, -1)}
_KEY = "CAST({r} AS BIGINT) * 17179869184 + CAST({c} AS BIGINT) * 4 + {k}"
_WS = f"{POURS}, ws AS (SELECT sr AS r, sc AS c, arg_min(p, hop) AS p FROM walk JOIN pours USING (r, c) GROUP BY sr, sc)"
_AROUND8 = "w8 AS (SELECT ws.r, ws.c, ws.p, " + ", ".join(f"{n}.p IS NOT DISTINCT FROM ws.p AS {n}" for n in _AHEAD) + " FROM ws " + " ".join(f"LEFT JOIN ws {n} ON {n}.r = ws.r + {a} AND {n}.c = ws.c + {b}" for n, (a, b) in _AHEAD.items()) + ")"


def _turn(side: int, beyond: str, ahead: str, corner: str, y1: str, x1: str, y2: str, x2: str) -> str:
    (a, b), (p, q) = _AHEAD[ahead], _AHEAD[corner]
    nxt = f"CASE WHEN NOT {ahead} THEN {_KEY.format(r='r', c='c', k=(side + 1) % 4)} WHEN NOT {corner} THEN {_KEY.format(r=f'(r + {a})', c=f'(c + {b})', k=side)} ELSE {_KEY.format(r=f'(r + {p})', c=f'(c + {q})', k=(side + 3) % 4)} END"
    return f"SELECT p AS k, {_KEY.format(r='r', c='c', k=side)} AS e, {nxt} AS nxt, r + {y1}::DOUBLE AS y1, c + {x1}::DOUBLE AS x1, r + {y2}::DOUBLE AS y2, c + {x2}::DOUBLE AS x2 FROM w8 WHERE NOT {beyond}"


_LO, _HI = "-0.5", "0.5"
_BOUND = "sd AS (" + " UNION ALL ".join((_turn(0, "n", "e", "ne", _LO, _LO, _LO, _HI), _turn(1, "e", "s", "se", _LO, _HI, _HI, _HI), _turn(2, "s", "w", "sw", _HI, _HI, _HI, _LO), _turn(3, "w", "n", "nw", _HI, _LO, _LO, _LO))) + ")"


def _rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.area_rings(_watersheds(spark, sf_dir).select("r", "c", "p"))


def build() -> dict[str, tuple]:
    q: dict[str, tuple] = {}
    q["contour_lines"] = (
        lambda s, d: lines.contour_lines(dem(s, d, True), INTERVAL).select("level", "line", "seq", "y1", "x1", "n_pieces", "closed"),
        f"WITH RECURSIVE {CONTOURS}, {_ring_walk('seg')} SELECT every.k * {INTERVAL!r}::DOUBLE AS level, line, seq, y1, x1, count(*) OVER (PARTITION BY every.k, line) AS n_pieces, closed FROM every JOIN seg ON seg.k = every.k AND seg.e = every.e",
    )
    q["watershed_rings"] = (
        lambda s, d: lines.ring_summary(_rings(s, d)),
        f"WITH RECURSIVE {FLOW}, {_WS}, {_AROUND8}, {_BOUND}, {_ring_walk('sd')} SELECT every.k AS p, line, count(*) AS n_pieces, round(sum(x1 * y2 - x2 * y1) / 2, 3) AS area, min(y1) AS min_y, max(y1) AS max_y, min(x1) AS min_x, max(x1) AS max_x FROM every JOIN sd ON sd.k = every.k AND sd.e = every.e GROUP BY every.k, line",
    )
    q["stream_lines"] = (
        lambda s, d: lines.stream_lines(_network(s, d)),
        f"""WITH RECURSIVE {STREAM}, lh AS (SELECT r AS sr, c AS sc, r, c, pr, pc, CAST(0 AS BIGINT) AS hop FROM cut UNION ALL SELECT sr, sc, cut.r, cut.c, cut.pr, cut.pc, hop + 1 FROM lh JOIN cut ON cut.r = lh.pr AND cut.c = lh.pc),
inn AS (SELECT r AS link_r, c AS link_c, sr AS r, sc AS c, max(hop) OVER (PARTITION BY r, c) AS most, hop FROM lh WHERE pr IS NULL),
ends AS (SELECT DISTINCT link_r, link_c, most FROM inn)
SELECT link_r, link_c, most - hop AS seq, r, c, most + 1 AS n_cells FROM inn
UNION ALL SELECT link_r, link_c, most + 1, net.pr, net.pc, most + 1 FROM ends JOIN net ON net.r = link_r AND net.c = link_c WHERE net.pr IS NOT NULL""",
    )
    q["main_stems"] = (
        lambda s, d: lines.main_stems(*base(s, d)),
        f"""WITH RECURSIVE {FLOW}, hv AS (SELECT r, c, pr, pc FROM (SELECT flow.r, flow.c, pr, pc, row_number() OVER (PARTITION BY pr, pc ORDER BY accumulation DESC, flow.r, flow.c) AS k FROM flow JOIN acc USING (r, c) WHERE pr IS NOT NULL) WHERE k = 1),
stem AS (SELECT r AS outlet_r, c AS outlet_c, CAST(0 AS BIGINT) AS step, r, c FROM flow WHERE pr IS NULL UNION ALL SELECT outlet_r, outlet_c, step + 1, hv.r, hv.c FROM stem JOIN hv ON hv.pr = stem.r AND hv.pc = stem.c) SELECT * FROM stem""",
    )
    return q
