"""Scalar functions on coordinates and readings, as SQL text over named columns. Text fits Spark SQL as it stands, so
callers use F.expr and several of them fall into one projection."""

from __future__ import annotations

import math

EARTH_M = 6371000.0
EARTH_NM = 3440.065


def haversine(lat1: str, lon1: str, lat2: str, lon2: str, radius: float = EARTH_M) -> str:
    a = f"(power(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * power(sin(radians({lon2} - {lon1}) / 2), 2))"
    return f"(2 * {radius!r}e0 * atan2(sqrt({a}), sqrt(greatest(1 - {a}, 0e0))))"


def bearing(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    y = f"sin(radians({lon2} - {lon1})) * cos(radians({lat2}))"
    x = f"(cos(radians({lat1})) * sin(radians({lat2})) - sin(radians({lat1})) * cos(radians({lat2})) * cos(radians({lon2} - {lon1})))"
    return f"(((degrees(atan2({y}, {x})) + 360) % 360))"


def tile_x(lon: str, zoom: int) -> str:
    return f"CAST(floor(({lon} + 180e0) / 360e0 * {1 << zoom}) AS INT)"


def tile_y(lat: str, zoom: int) -> str:
    return f"CAST(floor((1e0 - ln(tan(radians({lat})) + 1e0 / cos(radians({lat}))) / {math.pi!r}e0) / 2e0 * {1 << zoom}) AS INT)"


def tile_lat(y: str, zoom: int) -> str:
    """Latitude of a tile row's northern edge."""
    k = f"({math.pi!r}e0 * (1 - 2e0 * {y} / {1 << zoom}))"
    return f"degrees(atan((exp({k}) - exp(-{k})) / 2))"


def tile_lon(x: str, zoom: int) -> str:
    return f"({x} / {float(1 << zoom)}e0 * 360e0 - 180e0)"


def degree_tile(lat: str, lon: str) -> str:
    """Name of the 1-degree tile by floor: N45E006."""
    part = lambda v, pos, neg, width: f"CASE WHEN floor({v}) >= 0 THEN '{pos}' ELSE '{neg}' END || lpad(CAST(CAST(abs(floor({v})) AS INT) AS VARCHAR(4)), {width}, '0')"
    return f"({part(lat, 'N', 'S', 2)} || {part(lon, 'E', 'W', 3)})"


def degree_bounds(name: str, compat: bool = False) -> dict[str, str]:
    """Box of a 1-degree tile by its name: south, west, north, east. The inverse of degree_tile; with compat the published
    boxes, which lie one degree further south and west for S and W."""
    side = lambda at, width, neg: f"CASE WHEN substr({name}, {at}, 1) = '{neg}' THEN -CAST(substr({name}, {at + 1}, {width}) AS INT){' - 1' if compat else ''} ELSE CAST(substr({name}, {at + 1}, {width}) AS INT) END"
    south, west = side(1, 2, "S"), side(4, 3, "W")
    return {"south": south, "west": west, "north": f"{south} + 1", "east": f"{west} + 1"}


def quadrant(lat: str, lon: str) -> str:
    """90-degree quadrant of the ocean grid: its north and west edges."""
    return f"concat('n', CAST(CAST(CASE WHEN {lat} >= 0 THEN 90 ELSE 0 END AS INT) AS VARCHAR(4)), '_w', CAST(CAST(least(floor(({lon} + 180) / 90), 3) * 90 - 180 AS INT) AS VARCHAR(5)))"


def wrap_lon(lon: str) -> str:
    return f"(((({lon} % 360) + 540) % 360) - 180)"


def utm_zone(lon: str) -> str:
    return f"CAST(least(floor(({lon} + 180) / 6), 59) + 1 AS INT)"


def dms(v: str, pos: str, neg: str) -> str:
    """Degrees, minutes and whole seconds with a letter: 45°30'15"N."""
    s = f"CAST(round(abs({v}) * 3600) AS BIGINT)"
    num = lambda x: f"CAST({x} AS VARCHAR(8))"
    return f"concat({num(f'CAST(floor({s} / 3600) AS BIGINT)')}, '°', lpad({num(f'CAST(floor(({s} % 3600) / 60) AS BIGINT)')}, 2, '0'), '''', lpad({num(f'{s} % 60')}, 2, '0'), '\"', CASE WHEN {v} >= 0 THEN '{pos}' ELSE '{neg}' END)"


def compass(deg: str) -> str:
    """16-point name of a direction."""
    names = "N NNE NE ENE E ESE SE SSE S SSW SW WSW W WNW NW NNW".split()
    k = f"(CAST(floor({deg} / 22.5e0 + 0.5e0) AS INT) % 16)"
    return "CASE " + " ".join(f"WHEN {k} = {i} THEN '{x}'" for i, x in enumerate(names)) + " END"


def ladder(v: str, steps: tuple[tuple[float, str], ...], last: str, below: str = "<") -> str:
    """The name of the first step that v is below (or, with <=, not above); last for the rest. Null stays null."""
    return f"CASE WHEN {v} IS NULL THEN NULL " + " ".join(f"WHEN {v} {below} {x} THEN '{name}'" for x, name in steps) + f" ELSE '{last}' END"


#: Published class limits.
STORM = ((34, "depression"), (64, "storm"), (83, "1"), (96, "2"), (113, "3"), (137, "4"))
AIR = ((50, "good"), (100, "moderate"), (150, "sensitive"), (200, "unhealthy"), (300, "very_unhealthy"))
QUAKE = ((3, "minor"), (5, "light"), (7, "strong"))
QUAKE_DEPTH = ((10, "shallow"), (70, "intermediate"))


def storm_class(knots: str) -> str:
    return ladder(knots, STORM, "5")


def air_class(index: str) -> str:
    return ladder(index, AIR, "hazardous", "<=")


def quake_class(magnitude: str) -> str:
    return ladder(magnitude, QUAKE, "major")


def quake_depth_class(km: str) -> str:
    return ladder(km, QUAKE_DEPTH, "deep")


def solar_declination(day: str) -> str:
    """Degrees, by the day of the year."""
    return f"(-23.45e0 * cos(radians(360e0 / 365 * ({day} + 10))))"


def orbit_class(km: str) -> str:
    return ladder(km, ((2000, "LEO"), (35000, "MEO")), "GEO")


#: Upper ends of the viewing zones in metres.
VIEW_ZONES = ((500_000, "earth"), (5_000_000, "low-orbit"), (50_000_000, "high-orbit"))


def view_zone(metres: str) -> str:
    """Zone of an altitude; below the ground and from 50,000 km on it is deep space."""
    return f"CASE WHEN {metres} < 0 THEN 'deep-space' ELSE {ladder(metres, VIEW_ZONES, 'deep-space')} END"


def terminator_lat(declination: str, lon: str) -> str:
    """Latitude at which the border of day and night crosses a meridian, the sun standing over longitude 0. At an equinox the
    border runs over the poles, by the side of the sun's meridian."""
    tangent = f"tan(radians({declination}))"
    return f"CASE WHEN abs({declination}) >= 89.5e0 THEN 0e0 WHEN {declination} = 0 THEN -90e0 * sign(round(cos(radians({lon})), 12)) ELSE degrees(atan(-cos(radians({lon})) / {tangent})) END"


def cell_id(lat: str, lon: str, level: int, prefix: str = "cell") -> str:
    """Name of the cell of 1 / 2**level degrees around a place; halves go up."""
    num = lambda v: f"CAST(CAST(floor({v} * {1 << level} + 0.5e0) AS BIGINT) AS VARCHAR(12))"
    return f"concat('{prefix}-{level}-', {num(lat)}, '-', {num(lon)})"


def hexagon_corner(lat: str, lon: str, k: str, edge_m: float) -> dict[str, str]:
    """Corner k (0 to 5, 6 closes) of a hexagon around a place, the first 30 degrees before north."""
    turn = f"({math.pi / 3!r}e0 * ({k} % 6) - {math.pi / 6!r}e0)"
    reach = f"{math.degrees(edge_m / EARTH_M)!r}e0"
    return {"corner_lat": f"{lat} + {reach} * cos{turn}", "corner_lon": f"{lon} + {reach} / cos(radians({lat})) * sin{turn}"}


def sphere_offsets(lat: str, angle: str, radius: float) -> dict[str, str]:
    """Steps in degrees from a place to the one at a distance (radians) and angle (degrees, from north)."""
    d, place, turn = f"{radius!r}e0", f"radians({lat})", f"radians({angle})"
    to = f"asin(sin({place}) * cos({d}) + cos({place}) * sin({d}) * cos({turn}))"
    return {"d_lat": f"degrees({to}) - {lat}", "d_lon": f"degrees(atan2(sin({turn}) * sin({d}) * cos({place}), cos({d}) - sin({place}) * sin({to})))"}


def units(v: str, unit: str) -> str:
    """Metres in another unit."""
    return f"({v} * {dict(m=1.0, ft=3.28084, km=0.001, mi=0.000621371)[unit]!r}e0)"


# The ellipsoid WGS 84, the scale on the central meridian, the letters of latitude bands and squares.
_A, _F, _K0 = 6378137.0, 1 / 298.257223563, 0.9996
BANDS = "CDEFGHJKLMNPQRSTUVWXX"
COLUMN_LETTERS = ("ABCDEFGH", "JKLMNPQR", "STUVWXYZ")
ROW_LETTERS = "ABCDEFGHJKLMNPQRSTUV"


def utm_steps(lat: str, lon: str) -> list[dict[str, str]]:
    """Transverse Mercator by the Krueger series to the third order of n, in steps: each dict's columns use those before.
    The last ones are zone, easting and northing (false northing in the south), good to a millimetre in a zone; null
    beyond 80 S and 84 N."""
    n = _F / (2 - _F)
    mean = _A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * math.sqrt(n) / (1 + n)
    wave = lambda f, g: " + ".join(f"{a:.17e} * {f}({2 * j} * xi) * {g}({2 * j} * eta)" for j, a in enumerate(alpha, 1))
    inside = f"{lat} BETWEEN -80 AND 84 AND {lon} BETWEEN -180 AND 180"
    return [
        {"zone": f"CASE WHEN {inside} THEN {utm_zone(lon)} END"},
        {"dl": f"radians({lon} - (zone * 6 - 183))", "t": f"sinh(atanh(sin(radians({lat}))) - {e:.17e} * atanh({e:.17e} * sin(radians({lat}))))"},
        {"xi": "atan2(t, cos(dl))", "eta": "asinh(sin(dl) / sqrt(t * t + cos(dl) * cos(dl)))"},
        {"easting": f"500000 + {_K0 * mean:.17e} * (eta + {wave('cos', 'sinh')})", "northing": f"CASE WHEN {lat} < 0 THEN 10000000 ELSE 0 END + {_K0 * mean:.17e} * (xi + {wave('sin', 'cosh')})"},
    ]


def mgrs(lat: str, zone: str = "zone", easting: str = "easting", northing: str = "northing") -> str:
    """Grid reference to the metre from UTM columns: zone, band, square of 100 km, five digits each way (cut, not rounded)."""
    band = f"substr('{BANDS}', CAST(floor(({lat} + 80) / 8) AS INT) + 1, 1)"
    column = "CASE " + " ".join(f"WHEN {zone} % 3 = {(k + 1) % 3} THEN substr('{letters}', CAST(floor({easting} / 100000) AS INT), 1)" for k, letters in enumerate(COLUMN_LETTERS)) + " END"
    row = f"substr('{ROW_LETTERS}', CAST((floor({northing} / 100000) + CASE WHEN {zone} % 2 = 0 THEN 5 ELSE 0 END) % 20 AS INT) + 1, 1)"
    digits = lambda v: f"lpad(CAST(CAST(floor({v}) % 100000 AS INT) AS VARCHAR(6)), 5, '0')"
    return f"lpad(CAST({zone} AS VARCHAR(2)), 2, '0') || {band} || {column} || {row} || {digits(easting)} || {digits(northing)}"
