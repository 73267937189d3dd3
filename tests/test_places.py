"""Nearest stations against all pairs; direction fields against loops."""

import math
import random

from oroflow.operators import fields, vector


def nm(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 3440.065 * math.asin(min(1.0, math.sqrt(h)))


def asked(spark, points, stations):
    p = spark.createDataFrame(points, "pid long, lat double, lon double")
    return {r["pid"]: (r["sid"], r["distance_nm"]) for r in vector.nearest(p, spark.createDataFrame(stations, "sid long, slat double, slon double")).collect()}


def test_nearest_everywhere(spark):
    rng = random.Random(9)
    points = [(k, rng.uniform(-90, 90), rng.uniform(-180, 180)) for k in range(250)]
    points += [(300, 90.0, 0.0), (301, -90.0, 77.0), (302, 0.0, 180.0), (303, 0.0, -180.0), (304, 89.99, -120.0), (305, None, 1.0)]
    spread = [(k, rng.uniform(-90, 90), rng.uniform(-180, 180)) for k in range(120)]
    city = [(k, 10 + rng.uniform(-0.3, 0.3), 179.9 + rng.uniform(0, 0.09)) for k in range(400)]
    for stations in (spread, city, spread[:1]):
        got = asked(spark, points, stations)
        for pid, lat, lon in points:
            if lat is None:
                assert got[pid] == (None, None)
                continue
            d = min(nm((lat, lon), s[1:]) for s in stations)
            assert abs(got[pid][1] - d) <= 0.051, pid
            assert nm((lat, lon), next(s[1:] for s in stations if s[0] == got[pid][0])) <= d + 1e-6


def test_nearest_ties_and_nothing(spark):
    same = [(7, 5.0, 5.0), (3, 5.0, 5.0), (9, None, 1.0)]
    assert asked(spark, [(1, 5.0, 5.0), (2, -5.0, -175.0)], same) == {1: (3, 0.0), 2: (3, round(math.pi * 3440.065, 1))}
    assert asked(spark, [(1, 5.0, 5.0)], [(9, None, 1.0)]) == {1: (None, None)}


def test_nearest_joins_by_shuffle_beyond_the_bound(spark, monkeypatch):
    rng = random.Random(3)
    stations = [(k, rng.uniform(-90, 90), rng.uniform(-180, 180)) for k in range(60)]
    points = [(k, rng.uniform(-90, 90), rng.uniform(-180, 180)) for k in range(60)]
    before = asked(spark, points, stations)
    monkeypatch.setattr(vector, "SENT", 0)
    monkeypatch.setattr(vector, "_BLOCK_LEVEL", 3)  # so that points go down by themselves too
    assert asked(spark, points, stations) == before


def splat(paths):
    field = {}
    for path in paths.values():
        for (x1, y1), (x2, y2) in zip(path, path[1:], strict=False):
            if None in (x1, y1, x2, y2) or abs(x2 - x1) > 180 or math.hypot(x2 - x1, y2 - y1) < 0.01:
                continue
            n = math.sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2)
            ux, uy, steps = (x2 - x1) / n, (y2 - y1) / n, math.ceil(n / 0.5)
            for s in range(steps + 1):
                for p in range(-16, 17):
                    gx, gy = math.floor(x1 + s / steps * (x2 - x1) - uy * (p * 0.5) + 180), math.floor(90 - (y1 + s / steps * (y2 - y1) + ux * (p * 0.5)))
                    if 0 <= gx < 360 and 0 <= gy < 180:
                        w = (1 - abs(p * 0.5) / 8) ** 1.5
                        a, b = field.get((gx, gy), (0.0, 0.0))
                        field[gx, gy] = a + ux * w, b + uy * w
    out = {}
    for key, (a, b) in field.items():
        m = math.hypot(a, b)
        out[key] = (a / m, b / m, m) if m > 0.001 else (a, b, m)
    return out


def test_flow_field(spark):
    rng = random.Random(2)
    paths = {}
    for line in range(6):
        x, y = rng.uniform(-175, 175), rng.uniform(-85, 85)
        paths[line] = [(x, y)] + [(x := x + rng.uniform(-9, 9), y := y + rng.uniform(-5, 5)) for _ in range(5)]
    paths[6] = [(170.0, 0.0), (-170.0, 1.0), (-170.0, 1.0), (None, 3.0), (-160.0, 3.0)]
    rows = [(line, i, x, y) for line, path in paths.items() for i, (x, y) in enumerate(path)]
    field = fields.flow_field(spark.createDataFrame(rows, "line int, i int, lon double, lat double"))
    got, expected = {(r["gx"], r["gy"]): (r["dx"], r["dy"], r["mag"]) for r in field.collect()}, splat(paths)
    assert set(got) == set(expected)
    assert all(abs(a - b) < 1e-9 for k in got for a, b in zip(got[k], expected[k], strict=True) if expected[k][2] > 1e-6)
    points = [(k, rng.uniform(-90, 90), rng.uniform(-180, 180)) for k in range(60)] + [(99, None, 0.0)]
    at = {r["pid"]: (r["dx"], r["dy"], r["mag"]) for r in fields.flow_at(spark.createDataFrame(points, "pid long, lat double, lon double"), field).collect()}
    for pid, lat, lon in points:
        cell = got.get((math.floor(lon + 180.5), math.floor(90.5 - lat)), (0.0,) * 3) if lat is not None else (0.0,) * 3
        assert at[pid] == cell
    went = {r["pid"]: r for r in fields.advected(spark.createDataFrame(points, "pid long, lat double, lon double"), field, 0.5, 2).collect()}
    for pid, lat, lon in points[:60]:
        for _ in range(2):
            dx, dy, m = got.get((math.floor(lon + 180.5), math.floor(90.5 - lat)), (0.0,) * 3)
            if m > 0.01 and abs(lat) <= 90 and abs(lon) <= 180:
                lat, lon = lat + 0.5 * dy, lon + 0.5 * dx
        assert abs(went[pid]["lat"] - lat) < 1e-9 and abs(went[pid]["lon"] - lon) < 1e-9
