"""Tile stores: resampling, levels, choice of sources, points, depths."""

import math

import numpy as np
import pytest

from oroflow.sources import pyramid, tiles

REF = (5.0, 20.0, 0.02, 0.02)


@pytest.fixture(scope="module")
def cells(spark):
    rows = [(r, c, None if (r * c) % 41 == 5 or r > 110 else float(round(300 + 200 * math.sin(r / 9) + c))) for r in range(130) for c in range(90)]
    return rows, spark.createDataFrame(rows, "r int, c int, z double")


def decoded(store):
    return {(r["zoom"], r["x"], r["y"]): tiles.decode(r["payload"]) for r in store.collect()}


def test_levels(spark, cells):
    rows, df = cells
    z = {(r, c): v for r, c, v in rows}
    got = decoded(pyramid.build(pyramid.resample(df, REF, 9, 16), 7, 9, 16))
    assert {k[0] for k in got} == {7, 8, 9}
    for (zoom, x, y), tile in got.items():
        assert (tile != tiles.NODATA).any()
        if zoom == 9:
            edge = lambda v: math.degrees(math.atan(math.sinh(math.pi * (1 - 2 * v / 512))))
            for py in range(16):
                for px in range(16):
                    lat = edge(y) - (py + 0.5) * (edge(y) - edge(y + 1)) / 16
                    lon = x / 512 * 360 - 180 + (px + 0.5) * 360 / 512 / 16
                    v = z.get((round((REF[0] - lat) / REF[2]), round((lon - REF[1]) / REF[3])))
                    assert tile[py, px] == (tiles.NODATA if v is None else v)
        else:
            for py in range(16):
                for px in range(16):
                    four = [got[k][(2 * py + a) % 16, (2 * px + b) % 16] for a in (0, 1) for b in (0, 1) if (k := (zoom + 1, 2 * x + (2 * px + b) // 16, 2 * y + (2 * py + a) // 16)) in got]
                    four = [v for v in four if v != tiles.NODATA]
                    assert tile[py, px] == (round(sum(four) / len(four)) if four else tiles.NODATA)


def test_points_fall_back_level_by_level(spark, cells):
    _, df = cells
    store = pyramid.build(pyramid.resample(df, REF, 9, 16), 7, 9, 16)
    broken = store.selectExpr("zoom", "x", "y", "CASE WHEN zoom = 9 AND x % 2 = 0 THEN CAST('junk' AS BINARY) WHEN zoom = 9 AND y % 2 = 0 THEN NULL ELSE payload END AS payload", "n_valid")
    rng = np.random.default_rng(1)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(rng.uniform(2.2, 5.2, 300), rng.uniform(19.8, 22.0, 300), strict=True))]
    rows += [(300 + i, 4.0, 20.5) for i in range(50)] + [(400, 89.99, 0.0), (401, None, 20.0), (402, 0.0, None)]
    points = spark.createDataFrame(rows, "pid long, lat double, lon double")
    got = {r["pid"]: (r["z"], r["zoom"]) for r in pyramid.elevation_at(points, broken, (9, 8, 7), tile_points=7).collect()}
    assert len(got) == len(rows)
    grids = decoded(store)
    for pid, lat, lon in rows:
        expected = (None, None)
        for zoom in (9, 8, 7) if lat is not None and lon is not None and abs(lat) < 85 else ():
            n = 1 << zoom
            x, fy = math.floor((lon + 180) / 360 * n), (1 - math.asinh(math.tan(math.radians(lat))) / math.pi) / 2 * n
            y = math.floor(fy)
            if (zoom, x, y) not in grids or zoom == 9 and (x % 2 == 0 or y % 2 == 0):
                continue
            edge = lambda v, n=n: math.degrees(math.atan(math.sinh(math.pi * (1 - 2 * v / n))))
            qy, qx = (edge(y) - lat) / (edge(y) - edge(y + 1)) * 15, ((lon + 180) / 360 * n - x) * 15
            y0, x0 = int(qy), int(qx)
            y1, x1, wy, wx = min(y0 + 1, 15), min(x0 + 1, 15), qy - y0, qx - x0
            t = [float(grids[zoom, x, y][a, b]) for a in (y0, y1) for b in (x0, x1)]
            good = [v for v in t if v != tiles.NODATA]
            if good:
                v = t[0] * (1 - wy) * (1 - wx) + t[1] * (1 - wy) * wx + t[2] * wy * (1 - wx) + t[3] * wy * wx if len(good) == 4 else good[0]
                expected = (v, zoom)
                break
        assert got[pid][1] == expected[1], (pid, lat, lon)
        assert expected[0] is None or abs(got[pid][0] - expected[0]) <= 0.0501


def test_choice_and_statistics(spark, cells):
    _, df = cells
    whole = pyramid.resample(df, REF, 9, 16)
    part = pyramid.resample(df.filter("r < 12 and c < 40"), REF, 9, 16)
    got = pyramid.choose(part, whole.filter("x % 2 = 0"), 16, 0.2).collect()
    first = {(r["x"], r["y"]): r["n_valid"] for r in part.collect()}
    second = {(r["x"], r["y"]): r["n_valid"] for r in whole.filter("x % 2 = 0").collect()}
    assert {(r["x"], r["y"]): (r["n_valid"], r["source"]) for r in got} == {k: (first[k], "first") if k in first and (first[k] >= 0.2 * 256 or k not in second) else (second[k], "second") for k in {*first, *second}}
    odd = spark.createDataFrame([(1, 0, 0, b"junk"), (1, 0, 1, None), (1, 1, 0, tiles.encode(np.full((4, 4), tiles.NODATA)))], "zoom int, x int, y int, payload binary")
    assert sorted((r["y"], r["x"], r["n_valid"], r["z_sum"]) for r in pyramid.statistics(odd).collect()) == sorted([(0, 0, None, None), (1, 0, None, None), (0, 1, 0, None)], key=lambda v: v[:2])


def test_least_bits(spark):
    rng = np.random.default_rng(3)
    rows = [(r, c, float(rng.integers(0, 40 if r < 8 else 9000)) if c else None) for r in range(16) for c in range(8)]
    got = {r["tr"]: r for r in pyramid.least_bits(spark.createDataFrame(rows, "r int, c int, z double"), 1.0, 8).collect()}
    assert got[0]["bits"] == 8 and got[0]["rmse"] == 0 and 8 < got[1]["bits"] < 16
    for tr, row in got.items():
        z = np.array([[tiles.NODATA if v is None else v for r, c, v in rows if r == i] for i in range(8 * tr, 8 * tr + 8)], np.int64)
        error = lambda b, z=z: float(np.sqrt(np.mean((tiles.decode(tiles.encode(z, b)) - z)[z != tiles.NODATA] ** 2)))
        assert error(row["bits"]) == row["rmse"] <= 1 and np.array_equal(tiles.decode(row["payload"]), tiles.decode(tiles.encode(z, row["bits"])))
        assert row["bits"] == 8 or error(row["bits"] - 1) > 1


@pytest.mark.parametrize("n", [3, 4])
def test_png_filters(n):
    """Rows under each of the five filters, made by their definition."""
    import struct
    import zlib

    rng = np.random.default_rng(8)
    pixels = rng.integers(0, 256, (10, 7, n))
    raw = b""
    for y in range(10):
        kind, line = y % 5, []
        for x in range(7):
            for k in range(n):
                a = int(pixels[y, x - 1, k]) if x else 0
                b = int(pixels[y - 1, x, k]) if y else 0
                c = int(pixels[y - 1, x - 1, k]) if x and y else 0
                p = a + b - c
                paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
                line.append((int(pixels[y, x, k]) - (0, a, b, (a + b) // 2, paeth)[kind]) % 256)
        raw += bytes([kind, *line])
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 7, 10, 8, 2 if n == 3 else 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    assert np.array_equal(tiles.png_decode(data), pixels)


def test_pixels_are_not_broadcast(spark):
    """Before its pixels are made a tile is one row, and Spark's size check takes it for one."""
    ground = spark.createDataFrame([(r, c, 1.0) for r in range(3) for c in range(3)], "r int, c int, z double")
    tiles_ = pyramid.resample(ground, (10.0, 20.0, 0.01, 0.01), 10, 32)
    tiles_.collect()
    assert "BroadcastHashJoin" not in tiles_._jdf.queryExecution().executedPlan().toString()
