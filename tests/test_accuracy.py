"""Mosaics, classes and slope deviations against NumPy; tile names and property summaries in odd cases."""

import math

import numpy as np
from pyspark.sql import functions as F

from oroflow.functions import geo
from oroflow.operators import accuracy
from oroflow.sources import pyramid, tiles

SIDE, ZOOM, RADIUS = 8, 5, 9


def stored(spark, grids):
    rows = [(ZOOM, x, y, bytearray(tiles.encode(np.where(np.isnan(z), tiles.NODATA, z).astype(np.int64), 16)), 1) for (x, y), z in grids.items()]
    return spark.createDataFrame(rows, pyramid.SCHEMA)


def test_mosaic(spark):
    rng = np.random.default_rng(8)
    make = lambda share: np.where(rng.random((SIDE, SIDE)) < share, np.nan, rng.integers(0, 900, (SIDE, SIDE)).astype(float))
    first = {(x, y): make(0.5) for x in range(14, 18) for y in range(14, 18) if (x, y) != (15, 15)}
    second = {(x, y): make(0.1) for x in range(13, 17) for y in range(13, 17)}
    broken = stored(spark, second).withColumn("payload", F.when((F.col("x") == 14) & (F.col("y") == 14), F.unhex(F.lit("00"))).otherwise(F.col("payload")))
    second[14, 14] = np.full((SIDE, SIDE), np.nan)
    points = [(k, float(a), float(b)) for k, (a, b) in enumerate(zip(rng.uniform(-8, 12, 15), rng.uniform(-15, 12, 15), strict=True))] + [(50, 70.0, -179.9), (51, None, 3.0)]
    asked = spark.createDataFrame(points, "pid long, lat double, lon double")
    got = {(r["pid"], r["row"], r["col"]): (r["z"], r["source"]) for r in pyramid.mosaic(asked, RADIUS, ZOOM, stored(spark, first), broken, side=SIDE, tile_windows=3).collect()}
    expected = {}
    for pid, lat, lon in points[:-1]:
        cx = math.floor((lon + 180) / 360 * 2**ZOOM * SIDE)
        cy = math.floor((1 - math.asinh(math.tan(math.radians(lat))) / math.pi) / 2 * 2**ZOOM * SIDE)
        for row in range(2 * RADIUS + 1):
            for col in range(2 * RADIUS + 1):
                gx, gy = cx - RADIUS + col, cy - RADIUS + row
                for k, store in enumerate((first, second)):
                    z = store.get((gx // SIDE, gy // SIDE))
                    if z is not None and not np.isnan(z[gy % SIDE, gx % SIDE]):
                        expected[pid, row, col] = (z[gy % SIDE, gx % SIDE], k)
                        break
    assert got == expected and {k for _, k in got.values()} == {0, 1}


def test_squares_of_a_mosaic_leave_together(spark):
    """Whatever a batch holds, each square keeps its own cells."""
    level = stored(spark, {(x, y): np.full((SIDE, SIDE), 10.0 * x + y) for x in range(14, 18) for y in range(14, 18)})
    asked = spark.createDataFrame([(k, k - 6.0, k - 5.0) for k in range(12)], "pid long, lat double, lon double")
    rows = [sorted(map(tuple, pyramid.mosaic(asked, RADIUS, ZOOM, level, side=SIDE, batch_cells=n).collect())) for n in (1, 200, 100_000)]
    assert rows[0] == rows[1] == rows[2] and len({r[0] for r in rows[0]}) == 12


def test_slope_deviation(spark):
    rng = np.random.default_rng(1)
    a, b = rng.uniform(0, 90, (12, 12)), rng.uniform(0, 90, (12, 12))
    cells = lambda z: spark.createDataFrame([(r, c, float(z[r, c])) for r in range(12) for c in range(12)], "r int, c int, z double")
    slope = lambda z: np.degrees(np.arctan(np.hypot(*np.gradient(z, 30.0))))
    d = np.abs(slope(a) - slope(b))
    got = accuracy.slope_deviation(cells(a), cells(b)).collect()
    assert len(got) == 1 and got[0]["n"] == 144
    for name, value in (("rmse", np.sqrt((d**2).mean())), ("mean", d.mean()), ("greatest", d.max()), ("p95", np.percentile(d, 95))):
        assert abs(got[0][name] - value) < 1e-9
    assert accuracy.slope_deviation(cells(a).filter("false"), cells(b)).count() == 0


def test_terrain_classes(spark):
    heights = {0: (-9.0, -1.0), 1: (0.0, 20.0), 2: (0.0, 90.0), 3: (0.0, 900.0), 4: (0.0, 2900.0), 5: (0.0, 3000.0), 6: (None, None), 7: (None, 4.0)}
    rows = [(k * 4 + i, 0, z) for k, pair in heights.items() for i, z in enumerate(pair)]
    got = {r["tr"]: r["class"] for r in accuracy.terrain_classes(spark.createDataFrame(rows, "r int, c int, z double"), 4).collect()}
    assert got == dict(enumerate(("ocean", "flat_lowland", "lowland", "hills", "mountain", "high_mountain", "nodata", "flat_lowland")))


def test_names_and_properties(spark):
    at = spark.createDataFrame([(-0.5, -0.5), (0.0, 0.0), (-41.2, 174.9), (89.9, -180.0)], "lat double, lon double").withColumn("name", F.expr(geo.degree_tile("lat", "lon")))
    for r in at.select("lat", "lon", *[F.expr(x).alias(k) for k, x in geo.degree_bounds("name").items()]).collect():
        assert r["south"] <= r["lat"] < r["north"] and r["west"] <= r["lon"] < r["east"]
    named = spark.createDataFrame([("N40W072",), ("S01E036",)], "name string").select(*[F.expr(x).alias(k) for k, x in geo.degree_bounds("name", compat=True).items()]).collect()
    assert [tuple(r) for r in named] == [(40, -73, 41, -72), (-2, 36, -1, 37)]
    rows = [({"a": "1", "b": "x"},), ({"a": "NaN", "b": "x"},), ({"a": "-3.5", "b": None},), (None,), ({},)]
    got = {r["name"]: tuple(r)[1:] for r in accuracy.property_summary(spark.createDataFrame(rows, "properties map<string,string>")).collect()}
    assert got == {"a": (3, 2, -3.5, 1.0, 3), "b": (2, 0, None, None, 1)}
    turned = spark.range(1).selectExpr(*[f"{geo.terminator_lat(d, lon)} AS v{i}" for i, (d, lon) in enumerate((("0e0", "0e0"), ("0e0", "180e0"), ("0e0", "90e0"), ("23e0", "0e0"), ("90e0", "5e0")))]).first()
    assert [round(v, 6) for v in turned] == [-90.0, 90.0, 0.0, -67.0, 0.0]
