"""Closed forms on small rasters."""

import math

import numpy as np
import pytest

from oroflow.operators import grid, terrain, vector


def cells(spark, z):
    rows = [(r, c, None if np.isnan(v) else float(v)) for r, line in enumerate(np.asarray(z, float)) for c, v in enumerate(line)]
    return spark.createDataFrame(rows, "r int, c int, z double")


def grid_of(df, name, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        if r[name] is not None:
            out[r["r"], r["c"]] = r[name]
    return out


def test_ramp(spark):
    z = np.repeat(np.arange(10)[:, None] * 100.0, 10, axis=1)
    out = grid_of(terrain.derive(cells(spark, z), "slope"), "slope", z.shape)
    assert np.isnan(out[0]).all() and np.isnan(out[:, 0]).all()
    assert out[5, 5] == pytest.approx(math.degrees(math.atan(100 / terrain.CELL)), abs=1e-5)
    assert set(grid_of(terrain.derive(cells(spark, z), "aspect"), "aspect", z.shape)[1:-1, 1:-1].ravel()) == {0.0}
    assert set(grid_of(terrain.derive(cells(spark, z.T), "aspect"), "aspect", z.shape)[1:-1, 1:-1].ravel()) == {270.0}


def test_flat(spark):
    z = np.full((6, 6), 100.0)
    got = terrain.derive(cells(spark, z), "slope", "aspect", "tpi", "tri", "roughness", "curvature").collect()
    inside = [r for r in got if 0 < r["r"] < 5 and 0 < r["c"] < 5]
    assert all((r["slope"], r["aspect"], r["tpi"], r["tri"], r["roughness"], r["curvature"]) == (0, None, 0, 0, 0, 0) for r in inside)


def test_hole_and_peak(spark):
    z = np.full((7, 7), 100.0)
    z[3, 3] = 200
    tpi = grid_of(terrain.derive(cells(spark, z), "tpi"), "tpi", z.shape)
    assert tpi[3, 3] == 100 and tpi[2, 2] == -12.5
    z[3, 3] = np.nan
    slope = grid_of(terrain.derive(cells(spark, z), "slope"), "slope", z.shape)
    assert np.isnan(slope[2:5, 2:5]).all() and slope[1, 1] == 0
    shade = grid_of(terrain.derive(cells(spark, z), "hillshade"), "hillshade", z.shape)
    assert shade[3, 3] == 0 and (np.nan_to_num(shade) <= 255).all()


def test_gaps_are_not_bridged(spark):
    rows = [(r, c, 1.0 * r) for r in range(6) for c in range(6) if r != 3]
    got = grid.with_neighbours(spark.createDataFrame(rows, "r int, c int, z double")).filter("r in (2, 4)").collect()
    assert all((x["s"] if x["r"] == 2 else x["n"]) is None for x in got)


def test_blocks_agree_with_numpy(spark, monkeypatch):
    monkeypatch.setattr(grid, "BLOCK", 4)
    rng = np.random.default_rng(0)
    z = rng.integers(0, 100, (13, 11)).astype(float)
    z[5, 5] = np.nan
    got = grid_of(terrain.mean_filter(cells(spark, z), 5), "mean_filter", z.shape)
    wide = np.pad(z, 2, mode="symmetric")
    want = np.array([[np.nanmean(wide[r : r + 5, c : c + 5]) if not np.isnan(z[r, c]) else np.nan for c in range(11)] for r in range(13)])
    assert np.allclose(got, want, atol=1e-6, equal_nan=True)
    top = grid_of(terrain.extreme_filter(cells(spark, z), "max", 3), "max_filter", z.shape)
    wide = np.pad(z, 1, mode="symmetric")
    want = np.array([[np.nanmax(wide[r : r + 3, c : c + 3]) if not np.isnan(z[r, c]) else np.nan for c in range(11)] for r in range(13)])
    assert np.allclose(top, want, equal_nan=True)


def test_wall_hides(spark):
    z = np.full((20, 20), 100.0)
    z[8:12] = 200
    eye = spark.createDataFrame([(0, 2, 10, 1.75)], "o int, orow int, ocol int, height double")
    seen = {(r["r"], r["c"]): r["visible"] for r in terrain.viewshed(cells(spark, z), eye, 17).collect()}
    assert seen[2, 10] and seen[5, 10] and seen[8, 10] and not seen[15, 10]


def test_zones_and_lines(spark):
    z = np.arange(25.0).reshape(5, 5)
    ring = [(0.5, 0.5), (3.5, 0.5), (3.5, 3.5), (0.5, 3.5)]
    edges = spark.createDataFrame([(1, *p, *q) for p, q in zip(ring, ring[1:] + ring[:1])], "zone int, x1 double, y1 double, x2 double, y2 double")
    r = vector.zonal_stats(cells(spark, z), edges).first()
    assert (r["count"], r["mean"], r["min"], r["max"]) == (9, 12.0, 6.0, 18.0)
    seg = spark.createDataFrame([(1, 0, 0, 4, 4), (2, 1, 0, 1, 3)], "line int, r1 int, c1 int, r2 int, c2 int")
    got = {(x["line"], x["r"], x["c"]) for x in vector.rasterize_lines(seg).collect()}
    assert got == {(1, i, i) for i in range(5)} | {(2, 1, c) for c in range(4)}


def test_cells_of_one_segment_are_not_held_against_each_other(spark, monkeypatch):
    monkeypatch.setattr(vector, "_PIECE", 3)
    schema = "line int, r1 int, c1 int, r2 int, c2 int"
    lone = vector.rasterize_lines(spark.createDataFrame([(1, 0, 0, 7, 7), (2, 1, 4, 1, 4)], schema))
    assert sorted(map(tuple, lone.collect())) == [(1, i, i) for i in range(8)] + [(2, 1, 4)]
    assert "Aggregate" not in lone._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]  # none over the cells
    rows = [(1, 0, 0, 0, 4), (1, 0, 4, 0, 2), (None, 3, 3, 3, 5), (None, 3, 5, 3, 3), (5, 9, 9, 9, 9)]
    got = [tuple(x) for x in vector.rasterize_lines(spark.createDataFrame(rows, schema)).collect()]
    assert len(got) == len(set(got)) and set(got) == {(1, 0, c) for c in range(5)} | {(None, 3, c) for c in range(3, 6)} | {(5, 9, 9)}


def test_contours_of_a_plane(spark):
    z = np.repeat(np.arange(6)[None, :] * 10.0, 6, axis=0)
    got = vector.contour_segments(cells(spark, z), 25.0).collect()
    assert {r["level"] for r in got} == {25.0, 50.0} and all(r["x1"] == 2.5 == r["x2"] for r in got if r["level"] == 25.0) and sum(r["level"] == 25.0 for r in got) == 5
