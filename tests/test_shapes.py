"""Shapefiles: round trips of all kinds, boxes that prune files and records, broken files."""

import json
import os
import random

import pytest
from pyspark.errors import PySparkException

from oroflow.sources import shapes

PART = "array<array<struct<x:double,y:double,z:double>>>"


def made(rng, kind, k):
    if k % 17 == 0:
        return None
    x, y = rng.uniform(-170, 170), rng.uniform(-80, 80)
    point = lambda: (x + rng.uniform(-2, 2), y + rng.uniform(-2, 2), float(rng.randrange(900)))
    if kind == "point":
        return [[point()]]
    if kind == "multipoint":
        return [[point() for _ in range(rng.randrange(1, 5))]]
    return [[point() for _ in range(rng.randrange(2, 9))] for _ in range(rng.randrange(1, 4))]


@pytest.mark.parametrize("kind", ["point", "multipoint", "line", "polygon"])
@pytest.mark.parametrize("with_z", [False, True])
def test_round_trip_and_box(spark, tmp_path, kind, with_z):
    rng = random.Random(kind)
    rows = [(k, None if k % 5 == 0 else f"näme {k}", made(rng, kind, k)) for k in range(300)]
    folder = str(tmp_path / "s")
    files = shapes.write_shapes(spark.createDataFrame(rows, f"ID long, NAME string, parts {PART}"), folder, kind, files=3, rows=40, with_z=with_z).collect()
    assert sum(f["n_records"] for f in files) == 300 and max(f["n_records"] for f in files) <= 40
    spark.dataSource.register(shapes.ShapefileSource)
    got = {int(r["attributes"]["ID"]): r for r in spark.read.format("shapefile").option("records", 7).load(folder).collect()}
    assert len(got) == 300
    for k, name, parts in rows:
        assert got[k]["attributes"]["NAME"] == name
        expected = [[(x, y, z if with_z else None) for x, y, z in p] for p in parts] if parts else None
        assert ([[tuple(q) for q in p] for p in got[k]["parts"]] if got[k]["parts"] is not None else None) == expected
    box = (-40.0, -30.0, 35.0, 50.0)
    inside = {k for k, _, p in rows if p and min(q[0] for s in p for q in s) <= box[2] and max(q[0] for s in p for q in s) >= box[0] and min(q[1] for s in p for q in s) <= box[3] and max(q[1] for s in p for q in s) >= box[1]}
    near = shapes.read_shapes(spark, folder, box, ["ID"]).collect()
    assert {int(r["attributes"]["ID"]) for r in near} == inside and len(near) == len(inside) and all(set(r["attributes"]) == {"ID"} for r in near)


def test_files_outside_the_box_are_not_read(spark, tmp_path):
    rows = [(k, [[(float(k), 0.0, 0.0), (k + 0.5, 1.0, 0.0)]]) for k in range(100)]
    folder = str(tmp_path / "s")
    shapes.write_shapes(spark.createDataFrame(rows, f"ID long, parts {PART}"), folder, "line", files=4, rows=10)
    planned = shapes.ShapefileReader({"path": folder, "box": "42,0,43,1"}).partitions()
    assert 0 < len({p.file for p in planned}) <= 2 < len({p.file for p in shapes.ShapefileReader({"path": folder}).partitions()})
    for name in os.listdir(folder):  # what lies outside can even be broken past its header
        path = f"{folder}/{name}"
        if name.endswith(".shp") and path not in {p.file for p in planned}:
            with open(path, "r+b") as f:
                f.truncate(100)
    assert sorted(int(r["attributes"]["ID"]) for r in shapes.read_shapes(spark, folder, (42.0, 0.0, 43.0, 1.0)).collect()) == [42, 43]
    assert shapes.read_shapes(spark, folder, (500.0, 0.0, 501.0, 1.0)).count() == 0


def test_broken_and_bare_files(spark, tmp_path):
    folder = str(tmp_path / "s")
    shapes.write_shapes(spark.createDataFrame([(1, [[(1.0, 2.0, 0.0)]])], f"ID long, parts {PART}").coalesce(1), folder, "point", files=1)
    os.remove(f"{folder}/part-00000-00000.dbf")
    assert [r["attributes"] for r in shapes.read_shapes(spark, folder).collect()] == [{}]
    with open(f"{folder}/bad.shp", "wb") as f:
        f.write(b"no")
    with pytest.raises(PySparkException, match="bad.shp"):
        shapes.read_shapes(spark, folder).count()
    assert spark.read.format("shapefile").option("broken", "skip").load(folder).count() == 1
    with pytest.raises(shapes.ShapeError):
        shapes.write_shapes(spark.createDataFrame([(1, [[(1.0, 2.0, 0.0)]])], f"much_too_long_a_name long, parts {PART}"), folder, "point")


def test_geojson(spark, tmp_path):
    rows = [("a", [[(1.0, 2.0, 0.0), (3.0, 4.0, 0.0)]]), ("b", [[(1.0, 2.0, 0.0), (3.0, 4.0, 0.0)], [(5.0, 6.0, 0.0), (7.0, 8.0, 0.0)]]), ("c", None)]
    folder = str(tmp_path / "s")
    shapes.write_shapes(spark.createDataFrame(rows, f"ID string, parts {PART}"), folder, "line")
    got = {f["properties"]["ID"]: f["geometry"] for f in (json.loads(r["feature"]) for r in shapes.shape_geojson(shapes.read_shapes(spark, folder)).collect())}
    assert got["a"] == {"type": "LineString", "coordinates": [[1, 2], [3, 4]]}
    assert got["b"] == {"type": "MultiLineString", "coordinates": [[[1, 2], [3, 4]], [[5, 6], [7, 8]]]}
    assert got["c"] == {"type": "GeometryCollection", "geometries": []}
