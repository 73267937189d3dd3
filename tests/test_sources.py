"""Codecs and text formats: exact round trips."""

import numpy as np
import pytest

from oroflow.sources import text, tiles


@pytest.mark.parametrize("predictor", [tiles.LEFT, tiles.GRADIENT])
@pytest.mark.parametrize("compressor", [tiles.ZLIB, tiles.ZSTD])
def test_tiles(predictor, compressor):
    rng = np.random.default_rng(2)
    for z in (rng.integers(-400, 8000, (32, 32)), np.full((16, 16), 7), np.full((8, 8), tiles.NODATA), rng.integers(-11000, 8849, (64, 64))):
        z = z.copy()
        z[0, 0] = tiles.NODATA
        assert np.array_equal(tiles.decode(tiles.encode(z, 16, predictor, compressor)), z)
        back = tiles.decode(tiles.encode(z, 8, predictor, compressor))
        span = z[z != tiles.NODATA].max(initial=0) - z[z != tiles.NODATA].min(initial=0)
        assert np.array_equal(back == tiles.NODATA, z == tiles.NODATA) and np.abs(back - z).max() <= max(1, abs(span) / 254)
    with pytest.raises(tiles.TileError):
        tiles.decode(b"junk that is no tile")


def test_png():
    rng = np.random.default_rng(3)
    rgb = rng.integers(0, 256, (9, 7, 3)).astype(np.uint8)
    assert np.array_equal(tiles.png_decode(tiles.png_encode(rgb)), rgb)
    z = np.round(rng.random((16, 16)) * 3000, 0)
    z[1, 1] = np.nan
    assert np.array_equal(tiles.png_to_heights(tiles.heights_to_png(z)), z, equal_nan=True)


def test_tile_tables(spark):
    cells = spark.createDataFrame([(r, c, float(r * c)) for r in range(10) for c in range(9)], "r int, c int, z double")
    made = tiles.encode_tiles(cells, 8)
    assert made.count() == 4
    assert sorted(map(tuple, tiles.decode_tiles(made, 8).select("r", "c", "z").collect())) == sorted(map(tuple, cells.collect()))
    broken = made.limit(1).selectExpr("tr", "tc", "CAST('x' AS binary) AS payload")
    assert tiles.decode_tiles(broken, 8).first()["error"]


def test_text_formats(spark, tmp_path):
    (tmp_path / "a.geojson").write_text('{"type":"FeatureCollection","features":[{"type":"Feature","geometry":{"type":"Point","coordinates":[7.5,46.0]},"properties":{"name":"x"}},{"type":"Feature","geometry":{"type":"LineString","coordinates":[[1,2],[3,4]]},"properties":{}}]}')
    got = text.read_geojson(spark, str(tmp_path / "a.geojson")).collect()
    assert [(r["kind"], r["lon"], r["lat"]) for r in got] == [("Point", 7.5, 46.0), ("LineString", None, None)] and got[0]["properties"]["name"] == "x"
    (tmp_path / "p.csv").write_text("Name;Latitude;LNG\na;1.5;2.5\nb;x;3\n")
    assert [(r["lat"], r["lon"], r["Name"]) for r in text.read_points_csv(spark, str(tmp_path / "p.csv")).collect()] == [(1.5, 2.5, "a")]
    (tmp_path / "t.gpx").write_text('<gpx><trk><trkseg><trkpt lat="1.0" lon="2.0"><ele>5</ele><time>2024-01-01T00:00:00Z</time></trkpt></trkseg></trk></gpx>')
    r = text.read_gpx(spark, str(tmp_path / "t.gpx")).first()
    assert (r["lat"], r["lon"], r["ele"]) == (1.0, 2.0, 5.0)
    (tmp_path / "k.kml").write_text("<kml><Document><Placemark><name>n</name><LineString><coordinates>1,2,3 4,5</coordinates></LineString></Placemark></Document></kml>")
    assert [(r["i"], r["lon"], r["lat"], r["ele"]) for r in text.read_kml(spark, str(tmp_path / "k.kml")).collect()] == [(0, 1.0, 2.0, 3.0), (1, 4.0, 5.0, None)]
    s = spark.createDataFrame([('["abc", null, 3.5]',)], "state string")
    assert tuple(text.positional(s, {"call": (0, "string"), "v": (2, "double"), "gone": (5, "int")}).first()) == ("abc", 3.5, None)


def test_registry():
    import __spark_entry__ as e

    q, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(q) and e.FLAGSHIP in q and len(q) > 100


def test_chunk_files(spark, tmp_path):
    from oroflow.sources import chunks

    rng = np.random.default_rng(4)
    parts = {(r, c): rng.integers(-50, 4000, (256, 256)).astype(np.int16) for r in range(2) for c in range(2)}
    parts[0, 0][5, 5] = chunks.NODATA
    for version, name in ((1, "a.chunks"), (2, "b.chunks")):
        data = chunks.pack_chunks(parts, b"TESTMAGI", version)
        (tmp_path / name).write_bytes(data)
        assert all(np.array_equal(chunks.unpack_chunk(data, *k, b"TESTMAGI"), z) for k, z in parts.items())
    out = chunks.read_chunks(spark, str(tmp_path / "a.chunks"), spark.createDataFrame([(0, 0)], "chunk_row int, chunk_col int"))
    assert out.count() == 256 * 256 - 1 and out.filter("r = 7 and c = 9").first()["z"] == parts[0, 0][7, 9]
    with pytest.raises(ValueError):
        chunks.unpack_chunk(data, 5, 0)
