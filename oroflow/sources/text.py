"""Text formats: GeoJSON, CSV with coordinate columns found by name, GPX and KML points; and their writers."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LAT, _LON = re.compile(r"^(lat|latitude|y)$", re.I), re.compile(r"^(lon|lng|long|longitude|x)$", re.I)
_GEOJSON = "struct<type:string,features:array<struct<geometry:struct<type:string,coordinates:string>,properties:map<string,string>>>>"


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Features of each file: kind, coordinates (JSON text), properties, lon, lat (of points). Malformed files give none."""
    whole = spark.read.text(path, wholetext=True)
    found = whole.select(F.explode(F.from_json("value", _GEOJSON)["features"]).alias("f"))
    point = F.when(F.col("f.geometry.type") == "Point", F.from_json("f.geometry.coordinates", "array<double>"))
    return found.select(F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("coordinates"), F.col("f.properties").alias("properties"), F.get(point, F.lit(0)).alias("lon"), F.get(point, F.lit(1)).alias("lat"))


def read_points_csv(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """A table with lat and lon columns, whatever they are called; rows without numbers in them are left out. The
    separator is found from the header."""
    header = spark.read.text(path).limit(1).first()
    if sep is None:
        sep = max(",;\t|", key=(header[0] if header else "").count)
    table = spark.read.option("header", True).option("sep", sep).option("inferSchema", True).csv(path)
    lat, lon = (next(c for c in table.columns if p.match(c)) for p in (_LAT, _LON))
    num = lambda c: F.expr(f"try_cast(`{c}` AS double)")
    rest = [c for c in table.columns if c not in (lat, lon)]
    return table.select(num(lat).alias("lat"), num(lon).alias("lon"), *rest).filter("lat is not null and lon is not null")


def read_gpx(spark: SparkSession, path: str, tag: str = "trkpt") -> DataFrame:
    """Track points: lat, lon, ele, time."""
    schema = "_lat double, _lon double, ele double, time string"
    return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path).select(F.col("_lat").alias("lat"), F.col("_lon").alias("lon"), "ele", F.expr("try_cast(time AS timestamp)").alias("time"))


def read_kml(spark: SparkSession, path: str) -> DataFrame:
    """Placemarks: name and its comma-separated tuples as points in order."""
    schema = "name string, Point struct<coordinates:string>, LineString struct<coordinates:string>"
    marks = spark.read.format("xml").option("rowTag", "Placemark").schema(schema).load(path)
    tuples = F.split(F.trim(F.coalesce("Point.coordinates", "LineString.coordinates")), r"\s+")
    at = marks.select("name", F.posexplode(tuples).alias("i", "t")).withColumn("p", F.split("t", ","))
    num = lambda k: F.expr(f"try_cast(get(p, {k}) AS double)")
    return at.select("name", "i", num(0).alias("lon"), num(1).alias("lat"), num(2).alias("ele"))


def to_kml(points: DataFrame, name: str = "name") -> DataFrame:
    """One Placemark a row (lon, lat, z), as text; the document's frame is the writer's."""
    safe = F.replace(F.replace(F.col(name).cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    return points.select(F.format_string("<Placemark><name>%s</name><Point><coordinates>%s,%s,%s</coordinates></Point></Placemark>", safe, F.col("lon"), F.col("lat"), F.coalesce("z", F.lit(0.0))).alias("value"))


def write_geojson(features: DataFrame, path: str) -> None:
    """features: feature (JSON text). One feature a line; parts in parallel, no collection in one task."""
    features.select(F.col("feature").alias("value")).write.mode("overwrite").text(path)


def positional(states: DataFrame, names: dict[str, tuple[int, str]]) -> DataFrame:
    """states: state (JSON array as text). Named and typed fields by position."""
    return states.select(*[F.expr(f"try_cast(get(from_json(state, 'array<string>'), {k}) AS {kind})").alias(name) for name, (k, kind) in names.items()])
