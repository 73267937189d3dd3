"""Time-stamped geo-event feeds: tracks, latest fixes, filters, feature queries and error statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo


def latest_fix(fixes: DataFrame, key: str = "key") -> DataFrame:
    """fixes: key, ts, id, lat, lon, value. The latest fix of each key (the largest id of equally late ones)."""
    top = F.max_by(F.struct("id", "ts", "lat", "lon", "value"), F.struct("ts", "id"))
    return fixes.groupBy(key).agg(top.alias("x")).select(key, "x.*")


def track_legs(fixes: DataFrame) -> DataFrame:
    """Each fix with the way from the one before: distance, bearing, seconds."""
    order = Window.partitionBy("key").orderBy("ts", "id")
    before = {"lat0": F.lag("lat").over(order), "lon0": F.lag("lon").over(order), "ts0": F.lag("ts").over(order)}
    legs = fixes.withColumns(before)
    return legs.select("key", "id", F.expr(f"round({geo.haversine('lat0', 'lon0', 'lat', 'lon')}, 2)").alias("leg_m"), F.expr(f"CASE WHEN lat0 = lat AND lon0 = lon THEN NULL ELSE round({geo.bearing('lat0', 'lon0', 'lat', 'lon')}, 4) END").alias("bearing"), (F.unix_seconds(F.col("ts").cast("timestamp")) - F.unix_seconds(F.col("ts0").cast("timestamp"))).alias("seconds"))


def tracks(fixes: DataFrame) -> DataFrame:
    """One row a key: fixes, way, greatest value with its storm class, first and last time."""
    per = track_legs(fixes).groupBy("key").agg(F.round(F.sum("leg_m") / 1000, 2).alias("length_km"))
    head = fixes.groupBy("key").agg(F.count(F.lit(1)).alias("n_fixes"), F.max("value").alias("peak"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return head.join(per, "key").withColumn("category", F.expr(geo.storm_class("peak")))


def feature_query(features: DataFrame, box: tuple[float, float, float, float], condition: str = "true", limit: int = 10, offset: int = 0, order: str = "fid") -> DataFrame:
    """One page of the features in a box that meet a condition, each with the number matched in all. The page is a
    top-k report; the count is an aggregate of its own."""
    west, south, east, north = box
    found = features.filter(F.col("lon").between(west, east) & F.col("lat").between(south, north)).filter(condition)
    matched = F.broadcast(found.agg(F.count(F.lit(1)).alias("number_matched")))
    return found.orderBy(order).offset(offset).limit(limit).join(matched)


def within_radius(features: DataFrame, lat: float, lon: float, nm: float) -> DataFrame:
    """Features nearer than a distance; a box on the raw coordinates comes first, so that it can be pushed down."""
    near = features.filter(F.col("lat").between(lat - nm / 60, lat + nm / 60))
    d = F.expr(geo.haversine(repr(float(lat)), repr(float(lon)), "lat", "lon", geo.EARTH_NM))
    return near.withColumn("distance_nm", F.round(d, 3)).filter(F.col("distance_nm") <= nm)


def with_fallback(points: DataFrame, *sources: tuple[str, DataFrame]) -> DataFrame:
    """points: pid, key; sources: name and (key, z), the first that has a value counts. Adds z and source."""
    out = points
    for k, (_, table) in enumerate(sources):
        out = out.join(table.select("key", F.col("z").alias(f"z{k}")), "key", "left")
    z = [F.col(f"z{k}") for k in range(len(sources))]
    named = F.coalesce(*[F.when(v.isNotNull(), F.lit(name)) for v, (name, _) in zip(z, sources, strict=True)], F.lit("none"))
    return out.select("pid", F.coalesce(*z).alias("z"), named.alias("source"))


def error_stats(pairs: DataFrame) -> DataFrame:
    """pairs: expected, got. One row of accuracy measures over the pairs with both."""
    e = F.col("got") - F.col("expected")
    r = lambda x: F.round(x, 6)
    return pairs.filter("expected is not null and got is not null").agg(F.count(F.lit(1)).alias("n"), r(F.sqrt(F.avg(e * e))).alias("rmse"), r(F.avg(F.abs(e))).alias("mae"), r(F.max(F.abs(e))).alias("max_error"), r(F.avg(e)).alias("bias"), r(F.stddev_pop(e)).alias("std"), r(F.percentile(F.abs(e), F.lit(0.5))).alias("p50"), r(F.percentile(F.abs(e), F.lit(0.95))).alias("p95"))
