"""What a raster lost on its way: slopes of two rasters held against each other, classes of terrain, both by tile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from . import grid

#: Published limits of the classes: range and deviation in metres.
FLAT, LOW, HILLS, MOUNTAIN = (50, 15), (200, 50), 1000, 3000


def _tiled(cells: DataFrame, side: int) -> DataFrame:
    return cells.withColumns({"tr": F.floor(F.col("r") / side).cast("int"), "tc": F.floor(F.col("c") / side).cast("int")})


def terrain_classes(cells: DataFrame, side: int = 256) -> DataFrame:
    """tr, tc, class of each tile by its greatest height, range and deviation; nodata for one whose heights are all null."""
    span, std = F.max("z") - F.min("z"), F.stddev_pop("z")
    found = F.when(F.count("z") == 0, "nodata").when(F.max("z") < 0, "ocean").when((span < FLAT[0]) & (std < FLAT[1]), "flat_lowland").when((span < LOW[0]) & (std < LOW[1]), "lowland")
    found = found.when(span < HILLS, "hills").when(span < MOUNTAIN, "mountain").otherwise("high_mountain")
    return _tiled(cells, side).groupBy("tr", "tc").agg(found.alias("class"))


def gradient_slope(cells: DataFrame, pixel_m: float = 30.0) -> DataFrame:
    """r, c, slope in degrees by differences of both neighbours, of one where the other is missing, none where both are."""

    def along(before: str, after: str) -> Column:
        one = F.coalesce(F.col(after) - F.col("z"), F.col("z") - F.col(before), F.lit(0.0))
        return F.coalesce((F.col(after) - F.col(before)) / 2, one) / pixel_m

    steep = F.sqrt(F.pow(along("n", "s"), F.lit(2.0)) + F.pow(along("w", "e"), F.lit(2.0)))
    return grid.with_neighbours(cells).filter("z is not null").select("r", "c", F.degrees(F.atan(steep)).alias("slope"))


def slope_deviation(original: DataFrame, other: DataFrame, side: int = 256, pixel_m: float = 30.0) -> DataFrame:
    """tr, tc and how far the slopes of two rasters lie apart in each tile: cells with data in both, root mean square, mean,
    greatest and 95th percentile (between ranks linear; exact, as a tile's cells are bounded), in degrees."""
    both = gradient_slope(original, pixel_m).join(gradient_slope(other, pixel_m).withColumnRenamed("slope", "slope2"), ["r", "c"])
    d = F.abs(F.col("slope") - F.col("slope2"))
    return _tiled(both, side).withColumn("d", d).groupBy("tr", "tc").agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("rmse"), F.avg("d").alias("mean"), F.max("d").alias("greatest"), F.percentile("d", F.lit(0.95)).alias("p95"))


def overlapping_degree_tiles(boxes: DataFrame, inset: float = 0.001) -> DataFrame:
    """boxes: south, west, north, east and more -> a row for each 1-degree tile that a box touches, by name, the box drawn in
    by `inset` degrees on all sides."""
    rows, columns = (F.explode(F.sequence(F.floor(F.col(a) + inset), F.floor(F.col(b) - inset))) for a, b in (("south", "north"), ("west", "east")))
    return boxes.filter(f"north - south > {2 * inset} AND east - west > {2 * inset}").withColumn("t_lat", rows).withColumn("t_lon", columns).withColumn("name", F.expr(geo.degree_tile("t_lat", "t_lon"))).drop("t_lat", "t_lon")


def property_summary(features: DataFrame) -> DataFrame:
    """features: properties (map of text). By name: features that have it, numbers among its values with their least and
    greatest (null without), and how many different values."""
    each = features.select(F.explode("properties").alias("name", "value")).filter("value is not null")
    per = each.groupBy("name", "value").agg(F.count(F.lit(1)).alias("n")).withColumn("v", F.expr("nullif(nullif(nullif(try_cast(value AS double), double('NaN')), double('Infinity')), double('-Infinity'))"))
    return per.groupBy("name").agg(F.sum("n").alias("n_features"), F.sum(F.when(F.col("v").isNotNull(), F.col("n")).otherwise(0)).alias("n_numbers"), F.min("v").alias("least"), F.max("v").alias("greatest"), F.count(F.lit(1)).alias("n_values"))
