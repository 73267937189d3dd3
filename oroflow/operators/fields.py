"""Direction fields splatted from paths, and their values at points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Stride along and across a leg, reach of its influence (degrees), power of its decay, least magnitude.
STRIDE, REACH, DECAY, LEAST = 0.5, 8.0, 1.5, 0.001


def _cells(lon: Column, lat: Column) -> dict[str, Column]:
    return {"gx": F.floor(lon + 180.0).cast("int"), "gy": F.floor(90.0 - lat).cast("int")}


def flow_field(paths: DataFrame) -> DataFrame:
    """paths: line, i, lon, lat. A globe of 1-degree cells (gx from 180 W, gy from 90 N): the mean direction of the legs
    within 8 degrees, as a unit vector (dx, dy), and the sum's magnitude; cells that nothing reaches have no row.

    A leg gives its direction to the cells under points half a degree apart along and across it, by (1 - distance / 8) to
    the power of 1.5. Legs over the date line (more than 180 degrees of longitude) and of less than 0.01 degree give
    nothing, nor do places without a coordinate, which break a path. A vector of a magnitude of 0.001 or less stays as it
    is. Each task sums what it splats before anything is shuffled, at most 64,800 rows a task."""
    order = Window.partitionBy("line").orderBy("i")
    legs = paths.withColumns({"x2": F.lead("lon").over(order), "y2": F.lead("lat").over(order)})
    legs = legs.withColumns({"dx": F.col("x2") - F.col("lon"), "dy": F.col("y2") - F.col("lat")}).filter("abs(dx) <= 180")
    legs = legs.withColumn("len", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))).filter("len >= 0.01e0")
    legs = legs.withColumns({"ux": F.col("dx") / F.col("len"), "uy": F.col("dy") / F.col("len"), "steps": F.ceil(F.col("len") / STRIDE).cast("int")})
    along = legs.withColumn("s", F.explode(F.sequence(F.lit(0), "steps"))).withColumns({"cx": F.col("lon") + F.col("s") / F.col("steps") * F.col("dx"), "cy": F.col("lat") + F.col("s") / F.col("steps") * F.col("dy")})
    half = int(REACH / STRIDE)
    across = along.withColumn("off", F.explode(F.sequence(F.lit(-half), F.lit(half)))).withColumn("off", F.col("off") * F.lit(STRIDE))
    spread = across.withColumns(_cells(F.col("cx") - F.col("uy") * F.col("off"), F.col("cy") + F.col("ux") * F.col("off"))).filter("gx between 0 and 359 and gy between 0 and 179")
    w = F.pow(1.0 - F.abs("off") / REACH, F.lit(DECAY))
    summed = spread.groupBy("gx", "gy").agg(F.sum(F.col("ux") * w).alias("sx"), F.sum(F.col("uy") * w).alias("sy"))
    summed = summed.withColumn("mag", F.sqrt(F.col("sx") * F.col("sx") + F.col("sy") * F.col("sy")))
    unit = lambda v: F.when(F.col("mag") > LEAST, F.col(v) / F.col("mag")).otherwise(F.col(v))
    return summed.select("gx", "gy", unit("sx").alias("dx"), unit("sy").alias("dy"), "mag")


def flow_at(points: DataFrame, field: DataFrame) -> DataFrame:
    """points: pid, lat, lon. The field's vector at the cell whose corner is nearest; zeros where there is none. A field
    has 64,800 cells at most, so it goes to every task."""
    at = points.withColumns(_cells(F.col("lon") + 0.5, F.col("lat") - 0.5))
    zero = lambda v: F.coalesce(v, F.lit(0.0)).alias(v)
    return at.join(F.broadcast(field), ["gx", "gy"], "left").select("pid", zero("dx"), zero("dy"), zero("mag"))


def advected(points: DataFrame, field: DataFrame, speed: float, steps: int, least: float = 0.01) -> DataFrame:
    """points: pid, lat, lon, carried along the field: each step moves a point by speed degrees along the vector of its cell
    where the magnitude is above `least`. A point that leaves the globe's range stays where it left, with out = true."""
    here = points.select("pid", "lat", "lon", (F.col("lat").isNull() | F.col("lon").isNull()).alias("out"))
    for _ in range(steps):
        go = ~F.col("out") & (F.coalesce("mag", F.lit(0.0)) > least)
        met = here.withColumns(_cells(F.col("lon") + 0.5, F.col("lat") - 0.5)).join(F.broadcast(field), ["gx", "gy"], "left")
        moved = met.select("pid", F.when(go, F.col("lat") + F.col("dy") * speed).otherwise(F.col("lat")).alias("lat"), F.when(go, F.col("lon") + F.col("dx") * speed).otherwise(F.col("lon")).alias("lon"), "out")
        here = moved.withColumn("out", F.col("out") | ~F.col("lat").between(-90, 90) | ~F.col("lon").between(-180, 180))
    return here
