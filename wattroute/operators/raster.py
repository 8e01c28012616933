"""Elevation from raster tiles of one degree, by an equi-join of each point's four grid cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ABSURD_M = 9000.0  # fixed value: readings farther from sea level are none


def sample(points: DataFrame, tiles: DataFrame, cells: DataFrame) -> DataFrame:
    """id, elevation_m (float) of each point (id, lat, lon): bilinear between the centres of the four cells around it.

    tiles(tile_lat, tile_lon, width, height): south-west corner and size of the grids; cells(tile_lat, tile_lon, row, col, metres): row 0 in the
    north, col 0 in the west, rows without a reading left out or null. Beyond a tile's outer centres its edge counts. Points without a tile are at
    sea; a missing cell or an absurd height gives 0. Points of a null place have no elevation.
    """
    at = points.where("lat is not null and lon is not null").select("id", "lat", "lon", F.floor("lat").cast("int").alias("tile_lat"), F.floor("lon").cast("int").alias("tile_lon"))
    placed = at.join(tiles, ["tile_lat", "tile_lon"], "left")
    y = F.least(F.greatest(F.col("height") * (F.col("tile_lat") + 1 - F.col("lat")) - 0.5, F.lit(0.0)), (F.col("height") - 1).cast("double"))
    x = F.least(F.greatest(F.col("width") * (F.col("lon") - F.col("tile_lon")) - 0.5, F.lit(0.0)), (F.col("width") - 1).cast("double"))
    placed = placed.withColumn("y", y).withColumn("x", x).withColumn("r0", F.floor("y").cast("int")).withColumn("c0", F.floor("x").cast("int")).withColumn("fr", F.col("y") - F.col("r0")).withColumn("fc", F.col("x") - F.col("c0"))
    corner = lambda dr, dc, share: F.struct(F.least(F.col("r0") + dr, F.col("height") - 1).alias("row"), F.least(F.col("c0") + dc, F.col("width") - 1).alias("col"), share.alias("share"))
    fr, fc = F.col("fr"), F.col("fc")
    four = F.array(corner(0, 0, (1 - fr) * (1 - fc)), corner(0, 1, (1 - fr) * fc), corner(1, 0, fr * (1 - fc)), corner(1, 1, fr * fc))
    asked = placed.where("height is not null").select("id", "tile_lat", "tile_lon", F.explode(four).alias("k")).select("id", "tile_lat", "tile_lon", "k.*").where("share > 0")
    met = asked.join(cells, ["tile_lat", "tile_lon", "row", "col"], "left")
    got = met.groupBy("id").agg(F.when(F.bool_and(F.col("metres").isNotNull()), F.sum(F.col("share") * F.col("metres"))).alias("m"))
    sane = F.when(F.abs("m") <= ABSURD_M, F.col("m")).otherwise(0.0)
    return points.select("id", "lat", "lon").join(got, "id", "left").select("id", F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), F.coalesce(sane, F.lit(0.0))).cast("float").alias("elevation_m"))
