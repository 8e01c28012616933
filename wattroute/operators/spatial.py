"""Spatial joins with a cell key, so that they are equi-joins and never compare all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattroute.functions import geo
from wattroute.operators.rounds import durable

SHARES = 16  # cells of a wide cell, to a side


def around(df: DataFrame, size: float) -> DataFrame:
    """Each row nine times, keyed by the cells around its own."""
    near = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    out = df.withColumn("cy", F.explode(F.transform(near, lambda i: geo.cell(F.col("lat"), size) + i)))
    return out.withColumn("cx", F.explode(F.transform(near, lambda i: geo.cell(F.col("lon"), size) + i)))


def _distinct_nodes(nodes: DataFrame) -> DataFrame:
    """node_id, node_lat, node_lon: the smallest id of each place that has nodes."""
    return nodes.where("node_id is not null").groupBy(F.col("lat").alias("node_lat"), F.col("lon").alias("node_lon")).agg(F.min("node_id").alias("node_id"))


def _nearest(places: DataFrame, n: DataFrame, size: float) -> DataFrame:
    """lat, lon, d, node_id of the places (lat, lon) that have a node in the 3x3 cells around them.

    Cells of a part of the size come first. All nodes nearer than such a cell is wide are seen there, so that a hit within that is final; a place
    goes on to wider cells only as long as its nodes are sparse, and meets many nodes only if they are all far away.
    """
    left, out = places, None
    for part in (size / 64, size / 8, size):
        keyed = n.select("*", geo.cell(F.col("node_lat"), part).alias("cy"), geo.cell(F.col("node_lon"), part).alias("cx"))
        d = F.round(geo.flat_distance_sq(F.col("lat"), F.col("lon"), F.col("node_lat"), F.col("node_lon")), 15)
        best = around(left, part).join(keyed, ["cy", "cx"]).groupBy("lat", "lon").agg(F.min(F.struct(d.alias("d"), "node_id")).alias("best"))
        best = durable(best.select("lat", "lon", "best.*"))
        if part < size:
            best = best.where(F.col("d") < F.pow(part * F.cos(F.radians("lat")), F.lit(2.0)) * (1 - 1e-6) - 2e-15)
            left = durable(left.join(best.select("lat", "lon"), ["lat", "lon"], "left_anti"))
        out = best if out is None else out.unionByName(best)
    return out


def _for_points(points: DataFrame, found: DataFrame) -> DataFrame:
    """id, node_id: what was found for the place of each point."""
    met = points.select("id", "lat", "lon").join(found, ["lat", "lon"], "left")
    best = F.min(F.when(F.col("node_id").isNotNull(), F.struct("d", "node_id")))
    return met.groupBy("id").agg(best.alias("best")).select("id", F.col("best.node_id").alias("node_id"))


def _places(points: DataFrame) -> DataFrame:
    return durable(points.where("lat is not null and lon is not null").select("lat", "lon").distinct())


def nearest_node(points: DataFrame, nodes: DataFrame, size: float = 0.1) -> DataFrame:
    """id, node_id: the node of least flat distance in the 3x3 cells around each point; smallest id on ties, null if none.

    Points at one place are answered once, and of nodes at one place the smallest is asked.
    """
    return _for_points(points, _nearest(_places(points), durable(_distinct_nodes(nodes)), size))


def nearest_node_anywhere(points: DataFrame, nodes: DataFrame, size: float = 0.1) -> DataFrame:
    """As nearest_node; points whose nine cells hold no node get the nearest of all nodes, from ever wider cells.

    In cells of size s every node nearer than s * cos(lat) degrees is seen, so a hit within that is final; the
    others go on with eight times the size. A point takes part in as many rounds as it is far from any node. In wide cells a point meets only the
    nodes of the narrower cells (SHARES to a side) that can hold its nearest: a cell counts if its nearest corner is no farther than the farthest
    corner of some other cell. The points left are written each round, so plans do not grow.
    """
    places, nodes = _places(points), durable(_distinct_nodes(nodes))
    out = _nearest(places, nodes, size)
    left = durable(places.join(out.select("lat", "lon"), ["lat", "lon"], "left_anti"))
    while size < 360 and not left.isEmpty():
        size *= 8
        part = size / SHARES
        n = nodes.select("*", geo.cell(F.col("node_lat"), part).alias("py"), geo.cell(F.col("node_lon"), part).alias("px"))
        boxes = n.groupBy("py", "px").agg(*[f(c).alias(f"{f.__name__}_{c}") for c in ("node_lat", "node_lon") for f in (F.min, F.max)])
        boxes = boxes.withColumn("cy", F.floor(F.col("py") / SHARES)).withColumn("cx", F.floor(F.col("px") / SHARES))
        met = around(left, size).join(boxes, ["cy", "cx"])
        gap = lambda c: F.greatest(F.col(f"min_node_{c}") - F.col(c), F.col(c) - F.col(f"max_node_{c}"), F.lit(0.0))
        reach = lambda c: F.greatest(F.abs(F.col(f"min_node_{c}") - F.col(c)), F.abs(F.col(f"max_node_{c}") - F.col(c)))
        square = lambda of: of("lat") * of("lat") + F.pow(of("lon") * F.cos(F.radians("lat")), F.lit(2.0))
        near = durable(met.select("lat", "lon", "py", "px", square(gap).alias("near"), square(reach).alias("far")))
        bound = near.groupBy("lat", "lon").agg(F.min("far").alias("bound"))
        asked = near.join(bound, ["lat", "lon"]).where(F.col("near") <= F.col("bound") * (1 + 1e-9) + 1e-12)
        d = geo.flat_distance_sq(F.col("lat"), F.col("lon"), F.col("node_lat"), F.col("node_lon"))
        best = asked.join(n, ["py", "px"]).groupBy("lat", "lon").agg(F.min(F.struct(F.round(d, 15).alias("d"), "node_id")).alias("best"))
        best = durable(best.select("lat", "lon", "best.*"))
        done = best.where(F.lit(size >= 360) | (F.sqrt("d") <= size * F.cos(F.radians("lat"))))
        out, left = out.unionByName(done), durable(left.join(done.select("lat", "lon"), ["lat", "lon"], "left_anti"))
    return _for_points(points, out)


def _columns(band: Column, size: float, degrees: float) -> Column:
    """Number of cells around the globe in a band of latitude: each at least as wide as ``degrees`` of a great circle in the bands next to it."""
    worst = F.least(F.lit(90.0), F.greatest(F.abs(band - 1), F.abs(band + 2)) * size)
    return F.greatest(F.lit(1), F.floor(F.cos(F.radians(worst)) * (360 / (1.02 * degrees)))).cast("bigint")


def within(points: DataFrame, others: DataFrame, metres: float, keep_same: bool = False, keys: tuple[str, ...] = ()) -> DataFrame:
    """Pairs (id, other_id, distance_m) up to ``metres`` apart; near the poles and across longitude 180 too. Each point with
    itself is left out (with ``keep_same`` not: the sides hold different things). With ``keys`` only rows of equal keys meet.

    Cells are bands of latitude cut into as many columns as the band's narrowest circle allows; columns wrap around.
    """
    degrees = metres / geo.EARTH_M * (180 / 3.141592653589793)
    size = 1.001 * degrees
    column = lambda lon, n: F.pmod(F.floor((lon + 180) / 360 * n), n)
    band = geo.cell(F.col("lat"), size)
    b = others.select(*keys, F.col("id").alias("other_id"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), band.alias("cy"), column(F.col("lon"), _columns(band, size, degrees)).alias("cx"))
    near = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    asked = points.select(*keys, "id", "lat", "lon", F.explode(F.transform(near, lambda i: band + i)).alias("cy"))
    n = _columns(F.col("cy"), size, degrees)
    asked = asked.select(*keys, "id", "lat", "lon", "cy", F.explode(F.array_distinct(F.transform(near, lambda i: F.pmod(column(F.col("lon"), n) + i, n)))).alias("cx"))
    d = geo.haversine_m(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))
    pairs = asked.join(b, ["cy", "cx", *keys]).withColumn("distance_m", d)
    near = pairs.where(F.col("distance_m") <= metres)
    return (near if keep_same else near.where(F.col("id") != F.col("other_id"))).select("id", "other_id", "distance_m")
