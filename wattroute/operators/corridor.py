"""Chargers along a planned route: which lie in its corridor, which are doubles, which stand at a waypoint."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattroute.functions import geo, rules
from wattroute.operators import lines, spatial

DOUBLE_M, WAYPOINT_M, MOST = 300.0, 150.0, 300  # fixed values: nearer sites are one, a site so near is at the waypoint, sites of a journey
NEAR_M = 1000.0  # cells of this size tell which segments a point meets


def route_line(route_edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """route, pos (from 0), lat, lon, cum_m: the edges' vertices in order, each junction once, with the running distance.

    route_edges(route, ord, edge); vertices(edge, seq, lat, lon).
    """
    met = route_edges.join(vertices, "edge").where("seq > 0 or ord = 0")
    w = Window.partitionBy("route").orderBy("ord", "seq")
    step = geo.haversine_m(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
    met = met.withColumn("step", F.coalesce(step, F.lit(0.0))).withColumn("pos", F.row_number().over(w) - 1)
    return met.select("route", "pos", "lat", "lon", F.sum("step").over(w).alias("cum_m"))


def in_corridor(sites: DataFrame, line: DataFrame, width_m: float) -> DataFrame:
    """route, site, pos_m, off_m: sites up to ``width_m`` from a sample of the line, at the running distance of the nearest (first) one.

    sites(site, lat, lon); line(route, pos, lat, lon, cum_m), sampled coarsely. An equi-join on cells; a site of a route is one row after partial aggregation.
    """
    point = F.struct("route", "pos", "cum_m")
    pairs = spatial.within(sites.select(F.col("site").alias("id"), "lat", "lon"), line.select(point.alias("id"), "lat", "lon"), width_m, keep_same=True)
    best = pairs.groupBy(F.col("other_id.route").alias("route"), F.col("id").alias("site")).agg(F.min(F.struct(F.round("distance_m", 6).alias("d"), F.col("other_id.pos").alias("pos"), F.col("other_id.cum_m").alias("cum_m"))).alias("b"))
    return best.select("route", "site", F.col("b.cum_m").alias("pos_m"), F.col("b.d").alias("off_m"))


def drop_doubles(candidates: DataFrame, keys: list[str], metres: float = DOUBLE_M) -> DataFrame:
    """Candidates (keys, ord, lat, lon, power_kw) without doubles: in order, each still there drops the later ones near it that are
    not stronger, up to the first that is, for which it goes itself.

    Who is near comes from the cell join, so the ordered part looks at each candidate's short list alone. The candidates of a key stream by in
    order; what is remembered is which of the later ones are gone.
    """
    placed = candidates.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy("ord")))
    at = placed.select(*keys, "lat", "lon", F.struct(*keys, "_place", "power_kw").alias("id"))
    later = spatial.within(at, at, metres, keys=tuple(keys)).where("other_id._place > id._place")
    other = F.struct(F.col("other_id._place").alias("place"), (F.col("other_id.power_kw") > F.col("id.power_kw")).alias("stronger"))
    near = later.groupBy(*[F.col(f"id.{c}").alias(c) for c in keys], F.col("id._place").alias("_place")).agg(F.array_sort(F.collect_list(other)).alias("_near"))
    rows = placed.join(near, [*keys, "_place"], "left").select(*candidates.columns, "_place", "_near")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gone: set[int] = set()
        for batch in batches:
            stays = []
            for place, near in zip(batch.column("_place").to_pylist(), batch.column("_near").to_pylist(), strict=True):
                if place == 1:
                    gone = set()
                if place in gone:
                    gone.remove(place)
                    stays.append(False)
                    continue
                here = [x for x in near or [] if x["place"] not in gone]
                upto = next((i for i, x in enumerate(here) if x["stronger"]), len(here))
                gone.update(x["place"] for x in here[:upto])
                stays.append(upto == len(here))
            yield batch.filter(pa.array(stays, pa.bool_()))

    ordered = rows.repartition(*[F.col(c) for c in keys]).sortWithinPartitions(*keys, "_place")
    return ordered.mapInArrow(kept, rows.schema).select(*candidates.columns)


def strongest_overall(candidates: DataFrame, key: str, most: int = MOST) -> DataFrame:
    """At most ``most`` candidates of a journey: the weakest go first, of equals the earlier."""
    w = Window.partitionBy(key).orderBy(F.desc("power_kw"), F.desc("segment"), F.desc("ord"))
    return candidates.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def merge_waypoints(candidates: DataFrame, waypoints: DataFrame, metres: float = WAYPOINT_M) -> tuple[DataFrame, DataFrame]:
    """(route, waypoint, site of the strongest candidate at it; the candidates left).

    A waypoint looks at the segments before and after it (numbers waypoint and waypoint + 1); of equally strong ones the first counts, and
    all candidates at a waypoint that has one leave both segments. candidates(route, segment, ord, site, lat, lon, power_kw).
    """
    around = waypoints.select("route", "waypoint", F.col("lat").alias("w_lat"), F.col("lon").alias("w_lon"), F.explode(F.array(F.col("waypoint"), F.col("waypoint") + 1)).alias("segment"))
    near = candidates.join(around, ["route", "segment"]).where(geo.haversine_m(F.col("lat"), F.col("lon"), F.col("w_lat"), F.col("w_lon")) <= metres)
    best = near.groupBy("route", "waypoint").agg(F.min_by("site", F.struct(-F.col("power_kw"), "segment", "ord")).alias("site"))
    left = candidates.join(near.select("route", "segment", "ord").distinct(), ["route", "segment", "ord"], "left_anti")
    return best, left


def project(points: DataFrame, line: DataFrame, key: str) -> DataFrame:
    """Each point (key, id, lat, lon) with the nearest place of its line: along_m, off_m; the first segment of equals.

    line(key, pos, lat, lon, cum_m). A point meets the segments of its line in the cells around it; only points farther than NEAR_M from all of it meet the whole line.
    """
    ends = [F.col(c) for c in ("lat_a", "lon_a", "lat_b", "lon_b")]
    measure = lambda lat, lon: (rules.segment_share(lat, lon, *ends), F.round(rules.segment_distance_m(lat, lon, *ends), 6))
    best, _ = lines.nearest(points.withColumnRenamed(key, "line"), lines.segments(line.withColumnRenamed(key, "line")), NEAR_M, measure)
    return best.select(F.col("line").alias(key), "id", F.col("c.along_m").alias("along_m"), F.col("c.off_m").alias("off_m"))
