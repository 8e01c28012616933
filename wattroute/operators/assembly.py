"""The graph of candidate stops of each request, assembled for many requests at once.

A request is a row of points: origin, waypoints, destination. Points are snapped to the road network, consecutive points routed, chargers near
each route become candidates, and the legs that a plan may want are decided by cheap rules. Only then are legs driven: the distinct
pairs of road nodes over all requests, each once, under every speed cap; requests that share a pair share its row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattroute.functions import geo, physics, rules
from wattroute.operators import asof, corridor, routing, sequences, spatial
from wattroute.operators.charging import CAPS_KMH
from wattroute.operators.rounds import durable

CORRIDOR_M, WIDE_M, GAP_M, FANOUT = 3000.0, 10_000.0, 20_000, 30  # fixed values: widths of the narrow and the wide corridor, least way to the next stop, most next stops


def drive(paths: DataFrame, edges: DataFrame, energy: Callable[[Column, Column], Column]) -> DataFrame:
    """src, dst, dist_m, evals: time and energy of each pair's path under every speed cap, from standstill.

    paths(src, dst, ord, a, b): the edges (a, b) of each pair in order. energy(speed, change of speed) of an edge.
    """
    cheapest = edges.where("speed_kmh > 0").groupBy(F.col("src").alias("a"), F.col("dst").alias("b")).agg(F.min_by(F.struct(*[c for c in edges.columns if c not in ("src", "dst")]), F.struct(F.col("length_m") / F.col("speed_kmh"), "length_m")).alias("e"))
    rows = paths.join(cheapest, ["a", "b"]).select("src", "dst", "ord", "e.*")
    caps = F.array(*[F.struct(F.lit(i).alias("cap"), F.lit(c or float("inf")).alias("kmh")) for i, c in enumerate(CAPS_KMH)])
    rows = rows.withColumn("c", F.explode(caps)).withColumn("eff", F.least("speed_kmh", "c.kmh")).withColumn("cap", F.col("c.cap"))
    before = F.lag("eff").over(Window.partitionBy("src", "dst", "cap").orderBy("ord"))
    rows = rows.withColumn("delta", F.col("eff") - F.coalesce(before, F.lit(0.0)))
    each = rows.groupBy("src", "dst", "cap").agg(F.sum("length_m").alias("dist_m"), F.sum(F.col("length_m") / (F.col("eff") / 3.6)).alias("time_s"), F.sum(energy(F.col("eff"), F.col("delta"))).alias("energy_wh"))
    ordered = F.array_sort(F.collect_list(F.struct("cap", "time_s", "energy_wh")))
    return each.groupBy("src", "dst").agg(F.max("dist_m").alias("dist_m"), F.transform(ordered, lambda x: F.struct(x["time_s"].alias("time_s"), x["energy_wh"].alias("energy_wh"))).alias("evals"))


def pair_paths(edges: DataFrame, pairs: DataFrame, reach: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """src, dst, ord, a, b: the edges of the quickest path of every distinct pair that is joined; none for a pair of one node."""
    wanted = durable(pairs.select("src", "dst").where("src is not null and dst is not null and src <> dst").distinct())
    costs = durable(routing.costs_to(edges, wanted.select(F.col("src").alias("source"), F.col("dst").alias("node")), reach))
    walked = durable(routing.routes(edges, costs, wanted.select(F.col("src").alias("source"), F.col("dst").alias("target"))))
    w = Window.partitionBy("source", "target").orderBy(F.desc("back"))
    steps = walked.select(F.col("source").alias("src"), F.col("target").alias("dst"), (F.row_number().over(w) - 1).alias("ord"), F.col("node").alias("a"), F.lead("node").over(w).alias("b"))
    return steps.where("b is not null")


def _lines(segments: DataFrame, paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """route (request and segment), pos, lat, lon, cum_m along each segment's path."""
    named = segments.select(F.struct("request", "segment").alias("route"), "src", "dst").join(paths, ["src", "dst"]).select("route", "ord", F.struct("a", "b").alias("edge"))
    used = named.select("edge").distinct()
    ends = used.select("edge", F.explode(F.array(F.struct(F.lit(0).alias("seq"), F.col("edge.a").alias("node_id")), F.struct(F.lit(1).alias("seq"), F.col("edge.b").alias("node_id")))).alias("v"))
    vertices = ends.select("edge", "v.seq", "v.node_id").join(nodes.select("node_id", "lat", "lon"), "node_id").select("edge", "seq", "lat", "lon")
    return corridor.route_line(named, vertices)


def assemble(
    points: DataFrame, sites: DataFrame, nodes: DataFrame, edges: DataFrame, energy: Callable[[Column, Column], Column], width_m: float = CORRIDOR_M, gap_m: int = GAP_M, car: physics.Vehicle = physics.TWO_WHEEL,
    reach: tuple[DataFrame, DataFrame] | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, legs, failures) of the requests' candidate graphs, as charging.solve() takes them.

    points(request, place: 0 origin, then waypoints, then destination, lat, lon, override_soc); sites(site, lat, lon, power_kw);
    nodes(node_id, lat, lon); edges(src, dst, length_m, speed_kmh and what ``energy`` reads).
    nodes: request, node, ord, kind, power_kw, override_soc, site, road_node; legs: request, leg, src, dst, dist_m, evals.
    ``reach``: routing.reach_of_parts(edges), if it is known already.
    failures: request, problem: a point that can't be snapped, consecutive points that no way joins. Such requests have no graph.
    """
    numbered = points.withColumn("id", F.struct("request", "place"))
    snapped = numbered.join(spatial.nearest_node(numbered.select("id", "lat", "lon"), nodes), "id").drop("id")
    placed = durable(snapped.withColumn("last", F.col("place") == F.max("place").over(Window.partitionBy("request"))))
    w = Window.partitionBy("request").orderBy("place")
    segments = placed.select("request", F.col("place").alias("segment"), F.col("node_id").alias("src"), F.lead("node_id").over(w).alias("dst"), "last").where("not last").drop("last")
    segments = durable(segments)
    reach = reach or routing.reach_of_parts(edges)
    paths = durable(pair_paths(edges, segments, reach))
    joined = paths.select("src", "dst").distinct().withColumn("joined", F.lit(True))
    lost = segments.join(joined, ["src", "dst"], "left").where("src is not null and dst is not null and src <> dst and joined is null").select("request", F.lit("no_route").alias("problem"))
    failures = durable(placed.where("node_id is null").select("request", F.lit("snap_failed").alias("problem")).unionByName(lost).groupBy("request").agg(F.max("problem").alias("problem")))
    good = segments.join(failures, "request", "left_anti")

    line = durable(_lines(good, paths, nodes))
    near = corridor.in_corridor(sites.select("site", "lat", "lon"), sequences.downsample(line, "route", "pos", "cum_m"), width_m)
    found = near.join(sites, "site").select(F.col("route.request").alias("request"), F.col("route.segment").alias("segment"), F.struct("pos_m", "site").alias("ord"), "pos_m", "site", "lat", "lon", "power_kw")
    single = corridor.drop_doubles(durable(found), ["request", "segment"])
    capped = corridor.strongest_overall(single, "request")
    on_road = spatial.nearest_node(capped.select("site", "lat", "lon").dropDuplicates(["site"]).withColumnRenamed("site", "id"), nodes).where("node_id is not null")
    kept = durable(capped.join(on_road.withColumnRenamed("id", "site"), "site").withColumnRenamed("request", "route"))
    between = placed.where("place > 0 and not last").join(failures, "request", "left_anti")
    waypoints = between.select(F.col("request").alias("route"), (F.col("place") - 1).alias("waypoint"), "lat", "lon")
    at_waypoint, others = corridor.merge_waypoints(kept, waypoints)

    power = F.broadcast(at_waypoint) if at_waypoint.count() <= 10_000 else at_waypoint
    of = placed.join(failures, "request", "left_anti").join(power.select(F.col("route").alias("request"), (F.col("waypoint") + 1).alias("place"), "site"), ["request", "place"], "left").join(sites.select("site", "power_kw"), "site", "left")
    kind = F.when(F.col("place") == 0, "origin").when(F.col("last"), "dest").otherwise("waypoint")
    fixed = of.select("request", F.col("place").alias("segment"), F.lit(0.0).alias("pos_m"), kind.alias("kind"), "site", "power_kw", F.when(kind == "waypoint", F.col("override_soc")).alias("override_soc"), "lat", "lon", F.col("node_id").alias("road_node"))
    chargers = others.select(F.col("route").alias("request"), "segment", "pos_m", F.lit("charger").alias("kind"), "site", "power_kw", F.lit(None).cast("double").alias("override_soc"), "lat", "lon", F.col("node_id").alias("road_node"))
    place = Window.partitionBy("request").orderBy("segment", F.col("kind") == "charger", "pos_m", "site")
    graph = durable(fixed.unionByName(chargers).withColumn("ord", F.row_number().over(place) - 1).withColumn("node", F.col("ord").cast("bigint")))

    # wanted legs: from a segment's entry to all of its chargers, from a charger to those ahead beyond the gap, from both to the segment's end
    inner = graph.where("kind <> 'dest'")
    in_reach = rules.straight_line_ok(geo.haversine_m(F.col("lat"), F.col("lon"), F.col("to_lat"), F.col("to_lon")), F.lit(car.capacity_kwh * 1000))
    keyed = graph.where("kind = 'charger'").withColumn("key", F.struct("request", "segment"))
    onward = asof.ahead(keyed.select("key", F.col("node").alias("site"), "pos_m"), "key", "site", "pos_m", gap_m, FANOUT).select(F.col("key.request").alias("request"), F.col("site").alias("src"), F.col("ahead").alias("dst"))
    entry = graph.where("kind in ('origin', 'waypoint')").select("request", "segment", F.col("node").alias("src"))
    first = entry.join(graph.where("kind = 'charger'").select("request", "segment", F.col("node").alias("dst")), ["request", "segment"]).select("request", "src", "dst")
    end = graph.where("kind in ('waypoint', 'dest')").select("request", (F.col("segment") - 1).alias("segment"), F.col("node").alias("dst"))
    close = inner.select("request", "segment", F.col("node").alias("src"), "kind").join(end, ["request", "segment"])
    ways = onward.unionByName(first).withColumn("always", F.lit(False)).unionByName(close.select("request", "src", "dst", (F.col("kind") != "charger").alias("always")))
    a = graph.select("request", F.col("node").alias("src"), "lat", "lon", F.col("road_node").alias("from_road"))
    b = graph.select("request", F.col("node").alias("dst"), F.col("lat").alias("to_lat"), F.col("lon").alias("to_lon"), F.col("road_node").alias("to_road"))
    wanted = durable(ways.join(a, ["request", "src"]).join(b, ["request", "dst"]).where(F.col("always") | in_reach).select("request", "src", "dst", "from_road", "to_road"))

    pairs = durable(wanted.select(F.col("from_road").alias("src"), F.col("to_road").alias("dst")).distinct())
    driven = drive(paths.unionByName(pair_paths(edges, pairs.join(joined, ["src", "dst"], "left_anti"), reach)), edges, energy)
    still = F.array(*[F.struct(F.lit(0.0).alias("time_s"), F.lit(0.0).alias("energy_wh")) for _ in CAPS_KMH])
    driven = driven.join(pairs, ["src", "dst"], "left_semi").unionByName(pairs.where("src = dst").select("src", "dst", F.lit(0.0).alias("dist_m"), still.alias("evals")))
    legs = wanted.join(driven.select(F.col("src").alias("from_road"), F.col("dst").alias("to_road"), "dist_m", "evals"), ["from_road", "to_road"])
    leg = (F.row_number().over(Window.partitionBy("request").orderBy("src", "dst")) - 1).cast("bigint")
    return graph.select("request", "node", "ord", "kind", "power_kw", "override_soc", "site", "road_node"), legs.select("request", leg.alias("leg"), "src", "dst", "dist_m", "evals"), failures


def waypoints_ahead(waypoints: DataFrame, current: DataFrame) -> DataFrame:
    """Waypoints of a journey that is planned anew: those that lie ahead of where it is; what could not be placed on the route stays.

    waypoints(request, waypoint, along_m: null if not placed); current(request, along_m). A journey without a place keeps all.
    """
    at = current.select("request", F.col("along_m").alias("now_m"))
    return waypoints.join(at, "request", "left").where(F.coalesce(F.col("along_m") > F.col("now_m"), F.lit(True))).select(*waypoints.columns)
