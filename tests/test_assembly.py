"""Candidate graphs against a plain assembly on a straight road, where every path is known."""

import math

import pytest
from pyspark.sql import functions as F

from wattroute.functions import physics
from wattroute.operators import assembly, routing

STEP = 0.05  # degrees between the nodes of the road


def metres(a, b):
    """Haversine."""
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371000.0 * math.asin(math.sqrt(h))


def flat(speed, delta):
    return F.col("length_m") * speed / 1000 + delta


def road(spark, n=60):
    nodes = [(i, 48.0 + i * STEP, 5.0) for i in range(n)] + [(900, 48.0, 8.0)]
    edges = [(a, b, 5560.0 + a, 80.0 + a % 5 * 20) for i in range(n - 1) for a, b in ((i, i + 1), (i + 1, i))]
    return spark.createDataFrame(nodes, "node_id bigint, lat double, lon double"), spark.createDataFrame(edges, "src bigint, dst bigint, length_m double, speed_kmh double"), {(e[0], e[1]): e[2:] for e in edges}


def evals(edges, a, b):
    """Distance and (time, energy) under each cap from node a to b along the road."""
    way = [edges[i, i + 1] for i in range(a, b)] if a <= b else [edges[i, i - 1] for i in range(a, b, -1)]
    out = []
    for cap in (None, 110.0, 100.0, 90.0):
        t = wh = before = 0.0
        for length, kmh in way:
            eff = min(kmh, cap or kmh)
            t, wh, before = t + length / (eff / 3.6), wh + length * eff / 1000 + eff - before, eff
        out.append((t, wh))
    return sum(x[0] for x in way), out


POINT = "request bigint, place int, lat double, lon double, override_soc double"
SITE = "site string, lat double, lon double, power_kw double"


def test_graph_of_a_straight_road(spark):
    nodes, roads, edges = road(spark)
    at = lambda i, east=0.001: (48.0 + i * STEP, 5.0 + east)
    sites = [("a", *at(5), 50.0), ("b", *at(5, 0.0015), 150.0), ("c", *at(7), 150.0), ("d", *at(20), 300.0), ("w", *at(30, 0.0005), 100.0), ("x", *at(40), 50.0), ("far", *at(41, 0.2), 300.0), ("y", *at(50), 150.0)]
    points = [(1, 0, *at(0), None), (1, 1, *at(30), 0.5), (1, 2, *at(59), None), (2, 0, *at(3), None), (2, 1, *at(22), None)]
    graph, legs, failures = assembly.assemble(spark.createDataFrame(points, POINT), spark.createDataFrame(sites, SITE), nodes, roads, flat)
    assert failures.count() == 0
    got = {(r.request, r.node): r for r in graph.collect()}
    names = lambda request: [got[k].site or got[k].kind for k in sorted(got) if k[0] == request]
    assert names(1) == ["origin", "b", "c", "d", "w", "x", "y", "dest"]  # a is a double of b; w is the waypoint's charger
    assert [got[1, i].kind for i in range(8)] == ["origin", "charger", "charger", "charger", "waypoint", "charger", "charger", "dest"]
    assert got[1, 4].power_kw == 100.0 and got[1, 4].override_soc == 0.5 and got[1, 0].power_kw is None
    # b leads beyond 20 km only (not to c), entries to all, everything to the end of its segment
    rows = {(r.request, r.src, r.dst): r for r in legs.collect()}
    assert sorted(k[1:] for k in rows if k[0] == 1) == [(0, 1), (0, 2), (0, 3), (0, 4), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4), (4, 5), (4, 6), (4, 7), (5, 6), (5, 7), (6, 7)]
    assert sorted(k[1:] for k in rows if k[0] == 2) == [(0, 1), (0, 2), (0, 3), (0, 4), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4)]
    for (request, a, b), r in rows.items():
        dist, four = evals(edges, got[request, a].road_node, got[request, b].road_node)
        assert r.dist_m == pytest.approx(dist) and [(e.time_s, e.energy_wh) for e in r.evals] == [pytest.approx(e) for e in four]


def test_shared_pairs_are_driven_once(spark):
    nodes, roads, edges = road(spark, 8)
    pairs = spark.createDataFrame([(0, 7), (0, 7), (7, 0), (3, 3), (0, 900)], "src bigint, dst bigint")
    got = assembly.drive(assembly.pair_paths(roads, pairs), roads, flat).collect()
    assert sorted((r.src, r.dst) for r in got) == [(0, 7), (7, 0)]
    for r in got:
        dist, four = evals(edges, r.src, r.dst)
        assert r.dist_m == pytest.approx(dist) and [(e.time_s, e.energy_wh) for e in r.evals] == [pytest.approx(e) for e in four]


def test_requests_without_a_graph(spark):
    nodes, roads, _ = road(spark, 8)
    points = [(1, 0, 48.0, 5.0, None), (1, 1, 60.0, 5.0, None), (2, 0, 48.0, 5.0, None), (2, 1, 48.0, 8.0, None), (3, 0, 48.0, 5.0, None), (3, 1, 48.1, 5.0, None)]
    graph, legs, failures = assembly.assemble(spark.createDataFrame(points, POINT), spark.createDataFrame([], SITE), nodes, roads, flat, car=physics.TWO_WHEEL)
    assert {r.request: r.problem for r in failures.collect()} == {1: "snap_failed", 2: "no_route"}
    assert [(r.request, r.kind) for r in graph.orderBy("ord").collect()] == [(3, "origin"), (3, "dest")]
    assert [(r.request, r.src, r.dst) for r in legs.collect()] == [(3, 0, 1)]


def test_unreachable_pairs_are_not_searched(spark):
    """A pair that no way joins costs nothing (before, its source was followed through the whole network)."""
    edges = spark.createDataFrame([(i, i + 1, 1000.0, 36.0) for i in range(10)], "src int, dst int, length_m double, speed_kmh double")
    reach = routing.reach_of_parts(edges)
    assert routing.costs_to(edges, spark.createDataFrame([(5, 1)], "source int, node int"), reach).count() == 0
    got = assembly.pair_paths(edges, spark.createDataFrame([(5, 1), (2, 4)], "src int, dst int"), reach).collect()
    assert sorted((r.src, r.dst, r.ord, r.a, r.b) for r in got) == [(2, 4, 0, 2, 3), (2, 4, 1, 3, 4)]
