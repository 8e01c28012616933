"""Streams with state, and literal cases of the planning operators."""

import heapq
import math

import pytest
from pyspark.sql import functions as F

from wattroute.functions import rules
from wattroute.operators import asof, routing, spatial
from wattroute.plans import catalogue, planning
from wattroute.sources.views import view
from wattroute.streaming import sessions

DATA = "/root/testdata/sf0.001"


def test_lines_of_a_stream(spark, tmp_path):
    schema = "session bigint, seq int, chunk string"
    for name, rows in (("a", [(1, 0, "7EC 0"), (1, 1, "3 62\r\r>A"), (2, 0, ">")]), ("b", [(1, 2, "T\nOK"), (1, 3, None)]), ("c", [(1, 4, ">"), (2, 1, "rest")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{name}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = sessions.lines(stream).writeStream.outputMode("append").format("memory").queryName("adapter").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted(map(tuple, spark.table("adapter").collect()))
    assert got == sorted([(1, "7EC 03 62"), (1, ">"), (1, "AT"), (1, "OK"), (1, ">"), (2, ">")])


def test_payloads(spark):
    rows = [(1, 1, 0, "0362F190AAAAAAAA"), (1, 2, 0, "100A620101020304"), (1, 2, 1, "2105060708090000"), (1, 3, 0, "100A620101020304"), (1, 3, 1, "2205060708"), (2, 1, 0, "2105"), (2, 2, 0, "00"), (2, 3, 0, None)]
    got = sorted(map(tuple, sessions.payloads(spark.createDataFrame(rows, "session bigint, request bigint, seq int, frame string")).collect()))
    assert got == [(1, 1, "62F190", None), (1, 2, "62010102030405060708", None), (1, 3, None, "sequence"), (2, 1, None, "unexpected"), (2, 2, None, "length")]


def test_travel_costs_without_limit(spark):
    edges = spark.createDataFrame([(i, i + 1, 1000.0, 36.0) for i in range(12)] + [(0, 12, 90000.0, 36.0), (0, 5, 1000.0, 36.0), (3, 3, 1.0, 36.0), (7, 0, 1.0, 0.0)], "src int, dst int, length_m double, speed_kmh double")
    costs = routing.travel_costs(edges, spark.createDataFrame([(0,), (0,), (11,), (None,)], "node_id int"))
    got = {(r.source, r.node): r.cost_s for r in costs.collect()}
    assert got[0, 12] == 800.0 and got[0, 4] == 400.0 and got[11, 12] == 100.0 and (11, 0) not in got and got[0, 0] == 0.0
    route = routing.routes(edges, costs, spark.createDataFrame([(0, 7), (11, 0)], "source int, target int"))
    assert [r.node for r in route.orderBy(F.desc("back")).collect()] == [0, 5, 6, 7]


def test_asof_edges(spark):
    q, a = spark.createDataFrame([("k", 0.0), ("k", 5.0), ("z", 1.0)], "k string, at double"), spark.createDataFrame([("k", 10.0, 1.0), ("k", 20.0, 3.0)], "k string, x double, y double")
    assert {(r.k, r.at): r.next for r in asof.next_after(q, a, "k", "at", "x", 10.0).collect()} == {("k", 0.0): 20.0, ("k", 5.0): 20.0, ("z", 1.0): None}
    q = spark.createDataFrame([("k", 0.0), ("k", 15.0), ("k", 30.0), ("z", 1.0)], "k string, at double")
    assert {(r.k, r.at): r.y for r in asof.interpolate(q, a, "k", "at", "x", "y").collect()} == {("k", 0.0): 1.0, ("k", 15.0): 2.0, ("k", 30.0): 3.0, ("z", 1.0): None}


def test_tiers(spark):
    d = lambda *x: spark.range(1).select(rules.speech_tier(*map(F.lit, x))).first()[0]
    assert [d(40.0, 0.0, 1.0), d(100.0, 10.0, 99.0), d(100.0, 10.0, 100.0), d(700.0, 10.0, 400.0), d(701.0, 10.0, 400.0)] == [3, 0, 2, 1, 0]


def test_leg_starts_from_standstill(spark):
    """The first edge of a leg pays for its whole speed, by a literal value of the rule: 100 km/h from 0, 1 km, flat, 20 C."""
    from wattroute.functions import physics

    energy = lambda delta: physics.edge_energy_wh(physics.ALL_WHEEL, F.lit(1000.0), F.lit(100.0), F.lit(0.0), F.lit(0.0), F.lit(0), F.lit(20.0), F.lit(delta))
    rest, rolling = spark.range(1).select(energy(100.0), energy(0.0)).first()
    assert rest - rolling == pytest.approx(0.5 * 2095 * 1.04 * (100 / 3.6) ** 2 / 0.85 / 3600, rel=1e-9)
    leg = catalogue.speed_cap_legs(spark, DATA).where("cap = 999.0").orderBy("leg").first()
    e = sorted((r.src, r.dst, r.length_m, r.speed_kmh, r.ascent_m, r.descent_m, r.road_class) for r in view(spark, DATA, "v_edge").where(f"floor(src / 10) = {leg.leg}").collect())
    total, before = 0.0, 0.0
    for _, _, length, kmh, up, down, kind in e:
        v, dv = kmh / 3.6, (kmh - before) / 3.6
        pull = 0.0099 * 2095 * 9.80665 * length + 0.5 * (1.225 * 288.15 / 293.15) * 0.75 * v * v * length + 0.5 * 2095 * 1.04 * (2 * v * dv - dv * dv)
        total += ((pull / 0.85 if pull >= 0 else pull * 0.65) + 2095 * 9.80665 * (up / 0.85 - down * 0.65) + 600 * length / v) / 3600 + (0.014 * length if kind == 1 else 0)
        before = kmh
    assert leg.energy_wh == pytest.approx(total, abs=1e-3)


def test_pairs_far_north_and_across_the_date_line(spark):
    import random

    draw = random.Random(1)
    places = [(lat + draw.uniform(-0.05, 0.05), ((lon + draw.uniform(-0.3, 0.3)) + 180) % 360 - 180) for lat, lon in [(65.0, 10.0), (89.97, 0.0), (-77.0, 180.0), (0.0, 180.0), (48.0, 7.0)] for _ in range(60)]
    places += [(65.0, 10.0), (65.0, 10.042), (89.99, 10.0), (89.99, -170.0), (10.0, 179.999), (10.0, -179.999)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(places)], "id int, lat double, lon double")
    got = {(r.id, r.other_id) for r in spatial.within(df, df, 2500.0).collect()}

    def metres(a, b):
        x = math.sin(math.radians(b[0] - a[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
        return 2 * 6_371_000 * math.asin(min(1.0, math.sqrt(x)))

    want = {(i, j) for i, a in enumerate(places) for j, b in enumerate(places) if i != j and metres(a, b) <= 2500}
    assert got == want and {(300, 301), (302, 303), (304, 305)} <= want


def test_nearest_node_anywhere(spark):
    nodes = spark.createDataFrame([(1, 48.0, 5.0), (2, 48.05, 5.0), (3, -30.0, 100.0)], "node_id int, lat double, lon double")
    points = spark.createDataFrame([(1, 48.04, 5.0), (2, 40.0, 5.0), (3, -60.0, 170.0), (4, 48.3, 5.3)], "id int, lat double, lon double")
    assert dict(map(tuple, spatial.nearest_node_anywhere(points, nodes).collect())) == {1: 2, 2: 1, 3: 3, 4: 2}
    assert dict(map(tuple, spatial.nearest_node(points, nodes).collect())) == {1: 2, 2: None, 3: None, 4: None}


def test_matrix_has_no_limit(spark):
    edges = view(spark, DATA, "v_edge")
    near = {}
    for r in edges.collect():
        near.setdefault(r.src, []).append((r.dst, r.length_m / r.speed_kmh * 3.6))

    def search(source):
        done, queue = {}, [(0.0, source)]
        while queue:
            c, n = heapq.heappop(queue)
            if n not in done:
                done[n] = c
                for m, w in near.get(n, []):
                    heapq.heappush(queue, (c + w, m))
        return done

    rows = planning.travel_matrix(spark, DATA).collect()
    costs = {s: search(s) for s in {r.source for r in rows}}
    assert len(rows) > 1000
    for r in rows:
        want = costs[r.source].get(r.node)
        assert r.cost_s is None if want is None else r.cost_s == pytest.approx(want, abs=1e-5)
    far = routing.many_to_many(edges, spark.createDataFrame([(1, 199), (199, 1), (1, 100000)], "source int, node int")).collect()
    assert {(r.source, r.node): r.cost_s and round(r.cost_s, 4) for r in far} == {(1, 199): round(costs[1][199], 4), (199, 1): costs[199].get(1) and round(costs[199][1], 4), (1, 100000): None}


def test_reach_sums_in_the_order_of_the_way(spark):
    """These four edges take 180 s, but 180.00000000000003 s when summed one after another; in pairs their sum is 180.0, within the limit."""
    ways = [(742, 48), (786, 120), (1025, 60), (1309, 120)]
    edges = spark.createDataFrame([(i, i + 1, float(m), float(v)) for i, (m, v) in enumerate(ways)], "src int, dst int, length_m double, speed_kmh double")
    got = {r.node: r.cost_s for r in routing.travel_costs(edges, spark.createDataFrame([(0,)], "node_id int"), planning.LIMIT_S).collect()}
    want, c = {0: 0.0}, 0.0
    for i, (m, v) in enumerate(ways[:3]):
        c += m / v * 3.6
        want[i + 1] = c
    assert got == want


def test_matrix_labels_end_at_the_farthest_wanted_node(spark):
    """A source whose wanted nodes are all known gets no labels beyond the farthest of them, however many edges lead on."""
    edges = spark.createDataFrame([(i, i + 1, 1000.0, 36.0) for i in range(60)] + [(0, 100 + i, 9000.0, 36.0) for i in range(40)], "src int, dst int, length_m double, speed_kmh double")
    got = routing.costs_to(edges, spark.createDataFrame([(0, 1), (0, 0)], "source int, node int")).collect()
    assert {r.node: r.cost_s for r in got if r.node < 3} == {0: 0.0, 1: 100.0}
    third = routing.costs_to(edges, spark.createDataFrame([(0, 3)], "source int, node int")).collect()
    assert {r.node for r in third if r.node < 100} == {0, 1, 2, 3}


def test_nearest_nodes_of_crowded_places(spark):
    """Dense, sparse and repeated places against all pairs; and a point meets few of many nodes (before: all 6,400 of its nine cells)."""
    dense = [(i, 48 + i % 80 * 0.003, 5 + i // 80 * 0.003) for i in range(6400)] + [(9000 + i, 48.0, 5.0) for i in range(3)] + [(9100, 49.05, 5.0)]
    spots = [(48 + i * 37 % 200 * 0.001, 5 + i * 53 % 230 * 0.001) for i in range(40)] + [(49.14, 5.09), (49.0, 5.0), (60.0, 5.0), (48.0015, 5.0015)]
    rows = [(k * 1000 + i, *s) for k in range(3) for i, s in enumerate(spots)] + [(77, None, 5.0)]
    nodes = spark.createDataFrame(dense, "node_id long, lat double, lon double")
    points = spark.createDataFrame(rows, "id long, lat double, lon double")
    cell = lambda x: math.floor(x / 0.1)

    def brute(lat, lon):
        near = [(round((a - lat) ** 2 + ((b - lon) * math.cos(math.radians(lat))) ** 2, 15), i) for i, a, b in dense if abs(cell(a) - cell(lat)) <= 1 and abs(cell(b) - cell(lon)) <= 1]
        return min(near)[1] if near else None

    want = {s: brute(*s) for s in spots}
    got = dict(map(tuple, spatial.nearest_node(points, nodes).collect()))
    assert got == {i: None if a is None else want[a, b] for i, a, b in rows}
    first = spatial._nearest(points.where("lat is not null").select("lat", "lon").distinct(), spatial._distinct_nodes(nodes), 0.1)
    assert first.count() == len([w for w in want.values() if w is not None])


def grid(side, name=lambda i: i):
    """Edges of a square grid, most of them both ways, with lengths in no order; and a plain search in them."""
    edges = [(a, b, 500.0 + (a * 131 + b * 17) % 1500, 30.0 + (a * 7 + b) % 90) for a in range(side * side) for b in (a + 1, a - 1, a + side, a - side) if 0 <= b < side * side and abs(a % side - b % side) <= 1 and (a + b) % 11]
    edges = [(name(a), name(b), m, v) for a, b, m, v in edges]
    near = {}
    for a, b, m, v in edges:
        near.setdefault(a, []).append((b, m / v * 3.6))

    def search(source):
        done, queue = {}, [(0.0, source)]
        while queue:
            c, n = heapq.heappop(queue)
            if n not in done:
                done[n] = c
                for m, w in near.get(n, []):
                    heapq.heappush(queue, (c + w, m))
        return done

    return edges, search


def test_matrix_writes_few_rows(spark):
    """Every round wrote all labels anew: 357 rows a pair here before."""
    import pyarrow.parquet as pq
    from wattroute.operators.rounds import matching, stored

    stored(spark.range(1))
    made = lambda: set(matching(spark, f"{spark.sparkContext.getCheckpointDir()}/*/part-*"))
    edges, search = grid(20)
    pairs = [(a, a + k) for a in range(400) for k in (0, 1, 2, 20, 21, 42) if a + k < 400]
    before = made()
    got = {(r.source, r.node): r.cost_s for r in routing.many_to_many(spark.createDataFrame(edges, "src int, dst int, length_m double, speed_kmh double"), spark.createDataFrame(pairs, "source int, node int")).collect()}
    costs = {a: search(a) for a, _ in pairs}
    assert got == {(a, b): costs[a].get(b) for a, b in pairs}
    rows = sum(pq.read_metadata(f.removeprefix("file:")).num_rows for f in made() - before)
    assert rows < 15 * len(pairs)


@pytest.mark.parametrize("ids, limits, all_end", [("ordered", {}, True), ("ordered", {"RANGE": 16, "HOPS": (2, 2)}, False), ("ordered", {"RANGE": 16, "WAYS": 1}, False), ("drawn", {"HOPS": (12, 12)}, True), ("ordered", {"LABELS": 1, "HOPS": (9,)}, False), ("texts", {"HOPS": (4, 3)}, False)], ids=str)
def test_near_pieces_of_all_kinds(spark, monkeypatch, ids, limits, all_end):
    """However pieces are cut, ended searches are those of a plain search with all nodes of best ways, and every other pair comes back."""
    from wattroute.operators import near
    from wattroute.operators.rounds import durable

    for k, v in limits.items():
        monkeypatch.setattr(near, k, v)
    name = {"ordered": lambda i: i, "drawn": lambda i: i * 7919 % 1_000_003 - 500_000, "texts": lambda i: f"n{i}"}[ids]
    kind = "string" if ids == "texts" else "bigint"
    edges, search = grid(12, name)
    pairs = sorted({(name(a), name(b)) for a in range(0, 144, 3) for b in (a, a + 1, a + 13, (a * 5 + 70) % 144) if b < 144})
    weights = durable(routing._weights(spark.createDataFrame(edges, f"src {kind}, dst {kind}, length_m double, speed_kmh double")))
    found, left = near.search(weights, durable(spark.createDataFrame(pairs, f"source {kind}, node {kind}")))
    found, left = {(r.source, r.node): r.cost_s for r in found.collect()}, sorted((r.source, r.node) for r in left.collect())
    costs = {a: search(a) for a, _ in pairs}
    assert all(costs[a][n] == c for (a, n), c in found.items())
    ended = {a for a, _ in pairs} - {a for a, _ in left}
    assert left == [p for p in pairs if p[0] not in ended] and {a for a, _ in found} <= ended
    into = {}
    for a, b, m, v in edges:
        into.setdefault(b, []).append((a, m / v * 3.6))
    for a, b in pairs:
        if a in ended and b in costs[a]:  # back along the best way
            while b != a:
                assert (a, b) in found
                b = min((costs[a][p] + w, p) for p, w in into[b] if p in costs[a])[1]
    assert (not left) == all_end
