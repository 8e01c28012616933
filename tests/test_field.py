"""Operators that SQL cannot say, against plain Python on small tables, and literal cases."""

import math

import pytest
from pyspark.sql import functions as F

from wattroute.functions import dialogue, physics, text
from wattroute.operators import calibration, corridor, documents, network, steps
from wattroute.plans import field
from wattroute.sources.views import view

DATA = "/root/testdata/sf0.001"


def metres(a, b):
    x = math.sin(math.radians(b[0] - a[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6_371_000 * math.asin(min(1.0, math.sqrt(x)))


def reach(near, start):
    seen, queue = {start}, [start]
    while queue:
        for m in near.get(queue.pop(), []):
            if m not in seen:
                seen.add(m)
                queue.append(m)
    return seen


def plain_components(edges):
    ahead, back = {}, {}
    for a, b in edges:
        ahead.setdefault(a, []).append(b)
        back.setdefault(b, []).append(a)
    return {n: max(reach(ahead, n) & reach(back, n)) for n in {*ahead, *back}}


@pytest.mark.parametrize("edges", [[(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 3), (5, 0), (6, 6)], [(i, (i + 1) % 9) for i in range(9)] + [(3, 20), (20, 21)], [(1, 2), (2, 1), (2, 3), (3, 2), (3, 1), (9, 1)]])
def test_strong_components(spark, edges):
    got = dict(map(tuple, network.strong_components(spark.createDataFrame(edges, "src int, dst int")).collect()))
    assert got == plain_components(edges)


def test_largest_component_of_the_roads(spark):
    edges = [(r.src, r.dst) for r in field._one_way(spark, DATA).collect()]
    want = plain_components(edges)
    size = {}
    for c in want.values():
        size[c] = size.get(c, 0) + 1
    best = max(size, key=lambda c: (size[c], -c))
    number = {n: i for i, n in enumerate(sorted(n for n, c in want.items() if c == best))}
    got = sorted(map(tuple, field.largest_part(spark, DATA).collect()))
    assert got == sorted((a, b, number[a], number[b]) for a, b in edges if a in number and b in number) and 1 < len(number) < len(want)


def plain_doubles(rows, most):
    keep = [True] * len(rows)
    for i, a in enumerate(rows):
        for j in range(i + 1, len(rows)):
            if keep[i] and keep[j] and metres(a[1:3], rows[j][1:3]) <= most:
                if rows[j][3] > a[3]:
                    keep[i] = False
                else:
                    keep[j] = False
    return [r[0] for r, k in zip(rows, keep, strict=True) if k]


def test_doubles_are_dropped_in_order(spark):
    import random

    draw = random.Random(2)
    rows = [(g, i, 50 + draw.uniform(0, 0.02), 5 + draw.uniform(0, 0.02), float(draw.choice([50, 150, 150, 300]))) for g in range(4) for i in range(30)]
    rows += [(9, 0, 50.0, 5.0, 50.0), (9, 1, 50.0005, 5.0, 150.0)]
    df = spark.createDataFrame(rows, "g int, ord int, lat double, lon double, power_kw double")
    got = sorted((r.g, r.ord) for r in corridor.drop_doubles(df, ["g"]).collect())
    assert got == [(g, o) for g in (0, 1, 2, 3, 9) for o in plain_doubles([r[1:] for r in rows if r[0] == g], 300.0)] and (9, 0) not in got


def test_projection_on_a_line(spark):
    line = [(r.route, r.pos, r.lat, r.lon, r.cum_m) for r in field._line(spark, DATA).collect()]
    sites = {r.id: (r.lat, r.lon) for r in view(spark, DATA, "v_charger").collect()}
    for r in field.route_projection(spark, DATA).collect():
        p, own = sites[r.id], sorted(x[1:] for x in line if x[0] == r.route)
        best = None
        for (_, la, oa, ca), (_, lb, ob, cb) in zip(own, own[1:], strict=False):
            k = math.cos(math.radians((la + lb) / 2)) * 111_320
            bx, by, px, py = (ob - oa) * k, (lb - la) * 111_320, (p[1] - oa) * k, (p[0] - la) * 111_320
            t = min(max((px * bx + py * by) / (bx * bx + by * by), 0), 1)
            off = math.hypot(px - t * bx, py - t * by)
            if best is None or off < best[0] - 1e-6:
                best = (off, ca + t * (cb - ca))
        assert (r.off_m, r.along_m) == (pytest.approx(best[0], abs=1e-2), pytest.approx(best[1], abs=0.05))


def test_charge_lookup_is_near_the_integral(spark):
    asks = spark.createDataFrame([(150.0, 0.1, 0.8), (350.0, 0.129, 0.765), (50.0, 0.5, 0.5), (50.0, 0.8, 0.2), (22.0, -1.0, 2.0)], "power_kw double, from_soc double, to_soc double")
    got = {(r.power_kw, r.from_soc): r.charge_s for r in calibration.charge_seconds(asks, calibration.charge_table(asks, physics.ALL_WHEEL, 1.0)).collect()}
    exact = asks.select("power_kw", "from_soc", physics.charge_seconds(physics.ALL_WHEEL, F.greatest("from_soc", F.lit(0.0)), F.least("to_soc", F.lit(1.0)), F.col("power_kw"), F.lit(1.0)).alias("s")).collect()
    for r in exact:
        assert got[r.power_kw, r.from_soc] == pytest.approx(r.s, abs=1.0)
    assert got[50.0, 0.5] == got[50.0, 0.8] == 0.0


def test_refit_scale_and_reference(spark):
    """Literal values: 209 Wh/km of the two-wheel car, and the reference consumption of both."""
    row = spark.range(1).select(calibration.scale_for(physics.TWO_WHEEL, F.lit(209.0)), calibration.reference_wh_per_km(physics.TWO_WHEEL), calibration.reference_wh_per_km(physics.ALL_WHEEL)).first()
    assert list(row) == pytest.approx([1.0207445228, 204.80793312426513, 208.29794680073573], rel=1e-9)


def test_replay_of_a_still_clock(spark):
    """A repeated time is left out and does not move the speed before; a first fix without height takes the first there is."""
    fixes = [(1, 0, 0.0, 50.0, 5.0, None, None), (1, 1, 10.0, 50.001, 5.0, None, 100.0), (1, 2, 10.0, 50.5, 5.0, None, 500.0), (1, 3, 20.0, 50.501, 5.0, None, 104.0), (2, 0, 0.0, 50.0, 5.0, 1.0, 1.0)]
    df = spark.createDataFrame(fixes, "trip_id int, seq int, t_s double, lat double, lon double, speed_mps double, alt_m double")
    runs = spark.createDataFrame([(1, "ev_awd", 20.0, 1.0), (2, "ev_awd", 20.0, 1.0), (3, "ev_awd", 20.0, 1.0)], "trip_id int, vehicle string, temp_c double, k double")
    got = {r.trip_id: r for r in calibration.replay(df, runs).collect()}
    assert got[1].distance_m == pytest.approx(2 * metres((50.0, 5.0), (50.001, 5.0)), rel=1e-6)
    assert got[2].predicted_wh == got[3].predicted_wh == 0.0 and got[1].predicted_wh > 0


def test_step_texts(spark):
    cases = {
        ("turn", "slight left", "Main", "", "", None): "Turn slightly left onto Main", ("turn", "u-turn", "Main", "", "", None): "Make a U-turn", ("continue", "right", "", "A1;B2", "", None): "Continue right on A1 / B2",
        ("continue", "right", "", "", "", None): "Continue", ("off ramp", "right", "x", "", "12", None): "Take exit 12", ("off ramp", "sharp right", "x", "", "", None): "Take the exit on the right", ("on ramp", "straight", "", "", "", None): "Take the ramp",
        ("fork", "slight right", "x", "", "", None): "Keep right", ("end of road", "left", "Elm", "", "", None): "At the end of the road, turn left onto Elm", ("roundabout", "straight", "", "", "", 2): "At the roundabout, take the 2nd exit",
        ("roundabout", "straight", "", "", "", None): "At the roundabout", ("roundabout", "straight", "", "", "", 11): "At the roundabout, take the 11th exit", ("arrive", "straight", "", "", "", None): "Arrive at your destination",
    }
    df = spark.createDataFrame(list(cases), "maneuver string, modifier string, name string, ref string, exit_ref string, exit_count int")
    got = df.select("*", text.step_text(*[F.col(c) for c in df.columns]).alias("text")).collect()
    assert {tuple(r)[:6]: r.text for r in got} == cases


def test_formats_are_checked(spark):
    bad = spark.createDataFrame([('{"format": "cpack-2", "chargers": []}',)], "body string")
    with pytest.raises(Exception, match="format must be cpack-1"):
        documents.read_packs(bad).collect()
    answers = spark.createDataFrame([("220101", "620101"), ("220101", "6201"), ("220101", "620102"), ("F0", "30AA"), ("", "40")], "q string, a string")
    assert [r[0] for r in answers.select(dialogue.echoes(F.col("a"), F.col("q"))).collect()] == [True, False, False, True, False]


def test_steps_of_junctions(spark):
    """One route a rule: nodes on a plane by bearing, the route's edges and what else leaves each junction."""
    rows, routes = [], {}

    def route(name, *legs):
        """legs: (bearing, length, flags, name, ref, alternatives [(bearing, flags, name, speed)])."""
        base, at = len(rows) * 1000, 0
        for k, (deg, length, flags, road_name, ref, others) in enumerate(legs):
            slot = len(rows)
            rows.append((slot, base + k, base + k + 1, float(length), 50.0, flags, road_name, ref, float(deg), float(deg)))
            routes.setdefault(name, []).append(slot)
            for j, (d, f, n, speed) in enumerate(others):
                rows.append((len(rows), base + k, base + 500 + at + j, 10.0, speed, f, n, "", float(d), float(d)))
            at += len(others)

    res, sec, link, ring, mot = 7, 4, 4 | 16, 7 | 32, 1
    route("right", (0, 100, res, "A", "", []), (90, 100, res, "B", "", [(0, res, "A", 50.0)]))
    route("end", (0, 100, res, "A", "", []), (90, 100, res, "B", "", [(270, res, "C", 50.0)]))
    route("fork", (0, 100, sec, "A", "", []), (15, 100, sec, "B", "", [(345, sec, "C", 50.0)]))
    route("main", (0, 100, sec, "A", "", []), (5, 100, sec, "B", "", [(345, link, "", 50.0)]))
    route("off", (0, 100, mot, "", "M1", []), (15, 100, 1 | 16, "", "", [(0, mot, "", 120.0)]))
    route("on", (0, 100, sec, "A", "", []), (30, 100, link, "", "", [(0, sec, "A", 50.0)]))
    route("rename", (0, 100, res, "A", "", []), (0, 100, res, "B", "", []))
    route("blip", (0, 100, res, "A", "", []), (0, 20, res, "B", "", []), (0, 100, res, "C", "", []))
    route("ring", (0, 100, sec, "A", "", []), (90, 20, ring, "", "", []), (0, 20, ring, "", "", [(90, res, "X", 30.0)]), (270, 100, sec, "B", "", [(0, ring, "", 30.0)]))
    route("same", (0, 100, res, "A", "", []), (0, 100, res, "A", "", [(15, res, "C", 50.0)]))
    schema = "slot int, src int, dst int, length_m double, speed_kmh double, flags int, name string, ref string, leave_deg double, arrive_deg double"
    edges = spark.createDataFrame(rows, schema)
    path = spark.createDataFrame([(n, k, s) for n, slots in routes.items() for k, s in enumerate(slots)], "route string, ord int, slot int")
    got = {}
    for r in steps.steps(path, edges).orderBy("route", "along_m", "ord").collect():
        got.setdefault(r.route, []).append((r.maneuver, r.modifier, r.along_m, r.exit_count))
    middle = {n: v[1:-1] for n, v in got.items()}
    assert all(v[0][0] == "depart" and v[-1][0] == "arrive" for v in got.values())
    assert middle == {
        "right": [("turn", "right", 100.0, None)], "end": [("end of road", "right", 100.0, None)], "fork": [("fork", "slight right", 100.0, None)], "main": [("continue", "straight", 100.0, None)],
        "off": [("off ramp", "straight", 100.0, None)], "on": [("on ramp", "slight right", 100.0, None)], "rename": [("continue", "straight", 100.0, None)], "blip": [("continue", "straight", 120.0, None)],
        "ring": [("roundabout", "straight", 100.0, 2)], "same": [],
    }
    assert got["ring"][-1][2] == 240.0
    signed = steps.signage(spark.createDataFrame([(1, 5), (2, 6), (3, 7)], "slot int, node int"), spark.createDataFrame([(1, "X", "", "9"), (2, "Y", "B1", "")], "slot int, dest string, dest_ref string, junction_ref string"), spark.createDataFrame([(6, "12"), (7, "13")], "node int, exit_ref string"))
    assert sorted((r.slot, r.dest, r.dest_ref, r.exit_ref) for r in signed.collect()) == [(1, "X", "", "9"), (2, "Y", "B1", "12"), (3, "", "", "13")]
    line = spark.createDataFrame([(1, 0, 50.0, 5.0), (1, 1, 50.0, 5.0), (1, 2, 51.0, 5.0), (1, 3, 51.0, 5.001), (1, 4, 51.0, 5.001), (2, 0, 1.0, 1.0), (2, 1, 1.0, 1.0)], "edge int, seq int, lat double, lon double")
    assert {r.edge: (round(r.leave_deg), round(r.arrive_deg)) for r in steps.end_bearings(line, "edge", "seq").collect()} == {1: (0, 90)}
