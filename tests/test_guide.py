"""Guidance of whole plans against plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from wattroute.operators import guide, lines

STEP = "plan bigint, leg bigint, ord bigint, maneuver string, from_leg_start_m double, lat double, lon double"
LEG = "plan bigint, leg bigint, dist_m double, drive_s double"
STOP = "plan bigint, stop bigint, name string, from_start_m double"
LINE = "line bigint, pos bigint, lat double, lon double"


def plain(steps, legs, stops, line):
    """(leg, ord, label, along) by one loop over a plan's steps; line: (lat, lon, cum)."""
    out, start, seg0, before, n = [], 0.0, 0, 0.0, len(line) - 1
    for _, leg, dist, _ in legs:
        for _, _, k, maneuver, at, lat, lon in [s for s in steps if s[1] == leg]:
            expected, label = start + at, None
            if maneuver == "depart":
                continue
            if maneuver == "arrive" and leg != legs[-1][1]:
                label = next((s[2] for s in stops if abs(s[3] - expected) <= 150), None)
                if label is None:
                    continue
            end = min(next((i for i, p in enumerate(line) if p[2] > expected + 500), len(line) - 1), n - 1)
            if end < min(seg0, n - 1):
                out.append((leg, k, label, max(0.0, min(expected, line[-1][2]))))
                continue
            across, best = 111320.0 * math.cos(math.radians(lat)), None
            for i in range(min(seg0, n - 1), end + 1):
                (la, oa, ca), (lb, ob, cb) = line[i], line[i + 1]
                bx, by, px, py = (ob - oa) * across, (lb - la) * 111320.0, (lon - oa) * across, (lat - la) * 111320.0
                square = bx * bx + by * by
                t = min(max((px * bx + py * by) / square, 0), 1) if square else 0
                off = math.hypot(px - t * bx, py - t * by)
                if best is None or off < best[0] - 1e-9:
                    best = (off, i, ca + t * (cb - ca))
            seg0, before = best[1], max(best[2], before)
            out.append((leg, k, label, before))
        start += dist
    return out


def drawn(rng, plan, points):
    """A winding line with legs of a third each, steps beside it (some far off their place), stops at some leg ends."""
    lat, lon, line = 50.0, 6.0, []
    for k in range(points):
        line.append((plan, k, lat, lon))
        lat, lon = lat + rng.choice([0.001, 0.002, -0.0005]), lon + rng.choice([0.001, -0.001, 0.003])
    return line


def test_guidance_of_plans(spark):
    rng = random.Random(5)
    line_rows = [r for p in (1, 2, 3) for r in drawn(rng, p, 60)]
    line = lines.along(spark.createDataFrame(line_rows, LINE)).withColumnRenamed("line", "plan")
    of = {}
    for r in line.orderBy("plan", "pos").collect():
        of.setdefault(r.plan, []).append((r.lat, r.lon, r.cum_m))
    steps, legs, stops = [], [], []
    for p, ps in of.items():
        n = p if p < 3 else 3
        each = ps[-1][2] / n
        legs += [(p, leg, each, 100.0) for leg in range(n)]
        stops += [(p, 0, "first", each + 120.0)] if p == 3 else []
        for leg in range(n):
            kinds = ["depart", *rng.choices(["turn", "fork"], k=6), "arrive"]
            for k, m in enumerate(kinds):
                at = each * k / (len(kinds) - 1) + rng.choice([0, 0, 700, -900])
                lat, lon, _ = min(ps, key=lambda q: abs(q[2] - leg * each - at))
                steps.append((p, leg, k, m, at, lat + rng.uniform(-1e-4, 1e-4), lon + rng.uniform(-1e-4, 1e-4)))
    got = guide.plan_guidance(spark.createDataFrame(steps, STEP), spark.createDataFrame(legs, LEG), spark.createDataFrame(stops, STOP), line).collect()
    for p, ps in of.items():
        expected = plain([s for s in steps if s[0] == p], [x for x in legs if x[0] == p], [s for s in stops if s[0] == p], ps)
        rows = sorted((r for r in got if r.plan == p), key=lambda r: (r.leg, r.ord))
        assert [(r.leg, r.ord, r.arrive_label) for r in rows] == [e[:3] for e in expected]
        assert [r.along_m for r in rows] == [pytest.approx(e[3], abs=1e-6) for e in expected]
    assert sum(r.maneuver == "arrive" and r.plan == 3 for r in got) == 2  # the first leg's stop and the end; the second leg ends at no stop


def test_remaining_way_and_time(spark):
    legs = spark.createDataFrame([(1, 0, 1000.0, 100.0), (1, 1, 500.0, 0.0), (1, 2, 2000.0, 100.0)], LEG)
    stops = spark.createDataFrame([(1, 0, "A", 600.0), (1, 1, "B", 300.0)], "plan bigint, stop bigint, name string, charge_s double")
    places = spark.createDataFrame([(1, 1, 250.0, 0, 0), (2, 1, 1200.0, 1, 1), (3, 1, 3600.0, 2, 2)], "id bigint, plan bigint, along_m double, leg bigint, passed bigint")
    got = {r.id: (r.left_m, r.left_s, r.next) for r in guide.remaining(places, legs, stops).collect()}
    assert got == {1: (3250.0, 75.0 + 100.0 + 900.0, "A"), 2: (2300.0, 100.0 + 300.0, "B"), 3: (0.0, 0.0, None)}


def test_course_turns_the_shorter_way(spark):
    rows = [(1, 0, 350.0), (1, 1, 10.0), (1, 2, 200.0), (1, 3, 200.0), (2, 0, 90.0), (2, 1, 270.0), (2, 2, None)]
    got = guide.smooth_course(spark.createDataFrame(rows, "drive bigint, id bigint, target_deg double")).collect()
    assert {(r.drive, r.id): r.course_deg for r in got} == {(1, 0): 350.0, (1, 1): 10.0, (1, 2): 325.0, (1, 3): 280.0, (2, 0): 45.0, (2, 1): 0.0}


def test_small_rules(spark):
    df = spark.createDataFrame([("origin", None, None, "quickest", 90.0, None, 1.0), ("waypoint", 1, None, "few_long", 300.0, None, None), ("charger", None, "Ionity", "many_short", 200.0, 5.0, 7.0), ("dest", None, None, "other", None, None, None)], "kind string, wp int, name string, bias string, wh double, start_soc double, end_soc double")
    got = df.select(guide.endpoint_label(F.col("kind"), F.col("wp"), F.col("name")).alias("label"), guide.bias_factor(F.col("bias")).alias("b"), guide.accepted_refit(F.col("wh")).alias("w"), guide.merged_snapshot(["soc"]).alias("s")).collect()
    assert [r.label for r in got] == ["Origin", "Waypoint 2", "Ionity", "Dest"] and [r.b for r in got] == [1.0, 2.0, 0.4, None] and [r.w for r in got] == [120.0, 260.0, 200.0, None]
    assert [None if r.s is None else tuple(r.s) for r in got] == [(None, 1.0), None, (5.0, 7.0), None]
