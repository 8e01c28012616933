"""Lines against plain loops: simplifying, snapping in order, trimming, splitting, stops in order, elevation."""

import math
import random

import pytest

from wattroute.operators import lines, raster

POINTS = "line bigint, pos int, lat double, lon double"


def plane(p, a, b, at):
    """(share, metres) of p on the segment a-b, on the plane at latitude ``at``."""
    k, across = 111320.0, 111320.0 * math.cos(math.radians(at))
    bx, by, px, py = (b[1] - a[1]) * across, (b[0] - a[0]) * k, (p[1] - a[1]) * across, (p[0] - a[0]) * k
    square = bx * bx + by * by
    t = min(max((px * bx + py * by) / square, 0.0), 1.0) if square > 0 else 0.0
    return t, math.hypot(px - t * bx, py - t * by)


def recursion(points, tolerance):
    """Douglas-Peucker by recursion."""
    if len(points) < 3:
        return points
    a, b = points[0], points[-1]
    off = [plane(p, a, b, (a[0] + b[0]) / 2)[1] for p in points[1:-1]]
    k = max(range(len(off)), key=lambda i: (off[i], -i))
    if off[k] < tolerance or off[k] == 0:
        return [a, b]
    return recursion(points[: k + 2], tolerance)[:-1] + recursion(points[k + 1 :], tolerance)


def wiggly(rng, n):
    lat, lon, out = 50.0, 6.0, []
    for _ in range(n):
        lat, lon = lat + rng.choice([0, 0, 1e-5, 1e-4]), lon + rng.choice([0, 1e-5, -1e-4])
        out.append((lat, lon))
    return out


def test_simplify_is_the_recursion(spark):
    rng = random.Random(1)
    given = {i: wiggly(rng, n) for i, n in enumerate([1, 2, 3, 50, 300, 7])}
    given[10] = [(50.0, 6.0), (50.0001, 6.001), (50.0001, 6.002), (50.0, 6.003)]  # a tie: the first of equally far points
    given[11] = [(50.0, 6.0)] * 4
    df = spark.createDataFrame([(i, k, *p) for i, ps in given.items() for k, p in enumerate(ps)], POINTS)
    for tolerance in (0.5, 5.0):
        got = {}
        for r in sorted(lines.simplify(df, tolerance).collect()):
            got.setdefault(r.line, []).append((r.lat, r.lon))
        assert got == {i: recursion(ps, tolerance) for i, ps in given.items()}


def test_display_line_joins_legs(spark):
    rows = [(1, 0, 0, 50.0, 6.0), (1, 0, 1, 50.001, 6.0), (1, 0, 2, 50.002, 6.0), (1, 1, 0, 50.002, 6.0), (1, 1, 1, 50.002, 6.01), (2, 0, 0, 1.0, 1.0)]
    got = lines.display_line(spark.createDataFrame(rows, "plan bigint, leg int, pos int, lat double, lon double"))
    assert sorted(map(tuple, got.collect())) == [(1, 0, 50.0, 6.0), (1, 1, 50.002, 6.0), (1, 2, 50.002, 6.01), (2, 0, 1.0, 1.0)]


def plain_snaps(fixes, line):
    """The loop: a window around the last segment, the whole line where that fails."""
    out, hint, n = [], None, len(line) - 1
    for f in fixes:
        every = [(round(plane(f, line[i][:2], line[i + 1][:2], f[0])[1], 6), i) for i in range(n)]
        window = every
        if hint is not None:
            at, low, high = line[hint][2], hint, hint
            while low > 0 and line[low][2] > at - 500:
                low -= 1
            while high < n - 1 and line[high + 1][2] < at + 5000:
                high += 1
            window = every[low : high + 1]
        best = min(window)
        if hint is not None and best[0] > 250:
            best = min(every)
        hint = best[1]
        t = plane(f, line[hint][:2], line[hint + 1][:2], f[0])[0]
        out.append((hint, line[hint][2] + t * (line[hint + 1][2] - line[hint][2]), best[0]))
    return out


def test_snap_follows_loops(spark):
    rng = random.Random(7)
    ring = [(50 + 0.02 * math.sin(k / 10), 6 + 0.03 * math.cos(k / 10)) for k in range(200)]  # three times around
    straight = [(50.0, 7 + k * 0.004) for k in range(60)] + [(50.001, 7 + k * 0.004) for k in range(60, -1, -1)]  # there and back
    rows = [(i, k, *p) for i, ps in ((1, ring), (2, straight)) for k, p in enumerate(ps)]
    line = lines.along(spark.createDataFrame(rows, POINTS))
    of = {}
    for r in sorted(line.collect()):
        of.setdefault(r.line, []).append((r.lat, r.lon, r.cum_m))
    fixes = {i: [(p[0] + rng.uniform(-3e-4, 3e-4), p[1] + rng.uniform(-3e-4, 3e-4)) for p in ps[:: rng.choice([1, 2])]] for i, ps in ((1, ring), (2, straight))}
    fixes[1][40] = (50.5, 6.0)  # far from everything: the whole line is searched
    fixes[2][30:30] = [(50.0005, 7.2), (50.0005, 7.01)]  # a jump out of the window
    df = spark.createDataFrame([(i, k, *p) for i, ps in fixes.items() for k, p in enumerate(ps)], "line bigint, id bigint, lat double, lon double")
    got = {}
    for r in sorted(lines.snap_in_order(df, line).collect()):
        got.setdefault(r.line, []).append((r.seg, r.along_m, r.off_m))
    for i in fixes:
        expected = plain_snaps(fixes[i], of[i])
        assert [g[0] for g in got[i]] == [e[0] for e in expected]
        assert [g[1:] for g in got[i]] == [pytest.approx(e[1:], abs=1e-3) for e in expected]


def test_trim_both_ends(spark):
    line = [(1, k, 50.0, 6 + k * 0.001) for k in range(20)] + [(2, 0, 50.0, 6.0), (2, 1, 50.0, 6.1)] + [(3, k, 50.0, 6 + k * 0.001) for k in range(4)]
    pins = [(1, "origin", 50.0003, 6.0015), (1, "destination", 50.00001, 6.018), (2, "origin", 50.0, 6.05), (3, "origin", 50.01, 6.001), (3, "destination", 50.0, 6.003)]
    cut, stubs = lines.trim(spark.createDataFrame(line, POINTS), spark.createDataFrame(pins, "line bigint, end string, lat double, lon double"))
    rows = sorted(map(tuple, cut.collect()))
    one = [r for r in rows if r[0] == 1]
    assert one[0][1:] == (0, 50.0, pytest.approx(6.0015)) and one[1][3] == pytest.approx(6.002) and one[-1][3] == pytest.approx(6.018) and len(one) == 18
    assert [r[1] for r in one] == list(range(18))
    assert [r[1:] for r in rows if r[0] == 2] == [(0, 50.0, 6.0), (1, 50.0, 6.1)] and sum(r[0] == 3 for r in rows) == 4
    assert [(r.line, r.end) for r in stubs.collect()] == [(1, "origin")]  # 33 m; the destination's gap is 1 m


def test_split_curve(spark):
    curve = spark.createDataFrame([(1, 0.0, 0.9), (1, 100.0, 0.7), (2, 0.0, 1.0), (2, 50.0, 0.5)], "k int, x double, y double")
    at = spark.createDataFrame([(1, 25.0), (2, 50.0), (3, 1.0)], "k int, place double")
    got = sorted(map(tuple, lines.split(curve, at, "k", "x", "y").collect()))
    assert got == [(1, "ahead", 25.0, pytest.approx(0.85)), (1, "ahead", 100.0, 0.7), (1, "behind", 0.0, 0.9), (1, "behind", 25.0, pytest.approx(0.85)), (2, "ahead", 50.0, 0.5), (2, "behind", 0.0, 1.0), (2, "behind", 50.0, 0.5)]
    beyond = sorted(map(tuple, lines.split(curve, spark.createDataFrame([(1, 200.0)], "k int, place double"), "k", "x", "y").collect()))
    assert beyond == [(1, "ahead", 200.0, 0.7), (1, "behind", 0.0, 0.9), (1, "behind", 100.0, 0.7), (1, "behind", 200.0, 0.7)]


def test_stops_in_order(spark):
    legs = [(1, 0, "A", 10.0), (1, 1, "B", 5.0), (1, 2, "A", 7.0), (1, 3, "C", 1.0), (2, 0, "B", 1.0), (2, 1, "A", 1.0)]
    stops = [(1, 0, "B"), (1, 1, "A"), (2, 0, "A"), (2, 1, "B"), (3, 0, "A")]
    got = lines.match_stops(spark.createDataFrame(legs, "plan int, seq int, to_name string, dist_m double"), spark.createDataFrame(stops, "plan int, stop int, name string"))
    assert sorted(map(tuple, got.collect())) == [(1, 0, 15.0), (1, 1, 22.0), (2, 0, 2.0)]


def test_elevation_between_cells(spark):
    tiles = spark.createDataFrame([(49, 6, 4, 4), (50, 6, 2, 2)], "tile_lat int, tile_lon int, width int, height int")
    cells = [(49, 6, r, c, float(10 * r + c)) for r in range(4) for c in range(4)] + [(50, 6, 0, 0, 9999.0), (50, 6, 0, 1, 9999.0), (50, 6, 1, 0, 5.0)]
    points = [(1, 49.5, 6.5), (2, 49.999, 6.0001), (3, 49.0, 6.999), (4, 10.0, 10.0), (5, 50.75, 6.25), (6, 50.25, 6.75), (7, None, 6.0)]
    got = raster.sample(spark.createDataFrame(points, "id int, lat double, lon double"), tiles, spark.createDataFrame(cells, "tile_lat int, tile_lon int, row int, col int, metres double"))
    assert {r.id: r.elevation_m for r in got.collect()} == {1: 16.5, 2: 0.0, 3: 33.0, 4: 0.0, 5: 0.0, 6: 0.0, 7: None}
