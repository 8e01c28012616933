"""Drive progress: a stream in any cut equals the plain fold; the rules at their limits."""

import random
from datetime import UTC, datetime, timedelta

from wattroute.streaming import drive

FIX = "drive bigint, id bigint, at timestamp, t_s double, along_m double, off_m double, replanned boolean, stops_m array<double>, leg_ends_m array<double>, total_m double"
START = datetime(2024, 1, 1, tzinfo=UTC)


def fixes(seed, drives=6, n=60):
    rng, rows = random.Random(seed), []
    for d in range(drives):
        along, total = 0.0, 2000.0 + 300 * d
        stops, ends = [600.0, 1200.0], [600.0, 1200.0, total]
        for i in range(n):
            along += rng.choice([0, 20, 40, 90])
            t = i * 1.0 - (2.0 if rng.random() < 0.1 else 0.0)
            off = rng.choice([2.0, 9.9, 10.1, 30.0]) if (i // 9) % 3 else rng.choice([50.0, 80.0])
            rows.append((d, i, START + timedelta(seconds=i), t, along if rng.random() > 0.03 else None, off, i == 30 and d % 2 == 0, stops, ends, total))
    return rows


def plain(rows):
    out = []
    for d in sorted({r[0] for r in rows}):
        stops = leg = 0
        since = shown = last = None
        waiting = done = False
        for _, i, _, t, along, off, new, stop_m, ends, total in sorted(r for r in rows if r[0] == d):
            if along is None or done or last is not None and t <= last:
                continue
            last = t
            if new:
                stops, leg, waiting = 0, 0, False
            passed = False
            for k in range(stops, len(stop_m)):
                if along < stop_m[k] - 40:
                    break
                out.append((d, i, t, "stop", along, k))
                stops, passed = k + 1, True
            for k in range(leg, len(ends) - 1):
                if along < ends[k] - 40:
                    break
                leg, passed = k + 1, True
                out.append((d, i, t, "leg", along, leg))
            if along >= total - 40:
                done = True
                out.append((d, i, t, "arrived", along, stops))
                continue
            out.append((d, i, t, "on" if off <= 10 else "off", along, 0))
            if off < 50:
                since = None
            elif not waiting:
                since = t if since is None else since
                if t - since >= 5:
                    waiting, since = True, None
                    out.append((d, i, t, "replan", along, stops))
            if passed or shown is None or t - shown >= 1:
                shown = t
                out.append((d, i, t, "show", along, leg))
    return sorted(out)


def test_table_is_the_fold(spark):
    rows = fixes(1)
    expected = plain(rows)
    assert {e[3] for e in expected} == {"stop", "leg", "arrived", "on", "off", "replan", "show"}
    assert sorted(map(tuple, drive.progress_of_table(spark.createDataFrame(rows, FIX)).collect())) == expected
    first = {e[0]: e[1] for e in reversed(expected) if e[3] == "replan"}
    early = [r for r in rows if r[4] is not None and r[1] < 30 and r[0] in (1, 3)]
    kept = {d: drive.sustained(spark.createDataFrame([r for r in early if r[0] == d and all(r[3] > q[3] for q in early if q[0] == d and q[1] < r[1])], FIX)).first() for d in (1, 3)}
    assert {d: r.id for d, r in kept.items() if r} == {d: i for d, i in first.items() if d in (1, 3) and i < 30}


def test_stream_in_any_cut_is_the_fold(spark, tmp_path):
    rows, rng = fixes(2), random.Random(0)
    for k, cuts in enumerate(([], [10, 11, 40], sorted(rng.sample(range(60), 6)))):
        bounds = [0, *cuts, 60]
        for n, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
            spark.createDataFrame([r for r in rows if a <= r[1] < b], FIX).coalesce(1).write.parquet(f"{tmp_path}/in{k}/{n:03d}")
        stream = spark.readStream.schema(FIX).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in{k}/*")
        q = drive.progress(stream).writeStream.outputMode("append").format("memory").queryName(f"drive{k}").option("checkpointLocation", f"{tmp_path}/cp{k}").trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert sorted(map(tuple, spark.table(f"drive{k}").collect())) == plain(rows)


def test_replans_leave_with_the_charge_of_the_plan(spark):
    events = spark.createDataFrame([(1, 7, 8.0, "replan", 150.0, 0), (1, 8, 9.0, "show", 160.0, 0)], drive.EVENT)
    at = spark.createDataFrame([(1, 7, 50.0, 6.0), (1, 8, 50.1, 6.1)], "drive bigint, id bigint, lat double, lon double")
    curve = spark.createDataFrame([(1, 100.0, 0.8), (1, 200.0, 0.6)], "drive bigint, x double, soc double")
    assert [(r.id, r.lat, round(r.depart_soc, 9)) for r in drive.replan_requests(events, at, curve).collect()] == [(7, 50.0, 0.7)]


def test_state_ends_with_the_drive(spark, tmp_path):
    """After arrival, and after long silence, nothing of a drive is kept."""
    far = START + timedelta(days=1)
    batches = [[(1, 0, START, 0.0, 1990.0, 1.0, False, [], [2000.0], 2000.0), (2, 0, START, 0.0, 5.0, 1.0, False, [], [2000.0], 2000.0)], [(3, 0, far, 0.0, 5.0, 1.0, False, [], [2000.0], 2000.0)], [(3, 1, far + timedelta(days=1), 1.0, 6.0, 1.0, False, [], [2000.0], 2000.0)], [(3, 2, far + timedelta(days=1, hours=3), 2.0, 7.0, 1.0, False, [], [2000.0], 2000.0)]]
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, FIX).coalesce(1).write.parquet(f"{tmp_path}/in/{n:03d}")
    stream = spark.readStream.schema(FIX).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = drive.progress(stream).writeStream.outputMode("append").format("memory").queryName("ends").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 1
