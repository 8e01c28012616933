"""A plan's guidance: the steps of all its legs in one list, anchored on the drawn line; and what the display says of the rest of the way."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattroute.functions import rules
from wattroute.operators import guidance, lines

# How near a stop an arrival must be, how far beyond its place a step is looked for, bias factors, limits of a refit, turn of the course a fix.
STOP_M, SLACK_M = 150.0, 500.0
BIAS = {"few_long": 2.0, "quickest": 1.0, "many_short": 0.4}
REFIT_WH_PER_KM = (120.0, 260.0)
COURSE_DEG = 45.0


def leg_ends(legs: DataFrame) -> DataFrame:
    """legs(plan, leg, dist_m, drive_s) with start_m, end_m along the plan and speed_mps (0 for a leg without a time)."""
    end = F.sum("dist_m").over(Window.partitionBy("plan").orderBy("leg"))
    return legs.withColumn("end_m", end).withColumn("start_m", F.col("end_m") - F.col("dist_m")).withColumn("speed_mps", F.when(F.col("drive_s") > 0, F.col("dist_m") / F.col("drive_s")).otherwise(0.0))


def flattened(steps: DataFrame, legs: DataFrame, stops: DataFrame) -> DataFrame:
    """plan, leg, ord, maneuver, lat, lon, expected_m, arrive_label of the steps that are said: no departures, and of the arrivals before the
    last leg's only those at a stop (150 m, the first such stop), under its name.

    steps(plan, leg, ord, maneuver, from_leg_start_m, lat, lon); stops(plan, stop, name, from_start_m): a few for a plan.
    """
    last = F.col("leg") == F.max("leg").over(Window.partitionBy("plan"))
    placed = leg_ends(legs).withColumn("last", last).select("plan", "leg", "start_m", "last")
    rows = steps.join(placed, ["plan", "leg"]).withColumn("expected_m", F.col("start_m") + F.col("from_leg_start_m"))
    named = stops.groupBy("plan").agg(F.array_sort(F.collect_list(F.struct("stop", "name", "from_start_m"))).alias("stops"))
    rows = rows.join(named, "plan", "left")
    met = F.get(F.filter("stops", lambda s: F.abs(s["from_start_m"] - F.col("expected_m")) <= STOP_M), F.lit(0))
    arrives = F.col("maneuver") == "arrive"
    said = (F.col("maneuver") != "depart") & (~arrives | F.col("last") | met.isNotNull())
    return rows.where(said).select("plan", "leg", "ord", "maneuver", "lat", "lon", "expected_m", F.when(arrives & ~F.col("last"), met["name"]).alias("arrive_label"))


def anchored(steps: DataFrame, line: DataFrame) -> DataFrame:
    """Steps with along_m on the line: the nearest place of the segments from the last step's on to the first that begins over 500 m beyond where
    the step is expected; never before the last step's. Where that is no segment, the expected place, within the line.

    steps(plan, leg, ord, expected_m, lat, lon, ...); line(plan, pos, lat, lon, cum_m). Both stream by in one order, segments until the step that
    still looks at them; what is remembered is the segments from the last anchor on.
    """
    segs = lines.segments(line.withColumnRenamed("plan", "line")).withColumnRenamed("line", "plan")
    whole = line.groupBy("plan").agg(F.max("cum_m").alias("whole_m"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    number = F.row_number().over(Window.partitionBy("plan").orderBy("leg", "ord"))
    # a later step may be expected earlier; it is met when all segments of its own window and of those before have come by
    upto = F.max(F.col("expected_m") + SLACK_M).over(Window.partitionBy("plan").orderBy("leg", "ord"))
    asked = steps.join(whole, "plan").withColumn("_n", number).withColumn("_at", upto)
    keys = ["plan", "_at", "_n"]
    beyond = F.lag("start_m").over(Window.partitionBy("plan").orderBy("seg"))  # the segment that begins at the first vertex beyond still counts
    s = segs.select("plan", F.coalesce(beyond, F.lit(-1.0)).alias("_at"), F.lit(0).alias("_n"), "seg", "lat_a", "lon_a", "lat_b", "lon_b", "start_m", "end_m")
    q = asked.select(*keys, "leg", "ord", "expected_m", "whole_m", F.col("lat").alias("lat_a"), F.col("lon").alias("lon_a"))
    both = s.unionByName(q, allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, held, before = None, [], 0.0
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["plan"] != plan:
                    plan, held, before = r["plan"], [], 0.0
                if r["_n"] == 0:
                    held.append((r["_at"], r["lat_a"], r["lon_a"], r["lat_b"], r["lon_b"], r["start_m"], r["end_m"]))
                    continue
                best, across = None, 111_320.0 * math.cos(math.radians(r["lat_a"]))
                limit = r["expected_m"] + SLACK_M
                for k, (begins, la, oa, lb, ob, start, end) in enumerate(held):
                    if begins > limit:
                        break
                    bx, by, px, py = (ob - oa) * across, (lb - la) * 111_320.0, (r["lon_a"] - oa) * across, (r["lat_a"] - la) * 111_320.0
                    square = bx * bx + by * by
                    t = min(max((px * bx + py * by) / square, 0.0), 1.0) if square > 0 else 0.0
                    off = math.hypot(px - t * bx, py - t * by)
                    if best is None or off < best[0] - 1e-9:
                        best = (off, k, start + t * (end - start))
                if best is None:  # the last anchor is beyond the window
                    out.append((plan, r["leg"], r["ord"], max(0.0, min(r["expected_m"], r["whole_m"]))))
                    continue
                before, held = max(best[2], before), held[best[1] :]
                out.append((plan, r["leg"], r["ord"], before))
            columns = zip(*out, strict=True) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, [pa.int64(), pa.int64(), pa.int64(), pa.float64()], strict=True)], ["plan", "leg", "ord", "along_m"])

    ordered = both.repartition(F.col("plan")).sortWithinPartitions(*keys, "seg")
    found = ordered.mapInArrow(run, "plan bigint, leg bigint, ord bigint, along_m double")
    return steps.join(found, ["plan", "leg", "ord"])


def plan_guidance(steps: DataFrame, legs: DataFrame, stops: DataFrame, line: DataFrame) -> DataFrame:
    """All steps of a plan in order: plan, leg, ord, maneuver, arrive_label, along_m, then (the next step's maneuver if it is under 400 m on)."""
    placed = anchored(flattened(steps, legs, stops), line)
    return guidance.chain(placed, "plan", "along_m", "maneuver").select("plan", "leg", "ord", "maneuver", "arrive_label", "along_m", "then")


def remaining(places: DataFrame, legs: DataFrame, stops: DataFrame) -> DataFrame:
    """id, left_m, left_s, next: what is left of a plan at a place: the way, the time and the next stop (null: the destination).

    The rest of the current leg at the leg's average speed (none where that is 0), the later legs' driving, and the charging at stops not passed yet.
    places(id, plan, along_m, leg: number of the current one, passed: stops passed); legs(plan, leg, dist_m, drive_s); stops(plan, stop, name, charge_s),
    numbered from 0. A plan has few legs and stops.
    """
    ends = leg_ends(legs).groupBy("plan").agg(F.collect_list(F.struct("leg", "end_m", "drive_s", "speed_mps")).alias("legs"), F.max("end_m").alias("total_m"))
    named = stops.groupBy("plan").agg(F.array_sort(F.collect_list(F.struct("stop", "name", "charge_s"))).alias("stops"))
    at = places.join(ends, "plan").join(named, "plan", "left").withColumn("stops", F.coalesce("stops", F.array().cast(named.schema["stops"].dataType)))
    add = lambda rows, value: F.aggregate(rows, F.lit(0.0), lambda a, x: a + value(x))
    own = F.get(F.filter("legs", lambda x: x["leg"] == F.col("leg")), F.lit(0))
    rest = F.when(own["speed_mps"] > 0, F.greatest(own["end_m"] - F.col("along_m"), F.lit(0.0)) / own["speed_mps"]).otherwise(0.0)
    later = add(F.filter("legs", lambda x: x["leg"] > F.col("leg")), lambda x: x["drive_s"])
    ahead = F.filter("stops", lambda s: s["stop"] >= F.col("passed"))
    return at.select("id", F.greatest(F.col("total_m") - F.col("along_m"), F.lit(0.0)).alias("left_m"), (rest + later + add(ahead, lambda s: s["charge_s"])).alias("left_s"), F.get(ahead, F.lit(0))["name"].alias("next"))


def endpoint_label(kind: Column, waypoint: Column, charger: Column) -> Column:
    """How an end of a leg is called: Origin, Dest, Waypoint and its number from 1, or the charger's name."""
    return F.when(kind == "origin", "Origin").when(kind == "dest", "Dest").when(kind == "waypoint", F.concat(F.lit("Waypoint "), (waypoint + 1).cast("string"))).otherwise(charger)


def bias_factor(choice: Column) -> Column:
    out = F.lit(None).cast("double")
    for name, factor in BIAS.items():
        out = F.when(choice == name, factor).otherwise(out)
    return out


def accepted_refit(wh_per_km: Column) -> Column:
    return rules.clamp(wh_per_km, *REFIT_WH_PER_KM)


def merged_snapshot(names: list[str]) -> Column:
    """A struct of start_ and end_ readings; null where all of them are."""
    ends = [f"{end}_{n}" for n in names for end in ("start", "end")]
    return F.when(F.coalesce(*[F.col(c).cast("string") for c in ends]).isNotNull(), F.struct(*ends))


def smooth_course(fixes: DataFrame) -> DataFrame:
    """drive, id, course_deg: from fix to fix the course turns towards its target the shorter way round, by 45 degrees at most; it begins at north.

    fixes(drive, id, target_deg); drives stream by in order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = now = None
        for batch in batches:
            out = []
            for d, i, target in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                now = now if d == of else 0.0
                turn = math.fmod(target - now, 360.0)
                turn -= 360.0 * (turn > 180.0) - 360.0 * (turn < -180.0)
                now = (now + min(max(turn, -COURSE_DEG), COURSE_DEG)) % 360.0
                of = d
                out.append((d, i, now))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), [pa.int64(), pa.int64(), pa.float64()], strict=True)], ["drive", "id", "course_deg"])

    rows = fixes.where("drive is not null and target_deg is not null").select(F.col("drive").cast("bigint").alias("drive"), F.col("id").cast("bigint").alias("id"), F.col("target_deg").cast("double").alias("target_deg"))
    return rows.repartition(F.col("drive")).sortWithinPartitions("drive", "id").mapInArrow(run, "drive bigint, id bigint, course_deg double")
