"""Operators on lines (ordered points): simplifying, joining, trimming, splitting, and placing points on them.

A point meets the segments of its own line through cells, never all of them: segments are sampled so densely that whatever is near a
segment is near one of its samples. Only points far from their whole line are compared with all of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattroute.functions import geo, rules
from wattroute.operators import spatial
from wattroute.operators.rounds import durable

# Tolerance of display lines; window back and ahead of the last place and distance at which all is searched again; trimming.
TOLERANCE_M = 0.5
BACK_M, AHEAD_M, LOST_M = 500.0, 5000.0, 250.0
TRIM_WITHIN_M, TRIM_OFF_M, GAP_M = 2000.0, 50.0, 10.0


def simplify(points: DataFrame, tolerance_m: float = TOLERANCE_M) -> DataFrame:
    """The points (line, pos, lat, lon) that Douglas-Peucker keeps: first and last, and of each stretch the farthest from its chord
    (of equally far ones the first) while that is at least ``tolerance_m`` off.

    All open stretches of all lines are split at once; a round is one aggregation by stretch, and points of finished stretches leave.
    Rounds follow the depth of the splits, about the logarithm of a line's points.
    """
    w = Window.partitionBy("line")
    ends = points.select("line", "pos", "lat", "lon", F.min("pos").over(w).alias("low"), F.max("pos").over(w).alias("high"))
    ends = durable(ends)
    edge = ends.where("pos = low or pos = high")
    kept = [edge.select("line", "pos", "lat", "lon")]
    of = lambda c: edge.where(f"pos = {c}").select("line", F.struct("pos", "lat", "lon").alias(c))
    inside = durable(ends.where("pos > low and pos < high").drop("low", "high").join(of("low"), "line").join(of("high"), "line"))
    while not inside.isEmpty():
        off = rules.segment_distance_m(F.col("lat"), F.col("lon"), *[F.col(f"{end}.{c}") for end in ("low", "high") for c in ("lat", "lon")])
        far = inside.groupBy("line", F.col("low.pos").alias("at")).agg(F.max(F.struct(off.alias("off"), (-F.col("pos")).alias("pos"), F.struct("pos", "lat", "lon").alias("p"))).alias("f"))
        split = durable(far.where((F.col("f.off") >= tolerance_m) & (F.col("f.off") > 0)).select("line", "at", F.col("f.p").alias("mid")))
        kept.append(split.select("line", "mid.*"))
        parts = inside.join(split, (inside["line"] == split["line"]) & (inside["low.pos"] == split["at"])).drop(split["line"], split["at"]).where("pos <> mid.pos")
        left = F.col("pos") < F.col("mid.pos")
        inside = durable(parts.select("line", "pos", "lat", "lon", F.when(left, F.col("low")).otherwise(F.col("mid")).alias("low"), F.when(left, F.col("mid")).otherwise(F.col("high")).alias("high")))
    out = kept[0]
    for more in kept[1:]:
        out = out.unionByName(more)
    return out


def display_line(legs: DataFrame, tolerance_m: float = TOLERANCE_M) -> DataFrame:
    """plan, pos (from 0), lat, lon: the legs' points, each leg simplified by itself, without points that repeat the one before. legs(plan, leg, pos, lat, lon)."""
    simple = simplify(legs.select(F.struct("plan", "leg").alias("line"), "pos", "lat", "lon"), tolerance_m)
    w = Window.partitionBy("line.plan").orderBy("line.leg", "pos")
    new = ~(F.lag("lat").over(w).eqNullSafe(F.col("lat")) & F.lag("lon").over(w).eqNullSafe(F.col("lon")))
    once = simple.withColumn("new", new).where("new")
    return once.select(F.col("line.plan").alias("plan"), (F.row_number().over(w) - 1).alias("pos"), "lat", "lon")


def along(points: DataFrame) -> DataFrame:
    """Adds cum_m, the running distance of each line's points."""
    w = Window.partitionBy("line").orderBy("pos")
    step = F.coalesce(geo.haversine_m(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon")), F.lit(0.0))
    return points.withColumn("_step", step).withColumn("cum_m", F.sum("_step").over(w)).drop("_step")


def segments(line: DataFrame) -> DataFrame:
    """line, seg (pos of its first point), lat_a, lon_a, lat_b, lon_b, start_m, end_m. line(line, pos, lat, lon, cum_m)."""
    w = Window.partitionBy("line").orderBy("pos")
    ends = line.select("line", F.col("pos").alias("seg"), F.col("lat").alias("lat_a"), F.col("lon").alias("lon_a"), F.col("cum_m").alias("start_m"), *[F.lead(c).over(w).alias(a) for c, a in (("lat", "lat_b"), ("lon", "lon_b"), ("cum_m", "end_m"))])
    return ends.where("lat_b is not null")


def on_plane(lat: Column, lon: Column) -> tuple[Column, Column]:
    """(share along the segment lat_a ... lon_b, distance in metres) of a point, on the plane at the point's latitude."""
    across = F.cos(F.radians(lat)) * rules.DEGREE_M
    bx, by = (F.col("lon_b") - F.col("lon_a")) * across, (F.col("lat_b") - F.col("lat_a")) * rules.DEGREE_M
    px, py = (lon - F.col("lon_a")) * across, (lat - F.col("lat_a")) * rules.DEGREE_M
    square = bx * bx + by * by
    share = F.when(square > 0, F.least(F.greatest((px * bx + py * by) / F.nullif(square, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))
    return share, F.round(F.sqrt(F.pow(px - share * bx, F.lit(2.0)) + F.pow(py - share * by, F.lit(2.0))), 6)


def _placed(met: DataFrame, measure) -> DataFrame:
    share, off = measure(F.col("lat"), F.col("lon"))
    place = F.col("start_m") + share * (F.col("end_m") - F.col("start_m"))
    return met.select("line", "id", F.struct(off.alias("off_m"), "seg", place.alias("along_m"), "start_m", "end_m").alias("c"))


def near_segments(points: DataFrame, segs: DataFrame, metres: float, measure=on_plane) -> tuple[DataFrame, DataFrame]:
    """(pairs, rest): (line, id, c: off_m, seg, along_m, start_m, end_m) of every segment up to ``metres`` off; the points that have none.

    points(line, id, lat, lon). The join is on line and cell.
    """
    pieces = F.greatest(F.ceil((F.col("end_m") - F.col("start_m")) / metres), F.lit(1)).cast("int")
    samples = segs.withColumn("n", pieces).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumn("s", (F.col("i") + 0.5) / F.col("n"))
    samples = samples.select("line", F.struct("line", "seg").alias("id"), (F.col("lat_a") + F.col("s") * (F.col("lat_b") - F.col("lat_a"))).alias("lat"), (F.col("lon_a") + F.col("s") * (F.col("lon_b") - F.col("lon_a"))).alias("lon"))
    asked = points.select("line", F.struct("line", "id", "lat", "lon").alias("id"), "lat", "lon")
    met = spatial.within(asked, samples, 1.55 * metres, keep_same=True, keys=("line",)).select("id.*", F.col("other_id.seg").alias("seg")).distinct()
    pairs = durable(_placed(met.join(segs, ["line", "seg"]), measure).where(F.col("c.off_m") <= metres))
    return pairs, points.join(pairs.select("line", "id").distinct(), ["line", "id"], "left_anti")


def nearest(points: DataFrame, segs: DataFrame, metres: float = LOST_M, measure=on_plane) -> tuple[DataFrame, DataFrame]:
    """(best, pairs): line, id and c of each point's nearest segment, the first of equals; and the pairs of near_segments()."""
    pairs, rest = near_segments(points, segs, metres, measure)
    least = lambda df: df.groupBy("line", "id").agg(F.min("c").alias("c"))
    return least(pairs).unionByName(least(_placed(rest.join(segs, "line"), measure))), pairs


SNAP = "line bigint, id bigint, seg bigint, along_m double, off_m double"


def snap_in_order(fixes: DataFrame, line: DataFrame) -> DataFrame:
    """SNAP of each fix of a drive, in order: searched from 500 m before to 5 km after the last one's segment; on the whole line at first
    and where nothing in that window is within 250 m. So a route that passes a place twice is followed, not jumped on.

    fixes(line, id, lat, lon), id in order of time; line(line, pos, lat, lon, cum_m). Only segments within 250 m can win in a window, and they
    come with each fix from the cell join; the ordered part streams over these short lists and keeps one segment.
    """
    best, pairs = nearest(fixes, segments(line), LOST_M)
    near = pairs.groupBy("line", "id").agg(F.array_sort(F.collect_list("c")).alias("near"))
    rows = best.withColumnRenamed("c", "far").join(near, ["line", "id"], "left").select("line", "id", "far", "near")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drive = last = None
        for batch in batches:
            out = []
            for of, i, far, near in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                got = far
                if last is not None and of == drive:
                    at = last["start_m"]
                    seen = (c for c in near or [] if (c["seg"] >= last["seg"] or c["end_m"] > at - BACK_M) and (c["seg"] <= last["seg"] or c["start_m"] < at + AHEAD_M))
                    got = next(seen, far)
                drive, last = of, got
                out.append((of, i, got["seg"], got["along_m"], got["off_m"]))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), [pa.int64()] * 3 + [pa.float64()] * 2, strict=True)], ["line", "id", "seg", "along_m", "off_m"])

    return rows.repartition(F.col("line")).sortWithinPartitions("line", "id").mapInArrow(run, SNAP)


def _trim_leading(line: DataFrame, pins: DataFrame) -> DataFrame:
    """line, pos, lat, lon, cut off before the place nearest to each line's pin, where that is within 50 m of its first 2 km."""
    whole = along(line)
    counted = whole.groupBy("line").agg(F.count(F.lit(1)).alias("n"))
    segs = segments(whole).where(F.col("start_m") <= TRIM_WITHIN_M)
    share, off = on_plane(F.col("lat"), F.col("lon"))
    met = pins.select("line", "lat", "lon").join(segs, "line").withColumn("t", share).withColumn("off", off)
    spot = F.struct("off", "seg", (F.col("start_m") + F.col("t") * (F.col("end_m") - F.col("start_m"))).alias("target"), (F.col("lat_a") + F.col("t") * (F.col("lat_b") - F.col("lat_a"))).alias("lat"), (F.col("lon_a") + F.col("t") * (F.col("lon_b") - F.col("lon_a"))).alias("lon"))
    best = met.groupBy("line").agg(F.min(spot).alias("b")).where(F.col("b.off") <= TRIM_OFF_M)
    cut = whole.join(best, "line").where(F.col("cum_m") >= F.col("b.target") - 1e-6)
    first = cut.groupBy("line").agg(F.min("cum_m").alias("m"), F.min("pos").alias("p"), F.count(F.lit(1)).alias("left"))
    plan = best.join(first, "line").join(counted, "line").withColumn("new", F.abs(F.col("m") - F.col("b.target")) >= 1e-6)
    plan = plan.where((F.col("n") > 2) & (F.col("left") + F.col("new").cast("int") >= 2)).select("line", "p", "new", F.col("b.lat").alias("new_lat"), F.col("b.lon").alias("new_lon"))
    rest = line.join(plan.select("line", "p"), "line", "left").where("p is null or pos >= p").select("line", "pos", "lat", "lon")
    return rest.unionByName(plan.where("new").select("line", (F.col("p") - 1).alias("pos"), F.col("new_lat").alias("lat"), F.col("new_lon").alias("lon")))


def trim(line: DataFrame, pins: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(line, connectors): lines (line, pos, lat, lon) cut to where their pins project, and from pins more than 10 m away the stub to draw.

    pins(line, end: origin or destination, lat, lon). Lines of two points stay. connectors: line, end, lat, lon of the line's end.
    """
    turned = lambda df: df.withColumn("pos", -F.col("pos"))
    many = line.groupBy("line").agg((F.count(F.lit(1)) > 2).alias("long"))
    of = lambda end: pins.where(F.col("end") == end).join(many.where("long"), "line").select("line", "lat", "lon")
    start = line.select("line", F.col("pos").cast("bigint").alias("pos"), "lat", "lon")
    fore = durable(_trim_leading(start, of("origin")))
    back = _trim_leading(turned(fore), of("destination"))
    cut = durable(turned(back).select("line", "pos", "lat", "lon"))
    # an end has a connector if it was cut, even where nothing but its first point's place was found
    reached = _cut_ends(start, of("origin")).withColumn("end", F.lit("origin")).unionByName(_cut_ends(turned(fore), of("destination")).withColumn("end", F.lit("destination")))
    tips = cut.groupBy("line").agg(F.min_by(F.struct("lat", "lon"), "pos").alias("origin"), F.max_by(F.struct("lat", "lon"), "pos").alias("destination"))
    tip = F.when(F.col("end") == "origin", F.col("origin")).otherwise(F.col("destination"))
    stubs = pins.join(reached, ["line", "end"], "left_semi").join(tips, "line").withColumn("tip", tip)
    stubs = stubs.where(geo.haversine_m(F.col("lat"), F.col("lon"), F.col("tip.lat"), F.col("tip.lon")) > GAP_M)
    place = F.row_number().over(Window.partitionBy("line").orderBy("pos")) - 1
    return cut.select("line", place.alias("pos"), "lat", "lon"), stubs.select("line", "end", F.col("tip.lat").alias("lat"), F.col("tip.lon").alias("lon"))


def _cut_ends(line: DataFrame, pins: DataFrame) -> DataFrame:
    """line of the pins whose place on the line's first 2 km is within 50 m."""
    _, off = on_plane(F.col("lat"), F.col("lon"))
    met = pins.join(segments(along(line)).where(F.col("start_m") <= TRIM_WITHIN_M), "line").withColumn("off", off)
    return met.groupBy("line").agg(F.min("off").alias("off")).where(F.col("off") <= TRIM_OFF_M).select("line")


def split(curve: DataFrame, at: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """The points of each key's curve with side: behind (up to the place ``at``) or ahead (from it on), both with a point at exactly that place.

    curve(key, x, y), x once for each key; at(key, place). Between points the curve is linear, beyond its ends flat. A key without a curve gives no rows.
    """
    rows = curve.join(at.select(key, F.col("place").alias("_p")), key)
    before, after = F.col(x) <= F.col("_p"), F.col(x) >= F.col("_p")
    sides = F.filter(F.array(F.when(before, "behind"), F.when(after, "ahead")), lambda s: s.isNotNull())
    own = rows.withColumn("side", F.explode(sides)).select(key, "side", x, y)
    around = rows.groupBy(key, "_p").agg(F.max_by(F.struct(F.col(x).alias("x"), F.col(y).alias("y")), F.when(before, F.col(x))).alias("a"), F.min_by(F.struct(F.col(x).alias("x"), F.col(y).alias("y")), F.when(after, F.col(x))).alias("b"))
    between = F.col("a.y") + (F.col("b.y") - F.col("a.y")) * ((F.col("_p") - F.col("a.x")) / F.nullif(F.col("b.x") - F.col("a.x"), F.lit(0.0)))
    new = around.where("not (a.x <=> _p)").select(key, F.explode(F.array(F.lit("behind"), F.lit("ahead"))).alias("side"), F.col("_p").alias(x), F.coalesce(between, "a.y", "b.y").alias(y))
    return own.unionByName(new)


def match_stops(legs: DataFrame, stops: DataFrame) -> DataFrame:
    """plan, stop, from_start_m: a plan's stops in order, each at the end of the first leg after the last match that leads to its name.

    legs(plan, seq, to_name, dist_m); stops(plan, stop, name). One pass: a stop that no leg leads to holds back all after it. A plan's legs
    are a few tens, so its pass is a fold over one row, in the JVM.
    """
    named = stops.groupBy("plan").agg(F.array_sort(F.collect_list(F.struct("stop", "name"))).alias("stops"))
    rows = legs.groupBy("plan").agg(F.array_sort(F.collect_list(F.struct("seq", "to_name", "dist_m"))).alias("legs")).join(named, "plan")
    start = F.struct(F.lit(0.0).alias("m"), F.array().cast("array<double>").alias("at"))

    def step(state: Column, leg: Column) -> Column:
        m, n = state["m"] + leg["dist_m"], F.size(state["at"])
        hit = F.coalesce(F.get("stops", n)["name"] == leg["to_name"], F.lit(False))
        return F.struct(m.alias("m"), F.when(hit, F.concat(state["at"], F.array(m))).otherwise(state["at"]).alias("at"))

    found = rows.select("plan", "stops", F.aggregate("legs", start, step, lambda s: s["at"]).alias("at"))
    return found.select("plan", F.explode(F.transform(F.arrays_zip("at", F.slice("stops", F.lit(1), F.size("at"))), lambda x: F.struct(x["1"]["stop"].alias("stop"), x["at"].alias("from_start_m")))).alias("m")).select("plan", "m.*")
