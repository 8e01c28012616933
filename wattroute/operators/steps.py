"""Turn-by-turn steps of a route from the junctions that it passes.

Each junction is a row: the edge before, the edge after, and the array of all edges that leave it (bounded by a node's degree). The rules
are one chain of conditions over that row; roundabouts are runs of rows. Nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattroute.functions import geo, road, rules, text
from wattroute.operators import guidance

# Degrees that still count as straight and as slight, what makes an angle or a slower road obvious.
STRAIGHT, SLIGHT, FUZZ, RATIO, SLOWER = 20.0, 40.0, 25.0, 1.4, 2.0
EDGE = ["slot", "src", "dst", "length_m", "speed_kmh", "flags", "name", "ref", "leave_deg", "arrive_deg"]


def signage(steps: DataFrame, signs: DataFrame, exits: DataFrame) -> DataFrame:
    """Adds dest, dest_ref and exit_ref: of the edge's sign; the exit of the sign, else of the node; empty where there is none.

    signs(slot, dest, dest_ref, junction_ref), exits(node, exit_ref).
    """
    out = steps.join(signs, "slot", "left").join(exits, "node", "left")
    text_of = lambda c: F.coalesce(c, F.lit(""))
    exit_ref = F.coalesce(F.nullif(text_of("junction_ref"), F.lit("")), F.col("exit_ref"), F.lit(""))
    return out.withColumn("exit_ref", exit_ref).withColumn("dest", text_of("dest")).withColumn("dest_ref", text_of("dest_ref")).drop("junction_ref")


def steps(route_edges: DataFrame, edges: DataFrame) -> DataFrame:
    """route, along_m, maneuver, modifier, exit_count, name, ref, slot, node of each step, in order of along_m and ord.

    route_edges(route, ord from 0, slot); edges(EDGE): flags of road.guide_flags, empty text for no name, bearings at both ends.
    """
    outs = edges.groupBy(F.col("src").alias("node")).agg(F.collect_list(F.struct("slot", "dst", "speed_kmh", "flags", "leave_deg")).alias("outs"))
    w = Window.partitionBy("route").orderBy("ord")
    r = route_edges.join(edges.select(*EDGE), "slot").withColumn("node", F.col("src"))
    prev = {c: F.lag(c).over(w).alias(f"p_{c}") for c in ("src", "flags", "name", "ref", "speed_kmh", "arrive_deg")}
    r = r.select("*", *prev.values(), (F.sum("length_m").over(w) - F.col("length_m")).alias("along_m")).join(outs, "node", "left")

    round_, p_round = road.flag_round(F.col("flags")), F.coalesce(road.flag_round(F.col("p_flags")), F.lit(False))
    first = F.col("p_src").isNull()
    r = r.withColumn("entry", (round_ & ~p_round).cast("int")).withColumn("run", F.sum("entry").over(w))
    exits = (~first & p_round & F.exists("outs", lambda e: ~road.flag_round(e["flags"]))).cast("int")
    of_run = Window.partitionBy("route", "run").orderBy("ord")
    r = r.withColumn("exits", F.sum(exits).over(of_run)).withColumn("entry_m", F.min("along_m").over(of_run)).withColumn("entry_ord", F.min("ord").over(of_run))

    delta = lambda e: geo.signed_turn_deg(e - F.col("p_arrive_deg"))
    r = r.withColumn("delta", delta(F.col("leave_deg"))).withColumn("dev", F.abs("delta"))
    r = r.withColumn("alts", F.filter("outs", lambda e: (e["slot"] != F.col("slot")) & (e["dst"] != F.col("p_src"))))
    off = lambda e: F.abs(delta(e["leave_deg"]))
    link, p_link, kind, p_kind = road.flag_link(F.col("flags")), road.flag_link(F.col("p_flags")), road.flag_kind(F.col("flags")), road.flag_kind(F.col("p_flags"))
    near = F.filter("alts", lambda e: off(e) <= SLIGHT)
    keeps = (kind == p_kind) & (link == p_link)
    same = rules.similar(F.col("p_name"), F.col("p_ref"), F.col("name"), F.col("ref"))
    straight, slight = F.col("dev") <= STRAIGHT, F.col("dev") <= SLIGHT
    main_road = keeps & F.forall(near, lambda e: road.flag_link(e["flags"]))
    same_name = straight & (F.col("name") != "") & (F.col("name") == F.col("p_name"))
    dead_end = F.forall("outs", lambda e: (e["dst"] == F.col("p_src")) | (off(e) > SLIGHT))
    obvious = (
        F.forall("alts", lambda e: off(e) > F.greatest(F.col("dev") * RATIO, F.col("dev") + FUZZ))
        | (straight & keeps & F.forall("alts", lambda e: rules.class_priority(e["flags"]) < rules.class_priority(F.col("flags"))))
        | (same & F.forall("alts", lambda e: e["speed_kmh"] * SLOWER <= F.col("speed_kmh"))) | (straight & same)
    )
    rename = F.when(~same & (F.col("name") != ""), "continue")
    forked = slight & (F.size(near) > 0)
    maneuver = (
        F.when(first, "depart").when(p_round & ~round_, "roundabout").when(p_round | round_, F.lit(None).cast("string"))
        .when(F.size("alts") == 0, rename).when(link & ~p_link, F.when(p_kind.isin(1, 2), "off ramp").otherwise("on ramp"))
        .when(forked, F.when(main_road | same_name, rename).otherwise("fork")).when(~slight & dead_end, "end of road").when(slight & obvious, rename).otherwise("turn")
    )
    r = r.withColumn("maneuver", maneuver)
    banded = text.turn_modifier(F.col("delta"))
    modifier = F.when(F.col("maneuver").isin("depart", "roundabout", "continue"), "straight").when(F.col("maneuver") == "fork", F.when(F.col("delta") < 0, "slight left").otherwise("slight right")).otherwise(banded)
    ring = F.col("maneuver") == "roundabout"
    # a roundabout's step stands at its entry: the row's own run is the one it leaves, as no new one has begun
    made = r.where("maneuver is not null").select(
        "route", F.when(ring, F.col("entry_ord")).otherwise(F.col("ord")).alias("ord"), F.when(ring, F.col("entry_m")).otherwise(F.col("along_m")).alias("along_m"), "maneuver", modifier.alias("modifier"),
        F.when(ring, F.greatest(F.col("exits"), F.lit(1))).cast("int").alias("exit_count"), "name", "ref", "slot", "node",
    )
    end = r.groupBy("route").agg(F.max(F.struct("ord", (F.col("along_m") + F.col("length_m")).alias("along_m"), "slot", "dst")).alias("l"))
    arrive = end.select("route", (F.col("l.ord") + 1).alias("ord"), F.col("l.along_m").alias("along_m"), F.lit("arrive").alias("maneuver"), F.lit("straight").alias("modifier"), F.lit(None).cast("int").alias("exit_count"), F.lit("").alias("name"), F.lit("").alias("ref"), "l.slot", F.col("l.dst").alias("node"))
    return guidance.drop_short_renames(made.unionByName(arrive), "route", "along_m", "maneuver", "ord")


def end_bearings(vertices: DataFrame, key: str, seq: str) -> DataFrame:
    """key, leave_deg, arrive_deg: bearings of the first and the last piece of a line that has a length; null where none has (take its ends then)."""
    w = Window.partitionBy(key).orderBy(seq)
    before = [F.lag(c).over(w) for c in ("lat", "lon")]
    moved = (before[0] != F.col("lat")) | (before[1] != F.col("lon"))
    pieces = vertices.select(key, seq, moved.alias("moved"), geo.bearing_deg(*before, F.col("lat"), F.col("lon")).alias("deg")).where("moved")
    return pieces.groupBy(key).agg(F.min_by("deg", seq).alias("leave_deg"), F.max_by("deg", seq).alias("arrive_deg"))
