"""Queries of calibration, corridors, networks, documents and telemetry, each with SQL for DuckDB where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattroute.functions import dialogue, geo, physics, road, text
from wattroute.operators import calibration, corridor, documents, network, sequences, spatial, steps
from wattroute.plans.catalogue import _hav, _lerp_sql, _with, rounded
from wattroute.sources.views import table, view
from wattroute.streaming import sessions

QUALIFYING_M = 10_000.0  # the tables hold short trips
EPOCH = 1_700_000_000


def _fixes(spark: SparkSession, d: str) -> DataFrame:
    """Every ninth fix repeats the time of the one before."""
    return view(spark, d, "v_fix").withColumn("t_s", F.col("t_s") - F.when(F.col("seq") % 9 == 4, 10.0).otherwise(0.0))


def replay_trips(spark: SparkSession, d: str) -> DataFrame:
    trips = view(spark, d, "v_trip").select("trip_id", "vehicle", F.coalesce("ambient_temp_c", F.lit(15.0)).alias("temp_c"), F.lit(1.0).alias("k"))
    got = calibration.replay(_fixes(spark, d), trips)
    return got.select("trip_id", "vehicle", rounded(F.col("distance_m"), 4).alias("distance_m"), rounded(F.col("predicted_wh"), 4).alias("predicted_wh"))


def calibration_trips(spark: SparkSession, d: str) -> DataFrame:
    rows, _ = calibration.calibrate(view(spark, d, "v_trip"), _fixes(spark, d), QUALIFYING_M)
    number = [rounded(F.col(c), 5).alias(c) for c in ("distance_m", "actual_wh", "predicted_wh", "ratio", "error_points")]
    return rows.select("requested", "trip_id", F.col("start_unix").cast("bigint").alias("start_unix"), *number, "qualifying", "measured", "excluded_reason")


def calibration_summary(spark: SparkSession, d: str) -> DataFrame:
    _, summary = calibration.calibrate(view(spark, d, "v_trip"), _fixes(spark, d), QUALIFYING_M)
    return summary.select("requested", *[rounded(F.col(c), 5).alias(c) for c in ("median_ratio", "reference_wh_per_km", "mae_points", "max_error_points")], "accepted")


def reference_use(spark: SparkSession, d: str) -> DataFrame:
    """Reference consumption of each vehicle, and the scalars that make it what each nation asks for."""
    n = table(spark, d, "nation").select("n_nationkey", (F.col("n_nationkey") * 4 + 150.0).alias("wanted"))
    parts = [n.select("n_nationkey", F.lit(v).alias("vehicle"), rounded(calibration.reference_wh_per_km(car)).alias("reference"), rounded(calibration.scale_for(car, F.col("wanted"))).alias("scale")) for v, car in calibration.VEHICLES.items()]
    return parts[0].unionByName(parts[1])


def charge_lookup(spark: SparkSession, d: str) -> DataFrame:
    n = F.regexp_extract("id", "([0-9]+)$", 1).cast("int")
    asks = view(spark, d, "v_charger").select("id", F.col("max_power_kw").alias("power_kw"), (n % 40 / 100).alias("from_soc"), (n % 90 / 100 + 0.1234).alias("to_soc"))
    got = calibration.charge_seconds(asks, calibration.charge_table(asks, physics.ALL_WHEEL, 0.5))
    return got.select("id", rounded(F.col("charge_s"), 3).alias("charge_s"))


def _line(spark: SparkSession, d: str) -> DataFrame:
    """Each column of nodes is a route north; an edge leads over the middle to the next node."""
    n = view(spark, d, "v_node").withColumn("route", F.floor(F.col("node_id") / 40))
    edges = n.where("node_id % 40 < 39").select("route", (F.col("node_id") % 40).alias("ord"), F.col("node_id").alias("edge"))
    vertices = n.select(F.col("node_id").alias("edge"), "lat", "lon", F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("seq")).withColumn("lat", F.col("lat") + F.col("seq") * 0.0025)
    return corridor.route_line(edges, vertices)


def route_lines(spark: SparkSession, d: str) -> DataFrame:
    return _line(spark, d).select("route", "pos", rounded(F.col("lat")).alias("lat"), "lon", rounded(F.col("cum_m"), 4).alias("cum_m"))


def corridor_sites(spark: SparkSession, d: str) -> DataFrame:
    sites = view(spark, d, "v_charger").select(F.col("id").alias("site"), "lat", "lon")
    got = corridor.in_corridor(sites, sequences.downsample(_line(spark, d), "route", "pos", "cum_m"), 3000.0)
    return got.select("route", "site", rounded(F.col("pos_m"), 3).alias("pos_m"), rounded(F.col("off_m"), 3).alias("off_m"))


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    n = F.regexp_extract("id", "([0-9]+)$", 1).cast("int")
    return view(spark, d, "v_charger").select(F.col("country").alias("route"), (n % 4).alias("segment"), n.alias("ord"), F.col("id").alias("site"), "lat", "lon", F.col("max_power_kw").alias("power_kw"))


def site_doubles(spark: SparkSession, d: str) -> DataFrame:
    """Tested against the plain double loop."""
    return corridor.drop_doubles(_candidates(spark, d), ["route", "segment"], 4000.0).select("route", "segment", "ord", "site")


def journey_cap(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("node_id")
    c = view(spark, d, "v_node").select(F.lit(1).alias("journey"), F.floor(n / 100).alias("segment"), (n % 100).alias("ord"), (n * 37 % 11 * 50.0).alias("power_kw"), "node_id")
    return corridor.strongest_overall(c, "journey").select("node_id", "power_kw")


def waypoint_sites(spark: SparkSession, d: str) -> DataFrame:
    c = _candidates(spark, d)
    waypoints = c.where("segment < 3").groupBy("route", F.col("segment").alias("waypoint")).agg((F.min_by("lat", "ord") + 0.0005).alias("lat"), F.min_by("lon", "ord").alias("lon"))
    best, left = corridor.merge_waypoints(c, waypoints, 3000.0)
    return best.select("route", "waypoint", "site").unionByName(left.select("route", F.lit(-1).alias("waypoint"), "site"))


def route_projection(spark: SparkSession, d: str) -> DataFrame:
    """Each charger on the route of its column of nodes."""
    points = view(spark, d, "v_charger").select(F.floor(F.round((F.col("lon") - 5) / 0.007, 6)).alias("route"), "id", "lat", "lon")
    return corridor.project(points, _line(spark, d), "route").select("route", "id", rounded(F.col("along_m"), 2).alias("along_m"), rounded(F.col("off_m"), 3).alias("off_m"))


def adjacency(spark: SparkSession, d: str) -> DataFrame:
    texts = [F.concat_ws(",", F.transform(c, lambda x: x.cast("string"))).alias(c) for c in ("out", "into")]
    return network.neighbours(view(spark, d, "v_edge")).select("node_id", *texts)


def reverse_index(spark: SparkSession, d: str) -> DataFrame:
    return network.offsets(view(spark, d, "v_edge"), "dst")


def cheapest_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges between blocks of four nodes are parallel."""
    e = view(spark, d, "v_edge")
    e = e.select((F.col("src") * 1000000 + F.col("dst")).alias("slot"), F.floor(F.col("src") / 4).alias("src"), F.floor(F.col("dst") / 4).alias("dst"), "length_m", "speed_kmh")
    return network.cheapest_parallel(e).select("src", "dst", "slot", rounded(F.col("cost_s")).alias("cost_s"))


def way_import(spark: SparkSession, d: str) -> DataFrame:
    """Two files: the second repeats the ways of every second number as motorways."""
    w = view(spark, d, "v_way")
    one = w.select(F.lit(0).alias("file"), F.col("way_id").alias("pos"), "way_id", "highway", "maxspeed", F.sequence(F.lit(0), F.col("way_id") % 4).alias("refs"))
    two = w.select(F.lit(1).alias("file"), (-F.col("way_id")).alias("pos"), (F.floor(F.col("way_id") / 2) * 2 + 1000).alias("way_id"), F.lit("motorway").alias("highway"), "maxspeed", F.array(F.lit(0), F.lit(1)).cast("array<bigint>").alias("refs"))
    files = one.withColumn("refs", F.col("refs").cast("array<bigint>")).unionByName(two)
    got = network.accept_ways(files, road.default_speed_kmh(F.col("highway")), road.max_speed_kmh(F.col("maxspeed")))
    return got.select("way_id", "file", "pos", "speed_kmh", F.size("refs").alias("nodes"))


def _refs(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "v_way").select("way_id", F.posexplode(F.array(*[F.col("way_id") + k for k in (0, 3, 7)])).alias("pos", "node_id"))


def junction_nodes(spark: SparkSession, d: str) -> DataFrame:
    found, _ = network.needed_nodes(_refs(spark, d), view(spark, d, "v_node"))
    return found.select("node_id", "uses", "junction")


def missing_nodes(spark: SparkSession, d: str) -> DataFrame:
    return network.needed_nodes(_refs(spark, d), view(spark, d, "v_node"))[1]


def name_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ways with the number of their name, and the name read back from it (empty for none)."""
    w = view(spark, d, "v_way").withColumn("name", F.when(F.col("way_id") % 5 != 0, F.col("name")))
    ids = network.dictionary(w, "name", "way_id")
    coded = w.join(ids, "name", "left").select("way_id", F.coalesce("id", F.lit(0)).alias("name_id"))
    return coded.join(F.broadcast(ids.select(F.col("id").alias("name_id"), "name")) if ids.count() <= 10_000 else ids.select(F.col("id").alias("name_id"), "name"), "name_id", "left").select("way_id", "name_id", F.coalesce("name", F.lit("")).alias("name"))


def snap_cells(spark: SparkSession, d: str) -> DataFrame:
    return network.snap_cells(view(spark, d, "v_node"), 0.03)


def _one_way(spark: SparkSession, d: str) -> DataFrame:
    """Edges that ECONOMY parts begin lead towards the higher number only, so some nodes cannot be reached or left."""
    one, a, b = F.col("road_class") == 1, F.col("src"), F.col("dst")
    return view(spark, d, "v_edge").select(F.when(one, F.least(a, b)).otherwise(a).alias("src"), F.when(one, F.greatest(a, b)).otherwise(b).alias("dst"))


def strong_parts(spark: SparkSession, d: str) -> DataFrame:
    """Tested against a plain search."""
    return network.strong_components(_one_way(spark, d))


def largest_part(spark: SparkSession, d: str) -> DataFrame:
    """Tested against a plain search."""
    return network.largest_component(_one_way(spark, d)).select("src", "dst", "from_id", "to_id")


def nearest_anywhere(spark: SparkSession, d: str) -> DataFrame:
    """Customers' places all over the globe."""
    k = F.col("c_custkey")
    points = table(spark, d, "customer").select(k.alias("id"), (k * 7919 % 1500 / 10 - 70.0).alias("lat"), (k * 104729 % 3600 / 10 - 180.0).alias("lon"))
    nodes = table(spark, d, "supplier").select(F.col("s_suppkey").alias("node_id"), (F.col("s_suppkey") * 37 % 140 - 60.5).alias("lat"), (F.col("s_suppkey") * 53 % 360 - 180.25).alias("lon"))
    return spatial.nearest_node_anywhere(points, nodes, 1.0)


def pack_round_trip(spark: SparkSession, d: str) -> DataFrame:
    return documents.read_packs(documents.charger_packs(view(spark, d, "v_charger"), "country", EPOCH)).select("region", "id", "name", "lat", "lon", "operator", "max_power_kw")


def log_round_trip(spark: SparkSession, d: str) -> DataFrame:
    return documents.read_logs(documents.trip_logs(view(spark, d, "v_trip"), view(spark, d, "v_fix"))).select("id", "vehicle", "start_unix", "seq", "t_s", "speed_mps", "alt_m")


def placemark_feed(spark: SparkSession, d: str) -> DataFrame:
    """A document for each nation with a placemark for each of its chargers; every third is no fast one, every seventh without a place."""
    n = F.regexp_extract("id", "([0-9]+)$", 1).cast("int")
    name = F.when(n % 3 == 0, F.lit("Chargy ")).otherwise(F.lit("SuperChargy "))
    at = F.when(n % 7 == 0, F.lit("none")).otherwise(F.concat_ws(",", F.col("lon").cast("string"), F.col("lat").cast("string"), F.lit("0")))
    mark = F.concat(F.lit("<Placemark><name>"), name, "id", F.lit("</name><coordinates> "), at, F.lit(" </coordinates></Placemark>"))
    files = view(spark, d, "v_charger").groupBy("operator").agg(F.array_sort(F.collect_list(F.struct(n.alias("n"), mark.alias("mark")))).alias("m"))
    files = files.select("operator", F.concat(F.lit("<kml>"), F.array_join(F.transform("m", lambda x: x["mark"]), ""), F.lit("</kml>")).alias("body"))
    return documents.placemarks(files, "operator", "body")


def feed_times(spark: SparkSession, d: str) -> DataFrame:
    stamp = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    bad = F.when(F.col("event_id") % 10 == 0, F.replace(stamp, F.lit("T"), F.lit(" "))).otherwise(stamp)
    return table(spark, d, "events").select("event_id", documents.epoch_of(bad).alias("epoch"))


def remote_catalog(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    region = F.when(k % 4 == 0, F.col("n_name")).otherwise(F.concat(F.lit("eu-"), k.cast("string")))
    file = F.when(k % 5 == 0, F.lit("../x")).when(k % 5 == 1, F.lit("/x")).otherwise(F.concat(F.lit("a/"), k.cast("string")))
    sha = F.when(k % 3 != 0, F.sha2(F.col("n_name").cast("binary"), 256)).when(k % 2 == 0, F.upper(F.sha2(F.col("n_name").cast("binary"), 256)))
    return documents.catalog_problems(table(spark, d, "nation").select(region.alias("region"), file.alias("file"), sha.alias("sha256")))


def publish_plan(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    n = table(spark, d, "nation").select(k, F.concat(F.lit("epoch/"), F.col("n_name")).alias("path"), F.md5(F.col("n_name").cast("binary")).alias("md5"))
    return documents.publish_plan(n.select("path", "md5"), n.where(k % 3 != 0).select("path", F.when(k % 3 == 1, F.col("md5")).otherwise(F.lit("other")).alias("md5")))


def feed_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Chargers by operator as feeds in a row; every nation's feed is required."""
    rows = view(spark, d, "v_charger").where("max_power_kw >= 300").select(F.col("operator").alias("feed"))
    return documents.feed_outcome(rows, table(spark, d, "nation").select(F.col("n_name").alias("feed")))


_REQUEST = "case event_id % 4 when 0 then '220101' when 1 then '22F190' when 2 then '1003' else '21' end"


def _exchange(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    e = view(spark, d, "v_payload").withColumn("request", F.expr(_REQUEST))
    answer = F.when(k % 5 == 0, "7F2231").when(k % 5 == 1, "7F22").when(k % 5 == 2, F.col("payload_hex")).when(k % 5 == 3, "6ABC").otherwise("50030032")
    return e.select("event_id", "session_id", "request", answer.alias("answer"))


def conclusions(spark: SparkSession, d: str) -> DataFrame:
    e = _exchange(spark, d).withColumn("c", dialogue.conclusion(F.col("request"), F.col("answer")))
    return e.select("event_id", "c.kind", "c.detail", dialogue.echoes(F.col("answer"), F.col("request")).alias("echo"))


def setup_lists(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    return table(spark, d, "nation").select("n_nationkey", F.array_join(dialogue.setup_commands(k + 2016, k + 8), ";").alias("commands"))


def poll_lists(spark: SparkSession, d: str) -> DataFrame:
    """Parts of a brand are the commands of a profile, their type the target; some need a session, some ask only for cells beyond the pack's 180."""
    k = F.col("p_partkey")
    c = table(spark, d, "part").select(F.col("p_brand").alias("profile"), k.alias("ord"), F.col("p_type").alias("target"), F.concat(F.lit("22"), F.lpad(F.hex(k % 65536), 4, "0")).alias("uds"), F.when(k % 3 == 0, "1003").alias("session"), F.when(k % 7 == 0, F.array().cast("array<struct<signal:string,first_index:bigint>>")).otherwise(F.array(F.struct(F.when(k % 2 == 0, "cell_voltage").otherwise("soc").alias("signal"), (k % 250).cast("bigint").alias("first_index")))).alias("signals"))
    asked = c.where(dialogue.command_relevant(F.col("signals"), F.lit(180)))
    return dialogue.poll_list(asked, "profile")


def _commands(spark: SparkSession) -> DataFrame:
    rows = [("a", 0, "22F190", None), ("a", 1, "220101", "1003"), ("a", 2, "2201", None), ("b", 3, "220101", None)]
    return spark.createDataFrame(rows, "target string, ord int, uds string, session string")


def payload_commands(spark: SparkSession, d: str) -> DataFrame:
    e = _exchange(spark, d).select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 2 == 0, "a").otherwise("b").alias("target"), F.col("answer").alias("payload_hex"))
    return dialogue.first_command(e, _commands(spark)).withColumnRenamed("id", "event_id")


def session_answers(spark: SparkSession, d: str) -> DataFrame:
    e = _exchange(spark, d).select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 2 == 0, "a").otherwise("b").alias("target"), F.col("answer").alias("payload_hex"))
    return dialogue.is_session_answer(e, _commands(spark)).withColumnRenamed("id", "event_id")


def reading_rows(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    kind = F.when(k % 3 == 0, "canonical").when(k % 3 == 1, "extra").otherwise("failed")
    e = table(spark, d, "events").select(k.alias("id"), kind.alias("kind"), F.col("event_type").alias("name"), (k / 2).alias("value"), F.when(k % 2 == 0, "on").alias("text"), F.lit("V").alias("unit"), F.lit("timeout").alias("reason"))
    return dialogue.readings(e)


def adapter_payloads(spark: SparkSession, d: str) -> DataFrame:
    """Each request's frames: a first and two consecutive ones; every fifth request's last has the wrong number, every seventh is a single frame."""
    k = F.col("event_id")
    frames = F.when(k % 7 == 0, F.array(F.concat(F.lit("03"), F.substring("payload_hex", 1, 14)))).otherwise(
        F.array(F.concat(F.lit("1010"), F.substring("payload_hex", 1, 12)), F.concat(F.lit("21"), F.substring("payload_hex", 13, 14)), F.concat(F.when(k % 5 == 0, F.lit("23")).otherwise(F.lit("22")), F.substring("payload_hex", 27, 14)))
    )
    f = view(spark, d, "v_payload").select(F.col("session_id").alias("session"), k.alias("request"), F.posexplode(frames).alias("seq", "frame"))
    return sessions.payloads(f)


def lenient_fields(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    number = F.concat(F.lit(" "), (k % 90).cast("string"), F.when(k % 3 == 0, F.lit(",5 ")).when(k % 3 == 1, F.lit(".25")).otherwise(F.lit("x")))
    place = F.when(k % 4 == 0, F.concat(F.lit("["), (k % 180).cast("string"), F.lit("; 1]"))).otherwise(F.concat(F.lit("["), (k % 180).cast("string"), F.lit(".5, -"), (k % 90).cast("string"), F.lit("]")))
    at = text.lon_lat(place)
    return table(spark, d, "customer").select("c_custkey", text.loose_double(number).alias("number"), at["lat"].alias("lat"), at["lon"].alias("lon"))


def signed_turns(spark: SparkSession, d: str) -> DataFrame:
    turn = ((F.col("src") * 37 - F.col("dst") * 11) % 1080).cast("double")
    return view(spark, d, "v_edge").select("src", "dst", geo.signed_turn_deg(turn).alias("turn"), road.flag_kind((F.col("src") % 64).cast("int")).alias("kind"), road.flag_link((F.col("src") % 64).cast("int")).alias("link"), road.flag_round((F.col("src") % 64).cast("int")).alias("round"))


def step_texts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    pick = lambda names, n: F.element_at(F.array(*[F.lit(x) for x in names]), (n % len(names) + 1).cast("int"))
    w = table(spark, d, "part").select("p_partkey", pick(text.MANEUVERS, k).alias("maneuver"), pick([m for m, _ in text.MODIFIERS], F.floor(k / 10)).alias("modifier"), F.when(k % 4 != 0, F.col("p_brand")).otherwise("").alias("name"), F.when(k % 3 == 0, F.lit("A1;B 2")).otherwise("").alias("ref"), F.when(k % 5 == 0, "12b").otherwise("").alias("exit_ref"), F.when(k % 6 != 0, k % 25).alias("exit_count"))
    return w.select("p_partkey", text.step_text(*[F.col(c) for c in ("maneuver", "modifier", "name", "ref", "exit_ref", "exit_count")]).alias("text"))


def route_steps(spark: SparkSession, d: str) -> DataFrame:
    """From every node a staircase north and east over five edges; roads are the ways of their first node. Tested on literal junctions."""
    n = view(spark, d, "v_node")
    ends = lambda c: n.select(F.col("node_id").alias(c), F.col("lat").alias(f"{c}_lat"), F.col("lon").alias(f"{c}_lon"))
    ways = view(spark, d, "v_way").select(F.col("way_id").alias("src"), road.guide_flags(F.col("highway"), F.col("junction")).alias("flags"), F.coalesce("name", F.lit("")).alias("name"), F.lit("").alias("ref"))
    deg = geo.bearing_deg(*[F.col(c) for c in ("src_lat", "src_lon", "dst_lat", "dst_lon")])
    e = view(spark, d, "v_edge").join(ends("src"), "src").join(ends("dst"), "dst").join(ways, "src")
    e = e.select((F.col("src") * 1000000 + F.col("dst")).alias("slot"), "src", "dst", "length_m", "speed_kmh", "flags", "name", "ref", deg.alias("leave_deg"), deg.alias("arrive_deg"))
    moves = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(a).alias("a"), F.lit(b).alias("b")) for i, (a, b) in enumerate([(0, 1), (1, 41), (41, 42), (42, 82), (82, 83)])])
    path = n.select(F.col("node_id").alias("route"), F.inline(moves)).withColumn("slot", (F.col("route") + F.col("a")) * 1000000 + F.col("route") + F.col("b")).select("route", "ord", "slot")
    whole = path.join(e.select("slot"), "slot", "left_semi").groupBy("route").agg(F.count(F.lit(1)).alias("n")).where("n = 5").select("route")
    got = steps.steps(path.join(whole, "route", "left_semi"), e)
    return got.select("route", "ord", rounded(F.col("along_m"), 3).alias("along_m"), "maneuver", "modifier", "exit_count", "name")


QUERIES = [
    replay_trips, calibration_trips, calibration_summary, reference_use, charge_lookup, route_lines, corridor_sites, site_doubles, journey_cap, waypoint_sites, route_projection, adjacency,
    reverse_index, cheapest_edges, way_import, junction_nodes, missing_nodes, name_ids, snap_cells, strong_parts, largest_part, nearest_anywhere, pack_round_trip, log_round_trip, placemark_feed,
    feed_times, remote_catalog, publish_plan, feed_outcomes, conclusions, setup_lists, poll_lists, payload_commands, session_answers, reading_rows, adapter_payloads, lenient_fields, signed_turns, step_texts, route_steps,
]


def _wh_sql(mass: str, length: str, kmh: str, dv: str, temp: str, alt: str, k: str = "1.0") -> str:
    """Energy of a flat stretch; ``k`` scales rolling, air and climate."""
    v, d = f"(({kmh})/3.6::double)", f"(({dv})/3.6::double)"
    rho = f"(1.225*288.15::double/({temp}+273.15::double)*exp(-({alt})/8435.0::double))"
    pull = f"({k}*0.0099::double*{mass}*9.80665::double*({length}) + {k}*0.5*{rho}*0.75::double*{v}*{v}*({length}) + 0.5*{mass}*1.04::double*(2*{v}*{d}-{d}*{d}))"
    drive, hvac = f"(0.85::double*(1-{_lerp_sql(temp, [(-10.0, 0.02), (5.0, 0.0)])}))", _lerp_sql(temp, physics.HVAC_W)
    return f"((case when {pull} >= 0 then {pull}/{drive} else {pull}*0.65::double end + (300+{k}*{hvac})*(case when {v} > 0 then ({length})/{v} else 0 end))/3600.0::double)"


_MASS = "(case vehicle when 'ev_awd' then 2095.0::double else 1985.0::double end)"
_DRIVE = f"(0.85::double*(1-{_lerp_sql('temp', [(-10.0, 0.02), (5.0, 0.0)])}))"
_PAIRS = f""", fx as (select trip_id, seq, t_s - case when seq % 9 = 4 then 10 else 0 end t, lat, lon, speed_mps, alt_m from v_fix),
  lg as (select b.trip_id, b.seq, a.seq is null as first, b.t - a.t dt, {_hav('a', 'b')} len, (b.speed_mps - a.speed_mps) * 3.6::double logged, coalesce(a.alt_m, 0) alt0, b.alt_m from fx b left join fx a on a.trip_id = b.trip_id and a.seq = b.seq - 1),
  mv as (select *, len / dt * 3.6::double kmh from lg where dt > 0), sg as (select *, coalesce(logged, kmh - coalesce(lag(kmh) over (partition by trip_id order by seq), 0)) dv from mv),
  rd as (select trip_id, alt_m, row_number() over (partition by trip_id order by seq) k from lg where alt_m is not null and (first or dt > 0)),
  walk as (select trip_id, k, alt_m as ref, 0.0::double up, 0.0::double down from rd where k = 1 union all
    select rd.trip_id, rd.k, case when abs(alt_m - ref) > 3 then alt_m else ref end, up + case when alt_m - ref > 3 then alt_m - ref else 0 end, down + case when ref - alt_m > 3 then ref - alt_m else 0 end from walk join rd on rd.trip_id = walk.trip_id and rd.k = walk.k + 1),
  cl as (select trip_id, arg_max(up, k) up, arg_max(down, k) down from walk group by 1), tr as (select *, coalesce(ambient_temp_c, 15) temp from v_trip)"""


def _replay_sql(name: str, source: str, k: str) -> str:
    """CTE of trip_id, distance, wh from a CTE of trips (trip_id, vehicle, temp, ...)."""
    return f""", {name}_f as (select {source}.trip_id, sum(len) dist, sum({_wh_sql(_MASS, 'len', 'kmh', 'dv', 'temp', 'alt0', k)}) flat from {source} join sg using (trip_id) group by 1),
  {name} as (select {source}.trip_id, coalesce({name}_f.dist, 0) dist, coalesce({name}_f.flat + (coalesce(up, 0) * {_MASS} * 9.80665::double / {_DRIVE} - coalesce(down, 0) * {_MASS} * 9.80665::double * 0.65::double) / 3600, 0) wh from {source} left join {name}_f using (trip_id) left join cl using (trip_id))"""


def _reference_sql(k: str) -> str:
    return _wh_sql(_MASS, "1000.0::double", "110.0::double", "0.0::double", "23.0::double", "0.0::double", k)


_FIT = _with("v_fix", "v_trip") + _PAIRS + _replay_sql("r1", "tr", "1.0") + f""",
  en as (select *, end_charge_kwh - start_charge_kwh put, end_discharge_kwh - start_discharge_kwh took from tr),
  ac as (select *, coalesce(put >= 0 and took >= 0, false) counted, coalesce(start_display_soc_pct > end_display_soc_pct, false) shown, start_soc_pct > end_soc_pct fell from en),
  ex as (select ac.*, dist, wh, req requested, case when counted then case when took > put then (took - put) * 1000 end when shown then (start_display_soc_pct - end_display_soc_pct) / 100 * 70000 when fell then (start_soc_pct - end_soc_pct) / 100.0::double * 70000 end actual,
    coalesce(case when vehicle <> req then 'vehicle mismatch: trip log is for ' || vehicle || ', requested ' || req end, case when (select count(*) from v_fix f where f.trip_id = ac.trip_id) < 2 then 'fewer than 2 samples' end,
      case when counted and took <= put then 'no net discharge (measured)' when not counted and not shown and not fell then 'no net discharge' end, case when wh <= 0 then 'predicted energy is not positive' end) why
    from ac join r1 using (trip_id), (values ('ev_2wd'), ('ev_awd')) v(req)),
  us as (select *, actual / wh ratio from ex where why is null),
  md as (select requested, min(ratio) filter (run >= total / 2) median from (select requested, ratio, sum(wh) over (partition by requested order by ratio) run, sum(wh) over (partition by requested) total from us) group by 1),
  ft as (select *, ref * median refit, (ref * median - zero) / (ref - zero) k from (select *, {_reference_sql('1.0')} as ref, {_reference_sql('0.0')} as zero from (select requested, requested vehicle, median from md))),
  ur as (select us.*, ft.k from us join ft using (requested))""" + _replay_sql("r2", "ur", "k") + f""",
  er as (select ur.*, abs(coalesce(start_display_soc_pct, start_soc_pct) - r2.wh / 70000 * 100 - coalesce(end_display_soc_pct, end_soc_pct)) err, ur.dist >= {QUALIFYING_M} qual from ur join r2 using (trip_id))"""

_SITES = ", cs as (select country route, cast(regexp_extract(id, '([0-9]+)$', 1) as integer) n, id, lat, lon, max_power_kw p from v_charger)"
_LINE = """, nl as (select node_id // 40 route, node_id % 40 ord, lat, lon from v_node), lv as (select route, ord, s, lat + s * 0.0025::double lat, lon from nl, range(3) t(s) where ord < 39 and (s > 0 or ord = 0)),
  lp as (select route, row_number() over (partition by route order by ord, s) - 1 pos, lat, lon from lv),
  ln as (select b.route, b.pos, b.lat, b.lon, sum(case when a.pos is null then 0 else """ + _hav("a", "b") + """ end) over (partition by b.route order by b.pos) cum_m from lp b left join lp a on a.route = b.route and a.pos = b.pos - 1)"""
_TALK = """with x as (select event_id, '620101EFFBE7EF' || lpad(upper(hex(event_id%201)),2,'0') || '0000000000' || lpad(upper(hex(event_id*7919%65536)),4,'0') || lpad(upper(hex(event_id*31%65536)),4,'0') payload_hex, """ + _REQUEST + """ req from events),
  e as (select *, case event_id % 5 when 0 then '7F2231' when 1 then '7F22' when 2 then payload_hex when 3 then '6ABC' else '50030032' end ans, case when event_id % 2 = 0 then 'a' else 'b' end target from x)"""
ORACLE = {
    "replay_trips": _with("v_fix", "v_trip") + _PAIRS + _replay_sql("r1", "tr", "1.0") + " select trip_id, vehicle, round(dist, 4) distance_m, round(wh, 4) predicted_wh from r1 join tr using (trip_id)",
    "calibration_trips": _FIT + """ select requested, trip_id, cast(start_unix as bigint) start_unix, round(dist, 5) distance_m, round(actual, 5) actual_wh, round(wh, 5) predicted_wh, round(ratio, 5) ratio, round(err, 5) error_points, qual qualifying, counted measured, null::varchar excluded_reason from er
        union all select requested, trip_id, cast(start_unix as bigint), 0, 0, 0, 0, null, false, false, why from ex where why is not null""",
    "calibration_summary": _FIT + """, la as (select *, row_number() over (partition by requested order by start_unix desc, trip_id desc) n from er where qual), ok as (select requested, max(err) mx, avg(err) mae from la where n <= 10 group by 1)
        select requested, round(median, 5) median_ratio, round(refit, 5) reference_wh_per_km, round(mae, 5) mae_points, round(mx, 5) max_error_points, coalesce(mx <= 3 and mae <= 2, false) accepted from ft left join ok using (requested)""",
    "reference_use": f"with v as (select n_nationkey, n_nationkey * 4 + 150.0::double wanted, vehicle from nation, (values ('ev_2wd'), ('ev_awd')) t(vehicle)), r as (select *, {_reference_sql('1.0')} as ref, {_reference_sql('0.0')} as zero from v) select n_nationkey, vehicle, round(ref, 6) reference, round((wanted - zero) / (ref - zero), 6) scale from r",
    "route_lines": _with("v_node") + _LINE + " select route, cast(pos as integer) pos, round(lat, 6) lat, lon, round(cum_m, 4) cum_m from ln",
    "corridor_sites": _with("v_node", "v_charger") + _LINE + f", k as (select *, row_number() over (partition by route, floor(cum_m / 2000) order by pos) n, max(pos) over (partition by route) last from ln), m as (select l.route, c.id, l.pos, l.cum_m, round({_hav('c', 'l')}, 6) d from v_charger c, k l where (l.n = 1 or l.pos = l.last) and {_hav('c', 'l')} <= 3000) select route, id site, round(arg_min(cum_m, d * 1000000 + pos), 3) pos_m, round(min(d), 3) off_m from m group by 1, 2",
    "journey_cap": _with("v_node") + " select node_id, power_kw from (select node_id, node_id * 37 % 11 * 50.0::double power_kw, row_number() over (order by node_id * 37 % 11 desc, node_id // 100 desc, node_id % 100 desc) n from v_node) where n <= 300",
    "waypoint_sites": _with("v_charger") + _SITES + f""", w as (select route, n % 4 waypoint, arg_min(lat, n) + 0.0005::double lat, arg_min(lon, n) lon from cs where n % 4 < 3 group by 1, 2),
        nr as (select c.route, w.waypoint, c.n, c.id, c.p from cs c join w on w.route = c.route and c.n % 4 in (w.waypoint, w.waypoint + 1) where {_hav('c', 'w')} <= 3000)
        select route, waypoint, id site from (select *, row_number() over (partition by route, waypoint order by p desc, n % 4, n) k from nr) where k = 1 union all select route, -1, id from cs where id not in (select id from nr)""",
    "reverse_index": _with("v_edge") + " select dst, degree, cast(sum(degree) over (order by dst) - degree as bigint) first_edge from (select dst, count(*) degree from v_edge group by 1)",
    "cheapest_edges": _with("v_edge") + ", e as (select src * 1000000 + dst slot, src // 4 src, dst // 4 dst, length_m / speed_kmh * 3.6::double c from v_edge) select src, dst, slot, round(c, 6) cost_s from (select *, row_number() over (partition by src, dst order by c, slot) k from e) where k = 1",
    "way_import": _with("v_way") + """, f as (select 0 file, way_id pos, way_id, highway, maxspeed, way_id % 4 + 1 n from v_way union all select 1, -way_id, way_id // 2 * 2 + 1000, 'motorway', maxspeed, 2 from v_way), k as (select *, row_number() over (partition by way_id order by file, pos) k from f)
        select way_id, file, pos, cast(case when maxspeed is not null and maxspeed not like '%mph%' then cast(maxspeed as double) else case highway when 'residential' then 30 when 'tertiary' then 60 when 'secondary' then 70 when 'primary' then 80 when 'motorway' then 120 else 72 end end as double) speed_kmh, cast(n as integer) nodes from k where k = 1 and highway <> 'footway' and n >= 2""",
    "junction_nodes": _with("v_way", "v_node") + ", r as (select way_id + k node_id, k <> 3 e from v_way, (values (0), (3), (7)) t(k)) select node_id, count(*) uses, bool_or(e) or count(*) >= 2 junction from r where node_id in (select node_id from v_node) group by 1",
    "missing_nodes": _with("v_way", "v_node") + ", r as (select way_id + k node_id from v_way, (values (0), (3), (7)) t(k)) select node_id, count(*) uses from r where node_id not in (select node_id from v_node) group by 1",
    "name_ids": _with("v_way") + ", w as (select way_id, case when way_id % 5 <> 0 then name end as name from v_way), i as (select name, row_number() over (order by f, name) id from (select name, min(way_id) f from w where name is not null group by 1)) select way_id, cast(coalesce(id, 0) as integer) name_id, coalesce(w.name, '') as name from w left join i using (name)",
    "snap_cells": _with("v_node") + ", b as (select min(lat) a, max(lat) b, min(lon) c, max(lon) d from v_node) select node_id, cast(least(floor(round((lat - a) / 0.03::double, 9)), greatest(ceil((b - a) / 0.03::double) - 1, 0)) as bigint) as row, cast(least(floor(round((lon - c) / 0.03::double, 9)), greatest(ceil((d - c) / 0.03::double) - 1, 0)) as bigint) col from v_node, b",
    "nearest_anywhere": """with p as (select c_custkey id, c_custkey * 7919 % 1500 / 10.0::double - 70 lat, c_custkey * 104729 % 3600 / 10.0::double - 180 lon from customer), n as (select s_suppkey node_id, s_suppkey * 37 % 140 - 60.5::double lat, s_suppkey * 53 % 360 - 180.25::double lon from supplier),
        q as (select p.id, n.node_id, round(power(n.lat - p.lat, 2) + power((n.lon - p.lon) * cos(radians(p.lat)), 2), 15) d, abs(floor(n.lat) - floor(p.lat)) <= 1 and abs(floor(n.lon) - floor(p.lon)) <= 1 near from p, n)
        select id, node_id from (select *, row_number() over (partition by id order by near desc, d, node_id) k from q) where k = 1""",
    "pack_round_trip": _with("v_charger") + " select country region, id, name, lat, lon, operator, max_power_kw from v_charger",
    "log_round_trip": _with("v_fix", "v_trip") + " select cast(trip_id as varchar) id, vehicle, cast(start_unix as bigint) start_unix, cast(seq as integer) seq, t_s, speed_mps, alt_m from v_fix join v_trip using (trip_id)",
    "placemark_feed": _with("v_charger") + ", c as (select *, cast(regexp_extract(id, '([0-9]+)$', 1) as integer) n from v_charger) select operator, 'chargy:' || (row_number() over (partition by operator order by n) - 1) id, 'SuperChargy ' || id as name, lat, lon from c where n % 3 <> 0 and n % 7 <> 0",
    "feed_times": "select event_id, case when event_id % 10 <> 0 then cast(epoch(date_trunc('second', ts)) as bigint) end epoch from events",
    "remote_catalog": """with r as (select case when n_nationkey % 4 = 0 then n_name else 'eu-' || n_nationkey end region, case n_nationkey % 5 when 0 then '../x' when 1 then '/x' else 'a/' || n_nationkey end file, n_nationkey k from nation)
        select region, file, 'region' as rule from r where k % 4 = 0 union all select region, file, 'sha256' from r where k % 3 = 0 union all select region, file, 'path' from r where k % 5 < 2""",
    "publish_plan": "select 'epoch/' || n_name path, case n_nationkey % 3 when 0 then 'upload' when 1 then 'skip' else 'abort' end action from nation",
    "feed_outcomes": _with("v_charger") + " select n_name feed, count(operator) n, count(operator) > 0 ok from nation left join (select operator from v_charger where max_power_kw >= 300) on operator = n_name group by 1",
    "conclusions": _TALK + """, p as (select *, case substr(req, 1, 2) when '22' then '62' when '10' then '50' else '61' end pos from e)
        select event_id, case when ans = '7F2231' then 'negative' when ans = '7F22' then 'short negative' when substr(ans, 1, 2) = pos then 'payload' else 'unexpected' end kind, case when ans = '7F2231' then '31' else ans end detail, substr(ans, 1, 2) = pos and length(ans) >= length(req) and substr(ans, 3, length(req) - 2) = substr(req, 3) echo from p""",
    "setup_lists": "select n_nationkey, 'ATSH' || lpad(hex(n_nationkey + 2016), 3, '0') || ';ATCRA' || lpad(hex(n_nationkey + 8), 3, '0') || ';ATFCSH' || lpad(hex(n_nationkey + 2016), 3, '0') || ';ATFCSD300000;ATFCSM1' commands from nation",
    "poll_lists": """with c as (select p_brand profile, p_partkey k, p_type target, '22' || lpad(hex(p_partkey % 65536), 4, '0') uds from part where p_partkey % 7 = 0 or p_partkey % 2 <> 0 or p_partkey % 250 <= 180), s as (select profile, target, min(k) k from c where k % 3 = 0 group by 1, 2),
        a as (select profile, k, 1 sub, target, uds from c union all select profile, k, 0, target, '1003' from s) select profile, cast(row_number() over (partition by profile order by k, sub) - 1 as integer) place, target, uds from a""",
    "payload_commands": _TALK + " select event_id, case when ans = payload_hex then case target when 'a' then 1 else 3 end end command from e",
    "session_answers": _TALK + " select event_id from e where target = 'a' and ans = '50030032'",
    "reading_rows": "select event_id id, case when event_id % 3 < 2 then event_type end signal, case when event_id % 3 = 0 or (event_id % 3 = 1 and event_id % 2 = 1) then event_id / 2.0::double end as value, case when event_id % 3 = 1 and event_id % 2 = 0 then 'on' end text_value, case when event_id % 3 < 2 then 'V' end unit, case when event_id % 3 = 2 then 'timeout' end failure_reason from events",
    "adapter_payloads": _TALK + """ select user_id as session, event_id request, case when event_id % 7 = 0 then substr(payload_hex, 1, 6) when event_id % 5 <> 0 then substr(payload_hex, 1, 32) end payload, case when event_id % 7 <> 0 and event_id % 5 = 0 then 'sequence' end problem from e join events using (event_id)""",
    "lenient_fields": """select c_custkey, case c_custkey % 3 when 0 then c_custkey % 90 + 0.5::double when 1 then c_custkey % 90 + 0.25::double end number, case when c_custkey % 4 <> 0 then -(c_custkey % 90)::double end lat, case when c_custkey % 4 <> 0 then c_custkey % 180 + 0.5::double end lon from customer""",
    "signed_turns": _with("v_edge") + ", t as (select src, dst, ((src * 37 - dst * 11) % 1080 + 1080) % 360 w from v_edge) select src, dst, cast(case when w > 180 then w - 360 else w end as double) turn, cast(src % 64 % 16 as integer) kind, src // 16 % 2 = 1 link, src // 32 % 2 = 1 \"round\" from t",
}
ORACLE["adjacency"] = _with("v_edge") + """, a as (select src n, string_agg(dst::varchar, ',' order by dst) o from (select distinct src, dst from v_edge) group by 1), b as (select dst n, string_agg(src::varchar, ',' order by src) i from (select distinct src, dst from v_edge) group by 1)
    select coalesce(a.n, b.n) node_id, coalesce(o, '') out, coalesce(i, '') as into from a full join b on a.n = b.n"""
ORACLE["route_projection"] = _with("v_node", "v_charger") + _LINE + """, sg as (select route, pos, lat la, lon oa, cum_m ca, lead(lat) over w lb, lead(lon) over w ob, lead(cum_m) over w cb from ln window w as (partition by route order by pos)),
    c as (select cast(floor(round((lon - 5) / 0.007::double, 6)) as bigint) route, id, lat, lon from v_charger), g as (select *, cos(radians((la + lb) / 2)) * 111320.0::double k from sg where lb is not null),
    q as (select g.route, id, pos, ca, cb, (ob - oa) * k bx, (lb - la) * 111320.0::double by_, (c.lon - oa) * k px, (c.lat - la) * 111320.0::double py from g join c using (route)),
    t as (select *, case when bx * bx + by_ * by_ > 0 then least(greatest((px * bx + py * by_) / (bx * bx + by_ * by_), 0), 1) else 0 end t from q),
    d as (select route, id, pos, round(sqrt((px - t * bx) ** 2 + (py - t * by_) ** 2), 6) off, ca + t * (cb - ca) along from t), r as (select *, row_number() over (partition by route, id order by off, pos) n from d)
    select route, id, round(along, 2) along_m, round(off, 3) off_m from r where n = 1"""
