"""Queries over guidance texts, telemetry, feeds, catalogues and trips, each with SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wattroute.functions import geo, road, telemetry, text
from wattroute.operators import catalog, sequences
from wattroute.plans.catalogue import _hav, _with, rounded
from wattroute.sources.views import table, view


def phrases(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("length_m") * (F.col("src") % 17) + 0.37
    out = [text.distance_text(m).alias("banner"), text.spoken_distance(m).alias("spoken"), text.duration_text(m / F.col("speed_kmh") * 3.6).alias("lasts")]
    return view(spark, d, "v_edge").select("src", "dst", *out)


def turn_modifiers(spark: SparkSession, d: str) -> DataFrame:
    delta = ((F.col("src") * 37 + F.col("dst") * 11) % 361 - 180).cast("double")
    return view(spark, d, "v_edge").select("src", "dst", text.turn_modifier(delta).alias("modifier"))


def guide_flags(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "v_way").select("way_id", road.guide_flags(F.col("highway"), F.col("junction")).alias("flags"))


def tile_names(spark: SparkSession, d: str) -> DataFrame:
    n = view(spark, d, "v_node").select(text.tile_name(F.col("lat") - 48.1, F.col("lon") - 5.1).alias("tile"))
    return n.groupBy("tile").agg(F.count(F.lit(1)).alias("nodes"))


def payload_decode(spark: SparkSession, d: str) -> DataFrame:
    raw = lambda first, n: telemetry.bits(F.col("payload_hex"), 3, first, n)
    current, volts = telemetry.signed(raw(80, 16), 16), raw(96, 16)
    return view(spark, d, "v_payload").select(
        "event_id", telemetry.scaled(raw(32, 8), div=2.0).alias("soc"), telemetry.scaled(current, div=10.0).alias("amperes"),
        telemetry.scaled(volts, div=10.0, low=100.0, high=5000.0).alias("volts"), raw(99, 5).alias("odd_bits"),
    )


def line_classes(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "v_line").select("event_id", telemetry.line_class(F.col("line")).alias("kind"))


def request_plan(spark: SparkSession, d: str) -> DataFrame:
    """Setup commands go out when the target differs from the previous request's; seven more open the session."""
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("event_id"))
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", before.alias("before"))
    n = F.when(F.col("before").isNull(), 13).when(F.col("before") != F.col("event_type"), 6).otherwise(1)
    return e.select("user_id", "event_id", n.alias("commands"))


def frame_chunks(spark: SparkSession, d: str) -> DataFrame:
    p = view(spark, d, "v_payload").select("event_id", F.posexplode(telemetry.chunks(F.col("payload_hex"), 7)).alias("i", "data"))
    return p.select("event_id", "i", telemetry.single_frame(F.col("data")).alias("frame"))


def ocpi_feed(spark: SparkSession, d: str) -> DataFrame:
    kw, even = F.col("max_power_kw"), F.col("id").endswith("0")
    plug = F.struct(F.lit("iec_62196_t2_combo").alias("standard"), F.when(even, kw * 1000).otherwise(0.0).alias("max_electric_power"), F.lit(400.0).alias("max_voltage"), (kw * 2.5).alias("max_amperage"))
    other = F.struct(F.lit("CHADEMO").alias("standard"), F.lit(90000.0).alias("max_electric_power"), F.lit(None).cast("double").alias("max_voltage"), F.lit(None).cast("double").alias("max_amperage"))
    place = F.struct(F.col("lat").cast("string").alias("latitude"), F.col("lon").cast("string").alias("longitude"))
    body = F.to_json(F.struct("id", "name", place.alias("coordinates"), F.array(F.struct(F.array(plug, other).alias("connectors"))).alias("evses")))
    got = catalog.parse_locations(view(spark, d, "v_charger").select(body.alias("body")), "body", "feed")
    return got.select("id", "name", rounded(F.col("lat")).alias("lat"), rounded(F.col("lon")).alias("lon"), "max_power_kw", F.size("plugs").alias("plugs"))


def catalog_merge(spark: SparkSession, d: str) -> DataFrame:
    n, sha = table(spark, d, "nation"), lambda c: F.sha2(c.cast("binary"), 256).alias("sha256")
    old = n.where("n_nationkey % 3 <> 0").select(F.col("n_name").alias("name"), sha(F.col("n_name")))
    new = n.where("n_nationkey % 2 = 0").select(F.col("n_name").alias("name"), sha(F.when(F.col("n_nationkey") % 4 == 0, F.col("n_name")).otherwise(F.concat("n_name", F.lit("2")))))
    return catalog.merge_catalog(old, new)


def catalog_rules(spark: SparkSession, d: str) -> DataFrame:
    p, sha = table(spark, d, "pages"), F.sha2(F.col("html").cast("binary"), 256)
    sha = F.when(F.col("page_id") % 5 == 0, F.upper(sha)).when(F.col("page_id") % 7 == 0, F.substring(sha, 1, 63)).otherwise(sha)
    return catalog.catalog_rules(p.select("page_id", sha.alias("sha256"), (F.col("page_id") % 4).alias("epoch")), ["page_id"])


def graph_rules(spark: SparkSession, d: str) -> DataFrame:
    e = view(spark, d, "v_edge")
    e = e.withColumn("dst", F.when(F.col("src") % 50 == 7, F.col("dst") + 1000000000).when(F.col("src") % 50 == 8, F.col("src")).otherwise(F.col("dst")))
    return catalog.graph_rules(e.withColumn("length_m", F.when(F.col("src") % 40 == 3, 0.0).otherwise(F.col("length_m"))), view(spark, d, "v_node"))


def trip_actual_energy(spark: SparkSession, d: str) -> DataFrame:
    t = catalog.trip_energy(view(spark, d, "v_trip"))
    return t.select("trip_id", rounded(F.col("actual_wh")).alias("actual_wh"), "measured", "reason")


def nearest_reading(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_id", "event_type")
    asked, read = (e.where(F.col("event_type") == k) for k in ("view", "purchase"))
    return sequences.nearest_in_time(asked.select("user_id", "event_id"), read.withColumn("reading", F.col("event_id") * 3), "user_id", "event_id", "reading")


def poll_quiet_runs(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_id", "event_type")
    return sequences.quiet_runs(e, "user_id", ["event_id"], ~F.col("event_type").isin("error", "view")).select("user_id", "event_id", "place")


def roundabout_exits(spark: SparkSession, d: str) -> DataFrame:
    w = view(spark, d, "v_way").withColumn("route", F.floor(F.col("way_id") / 100))
    return sequences.islands(w, "route", "way_id", F.col("way_id") % 7 < 4, F.coalesce(F.col("oneway") == "yes", F.lit(False))).select("route", "first", "last", "exits")


def _along(spark: SparkSession, d: str) -> DataFrame:
    level = 80 - F.col("seq") * 0.1 - (F.col("seq") % 3) * 0.25
    return view(spark, d, "v_fix").select("trip_id", "seq", (F.col("t_s") * 17 + F.col("seq") % 4 * 100).alias("x"), level.cast("double").alias("level"))


def trail_thinning(spark: SparkSession, d: str) -> DataFrame:
    return sequences.thin_trail(_along(spark, d), "trip_id", "seq", "x", "level", 500.0, 0.45).select("trip_id", "seq")


def corridor_downsample(spark: SparkSession, d: str) -> DataFrame:
    return sequences.downsample(_along(spark, d), "trip_id", "seq", "x").select("trip_id", "seq")


def trip_smooth_ascent(spark: SparkSession, d: str) -> DataFrame:
    f, w = view(spark, d, "v_fix").where("alt_m is not null"), Window.partitionBy("trip_id").orderBy("seq")
    at = [F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon")]
    f = f.withColumn("step", F.coalesce(geo.haversine_m(*at), F.lit(0.0))).withColumn("cum_m", rounded(F.sum("step").over(w)))
    s = sequences.smooth_climb(f, "trip_id", "seq", "cum_m", "alt_m", 700)
    return s.select("trip_id", rounded(F.col("ascent_m")).alias("ascent_m"), rounded(F.col("descent_m")).alias("descent_m"))


def soc_curve(spark: SparkSession, d: str) -> DataFrame:
    e = view(spark, d, "v_edge").withColumn("plan", F.floor(F.col("src") / 50))
    w = Window.partitionBy("plan").orderBy("src", "dst")
    e = e.withColumn("until", F.sum("length_m").over(w)).withColumn("from_m", F.col("until") - F.col("length_m"))
    e = e.withColumn("s0", 0.9 - F.col("from_m") / 1e6).withColumn("s1", 0.9 - F.col("until") / 1e6)
    return sequences.charge_curve(e, "plan", "from_m", "until", "s0", "s1").select("plan", "distance_m", rounded(F.col("soc")).alias("soc"))


def strongest(spark: SparkSession, d: str) -> DataFrame:
    """The 300 strongest chargers; among equals the later ones stay."""
    return view(spark, d, "v_charger").orderBy(F.desc("max_power_kw"), F.desc("id")).limit(300).select("id", "max_power_kw")


QUERIES = [
    phrases, turn_modifiers, guide_flags, tile_names, payload_decode, line_classes, request_plan, frame_chunks, ocpi_feed, catalog_merge, catalog_rules, graph_rules,
    trip_actual_energy, nearest_reading, poll_quiet_runs, roundabout_exits, trail_thinning, corridor_downsample, trip_smooth_ascent, soc_curve, strongest,
]

_M = "(length_m * (src % 17) + 0.37::double)"
_MIN = f"cast(round({_M} / speed_kmh * 3.6::double / 60) as bigint)"
_XY = "select trip_id, seq, t_s * 17 + seq % 4 * 100 x, cast(80 - seq * 0.1 - (seq % 3) * 0.25 as double) lvl from v_fix"
ORACLE = {
    "phrases": _with("v_edge") + f"""select src, dst, case when {_M} >= 10000 then cast(cast(round({_M} / 1000) as bigint) as varchar) || ' km' when {_M} >= 1000 then printf('%.1f km', {_M} / 1000) else cast(cast(round({_M} / 10) * 10 as bigint) as varchar) || ' m' end banner,
        case when {_M} >= 10000 then cast(cast(round({_M} / 1000) as bigint) as varchar) || ' kilometers' when {_M} >= 1000 then case when printf('%.1f', {_M} / 1000) = '1.0' then '1 kilometer' else replace(printf('%.1f', {_M} / 1000), '.0', '') || ' kilometers' end
          else cast(greatest(50, cast(round({_M} / 50) * 50 as bigint)) as varchar) || ' meters' end spoken,
        case when {_MIN} >= 60 then cast({_MIN} // 60 as varchar) || 'h ' else '' end || cast({_MIN} % 60 as varchar) || 'm' lasts from v_edge""",
    "turn_modifiers": _with("v_edge") + """, t as (select src, dst, (src * 37 + dst * 11) % 361 - 180 t from v_edge) select src, dst, case when abs(t) > 170 then 'u-turn' when abs(t) <= 20 then 'straight' else
        case when abs(t) <= 40 then 'slight ' when abs(t) > 120 then 'sharp ' else '' end || case when t < 0 then 'left' else 'right' end end modifier from t""",
    "guide_flags": _with("v_way") + "select way_id, cast(case highway when 'residential' then 7 when 'tertiary' then 5 when 'secondary' then 4 when 'primary' then 3 when 'motorway_link' then 17 else 0 end + case when junction is null then 0 else 32 end as integer) flags from v_way",
    "tile_names": _with("v_node") + "select 'Copernicus_DSM_COG_10_' || case when lat < 48.1::double then 'S01' else printf('N%02d', cast(floor(lat - 48.1::double) as integer)) end || '_00_' || case when lon < 5.1::double then 'W001' else printf('E%03d', cast(floor(lon - 5.1::double) as integer)) end || '_00_DEM' tile, count(*) nodes from v_node group by 1",
    "payload_decode": "select event_id, event_id % 201 / 2.0::double soc, case when event_id * 7919 % 65536 > 32767 then event_id * 7919 % 65536 - 65536 else event_id * 7919 % 65536 end / 10.0::double amperes, least(greatest(event_id * 31 % 65536 / 10.0::double, 100), 5000) volts, cast(event_id * 31 % 65536 // 256 % 32 as bigint) odd_bits from events",
    "line_classes": "select event_id, case event_type when 'error' then 'no data' when 'signup' then 'searching' when 'view' then 'ok' when 'purchase' then 'bus init' else 'frame' end kind from events",
    "request_plan": "select user_id, event_id, cast(case when row_number() over w = 1 then 13 when event_type <> lag(event_type) over w then 6 else 1 end as integer) commands from events window w as (partition by user_id order by event_id)",
    "frame_chunks": _with("v_payload") + "select event_id, cast(i as integer) i, rpad('0' || cast(least(7, length(payload_hex) // 2 - 7 * i) as varchar) || substr(payload_hex, cast(14 * i + 1 as bigint), 14), 16, '0') frame from v_payload, range(3) t(i) where 14 * i < length(payload_hex)",
    "ocpi_feed": _with("v_charger") + "select 'feed:' || id id, name, round(lat, 6) lat, round(lon, 6) lon, max_power_kw, cast(2 as integer) plugs from v_charger where max_power_kw >= 50",
    "catalog_merge": """select n_name as name, case when n_nationkey % 4 = 2 then sha256(n_name || '2') else sha256(n_name) end sha256,
        case when n_nationkey % 2 <> 0 then 'kept' when n_nationkey % 3 = 0 then 'added' when n_nationkey % 4 = 0 then 'same' else 'changed' end state from nation where n_nationkey % 3 <> 0 or n_nationkey % 2 = 0""",
    "catalog_rules": "select page_id, 'epoch' as rule from pages where page_id % 4 = 0 union all select page_id, 'sha256' from pages where page_id % 5 = 0 or page_id % 7 = 0",
    "graph_rules": _with("v_edge", "v_node") + """, e as (select src, case src % 50 when 7 then dst + 1000000000 when 8 then src else dst end dst, case when src % 40 = 3 then 0 else length_m end length_m, speed_kmh from v_edge)
        select src, dst, 'loop' as rule from e where src = dst union all select src, dst, 'length' from e where length_m <= 0 union all select src, dst, 'speed' from e where speed_kmh <= 0
        union all select src, dst, 'no src' from e where src not in (select node_id from v_node) union all select src, dst, 'no dst' from e where dst not in (select node_id from v_node)""",
    "trip_actual_energy": _with("v_trip") + """, k as (select *, coalesce(end_charge_kwh >= start_charge_kwh and end_discharge_kwh >= start_discharge_kwh, false) c, (end_discharge_kwh - start_discharge_kwh - end_charge_kwh + start_charge_kwh) * 1000 net, coalesce(start_display_soc_pct > end_display_soc_pct, false) s from v_trip)
        select trip_id, round(case when c then case when net > 0 then net end when s then (start_display_soc_pct - end_display_soc_pct) * 700 when start_soc_pct > end_soc_pct then (start_soc_pct - end_soc_pct) * 700.0::double end, 6) actual_wh,
        case when c and net > 0 then true when not c and (s or start_soc_pct > end_soc_pct) then false end measured,
        case when c and net <= 0 then 'no net discharge (measured)' when not c and not s and start_soc_pct <= end_soc_pct then 'no net discharge' end reason from k""",
    "nearest_reading": "select a.user_id, a.event_id, arg_min(b.event_id * 3, abs(a.event_id - b.event_id) * 2 + cast(b.event_id > a.event_id as integer)) reading from events a left join events b on a.user_id = b.user_id and b.event_type = 'purchase' where a.event_type = 'view' group by 1, 2",
    "poll_quiet_runs": """select user_id, event_id, cast(n - good as integer) place from (select *, coalesce(max(case when event_type not in ('error', 'view') then n end) over (partition by user_id order by n), 0) good
        from (select user_id, event_id, event_type, row_number() over (partition by user_id order by event_id) n from events)) where n > good and (n - good) % 3 = 0""",
    "roundabout_exits": _with("v_way") + """, r as (select cast(floor(way_id / 100) as bigint) route, way_id, oneway, row_number() over (partition by floor(way_id / 100) order by way_id) a from v_way), i as (select *, a - row_number() over (partition by route order by way_id) run from r where way_id % 7 < 4)
        select route, min(way_id) as first, max(way_id) as last, greatest(1, count(*) filter (oneway = 'yes')) exits from i group by route, run""",
    "trail_thinning": _with("v_fix") + f""", p as ({_XY}), walk as (select trip_id, seq, x kx, lvl kl, true keep from p where seq = 0 union all
        select p.trip_id, p.seq, case when abs(x - kx) >= 500 or abs(lvl - kl) >= 0.45::double then x else kx end, case when abs(x - kx) >= 500 or abs(lvl - kl) >= 0.45::double then lvl else kl end, abs(x - kx) >= 500 or abs(lvl - kl) >= 0.45::double from walk join p on p.trip_id = walk.trip_id and p.seq = walk.seq + 1)
        select trip_id, seq from walk where keep""",
    "corridor_downsample": _with("v_fix") + f""", p as ({_XY}), walk as (select trip_id, seq, 2000.0::double mark, true keep from p where seq = 0 union all
        select p.trip_id, p.seq, mark + case when x >= mark then 2000 else 0 end, x >= mark from walk join p on p.trip_id = walk.trip_id and p.seq = walk.seq + 1)
        select trip_id, seq from walk w where keep or seq = (select max(seq) from p where p.trip_id = w.trip_id)""",
    "trip_smooth_ascent": _with("v_fix") + f""", f as (select trip_id, seq, lat, lon, alt_m, row_number() over (partition by trip_id order by seq) k from v_fix where alt_m is not null),
        s as (select b.trip_id, b.k, b.alt_m, coalesce({_hav('a', 'b')}, 0) step from f b left join f a on a.trip_id = b.trip_id and a.k = b.k - 1),
        c as (select *, round(sum(step) over (partition by trip_id order by k), 6) cum, count(*) over (partition by trip_id) n from s),
        m as (select trip_id, k, case when k = 1 or k = n then alt_m else median(alt_m) over (partition by trip_id order by cum range between 700 preceding and 700 following) end h from c),
        g as (select trip_id, coalesce(h - lag(h) over (partition by trip_id order by k), 0) g from m) select trip_id, round(sum(greatest(g, 0)), 6) ascent_m, round(sum(greatest(-g, 0)), 6) descent_m from g group by 1""",
    "soc_curve": _with("v_edge") + """, l as (select cast(floor(src / 50) as bigint) plan, length_m, sum(length_m) over (partition by floor(src / 50) order by src, dst) b from v_edge), p as (select plan, b distance_m from l union all
        select plan, 2000.0::double * i from (select plan, max(b) t from l group by 1), range(0, 1000) r(i) where 2000 * i < t) select plan, distance_m, round(0.9::double - distance_m / 1e6::double, 6) soc from p""",
    "strongest": _with("v_charger") + "select id, max_power_kw from v_charger order by max_power_kw desc, id desc limit 300",
}
