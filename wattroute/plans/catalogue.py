"""The library's own queries, each with SQL written for DuckDB that must give the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wattroute.functions import geo, physics, road
from wattroute.operators import network, spatial, trips
from wattroute.sources.views import SQL as VIEW
from wattroute.sources.views import table, view
from wattroute.streaming.latest import latest, windowed_counts

TEMP_C = 20.0


def rounded(c: Column, n: int = 6) -> Column:
    return F.round(c, n)


def _energy(df: DataFrame, speed: str = "speed_kmh", delta: Column | None = None) -> Column:
    return physics.edge_energy_wh(physics.ALL_WHEEL, F.col("length_m"), F.col(speed), F.col("ascent_m"), F.col("descent_m"), F.col("road_class"), F.lit(TEMP_C), delta)


def edge_energy(spark: SparkSession, d: str) -> DataFrame:
    e = view(spark, d, "v_edge")
    return e.select("src", "dst", rounded(_energy(e)).alias("energy_wh"), rounded(F.col("length_m") / F.col("speed_kmh") * 3.6).alias("time_s"))


def edge_energy_by_class(spark: SparkSession, d: str) -> DataFrame:
    e = view(spark, d, "v_edge")
    return e.groupBy("road_class").agg(F.count(F.lit(1)).alias("edges"), rounded(F.sum(_energy(e)), 4).alias("energy_wh"), rounded(F.sum("length_m"), 4).alias("length_m"))


def speed_cap_legs(spark: SparkSession, d: str) -> DataFrame:
    """Edges of ten consecutive sources form a leg; time and energy of each under every speed cap. A leg starts from standstill."""
    e = view(spark, d, "v_edge").withColumn("leg", F.floor(F.col("src") / 10)).withColumn("cap", F.explode(F.array(*[F.lit(c) for c in (999.0, 110.0, 100.0, 90.0)])))
    e = e.withColumn("eff", F.least("speed_kmh", "cap")).where("eff > 0")
    before = F.lag("eff").over(Window.partitionBy("leg", "cap").orderBy("src", "dst"))
    e = e.withColumn("delta", F.col("eff") - F.coalesce(before, F.lit(0.0)))
    e = e.withColumn("wh", _energy(e, "eff", F.col("delta")))
    return e.groupBy("leg", "cap").agg(rounded(F.sum(F.col("length_m") / F.col("eff") * 3.6), 4).alias("time_s"), rounded(F.sum("wh"), 4).alias("energy_wh"))


def charge_duration(spark: SparkSession, d: str) -> DataFrame:
    c = view(spark, d, "v_charger")
    seconds = physics.charge_seconds(physics.ALL_WHEEL, F.lit(0.1), F.lit(0.8), F.col("max_power_kw"), F.lit(0.5))
    kinds = c.select("max_power_kw").distinct().withColumn("charge_s", rounded(seconds, 3))  # there are few powers; each is integrated once
    return c.join(kinds, "max_power_kw").select("id", "charge_s")


def charger_pairs(spark: SparkSession, d: str) -> DataFrame:
    c = view(spark, d, "v_charger")
    return spatial.within(c, c, 2000.0).select("id", "other_id", rounded(F.col("distance_m"), 4).alias("distance_m"))


def bearings(spark: SparkSession, d: str) -> DataFrame:
    e, n = view(spark, d, "v_edge").select("src", "dst"), view(spark, d, "v_node")
    a, b = (n.select(F.col("node_id").alias(k), F.col("lat").alias(f"{k}_lat"), F.col("lon").alias(f"{k}_lon")) for k in ("src", "dst"))
    p = [F.col(c) for c in ("src_lat", "src_lon", "dst_lat", "dst_lon")]
    return e.join(a, "src").join(b, "dst").select("src", "dst", rounded(geo.bearing_deg(*p), 4).alias("bearing"), rounded(geo.haversine_m(*p), 4).alias("metres"))


def nearest_node(spark: SparkSession, d: str) -> DataFrame:
    return spatial.nearest_node(view(spark, d, "v_charger"), view(spark, d, "v_node"))


def bbox_filter(spark: SparkSession, d: str) -> DataFrame:
    c = view(spark, d, "v_charger")
    return c.where(geo.in_box(F.col("lat"), F.col("lon"), 48.05, 5.05, 48.15, 5.2)).select("id", "name", "max_power_kw")


def bbox(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "v_node").agg(*[f(c).alias(f"{n}_{c}") for c in ("lat", "lon") for n, f in (("min", F.min), ("max", F.max))])


def csr_degree(spark: SparkSession, d: str) -> DataFrame:
    """Out-degree of each source and the offset of its first edge."""
    return network.offsets(view(spark, d, "v_edge"), "src")


def way_attributes(spark: SparkSession, d: str) -> DataFrame:
    w = view(spark, d, "v_way")
    default = road.default_speed_kmh(F.col("highway"))
    return w.where(default.isNotNull()).select(
        "way_id", F.coalesce(road.max_speed_kmh(F.col("maxspeed")), default).alias("speed_kmh"), road.road_class(F.col("highway")).alias("road_class"), road.one_way(F.col("oneway"), F.col("junction")).alias("one_way")
    )


def trip_segments(spark: SparkSession, d: str) -> DataFrame:
    s = trips.segments(view(spark, d, "v_fix"))
    return s.select("trip_id", "seq", rounded(F.col("length_m"), 4).alias("length_m"), "dt_s", rounded(F.col("mps"), 4).alias("mps"))


def trip_hysteresis(spark: SparkSession, d: str) -> DataFrame:
    return trips.climb(view(spark, d, "v_fix"))


def speed_median(spark: SparkSession, d: str) -> DataFrame:
    f = view(spark, d, "v_fix").where("speed_mps is not null").withColumn("w", F.col("seq") % 3 + 1)
    return trips.weighted_median(f, ["trip_id"], "speed_mps", "w")


def candidate_cap(spark: SparkSession, d: str) -> DataFrame:
    """At most 30 chargers of a country, strongest first."""
    w = Window.partitionBy("country").orderBy(F.desc("max_power_kw"), "id")
    return view(spark, d, "v_charger").withColumn("place", F.row_number().over(w)).where("place <= 30").select("country", "place", "id", "max_power_kw")


def station_rollup(spark: SparkSession, d: str) -> DataFrame:
    c = view(spark, d, "v_charger")
    return c.groupBy("country", "operator").agg(F.count(F.lit(1)).alias("n"), F.max("max_power_kw").alias("best_kw"), F.min_by("name", "id").alias("first_name"))


def sha_manifest(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.sha2(F.col("html").cast("binary"), 256).alias("sha256"), F.octet_length("html").cast("bigint").alias("bytes"))


def html_title(spark: SparkSession, d: str) -> DataFrame:
    title = F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)
    return table(spark, d, "pages").select("page_id", F.when(F.col("html").rlike("(?s)<title>.*?</title>"), title).alias("title"))


def event_counts(spark: SparkSession, d: str) -> DataFrame:
    n = windowed_counts(table(spark, d, "events"))
    return n.groupBy(F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "event_type").agg(F.sum("n").alias("n"))


def latest_signal(spark: SparkSession, d: str) -> DataFrame:
    return latest(table(spark, d, "events"))


QUERIES = [
    edge_energy, edge_energy_by_class, speed_cap_legs, charge_duration, charger_pairs, bearings, nearest_node, bbox_filter, bbox, csr_degree,
    way_attributes, trip_segments, trip_hysteresis, speed_median, candidate_cap, station_rollup, sha_manifest, html_title, event_counts, latest_signal,
]


def _energy_sql(v: str, dv: str = "0.0") -> str:
    """At 20 C, 0 m, no wind, 2095 kg."""
    pull = f"(0.0099*2095*9.80665*length_m + 0.5*(1.225*288.15/293.15)*0.75*power(({v})/3.6,2)*length_m + 0.5*2095*1.04*(2*({v})/3.6*(({dv})/3.6) - power(({dv})/3.6,2)))"
    return f"((case when {pull} >= 0 then {pull}/0.85 else {pull}*0.65 end + 2095*9.80665*ascent_m/0.85 - 2095*9.80665*descent_m*0.65 + 600.0*length_m/(({v})/3.6))/3600.0 + case when road_class = 1 then 0.014*length_m else 0 end)"


def _with(*views: str) -> str:
    return "with recursive " + ", ".join(f"{v} as ({VIEW[v]})" for v in views) + " "


def _lerp_sql(x: str, knots: list[tuple[float, float]]) -> str:
    parts = " ".join(f"when {x} <= {x1}::double then {y0}::double + ({x} - {x0}::double) * {(y1 - y0) / (x1 - x0)!r}::double" for (x0, y0), (x1, y1) in zip(knots, knots[1:], strict=False))
    return f"(case when {x} <= {knots[0][0]}::double then {knots[0][1]}::double {parts} else {knots[-1][1]}::double end)"


def _hav(a: str, b: str) -> str:
    return f"(12742000.0 * asin(sqrt(least(1.0, power(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * power(sin(radians({b}.lon - {a}.lon) / 2), 2)))))"


_STEPS = "ceil((0.8::double - 0.1::double) * 2000)"
_SOC = f"(0.1::double + (i + 0.5) * ((0.8::double - 0.1::double) / {_STEPS}))"
ORACLE = {
    "edge_energy": _with("v_edge") + f"select src, dst, round({_energy_sql('speed_kmh')}, 6) energy_wh, round(length_m / speed_kmh * 3.6::double, 6) time_s from v_edge",
    "edge_energy_by_class": _with("v_edge") + f"select road_class, count(*) edges, round(sum({_energy_sql('speed_kmh')}), 4) energy_wh, round(sum(length_m), 4) length_m from v_edge group by 1",
    "speed_cap_legs": _with("v_edge") + f""", c as (select *, cast(floor(src / 10) as bigint) leg, least(speed_kmh, cap) eff from v_edge, (values (999.0::double), (110.0), (100.0), (90.0)) t(cap)),
        l as (select *, eff - coalesce(lag(eff) over (partition by leg, cap order by src, dst), 0.0) dv from c)
        select leg, cap, round(sum(length_m / eff * 3.6::double), 4) time_s, round(sum({_energy_sql('eff', 'dv')}), 4) energy_wh from l group by 1, 2""",
    "charge_duration": _with("v_charger") + f"""select id, round(sum(3600 * ((0.8::double - 0.1::double) / {_STEPS}) * 70 / least({_lerp_sql(_SOC, physics.COLD_KW)} + 0.5 * ({_lerp_sql(_SOC, physics.WARM_KW)} - {_lerp_sql(_SOC, physics.COLD_KW)}), max_power_kw)), 3) charge_s
        from v_charger, unnest(range(0, cast({_STEPS} as bigint))) t(i) group by id""",
    "charger_pairs": _with("v_charger") + f"select a.id, b.id other_id, round({_hav('a', 'b')}, 4) distance_m from v_charger a join v_charger b on a.id <> b.id where {_hav('a', 'b')} <= 2000",
    "bearings": _with("v_edge", "v_node") + f"""select src, dst, round(fmod(degrees(atan2(sin(radians(b.lon - a.lon)) * cos(radians(b.lat)), cos(radians(a.lat)) * sin(radians(b.lat)) - sin(radians(a.lat)) * cos(radians(b.lat)) * cos(radians(b.lon - a.lon)))) + 720, 360.0), 4) bearing,
        round({_hav('a', 'b')}, 4) metres from v_edge join v_node a on a.node_id = src join v_node b on b.node_id = dst""",
    "nearest_node": _with("v_charger", "v_node") + """select id, node_id from (select c.id, n.node_id, row_number() over (partition by c.id order by round(power(n.lat - c.lat, 2) + power((n.lon - c.lon) * cos(radians(c.lat)), 2), 15) nulls last, n.node_id) k
        from v_charger c left join v_node n on abs(floor(n.lat / 0.1) - floor(c.lat / 0.1)) <= 1 and abs(floor(n.lon / 0.1) - floor(c.lon / 0.1)) <= 1) where k = 1""",
    "bbox_filter": _with("v_charger") + "select id, name, max_power_kw from v_charger where lat >= 48.05 and lat <= 48.15 and lon >= 5.05 and lon <= 5.2",
    "bbox": _with("v_node") + "select min(lat) min_lat, max(lat) max_lat, min(lon) min_lon, max(lon) max_lon from v_node",
    "csr_degree": _with("v_edge") + "select src, degree, cast(sum(degree) over (order by src) - degree as bigint) first_edge from (select src, count(*) degree from v_edge group by 1)",
    "way_attributes": _with("v_way") + """select way_id, cast(case when maxspeed is not null and maxspeed not like '%mph%' then cast(maxspeed as double) else case highway when 'residential' then 30 when 'tertiary' then 60 when 'secondary' then 70 when 'primary' then 80 else 72 end end as double) speed_kmh,
        case when highway = 'residential' then 1 else 0 end road_class, case when oneway = 'yes' then 1 when oneway = '-1' then -1 when junction = 'roundabout' then 1 else 0 end one_way from v_way where highway <> 'footway'""",
    "trip_segments": _with("v_fix") + f"select b.trip_id, b.seq, round({_hav('a', 'b')}, 4) length_m, b.t_s - a.t_s dt_s, round({_hav('a', 'b')} / (b.t_s - a.t_s), 4) mps from v_fix b join v_fix a on a.trip_id = b.trip_id and a.seq = b.seq - 1",
    "trip_hysteresis": _with("v_fix") + """, r as (select trip_id, alt_m, row_number() over (partition by trip_id order by seq) k from v_fix where alt_m is not null),
        walk as (select trip_id, k, alt_m as ref, 0.0::double as up, 0.0::double as down from r where k = 1 union all
          select r.trip_id, r.k, case when abs(alt_m - ref) > 3 then alt_m else ref end, up + case when alt_m - ref > 3 then alt_m - ref else 0 end, down + case when ref - alt_m > 3 then ref - alt_m else 0 end
          from walk join r on r.trip_id = walk.trip_id and r.k = walk.k + 1)
        select t.trip_id, coalesce(arg_max(up, k), 0.0) ascent_m, coalesce(arg_max(down, k), 0.0) descent_m from (select distinct trip_id from v_fix) t left join walk using (trip_id) group by 1""",
    "speed_median": _with("v_fix") + """, s as (select trip_id, speed_mps, sum(seq % 3 + 1) over (partition by trip_id order by speed_mps) run, sum(seq % 3 + 1) over (partition by trip_id) total from v_fix where speed_mps is not null)
        select trip_id, min(speed_mps) filter (run >= total / 2.0) weighted_median from s group by 1""",
    "candidate_cap": _with("v_charger") + "select country, cast(place as integer) place, id, max_power_kw from (select *, row_number() over (partition by country order by max_power_kw desc, id) place from v_charger) where place <= 30",
    "station_rollup": _with("v_charger") + "select country, operator, count(*) n, max(max_power_kw) best_kw, arg_min(name, id) first_name from v_charger group by 1, 2",
    "sha_manifest": "select page_id, sha256(html) sha256, cast(strlen(html) as bigint) bytes from pages",
    "html_title": "select page_id, case when regexp_matches(html, '(?s)<title>.*?</title>') then regexp_extract(html, '(?s)<title>(.*?)</title>', 1) end title from pages",
    "event_counts": "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H') as hour, event_type, cast(count(*) as bigint) n from events group by 1, 2",
    "latest_signal": "select user_id, event_type, event_id, n from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) k, count(*) over (partition by user_id, event_type) n from events) where k = 1",
}
