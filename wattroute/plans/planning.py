"""Queries of routing, guidance, registers and display rules, each with SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wattroute.functions import road, rules
from wattroute.operators import asof, feeds, graph, guidance, routing, sequences
from wattroute.plans.catalogue import _hav, _with, rounded
from wattroute.sources.views import table, view

LIMIT_S = 180.0  # of the reach queries, a feature: an isochrone


def _reach(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    edges = view(spark, d, "v_edge")
    return edges, routing.travel_costs(edges, view(spark, d, "v_node"), LIMIT_S)


def travel_reach(spark: SparkSession, d: str) -> DataFrame:
    return _reach(spark, d)[1].select("source", "node", rounded(F.col("cost_s")).alias("cost_s"))


def travel_matrix(spark: SparkSession, d: str) -> DataFrame:
    """From every node to itself and to those one or two rows and columns on, without a limit. Tested against a plain search."""
    ids = view(spark, d, "v_node").select(F.col("node_id").alias("source"))
    pairs = ids.select("source", F.explode(F.array(*[F.col("source") + k for k in (0, 1, 2, 40, 41, 82)])).alias("node")).join(ids.select(F.col("source").alias("node")), "node", "left_semi")
    return routing.many_to_many(view(spark, d, "v_edge"), pairs).select("source", "node", rounded(F.col("cost_s")).alias("cost_s"))


def route_nodes(spark: SparkSession, d: str) -> DataFrame:
    edges, costs = _reach(spark, d)
    targets = costs.select("source", F.col("node").alias("target"))
    return routing.routes(edges, costs, targets).select("source", "target", "node", "back")


def display_rules(spark: SparkSession, d: str) -> DataFrame:
    n, soc = F.col("seq"), F.col("seq") % 100
    look = rules.look_ahead_m(F.coalesce("speed_mps", F.lit(0.0)), F.when(n % 4 != 0, (n % 20) * 80.0))
    return view(spark, d, "v_fix").select(
        "trip_id", "seq", look.alias("look"), rounded(rules.zoom(look)).alias("zoom"), rules.soc_state(F.when(n % 11 != 0, soc), n % 15).alias("state"),
        rules.margin_colour(soc, F.lit(20)).alias("colour"), rules.soc_bucket(soc / 100.0).alias("bucket"), rules.clamp_i16(F.col("alt_m") * 160).alias("height"),
        rules.straight_line_ok(n * 5000.0, F.lit(70000.0)).alias("in_range"),
    )


def segment_distance(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("trip_id").orderBy("seq")
    f = view(spark, d, "v_fix").select("trip_id", "seq", "lat", "lon", *[F.lag(c).over(w).alias(f"{c}_a") for c in ("lat", "lon")], *[F.lead(c).over(w).alias(f"{c}_b") for c in ("lat", "lon")])
    off = rules.segment_distance_m(*[F.col(c) for c in ("lat", "lon", "lat_a", "lon_a", "lat_b", "lon_b")])
    return f.where("lat_a is not null and lat_b is not null").select("trip_id", "seq", F.round(off, 4).alias("off_m"))


def upcoming_step(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_id", "event_type")
    return asof.next_after(e.where("event_type = 'view'").drop("event_type"), e.where("event_type = 'purchase'"), "user_id", "event_id", "event_id", 10)


def soc_between(spark: SparkSession, d: str) -> DataFrame:
    """Fixes without a speed have no reading of the charge; every fix asks for it 55 m on."""
    soc = F.when(F.col("speed_mps").isNotNull(), 80 - (F.col("seq") * 7 % 50) * 0.5)
    f = view(spark, d, "v_fix").select("trip_id", "seq", (F.col("seq") * 170.0).alias("x"), soc.alias("soc"))
    got = asof.interpolate(f.select("trip_id", "seq", (F.col("x") + 55).alias("at")), f, "trip_id", "at", "x", "soc")
    return got.select("trip_id", "seq", rounded(F.col("soc")).alias("soc"))


def voice_prompts(spark: SparkSession, d: str) -> DataFrame:
    f = view(spark, d, "v_fix").withColumn("step", F.floor(F.col("seq") / 20))
    tier = rules.speech_tier(500 - F.col("seq") % 20 * 25, F.col("speed_mps"), 500 - F.col("step") % 3 * 220)
    return guidance.prompts(f.withColumn("tier", tier), "trip_id", "step", "seq", "tier").select("trip_id", "seq", "tier")


def _steps(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("way_id")
    return view(spark, d, "v_way").select("way_id", F.floor(i / 100).alias("route"), (i * 25 + i % 3 * 9).alias("along"), F.when((i % 4).isin(1, 2), "continue").otherwise("turn").alias("maneuver"), F.col("name").alias("text"))


def guidance_steps(spark: SparkSession, d: str) -> DataFrame:
    kept = guidance.drop_short_renames(_steps(spark, d), "route", "along", "maneuver")
    return guidance.chain(kept.withColumn("along", F.col("along") * 8), "route", "along", "text").select("way_id", "along", "maneuver", "then")


def road_renames(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("way_id")
    w = view(spark, d, "v_way").withColumn("route", F.floor(i / 100)).withColumn("ref", F.concat(F.lit("R"), (F.floor(i / 5) % 4).cast("string"))).withColumn("name", F.when(i % 3 != 0, F.col("name")))
    flags = road.guide_flags(F.col("highway"), F.col("junction"))
    return guidance.renames(w, "route", "way_id").select("way_id", "name", rules.class_priority(flags).alias("priority"))


def junction_alternatives(spark: SparkSession, d: str) -> DataFrame:
    e = view(spark, d, "v_edge").select("src", "dst")
    onward = e.select(F.col("src").alias("b"), F.col("dst").alias("c"))
    moves = e.select(F.col("src").alias("a"), F.col("dst").alias("b")).join(onward, "b")
    return guidance.alternatives(moves, e)


def rule_overlaps(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    r = table(spark, d, "part").select(F.floor(k / 6).alias("command"), k.alias("rule"), (k * 29 % 240).alias("first"), (F.col("p_size") + k % 20 - 1).alias("bits"))
    return guidance.overlaps(r, "command", "rule", "first", "bits")


def register_feed(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("station_id"), F.lit(1).alias("seq"), rules.address_name(F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment")).otherwise(""), F.when(F.col("c_custkey") % 4 != 0, F.col("c_nationkey").cast("string")).otherwise(" "), F.col("c_name")).alias("name"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("point_id"), F.col("o_custkey").alias("station_id"))
    flag = lambda when: F.when(when, "t").otherwise("f")
    n = F.col("l_partkey")
    flags = {name: F.lit(None).cast("string") for _, names in rules.PLUGS for name in names} | {"dc_ccs": flag(n % 5 == 0), "dc_chademo": flag(n % 3 == 0), "ac_t2_cable": flag(n % 2 == 0), "ac_cee5": flag(n % 7 == 0)}
    p = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("point_id"), rules.plug_standard(flags).alias("standard"), (F.col("l_quantity").cast("double") * 7).alias("kw"))
    return feeds.register_stations(c, o, p)


def point_feed(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("l_linenumber")
    rows = table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 10 + n).alias("seq"), F.when(n % 4 != 0, F.concat(F.lit("S"), (F.col("l_orderkey") % 997).cast("string"))).otherwise(" ").alias("shared_id"),
        F.concat(F.lit("L"), F.col("l_orderkey").cast("string")).alias("local_id"), F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("name"), F.when(F.col("l_suppkey") % 3 != 0, F.col("l_returnflag")).alias("operator"),
        F.when(F.col("l_partkey") % 2 == 0, "EF_combo_CCS").otherwise("chademo").alias("standard"), (F.col("l_quantity").cast("double") * 3).alias("kw"),
    )
    return feeds.point_rows_to_stations(rows)


def fetch_plan(spark: SparkSession, d: str) -> DataFrame:
    n, i = table(spark, d, "nation"), F.col("n_nationkey")
    name = F.col("n_name").alias("kind")
    return feeds.install_plan(
        n.select(name, F.sha2(F.col("n_name").cast("binary"), 256).alias("sha256"), (i * 1000).alias("bytes")),
        n.where("n_nationkey % 4 <> 1").select(name, F.sha2(F.when(i % 3 == 0, F.lower("n_name")).otherwise(F.col("n_name")).cast("binary"), 256).alias("sha256")),
        n.where("n_nationkey % 2 = 1").select(name, (i * i * 90).alias("bytes")),
    )


def recorded_fixes(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("seq")
    f = view(spark, d, "v_fix").withColumn("t", n * 0.3 - F.when(n % 7 == 3, 1.0).otherwise(0.0)).withColumn("lat", F.when(n % 13 == 5, 91.0).otherwise(F.col("lat")))
    return sequences.thin_fixes(f, "trip_id", "seq", "t").select("trip_id", "seq")


def leg_targets(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("p_partkey")
    sites = table(spark, d, "part").select(F.floor(i / 200).alias("plan"), i.alias("site"), (i % 200 * 1700 + i % 3 * 900).cast("double").alias("pos"))
    return asof.ahead(sites, "plan", "site", "pos", 20_000, 30)


def departures(spark: SparkSession, d: str) -> DataFrame:
    c = view(spark, d, "v_charger").select("id", rules.depart_targets(F.lit(0.9), F.round(F.col("max_power_kw") / 500, 1)).alias("t"))
    return c.select("id", F.posexplode("t").alias("place", "target"))


def way_graph(spark: SparkSession, d: str) -> DataFrame:
    """Every eight nodes form a way with the first of the next, and each way is crossed by one of three nodes."""
    nodes = view(spark, d, "v_node").withColumn("lat", F.col("lat") + F.col("node_id") % 3 * 0.001)
    i = nodes.select((F.floor(F.col("node_id") / 8) * 8).alias("i")).distinct()
    long = i.select("i", F.posexplode(F.sequence(F.col("i"), F.col("i") + 8)).alias("pos", "node_id"))
    cross = i.select((F.col("i") + 1000000000).alias("i"), F.posexplode(F.array(F.col("i") + 3, F.col("i") + 11, F.col("i") + 19)).alias("pos", "node_id"))
    refs = long.unionByName(cross).select(F.col("i").alias("way_id"), "pos", "node_id", (F.col("i") % 5 % 3 - 1).alias("direction"))
    return graph.way_edges(refs, nodes).select("src", "dst", "way_id", F.round("length_m", 5).alias("length_m"))


QUERIES = [
    travel_reach, travel_matrix, route_nodes, display_rules, segment_distance, upcoming_step, soc_between, voice_prompts, guidance_steps, road_renames, junction_alternatives,
    rule_overlaps, register_feed, point_feed, fetch_plan, recorded_fixes, leg_targets, departures, way_graph,
]


def _rounds() -> str:
    """Best costs after each round; no edge takes under 13.8 s, so 13 rounds fill the limit."""
    sql = _with("v_edge", "v_node") + ", w as materialized (select src, dst, min(length_m / speed_kmh * 3.6::double) w from v_edge group by 1, 2), d0 as (select node_id source, node_id node, 0.0::double c from v_node)"
    for k in range(13):
        sql += f", d{k + 1} as materialized (select source, node, min(c) c from (select * from d{k} union all select source, dst, c + w from d{k} join w on src = node where c + w <= {LIMIT_S}) group by 1, 2)"
    return sql


_M = "111320.0::double"
_STEP = "500 - seq % 20 * 25"
_SPEED = "greatest(coalesce(speed_mps, 0), 1)"
_APPROACH = "(500 - step % 3 * 220)"
ORACLE = {
    "travel_reach": _rounds() + " select source, node, round(c, 6) cost_s from d13",
    "route_nodes": _rounds() + """, prev as materialized (select b.source, b.node, min(src) prev from d13 b join w on dst = b.node join d13 a on a.source = b.source and a.node = src where b.node <> b.source and abs(a.c + w - b.c) <= 1e-9 group by 1, 2),
        walk as (select source, node target, node, 0 back from d13 union all select walk.source, target, prev, back + 1 from walk join prev on prev.source = walk.source and prev.node = walk.node) select source, target, node, cast(back as integer) back from walk""",
    "display_rules": _with("v_fix") + """, l as (select *, greatest(200, coalesce(least(least(greatest(coalesce(speed_mps, 0) * 32, 200), 1500), case when seq % 4 <> 0 then seq % 20 * 80.0::double + 100 end), least(greatest(coalesce(speed_mps, 0) * 32, 200), 1500))) look from v_fix)
        select trip_id, seq, look, round(17 - 2.5::double * least(greatest((look - 200) / 1300, 0), 1), 6) zoom, case when seq % 11 = 0 then 'hidden' when seq % 15 >= 10 then 'stale' else 'fresh' end state, case when seq % 100 < 20 then 'red' when seq % 100 <= 30 then 'orange' else 'green' end colour,
        cast(floor(seq % 100 / 100.0::double * 50) as integer) bucket, case when alt_m is not null then cast(least(greatest(alt_m * 160, -32768), 32767) as integer) end height, seq * 5000.0::double * 1.3::double * 0.18::double <= 70000 in_range from l""",
    "segment_distance": _with("v_fix") + f""", p as (select trip_id, seq, lat, lon, lag(lat) over w la, lag(lon) over w oa, lead(lat) over w lb, lead(lon) over w ob from v_fix window w as (partition by trip_id order by seq)),
        q as (select trip_id, seq, (ob - oa) * cos(radians((la + lb) / 2)) * {_M} bx, (lb - la) * {_M} by_, (lon - oa) * cos(radians((la + lb) / 2)) * {_M} px, (lat - la) * {_M} py from p where la is not null and lb is not null),
        s as (select *, case when bx * bx + by_ * by_ > 0 then least(greatest((px * bx + py * by_) / (bx * bx + by_ * by_), 0), 1) else 0 end t from q) select trip_id, seq, round(sqrt((px - t * bx) ** 2 + (py - t * by_) ** 2), 4) off_m from s""",
    "upcoming_step": "select a.user_id, a.event_id, b.event_id as next from (select * from events where event_type = 'view') a asof left join (select * from events where event_type = 'purchase') b on a.user_id = b.user_id and a.event_id + 10 < b.event_id",
    "soc_between": _with("v_fix") + """, f as (select trip_id, seq, seq * 170.0::double x, case when speed_mps is not null then 80 - (seq * 7 % 50) * 0.5::double end soc from v_fix), s as (select * from f where soc is not null), q as (select trip_id, seq, x + 55 p from f)
        select q.trip_id, q.seq, round(case when b.x > a.x then a.soc + (b.soc - a.soc) * (p - a.x) / (b.x - a.x) else coalesce(a.soc, b.soc) end, 6) soc from q asof left join s a on q.trip_id = a.trip_id and q.p >= a.x asof left join s b on q.trip_id = b.trip_id and q.p <= b.x""",
    "voice_prompts": _with("v_fix") + f""", f as (select *, seq // 20 step from v_fix), t as (select *, case when {_STEP} <= 40 then 3 when ({_STEP}) / {_SPEED} <= 15 and {_APPROACH} >= 100 then 2 when ({_STEP}) / {_SPEED} <= 70 and {_APPROACH} >= 400 then 1 else 0 end tier from f),
        b as (select *, coalesce(max(tier) over (partition by trip_id, step order by seq rows between unbounded preceding and 1 preceding), 0) was from t) select trip_id, seq, cast(tier as integer) tier from b where tier > was""",
    "guidance_steps": _with("v_way") + """, s as (select way_id, way_id // 100 route, way_id * 25 + way_id % 3 * 9 a, case when way_id % 4 in (1, 2) then 'continue' else 'turn' end maneuver, name from v_way), g as (select *, coalesce(lead(a) over (partition by route order by a) - a, 0) gap from s),
        k as (select way_id, route, a * 8 along, maneuver, name from g where (maneuver = 'turn' or gap >= 30)) select way_id, along, maneuver, case when lead(along) over w - along < 400 then lead(name) over w end "then" from k window w as (partition by route order by along)""",
    "road_renames": _with("v_way") + """, r as (select way_id, way_id // 100 route, coalesce(case when way_id % 3 <> 0 then name end, '') name, way_id // 5 % 4 ref, case highway when 'residential' then 4.0::double when 'tertiary' then 6 when 'secondary' then 7 when 'primary' then 8 when 'motorway_link' then 8.5::double else 2 end priority from v_way),
        l as (select *, lag(name) over w ln, lag(way_id) over w li from r window w as (partition by route order by way_id)) select way_id, name, priority from l where li is not null and name <> '' and name <> ln""",
    "junction_alternatives": _with("v_edge") + "select m.src a, m.dst b, n.dst c, (select count(*) from v_edge o where o.src = m.dst and o.dst <> n.dst and o.dst <> m.src) others from v_edge m join v_edge n on n.src = m.dst",
    "rule_overlaps": """with r as (select p_partkey // 6 command, p_partkey as rule, p_partkey * 29 % 240 f, p_size + p_partkey % 20 - 1 n from part) select command, rule, 'length' problem from r where n < 1 or n > 64
        union all select a.command, a.rule, 'overlap' from r a where exists (select 1 from r b where b.command = a.command and (b.f, b.rule) < (a.f, a.rule) and b.f + b.n > a.f)""",
    "register_feed": """with p as (select l_orderkey, l_quantity * 7 kw, case when l_partkey % 5 = 0 then 2 when l_partkey % 3 = 0 or l_partkey % 2 = 0 or l_partkey % 7 = 0 then 1 end s from lineitem), g as (select o_custkey, max(case when s = 2 and kw >= 50 then kw end) max_power_kw, count(s) plugs from orders join p on o_orderkey = l_orderkey group by 1)
        select c_custkey station_id, case when c_custkey % 4 <> 0 then c_mktsegment || ' ' || c_nationkey || ', ' || c_name else c_name end as name, cast(max_power_kw as double) max_power_kw, plugs from g join customer on c_custkey = o_custkey where max_power_kw is not null""",
    "point_feed": """with r as (select l_orderkey * 10 + l_linenumber seq, case when l_linenumber % 4 <> 0 then 'S' || (l_orderkey % 997) else 'L' || l_orderkey end station_id, 'P' || l_partkey as name, case when l_suppkey % 3 <> 0 then l_returnflag else '' end op, case when l_partkey % 2 = 0 and l_quantity * 3 >= 50 then l_quantity * 3 end kw from lineitem)
        select station_id, first(name order by seq, name, op) as name, nullif(first(op order by seq, name, op), '') as operator, cast(max(kw) as double) max_power_kw, count(*) plugs from r group by 1 having max(kw) is not null""",
    "fetch_plan": "select n_name kind, cast(greatest(0, n_nationkey * 1000 - case when n_nationkey % 2 = 1 then n_nationkey * n_nationkey * 90 else 0 end) as bigint) to_fetch from nation where n_nationkey % 4 = 1 or (n_nationkey % 3 = 0 and lower(n_name) <> n_name)",
    "recorded_fixes": _with("v_fix") + """, f as (select trip_id, seq, seq * 0.3::double - case when seq % 7 = 3 then 1 else 0 end t from v_fix where seq % 13 <> 5), p as (select *, row_number() over (partition by trip_id order by seq) k from f where t >= 0),
        walk as (select trip_id, seq, k, t mark, true keep from p where k = 1 union all select p.trip_id, p.seq, p.k, case when p.t - mark >= 0.5::double then p.t else mark end, p.t - mark >= 0.5::double from walk join p on p.trip_id = walk.trip_id and p.k = walk.k + 1) select trip_id, seq from walk where keep""",
    "leg_targets": """with s as (select p_partkey // 200 plan, p_partkey site, p_partkey % 200 * 1700 + p_partkey % 3 * 900 pos from part), r as (select a.plan, a.site, b.site ahead, row_number() over (partition by a.plan, a.site order by b.pos, b.site) k from s a join s b on a.plan = b.plan and b.pos > a.pos + 20000)
        select plan, site, ahead from r where k <= 30""",
    "way_graph": _with("v_node") + f""", n as (select node_id, lat + node_id % 3 * 0.001::double lat, lon from v_node), i as (select distinct cast(floor(node_id / 8) * 8 as bigint) i from v_node), r as (select i w, k pos, i + k node_id from i, range(9) t(k) union all select i + 1000000000, k, i + 3 + 8 * k from i, range(3) t(k)),
        u as (select node_id, count(*) uses from r group by 1), p as (select w, pos, n.node_id, lat, lon, uses, row_number() over (partition by w order by pos) k, count(*) over (partition by w) m from r join u using (node_id) join n using (node_id)),
        c as (select *, coalesce(sum(case when k = 1 or k = m or uses >= 2 then 1 else 0 end) over (partition by w order by k rows between unbounded preceding and 1 preceding), 0) piece from p),
        e as (select b.w, b.piece, arg_min(a.node_id, b.k) src, arg_max(b.node_id, b.k) dst, sum({_hav('a', 'b')}) len from c b join c a on a.w = b.w and a.k = b.k - 1 group by 1, 2), f as (select * from e where src <> dst and len > 0)
        select src, dst, w way_id, round(len, 5) length_m from f where w % 5 % 3 - 1 >= 0 union all select dst, src, w, round(len, 5) from f where w % 5 % 3 - 1 <= 0""",
    "departures": _with("v_charger") + ", t as (select distinct id, target from (select id, unnest([0.6::double, 0.7::double, 0.8::double, 0.9::double, round(max_power_kw / 500, 1)]) target from v_charger)) select id, cast(row_number() over (partition by id order by target) - 1 as integer) place, target from t",
}
