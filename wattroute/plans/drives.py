"""Queries on drives and their displays: progress, what is left of the way, courses, names of ends; with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wattroute.operators import guide, lines
from wattroute.plans.catalogue import _with, rounded
from wattroute.sources.views import table, view
from wattroute.streaming import drive


def _legs(spark: SparkSession, d: str) -> DataFrame:
    """An order's lines as the legs of a plan; every seventh part's takes no time."""
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")) - 1
    seconds = F.when(F.col("l_partkey") % 7 == 0, 0.0).otherwise(F.col("l_quantity").cast("double") * (30 + F.col("l_suppkey") % 9))
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("plan"), place.cast("bigint").alias("leg"), (F.col("l_quantity").cast("double") * 1000).alias("dist_m"), seconds.alias("drive_s"))


def leg_speeds(spark: SparkSession, d: str) -> DataFrame:
    return guide.leg_ends(_legs(spark, d)).select("plan", "leg", "start_m", "end_m", rounded(F.col("speed_mps")).alias("speed_mps"))


def remaining_way(spark: SparkSession, d: str) -> DataFrame:
    """Each order asks from 12.5 km into its second leg, or its only one; its first two legs end at stops."""
    legs = _legs(spark, d)
    stops = legs.where("leg < 2").select("plan", F.col("leg").alias("stop"), F.concat(F.lit("stop "), F.col("leg").cast("string")).alias("name"), (F.col("leg") * 300.0 + 600).alias("charge_s"))
    asks = guide.leg_ends(legs).groupBy("plan").agg(F.max_by("start_m", F.when(F.col("leg") <= 1, F.col("leg"))).alias("m"), F.max(F.when(F.col("leg") <= 1, F.col("leg"))).alias("leg"))
    places = asks.select(F.col("plan").alias("id"), "plan", (F.col("m") + 12_500.0).alias("along_m"), "leg", F.col("leg").alias("passed"))
    return guide.remaining(places, legs, stops).select("id", rounded(F.col("left_m"), 3).alias("left_m"), rounded(F.col("left_s"), 4).alias("left_s"), "next")


def courses(spark: SparkSession, d: str) -> DataFrame:
    f = view(spark, d, "v_fix").select(F.col("trip_id").alias("drive"), F.col("seq").alias("id"), (F.col("seq") * 97 % 360).alias("target_deg"))
    return guide.smooth_course(f)


def endpoint_names(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("origin", "waypoint", "charger", "dest")]), (k % 4 + 1).cast("int"))
    bias = F.element_at(F.array(*[F.lit(x) for x in ("few_long", "quickest", "many_short", "none")]), (k % 4 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", guide.endpoint_label(kind, k % 5, F.col("p_brand")).alias("label"), guide.bias_factor(bias).alias("bias"), guide.accepted_refit(F.col("p_size") * 8.0).alias("refit"))


def trip_snapshots(spark: SparkSession, d: str) -> DataFrame:
    t = view(spark, d, "v_trip").select("trip_id", "start_unix", guide.merged_snapshot(["display_soc_pct", "charge_kwh"]).alias("s"))
    return t.select("trip_id", F.col("s").isNotNull().alias("kept"), rounded(F.col("s.start_display_soc_pct"), 3).alias("start_pct"), rounded(F.col("s.end_charge_kwh"), 3).alias("end_kwh"))


def drive_events(spark: SparkSession, d: str) -> DataFrame:
    """Every trip along a route of 30 fixes and as many as it has: some off it for a while. Tested against the plain fold."""
    n = F.col("seq")
    f = view(spark, d, "v_fix").withColumn("total_m", F.lit(8000.0))
    ends = F.array(*[F.lit(x) for x in (2500.0, 5500.0, 8000.0)])
    off = F.when((n % 31 > 12) & (n % 31 < 16), 70.0).when(n % 31 == 25, 30.0).otherwise((n % 5).cast("double"))
    fixes = f.select(F.col("trip_id").alias("drive"), n.alias("id"), (n * 4.0).alias("t_s"), (n * 278.0).alias("along_m"), off.alias("off_m"), (n == 20).alias("replanned"), F.slice(ends, 1, 2).alias("stops_m"), ends.alias("leg_ends_m"), "total_m")
    return drive.progress_of_table(fixes)


def plan_guidance(spark: SparkSession, d: str) -> DataFrame:
    """Each trip's recorded line as a plan of three legs with steps along them. Tested against the plain loop."""
    f = view(spark, d, "v_fix")
    line = lines.along(f.select(F.col("trip_id").alias("line"), F.col("seq").alias("pos"), "lat", "lon")).withColumnRenamed("line", "plan")
    whole = line.groupBy("plan").agg(F.max("cum_m").alias("m"), F.max("pos").alias("last"))
    legs = whole.select("plan", F.explode(F.expr("sequence(0L, 2L)")).alias("leg"), (F.col("m") / 3).alias("dist_m"), (F.col("m") / 60).alias("drive_s"))
    own = line.join(whole, "plan").withColumn("leg", F.least(F.floor(F.col("cum_m") * 3 / F.greatest("m", F.lit(1.0))), F.lit(2)))
    kind = F.when(F.col("pos") == F.min("pos").over(Window.partitionBy("plan", "leg")), "depart").when(F.col("pos") == F.max("pos").over(Window.partitionBy("plan", "leg")), "arrive").otherwise("turn")
    steps = own.select("plan", "leg", F.col("pos").alias("ord"), kind.alias("maneuver"), (F.col("cum_m") - F.col("leg") * F.col("m") / 3).alias("from_leg_start_m"), "lat", (F.col("lon") + 0.00005).alias("lon"))
    stops = whole.where("plan % 2 = 0").select("plan", F.lit(0).cast("bigint").alias("stop"), F.lit("halt").alias("name"), (F.col("m") / 3 - 100).alias("from_start_m"))
    got = guide.plan_guidance(steps, legs, stops, line)
    return got.select("plan", "leg", "ord", "maneuver", "arrive_label", rounded(F.col("along_m"), 3).alias("along_m"), "then")


QUERIES = [leg_speeds, remaining_way, courses, endpoint_names, trip_snapshots, drive_events, plan_guidance]

_LEGS = """with l as (select l_orderkey plan, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 leg, cast(l_quantity as double) * 1000 m, case when l_partkey % 7 = 0 then 0 else cast(l_quantity as double) * (30 + l_suppkey % 9) end s from lineitem),
    e as (select *, sum(m) over (partition by plan order by leg) end_m, case when s > 0 then m / s else 0.0::double end v from l)"""
ORACLE = {
    "leg_speeds": _LEGS + " select plan, leg, end_m - m start_m, end_m, round(v, 6) speed_mps from e",
    "remaining_way": _LEGS + """, p as (select plan, max(end_m) total, max(leg) filter (where leg <= 1) leg, arg_max(end_m - m, leg) filter (where leg <= 1) + 12500 x from e group by 1),
        r as (select p.plan, total, x, p.leg, sum(case when e.leg = p.leg and v > 0 then greatest(end_m - x, 0) / v when e.leg > p.leg then s else 0 end) t, max(e.leg) last from p join e on e.plan = p.plan group by 1, 2, 3, 4)
        select plan id, round(greatest(total - x, 0), 3) left_m, round(t + coalesce((select sum(k * 300.0::double + 600) from range(2) q(k) where k >= r.leg and k <= r.last), 0), 4) left_s, 'stop ' || leg as next from r""",
    "courses": _with("v_fix") + """, f as (select trip_id drive, seq id, seq * 97 % 360 t from v_fix),
        walk as (select drive, id, cast((least(greatest(case when t > 180 then t - 360 else t end, -45), 45) + 360) % 360 as double) c from f where id = 0
          union all select f.drive, f.id, ((c + least(greatest(case when f.t - c > 180 then f.t - c - 360 when f.t - c < -180 then f.t - c + 360 else f.t - c end, -45), 45)) + 360) % 360 from walk join f on f.drive = walk.drive and f.id = walk.id + 1)
        select drive, id, c course_deg from walk""",
    "endpoint_names": """select p_partkey, case p_partkey % 4 when 0 then 'Origin' when 1 then 'Waypoint ' || (p_partkey % 5 + 1) when 2 then p_brand else 'Dest' end as label, case p_partkey % 4 when 0 then 2.0::double when 1 then 1 when 2 then 0.4::double end bias,
        least(greatest(p_size * 8.0::double, 120), 260) refit from part""",
    "trip_snapshots": _with("v_trip") + """ select trip_id, coalesce(start_display_soc_pct, end_display_soc_pct, start_charge_kwh, end_charge_kwh) is not null kept, round(start_display_soc_pct, 3) start_pct, round(end_charge_kwh, 3) end_kwh from v_trip""",
}
