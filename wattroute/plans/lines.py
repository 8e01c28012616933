"""Queries on lines: display lines, snapping, trimming, splitting, stops in order, elevation; with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wattroute.operators import lines, raster
from wattroute.plans.catalogue import _with, rounded
from wattroute.sources.views import table, view


def _tracks(spark: SparkSession, d: str) -> DataFrame:
    """Recorded trips as lines."""
    return view(spark, d, "v_fix").select(F.col("trip_id").alias("line"), F.col("seq").alias("pos"), "lat", "lon")


def display_lines(spark: SparkSession, d: str) -> DataFrame:
    """Each trip as a plan, its legs of 40 fixes. Tested against the plain recursion."""
    t = _tracks(spark, d)
    legs = t.select(F.col("line").alias("plan"), F.floor(F.col("pos") / 40).alias("leg"), "pos", "lat", "lon")
    return lines.display_line(legs, 4.0)


def route_snaps(spark: SparkSession, d: str) -> DataFrame:
    """Every fix of a trip, moved a little, on the trip's simplified line. Tested against the plain loop."""
    t = _tracks(spark, d)
    fixes = t.select("line", F.col("pos").alias("id"), (F.col("lat") + (F.col("pos") * 7 % 5 - 2) * 1e-4).alias("lat"), "lon")
    got = lines.snap_in_order(fixes, lines.along(lines.simplify(t, 20.0)))
    return got.select(F.col("line").alias("trip_id"), F.col("id").alias("seq"), "seg", rounded(F.col("along_m"), 3).alias("along_m"), rounded(F.col("off_m"), 3).alias("off_m"))


def _pins(t: DataFrame) -> DataFrame:
    """Where a trip was meant to begin and end: a little beside its first fixes and last fixes."""
    third = t.where("pos = 2").select("line", F.lit("origin").alias("end"), (F.col("lat") + 0.00003).alias("lat"), (F.col("lon") + F.col("line") % 9 * 0.0001).alias("lon"))
    last = t.groupBy("line").agg(F.max_by(F.struct("lat", "lon"), "pos").alias("p"))
    return third.unionByName(last.select("line", F.lit("destination").alias("end"), (F.col("p.lat") - 0.0004).alias("lat"), F.col("p.lon").alias("lon")))


def line_trims(spark: SparkSession, d: str) -> DataFrame:
    """Points left of each trip's line and its stubs. Tested on lines whose places are known."""
    t = _tracks(spark, d)
    cut, stubs = lines.trim(t, _pins(t))
    place = [rounded(F.col(c), 7).alias(c) for c in ("lat", "lon")]
    return cut.select("line", F.lit("line").alias("part"), "pos", *place).unionByName(stubs.select("line", F.col("end").alias("part"), F.lit(0).alias("pos"), *place))


def curve_splits(spark: SparkSession, d: str) -> DataFrame:
    """The charge along each trip, split a third of the way beyond its start (of some trips beyond their end)."""
    f = view(spark, d, "v_fix").select("trip_id", (F.col("seq") * 170.0).alias("x"), (80 - (F.col("seq") * 7 % 50) * 0.5).alias("soc"))
    at = f.groupBy("trip_id").agg(F.max("x").alias("m")).select("trip_id", F.when(F.col("trip_id") % 5 == 0, F.col("m") + 10).when(F.col("trip_id") % 5 == 1, 340.0).otherwise(F.col("m") / 3).alias("place"))
    return lines.split(f, at, "trip_id", "x", "soc").select("trip_id", "side", rounded(F.col("x"), 4).alias("x"), rounded(F.col("soc"), 6).alias("soc"))


def stop_places(spark: SparkSession, d: str) -> DataFrame:
    """An order's lines are the legs of a plan, to the supplier's number modulo 3; the ends of its legs 2, 4 and 5 are its stops, but some orders have a second stop that no leg leads to."""
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    legs = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("plan"), place.alias("seq"), (F.col("l_suppkey") % 3).cast("string").alias("to_name"), F.col("l_quantity").cast("double").alias("dist_m"))
    stops = legs.where("seq = 2 or seq = 4 or seq = 5").select("plan", F.col("seq").alias("stop"), F.when((F.col("plan") % 4 == 0) & (F.col("seq") == 4), "none").otherwise(F.col("to_name")).alias("name"))
    return lines.match_stops(legs, stops)


def elevations(spark: SparkSession, d: str) -> DataFrame:
    """Parts are the cells of a tile, some without a reading and some absurd; chargers ask, some from another tile."""
    k = F.col("p_partkey")
    part = table(spark, d, "part")
    cells = part.select(F.lit(48).alias("tile_lat"), F.lit(5).alias("tile_lon"), F.floor(k / 40).cast("int").alias("row"), (k % 40).cast("int").alias("col"), F.when(k % 17 == 0, None).when(k % 23 == 0, 20_000.0).otherwise(F.col("p_size") * 10.0).alias("metres"))
    tiles = cells.groupBy("tile_lat", "tile_lon").agg(F.lit(40).alias("width"), (F.max("row") + 1).alias("height"))
    n = F.regexp_extract("id", "([0-9]+)$", 1).cast("int")
    points = view(spark, d, "v_charger").select("id", F.when(n % 11 == 0, F.col("lat") + 2).otherwise(F.lit(48.0) + (F.col("lat") - 48.0) * 5).alias("lat"), (F.lit(5.0) + (F.col("lon") - 5.0) * 2.5).alias("lon"))
    return raster.sample(points, tiles, cells).select("id", rounded(F.col("elevation_m").cast("double"), 3).alias("elevation_m"))


QUERIES = [display_lines, route_snaps, line_trims, curve_splits, stop_places, elevations]

ORACLE = {
    "curve_splits": _with("v_fix") + """, f as (select trip_id, seq * 170.0::double x, 80 - (seq * 7 % 50) * 0.5::double soc from v_fix),
        a as (select trip_id, case trip_id % 5 when 0 then max(x) + 10 when 1 then 340.0::double else max(x) / 3 end p from f group by 1), r as (select f.*, p from f join a using (trip_id)),
        n as (select trip_id, p, max(x) filter (where x <= p) ax, arg_max(soc, x) filter (where x <= p) ay, min(x) filter (where x >= p) bx, arg_min(soc, x) filter (where x >= p) as "by" from r group by 1, 2),
        m as (select trip_id, p, coalesce(case when bx > ax then ay + ("by" - ay) * (p - ax) / (bx - ax) end, ay, "by") y from n where ax is distinct from p)
        select trip_id, side, round(x, 4) x, round(soc, 6) soc from (select trip_id, 'behind' side, x, soc from r where x <= p union all select trip_id, 'ahead', x, soc from r where x >= p union all select trip_id, unnest(['behind', 'ahead']), p, y from m)""",
    "stop_places": """with recursive l as (select l_orderkey plan, cast(l_suppkey % 3 as varchar) to_name, cast(l_quantity as double) m, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity) k from lineitem),
        s as (select plan, cast(k as integer) stop, case when plan % 4 = 0 and k = 4 then 'none' else to_name end as name, row_number() over (partition by plan order by k) n from l where k in (2, 4, 5)),
        walk as (select l.plan, k, m, coalesce(s.name = to_name, false) hit, case when s.name = to_name then 1 else 0 end done, s.stop from l left join s on s.plan = l.plan and s.n = 1 where k = 1
          union all select l.plan, l.k, walk.m + l.m, coalesce(s.name = to_name, false), walk.done + case when s.name = to_name then 1 else 0 end, s.stop from walk join l on l.plan = walk.plan and l.k = walk.k + 1 left join s on s.plan = l.plan and s.n = walk.done + 1)
        select plan, stop, m from_start_m from walk where hit""",
    "elevations": _with("v_charger") + """, c as (select cast(p_partkey // 40 as integer) r, p_partkey % 40 q, case when p_partkey % 17 = 0 then null when p_partkey % 23 = 0 then 20000.0::double else p_size * 10.0::double end m from part), h as (select max(r) + 1 h from c),
        p as (select id, case when regexp_extract(id, '([0-9]+)$', 1)::int % 11 = 0 then lat + 2 else 48.0::double + (lat - 48.0::double) * 5 end lat, 5.0::double + (lon - 5.0::double) * 2.5::double lon from v_charger),
        g as (select *, least(greatest(h * (49 - lat) - 0.5::double, 0), h - 1) y, least(greatest(40 * (lon - 5) - 0.5::double, 0), 39) x from p, h where lat < 49 and lat >= 48 and lon < 6),
        k as (select id, y - floor(y) fr, x - floor(x) fc, cast(floor(y) as integer) r0, cast(floor(x) as integer) c0, h from g),
        q as (select id, r0 r, c0 c, (1 - fr) * (1 - fc) s from k union all select id, r0, least(c0 + 1, 39), (1 - fr) * fc from k union all select id, least(r0 + 1, h - 1), c0, fr * (1 - fc) from k union all select id, least(r0 + 1, h - 1), least(c0 + 1, 39), fr * fc from k),
        e as (select id, case when bool_and(m is not null) then sum(s * m) end m from q left join c on c.r = q.r and c.q = q.c where s > 0 group by 1)
        select p.id, round(cast(cast(case when abs(e.m) <= 9000 then e.m else 0 end as float) as double), 3) elevation_m from p left join e on e.id = p.id""",
}
