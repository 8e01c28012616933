"""Queries of the charging-stop search and of the graphs it searches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattroute.functions import physics
from wattroute.operators import assembly, charging, routing
from wattroute.plans.catalogue import TEMP_C, rounded
from wattroute.sources.views import table, view

PLACES = 8  # of a drawn journey: origin, chargers, a waypoint, destination


def drawn_requests(spark: SparkSession, d: str) -> DataFrame:
    """A request of each supplier; batteries, floors and bias differ."""
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(
        k.cast("bigint").alias("request"), (F.lit(0.2) + k % 8 * 0.1).alias("depart_soc"), (F.lit(0.1) + k % 3 * 0.1).alias("arrival_min"), (F.lit(0.1) + k % 2 * 0.1).alias("charger_min"), (F.lit(0.8) + k % 3 * 0.05).alias("charger_max"),
        F.element_at(F.array(*[F.lit(x) for x in (0.4, 1.0, 2.0)]), (k % 3 + 1).cast("int")).alias("bias"), (k % 2).cast("double").alias("warmth"), (k % 4 != 0).alias("offer"),
    )


def drawn_graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Candidate nodes and legs of each request: every place leads to the next three, the first to the last."""
    k, i, j = F.col("request"), F.col("node"), F.col("dst")
    n = drawn_requests(spark, d).select(k, F.explode(F.expr(f"sequence(0L, {PLACES - 1}L)")).alias("node"))
    kind = F.when(i == 0, "origin").when(i == PLACES - 1, "dest").when(i == 4, "waypoint").otherwise("charger")
    power = F.when((kind == "charger") | ((i == 4) & (k % 3 == 0)), F.element_at(F.array(*[F.lit(x) for x in (50.0, 150.0, 300.0)]), ((k + i * i) % 3 + 1).cast("int")))
    nodes = n.select(k, i, i.cast("int").alias("ord"), kind.alias("kind"), power.alias("power_kw"), F.when((i == 4) & (k % 5 == 0), 0.5).alias("override_soc"))
    ahead = n.where(i < PLACES - 1).withColumn("dst", F.explode(F.expr(f"if(node = 0, array(1L, 2L, 3L, {PLACES - 1}L), sequence(node + 1, least(node + 3, {PLACES - 1}L)))")))
    ahead = ahead.where("not (node < 4 and dst > 4 and request % 2 = 0)")  # half of the requests must pass their waypoint
    metres = (j - i) * (60_000.0 + (k * 7919 + i * 31 + j * 17) % 50_000)
    wh_per_m = 0.15 + (k * 13 + i * 5 + j) % 80 / 1000
    legs = ahead.withColumn("dist_m", metres).withColumn("s", metres / (22.0 + (k + j) % 10)).withColumn("wh", metres * wh_per_m)
    evals = F.array(*[F.struct((F.col("s") * f).alias("time_s"), (F.col("wh") / f).alias("energy_wh")) for f in (1.0, 1.05, 1.1, 1.2)])
    return nodes, legs.select(k, (i * 100 + j).alias("leg"), i.alias("src"), "dst", "dist_m", evals.alias("evals"))


def _solved(spark: SparkSession, d: str) -> DataFrame:
    return charging.solve(drawn_requests(spark, d), *drawn_graph(spark, d))


def charging_legs(spark: SparkSession, d: str) -> DataFrame:
    """Tested against a plain search."""
    got = _solved(spark, d)
    number = [rounded(F.col(c), 6).alias(c) for c in ("drive_s", "energy_wh", "depart_soc", "arrival_soc", "charge_s")]
    return got.select("request", "alternative", "rung", "seq", "leg", "cap_kmh", *number, "flag")


def charging_plans(spark: SparkSession, d: str) -> DataFrame:
    """Tested against a plain search."""
    got = charging.totals(_solved(spark, d))
    return got.select("request", "alternative", "rung", "legs", "stops", *[rounded(F.col(c), 3).alias(c) for c in ("drive_s", "charge_s", "total_s", "dist_m")], "below_wanted", "runs_out")


def road_network(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The network at the scale of a country: its nodes ten times as far apart."""
    nodes = view(spark, d, "v_node").select("node_id", (F.lit(48.0) + (F.col("lat") - 48.0) * 10).alias("lat"), (F.lit(5.0) + (F.col("lon") - 5.0) * 10).alias("lon"))
    edges = view(spark, d, "v_edge").withColumn("length_m", F.col("length_m") * 5).withColumn("speed_kmh", F.col("speed_kmh") + 40)
    return nodes, edges


def journeys(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Points of a journey of each nation to the north (the network has few ways back), over one waypoint, and the chargers on the same scale."""
    k, nodes = F.col("n_nationkey"), F.broadcast(view(spark, d, "v_node").agg(F.max("node_id").alias("most")))
    n = table(spark, d, "nation").join(nodes)  # one row: the number of nodes
    column = (k * 3 + F.col("place")) % F.greatest(F.floor(F.col("most") / 40), F.lit(1))
    at = n.select(k.cast("bigint").alias("request"), "most", "n_nationkey", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("place"))
    points = at.select("request", "place", (F.lit(48.0) + (k % 13 + F.col("place") * 13) * 0.05 + 0.004).alias("lat"), (F.lit(5.0) + column * 0.07 + 0.003).alias("lon"), F.when(k % 2 == 0, 0.5).alias("override_soc"))
    c = view(spark, d, "v_charger")
    sites = c.select(F.col("id").alias("site"), (F.lit(48.0) + (F.col("lat") - 48.0) * 10).alias("lat"), (F.lit(5.0) + (F.col("lon") - 5.0) * 2).alias("lon"), F.col("max_power_kw").alias("power_kw"))
    return points, sites.where("power_kw >= 50")


def edge_wh(speed, delta):
    return physics.edge_energy_wh(physics.TWO_WHEEL, F.col("length_m"), speed, F.col("ascent_m"), F.col("descent_m"), F.col("road_class"), F.lit(TEMP_C), delta)


def candidate_legs(spark: SparkSession, d: str) -> DataFrame:
    """The legs of every journey's candidate graph. Tested against a plain assembly."""
    points, sites = journeys(spark, d)
    nodes, legs, _ = assembly.assemble(points, sites, *road_network(spark, d), edge_wh)
    names = nodes.select("request", "node", F.coalesce("site", "kind").alias("name"))
    end = lambda c: names.withColumnRenamed("node", c).withColumnRenamed("name", f"{c}_name")
    named = legs.join(end("src"), ["request", "src"]).join(end("dst"), ["request", "dst"])
    four = [rounded(F.get("evals", F.lit(i))[c], 4).alias(f"{c}_{i}") for i in range(4) for c in ("time_s", "energy_wh")]
    return named.select("request", "src", "dst", "src_name", "dst_name", rounded(F.col("dist_m"), 4).alias("dist_m"), *four)


def journey_plans(spark: SparkSession, d: str) -> DataFrame:
    """From points to plans: graphs in the narrow corridor, the wide one only for journeys whose plan is flagged, and of both plans that with fewer flags."""
    points, sites = journeys(spark, d)
    roads = road_network(spark, d)
    reach = routing.reach_of_parts(roads[1])
    k = F.col("request")
    asks = points.groupBy("request").agg(F.lit(0.5).alias("depart_soc")).select(k, (F.lit(0.25) + k % 4 * 0.2).alias("depart_soc"), F.lit(0.1).alias("arrival_min"), F.lit(0.1).alias("charger_min"), F.lit(0.8).alias("charger_max"), F.lit(1.0).alias("bias"), F.lit(1.0).alias("warmth"), F.lit(False).alias("offer"))

    def plans(of: DataFrame, width_m: float) -> DataFrame:
        nodes, legs, _ = assembly.assemble(of, sites, *roads, edge_wh, width_m, reach=reach)
        return charging.totals(charging.solve(asks.join(of.select("request").distinct(), "request", "left_semi"), nodes, legs))

    best = charging.widened(lambda of: plans(of, assembly.CORRIDOR_M), lambda of: plans(of, assembly.WIDE_M), points)
    return best.select("request", "corridor", "rung", "legs", "stops", *[rounded(F.col(c), 3).alias(c) for c in ("drive_s", "charge_s", "dist_m")], "below_wanted", "runs_out")


def kept_waypoints(spark: SparkSession, d: str) -> DataFrame:
    """Orders as waypoints of their customer's journey; every seventh could not be placed, the journeys of some have not begun."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("request"), F.col("o_orderkey").alias("waypoint"), F.when(F.col("o_orderkey") % 7 != 0, (F.col("o_orderkey") % 500).cast("double")).alias("along_m"))
    c = table(spark, d, "customer").where("c_custkey % 9 <> 0").select(F.col("c_custkey").alias("request"), (F.col("c_custkey") % 400).cast("double").alias("along_m"))
    return assembly.waypoints_ahead(o, c)


QUERIES = [charging_plans, charging_legs, candidate_legs, journey_plans, kept_waypoints]

ORACLE = {
    "kept_waypoints": """select o_custkey request, o_orderkey waypoint, case when o_orderkey % 7 <> 0 then cast(o_orderkey % 500 as double) end along_m from orders left join (select * from customer where c_custkey % 9 <> 0) c on c_custkey = o_custkey
        where o_orderkey % 7 = 0 or c_custkey is null or o_orderkey % 500 > c_custkey % 400""",
}
