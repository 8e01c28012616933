"""Least travel times over a road network by rounds of joins, many sources at once, and the routes behind them.

A round extends only the labels that the last round improved, each by one edge, and merges them with one aggregation by (source, node).
Costs are thus sums over the edges in the order of the way, from the source on: of two ways the same sum is compared, and a limit cut, as
a plain search does it, to the last bit. Each round is written to the shared folder, so the plan stays short and a lost executor costs
one round. The number of rounds is that of the edges of the longest best route (a time limit bounds it); state grows as sources times
nodes reached, and never holds a way longer than what its source still needs. Wanted nodes that are near are found without rounds (near.py). Routes are read back by doubled jumps: their rounds are logarithmic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattroute.functions.road import edge_seconds
from wattroute.operators import near
from wattroute.operators.network import strong_components
from wattroute.operators.rounds import durable


def _weights(edges: DataFrame) -> DataFrame:
    """src, dst, w: the cheapest of parallel edges; edges without a speed are closed."""
    open_ = edges.where("src <> dst and speed_kmh > 0")
    return open_.groupBy("src", "dst").agg(F.min(edge_seconds(F.col("length_m"), F.col("speed_kmh"))).alias("w"))


def travel_costs(edges: DataFrame, sources: DataFrame, limit_s: float | None = None) -> DataFrame:
    """source, node, cost_s for every node reached from each source (column node_id) within ``limit_s`` (None: all).

    Unreachable nodes have no row; a source reaches itself at cost 0; repeated sources count once.
    """
    weights = durable(_weights(edges))
    at = sources.select(F.col("node_id").alias("source"), F.col("node_id").alias("node")).where("source is not null").distinct()
    return _relax(weights, durable(at.withColumn("cost_s", F.lit(0.0)).withColumn("fresh", F.lit(True))), limit_s, None)


def _relax(weights: DataFrame, labels: DataFrame, limit_s: float | None, wanted: DataFrame | None) -> DataFrame:
    """Rounds until nothing improves. With ``wanted`` (source, node) a source stops where all its wanted nodes are known to be nearer."""
    while not (front := labels.where("fresh")).isEmpty():
        if wanted is not None:
            known = wanted.join(labels.select("source", "node", "cost_s"), ["source", "node"], "left")
            bound = known.groupBy("source").agg(F.when(F.count("cost_s") == F.count(F.lit(1)), F.max("cost_s")).alias("bound"))
            front = front.join(bound, "source").where("bound is null or cost_s < bound")
        step = front.join(weights, F.col("node") == F.col("src")).withColumn("on", F.col("cost_s") + F.col("w"))
        if wanted is not None:
            step = step.where("bound is null or on <= bound")
        if limit_s is not None:
            step = step.where(F.col("on") <= limit_s)
        step = step.select("source", F.col("dst").alias("node"), F.col("on").alias("cost_s"))
        both = labels.select("source", "node", "cost_s", F.col("cost_s").alias("known")).unionByName(step, allowMissingColumns=True)
        best = both.groupBy("source", "node").agg(F.min("cost_s").alias("cost_s"), F.min("known").alias("known"))
        labels = durable(best.select("source", "node", "cost_s", (F.col("known").isNull() | (F.col("cost_s") < F.col("known"))).alias("fresh")))
    return labels.drop("fresh")


def reach_of_parts(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, component; pairs a, b of components that an edge joins) of a network: what costs_to() needs to know of it, once for many calls."""
    live = edges.where("speed_kmh > 0")
    parts = durable(strong_components(live))
    of = lambda c, n: parts.select(F.col("node").alias(c), F.col("component").alias(n))
    steps = live.select("src", "dst").join(of("src", "a"), "src").join(of("dst", "b"), "dst").where("a <> b").select("a", "b").distinct()
    return parts, durable(steps)


def costs_to(edges: DataFrame, pairs: DataFrame, reach: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """source, node, cost_s: least costs from each source to its wanted nodes (source, node), where a way leads there, and to all nodes on the way.

    Pairs that no way joins are found first, from the strong components and what leads from one to another (``reach``: of
    reach_of_parts(), if it is known already); so no source looks through the whole network for a node that it cannot reach.
    Sources whose wanted nodes are near are then searched in blocks; the rounds follow the others, each only up to the farthest
    of its wanted nodes, once all of them have been reached.
    """
    return _costs_to(edges, durable(pairs.select("source", "node").distinct()), reach)


def _costs_to(edges: DataFrame, wanted: DataFrame, reach: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    parts, steps = reach or reach_of_parts(edges)
    of = lambda c, n: parts.select(F.col("node").alias(c), F.col("component").alias(n))
    placed = durable(wanted.join(of("source", "a"), "source", "left").join(of("node", "b"), "node", "left"))
    seen = front = durable(placed.where("a is not null").select("a", F.col("a").alias("b")).distinct())
    while not front.isEmpty():
        ahead = front.withColumnRenamed("b", "via").join(steps.select(F.col("a").alias("via"), "b"), "via").select("a", "b").distinct()
        front = durable(ahead.join(seen, ["a", "b"], "left_anti"))
        seen = durable(seen.unionByName(front))
    open_ = durable(placed.join(seen, ["a", "b"], "left_semi").select("source", "node").unionByName(placed.where("source = node").select("source", "node")).distinct())
    weights = durable(_weights(edges))
    found, left = near.search(weights, open_)
    return found if left.isEmpty() else found.unionByName(_between(weights, left))


def _between(weights: DataFrame, wanted: DataFrame) -> DataFrame:
    at = wanted.select("source", F.col("source").alias("node")).distinct()
    return _relax(weights, durable(at.withColumn("cost_s", F.lit(0.0)).withColumn("fresh", F.lit(True))), None, wanted)


def many_to_many(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Each wanted (source, node) with its least cost, null only if no way leads there."""
    wanted = durable(pairs.select("source", "node").distinct())
    return wanted.join(_costs_to(edges, wanted), ["source", "node"], "left")


def predecessors(edges: DataFrame, costs: DataFrame) -> DataFrame:
    """source, node, prev: the node before on a best route, the smallest of equals; sources have none."""
    before = costs.select("source", F.col("node").alias("src"), F.col("cost_s").alias("c"))
    into = costs.join(_weights(edges), F.col("node") == F.col("dst")).join(before, ["source", "src"])
    tight = into.where((F.col("node") != F.col("source")) & (F.abs(F.col("c") + F.col("w") - F.col("cost_s")) <= 1e-9))
    return tight.groupBy("source", "node").agg(F.min("src").alias("prev"))


def routes(edges: DataFrame, costs: DataFrame, targets: DataFrame) -> DataFrame:
    """source, target, node, back (edges left to the target) of the best route to each (source, target) that was reached."""
    jump = durable(predecessors(edges, costs).withColumnRenamed("prev", "to"))
    jumps = []
    while not jump.isEmpty():  # the k-th leads 2 ** k edges back
        jumps.append(jump)
        onward = jump.select("source", F.col("node").alias("to"), F.col("to").alias("then"))
        jump = durable(jump.join(onward, ["source", "to"]).select("source", "node", F.col("then").alias("to")))
    wanted = targets.select("source", "target").distinct().join(costs.select("source", F.col("node").alias("target")), ["source", "target"])
    found = durable(wanted.select("source", "target", F.col("target").alias("node"), F.lit(0).alias("back")))
    for k in range(len(jumps) - 1, -1, -1):
        between = found.join(jumps[k], ["source", "node"]).select("source", "target", F.col("to").alias("node"), (F.col("back") + 2**k).alias("back"))
        found = durable(found.unionByName(between))
    return found
