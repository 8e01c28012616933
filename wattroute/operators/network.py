"""Operators over the edges and ways of a road network: adjacency, offsets, imports, integrity, strong components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattroute.functions.road import edge_seconds
from wattroute.operators.rounds import durable


def neighbours(edges: DataFrame) -> DataFrame:
    """node_id, out, into: sorted distinct ends of the edges that leave and that reach each node."""
    ends = edges.select(F.col("src").alias("node_id"), F.col("dst").alias("out"), F.lit(None).cast(edges.schema["src"].dataType).alias("into"))
    ends = ends.unionByName(edges.select(F.col("dst").alias("node_id"), F.lit(None).cast(edges.schema["dst"].dataType).alias("out"), F.col("src").alias("into")))
    return ends.groupBy("node_id").agg(F.array_sort(F.collect_set("out")).alias("out"), F.array_sort(F.collect_set("into")).alias("into"))


def offsets(edges: DataFrame, key: str) -> DataFrame:
    """key, degree, first_edge: how many edges have each end and how many have a smaller one; running sums in three levels of blocks."""
    n = edges.groupBy(key).agg(F.count(F.lit(1)).alias("degree")).withColumn("block", F.floor(F.col(key) / 1024))
    n = n.withColumn("upto", F.sum("degree").over(Window.partitionBy("block").orderBy(key)) - F.col("degree"))
    blocks = n.groupBy("block").agg(F.sum("degree").alias("all")).withColumn("top", F.floor(F.col("block") / 1024))
    tops = blocks.groupBy("top").agg(F.sum("all").alias("total"))  # a row for a million nodes: one window over all of them is small
    tops = tops.select("top", (F.sum("total").over(Window.orderBy("top")) - F.col("total")).alias("above"))
    blocks = blocks.withColumn("within", F.sum("all").over(Window.partitionBy("top").orderBy("block")) - F.col("all")).join(tops, "top")
    return n.join(blocks, "block").select(key, "degree", (F.col("above") + F.col("within") + F.col("upto")).alias("first_edge"))


def cheapest_parallel(edges: DataFrame) -> DataFrame:
    """src, dst, slot of the quickest of parallel edges, the first of equals. edges(slot, src, dst, length_m, speed_kmh)."""
    cost = edge_seconds(F.col("length_m"), F.col("speed_kmh"))
    return edges.where("speed_kmh > 0").groupBy("src", "dst").agg(F.min(F.struct(cost.alias("cost"), "slot")).alias("b")).select("src", "dst", "b.slot", F.col("b.cost").alias("cost_s"))


def accept_ways(files: DataFrame, default_kmh: Column, tagged_kmh: Column) -> DataFrame:
    """Ways of several files as one table: of one id the first (file, pos) counts, and takes the id even if it is then rejected
    (no road for cars, fewer than two nodes). Adds speed_kmh: the tag's, else that of the kind of road."""
    first = Window.partitionBy("way_id").orderBy("file", "pos")
    kept = files.withColumn("_n", F.row_number().over(first)).where(F.col("_n") == 1).drop("_n")
    return kept.where(default_kmh.isNotNull() & (F.size("refs") >= 2)).withColumn("speed_kmh", F.coalesce(tagged_kmh, default_kmh))


def needed_nodes(refs: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes that ways use, with what makes each a junction; references to nodes that are not there).

    refs(way_id, pos, node_id). A junction is an end of a way or a node of two or more places of ways.
    """
    w = Window.partitionBy("way_id").orderBy("pos")
    ends = F.lag("pos").over(w).isNull() | F.lead("pos").over(w).isNull()
    uses = refs.withColumn("end", ends).groupBy("node_id").agg(F.count(F.lit(1)).alias("uses"), F.max("end").alias("end"))
    found = nodes.join(uses, "node_id").withColumn("junction", F.col("end") | (F.col("uses") >= 2))
    return found, uses.join(nodes.select("node_id"), "node_id", "left_anti").select("node_id", "uses")


def dictionary(df: DataFrame, value: str, order: str) -> DataFrame:
    """value, id: distinct texts numbered from 1 as they first occur; empty and null texts are number 0 and not listed.

    The numbering is one window over the distinct texts, which are few beside the rows that use them.
    """
    first = df.where(F.coalesce(value, F.lit("")) != "").groupBy(value).agg(F.min(order).alias("_first"))
    return first.select(value, F.row_number().over(Window.orderBy("_first", value)).alias("id"))


def snap_cells(nodes: DataFrame, size: float = 0.1) -> DataFrame:
    """node_id, row, col: cells over the nodes' own box; the last row and column also take what lies on the far edge."""
    box = nodes.agg(*[f(c).alias(f"{n}_{c}") for c in ("lat", "lon") for n, f in (("min", F.min), ("max", F.max))])

    def cell(c: str) -> Column:
        last = F.greatest(F.ceil((F.col(f"max_{c}") - F.col(f"min_{c}")) / size) - 1, F.lit(0))
        return F.least(F.floor(F.round((F.col(c) - F.col(f"min_{c}")) / size, 9)), last)

    return nodes.join(F.broadcast(box)).select("node_id", cell("lat").alias("row"), cell("lon").alias("col"))  # the box is one row


def _spread(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels (node, at) after the largest ones have reached along the edges all that they can."""
    while True:
        step = edges.join(labels.select(F.col("node").alias("src"), "at"), "src").select(F.col("dst").alias("node"), F.col("at").alias("new"))
        best = step.groupBy("node").agg(F.max("new").alias("new"))
        labels = durable(labels.join(best, "node", "left").select("node", F.greatest("at", F.coalesce("new", "at")).alias("at"), (F.col("new") > F.col("at")).alias("moved")))
        if labels.where("moved").isEmpty():
            return labels.select("node", "at")
        labels = labels.select("node", "at")


def connected(pairs: DataFrame) -> DataFrame:
    """node, rep: a representative of the undirected component of every node of the pairs (a, b).

    Each round maps a node to its neighbour of least hash (or itself) and contracts the pairs by that map: rounds are logarithmic also
    for long chains, and each is checkpointed.
    """
    e, total = durable(pairs.select("a", "b").where("a <> b").distinct()), None
    while not e.isEmpty():
        both = e.union(e.select("b", "a"))
        own = F.struct(F.xxhash64("a").alias("h"), F.col("a").alias("n"))
        least = both.groupBy("a").agg(F.min(F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("n"))).alias("m"))
        hop = durable(least.select(F.col("a").alias("node"), F.least(own, F.col("m"))["n"].alias("rep")))
        if total is None:
            total = hop
        else:
            total = durable(total.join(hop.select(F.col("node").alias("rep"), F.col("rep").alias("next")), "rep", "left").select("node", F.coalesce("next", "rep").alias("rep")))
        ends = lambda c: hop.select(F.col("node").alias(c), F.col("rep").alias(f"r{c}"))
        e = durable(e.join(ends("a"), "a").join(ends("b"), "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    return total if total is not None else e.select(F.col("a").alias("node"), F.col("b").alias("rep"))


def strong_components(edges: DataFrame) -> DataFrame:
    """node, component (its largest node) of every node that an edge touches.

    Nodes that lead to each other directly are one: they are contracted first (most roads lead both ways), again and again
    while there are any. What is left is coloured: the largest node that can reach a node colours it; a colour's own node and all
    of that colour that can reach it are a component, and leave. Rounds are checkpointed; nothing is collected.
    """
    e = durable(edges.select("src", "dst").where("src <> dst").distinct())
    names = durable(edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct().select("node", F.col("node").alias("rep")))
    while True:
        back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        one = connected(e.join(back, ["src", "dst"], "left_semi").select(F.col("src").alias("a"), F.col("dst").alias("b")))
        if one.isEmpty():
            break
        to = lambda c: one.select(F.col("node").alias(c), F.col("rep").alias(f"r{c}"))
        names = durable(names.join(to("rep"), "rep", "left").select("node", F.coalesce("rrep", "rep").alias("rep")))
        moved = e.join(to("src"), "src", "left").join(to("dst"), "dst", "left").select(F.coalesce("rsrc", "src").alias("src"), F.coalesce("rdst", "dst").alias("dst"))
        e = durable(moved.where("src <> dst").distinct())
    parts = _coloured(e)
    names = names.join(parts.select(F.col("node").alias("rep"), "component"), "rep", "left").select("node", F.coalesce("component", "rep").alias("part"))
    most = names.groupBy("part").agg(F.max("node").alias("component"))
    return names.join(most, "part").select("node", "component")


def _coloured(left: DataFrame) -> DataFrame:
    """node, component of a graph, by colouring."""
    nodes, out = durable(left.select(F.col("src").alias("node")).union(left.select("dst")).distinct()), None
    while not nodes.isEmpty():
        colours = _spread(left, nodes.select("node", F.col("node").alias("at")))
        c = lambda n: colours.select(F.col("node").alias(n), F.col("at").alias(f"{n}_at"))
        own = durable(left.join(c("src"), "src").join(c("dst"), "dst").where("src_at = dst_at").select("src", "dst"))
        seen = front = durable(colours.where("node = at"))
        while not front.isEmpty():  # who reaches the colour's own node: go back from it inside the colour
            back = own.join(front.select(F.col("node").alias("dst"), "at"), "dst").select(F.col("src").alias("node"), "at").distinct()
            front = durable(back.join(seen.select("node"), "node", "left_anti"))
            seen = durable(seen.unionByName(front))
        done = seen.select("node", F.col("at").alias("component"))
        out = done if out is None else out.unionByName(done)
        gone = done.select("node")
        nodes = durable(nodes.join(gone, "node", "left_anti"))
        left = durable(left.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti"))
    return out if out is not None else nodes.select("node", F.col("node").alias("component"))


def largest_component(edges: DataFrame) -> DataFrame:
    """Edges with both ends in the largest strong component (of equals the one with the smaller name), their nodes renumbered from 0 in order."""
    parts = durable(strong_components(edges))
    top = parts.groupBy("component").agg(F.count(F.lit(1)).alias("n")).agg(F.max(F.struct("n", (-F.col("component")).alias("c"))).alias("b"))
    keep = parts.join(F.broadcast(top.select((-F.col("b.c")).alias("component"))), "component").select("node")  # one row
    numbers = keep.withColumn("block", F.floor(F.col("node") / 4096))
    before = numbers.groupBy("block").agg(F.count(F.lit(1)).alias("n"))
    before = before.select("block", (F.sum("n").over(Window.orderBy("block")) - F.col("n")).alias("before"))  # a row for 4096 nodes
    numbers = numbers.join(before, "block").select("node", (F.col("before") + F.row_number().over(Window.partitionBy("block").orderBy("node")) - 1).alias("number"))
    ends = lambda c, n: numbers.select(F.col("node").alias(c), F.col("number").alias(n))
    return edges.join(ends("src", "from_id"), "src").join(ends("dst", "to_id"), "dst")
