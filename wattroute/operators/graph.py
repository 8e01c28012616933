"""From mapped ways to the edges of a road graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattroute.functions import geo


def way_edges(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """src, dst, way_id, length_m: ways cut at their ends and at nodes that several places of ways use, in the directions allowed.

    refs(way_id, pos, node_id, direction): direction 1 along the way, -1 against it, 0 both. nodes(node_id, lat, lon).
    Refs to unknown nodes are skipped; loops and pieces without length go. A node's uses are counted before the join,
    so a node of very many ways is one row there; a way itself has a bounded number of refs.
    """
    uses = refs.groupBy("node_id").agg(F.count(F.lit(1)).alias("uses"))
    w = Window.partitionBy("way_id").orderBy("pos")
    r = refs.join(uses, "node_id").join(nodes.select("node_id", "lat", "lon"), "node_id")
    before = {c: F.lag(c).over(w) for c in ("node_id", "lat", "lon")}
    cut = (F.lag("pos").over(w).isNull() | F.lead("pos").over(w).isNull() | (F.col("uses") >= 2)).cast("int")
    r = r.withColumn("cut", cut).withColumn("piece", F.sum("cut").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    step = geo.haversine_m(before["lat"], before["lon"], F.col("lat"), F.col("lon"))
    r = r.withColumn("step", step).withColumn("from", before["node_id"]).where(F.col("from").isNotNull())
    pieces = r.groupBy("way_id", "piece", "direction").agg(F.min_by("from", "pos").alias("src"), F.max_by("node_id", "pos").alias("dst"), F.sum("step").alias("length_m"))
    pieces = pieces.where("src <> dst and length_m > 0")
    there, back = F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))
    ends = F.when(F.col("direction") == 1, F.array(there)).when(F.col("direction") == -1, F.array(back)).otherwise(F.array(there, back))
    return pieces.select("way_id", "length_m", F.explode(ends).alias("e")).select("e.src", "e.dst", "way_id", "length_m")
