"""Operators over the steps and junctions of a route."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattroute.functions.rules import similar

SHORT_M, CHAIN_M = 30.0, 400.0  # fixed values: a rename closer to the next step is noise; steps closer than this are spoken together


def drop_short_renames(steps: DataFrame, key: str, along: str, maneuver: str, *then: str) -> DataFrame:
    """Without the "continue" steps that lie under SHORT_M before the next step (by ``along``, then ``then``); a closing one goes as well."""
    w = Window.partitionBy(key).orderBy(along, *then)
    gap = F.coalesce(F.lead(along).over(w) - F.col(along), F.lit(0))
    return steps.withColumn("_gap", gap).where((F.col(maneuver) != "continue") | (F.col("_gap") >= SHORT_M)).drop("_gap")


def chain(steps: DataFrame, key: str, along: str, text: str) -> DataFrame:
    """Column ``then``: the next step's text if it follows within CHAIN_M."""
    w = Window.partitionBy(key).orderBy(along)
    return steps.withColumn("then", F.when(F.lead(along).over(w) - F.col(along) < CHAIN_M, F.lead(text).over(w)))


def renames(edges: DataFrame, key: str, along: str) -> DataFrame:
    """Rows of a route whose road has a name other than the road before."""
    w = Window.partitionBy(key).orderBy(along)
    before = [F.lag(c).over(w) for c in ("name", "ref")]
    marked = edges.withColumn("_first", F.lag(along).over(w).isNull()).withColumn("_same", similar(*before, F.col("name"), F.col("ref")))
    return marked.where(~F.col("_first") & ~F.col("_same") & (F.coalesce("name", F.lit("")) != "")).drop("_first", "_same")


def alternatives(moves: DataFrame, edges: DataFrame) -> DataFrame:
    """For each move a -> b -> c, how many other edges leave b, not counting the way back to a."""
    out = edges.select(F.col("src").alias("b"), F.col("dst").alias("other"))
    counted = (F.col("other") != F.col("c")) & (F.col("other") != F.col("a"))
    return moves.select("a", "b", "c").distinct().join(out, "b", "left").groupBy("a", "b", "c").agg(F.count(F.when(counted, 1)).alias("others"))


def prompts(fixes: DataFrame, key: str, step: str, order: str, tier: str) -> DataFrame:
    """Fixes at which a step reaches a higher speech tier than it had; each tier is spoken once."""
    w = Window.partitionBy(key, step).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.max(tier).over(w), F.lit(0))
    return fixes.withColumn("_before", before).where(F.col(tier) > F.col("_before")).drop("_before")


def overlaps(rules: DataFrame, key: str, rule: str, first: str, length: str) -> DataFrame:
    """Decode rules that start inside an earlier range of their command, or whose length is not 1 to 64 bits."""
    w = Window.partitionBy(key).orderBy(first, rule).rowsBetween(Window.unboundedPreceding, -1)
    bad = rules.where(~F.col(length).between(1, 64)).select(key, rule, F.lit("length").alias("problem"))
    marked = rules.withColumn("_end", F.max(F.col(first) + F.col(length)).over(w))
    return bad.unionByName(marked.where(F.col(first) < F.col("_end")).select(key, rule, F.lit("overlap").alias("problem")))
