"""Joins with the next or the enclosing rows of the same key, by one sort instead of a range join.

Both sides are stacked and sorted by (key, place); running values carry the neighbour over. Growing frames
only (the backward look sorts in descending order), so a key costs time in proportion to its rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _stack(queries: DataFrame, key: str, place, rows: DataFrame, value: str) -> DataFrame:
    hit = rows.where(F.col(value).isNotNull()).select(key, F.col(value).alias("_x"), F.struct(*rows.columns).alias("_hit"))
    return queries.withColumn("_x", place).withColumn("_asked", F.lit(1)).unionByName(hit, allowMissingColumns=True).fillna(0, ["_asked"])


def next_after(queries: DataFrame, anchors: DataFrame, key: str, at: str, anchor: str, gap: float) -> DataFrame:
    """Each query row with ``next``: its key's first anchor strictly beyond place + gap (null if none)."""
    both = _stack(queries, key, F.col(at) + gap, anchors.select(key, anchor), anchor)
    w = Window.partitionBy(key).orderBy(F.desc("_x"), F.desc("_asked")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("_hit", F.last("_hit", ignorenulls=True).over(w)).where("_asked = 1")
    return found.select(*queries.columns, F.col(f"_hit.{anchor}").alias("next"))


def interpolate(queries: DataFrame, samples: DataFrame, key: str, at: str, x: str, y: str) -> DataFrame:
    """Each query row with ``y`` between the samples around its place; flat outside; null if the key has no sample.

    Of samples at one place the one with the smallest value counts.
    """
    one = samples.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(key, x).agg(F.min(y).alias(y))
    both = _stack(queries, key, F.col(at), one.select(key, x, y), x)
    frame = (Window.unboundedPreceding, Window.currentRow)
    up = Window.partitionBy(key).orderBy("_x", "_asked").rowsBetween(*frame)
    down = Window.partitionBy(key).orderBy(F.desc("_x"), "_asked").rowsBetween(*frame)
    both = both.withColumn("_a", F.last("_hit", ignorenulls=True).over(up)).withColumn("_b", F.last("_hit", ignorenulls=True).over(down)).where("_asked = 1")
    ax, ay, bx, by = F.col(f"_a.{x}"), F.col(f"_a.{y}"), F.col(f"_b.{x}"), F.col(f"_b.{y}")
    between = F.when(bx > ax, ay + (by - ay) * (F.col(at) - ax) / F.nullif(bx - ax, F.lit(0).cast("double"))).otherwise(ay)
    return both.select(*queries.columns, F.coalesce(between, ay, by).alias(y))


def ahead(df: DataFrame, key: str, order: str, place: str, least: int, most: int) -> DataFrame:
    """For each row, the first ``most`` rows of its key that lie more than ``least`` beyond it: (key, order, ahead).

    The rows are numbered along the key; how many lie up to place + least tells where the targets begin, and
    an equi-join on the number fetches them. Every row gives ``most`` pairs at most.
    """
    along = Window.partitionBy(key).orderBy(place, order)
    upto = Window.partitionBy(key).orderBy(place).rangeBetween(Window.unboundedPreceding, least)
    n = df.select(key, order, F.row_number().over(along).alias("_n"), F.count(F.lit(1)).over(upto).cast("int").alias("_skip"))
    wanted = n.select(key, order, F.explode(F.sequence(F.col("_skip") + 1, F.col("_skip") + most)).alias("_n"))
    return wanted.join(n.select(key, "_n", F.col(order).alias("ahead")), [key, "_n"]).drop("_n")
