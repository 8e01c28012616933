"""Recorded trips: segments, climb with hysteresis, weighted medians."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattroute.functions import geo

HYSTERESIS_M = 3.0  # fixed value


def segments(fixes: DataFrame) -> DataFrame:
    """Consecutive fixes of a trip: length, duration and ground speed (null unless time advances)."""
    w = Window.partitionBy("trip_id").orderBy("seq")
    prev = lambda c: F.lag(c).over(w)
    d = geo.haversine_m(prev("lat"), prev("lon"), F.col("lat"), F.col("lon"))
    out = fixes.select("trip_id", "seq", d.alias("length_m"), (F.col("t_s") - prev("t_s")).alias("dt_s")).where("length_m is not null")
    return out.withColumn("mps", F.when(F.col("dt_s") > 0, F.col("length_m") / F.col("dt_s")))


def climb(fixes: DataFrame) -> DataFrame:
    """Ascent and descent of each trip: the reference altitude moves only by a drift of more than 3 m, and then by all of it.

    An ordered fold over a trip's readings, in the JVM; a trip is bounded by one drive.
    """
    ordered = F.array_sort(F.collect_list(F.when(F.col("alt_m").isNotNull(), F.struct("seq", "alt_m"))))
    start = F.struct(F.lit(None).cast("double").alias("ref"), F.lit(0.0).alias("up"), F.lit(0.0).alias("down"))

    def step(state, reading):
        drift = reading["alt_m"] - state["ref"]
        far = F.abs(drift) > HYSTERESIS_M
        return F.struct(
            F.when(state["ref"].isNull() | far, reading["alt_m"]).otherwise(state["ref"]).alias("ref"),
            (state["up"] + F.when(far & (drift > 0), drift).otherwise(0.0)).alias("up"),
            (state["down"] + F.when(far & (drift < 0), -drift).otherwise(0.0)).alias("down"),
        )

    folded = fixes.groupBy("trip_id").agg(ordered.alias("readings")).withColumn("s", F.aggregate("readings", start, step))
    return folded.select("trip_id", F.col("s.up").alias("ascent_m"), F.col("s.down").alias("descent_m"))


def weighted_median(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """First value, in order, whose running weight reaches half the total; null if the total is not positive."""
    summed = df.groupBy(*keys, value).agg(F.sum(weight).alias("w"))
    ordered = Window.partitionBy(*keys).orderBy(value)
    run = summed.withColumn("run", F.sum("w").over(ordered)).withColumn("total", F.sum("w").over(Window.partitionBy(*keys)))
    return run.groupBy(*keys).agg(F.min(F.when((F.col("total") > 0) & (F.col("run") >= F.col("total") / 2), F.col(value))).alias("weighted_median"))


def acceptance(errors: DataFrame, last: int = 10, most: float = 3.0, mean: float = 2.0) -> DataFrame:
    """Whether the last errors (absolute, by start) of each vehicle stay within a largest and a mean one."""
    w = Window.partitionBy("vehicle").orderBy(F.desc("start_unix"), F.desc("trip_id"))
    recent = errors.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= last)
    out = recent.groupBy("vehicle").agg(F.max("error").alias("max_error"), F.avg("error").alias("mean_error"))
    return out.withColumn("accepted", (F.col("max_error") <= most) & (F.col("mean_error") <= mean))
