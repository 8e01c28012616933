"""Operators over ordered rows of a key: nearest reading, runs, thinning, smoothing, curves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SMOOTH_M, STEP_M = 75, 2000.0  # fixed values: half width of the median filter, grid of curves and samples


def nearest_in_time(queries: DataFrame, readings: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Each query row with the reading of its key that is nearest in time (the earlier on ties); null if the key has none.

    Both sides are stacked and sorted once by (key, time): two running values replace the range join.
    """
    r = readings.where(F.col(value).isNotNull()).select(F.col(key), F.col(at), F.struct(F.col(at).alias("t"), F.col(value).alias("v")).alias("hit"))
    both = queries.withColumn("asked", F.lit(True)).unionByName(r, allowMissingColumns=True)
    both = both.withColumn("asked", F.coalesce("asked", F.lit(False)))
    so_far = lambda order: F.last("hit", ignorenulls=True).over(Window.partitionBy(key).orderBy(order, "asked").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    before, after = so_far(F.col(at)), so_far(F.desc(at))  # readings of one time come before the queries of that time both ways
    found = both.withColumn("b", before).withColumn("a", after).where("asked")
    late = F.col("b").isNull() | ((F.col("a.t") - F.col(at)) < (F.col(at) - F.col("b.t")))
    return found.select(*queries.columns, F.when(late, F.col("a.v")).otherwise(F.col("b.v")).alias(value))


def quiet_runs(df: DataFrame, key: str, order: list[str], answered: Column, threshold: int = 3) -> DataFrame:
    """Rows at which ``threshold`` requests in a row went unanswered; the count starts anew after each."""
    w = Window.partitionBy(key).orderBy(*order)
    run = df.withColumn("ok", answered).withColumn("run", F.sum(F.col("ok").cast("int")).over(w))
    place = F.row_number().over(Window.partitionBy(key, "run").orderBy(*order))
    return run.where("not ok").withColumn("place", place).where(F.col("place") % threshold == 0).drop("ok", "run")


def islands(df: DataFrame, key: str, order: str, inside: Column, counted: Column) -> DataFrame:
    """Runs of consecutive rows that are inside: first and last row, and how many are counted (at least 1)."""
    w = Window.partitionBy(key).orderBy(order)
    marked = df.select(key, order, inside.alias("inside"), counted.alias("counted"))
    entered = F.col("inside") & ~F.coalesce(F.lag("inside").over(w), F.lit(False))
    runs = marked.withColumn("run", F.sum(entered.cast("int")).over(w)).where("inside")
    return runs.groupBy(key, "run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.greatest(F.sum(F.col("counted").cast("bigint")), F.lit(1).cast("bigint")).alias("exits"))


def _kept(df: DataFrame, key: str, order: str, start: Column, keep: Callable[[Column, Column], Column], mark: Callable[[Column, Column], Column]) -> DataFrame:
    """An ordered fold over the rows of one key (one trip), in the JVM: which row stays depends on ``mark``, what the last that did has left."""
    rest = [c for c in df.columns if c not in (key, order)]
    rows = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *rest))).alias("rows"))
    none = F.filter("rows", lambda r: F.lit(False))

    def step(state: Column, row: Column) -> Column:
        stays = keep(state["mark"], row)
        return F.struct(F.when(stays, mark(state["mark"], row)).otherwise(state["mark"]).alias("mark"), F.concat(state["kept"], F.when(stays, F.array(row)).otherwise(none)).alias("kept"))

    folded = rows.select(key, F.aggregate("rows", F.struct(start.alias("mark"), none.alias("kept")), step, lambda s: s["kept"]).alias("kept"))
    return folded.select(key, F.inline("kept")).select(*df.columns)


def thin_trail(df: DataFrame, key: str, order: str, along: str, level: str, metres: float = 500.0, points: float = 0.5) -> DataFrame:
    """The first row, then each at least ``metres`` or ``points`` away from the last kept."""
    place = lambda row: F.struct(row[along].cast("double").alias("x"), row[level].cast("double").alias("y"))
    nowhere = F.lit(None).cast("struct<x:double,y:double>")
    far = lambda last, row: last.isNull() | (F.abs(row[along] - last["x"]) >= metres) | (F.abs(row[level] - last["y"]) >= points)
    return _kept(df, key, order, nowhere, far, lambda last, row: place(row))


def thin_fixes(df: DataFrame, key: str, order: str, t: str, lat: str = "lat", lon: str = "lon", least_s: float = 0.5) -> DataFrame:
    """Fixes of a recording: none before its start or without a valid place, then each at least ``least_s`` after the last kept."""
    valid = (F.col(t) >= 0) & F.col(lat).between(-90, 90) & F.col(lon).between(-180, 180) & ((F.col(lat) != 0) | (F.col(lon) != 0))
    late = lambda last, row: last.isNull() | (row[t] - last >= least_s)
    return _kept(df.where(valid), key, order, F.lit(None).cast("double"), late, lambda last, row: row[t].cast("double"))


def downsample(df: DataFrame, key: str, order: str, along: str, step: float = STEP_M) -> DataFrame:
    """Rows that reach the next mark, which moves on by exactly one step each time, and the last row."""
    end = F.lead(order).over(Window.partitionBy(key).orderBy(order)).isNull()
    marked = df.withColumn("_end", end)
    reached = lambda mark, row: (row[along] >= mark) | row["_end"]
    return _kept(marked, key, order, F.lit(0.0), reached, lambda mark, row: mark + step).drop("_end")


def smooth_climb(df: DataFrame, key: str, order: str, along: str, height: str, half: int = SMOOTH_M) -> DataFrame:
    """Ascent and descent of the median-filtered height; the ends stay as they are."""
    w = Window.partitionBy(key).orderBy(order)
    near = F.array_sort(F.collect_list(height).over(Window.partitionBy(key).orderBy(along).rangeBetween(-half, half)))
    out = df.withColumn("near", near).withColumn("n", F.size("near"))
    middle = (F.element_at("near", F.floor((F.col("n") + 1) / 2).cast("int")) + F.element_at("near", F.floor(F.col("n") / 2 + 1).cast("int"))) / 2
    ends = F.lag(order).over(w).isNull() | F.lead(order).over(w).isNull()
    out = out.withColumn("smooth", F.when(ends, F.col(height)).otherwise(middle)).withColumn("d", F.col("smooth") - F.lag("smooth").over(w))
    up = lambda c: F.coalesce(F.sum(F.greatest(c, F.lit(0.0))), F.lit(0.0))
    return out.groupBy(key).agg(up(F.coalesce("d", F.lit(0.0))).alias("ascent_m"), up(F.coalesce(-F.col("d"), F.lit(0.0))).alias("descent_m"))


def charge_curve(legs: DataFrame, key: str, start: str, end: str, soc0: str, soc1: str, step: float = STEP_M) -> DataFrame:
    """Points (distance, state of charge): a grid over the plan, half-open for each leg, and each leg's end."""
    first, last = F.ceil(F.col(start) / step), F.ceil(F.col(end) / step) - 1
    grid = F.when(last >= first, F.transform(F.sequence(first, last), lambda k: k * step)).otherwise(F.array().cast("array<double>"))
    at = legs.withColumn("distance_m", F.explode(F.concat(grid, F.array(F.col(end)))))
    share = F.when(F.col(end) > F.col(start), (F.col("distance_m") - F.col(start)) / (F.col(end) - F.col(start))).otherwise(F.lit(1.0))
    return at.select(key, "distance_m", (F.col(soc0) + share * (F.col(soc1) - F.col(soc0))).alias("soc"))
