"""Charging-station registers that come as rows per charge point or connector, rolled up to stations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FAST_KW = 50.0  # fixed value: stations need a combo plug of this power


def qualifying(standard, kw):
    """Power of a fast combo plug, else null."""
    return F.when(F.upper(standard).contains("COMBO") & (kw >= FAST_KW), kw)


def register_stations(stations: DataFrame, points: DataFrame, plugs: DataFrame) -> DataFrame:
    """station_id, name, max_power_kw, plugs of the stations with a fast combo plug.

    Keys: stations(station_id, seq, name), points(point_id, station_id), plugs(point_id, standard, kw). Orphan rows are
    skipped; of several rows of a station the last (seq) counts. Plugs are summed per point before the second join, so
    a station with very many plugs is no large group.
    """
    last = stations.groupBy("station_id").agg(F.max_by("name", "seq").alias("name"))
    of_point = plugs.groupBy("point_id").agg(F.max(qualifying(F.col("standard"), F.col("kw"))).alias("kw"), F.count("standard").alias("n"))
    of_station = points.join(of_point, "point_id").groupBy("station_id").agg(F.max("kw").alias("max_power_kw"), F.sum("n").alias("plugs"))
    return last.join(of_station.where("max_power_kw is not null"), "station_id").select("station_id", "name", "max_power_kw", "plugs")


def point_rows_to_stations(rows: DataFrame) -> DataFrame:
    """One row per charge point (seq, shared_id, local_id, name, operator, standard, kw) to stations.

    The station is the shared id or, where that is empty, the local one. Name and operator are those of the first row
    (by seq, then name and operator; an empty operator is null); stations without a fast combo plug go.
    """
    station = F.coalesce(F.nullif(F.trim("shared_id"), F.lit("")), F.col("local_id"))
    first = lambda c: F.min_by(c, F.struct("seq", "name", "operator")).alias(c)
    power = F.max(qualifying(F.col("standard"), F.col("kw"))).alias("max_power_kw")
    got = rows.withColumn("operator", F.coalesce("operator", F.lit(""))).withColumn("station_id", station).groupBy("station_id").agg(first("name"), first("operator"), power, F.count("standard").alias("plugs"))
    return got.where("max_power_kw is not null").withColumn("operator", F.nullif(F.col("operator"), F.lit("")))


def install_plan(catalog: DataFrame, installed: DataFrame, staged: DataFrame) -> DataFrame:
    """Artifacts to fetch (missing or of another sha256) and the bytes still to come beyond what is staged."""
    have = installed.select("kind", F.col("sha256").alias("have"))
    want = catalog.join(have, "kind", "left").where("have is null or have <> sha256").join(staged.select("kind", F.col("bytes").alias("staged")), "kind", "left")
    return want.select("kind", F.greatest(F.lit(0), F.col("bytes") - F.coalesce("staged", F.lit(0))).alias("to_fetch"))
