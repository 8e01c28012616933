"""Attributes of a way from its tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Default speed (km/h) and guidance class of each kind of road, fastest first.
ROADS = [("motorway", 120.0), ("trunk", 100.0), ("primary", 80.0), ("secondary", 70.0), ("tertiary", 60.0), ("unclassified", 50.0), ("residential", 30.0), ("living_street", 20.0)]
LINK = 0.6


def edge_seconds(length_m: Column, speed_kmh: Column) -> Column:
    return length_m.cast("double") / speed_kmh.cast("double") * 3.6


def default_speed_kmh(highway: Column) -> Column:
    """By kind of road, 0.6 times that on a link; null for ways that cars don't use."""
    kind, link = F.regexp_replace(highway, "_link$", ""), highway.endswith("_link")
    speed = F.lit(None).cast("double")
    for name, kmh in ROADS:
        linked = name not in ("unclassified", "residential", "living_street")
        speed = F.when((kind == name) & (~link if not linked else F.lit(True)), F.when(link, F.lit(kmh * LINK)).otherwise(F.lit(kmh))).otherwise(speed)
    return speed


def road_class(highway: Column) -> Column:
    return F.when(highway.isin("residential", "living_street"), 1).otherwise(0)


def max_speed_kmh(maxspeed: Column) -> Column:
    """Leading digits; null for mph, for other text and for null."""
    digits = F.regexp_extract(F.trim(maxspeed), "^([0-9]+)", 1)
    return F.when(maxspeed.contains("mph") | (digits == ""), F.lit(None)).otherwise(digits.try_cast("double"))


def one_way(oneway: Column, junction: Column) -> Column:
    """1 forward only, -1 backward only, 0 both; a roundabout is forward only (a mere circle is not)."""
    return F.when(oneway.isin("yes", "true", "1"), 1).when(oneway == "-1", -1).when(junction == "roundabout", 1).otherwise(0)


def guide_flags(highway: Column, junction: Column) -> Column:
    """Class in bits 0-3 (1 fastest, 0 for other ways), link in bit 4, roundabout or circle in bit 5."""
    kind, out = F.regexp_replace(highway, "_link$", ""), F.lit(0)
    for k, (name, _) in enumerate(ROADS, 1):
        out = F.when(kind == name, k).otherwise(out)
    bit = lambda c, value: F.when(c, value).otherwise(0)
    return out + bit(highway.endswith("_link"), 16) + bit(junction.isin("roundabout", "circular"), 32)


def flag_kind(flags: Column) -> Column:
    """Class of the road, 1 fastest, from its guidance flags."""
    return flags.bitwiseAND(15)


def flag_link(flags: Column) -> Column:
    return flags.bitwiseAND(16) != 0


def flag_round(flags: Column) -> Column:
    return flags.bitwiseAND(32) != 0
