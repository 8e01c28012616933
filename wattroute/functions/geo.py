"""Geography on a sphere, as Column expressions in degrees and metres."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0  # fixed value: mean radius
DEGREE_M = 111_320.0  # fixed value: metres of one degree in the local plane


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.sin(dlat) * F.sin(dlat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlon) * F.sin(dlon)
    return F.asin(F.sqrt(F.when(a > 1, F.lit(1.0)).otherwise(a))) * (2 * EARTH_M)  # least() would make 1 of a null


def bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing in [0, 360)."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    turn = F.degrees(F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d)))
    return F.pmod(turn + 360, F.lit(360.0))


def signed_turn_deg(turn: Column) -> Column:
    """A turn normalised to (-180, 180]."""
    wrapped = F.pmod(turn, F.lit(360.0))
    return F.when(wrapped > 180, wrapped - 360).otherwise(wrapped)


def flat_distance_sq(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Square of the equirectangular distance in degrees, enough to compare by."""
    dx = (lon2 - lon1) * F.cos(F.radians(lat1))
    return (lat2 - lat1) * (lat2 - lat1) + dx * dx


def in_box(lat: Column, lon: Column, south: float, west: float, north: float, east: float) -> Column:
    return lat.between(south, north) & lon.between(west, east)


def cell(value: Column, size: float) -> Column:
    return F.floor(value / size)
