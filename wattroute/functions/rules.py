"""Small rules of planning, guidance and display as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Metres to a degree of latitude, speech tiers (now within metres; near and far within seconds, each with its least approach).
DEGREE_M = 111_320.0
NOW_M, NEAR_S, FAR_S, NEAR_APPROACH_M, FAR_APPROACH_M = 40.0, 15.0, 70.0, 100.0, 400.0
LIKELY_WH_PER_M, DETOUR = 0.18, 1.3


def clamp(x: Column, low: float, high: float) -> Column:
    """x within the bounds; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def straight_line_ok(distance_m: Column, battery_wh: Column) -> Column:
    """A full battery covers the straight line with the usual detour and consumption."""
    return distance_m * DETOUR * LIKELY_WH_PER_M <= battery_wh


def soc_bucket(soc: Column) -> Column:
    """Bucket of two percent."""
    return F.floor(soc * 50).cast("int")


def clamp_i16(x: Column) -> Column:
    return clamp(F.round(x), -32768.0, 32767.0).cast("int")


def soc_state(soc: Column, age_s: Column, stale_after_s: float = 10.0) -> Column:
    unknown = soc.isNull() | age_s.isNull()
    return F.when(unknown, "hidden").when(age_s >= stale_after_s, "stale").otherwise("fresh")


def margin_colour(soc_pct: Column, floor_pct: Column) -> Column:
    return F.when(soc_pct < floor_pct, "red").when(soc_pct <= floor_pct + 10, "orange").otherwise("green")


def look_ahead_m(speed_mps: Column, turn_m: Column) -> Column:
    """Half a minute of driving within bounds, drawn in to just past the next turn (null: none)."""
    far = clamp(F.greatest(speed_mps, F.lit(0.0)) * 32, 200.0, 1500.0)
    return F.greatest(F.lit(200.0), F.coalesce(F.least(far, turn_m + 100), far))


def zoom(look_ahead: Column) -> Column:
    return 17 - 2.5 * clamp((look_ahead - 200) / 1300, 0.0, 1.0)


def depart_targets(most: Column, need: Column) -> Column:
    """Ascending states of charge to leave with: the usual steps, the most allowed, the need; near-equal ones once."""
    targets = F.array_sort(F.array(F.lit(0.6), F.lit(0.7), F.lit(0.8), most, need))
    return F.filter(targets, lambda x, i: (i == 0) | (x - F.get(targets, i - 1) >= 1e-6))


def class_priority(flags: Column) -> Column:
    """Rank of a road from its guidance flags: motorway 10 down to living street 3, others 2; links lose 1.5."""
    kind = flags.bitwiseAND(15)
    base = F.when(kind.between(1, 8), 11.0 - kind).otherwise(2.0)
    return base - F.when(flags.bitwiseAND(16) != 0, 1.5).otherwise(0.0)


def similar(name_a: Column, ref_a: Column, name_b: Column, ref_b: Column) -> Column:
    """The same named road, or two nameless ones of the same reference; null counts as empty."""
    a, b, ra, rb = (F.coalesce(c, F.lit("")) for c in (name_a, name_b, ref_a, ref_b))
    return ((a != "") & (a == b)) | ((a == "") & (b == "") & (ra == rb))


def speech_tier(distance_m: Column, speed_mps: Column, approach_m: Column) -> Column:
    """3 now, 2 near, 1 far, 0 nothing to say yet."""
    seconds = distance_m / F.greatest(F.coalesce(speed_mps, F.lit(0.0)), F.lit(1.0))
    far = F.when((seconds <= FAR_S) & (approach_m >= FAR_APPROACH_M), 1).otherwise(0)
    return F.when(distance_m <= NOW_M, 3).when((seconds <= NEAR_S) & (approach_m >= NEAR_APPROACH_M), 2).otherwise(far)


def segment_share(lat: Column, lon: Column, lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    """How far along the segment a-b (0 to 1) a point's nearest place lies, on a local plane."""
    across = F.cos(F.radians((lat_a + lat_b) / 2)) * DEGREE_M
    bx, by = (lon_b - lon_a) * across, (lat_b - lat_a) * DEGREE_M
    px, py = (lon - lon_a) * across, (lat - lat_a) * DEGREE_M
    square = bx * bx + by * by
    return F.when(square > 0, clamp((px * bx + py * by) / F.nullif(square, F.lit(0.0)), 0.0, 1.0)).otherwise(0.0)


def segment_distance_m(lat: Column, lon: Column, lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    """Distance of a point from the segment a-b on a local plane; a segment without length is a point."""
    across = F.cos(F.radians((lat_a + lat_b) / 2)) * DEGREE_M
    bx, by = (lon_b - lon_a) * across, (lat_b - lat_a) * DEGREE_M
    px, py = (lon - lon_a) * across, (lat - lat_a) * DEGREE_M
    share = segment_share(lat, lon, lat_a, lon_a, lat_b, lon_b)
    return F.sqrt(F.pow(px - share * bx, F.lit(2.0)) + F.pow(py - share * by, F.lit(2.0)))


def plug_standard(flags: dict[str, Column]) -> Column:
    """First plug of the fixed order whose flag is 't'; null if none is."""
    out = F.lit(None).cast("string")
    for standard, names in reversed(PLUGS):
        hit = F.lit(False)
        for n in names:
            hit = hit | F.coalesce(flags[n] == "t", F.lit(False))
        out = F.when(hit, standard).otherwise(out)
    return out


# Plug standards by falling priority, each with the flag columns of the register that mean it.
PLUGS = [
    ("IEC_62196_T2_COMBO", ["dc_ccs"]), ("CHADEMO", ["dc_chademo"]), ("TESLA", ["dc_tesla"]), ("IEC_62196_T2", ["ac_t2_socket", "ac_t2_cable"]),
    ("IEC_62196_T1", ["ac_t1"]), ("DOMESTIC_SCHUKO", ["ac_schuko"]), ("CEE", ["ac_cee3", "ac_cee5"]),
]


def address_name(street: Column, number: Column, town: Column) -> Column:
    """"street number, town", or the town alone."""
    line = F.trim(F.concat(F.trim(street), F.lit(" "), F.trim(number)))
    return F.when(line == "", town).otherwise(F.concat(line, F.lit(", "), town))
