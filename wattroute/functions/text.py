"""Texts shown or spoken to a driver, and lenient readers of feed fields, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Largest deviation from straight (degrees) of each band of turns.
TURNS = [(20.0, "straight"), (40.0, "slight"), (120.0, ""), (170.0, "sharp")]


def whole(x: Column) -> Column:
    return F.round(x).cast("bigint").cast("string")


def distance_text(metres: Column) -> Column:
    """Tens of metres, tenths of kilometres from 1 km, kilometres from 10 km; less than nothing is nothing."""
    m = F.greatest(metres, F.lit(0.0))
    near = F.concat(whole(F.round(m / 10) * 10), F.lit(" m"))
    return F.when(m >= 10_000, F.concat(whole(m / 1000), F.lit(" km"))).when(m >= 1000, F.format_string("%.1f km", m / 1000)).otherwise(near)


def spoken_distance(metres: Column) -> Column:
    """Fifties of metres (at least one), tenths of kilometres without a closing zero, kilometres from 10 km."""
    m = F.greatest(metres, F.lit(0.0))
    tenths = F.regexp_replace(F.format_string("%.1f", F.round(m / 1000, 1)), r"\.0$", "")
    middle = F.concat(tenths, F.when(tenths == "1", F.lit(" kilometer")).otherwise(F.lit(" kilometers")))
    near = F.concat(whole(F.greatest(F.round(m / 50) * 50, F.lit(50.0))), F.lit(" meters"))
    return F.when(m >= 10_000, F.concat(whole(m / 1000), F.lit(" kilometers"))).when(m >= 1000, middle).otherwise(near)


def duration_text(seconds: Column) -> Column:
    minutes = F.round(seconds / 60).cast("bigint")
    rest = F.concat((minutes % 60).cast("string"), F.lit("m"))
    return F.when(minutes >= 60, F.concat(F.floor(minutes / 60).cast("string"), F.lit("h "), rest)).otherwise(rest)


def turn_modifier(delta_deg: Column) -> Column:
    """Band and side of a signed turn; beyond the last band it is a U-turn."""
    side, out = F.when(delta_deg < 0, "left").otherwise("right"), F.lit("u-turn")
    for most, band in reversed(TURNS):
        text = F.lit(band) if band == "straight" else F.concat(F.lit(f"{band} ".lstrip()), side)
        out = F.when(F.abs(delta_deg) <= most, text).otherwise(out)
    return F.when(delta_deg.isNotNull(), out)


def tile_name(lat: Column, lon: Column) -> Column:
    """Name of the elevation tile (one degree) that holds a point."""
    south, west = F.floor(lat), F.floor(lon)
    ns, ew = F.when(south >= 0, "N").otherwise("S"), F.when(west >= 0, "E").otherwise("W")
    return F.format_string("Copernicus_DSM_COG_10_%s%02d_00_%s%03d_00_DEM", ns, F.abs(south), ew, F.abs(west))


def loose_double(text: Column) -> Column:
    """A number with a decimal point or comma; null for anything else."""
    return F.coalesce(F.trim(text).try_cast("double"), F.replace(F.trim(text), F.lit(","), F.lit(".")).try_cast("double"))


def lon_lat(text: Column) -> Column:
    """Struct (lat, lon) of "[lon, lat]"; null if malformed."""
    part = lambda k: F.regexp_extract(text, r"^\s*\[([^,\]]+),([^,\]]+)\]\s*$", k).try_cast("double")
    return F.when(part(1).isNotNull() & part(2).isNotNull(), F.struct(part(2).alias("lat"), part(1).alias("lon")))


# Maneuvers, and modifiers each with the side it bears to.
MANEUVERS = ["depart", "arrive", "turn", "continue", "off ramp", "on ramp", "fork", "end of road", "roundabout"]
MODIFIERS = [("straight", ""), ("slight left", "left"), ("slight right", "right"), ("left", "left"), ("right", "right"), ("sharp left", "left"), ("sharp right", "right"), ("u-turn", "")]
TURN_TEXTS = {
    "straight": "Continue straight", "slight left": "Turn slightly left", "slight right": "Turn slightly right", "left": "Turn left", "right": "Turn right",
    "sharp left": "Turn sharp left", "sharp right": "Turn sharp right", "u-turn": "Make a U-turn",
}


def _choose(column: Column, texts: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for key, value in texts.items():
        out = F.when(column == key, value).otherwise(out)
    return out


def ordinal(n: Column) -> Column:
    """1st, 2nd, 3rd, 4th; 11th to 13th."""
    teen = (n % 100).between(11, 13)
    return F.concat(n.cast("string"), F.when(~teen & (n % 10 == 1), "st").when(~teen & (n % 10 == 2), "nd").when(~teen & (n % 10 == 3), "rd").otherwise("th"))


def step_text(maneuver: Column, modifier: Column, name: Column, ref: Column, exit_ref: Column, exit_count: Column, arrive: str | None = None) -> Column:
    """What to do at a step, in words; roads by name, else by reference (several joined by slashes)."""
    road = F.when(name != "", name).when(ref != "", F.replace(ref, F.lit(";"), F.lit(" / ")))
    side = _choose(modifier, {m: s for m, s in MODIFIERS})
    with_road = lambda base, lead: F.when(road.isNotNull(), F.concat(base, F.lit(lead), road)).otherwise(base)
    to_side = F.when(side != "", F.concat(F.lit(" on the "), side)).otherwise("")
    turn = _choose(modifier, TURN_TEXTS)
    way = _choose(modifier, {"straight": "", "slight left": " slightly left", "slight right": " slightly right", "left": " left", "right": " right", "sharp left": " sharp left", "sharp right": " sharp right", "u-turn": " left"})
    end = F.when(side == "left", "At the end of the road, turn left").when(side == "right", "At the end of the road, turn right").otherwise("Continue at the end of the road")
    return (
        F.when(maneuver == "depart", "Depart").when(maneuver == "arrive", f"Arrive at {arrive or 'your destination'}")
        .when(maneuver == "turn", F.when(modifier == "u-turn", turn).otherwise(with_road(turn, " onto ")))
        .when(maneuver == "continue", F.when(road.isNull(), "Continue").otherwise(F.concat(F.lit("Continue"), way, F.lit(" on "), road)))
        .when(maneuver == "off ramp", F.when(exit_ref != "", F.concat(F.lit("Take exit "), exit_ref)).otherwise(F.concat(F.lit("Take the exit"), to_side)))
        .when(maneuver == "on ramp", F.concat(F.lit("Take the ramp"), to_side)).when(maneuver == "fork", F.concat(F.lit("Keep "), F.when(side == "", "straight").otherwise(side)))
        .when(maneuver == "end of road", with_road(end, " onto "))
        .when(maneuver == "roundabout", F.when(exit_count.isNotNull(), F.concat(F.lit("At the roundabout, take the "), ordinal(exit_count), F.lit(" exit"))).otherwise("At the roundabout"))
    )
