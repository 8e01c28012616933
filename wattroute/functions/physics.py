"""Energy of a stretch of road and charging power, as Column expressions over doubles."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Physical constants and model parameters.
GRAVITY = 9.80665
ROTATING = 1.04
URBAN_WH_PER_KM = 14.0
CAP_400V_KW = 120.0
REFERENCE_KMH, REFERENCE_C, REFERENCE_M = 110.0, 23.0, 1000.0
HVAC_W = [(-10.0, 3500.0), (0.0, 2000.0), (18.0, 300.0), (24.0, 300.0), (30.0, 1300.0)]
WARM_KW = [(0.0, 115.0), (0.1, 115.0), (0.15, 187.0), (0.3, 220.0), (0.5, 225.0), (0.53, 120.0), (0.8, 130.0), (0.85, 120.0), (0.9, 63.0), (0.95, 40.0), (1.0, 12.0)]
COLD_KW = [(0.0, 60.0), (0.1, 90.0), (0.15, 120.0), (0.2, 147.0), (0.3, 147.0), (0.45, 105.0), (0.6, 80.0), (0.8, 55.0), (0.85, 45.0), (0.9, 30.0), (0.95, 15.0), (1.0, 5.0)]


@dataclass(frozen=True)
class Vehicle:
    mass_kg: float
    capacity_kwh: float = 70.0
    drag_area_m2: float = 0.75
    rolling: float = 0.0099
    drive: float = 0.85
    regen: float = 0.65
    aux_w: float = 300.0


TWO_WHEEL, ALL_WHEEL = Vehicle(1985.0), Vehicle(2095.0)


def lerp(x: Column, knots: list[tuple[float, float]]) -> Column:
    """Piecewise linear through the knots, flat outside them."""
    out = F.when(x <= knots[0][0], F.lit(knots[0][1]))
    for (x0, y0), (x1, y1) in zip(knots, knots[1:], strict=False):
        out = out.when(x <= x1, y0 + (x - x0) * ((y1 - y0) / (x1 - x0)))
    return out.otherwise(F.lit(knots[-1][1]))


def air_density(temp_c: Column, altitude_m: Column) -> Column:
    return F.lit(1.225 * 288.15) / (temp_c + 273.15) * F.exp(-altitude_m / 8435.0)


def hvac_w(temp_c: Column) -> Column:
    return lerp(temp_c, HVAC_W)


def cold_drive(temp_c: Column, drive: float) -> Column:
    """Drive efficiency: two per cent less at -10 C and below, nothing less from 5 C on."""
    return (1 - lerp(temp_c, [(-10.0, 0.02), (5.0, 0.0)])) * drive


def edge_energy_wh(
    car: Vehicle, length_m: Column, speed_kmh: Column, ascent_m: Column, descent_m: Column, road_class: Column, temp_c: Column,
    delta_kmh: Column | None = None, altitude_m: Column | None = None, headwind_ms: Column | None = None, k_roll=1.0, k_aero=1.0, k_hvac=1.0,
) -> Column:
    """Wh over one edge at constant speed; ``delta_kmh`` is the change of speed on entering it."""
    delta_kmh, altitude_m, headwind_ms = (F.lit(0.0) if c is None else c for c in (delta_kmh, altitude_m, headwind_ms))
    v, dv = speed_kmh / 3.6, delta_kmh / 3.6
    seconds = F.when(v > 0, length_m / v).otherwise(F.lit(0.0))
    weight, wind = car.mass_kg * GRAVITY, v + headwind_ms
    drag = air_density(temp_c, altitude_m) * wind * wind * length_m * (0.5 * k_aero * car.drag_area_m2)
    pull = length_m * (k_roll * car.rolling * weight) + drag + (2 * v * dv - dv * dv) * (0.5 * car.mass_kg * ROTATING)
    drive = cold_drive(temp_c, car.drive)
    moved = F.when(pull >= 0, pull / drive).otherwise(pull * car.regen)
    climbed = ascent_m * weight / drive - descent_m * (weight * car.regen)
    housed = (hvac_w(temp_c) * k_hvac + car.aux_w) * seconds
    urban = F.when(road_class == 1, length_m * (URBAN_WH_PER_KM / 1000)).otherwise(F.lit(0.0))
    return (moved + climbed + housed) / 3600 + urban


def battery_kw(soc: Column, warmth: Column) -> Column:
    cold = lerp(soc, COLD_KW)
    return cold + F.least(F.greatest(warmth, F.lit(0.0)), F.lit(1.0)) * (lerp(soc, WARM_KW) - cold)


def charge_seconds(car: Vehicle, start: Column, end: Column, charger_kw: Column, warmth: Column, is_400v: bool = False) -> Column:
    """Seconds from one state of charge to another, by the midpoint rule; 0 if there is nothing to charge."""
    limit = F.least(charger_kw, F.lit(CAP_400V_KW)) if is_400v else charger_kw
    span = end - start
    steps = F.least(F.greatest(F.ceil(span * 2000), F.lit(16)), F.lit(2000)).cast("int")
    each = span / steps
    hours = F.aggregate(
        F.sequence(F.lit(0), steps - 1), F.lit(0.0),
        lambda total, i: total + each * car.capacity_kwh / F.least(battery_kw(start + (i + 0.5) * each, warmth), limit),
    )
    return F.when(end > start, hours * 3600).otherwise(F.lit(0.0))
