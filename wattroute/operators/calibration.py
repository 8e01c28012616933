"""Replay of recorded trips through the energy model, and the refit of the model to what they used.

Everything is a window over a trip or an aggregate by trip and vehicle; no trip is collected. A refit is one number for each
vehicle, joined back to its trips.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattroute.functions import geo, physics
from wattroute.operators import catalog, trips

VEHICLES = {"ev_2wd": physics.TWO_WHEEL, "ev_awd": physics.ALL_WHEEL}
NEUTRAL_C, QUALIFYING_M = 15.0, 100_000.0  # fixed values: temperature where none was logged, least distance of a trip that counts for acceptance


def reference_wh_per_km(car: physics.Vehicle, k: float = 1.0) -> Column:
    """Consumption of one kilometre at the reference speed and temperature, all three scalars at ``k``."""
    flat = [F.lit(physics.REFERENCE_M), F.lit(physics.REFERENCE_KMH), F.lit(0.0), F.lit(0.0), F.lit(0), F.lit(physics.REFERENCE_C)]
    return physics.edge_energy_wh(car, *flat, k_roll=k, k_aero=k, k_hvac=k) / (physics.REFERENCE_M / 1000)


def scale_for(car: physics.Vehicle, wh_per_km: Column) -> Column:
    """The one factor of all three scalars at which the reference consumption is ``wh_per_km``: energy is affine in it."""
    none, whole = reference_wh_per_km(car, 0.0), reference_wh_per_km(car)
    return F.when(whole != none, (wh_per_km - none) / (whole - none)).otherwise(F.lit(1.0))


def _by_vehicle(column, what) -> Column:
    out = F.lit(None).cast("double")
    for name, car in VEHICLES.items():
        out = F.when(column == name, what(car)).otherwise(out)
    return out


def replay(fixes: DataFrame, runs: DataFrame) -> DataFrame:
    """run columns (trip_id, vehicle, temp_c, k) with distance_m and predicted_wh of the trip under scalars ``k``.

    fixes(trip_id, seq, t_s, lat, lon, speed_mps, alt_m). Pairs whose time does not advance are left out, and the speed before a pair is that of
    the last pair that counted (at first 0); two logged speeds go before it. Climb is taken with hysteresis over the whole trip:
    its energy does not depend on where it falls.
    """
    w = Window.partitionBy("trip_id").orderBy("seq")
    before = {c: F.lag(c).over(w) for c in ("t_s", "lat", "lon", "speed_mps", "alt_m", "seq")}
    s = fixes.select(
        "trip_id", "seq", "alt_m", F.lit(True).alias("fix"), before["seq"].isNull().alias("first"), (F.col("t_s") - before["t_s"] > 0).alias("moved"),
        geo.haversine_m(before["lat"], before["lon"], F.col("lat"), F.col("lon")).alias("length_m"), (F.col("t_s") - before["t_s"]).alias("dt"),
        ((F.col("speed_mps") - before["speed_mps"]) * 3.6).alias("logged"), F.coalesce(before["alt_m"], F.lit(0.0)).alias("from_alt"),
    )
    climbs = trips.climb(s.where("first or moved").select("trip_id", "seq", "alt_m"))
    pairs = s.where("moved").withColumn("kmh", F.col("length_m") / F.col("dt") * 3.6)
    last = F.coalesce(F.lag("kmh").over(w), F.lit(0.0))
    pairs = pairs.withColumn("delta", F.coalesce("logged", F.col("kmh") - last)).join(runs, "trip_id")
    k = F.col("k")

    def wh(car: physics.Vehicle) -> Column:
        return physics.edge_energy_wh(car, F.col("length_m"), F.col("kmh"), F.lit(0.0), F.lit(0.0), F.lit(0), F.col("temp_c"), F.col("delta"), F.col("from_alt"), None, k, k, k)

    keys = runs.columns
    flat = pairs.groupBy(*keys).agg(F.sum("length_m").alias("distance_m"), F.sum(_by_vehicle(F.col("vehicle"), wh)).alias("flat_wh"))

    def lifted(car: physics.Vehicle) -> Column:
        weight = car.mass_kg * physics.GRAVITY
        return (F.col("ascent_m") * weight / physics.cold_drive(F.col("temp_c"), car.drive) - F.col("descent_m") * (weight * car.regen)) / 3600

    out = runs.join(flat.select("trip_id", "vehicle", "distance_m", "flat_wh"), ["trip_id", "vehicle"], "left").join(climbs, "trip_id", "left")
    got = F.coalesce(F.col("flat_wh") + _by_vehicle(F.col("vehicle"), lifted), F.lit(0.0))
    return out.select(*keys, F.coalesce("distance_m", F.lit(0.0)).alias("distance_m"), got.alias("predicted_wh"))


def eligible(trip_rows: DataFrame, fixes: DataFrame) -> DataFrame:
    """Every trip for every vehicle asked for (requested): its energy and replay, or the first reason why it does not count."""
    asked = F.explode(F.array(*[F.lit(v) for v in VEHICLES])).alias("requested")
    counts = fixes.groupBy("trip_id").agg(F.count(F.lit(1)).alias("samples"))
    rows = trip_rows.select("*", asked).join(catalog.trip_energy(trip_rows), "trip_id").join(counts, "trip_id", "left")
    runs = trip_rows.select("trip_id", "vehicle", F.coalesce("ambient_temp_c", F.lit(NEUTRAL_C)).alias("temp_c"), F.lit(1.0).alias("k"))
    rows = rows.join(replay(fixes, runs).select("trip_id", "distance_m", "predicted_wh"), "trip_id")
    other = F.when(F.col("vehicle") != F.col("requested"), F.concat(F.lit("vehicle mismatch: trip log is for "), F.col("vehicle"), F.lit(", requested "), F.col("requested")))
    few = F.when(F.coalesce("samples", F.lit(0)) < 2, "fewer than 2 samples")
    none = F.when(F.col("predicted_wh") <= 0, "predicted energy is not positive")
    return rows.withColumn("excluded_reason", F.coalesce(other, few, "reason", none)).drop("reason", "samples")


def calibrate(trip_rows: DataFrame, fixes: DataFrame, least_m: float = QUALIFYING_M) -> tuple[DataFrame, DataFrame]:
    """(one row a trip and vehicle, one row a vehicle): ratios of actual to predicted energy, their weighted median, the refit, and the error after it."""
    rows = eligible(trip_rows, fixes)
    used = rows.where("excluded_reason is null").withColumn("ratio", F.col("actual_wh") / F.col("predicted_wh"))
    median = trips.weighted_median(used, ["requested"], "ratio", "predicted_wh").withColumnRenamed("weighted_median", "median_ratio")
    reference = _by_vehicle(F.col("requested"), reference_wh_per_km)
    fits = median.withColumn("reference_wh_per_km", reference * F.col("median_ratio"))
    fits = fits.withColumn("k", _by_vehicle(F.col("requested"), lambda car: scale_for(car, F.col("reference_wh_per_km"))))
    runs = used.join(fits, "requested").select("trip_id", "vehicle", F.coalesce("ambient_temp_c", F.lit(NEUTRAL_C)).alias("temp_c"), "k")
    again = replay(fixes, runs).select("trip_id", F.col("predicted_wh").alias("refit_wh"))
    capacity = _by_vehicle(F.col("requested"), lambda car: F.lit(car.capacity_kwh * 1000))
    pct = lambda end: F.coalesce(f"{end}_display_soc_pct", F.col(f"{end}_soc_pct").cast("double"))
    error = F.abs(pct("start") - F.col("refit_wh") / capacity * 100 - pct("end"))
    used = used.join(again, "trip_id").withColumn("error_points", error).withColumn("qualifying", F.col("distance_m") >= least_m)
    ok = trips.acceptance(used.where("qualifying").select(F.col("requested").alias("vehicle"), "start_unix", "trip_id", F.col("error_points").alias("error")))
    ok = ok.select(F.col("vehicle").alias("requested"), "accepted", F.col("mean_error").alias("mae_points"), F.col("max_error").alias("max_error_points"))
    summary = fits.drop("k").join(ok, "requested", "left").withColumn("accepted", F.coalesce("accepted", F.lit(False)))
    shown = ["requested", "trip_id", "start_unix", "distance_m", "actual_wh", "predicted_wh", "ratio", "qualifying", "error_points", "measured", "excluded_reason"]
    nothing = rows.where("excluded_reason is not null").select("requested", "trip_id", "start_unix", *[F.lit(0.0).alias(c) for c in ("distance_m", "actual_wh", "predicted_wh", "ratio")], F.lit(False).alias("qualifying"), F.lit(None).cast("double").alias("error_points"), F.lit(False).alias("measured"), "excluded_reason")
    return used.select(*shown).unionByName(nothing), summary


def charge_table(powers: DataFrame, car: physics.Vehicle, warmth: float, step: float = 0.005) -> DataFrame:
    """power_kw, k, cum_s: seconds from empty to k steps, for each distinct power; a table of 1 / step + 1 rows a power."""
    n = round(1 / step)
    rows = powers.select("power_kw").where("power_kw is not null").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n))))
    piece = F.when(F.col("k") > 0, physics.charge_seconds(car, (F.col("k") - 1) * step, F.col("k") * step, F.col("power_kw"), F.lit(warmth))).otherwise(0.0)
    return rows.select("power_kw", "k", F.sum(piece).over(Window.partitionBy("power_kw").orderBy("k")).alias("cum_s"))


def charge_seconds(asks: DataFrame, table: DataFrame, step: float = 0.005) -> DataFrame:
    """asks (power_kw, from_soc, to_soc, ...) with charge_s read off the table between its knots; nothing to charge takes no time."""
    n = round(1 / step)
    knots = table.groupBy("power_kw").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "cum_s"))), lambda x: x["cum_s"]).alias("t"))

    def at(soc: str) -> Column:
        x = F.least(F.greatest(F.col(soc), F.lit(0.0)), F.lit(1.0)) / step
        k = F.least(F.floor(x), F.lit(n - 1)).cast("int")
        low, high = F.get("t", k), F.get("t", k + 1)
        return low + (x - k) * (high - low)

    return asks.join(knots, "power_kw").withColumn("charge_s", F.greatest(at("to_soc") - at("from_soc"), F.lit(0.0))).drop("t")
