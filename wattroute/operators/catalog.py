"""Feeds, catalogues and their rules: each rule gives rows that violate it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FAST_KW = 50.0  # fixed value: least power of a connector that counts
_PLUG = "standard:string,max_electric_power:double,max_voltage:double,max_amperage:double"
LOCATION = f"id string, name string, coordinates struct<latitude:string,longitude:string>, evses array<struct<connectors:array<struct<{_PLUG}>>>>"


def parse_locations(feed: DataFrame, body: str, source: str) -> DataFrame:
    """One row for each location of a JSON text that has a combined plug of at least 50 kW; bad texts and bad coordinates go."""
    at = feed.select(F.from_json(body, LOCATION).alias("x")).select("x.*")
    plugs = F.transform(
        F.flatten(F.coalesce(F.transform("evses", lambda e: F.coalesce(e["connectors"], F.array())), F.array())),
        lambda c: F.struct(
            F.upper(c["standard"]).contains("COMBO").alias("combined"),
            (F.when(c["max_electric_power"] > 0, c["max_electric_power"]).otherwise(F.coalesce(c["max_voltage"], F.lit(0.0)) * F.coalesce(c["max_amperage"], F.lit(0.0))) / 1000).alias("kw"),
        ),
    )
    lat, lon = (F.col(f"coordinates.{c}").try_cast("double") for c in ("latitude", "longitude"))
    out = at.select(F.concat(F.lit(source + ":"), "id").alias("id"), "name", lat.alias("lat"), lon.alias("lon"), plugs.alias("plugs"))
    best = F.array_max(F.transform(F.filter("plugs", lambda p: p["combined"] & (p["kw"] >= FAST_KW)), lambda p: p["kw"]))
    return out.withColumn("max_power_kw", best).where("max_power_kw is not null and lat is not null and lon is not null")


def merge_catalog(old: DataFrame, new: DataFrame, key: str = "name") -> DataFrame:
    """Upsert by key: the new row where there is one, with what happened to it."""
    o, n = old.select(key, F.col("sha256").alias("was")), new.select(key, F.col("sha256").alias("now"))
    state = F.when(F.col("now").isNull(), "kept").when(F.col("was").isNull(), "added").when(F.col("was") == F.col("now"), "same").otherwise("changed")
    return o.join(n, key, "full_outer").select(key, F.coalesce("now", "was").alias("sha256"), state.alias("state"))


def violations(df: DataFrame, keys: list[str], rules: dict[str, Column]) -> DataFrame:
    """keys and rule for each rule that a row breaks (a rule states what is wrong); one pass over the rows."""
    broken = F.array_compact(F.array(*[F.when(wrong, F.lit(name)) for name, wrong in rules.items()]))
    return df.select(*keys, F.explode(broken).alias("rule"))


def catalog_rules(df: DataFrame, keys: list[str]) -> DataFrame:
    return violations(df, keys, {"epoch": F.coalesce(F.col("epoch"), F.lit(0)) == 0, "sha256": ~F.coalesce(F.col("sha256").rlike("^[0-9a-f]{64}$"), F.lit(False))})


def graph_rules(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges that are loops, have no length or speed, or end at nodes that are not there."""
    local = violations(edges, ["src", "dst"], {"loop": F.col("src") == F.col("dst"), "length": ~(F.col("length_m") > 0), "speed": ~(F.col("speed_kmh") > 0)})
    gone = [edges.join(nodes.select(F.col("node_id").alias(end)), end, "left_anti").select("src", "dst", F.lit(f"no {end}").alias("rule")) for end in ("src", "dst")]
    return reduce(DataFrame.unionByName, gone, local)


def trip_energy(trips: DataFrame, capacity_kwh: float = 70.0) -> DataFrame:
    """Energy that a trip used: from the counters, else the displayed charge, else the dashboard's; or why it has none."""
    c = F.col
    put, took = c("end_charge_kwh") - c("start_charge_kwh"), c("end_discharge_kwh") - c("start_discharge_kwh")
    counted, shown = (put >= 0) & (took >= 0), c("start_display_soc_pct") > c("end_display_soc_pct")
    fell = c("start_soc_pct") > c("end_soc_pct")
    wh = lambda pct: pct / 100 * (capacity_kwh * 1000)
    used = F.when(counted, F.when(took > put, (took - put) * 1000)).when(shown, wh(c("start_display_soc_pct") - c("end_display_soc_pct"))).when(fell, wh(c("start_soc_pct") - c("end_soc_pct")))
    why = F.when(counted & (took <= put), "no net discharge (measured)").when(~F.coalesce(counted, F.lit(False)) & ~F.coalesce(shown, F.lit(False)) & ~fell, "no net discharge")
    return trips.select("trip_id", used.alias("actual_wh"), F.when(used.isNotNull(), F.coalesce(counted, F.lit(False))).alias("measured"), why.alias("reason"))
