"""The charging-stop search: for many requests at once, the quickest way through a graph of candidate stops.

A label says how a request can stand at a node with a charge in a bucket of 2 %: time, stops, exact charge and the label it came from. Of the
labels of one (node, bucket) the quickest stays, of equally quick ones that with fewer stops. Every leg is driven under each speed
cap, after passing a charger or after charging to one of a few targets.

Legs lead to nodes of a higher ``ord`` only, so the nodes of a request are settled in that order. A request's graph is one row (its candidates are
capped: a few hundred places with at most 101 labels each) and the search one fold over its nodes, so nodes and legs are shuffled once, by request,
and labels never: neither shuffled nor written. Requests share nothing, a partition holds about PLACES_A_PART places, however many there are.

The floors of the charge on arrival are relaxed in turn (RUNGS); a request is searched again only while it has no plan.

Defined cases: a request without a way to its destination has no plan; times are compared by the microsecond and, as the clock of a
round, cut to the millisecond; of equal labels that of the earlier predecessor (time, stops, ord, bucket), leg, cap and smaller target stays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattroute.functions import physics
from wattroute.operators.rounds import durable

# Speed caps, charge targets, least charge, costs of a stop, width of a bucket.
CAPS_KMH = (None, 110.0, 100.0, 90.0)
TARGETS = (0.6, 0.7, 0.8)
LEAST_CHARGE, SPARE = 0.02, 0.05
STOP_S, SHORT_S, RAMP_S = 300.0, 600.0, 300.0
BUCKETS, TABLE_STEP = 50, 0.005
TINY = 1e-9
NOWHERE = float("-inf")

PLACES_A_PART = 2_000  # of a partition of the search; each charger brings its table of 1.6 KB

# src: the place of the node before, -1 at the origin; was: the bucket there; up to target the order in which labels are compared.
LABEL = "struct<bucket:int,us:bigint,stops:int,ms:bigint,before:int,at:int,was:int,leg:bigint,cap:int,target:double,soc:double,time_s:double,depart:double,charge:double,src:int>"
SETTLED = f"struct<label:{LABEL},clock:bigint,from_s:double>"
HOP = "struct<leg:bigint,cap:int,depart:double,charge:double,arrival:double>"
PLAN = f"struct<rung:int,hops:array<{HOP}>>"


def charge_times(kinds: DataFrame, car: physics.Vehicle) -> DataFrame:
    """power_kw, warmth, t: seconds from empty to each half per cent, for each distinct kind of charger and battery."""
    n = round(1 / TABLE_STEP)
    rows = kinds.select("power_kw", "warmth").where("power_kw is not null").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n))))
    piece = F.when(F.col("k") > 0, physics.charge_seconds(car, (F.col("k") - 1) * TABLE_STEP, F.col("k") * TABLE_STEP, F.col("power_kw"), F.col("warmth"))).otherwise(0.0)
    total = F.sum(piece).over(Window.partitionBy("power_kw", "warmth").orderBy("k"))
    summed = rows.select("power_kw", "warmth", "k", total.alias("s")).groupBy("power_kw", "warmth")
    return summed.agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "s"))), lambda x: x["s"]).alias("t"))


def read_off(t: Column, soc: Column) -> Column:
    """Seconds from empty to ``soc``, between the knots of a table of charge_times()."""
    x = F.least(F.greatest(soc, F.lit(0.0)), F.lit(1.0)) / TABLE_STEP
    k = F.least(F.floor(x), F.lit(round(1 / TABLE_STEP) - 1)).cast("int")
    return F.get(t, k) + (x - k) * (F.get(t, k + 1) - F.get(t, k))


def bucket_of(soc: Column) -> Column:
    return F.floor(soc * BUCKETS).cast("int")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _nothing(of: str) -> Column:
    return F.array().cast(f"array<{of}>")


def _arriving(leg: Column, src: Column, labels: Column, floor: Column, rung: Column, battery_wh: float) -> Column:
    """The labels that one leg makes of the settled labels at its start: of each charge target the best, and all that pass."""
    most, free, pinned = F.col("charger_max"), rung["free"], F.when(~rung["free"], src["override_soc"])
    allowed = lambda x: pinned.isNull() | (x + TINY >= pinned)

    def made(was: Column, e: Column, depart: Column, charge: Column | None) -> Column:
        arrival = depart - e["use"]
        arrival = F.when(free, F.greatest(arrival, F.lit(-1.0))).otherwise(arrival)
        old, halt = was["label"], F.lit(0.0)
        if charge is not None:
            halt = charge + F.col("bias") * STOP_S + F.when(charge < SHORT_S, (SHORT_S - charge) / SHORT_S * RAMP_S).otherwise(0.0)
        time = was["clock"] / 1000 + halt + e["drive"]
        return F.struct(
            bucket_of(arrival).alias("bucket"), F.round(time * 1e6).cast("bigint").alias("us"), (old["stops"] + int(charge is not None)).alias("stops"), was["clock"].alias("ms"), old["stops"].alias("before"),
            src["ord"].alias("at"), old["bucket"].alias("was"), leg["leg"].alias("leg"), e["cap"].alias("cap"), (F.lit(-2.0) if charge is None else depart).alias("target"),
            arrival.alias("soc"), time.alias("time_s"), depart.alias("depart"), (F.lit(0.0) if charge is None else charge).alias("charge"), leg["from"].alias("src"),
        ).cast(LABEL)

    def targets(e: Column) -> Column:
        """The charges with which one cap can begin, whatever the label; each leads to one bucket."""
        need = F.least(e["use"] + floor + SPARE, most)
        wanted = F.sort_array(F.array(*[F.lit(x) for x in TARGETS], most, need))
        useful = lambda t: F.filter(t, lambda x, i: ((i == 0) | (x - F.get(t, i - 1) >= 1e-6)) & (x <= most + TINY) & allowed(x) & (x - e["use"] + TINY >= floor))
        return F.transform(_let(wanted, useful), lambda x: F.struct(e["cap"].alias("cap"), e["use"].alias("use"), e["drive"].alias("drive"), x.alias("to"), read_off(src["t"], x).alias("upto")))

    def quickest(o: Column) -> Column:
        below = F.filter(labels, lambda was: o["to"] > was["label"]["soc"] + (LEAST_CHARGE - TINY))
        return F.array_min(F.transform(below, lambda was: made(was, o, o["to"], F.greatest(o["upto"] - was["from_s"], F.lit(0.0)))))

    def ways(caps: Column) -> Column:
        charged = F.filter(F.transform(F.flatten(F.transform(caps, targets)), quickest), lambda x: x.isNotNull())
        enough = lambda was: F.filter(caps, lambda e: was["label"]["soc"] - e["use"] + TINY >= floor)
        passed = F.flatten(F.transform(F.filter(labels, lambda was: allowed(was["label"]["soc"])), lambda was: F.transform(enough(was), lambda e: made(was, e, was["label"]["soc"], None))))
        return F.concat(F.when(src["power_kw"].isNotNull() & ~rung["drive_only"], charged).otherwise(_nothing(LABEL)), passed)

    return _let(F.transform(leg["evals"], lambda e, cap: F.struct(cap.alias("cap"), (e["energy_wh"] / battery_wh).alias("use"), e["time_s"].alias("drive"))), ways)


def _settled(rung: Column, battery_wh: float) -> Column:
    """The labels that stay at each node of a request, in the order of ``nodes``."""

    def settle(done: Column, node: Column) -> Column:
        origin = F.struct(bucket_of(F.col("depart_soc")), F.lit(0), F.lit(0), F.lit(0), F.lit(0), F.lit(0), F.lit(0), F.lit(0), F.lit(0), F.lit(0.0), F.col("depart_soc"), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(-1)).cast(LABEL)
        wanted = F.when(node["kind"] == "dest", F.col("arrival_min") * rung["d"]).when(node["kind"] == "waypoint", 0.0).otherwise(F.col("charger_min") * rung["c"])
        floor = F.when(rung["free"], NOWHERE).otherwise(wanted)
        here = F.filter("legs", lambda leg: leg["to"] == F.size(done))
        came = F.flatten(F.transform(here, lambda leg: _arriving(leg, F.get("nodes", leg["from"]), F.get(done, leg["from"]), floor, rung, battery_wh)))
        every = F.sort_array(F.concat(F.when(node["kind"] == "origin", F.array(origin)).otherwise(_nothing(LABEL)), came))
        best = _let(every, lambda all_: F.filter(all_, lambda x, i: (i == 0) | (x["bucket"] != F.get(all_, i - 1)["bucket"])))
        kept = F.transform(best, lambda x: F.struct(x.alias("label"), (x["time_s"] * 1000).cast("bigint").alias("clock"), read_off(node["t"], x["soc"]).alias("from_s")).cast(SETTLED))
        return F.concat(done, F.array(kept))

    return F.aggregate("nodes", _nothing(f"array<{SETTLED}>"), settle)


def _plan(rung: Column, battery_wh: float) -> Column:
    """rung and hops of the first label to reach a destination, or null."""

    def traced(done: Column) -> Column:
        arrived = lambda at: F.transform(F.get(done, at), lambda x: F.struct(x["clock"].alias("ms"), x["label"]["stops"].alias("stops"), x["label"]["bucket"].alias("bucket"), at.alias("at")))
        none = _nothing("struct<ms:bigint,stops:int,bucket:int,at:int>")
        ends = F.flatten(F.transform("nodes", lambda n, at: F.when(n["kind"] == "dest", arrived(at)).otherwise(none)))
        acc = f"struct<at:int,bucket:int,hops:array<{HOP}>>"

        def back(acc_: Column, _: Column) -> Column:
            x = lambda s: s["label"]
            hop = lambda s: F.struct(x(s)["leg"], x(s)["cap"], x(s)["depart"], x(s)["charge"], x(s)["soc"]).cast(HOP)
            further = lambda s: F.when(x(s)["src"] < 0, acc_).otherwise(F.struct(x(s)["src"], x(s)["was"], F.concat(F.array(hop(s)), acc_["hops"])).cast(acc))
            return _let(F.get(F.filter(F.get(done, acc_["at"]), lambda s: x(s)["bucket"] == acc_["bucket"]), F.lit(0)), further)

        whole = lambda end: F.when(end.isNotNull(), F.struct(rung["rung"], F.aggregate("nodes", F.struct(end["at"], end["bucket"], _nothing(HOP)).cast(acc), back, lambda a: a["hops"])).cast(PLAN))
        return _let(F.array_min(ends), whole)

    return _let(_settled(rung, battery_wh), traced)


# Rungs: floors at chargers and at the destination as wanted or 0, whether the charge may fall below zero, whether charging is off.
RUNGS = [(1, 1, False, False), (0, 1, False, False), (0, 0, False, False), (0, 0, True, False)]
ALTERNATIVE = [(0, 0, False, True), (0, 0, True, True)]


def solve(requests: DataFrame, nodes: DataFrame, legs: DataFrame, car: physics.Vehicle = physics.TWO_WHEEL) -> DataFrame:
    """The legs of each request's plan, and of its stop-free alternative, in order.

    requests(request, depart_soc, arrival_min, charger_min, charger_max, bias, warmth, offer: whether an alternative is wanted);
    nodes(request, node, ord, kind: origin, charger, waypoint or dest, power_kw: null if nothing charges there, override_soc);
    legs(request, leg, src, dst, dist_m, evals: time_s and energy_wh under each of CAPS_KMH). Numbers of legs are unique in a request.

    Returns request, alternative, rung (of RUNGS; 3: it runs out of charge), seq, leg, src, dst, drive_s, dist_m, energy_wh, cap_kmh, depart_soc,
    arrival_soc, charge_s (before the leg), flag: below_wanted or reaches_zero.
    """
    battery = car.capacity_kwh * 1000
    asked = durable(requests.select("request", *[F.col(c).cast("double").alias(c) for c in ("depart_soc", "arrival_min", "charger_min", "charger_max", "bias", "warmth")], "offer"))
    place = durable(nodes.select("request", "node", F.col("ord").cast("int").alias("ord"), "kind", F.col("power_kw").cast("double").alias("power_kw"), F.col("override_soc").cast("double").alias("override_soc")))
    parts = max(1, -(-place.count() // PLACES_A_PART))
    warm = place.repartition(parts, "request").join(asked.repartition(parts, "request").select("request", "warmth"), "request")
    times = durable(charge_times(warm, car))
    times = F.broadcast(times) if times.count() <= 10_000 else times
    placed = warm.join(times, ["power_kw", "warmth"], "left").groupBy("request")
    placed = placed.agg(F.sort_array(F.collect_list(F.struct("ord", "node", "kind", "power_kw", "override_soc", "t"))).alias("nodes"))
    drawn = legs.select("request", "leg", "src", "dst", "dist_m", "evals").repartition(parts, "request").groupBy("request").agg(F.collect_list(F.struct("leg", "src", "dst", "dist_m", "evals")).alias("legs"))

    at = lambda node: (F.array_position("nodes.node", node) - 1).cast("int")
    placed = placed.join(drawn, "request").join(asked.repartition(parts, "request"), "request")
    ends = F.transform("legs", lambda x: F.struct(x["leg"].alias("leg"), at(x["src"]).alias("from"), at(x["dst"]).alias("to"), x["src"].alias("src"), x["dst"].alias("dst"), x["dist_m"].alias("dist_m"), x["evals"].alias("evals")))
    end = lambda x, of: F.get("nodes", x[of])
    rows = placed.withColumn("legs", F.filter(ends, lambda x: (x["from"] >= 0) & (x["to"] >= 0)))
    rows = rows.withColumn("wrong", F.exists("legs", lambda x: end(x, "to")["ord"] <= end(x, "from")["ord"]))
    rows = rows.withColumn("legs", F.filter("legs", lambda x: ~F.col("wrong") & (end(x, "from")["kind"] != "dest")))

    def run(rungs: list[tuple[int, int, bool, bool]], first: int) -> Column:
        """The first rung with a plan."""
        kinds = F.array(*[F.struct(F.lit(first + i).alias("rung"), F.lit(float(c)).alias("c"), F.lit(float(d)).alias("d"), F.lit(n).alias("free"), F.lit(o).alias("drive_only")) for i, (c, d, n, o) in enumerate(rungs)])
        return F.aggregate(kinds, F.lit(None).cast(PLAN), lambda plan, rung: F.coalesce(plan, _plan(rung, battery)))

    rows = rows.withColumn("best", run(RUNGS, 0))
    halts = F.filter("best.hops", lambda h: h["charge"] > 0)
    rows = rows.withColumn("other", F.when(F.col("offer") & (F.size(halts) == 1) & (F.get(halts, F.lit(0))["charge"] < SHORT_S), run(ALTERNATIVE, len(RUNGS))))
    plan = lambda c, other: F.struct(F.lit(other).alias("alternative"), F.col(c)["rung"].alias("rung"), F.transform(F.col(c)["hops"], _driven).alias("hops"))
    found = durable(rows.select("request", "wrong", F.array(plan("best", False), plan("other", True)).alias("plans")))
    if not found.where("wrong").isEmpty():
        raise ValueError("a leg must lead to a node of a higher ord")
    return _legs_of(found)


def _driven(h: Column) -> Column:
    """A hop with what its leg tells, and the charge that was wanted at its end."""
    leg = F.get(F.filter("legs", lambda x: x["leg"] == h["leg"]), F.lit(0))

    def told(x: Column) -> Column:
        kind, e = F.get("nodes", x["to"])["kind"], F.get(x["evals"], h["cap"])
        wanted = F.when(kind == "dest", F.col("arrival_min")).when(kind == "charger", F.col("charger_min")).otherwise(0.0)
        return F.struct(h.alias("h"), x["src"].alias("src"), x["dst"].alias("dst"), e["time_s"].alias("drive_s"), x["dist_m"].alias("dist_m"), e["energy_wh"].alias("energy_wh"), wanted.alias("wanted"))

    return _let(leg, told)


def _legs_of(found: DataFrame) -> DataFrame:
    plans = found.select("request", F.explode("plans").alias("p")).select("request", "p.*").where("rung is not null")
    first = F.array_position(F.transform("hops", lambda x: x["h"]["arrival"] <= TINY), True) - 1
    rows = plans.select("request", "alternative", "rung", first.alias("first"), F.posexplode("hops").alias("seq", "x")).select("request", "alternative", "rung", "first", "seq", "x.*")
    out_of = F.col("rung") == len(RUNGS) - 1
    flag = F.when(out_of & (F.col("seq") == F.col("first")), "reaches_zero").when(~out_of & (F.col("h.arrival") + TINY < F.col("wanted")), "below_wanted")
    caps = F.array(*[F.lit(c).cast("double") for c in CAPS_KMH])
    return rows.select(
        "request", "alternative", "rung", "seq", "h.leg", "src", "dst", "drive_s", "dist_m", "energy_wh", F.get(caps, F.col("h.cap")).alias("cap_kmh"),
        F.col("h.depart").alias("depart_soc"), F.col("h.arrival").alias("arrival_soc"), F.col("h.charge").alias("charge_s"), flag.alias("flag"),
    )


def totals(plan_legs: DataFrame) -> DataFrame:
    """One row for each plan: times, distance, stops and flags."""
    total = [F.sum(c).alias(a) for c, a in (("drive_s", "drive_s"), ("charge_s", "charge_s"), ("dist_m", "dist_m"))]
    got = plan_legs.groupBy("request", "alternative", "rung").agg(
        *total, F.count(F.lit(1)).alias("legs"), F.count_if(F.col("charge_s") > 0).alias("stops"), F.coalesce(F.bool_or(F.col("flag") == "below_wanted"), F.lit(False)).alias("below_wanted")
    )
    return got.withColumn("total_s", F.col("drive_s") + F.col("charge_s")).withColumn("runs_out", F.col("rung") == len(RUNGS) - 1)


def stops(plan_legs: DataFrame, requests: DataFrame) -> DataFrame:
    """request, alternative, stop, node, arrival_soc, depart_soc, charge_s of every charging stop, in order."""
    w = Window.partitionBy("request", "alternative").orderBy("seq")
    rows = plan_legs.join(requests.select("request", F.col("depart_soc").alias("begins")), "request").withColumn("came", F.coalesce(F.lag("arrival_soc").over(w), F.col("begins").cast("double")))
    found = rows.where("charge_s > 0").withColumn("stop", F.row_number().over(w))
    return found.select("request", "alternative", "stop", F.col("src").alias("node"), F.col("came").alias("arrival_soc"), "depart_soc", "charge_s")


def fewer_flags(narrow: DataFrame, wide: DataFrame) -> DataFrame:
    """Of two totals() of each request (the plans themselves, not alternatives) that with fewer flags; of equals the wide one, if it was searched."""
    flags = F.col("below_wanted").cast("int") + F.col("runs_out").cast("int")
    both = narrow.withColumn("corridor", F.lit("narrow")).unionByName(wide.withColumn("corridor", F.lit("wide"))).where("not alternative")
    best = both.groupBy("request").agg(F.min_by(F.struct(*both.columns), F.struct(flags, F.col("corridor") == "narrow")).alias("b"))
    return best.select("b.*")


def widened(narrow: Callable[[DataFrame], DataFrame], wide: Callable[[DataFrame], DataFrame], points: DataFrame) -> DataFrame:
    """totals() of each request: searched in the narrow corridor, and in the wide one only where that plan is flagged. narrow, wide: from points to totals()."""
    first = durable(narrow(points))
    flagged = durable(first.where("not alternative and (below_wanted or runs_out)").select("request"))
    if flagged.isEmpty():
        return fewer_flags(first, first.limit(0))
    return fewer_flags(first, durable(wide(points.join(flagged, "request", "left_semi"))))
