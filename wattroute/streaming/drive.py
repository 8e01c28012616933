"""Progress of drives along their routes: stops and legs that have been passed, leaving the route, arrival, and requests to plan anew.

One step of a drive looks at one fix and a small state; the same step makes the stream and the plain fold. Time is that of the fixes alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass, fields

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# How long before a stop or an end it counts as reached; on the route; off it, and for how long; between displays.
REACHED_M, ON_M, OFF_M, OFF_S, SHOWN_S = 40.0, 10.0, 50.0, 5.0, 1.0


@dataclass
class Drive:
    """What is remembered of a drive. Times are seconds, NaN for none."""

    stops: int = 0
    leg: int = 0
    off_since: float = float("nan")
    replanning: bool = False
    shown: float = float("nan")
    arrived: bool = False
    last_t: float = float("nan")


STATE = ", ".join(f"{f.name} {({'int': 'bigint', 'float': 'double', 'bool': 'boolean'})[f.type]}" for f in fields(Drive))
EVENT = "drive bigint, id bigint, t_s double, event string, along_m double, detail bigint"


def step(state: Drive, fix: tuple[int, float, float, float], stops_m: list[float], leg_ends_m: list[float], total_m: float) -> list[tuple[int, float, str, float, int]]:
    """Events (id, t, event, along, detail) of a fix (id, t, along, off) and the new state, in place.

    stop: its number; leg: the one that begins; arrived; on, off: the fix is within 10 m, or not; replan: 50 m off for five seconds of fix
    time, the number of stops passed; show: the display is due, once a second or when something was passed. After arrival nothing follows.
    """
    i, t, along, off = fix
    out, passed = [], False
    if state.arrived:
        return out
    say = lambda event, detail=0: out.append((i, t, event, along, detail))
    while state.stops < len(stops_m) and along >= stops_m[state.stops] - REACHED_M:
        say("stop", state.stops)
        state.stops, passed = state.stops + 1, True
    while state.leg < len(leg_ends_m) - 1 and along >= leg_ends_m[state.leg] - REACHED_M:
        state.leg, passed = state.leg + 1, True
        say("leg", state.leg)
    if along >= total_m - REACHED_M:
        state.arrived = True
        say("arrived", state.stops)
        return out
    say("on" if off <= ON_M else "off")
    if off >= OFF_M and not state.replanning:
        if state.off_since != state.off_since:
            state.off_since = t
        elif t - state.off_since >= OFF_S:
            state.replanning, state.off_since = True, float("nan")
            say("replan", state.stops)
    if off < OFF_M:
        state.off_since = float("nan")
    if passed or state.shown != state.shown or t - state.shown >= SHOWN_S:
        state.shown = t
        say("show", state.leg)
    return out


def progress(fixes: DataFrame, quiet_s: int = 3600) -> DataFrame:
    """Stream of EVENT rows from a stream of snapped fixes.

    fixes(drive, id, at: timestamp, t_s, along_m, off_m, replanned: the route was exchanged before this fix, stops_m, leg_ends_m, total_m: of the
    route that it was snapped to). Within a micro-batch fixes are put in order of id; later batches are taken to follow earlier ones. A fix that is
    not newer than the last, or has no time or place, is passed over. A drive's state ends on the first batch after its arrival, or ``quiet_s`` past its last fix.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        drive = Drive(*state.get) if state.exists else Drive()
        got, out = pd.concat(list(frames)).dropna(subset=["t_s", "along_m", "off_m"]).sort_values("id"), []
        for r in got.itertuples():
            out += follow(drive, r)
        state.update(tuple(asdict(drive).values()))
        end = state.getCurrentWatermarkMs() + 1 if drive.arrived else (int(got["at"].max().timestamp() * 1000) if len(got) else 0) + quiet_s * 1000
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, end))
        yield pd.DataFrame([(key[0], *e) for e in out], columns=[c.split()[0] for c in EVENT.split(", ")])

    return fixes.withWatermark("at", f"{quiet_s} seconds").groupBy("drive").applyInPandasWithState(run, EVENT, STATE, "append", "EventTimeTimeout")


def follow(drive: Drive, r) -> list[tuple]:
    """The events of a row, if it is newer than the last; a new route begins with its own stops and legs."""
    if drive.last_t == drive.last_t and r.t_s <= drive.last_t:
        return []
    drive.last_t = float(r.t_s)
    if r.replanned:
        drive.stops, drive.leg, drive.replanning = 0, 0, False
    return step(drive, (int(r.id), float(r.t_s), float(r.along_m), float(r.off_m)), list(r.stops_m), list(r.leg_ends_m), float(r.total_m))


def progress_of_table(fixes: DataFrame) -> DataFrame:
    """The same of a table: the drives stream by in order, one state held at a time."""
    names = ["drive", "id", "t_s", "along_m", "off_m", "replanned", "stops_m", "leg_ends_m", "total_m"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, drive = None, Drive()
        for frame in frames:
            out = []
            for r in frame.itertuples():
                if r.drive != of:
                    of, drive = r.drive, Drive()
                out += [(r.drive, *e) for e in follow(drive, r)]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in EVENT.split(", ")])

    rows = fixes.where("drive is not null and t_s is not null and along_m is not null and off_m is not null").select(*names)
    return rows.repartition(F.col("drive")).sortWithinPartitions("drive", "id").mapInPandas(run, EVENT)


def replan_requests(events: DataFrame, fixes: DataFrame, curve: DataFrame) -> DataFrame:
    """drive, id, lat, lon, depart_soc of each replan: from the deviated fix, with the charge that the plan's curve has at that place.

    fixes(drive, id, lat, lon); curve(drive, x, soc). Of a drive with a finished session the caller drops the answer.
    """
    from wattroute.operators import asof

    asked = events.where("event = 'replan'").select("drive", "id", "along_m").join(fixes.select("drive", "id", "lat", "lon"), ["drive", "id"])
    return asof.interpolate(asked, curve, "drive", "along_m", "x", "soc").select("drive", "id", "lat", "lon", F.col("soc").alias("depart_soc"))


def sustained(fixes: DataFrame) -> DataFrame:
    """drive, id of the first fix of each drive that is 50 m off for five seconds: the same by windows alone, before any replan."""
    w = Window.partitionBy("drive").orderBy("id")
    far = fixes.withColumn("far", F.col("off_m") >= OFF_M).withColumn("run", F.sum((~F.col("far")).cast("int")).over(w)).where("far")
    since = F.min("t_s").over(Window.partitionBy("drive", "run"))
    late = far.withColumn("since", since).where(F.col("t_s") - F.col("since") >= OFF_S)
    return late.groupBy("drive").agg(F.min("id").alias("id"))
