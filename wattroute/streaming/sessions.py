"""State kept for each adapter session: lines out of arbitrary chunks, payloads out of frames."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROMPT = ">"  # fixed value: the adapter is ready


def split_lines(rest: str, chunk: str) -> tuple[list[str], str]:
    """Finished lines and the open rest. CR and LF end a line, a prompt ends it and is a line of its own; empty lines give none."""
    parts = re.split("([\r\n>])", rest + chunk)
    done = [x for text, end in zip(parts[::2], parts[1::2], strict=False) for x in (text, end) if x and x not in "\r\n"]
    return done, parts[-1]


def lines(chunks: DataFrame, at: str | None = None, quiet_s: int = 600) -> DataFrame:
    """Stream of (session, seq, chunk) to (session, line); the open line of each session is its state.

    Chunks of a micro-batch are put in order of seq; later batches are taken to follow earlier ones. A null chunk is empty.
    With a time column ``at`` a session ends once the watermark is ``quiet_s`` past its last chunk: its open line is
    dropped with its state. Without one, state is kept for as long as the stream runs.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        got = pd.concat(list(frames)).sort_values("seq")
        done, rest = split_lines(state.get[0] if state.exists else "", "".join(got["chunk"].fillna("")))
        state.update((rest,))
        if at:
            state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), int(got[at].max().timestamp() * 1000)) + quiet_s * 1000)
        yield pd.DataFrame({"session": [key[0]] * len(done), "line": pd.Series(done, dtype=object)})

    timed = chunks.withWatermark(at, f"{quiet_s} seconds") if at else chunks
    return timed.groupBy("session").applyInPandasWithState(run, "session bigint, line string", "rest string", "append", "EventTimeTimeout" if at else "NoTimeout")


def payloads(frames: DataFrame) -> DataFrame:
    """Table of (session, request, seq, frame) to (session, request, payload, problem), in hex; a request has few frames (4,095 bytes at most).

    A frame's first digit tells its kind: 0 whole payload, 1 first of several, 2 the next one, numbered modulo 16. A new first frame discards
    what was pending; a wrong number drops it. The frames of a request are folded in order in the JVM.
    """
    number = lambda digits: F.coalesce(F.conv(digits, 16, 10).cast("int"), F.lit(0))
    nothing = F.array().cast("array<struct<payload:string,problem:string>>")
    start = F.struct(F.lit("").alias("held"), F.lit(0).alias("want"), F.lit(0).alias("number"), nothing.alias("out"))

    def step(state: Column, frame: Column) -> Column:
        kind, whole, length = F.substring(frame, 1, 1), F.substring(frame, 3, 1 << 20), number(F.substring(frame, 2, 1)) * 2
        fits = (length > 0) & (length <= F.length(whole))
        held, want = F.concat(state["held"], whole), state["want"]
        follows = (want > 0) & (number(F.substring(frame, 2, 1)) == state["number"] % 16)
        full = F.length(held) >= want
        said = lambda payload, problem: F.concat(state["out"], F.array(F.struct(payload.cast("string").alias("payload"), problem.cast("string").alias("problem"))))
        none = F.lit(None)
        made = lambda h, w, n, out: F.struct(h.alias("held"), w.alias("want"), n.alias("number"), out.alias("out"))
        empty, zero = F.lit(""), F.lit(0)
        whole_one = made(state["held"], want, state["number"], F.when(fits, said(F.left(whole, length), none)).otherwise(said(none, F.lit("length"))))
        first = made(F.substring(frame, 5, 1 << 20), number(F.substring(frame, 2, 3)) * 2, F.lit(1), state["out"])
        going_on = F.when(full, made(empty, zero, state["number"] + 1, said(F.left(held, want), none))).otherwise(made(held, want, state["number"] + 1, state["out"]))
        lost = made(empty, zero, state["number"], said(none, F.when(want > 0, F.lit("sequence")).otherwise(F.lit("unexpected"))))
        odd = made(state["held"], want, state["number"], said(none, F.lit("kind")))
        return F.when(kind == "0", whole_one).when(kind == "1", first).when((kind == "2") & follows, going_on).when(kind == "2", lost).otherwise(odd)

    rows = frames.where("frame is not null").groupBy("session", "request").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "frame"))), lambda x: x["frame"]).alias("frames"))
    folded = rows.withColumn("out", F.aggregate("frames", start, step, lambda s: s["out"]))
    return folded.select("session", "request", F.inline("out"))
