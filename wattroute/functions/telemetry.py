"""Adapter lines and payload bits, as Column expressions: no Python runs for a row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The adapter's replies, blanks removed.
REPLIES = [("OK", "ok"), ("?", "question"), ("NODATA", "no data"), ("CANERROR", "can error"), ("STOPPED", "stopped"), ("SEARCHING...", "searching")]


def line_class(line: Column, last_sent: Column | None = None) -> Column:
    """Kind of an adapter line: blank, echo, frame (3 hex digits of id, 1 to 8 bytes), a known reply, or banner."""
    bare = F.replace(line, F.lit(" "), F.lit(""))
    out = F.when(bare == "", "blank")
    if last_sent is not None:
        out = out.when(bare == last_sent, "echo")
    out = out.when(bare.rlike("^[0-9A-Fa-f]{3}([0-9A-Fa-f]{2}){1,8}$"), "frame")
    for text, kind in REPLIES:
        out = out.when(bare == text, kind)
    return out.when(bare.startswith("BUSINIT"), "bus init").when(bare.isNotNull(), "banner")


def bits(payload_hex: Column, skip_bytes: int, first_bit: int, length: int) -> Column:
    """Unsigned value of a run of up to 56 bits, most significant first, counted after ``skip_bytes``; null if the payload is short."""
    if not 1 <= length <= 56:
        raise ValueError("1 to 56 bits")
    low, high = first_bit // 8, (first_bit + length - 1) // 8
    run = F.substring(payload_hex, 2 * (skip_bytes + low) + 1, 2 * (high - low + 1))
    shifted = F.shiftright(F.conv(run, 16, 10).cast("bigint"), 8 * (high + 1) - first_bit - length)
    return F.when(F.length(payload_hex) >= 2 * (skip_bytes + high + 1), shifted.bitwiseAND(F.lit((1 << length) - 1)))


def signed(raw: Column, length: int) -> Column:
    return F.shiftright(F.shiftleft(raw, 64 - length), 64 - length)


def scaled(raw: Column, mul: float = 1.0, div: float = 1.0, add: float = 0.0, low: float | None = None, high: float | None = None) -> Column:
    """raw * mul / div + add, clamped where low < high."""
    value = raw.cast("double") * mul / div + add
    return F.greatest(F.least(value, F.lit(high)), F.lit(low)) if low is not None and high is not None and high > low else value


def single_frame(data_hex: Column) -> Column:
    """One frame of 8 bytes: length, 1 to 7 bytes, zeros; null for other lengths."""
    n = (F.length(data_hex) / 2).cast("int")
    return F.when(n.between(1, 7), F.rpad(F.concat(F.lpad(F.hex(n), 2, "0"), data_hex), 16, "0"))


def chunks(data_hex: Column, most: int) -> Column:
    """A payload cut into pieces of at most ``most`` bytes."""
    n = F.ceil(F.length(data_hex) / (2 * most)).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(data_hex, i * (2 * most) + 1, F.lit(2 * most)))).otherwise(F.array().cast("array<string>"))
