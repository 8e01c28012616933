"""Requests to an adapter and what its answers mean, as Column expressions over hex texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NEGATIVE = "7F"  # fixed value: first byte of a refusal


def setup_commands(tx: Column, rx: Column) -> Column:
    """The five commands that turn the adapter to a control unit (headers as integers)."""
    h = lambda c: F.lpad(F.hex(c), 3, "0")
    return F.array(F.concat(F.lit("ATSH"), h(tx)), F.concat(F.lit("ATCRA"), h(rx)), F.concat(F.lit("ATFCSH"), h(tx)), F.lit("ATFCSD300000"), F.lit("ATFCSM1"))


def positive(request_hex: Column) -> Column:
    """First byte of a positive answer: the request's plus 0x40, of eight bits."""
    return F.lpad(F.hex((F.conv(F.substring(request_hex, 1, 2), 16, 10).cast("int") + 0x40) % 256), 2, "0")


def echoes(response_hex: Column, request_hex: Column) -> Column:
    """The answer repeats the request: first byte plus 0x40, the rest as sent."""
    same = F.substring(response_hex, 1, 2) == positive(request_hex)
    n = F.length(request_hex)
    return (n > 0) & (F.length(response_hex) >= n) & same & (F.substr(response_hex, F.lit(3), n - 2) == F.substr(request_hex, F.lit(3), n - 2))


def conclusion(request_hex: Column, response_hex: Column) -> Column:
    """Struct (kind, detail): payload, negative with its code, short negative, or unexpected."""
    head, code = F.substring(response_hex, 1, 2), F.substring(response_hex, 5, 2)
    made = lambda kind, detail: F.struct(F.lit(kind).alias("kind"), detail.alias("detail"))
    refused = F.when(F.length(code) == 2, made("negative", code)).otherwise(made("short negative", response_hex))
    return F.when(head == NEGATIVE, refused).when(head == positive(request_hex), made("payload", response_hex)).otherwise(made("unexpected", response_hex))


def command_relevant(signals: Column, populated_cells: Column) -> Column:
    """A command is asked unless all its signals (array of struct signal, first_index) are cell voltages beyond the pack's cells; one without signals is asked."""
    return (F.size(signals) == 0) | F.exists(signals, lambda s: (s["signal"] != "cell_voltage") | (s["first_index"] <= populated_cells))


def poll_list(commands: DataFrame, key: str) -> DataFrame:
    """key, place, target, uds: the requests in order, a target's session request once before its first command that needs it.

    commands(key, ord, target, uds, session); irrelevant ones already gone.
    """
    w = Window.partitionBy(key, "target", F.col("session").isNotNull()).orderBy("ord")
    opens = F.col("session").isNotNull() & (F.row_number().over(w) == 1)
    each = commands.withColumn("_opens", opens).select(key, "ord", "target", F.posexplode(F.when(F.col("_opens"), F.array("session", "uds")).otherwise(F.array("uds"))).alias("sub", "uds"))
    return each.select(key, (F.row_number().over(Window.partitionBy(key).orderBy("ord", "sub")) - 1).alias("place"), "target", "uds")


def first_command(payloads: DataFrame, commands: DataFrame) -> DataFrame:
    """Each payload (id, target, payload_hex) with the first command (ord) of its target whose request it echoes; null if none."""
    c = commands.select("target", "ord", "uds")
    met = payloads.join(c, "target", "left").withColumn("hit", F.when(echoes(F.col("payload_hex"), F.col("uds")), F.col("ord")))
    return met.groupBy("id").agg(F.min("hit").alias("command"))


def is_session_answer(payloads: DataFrame, commands: DataFrame) -> DataFrame:
    """Payloads (id, target, payload_hex) that echo a session request of their target."""
    sessions = commands.where("session is not null").select("target", "session").distinct()
    return payloads.join(sessions, (payloads["target"] == sessions["target"]) & echoes(payloads["payload_hex"], sessions["session"]), "left_semi").select("id")


def readings(events: DataFrame) -> DataFrame:
    """Uniform rows (id, signal, value, text_value, unit, failure_reason) of canonical readings, extra readings and failures.

    events(id, kind canonical | extra | failed, name, value, text, unit, reason).
    """
    is_ = lambda k: F.col("kind") == k
    value = F.when(is_("canonical") | (is_("extra") & F.col("text").isNull()), F.col("value"))
    return events.select("id", F.when(~is_("failed"), F.col("name")).alias("signal"), value.alias("value"), F.when(is_("extra"), F.col("text")).alias("text_value"), F.when(~is_("failed"), F.col("unit")).alias("unit"), F.when(is_("failed"), F.col("reason")).alias("failure_reason"))
