"""Files that feeds and adapters come as, read with explicit schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CONNECTOR = "struct<standard:string,power_type:string,max_electric_power:double,max_voltage:double,max_amperage:double>"
LOCATION = f"struct<id:string,name:string,address:string,city:string,country:string,coordinates:struct<latitude:string,longitude:string>,operator:struct<name:string>,publish:boolean,evses:array<struct<uid:string,status:string,connectors:array<{CONNECTOR}>>>>"
RULE = "struct<signal:string,name:string,first:int,len:int,signed:boolean,blsb:boolean,mul:double,div:double,add:double,first_index:int,unit:string,map:map<string,string>>"
PROFILE = f"format string, id string, name string, variants array<struct<id:string,cells:int>>, commands array<struct<target:string,header:string,uds:string,session:string,rules:array<{RULE}>>>"


def _located(rows: DataFrame, source: str, country: str) -> DataFrame:
    """One row for each location of a file, its country or else the feed's own."""
    named = rows.select("l.*").withColumn("source", F.lit(source)).withColumn("country", F.coalesce("country", F.lit(country)))
    return named.where("id is not null")


def wrapped_locations(spark: SparkSession, path: str, source: str = "ndw", country: str = "NL") -> DataFrame:
    """Locations of OCPI files {"data": [...]}, gzip by their ending; a file is one task's, as gzip can't be cut."""
    return _located(spark.read.schema(f"data array<{LOCATION}>").json(path, multiLine=True).select(F.explode("data").alias("l")), source, country)


def plain_locations(spark: SparkSession, path: str, source: str = "roadbe", country: str = "BE") -> DataFrame:
    """Locations of OCPI files that are a plain array."""
    schema = spark.createDataFrame([], f"l {LOCATION}").schema["l"].dataType
    rows = spark.read.schema(schema).json(path, multiLine=True)
    return _located(rows.select(F.struct(*rows.columns).alias("l")), source, country)


def _hex(digits: Column) -> Column:
    """The number that hex digits (with or without 0x) stand for; null for anything else."""
    bare = F.regexp_replace(digits, "^0[xX]", "")
    return F.when(bare.rlike("^[0-9A-Fa-f]{1,8}$"), F.conv(bare, 16, 10).cast("bigint"))


def profiles(spark: SparkSession, path: str) -> DataFrame:
    """One row for each decode rule of the telemetry profiles in ``path``: profile, command, target, header (a number), uds (bytes), session, rule,
    signal, name, first, len, signed, blsb, mul, div, add, first_index, unit, map. Left out scales are 1 (add: 0), a left out first_index is 1.

    Files of another format give no row.
    """
    rows = spark.read.schema(PROFILE).json(path, multiLine=True).where("format = 'tprof-1'")
    commands = rows.select(F.col("id").alias("profile"), F.posexplode("commands").alias("command", "c"))
    rules = commands.select("profile", "command", "c.target", _hex(F.col("c.header")).alias("header"), F.unhex("c.uds").alias("uds"), "c.session", F.posexplode("c.rules").alias("rule", "r"))
    or_else = {"signed": F.lit(False), "blsb": F.lit(False), "mul": F.lit(1.0), "div": F.lit(1.0), "add": F.lit(0.0), "first_index": F.lit(1)}
    named = [F.coalesce(F.col(f"r.{c}"), or_else[c]).alias(c) if c in or_else else F.col(f"r.{c}").alias(c) for c in ("signal", "name", "first", "len", "signed", "blsb", "mul", "div", "add", "first_index", "unit", "map")]
    return rules.select("profile", "command", "target", "header", "uds", "session", "rule", *named)


def variants(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """wanted(profile, variant) with cells and problem: unknown_variant where the profile has none of that name."""
    rows = spark.read.schema(PROFILE).json(path, multiLine=True).where("format = 'tprof-1'")
    known = rows.select(F.col("id").alias("profile"), F.explode("variants").alias("v")).select("profile", F.col("v.id").alias("variant"), F.col("v.cells").alias("cells"), F.lit(True).alias("known"))
    return wanted.join(known, ["profile", "variant"], "left").select("profile", "variant", "cells", F.when(F.col("known").isNull(), "unknown_variant").alias("problem"))
