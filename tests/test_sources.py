"""Readers over small files that are written here."""

import gzip
import json
import zlib

import pytest

from wattroute.sources import osm, readers


def number(v):
    out = b""
    while v > 127:
        out += bytes([v & 127 | 128])
        v >>= 7
    return out + bytes([v])


def field(k, value):
    return number(k << 3) + number(value & (1 << 64) - 1) if isinstance(value, int) else number(k << 3 | 2) + number(len(value)) + value


def zig(v):
    return (v << 1) ^ (v >> 63)


def many(values):
    return b"".join(number(v) for v in values)


def deltas(values):
    return many(zig(b - a) & (1 << 64) - 1 for a, b in zip([0, *values], values, strict=False))


def blob(kind, payload, how):
    body = {"raw": lambda: field(1, payload), "zlib": lambda: field(2, len(payload)) + field(3, zlib.compress(payload))}[how]()
    head = field(1, kind) + field(3, len(body))
    return len(head).to_bytes(4, "big") + head + body


def test_osm_ways_and_nodes(spark, tmp_path, monkeypatch):
    ways = {7: ([1, 5, 3, 1], {"highway": "primary", "name": "Große Straße"}), 9_000_000_000: ([10**11, 10**11 + 1], {}), 8: ([], {"highway": "service"})}
    texts = ["", "highway", "primary", "name", "Große Straße", "service"]
    way = lambda i, refs, tags: field(1, i) + field(2, many(texts.index(k) for k in tags)) + field(3, many(texts.index(v) for v in tags.values())) + field(8, deltas(refs))
    nodes = [(1, 49.5, 6.25), (5, -12.0000001, -179.9999999), (3, 0.0, 0.0)]
    scaled = lambda k: [round(n[k] * 1e7) for n in nodes]
    table = field(1, b"".join(field(1, t.encode()) for t in texts))
    one = table + field(2, b"".join(field(3, way(i, *w)) for i, w in list(ways.items())[:2]))
    two = table + field(2, field(3, way(8, *ways[8]))) + field(2, field(2, field(1, deltas([n[0] for n in nodes])) + field(8, deltas(scaled(1))) + field(9, deltas(scaled(2)))))
    single = field(2, field(1, field(1, zig(77)) + field(8, zig(-20)) + field(9, zig(30)))) + field(17, 1000) + field(19, 10**9) + field(20, -(10**9))
    raw = blob(b"OSMHeader", b"", "raw") + blob(b"OSMData", one, "zlib") + blob(b"OSMData", two, "raw") + blob(b"OSMData", single, "zlib")
    (tmp_path / "a.pbf").write_bytes(raw)
    (tmp_path / "b.pbf").write_bytes(blob(b"OSMHeader", b"", "raw") + blob(b"OSMData", one, "raw"))
    (tmp_path / "cut.pbf").write_bytes(raw[:-5])
    (tmp_path / "none.pbf").write_bytes(blob(b"OSMHeader", b"", "raw"))
    monkeypatch.setattr(osm, "PART", 40)
    osm.register(spark)
    read = lambda name, kind: spark.read.format("osm_pbf").option("kind", kind).load(",".join(f"{tmp_path}/{n}" for n in name.split()))
    got = read("a.pbf", "ways")
    assert {r.way_id: (r.refs, r.tags) for r in got.collect()} == ways
    assert read("a.pbf b.pbf", "ways").count() == 5
    assert {(r.node_id, round(r.lat, 7), round(r.lon, 7)) for r in read("a.pbf", "nodes").collect()} == {*nodes, (77, round(1 - 2e-5, 7), round(-1 + 3e-5, 7))}
    assert read("none.pbf", "ways").count() == 0
    with pytest.raises(Exception, match="cut short"):
        read("cut.pbf", "ways").count()


def test_location_files(spark, tmp_path):
    where = {"coordinates": {"latitude": "52.1", "longitude": "5.2"}, "evses": [{"uid": "e", "connectors": [{"standard": "IEC_62196_T2_COMBO", "max_electric_power": 150000}]}]}
    rows = [{"id": "1", "name": "A", **where}, {"id": "2", "country": "DEU", **where}, {"name": "no id"}]
    (tmp_path / "ndw.json.gz").write_bytes(gzip.compress(json.dumps({"data": rows}).encode()))
    (tmp_path / "be.json").write_text(json.dumps(rows))
    for got, source, home in ((readers.wrapped_locations(spark, f"{tmp_path}/ndw.json.gz"), "ndw", "NL"), (readers.plain_locations(spark, f"{tmp_path}/be.json"), "roadbe", "BE")):
        found = {r.id: r for r in got.collect()}
        assert {i: (r.source, r.country) for i, r in found.items()} == {"1": (source, home), "2": (source, "DEU")}
        assert found["1"].coordinates.latitude == "52.1" and found["1"].evses[0].connectors[0].max_electric_power == 150000


def test_profiles(spark, tmp_path):
    rule = {"signal": "soc", "first": 8, "len": 16, "div": 2.0, "map": {"1": "on"}}
    profile = {"format": "tprof-1", "id": "p", "variants": [{"id": "long", "cells": 180}], "commands": [{"target": "bms", "header": "0x7E4", "uds": "220101", "rules": [rule, {"name": "x", "first": 0, "len": 8, "first_index": 3, "mul": 0.5}]}, {"target": "vcu", "header": "zz", "uds": "2201", "session": "1003", "rules": []}]}
    (tmp_path / "p.json").write_text(json.dumps(profile))
    (tmp_path / "other.json").write_text(json.dumps(profile | {"format": "tprof-2"}))
    a, b = sorted(readers.profiles(spark, f"{tmp_path}/*.json").collect(), key=lambda r: r.rule)
    assert (a.profile, a.header, bytes(a.uds), a.mul, a.div, a["add"], a.first_index, a.signed, a.map) == ("p", 0x7E4, b"\x22\x01\x01", 1.0, 2.0, 0.0, 1, False, {"1": "on"})
    assert (b.signal, b.name, b.first_index, b.mul) == (None, "x", 3, 0.5)
    wanted = spark.createDataFrame([("p", "long"), ("p", "short")], "profile string, variant string")
    assert {r.variant: (r.cells, r.problem) for r in readers.variants(spark, f"{tmp_path}/*.json", wanted).collect()} == {"long": (180, None), "short": (None, "unknown_variant")}
