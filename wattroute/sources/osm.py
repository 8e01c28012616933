"""OpenStreetMap extracts (PBF) as a Spark data source: ``spark.read.format("osm_pbf").option("kind", "ways").load(path)``.

A file is a row of compressed blobs. The driver reads their headers only, a few bytes each; runs of blobs of about PART bytes are the partitions, so a
file of any size is read by as many tasks as it needs and each holds one blob. Several files (a comma between their paths) are one table.
Paths may be local or of any file system that Arrow knows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PART = 16 << 20
WAYS = "way_id bigint, refs array<bigint>, tags map<string,string>"
NODES = "node_id bigint, lat double, lon double"


def fields(raw: memoryview) -> Iterator[tuple[int, int | memoryview]]:
    """(number, value) of each field of a protocol buffer; groups and fixed widths are passed over or given as bytes."""
    at, n = 0, len(raw)
    while at < n:
        key, at = varint(raw, at)
        kind = key & 7
        if kind == 0:
            value, at = varint(raw, at)
        elif kind == 2:
            size, at = varint(raw, at)
            value, at = raw[at : at + size], at + size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = raw[at : at + size], at + size
        else:
            raise ValueError(f"field of kind {kind}")
        yield key >> 3, value


def varint(raw: memoryview, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = raw[at]
        value |= (b & 127) << shift
        at += 1
        if b < 128:
            return value, at
        shift += 7


def packed(raw: memoryview) -> np.ndarray:
    """All numbers of a packed field at once."""
    b = np.frombuffer(raw, dtype=np.uint8)
    ends = np.flatnonzero(b < 128)
    starts = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64)
    out, length = np.zeros(len(ends), dtype=np.uint64), ends - starts + 1
    for k in range(int(length.max(initial=0))):
        own = length > k
        out[own] |= (b[starts[own] + k] & np.uint8(127)).astype(np.uint64) << np.uint64(7 * k)
    return out


def signed(v: np.ndarray) -> np.ndarray:
    return (v >> np.uint64(1)).astype(np.int64) ^ -(v & np.uint64(1)).astype(np.int64)


def offset(v: int) -> int:
    """A plain (not zigzag) 64-bit number."""
    return v - (1 << 64) if v >> 63 else v


def blob_bytes(raw: memoryview) -> bytes:
    for number, value in fields(raw):
        if number == 1:
            return bytes(value)
        if number == 3:
            return zlib.decompress(value)
        if number == 7:
            import zstandard

            return zstandard.ZstdDecompressor().decompressobj().decompress(bytes(value))
    raise ValueError("a blob is compressed in a way that is not read")


def ways_of(block: bytes) -> pa.RecordBatch | None:
    texts, groups = [], []
    for number, value in fields(memoryview(block)):
        if number == 1:
            texts = [bytes(s).decode("utf-8", "replace") for k, s in fields(value) if k == 1]
        elif number == 2:
            groups.append(value)
    ids, refs, tags = [], [], []
    for group in groups:
        for number, way in fields(group):
            if number != 3:
                continue
            got = {1: 0, 2: b"", 3: b"", 8: b""} | dict(fields(way))
            ids.append(offset(got[1]))
            refs.append(np.cumsum(signed(packed(got[8]))).tolist())
            tags.append([(texts[k], texts[v]) for k, v in zip(packed(got[2]).tolist(), packed(got[3]).tolist(), strict=True)])
    if not ids:
        return None
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(refs, pa.list_(pa.int64())), pa.array(tags, pa.map_(pa.string(), pa.string()))], ["way_id", "refs", "tags"])


def nodes_of(block: bytes) -> pa.RecordBatch | None:
    groups, scale, lat0, lon0 = [], 100, 0, 0
    for number, value in fields(memoryview(block)):
        if number == 2:
            groups.append(value)
        elif number == 17:
            scale = value
        elif number == 19:
            lat0 = offset(value)
        elif number == 20:
            lon0 = offset(value)
    parts = []
    for group in groups:
        for number, value in fields(group):
            if number == 2:  # dense: differences, column by column
                got = {1: b"", 8: b"", 9: b""} | dict(fields(value))
                parts.append([np.cumsum(signed(packed(got[k]))) for k in (1, 8, 9)])
            elif number == 1:
                got = dict(fields(value))
                parts.append([signed(np.array([got.get(k, 0)], dtype=np.uint64)) for k in (1, 8, 9)])
    if not parts:
        return None
    ids, lat, lon = (np.concatenate([p[k] for p in parts]) for k in range(3))
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array((lat0 + lat * scale) * 1e-9), pa.array((lon0 + lon * scale) * 1e-9)], ["node_id", "lat", "lon"])


def blobs(path: str) -> list[tuple[int, int]]:
    """(start, size) of the data blobs of a file."""
    system, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    out = []
    with system.open_input_file(name) as f:
        at, size = 0, f.size()
        while at < size:
            head = int.from_bytes(f.read_at(4, at), "big")
            got = dict(fields(memoryview(f.read_at(head, at + 4))))
            if bytes(got[1]) == b"OSMData":
                out.append((at + 4 + head, got[3]))
            at += 4 + head + got[3]
        if at != size:
            raise ValueError(f"{path} is cut short")
    return out


class Run(InputPartition):
    def __init__(self, path: str, parts: list[tuple[int, int]]):
        self.path, self.parts = path, parts


class Reader(DataSourceReader):
    def __init__(self, paths: list[str], kind: str):
        self.paths, self.kind = paths, kind

    def partitions(self) -> list[Run]:
        out = []
        for path in self.paths:
            held, size = [], 0
            for part in blobs(path):
                if held and size + part[1] > PART:
                    out.append(Run(path, held))
                    held, size = [], 0
                held.append(part)
                size += part[1]
            if held:
                out.append(Run(path, held))
        return out or [Run("", [])]

    def read(self, partition: Run) -> Iterator[pa.RecordBatch]:
        if not partition.parts:
            return
        path = partition.path
        system, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        with system.open_input_file(name) as f:
            for start, size in partition.parts:
                block = blob_bytes(memoryview(f.read_at(size, start)))
                got = ways_of(block) if self.kind == "ways" else nodes_of(block)
                if got is not None:
                    yield got


class OsmPbf(DataSource):
    @classmethod
    def name(cls) -> str:
        return "osm_pbf"

    def schema(self) -> str:
        kind = self.options.get("kind", "ways")
        if kind not in ("ways", "nodes"):
            raise ValueError("kind is ways or nodes")
        return WAYS if kind == "ways" else NODES

    def reader(self, schema) -> Reader:
        return Reader([p.strip() for p in self.options["path"].split(",")], self.options.get("kind", "ways"))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(OsmPbf)
