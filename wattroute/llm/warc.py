"""WARC archives as ``.warc.zst``: one zstandard frame for each record, all under a dictionary that leads the file.

A file holds a skippable frame (magic 0x184D2A5D) with the dictionary, then the records, each compressed on its own so that a
reader can start at any record. Between records stand empty skippable frames, which every zstandard reader passes over: they are the
line ends of Spark's text writer, so that the files are written by Spark to any store it can reach, committed with its tasks.

The dictionary is trained on a bounded sample of the records that are archived (SAMPLE pages of least id hash, SLICE bytes of each
at most). Of pages with equal payloads the one of smallest page_id is a response record, the others are revisit records without
payload, which refer to it. Both carry the HTTP header of the whole payload, its digest and its length.

Scale: the html is shuffled once, in the join of pages with the least page_id of their digest (a minimum with partial
sums in the tasks; the join's hot digests are split by AQE), and goes straight to the files of FILE_BYTES of payload. A reader holds one compressed file and one record.

Defined cases: null html is empty; pages of the same smallest page_id and payload are all response records; a null page_id is
greater than all others, and where no page of a payload has an id all are response records; null url is an empty URI; extra columns are not looked at; an empty table gives no file.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattroute.llm.common import shared_dir, table
from wattroute.llm.tokenfile import train_dictionary

SAMPLE, SLICE = 512, 16 << 10  # records that the dictionary is trained on, and bytes of each
FILE_BYTES = 64 << 20  # payload of a file, about
DICTIONARY_FRAME = b"\x5d\x2a\x4d\x18"
BETWEEN = b"\x50\x2a\x4d\x18\x00\x00\x00\x00"  # an empty skippable frame
STEP = 32 << 10  # bytes given to the decompressor at once
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(urn: str | None) -> int | None:
    number = urn[len("<urn:page:") : -1] if urn else ""
    return int(number) if number else None


def record(page_id: int | None, url: str, payload: bytes, digest: str, length: int, refers_to: int | None) -> bytes:
    """A whole WARC 1.1 record; ``refers_to``: the response's page_id if this is a revisit."""
    http = HTTP.format(length).encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Target-URI: {''.join(url.split())}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if revisit:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], int, bytes]:
    """Header fields, length of the whole payload (by its HTTP header) and the payload that the record holds."""
    top, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = top.decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError("this is no WARC record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n" or len(block) != int(fields["Content-Length"]):
        raise ValueError("the record does not end where its header says")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(line.split(b":")[1]) for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:"))
    return fields, length, payload


def frames(content: bytes) -> Iterator[bytes]:
    """The records of a file: its dictionary is read from the leading frame, other skippable frames are passed over."""
    view, at, dictionary = memoryview(content), 0, None
    while at < len(view):
        magic = bytes(view[at : at + 4])
        if magic[1:] == DICTIONARY_FRAME[1:] and 0x50 <= magic[0] <= 0x5F:
            end = at + 8 + int.from_bytes(view[at + 4 : at + 8], "little")
            if magic == DICTIONARY_FRAME and at == 0:
                dictionary = zstandard.ZstdCompressionDict(bytes(view[at + 8 : end]))
            at = end
            continue
        expand = (zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()).decompressobj()
        out = []
        while not expand.eof:
            piece = view[at : at + STEP]
            if not piece:
                raise ValueError("the last record is cut short")
            out.append(expand.decompress(piece))
            at += len(piece) - len(expand.unused_data)
        yield b"".join(out)


def pages_of(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest (20 bytes) of every row."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    named = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), payload.alias("payload"))
    return named.withColumn("digest", F.unhex(F.sha1("payload")))


def firsts(rows: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, digest, refers_to of the pages that another one of a smaller page_id has the payload of, from slim rows."""
    slim = rows.where(F.octet_length("payload") >= least_bytes).select("page_id", "digest")
    least = slim.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null")
    other = slim.distinct().join(least, "digest").where(~F.col("page_id").eqNullSafe(F.col("first")))
    return other.select("page_id", "digest", F.col("first").alias("refers_to"))


def dictionary_for(pages: DataFrame) -> bytes:
    """Trained on the records of a bounded sample; empty where there is nothing to train on."""
    least = pages.select("page_id").where("page_id is not null").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(SAMPLE)
    rows = pages_of(pages).join(F.broadcast(least), "page_id", "left_semi").select("page_id", "url", F.substring("payload", 1, SLICE).alias("payload"), "digest", F.octet_length("payload").alias("n"))
    some = rows.orderBy("page_id", "digest").limit(SAMPLE).collect()  # SAMPLE * SLICE = 8 MB at most
    return train_dictionary([record(r.page_id, r.url, bytes(r.payload), base64.b32encode(r.digest).decode(), r.n, None) for r in some]) if some else b""


def write_warc(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Write a record for every row of ``pages`` (page_id, url, html) to ``.warc.zst`` files in the folder ``path``.

    ``least_bytes``: smaller payloads are always response records.
    """
    spark = pages.sparkSession
    dictionary = dictionary_for(pages)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=6, dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdCompressor(level=6)
        led = False
        for batch in batches:
            for page_id, url, payload, digest, refers_to in zip(*batch.columns, strict=True):
                raw = payload.as_buffer().to_pybytes()
                frame = squeeze.compress(record(page_id.as_py(), url.as_py(), raw, base64.b32encode(digest.as_py()).decode(), len(raw), refers_to.as_py()))
                lead = [] if led or not dictionary else [DICTIONARY_FRAME + len(dictionary).to_bytes(4, "little") + dictionary]
                led = True
                yield pa.RecordBatch.from_arrays([pa.array([*lead, frame], pa.binary())], ["frame"])

    rows = pages_of(pages)
    total = pages.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    files, keys = max(1, -(-total // FILE_BYTES)), ["none", "k", "digest"]
    keyed = lambda df: df.withColumn("none", F.col("page_id").isNull()).withColumn("k", F.coalesce("page_id", F.lit(0)))
    known = keyed(firsts(rows, least_bytes)).select(*keys, "refers_to").repartition(files, *keys)
    met = keyed(rows).repartition(files, *keys).join(known.hint("shuffle_hash"), keys, "left")
    packed = met.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(pack, "frame binary")
    packed.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", BETWEEN.decode()).text(path)
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in fs.listStatus(fs_path(path)):  # names alone
        name = status.getPath().getName()
        if name.startswith("part-"):
            fs.rename(status.getPath(), fs_path(path, name.removesuffix(".txt") + ".warc.zst"))


READ = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def read_warc(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """One row for each record of the archives in ``path``; digests of payloads are computed anew and must be those of the headers."""
    names = [c.split()[0] for c in READ.split(", ")] + ["payload"] * with_payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()][: len(names)]
        for batch in batches:
            for content in batch.column(0):
                held, size = [], 0
                for raw in frames(content.as_buffer().to_pybytes()):
                    fields, length, payload = parse(raw)
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if fields["WARC-Type"] == "response" and (base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest or len(payload) != length):
                        raise ValueError(f"{fields['WARC-Record-ID']} does not hold the payload that its header states")
                    row = [page_of(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], length, digest, fields["WARC-Type"], page_of(fields.get("WARC-Refers-To"))]
                    held.append([*row, payload] if with_payload else row)
                    size += 200 + len(payload) * with_payload
                    if size > 1 << 22:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), kinds, strict=True)], names)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), kinds, strict=True)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(path).select("content")
    return files.mapInArrow(run, READ + ", payload binary" * with_payload)


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(table(spark, sf_dir, "pages"), path)
    return read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


# 20 bytes are 8 groups of 5 hex digits, each 4 letters of 5 bits
SQL = """
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, strlen(html) as payload_bytes, sha1(html) as h from p),
m as (select *, min(page_id) over (partition by h) as first from d),
g as (select *, list_transform(range(8), lambda i: ('0x' || substr(h, cast(i * 5 + 1 as bigint), 5))::bigint) as v from m)
select page_id, payload_bytes,
 array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast((v[(k // 4 + 1)::bigint] // (32 ** (3 - k % 4))::bigint) % 32 + 1 as bigint), 1)), '') as payload_digest,
 case when page_id is not distinct from first then 'response' else 'revisit' end as record_type,
 case when page_id is distinct from first then first end as refers_to
from g"""
