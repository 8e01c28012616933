"""Token-id files: each document's ids as one zstandard frame under a shared trained dictionary.

Layout of a token table (Parquet directories that Spark writes and any Spark-readable store can hold):

* ``dictionary/``: one row (dict_hash, id_bytes, dictionary). ``dict_hash`` is the SHA-256 of the dictionary's bytes,
  ``id_bytes`` the width of one little-endian id (2 if the vocabulary allows it, else 4).
* ``blocks/``: rows of up to 1024 consecutive documents of a shard: shard, block, start (ids of the shard's documents
  before the block), first_id and last_id, dict_hash, doc_ids, n_tokens, offsets (document i is
  payload[offsets[i]:offsets[i+1]]) and payload. A short document is read alone: filter on first_id and last_id
  (pushed to the scan), then decompress one frame.

Shards are ranges of doc_id, at quantiles of the ids alone, so no text is moved to find them and the encoded frames are
shuffled once, each shard to the partition (and the file) of its own number: the files are in order of doc_id. One id, or
rows without id, that fill several shards are dealt over them by a hash of the text. Shards are at most MAX_SHARDS, so the
running totals that give each document its place in the whole are a bounded list. The dictionary is trained on a bounded sample (SAMPLE documents of least id hash).

Defined cases: null and empty texts hold just the end id; rows without doc_id come first; repeated rows stand next to
each other, each with its own place; an empty table gives an empty file set with an empty dictionary.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattroute.llm.bpe import byte_letters, vocabulary
from wattroute.llm.cache import Cache
from wattroute.llm.common import shared_dir, table, texts

TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
SAMPLE = 1000  # documents the dictionary is trained on
DICTIONARY = 32 * 1024  # its bytes at most
SHARD_DOCS, MAX_SHARDS = 2048, 10_000
NO_ID = -(1 << 63)  # rows without id sort here
BLOCK_DOCS, BLOCK_BYTES = 1024, 4 << 20
CACHED = 400_000  # pieces in each of two generations
ODD = re.compile(r" (?=\s|\Z)")  # a space that does not start a piece
CUT = re.compile(r" (?=\S)")
MARKED = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]+)").fullmatch  # a word and the marks after it, apostrophes not among them
BLOCK = "shard int, block int, start bigint, first_id bigint, last_id bigint, dict_hash string, doc_ids array<bigint>, n_tokens array<bigint>, offsets array<bigint>, payload binary"


class Encoder:
    """The library's tokenizer behind a cache of pieces.

    A text is cut before each space that stands before a non-space: its pattern always starts a new token there, so
    the pieces' ids, joined, are the text's. A text that holds a special token's string goes to the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.special = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.type = np.dtype("<u2" if self.lib.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.type.itemsize == 2 else "I"
        self.first, self.cache = Cache(CACHED // 20), Cache(CACHED)
        self.parts = [w for w, _ in self.lib.pre_tokenizer.pre_tokenize_str(" a,;")] == ["Ġa", ",;"]  # no token crosses from a word to its marks
        self.length = None  # bytes of each id's string, where every byte is a letter of the vocabulary and nothing is normalised
        if self.lib.normalizer is None and set(byte_letters()) <= self.lib.get_vocab().keys():
            self.length = np.zeros(self.lib.get_vocab_size(), dtype=np.int64)
            for string, i in self.lib.get_vocab().items():
                self.length[i] = len(string)

    def known(self, cache: Cache, pieces: list[str], lead: str) -> list[bytes]:
        """Ids of each piece (with ``lead`` before it); what the cache lacks goes to the library in one call, words without the marks after them."""
        out = list(map(cache.young.get, pieces))
        if None in out:
            lacks: dict[str, list[tuple[int, bytes]]] = {}
            for k in [k for k, got in enumerate(out) if got is None]:
                p, marks = pieces[k], b""
                if (got := cache.get(p)) is None and lead and self.parts and (m := MARKED(p)):
                    word, tail = m.groups()
                    marks = self.first.young.get(tail) or self.known(self.first, [tail], "")[0]
                    if (got := cache.get(word)) is not None:
                        got = cache.put(p, got + marks)
                    p = word
                if got is not None:
                    out[k] = got
                else:
                    lacks.setdefault(p, []).append((k, marks))
            for (p, at), ids in zip(lacks.items(), self.together([lead + p for p in lacks]) if lacks else [], strict=True):
                got = cache.put(p, ids)
                for k, marks in at:
                    out[k] = got + marks if marks else got
        return out

    def together(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces that begin with a space, encoded as one text and cut by the bytes that each id stands for; others one by one."""
        if len(pieces) < 2 or self.length is None or pieces[0][:1] != " ":
            return [array(self.code, e.ids).tobytes() for e in self.lib.encode_batch_fast(pieces, add_special_tokens=False)]
        ids = np.array(self.lib.encode_batch_fast(["".join(pieces)], add_special_tokens=False)[0].ids, dtype=self.type)
        upto = np.cumsum([len(p) if p.isascii() else len(p.encode()) for p in pieces])
        ends = np.searchsorted(np.cumsum(self.length[ids]), upto) + 1
        raw, size = ids.tobytes(), self.type.itemsize
        return [raw[s * size : e * size] for s, e in zip([0, *ends.tolist()], ends.tolist(), strict=False)]

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text and the end id, in the file's width."""
        end = np.array([END_ID], dtype=self.type).tobytes()
        for text in texts:
            if "<|" in text and any(s in text for s in self.special):
                yield array(self.code, self.lib.encode(text, add_special_tokens=False).ids).tobytes() + end
                continue
            first, *rest = CUT.split(text) if ODD.search(text) else text.split(" ")
            yield b"".join(self.known(self.first, [first], "")) + b"".join(self.known(self.cache, rest, " ")) + end


@lru_cache(maxsize=1)
def load(path: str) -> Encoder:
    return Encoder(path)


def train_dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; where the sample is too small to train on, its own bytes serve as one."""
    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-DICTIONARY:]


def write_tokens(docs: DataFrame, tokenizer_path: str, path: str) -> None:
    """Encode every row and write the token table at ``path``."""
    spark = docs.sparkSession
    rows = texts(docs)
    least = docs.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id")).limit(SAMPLE)

    def serialise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(list(load(tokenizer_path).encode(batch.column(0).to_pylist())), pa.binary())], ["ids"])

    sample = rows.join(F.broadcast(least), "doc_id", "left_semi").select("text").mapInArrow(serialise, "ids binary").limit(2 * SAMPLE)
    dictionary = train_dictionary(sorted(bytes(r.ids) for r in sample.toLocalIterator()))
    dict_hash = hashlib.sha256(dictionary).hexdigest()

    n = docs.count()
    shards = min(MAX_SHARDS, -(-n // SHARD_DOCS))
    ids = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).cast("double").alias("id"))
    bounds = np.array(sorted(ids.approxQuantile("id", [i / shards for i in range(1, shards)], 0.2 / shards)) if shards > 1 else [], dtype=np.float64)

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, squeeze = load(tokenizer_path), zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary))
        for batch in batches:
            ids = list(encoder.encode(batch.column(1).to_pylist()))
            of = batch.column(0).fill_null(NO_ID).to_numpy().astype(np.float64)
            low, high = np.searchsorted(bounds, of, side="left"), np.searchsorted(bounds, of, side="right")
            dealt = np.array([zlib.crc32(x) for x in ids], dtype=np.int64) % np.maximum(high - low, 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array((high - dealt).astype(np.int32)), batch.column(0), pa.array([len(x) // encoder.type.itemsize for x in ids], pa.int64()), pa.array([squeeze.compress(x) for x in ids], pa.binary())],
                ["shard", "doc_id", "n_tokens", "frame"],
            )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by shard and doc_id; a shard never spans two partitions."""
        shard, block, start, held, size = None, 0, 0, [], 0

        def flush() -> pa.RecordBatch:
            ids, counts, frames = zip(*held, strict=True)
            known = [i for i in ids if i is not None]
            ends = list(accumulate(map(len, frames), initial=0))
            row = [shard, block, start, min(known, default=None), max(known, default=None), dict_hash, list(ids), list(counts), ends, b"".join(frames)]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names)

        types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
        names = [c.split()[0] for c in BLOCK.split(", ")]
        for batch in batches:
            for s, i, n, f in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (s != shard or len(held) >= BLOCK_DOCS or size >= BLOCK_BYTES):
                    yield flush()
                    start, block = start + sum(h[1] for h in held), block + 1
                    held, size = [], 0
                if s != shard:
                    shard, block, start = s, 0, 0
                held.append((i, n, f))
                size += len(f)
        if held:
            yield flush()

    frames = rows.mapInArrow(compress, "shard int, doc_id bigint, n_tokens bigint, frame binary")
    blocks = frames.repartitionById(max(1, shards), F.col("shard")).sortWithinPartitions("shard", "doc_id").mapInArrow(pack, BLOCK)
    blocks.write.parquet(f"{path}/blocks")
    width = load_width(tokenizer_path)
    spark.createDataFrame([(dict_hash, width, bytearray(dictionary))], "dict_hash string, id_bytes int, dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")


def load_width(tokenizer_path: str) -> int:
    return load(tokenizer_path).type.itemsize


def dictionary_of(spark: SparkSession, path: str) -> tuple[str, int, bytes]:
    row = spark.read.parquet(f"{path}/dictionary").first()
    if hashlib.sha256(bytes(row.dictionary)).hexdigest() != row.dict_hash:
        raise ValueError("the dictionary does not have the hash that its table states")
    return row.dict_hash, row.id_bytes, bytes(row.dictionary)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and (if asked for) ids of every document of a token table."""
    dict_hash, width, dictionary = dictionary_of(spark, path)
    blocks = spark.read.parquet(f"{path}/blocks")
    totals = blocks.select("shard", F.aggregate("n_tokens", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n")).groupBy("shard").agg(F.sum("n").alias("n"))
    before, total = {}, 0
    for shard, n in sorted(map(tuple, totals.collect())):  # MAX_SHARDS rows at most
        before[shard], total = total, total + n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
        for batch in batches:
            for row in batch.to_pylist():
                if row["dict_hash"] != dict_hash:
                    raise ValueError(f"shard {row['shard']} was written with another dictionary")
                at, payload, offsets = before[row["shard"]] + row["start"], memoryview(row["payload"]), row["offsets"]
                ids = [np.frombuffer(expand.decompress(payload[s:e]), dtype=f"<u{width}").astype("<u4") for s, e in zip(offsets, offsets[1:], strict=False)]
                columns = [
                    pa.array(row["doc_ids"], pa.int64()), pa.array(list(accumulate(map(len, ids), initial=at))[:-1], pa.int64()),
                    pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()),
                ]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns, names = [*columns, pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return blocks.select("shard", "start", "dict_hash", "doc_ids", "offsets", "payload").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids)


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[int] | None:
    """Ids of one document: the scan reads only the blocks whose range holds the id, one frame is decompressed."""
    _, width, dictionary = dictionary_of(spark, path)
    at = F.array_position("doc_ids", F.lit(doc_id)).cast("int")
    frame = F.expr("substring(payload, cast(offsets[p - 1] as int) + 1, cast(offsets[p] - offsets[p - 1] as int))")
    row = spark.read.parquet(f"{path}/blocks").where(f"first_id <= {doc_id} and last_id >= {doc_id}").withColumn("p", at).where("p > 0").select(frame.alias("frame")).first()
    if row is None:
        return None
    raw = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)).decompress(bytes(row.frame))
    return np.frombuffer(raw, dtype=f"<u{width}").tolist()


def op7_tokenfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(table(spark, sf_dir, "documents"), vocabulary(TOKENIZER), path)
    return read_tokens(spark, path, with_ids=False)
