"""The pipeline from end to end, over tables with odd rows and clashing columns."""

import tracemalloc
from collections import deque

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wattroute.llm import bpe, quality, secrets, simhash

DATA = "/root/testdata/sf0.001"
ODD = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = "the quick brown fox jumps over a lazy dog near the old river bank while seven green boats drift past in the morning light of a cold spring day"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The tables of DATA with odd documents, and columns of the names that stages use for themselves."""
    at = str(tmp_path_factory.mktemp("tables"))
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    odd = [(900_001, None, None, None, None), (900_002, "", "en", "odd", 0), (900_003, "   \n", None, "odd", 4), (None, WORDS, "en", "odd", 9), (900_004, WORDS + " again", "en", "odd", 9), (900_004, WORDS + " again", "en", "odd", 9), (900_005, WORDS + " again", "en", "odd", 9)]
    odd += [(900_006, "word " * 200_000, "en", "odd", 1_000_000)]
    both = docs.unionByName(spark.createDataFrame(odd, ODD))
    clash = {c: F.concat(F.lit(f"{c} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for c in ("h", "score", "scored_text", "row", "node", "spans", "a.b")}
    both.withColumns(clash).write.parquet(f"{at}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{DATA}/{t}.parquet").write.parquet(f"{at}/{t}.parquet")
    return at


def test_stages_keep_rows_and_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r[c] == f"{c} {'-' if r.doc_id is None else r.doc_id}" for r in rows for c in ("h", "score", "scored_text", "row", "node", "spans", "a.b"))


def test_run_is_its_stages(spark, folder):
    got = {(r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, folder).select("doc_id", "n_tokens").collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
    left = docs.collect()
    lib = bpe.vocabulary()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(lib)
    assert got == {(r.doc_id, len(t.encode(r.text or "", add_special_tokens=False).ids)) for r in left}
    ids = [r.doc_id for r in left]
    assert sum(i in (900_004, 900_005) for i in ids) <= 1  # copies: one stays at most
    assert all("[secret]" not in (r.text or "") or r.n_chars == len(r.text) for r in left)


def test_run_on_empty_tables(spark, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{DATA}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_copies_keep_a_column_h(spark):
    docs = spark.createDataFrame([(2, WORDS, "x"), (1, WORDS, "y"), (3, "other words", "z")], "doc_id bigint, text string, h string")
    assert sorted((r.doc_id, r.h) for r in simhash.keep_one(docs).collect()) == [(1, "y"), (3, "z")]
    trees = quality.fit(spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet"))
    scored = docs.withColumnRenamed("h", "score").withColumn("scored_text", F.lit(1))
    assert quality.keep_good(scored, trees).columns == scored.columns


def test_near_copies_follow_fingerprints(spark, tmp_path):
    """A line in turn with new words: too many new five-word shingles for a similarity of 0.8, but fingerprints of at most 3 different bits."""
    line = "one long line that stands in both of these texts again and again "
    docs = spark.createDataFrame([(2, line * 300 + " ".join(f"a{i}" for i in range(40))), (1, line * 300 + " ".join(f"b{i}" for i in range(40))), (3, WORDS), (4, " "), (5, None)], "doc_id bigint, text string")
    bits = {r.doc_id: r.bits for r in simhash.fingerprints(docs).collect()}
    assert ((bits[1] ^ bits[2]) & (2**64 - 1)).bit_count() <= 3
    assert sorted(r.doc_id for r in corpus_pipeline.near_copies(spark, docs, str(tmp_path)).collect()) == [1, 3, 4, 5]
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == [1, 2, 3, 4, 5]


def test_texts_of_a_batch_are_strings_a_few_hundred_at_a_time(spark, monkeypatch):
    """Spark sends 10,000 texts at once; a worker never holds them all as Python strings, nor what a stage makes of them."""
    docs, runs = spark.createDataFrame([], "doc_id bigint, text string"), []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema: runs.append(f) or self)
    trees = quality.Trees(0.0, np.zeros((0, 15), dtype=np.int64), np.zeros((0, 15)), np.zeros((0, 16)))
    stages = [lambda: quality.keep_good(docs, trees), lambda: secrets.redact(docs, secrets.Network(np.random.default_rng(0))), lambda: bpe.digests(docs, bpe.vocabulary())]
    batch = pa.RecordBatch.from_arrays([pa.array(range(10_000)), pa.array([f"{i} " + WORDS * 20 for i in range(10_000)])], ["c0", "c1"])
    for stage in stages:
        stage()
        deque(runs[-1](iter([batch.slice(0, 10)])), 0)  # what a worker loads once
        tracemalloc.start()
        rows = sum(map(len, runs[-1](iter([batch, batch.slice(0, 0), batch.slice(9_999)]))))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert rows == 10_001 and peak < batch.nbytes / 2
