"""Helpers shared by the corpus operators: tables, shared-folder checkpoints, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only where that is unset and all runs on one machine (tests) a folder of our own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="wattroute-"))
    return sc.getCheckpointDir()


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as a Parquet table in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, text and the whole row as one struct, so that a helper column can have any name."""
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """All rows, ``rows`` at a time: Spark sends 10,000 texts at once, which need not all be Python strings at the same time."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def crc_mod(doc_id: Column, mod: int) -> Column:
    """crc32 of doc_id as text, modulo ``mod``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod


def sql_crc32(text: str) -> str:
    """DuckDB expression: the unsigned crc32 of an ASCII string, bit by bit."""
    bits = f"flatten(list_transform(string_split({text}, ''), lambda ch: [ascii(ch)::bigint, 0, 0, 0, 0, 0, 0, 0]))"
    return f"xor(list_reduce({bits}, lambda c, x: xor(xor(c, x) >> 1, 3988292384 * (xor(c, x) & 1)), 4294967295::bigint), 4294967295::bigint)"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone. Texts of ASCII characters take the fast built-in."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def alnum_words(text: Column) -> Column:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the A-Z-lowered text as an array; null or wordless: empty."""
    low = ascii_lower(F.coalesce(text, F.lit("")))
    parts = F.split(low, "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
    return F.array_remove(parts, "")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected edge list of longs: (node, component), component the smallest node.

    Each round maps every node to its neighbour of least hash (or itself), contracts the edges by that map and
    composes it with the maps before. Hash order makes the number of rounds logarithmic also for long chains.
    Nothing is collected; every round is written to the shared folder.
    """
    e = materialise(
        edges.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct(), "edges"
    )
    total = None
    while not e.isEmpty():
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("n"))).alias("m"))
        own = F.struct(F.xxhash64("a").alias("h"), F.col("a").alias("n"))
        hop = materialise(least.select(F.col("a").alias("node"), F.least(own, F.col("m"))["n"].alias("rep")), "hop")
        if total is None:
            total = hop
        else:
            step = hop.select(F.col("node").alias("rep"), F.col("rep").alias("next"))
            total = materialise(total.join(step, "rep", "left").select("node", F.coalesce("next", "rep").alias("rep")), "rep")
        ha, hb = hop.select(F.col("node").alias("a"), F.col("rep").alias("ra")), hop.select(F.col("node").alias("b"), F.col("rep").alias("rb"))
        e = materialise(
            e.join(ha, "a").join(hb, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(),
            "edges",
        )
    if total is None:
        return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    least = total.groupBy("rep").agg(F.min("node").alias("component"))
    return total.join(least, "rep").select("node", "component")


def texts(docs: DataFrame, columns: Sequence[str] = ("doc_id", "text"), binary: bool = False) -> DataFrame:
    """Only the columns an operator reads, so that extra or clashing names never matter; text null -> ''."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(*[(text.cast("binary") if binary else text).alias("text") if c == "text" else F.col(c) for c in columns])
