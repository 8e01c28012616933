"""What operators in rounds share: a round's result is written once, so that the plan stays short and a lost executor costs one round."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage: write ``df`` once as a table in the folder that spark.checkpoint.dir names and read it back."""
    return df.sparkSession.read.schema(df.schema).parquet(stored(df))


def stored(df: DataFrame, *by: str) -> str:
    """The path of ``df`` written as a table, in a folder for each value of ``by``.

    Only where spark.checkpoint.dir is unset and all runs on one machine (tests) a folder of our own is used. Tables go when the session ends.
    """
    spark, sc = df.sparkSession, df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="wattroute-"))
    path = f"{sc.getCheckpointDir()}/round-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path) if by else df.write.parquet(path)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """The paths that are there, of those a pattern names."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return [str(f.getPath()) for f in found or []]
