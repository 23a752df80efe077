"""Where plans are cut: a table that several steps read is written once, and its lineage ends there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the session's spark.checkpoint.dir.

    Only in local mode, where driver and executors are one process, a temporary folder may stand in for it.
    """
    sc = spark.sparkContext
    told = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if told is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
        told = sc.getCheckpointDir()
    return told.rstrip("/")


def cut(df: DataFrame, sort: str | None = None) -> DataFrame:
    """`df`, written as Parquet to the shared folder and read from there, sorted by a column if asked for.

    Without it the plan of a long chain of self-joins doubles at each step. What is read back has a known size, so that Spark itself
    decides which side of a join is small enough to be broadcast; columns that aren't needed are not read, and filters reach the
    files. A lost executor costs no more than the tasks that it ran.
    """
    path = f"{shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    out = df.repartitionByRange(F.col(sort)).sortWithinPartitions(sort) if sort else df
    out.write.option("compression", "zstd").parquet(path)  # lz4_raw fails where a filter is held against a dictionary
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: So many rows that grow with a batch of queries, not with the pages, are broadcast at most.
FEW = 200_000


def few(df: DataFrame) -> DataFrame:
    """`df`, cut, and marked for broadcast if it has `FEW` rows at most, so that no table of the index is dealt out to meet a batch's rows.

    By itself Spark deals out both sides where a batch's rows are more bytes than its threshold, or where it doesn't know how many they are.
    """
    out = cut(df)
    return F.broadcast(out) if out.count() <= FEW else out
