"""What queries share: the knowledge base and the index of a data directory, built once in a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

from pagewright.operators import index as I
from pagewright.plans.cut import cut
from pagewright.sources import tables

_kept: dict = {}


def base(spark: SparkSession, sf_dir: str) -> tables.Deferred:
    """Tables of the knowledge base, of which a query makes those that it reads."""
    return _once("kb", spark, sf_dir, lambda: tables.Deferred(tables.from_documents(spark, sf_dir)))


def index(spark: SparkSession, sf_dir: str) -> I.Deferred:
    """Tables of the index, of which a query makes those that it reads."""
    return _once("index", spark, sf_dir, lambda: I.Deferred(base(spark, sf_dir)))


def kept(kind: str, spark: SparkSession, sf_dir: str, make):
    """The table that `make` gives, computed once in a session."""
    return _once(kind, spark, sf_dir, lambda: cut(make()))


def limit_batches(spark: SparkSession) -> None:
    """Limits the session's Arrow batches (rows, bytes): what a Python worker holds then doesn't grow with the rows of a task. Smaller limits stay."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 1_000), ("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20)):
        size = int(spark.conf.get(name).rstrip("b"))
        if size <= 0 or size > most:
            spark.conf.set(name, str(most))


def _once(kind: str, spark: SparkSession, sf_dir: str, make):
    """What `make` gave for these files: files that changed give new tables, and what was kept of their earlier state goes."""
    files = spark.read.format("binaryFile").load(f"{sf_dir}/documents.parquet").select("path", "modificationTime", "length")
    state = tuple(map(tuple, files.orderBy("path").collect()))  # a few rows: one for each file
    place = (kind, spark.sparkContext.applicationId, sf_dir)
    if place not in _kept or _kept[place][0] != state:
        _kept[place] = (state, make())
    return _kept[place][1]


def forget() -> None:
    """Drops what was kept, so that the next query builds it anew."""
    _kept.clear()
