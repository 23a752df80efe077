"""What several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Elements of an array that `offsets` adds up in one go.
RUN = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The input table `name` of one data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def limit_batches(spark: SparkSession) -> None:
    """Limits the session's Arrow batches, so that batches of long texts need little memory beside the heap.

    For jobs, which own their session: the queries and the pipeline call it. No operator changes a setting; with the
    default of 10,000 rows a batch they give the same rows and need more memory.
    """
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 1_000), ("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20)):
        size = int(spark.conf.get(name).rstrip("b"))
        if size <= 0 or size > most:
            spark.conf.set(name, str(most))


def tidied(run):
    """`run`, a function of batches in a Python worker, that gives free memory back when its task is over.

    Workers live on and their next task may be another operator's; an allocator keeps what was freed, which counts
    against the executor.
    """

    def wrapped(batches):
        yield from run(batches)
        import pyarrow

        gc.collect()
        pyarrow.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library: memory stays with its allocator
            pass

    return wrapped


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the session's spark.checkpoint.dir.

    Only in local mode, where driver and executors are one process, a temporary folder may stand in for it.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        told = sc.getConf().get("spark.checkpoint.dir")
        if not told and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(told or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """`df`, computed once and kept in the folder that all executors share."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def bound(value: Column, use) -> Column:
    """`use(value)` with `value` computed once, however often `use` (and lambdas in it) refer to it."""
    return F.transform(F.array(value), use)[0]


def offsets(sizes: Column) -> Column:
    """Running totals of an array of numbers: what lies before each element. In time linear in its length.

    A fold that appends to an array copies it at each step, so runs of RUN elements are added up by themselves and moved
    by the total of the runs before them.
    """
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<bigint>)").alias("out"))

    def step(acc, n):
        return F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    def folded(x):
        return F.aggregate(x, zero, step)

    def moved(runs):
        before = folded(F.transform(runs, lambda r: r["at"]))["out"]
        return F.flatten(F.zip_with(runs, before, lambda r, b: F.transform(r["out"], lambda v: v + b)))

    def cut(x):
        last = F.floor((F.greatest(F.size(x), F.lit(1)) - 1) / RUN).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda i: folded(F.slice(x, i * RUN + 1, F.lit(RUN))))

    return bound(sizes, lambda x: bound(cut(x), moved))
