"""Streams: an index that follows files of pages, and event-time operators over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagewright.operators import incremental
from pagewright.operators import index as I
from pagewright.sources import json_pages


def _versioned(rows: DataFrame, version: int) -> DataFrame:
    return rows.withColumn("version_", F.lit(version).cast("long")).withColumn("sha256", F.sha2(F.to_json(F.struct(*[F.to_json(c) if "map" in t else c for c, t in rows.dtypes])), 256))


def follow_pages(spark: SparkSession, source: str, path: str, checkpoint: str, clean=None) -> StreamingQuery:
    """Takes new files of pages (JSON lines, columns of PAGE) below `source` into the index published below `path`, and ends when all are read.

    Each batch writes the pages' state and the index as a new version numbered by the batch, so a batch that is run again after a failure
    writes the same. A page with empty block_order and null title counts as deleted.
    """

    def take(batch: DataFrame, number: int) -> None:
        new = _versioned(batch.drop("file"), number)
        last = I.latest(path, spark)
        if last is not None and last >= number:
            return  # this batch was published before the failure
        if last is None:
            state, index = new.groupBy("id").agg(F.max_by(F.struct(*[c for c in new.columns if c != "id"]), "sha256").alias("r")).select("id", "r.*"), None
        else:
            old = spark.read.parquet(f"{path}/state-{last}")
            state, index = incremental.upsert(old, new, "id", "version_"), I.open_published(path, spark)
        state.select(*new.columns).write.mode("overwrite").parquet(f"{path}/state-{number}")
        state = spark.read.parquet(f"{path}/state-{number}")
        kb = json_pages.knowledge_base(state.filter("NOT (title IS NULL AND size(block_order) = 0)"))
        if index is None:
            made = I.build(kb, clean)
        else:
            changed = incremental.changes(old.select(F.col("id").alias("page_id"), "sha256"), state.select(F.col("id").alias("page_id"), "sha256"))
            made = incremental.apply(index, kb, changed, clean)
        I.publish(made, path, spark, number)

    pages = spark.readStream.schema(json_pages.PAGE).json(source)
    return pages.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _timed(events: DataFrame) -> DataFrame:
    """Events whose time is a point in time: times without a zone are in the session's."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """start, event_type, n, total per window; what comes later than the watermark is left out."""
    w = _timed(events).withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type")
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("w.start", "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """user_id, start, end, n of sessions without a pause of `gap`."""
    s = _timed(events).withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w"))
    return s.agg(F.count("*").alias("n")).select("user_id", "w.start", "w.end", "n")


def once(events: DataFrame, key: str = "event_id", late: str = "2 hours") -> DataFrame:
    """Events without those whose key came before within the watermark."""
    return _timed(events).withWatermark("ts", late).dropDuplicatesWithinWatermark([key])
