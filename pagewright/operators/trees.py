"""Digests of pages as a hash tree: what tells two states apart is found by going down only where digests differ.

A page's digest is that of its canonical JSON: fields and map keys in order, nulls written. Keys are dealt to ranges of their
hash, so that the ranges are the same in every state and none is hot; the digest of a range covers the keys and digests in it, in
order, and each level of the tree joins sixteen ranges, up to the root. Rows are kept in a folder for each range, so that a
comparison of two states reads no rows of ranges that are equal.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from pagewright.operators.incremental import changes

#: Hexadecimal digits of a range: 256 ranges; a range of 10,000 rows is some MB.
DIGITS = 2
#: So many ranges that differ are named in a filter at most, which prunes folders when it is planned; more are joined, which prunes them when it runs.
NAMED = 64


def _canonical(value: Column, kind: DataType) -> Column:
    if isinstance(kind, StructType):
        fields = [_canonical(value.getField(f.name), f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)]
        return F.when(value.isNotNull(), F.struct(*fields)) if fields else value
    if isinstance(kind, MapType):
        entries = F.transform(F.array_sort(F.map_entries(value)), lambda e: F.struct(e["key"].alias("key"), _canonical(e["value"], kind.valueType).alias("value")))
        return entries if not isinstance(kind.valueType, MapType) else F.map_entries(value)
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: _canonical(x, kind.elementType))
    return value


def page_digest(df: DataFrame, *without: str) -> Column:
    """SHA-256 of the canonical JSON of a row, without the columns named: the order of columns, fields and map keys doesn't matter, nulls do."""
    kept = sorted((f for f in df.schema.fields if f.name not in without), key=lambda f: f.name)
    row = F.struct(*(_canonical(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in kept))
    return F.sha2(F.to_json(row, {"ignoreNullFields": "false"}), 256)


def ranged(rows: DataFrame, key: str = "page_id", digits: int = DIGITS) -> DataFrame:
    """`rows` (key, sha256, ...) with range, the first digits of the key's hash; all null keys have one."""
    return rows.withColumn("range", F.left(F.sha2(F.coalesce(F.col(key).cast("string"), F.lit("")), 256), F.lit(digits)))


def tree(rows: DataFrame, key: str = "page_id", digest: str = "sha256", digits: int = DIGITS) -> DataFrame:
    """level, range, digest, n of every node that has rows; level 0 is the root, whose range is empty. `rows` have range."""
    told = F.concat_ws("\0", F.coalesce(F.col(key).cast("string"), F.lit("")), F.coalesce(digest, F.lit("")))
    joined = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), "\n"), 256)
    level = rows.groupBy("range").agg(joined(told).alias("digest"), F.count("*").alias("n"))
    every = [level.withColumn("level", F.lit(digits))]
    for depth in range(digits - 1, -1, -1):
        up = F.left("range", F.lit(depth)) if depth else F.lit("")
        level = level.groupBy(up.alias("range")).agg(joined(F.concat_ws(":", "range", "digest")).alias("digest"), F.sum("n").alias("n"))
        every.append(level.withColumn("level", F.lit(depth)))
    return reduce(DataFrame.unionByName, every).select("level", "range", "digest", "n")


TREE = "level int, range string, digest string, n bigint"


def _rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("key string, digest string, range string").parquet(f"{path}/rows")


def write_state(rows: DataFrame, path: str, key: str = "page_id", digest: str = "sha256", digits: int = DIGITS) -> None:
    """Writes key and digest by ranges, and then the tree over what was written: a state without a tree isn't whole and can't be compared."""
    kept = rows.select(F.col(key).cast("string").alias("key"), F.col(digest).cast("string").alias("digest"))
    ranged(kept, "key", digits).repartition("range").sortWithinPartitions("range", "key").write.mode("overwrite").partitionBy("range").parquet(f"{path}/rows")
    tree(_rows(rows.sparkSession, path), "key", "digest", digits).coalesce(1).write.mode("overwrite").parquet(f"{path}/tree")


def differing(spark: SparkSession, old: str, new: str) -> list[str]:
    """The ranges of the last level that two states don't share. Trees have at most 16 ** digits leaves; only nodes below differing ones are looked at."""
    trees = [spark.read.schema(TREE).parquet(f"{p}/tree") for p in (old, new)]
    depth = {t.agg(F.max("level")).first()[0] for t in trees} - {None}
    if len(depth) > 1:
        raise ValueError(f"{old} and {new} have trees of different depths")
    open_: list[str] = []
    for level in range(max(depth, default=-1) + 1):
        at = [t.filter(F.col("level") == level) for t in trees]
        if level > 1:
            at = [t.filter(F.left("range", F.lit(level - 1)).isin(open_)) for t in at]
        both = at[0].select("range", F.col("digest").alias("a")).join(at[1].select("range", F.col("digest").alias("b")), "range", "full")
        open_ = [r[0] for r in both.filter(~F.col("a").eqNullSafe(F.col("b"))).select("range").collect()]
        if not open_:
            break
    return sorted(open_)


def tree_diff(spark: SparkSession, old: str, new: str, key: str = "page_id") -> DataFrame:
    """key, change (added, deleted, modified) between two states, as `incremental.changes` over all rows gives it; equal ranges aren't read."""
    ranges = differing(spark, old, new)

    def part(path: str) -> DataFrame:
        rows = _rows(spark, path)
        if len(ranges) <= NAMED:
            return rows.filter(F.col("range").isin(ranges) if ranges else F.lit(False))
        return rows.join(F.broadcast(spark.createDataFrame([(r,) for r in ranges], "range string")), "range", "left_semi")  # at most 16 ** digits rows

    return changes(part(old), part(new), "key", "digest").withColumnRenamed("key", key)
