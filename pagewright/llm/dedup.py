"""Exact deduplication by deterministic block naming.

A normalised text is cut into blocks of a fixed number of bytes. The distinct blocks are sorted, and each gets an integer name.
Then neighbours are joined two by two: the distinct pairs of names are sorted and get integer names in turn, until one name is
left of each document. Two documents get the same (level, name) exactly if their normalised texts are equal: names stand
for whole blocks and pairs, never for their hashes. Hashes only serve as the address under which a block's name is looked
up, and the run proves that they are distinct on its data, or else takes another seed.

All steps are DataFrame functions. Blocks are shuffled once, and only the distinct ones of each task; what is shuffled
after that are integers. Each level is cut off by a checkpoint, so that a lost executor can't lead to other names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import checkpointed

#: Bytes of a block.
BLOCK_BYTES = 2048
#: Names of a task on the levels above the blocks, about.
NAMES = 100_000
#: Deleted before texts are compared.
WHITE = "[\\x20\\x09-\\x0D]+"


def normalised(text: Column) -> Column:
    """The text without the six ASCII white-space characters; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, "")


def _blocks(raw: Column, size: int) -> Column:
    """Bytes in blocks of `size`; the last may be shorter, an empty text has one empty block."""
    last = F.floor(F.greatest(F.octet_length(raw) - 1, F.lit(0)) / size).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(raw, i * size + 1, F.lit(size)))


def _address(block: Column, seed: int) -> list[Column]:
    return [F.xxhash64(F.lit(2 * seed), block), F.xxhash64(F.lit(2 * seed + 1), block)]


def _named(keys: DataFrame, *cols: str) -> DataFrame:
    """Distinct keys with an integer `name` each: its place in its sorted partition, behind those of the partitions before it."""
    return keys.distinct().sortWithinPartitions(*cols).withColumn("name", F.monotonically_increasing_id())


def block_names(df: DataFrame, raw: str, carried: list[Column], size: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of `df`: the carried columns, level and name, which are equal exactly where the bytes in `raw` are."""
    for seed in range(64):
        blocks = df.select(F.explode(_blocks(F.col(raw), size)).alias("block"))
        names = checkpointed(_named(blocks, "block").select(*(h.alias(c) for h, c in zip(_address(F.col("block"), seed), ("h1", "h2"), strict=True)), "name"))
        if names.groupBy("h1", "h2").count().filter("count > 1").isEmpty():
            break
    else:
        raise RuntimeError("no seed gives distinct addresses")
    addresses = F.transform(_blocks(F.col(raw), size), lambda b: F.struct(*(h.alias(c) for h, c in zip(_address(b, seed), ("h1", "h2"), strict=True))))
    rows = checkpointed(df.select(F.monotonically_increasing_id().alias("row"), *carried, addresses.alias("blocks")))
    own = [c for c in rows.columns if c != "blocks"]
    at = rows.select("row", F.posexplode("blocks").alias("pos", "b")).select("row", "pos", "b.h1", "b.h2")
    at = at.join(names, ["h1", "h2"]).select("row", "pos", "name", F.lit(0).alias("level"))
    # rows with one block are done; `most` bounds the number of levels
    size_of = F.size("blocks")
    most, total = rows.agg(F.coalesce(F.max(size_of), F.lit(1)), F.coalesce(F.sum(size_of), F.lit(0))).first()
    rows = rows.select(*own, size_of.alias("n"))
    if most == 1:
        return rows.drop("n").join(at.select("row", "level", "name"), "row").drop("row")
    done, level = at.join(rows.filter("n = 1").select("row"), "row", "left_semi"), 0
    at = at.join(rows.filter("n > 1").select("row", "n"), "row")
    while most > 1:
        level += 1
        total = total // 2 + 1
        parts = max(8, total // NAMES)
        half = F.shiftright("pos", 1)
        side = lambda odd: F.max(F.when(F.col("pos") % 2 == odd, F.col("name")))
        pairs = checkpointed(at.groupBy("row", "n", half.alias("pos")).agg(side(0).alias("a"), F.coalesce(side(1), F.lit(-1)).alias("b")).coalesce(parts))
        at = pairs.join(_named(pairs.select("a", "b"), "a", "b"), ["a", "b"])
        at = checkpointed(at.select("row", F.shiftright(F.col("n") + 1, 1).alias("n"), "pos", "name", F.lit(level).alias("level")).coalesce(parts))
        done = done.unionByName(at.filter("n = 1").select("row", "pos", "name", "level"))
        at = at.filter("n > 1")
        most = (most + 1) // 2
    return rows.drop("n").join(done.select("row", "level", "name"), "row").drop("row")


def dedup_exact(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of `df`: its key, keep_id, group_size, kept, text_sha256 (of the normalised text).

    Of equal texts the row with the most code points in the original text, then with the smallest key, stays. A null
    text counts as empty, and empty texts are equal. A null key comes after all others; a repeated key with the same text is
    kept in each row (keep_id names the key), with each of its rows counted in group_size. An empty table gives
    no rows. Other columns are not read.
    """
    k = "key_"
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    texts = df.select(F.col(key).alias(k), F.char_length(t).alias("points"), normalised(t).cast("binary").alias("raw"))
    named = checkpointed(block_names(texts, "raw", [F.col(k), F.col("points"), F.sha2("raw", 256).alias("text_sha256")], size))
    # the least of (-points, key is null, key) is the row that stays; both sides are pre-aggregated before the shuffle
    first = F.min(F.struct((-F.col("points")).alias("p"), F.col(k).isNull().alias("null"), F.col(k).alias("k")))
    # (kept as a table of its own, the groups leave the join with a plain shuffle on either side, which Spark can split where one group is hot)
    groups = checkpointed(named.groupBy("level", "name").agg(first.alias("first"), F.count("*").alias("group_size")))
    return named.join(groups, ["level", "name"]).select(
        F.col(k).alias(key), F.col("first.k").alias("keep_id"), "group_size", F.col(k).eqNullSafe(F.col("first.k")).alias("kept"), "text_sha256"
    )
