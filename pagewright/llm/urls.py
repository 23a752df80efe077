"""URL filters: a temporal join of captures with dated list entries.

Lists change: an entry adds a pattern to a list or removes it on a date. Per list and pattern these entries become validity
intervals, each ending where the next entry begins. A capture is judged by the entries that were active when it was
fetched: its URL gives the patterns that could match it (the host with and without its left labels, and the host with each leading part
of the path), and an as-of join finds for each the interval that holds the fetch time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.common import checkpointed

#: Intervals (of some 100 bytes) that are broadcast at most; more meet the captures in a shuffle that is split where a pattern is hot.
FEW = 50_000
#: Captures of one pattern that meet in one task; a pattern that more captures try is split into shares of so many.
SHARE = 100_000
#: Patterns that are split at most: shares grow with the number of captures so that there can't be more.
HOT = 10_000
#: A list whose active entries let a capture through whatever other lists say.
ALLOW = "allow"


def host_of(url: Column) -> Column:
    """Lower-case host: without scheme, user, port and closing dot. Empty where there is none."""
    rest = F.regexp_replace(F.trim(url), "^[A-Za-z][A-Za-z0-9+.-]*:", "")
    authority = F.regexp_extract(F.regexp_replace(rest, "^//", ""), "^[^/?#]*", 0)
    bare = F.regexp_replace(F.regexp_replace(authority, "^.*@", ""), ":[0-9]*$", "")
    return F.regexp_replace(F.lower(bare), "[.]+$", "")


def path_of(url: Column) -> Column:
    """The path with its leading slash, without query and fragment; / where there is none."""
    rest = F.regexp_replace(F.regexp_replace(F.trim(url), "^[A-Za-z][A-Za-z0-9+.-]*:", ""), "^//", "")
    path = F.regexp_extract(rest, "^[^/?#]*(/[^?#]*)", 1)
    return F.when(path == "", "/").otherwise(path)


def patterns_of(host: Column, path: Column) -> Column:
    """All patterns that match: host suffixes at label borders, and host + leading segments of the path."""
    labels = F.split(host, "[.]")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    prefixes = F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(parts, 1, i), "/")))).otherwise(F.array().cast("array<string>"))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(suffixes, prefixes)))


def intervals(entries: DataFrame) -> DataFrame:
    """list, pattern, since, until (null: open) from entries (list, pattern, at, action: add or remove).

    At one time a removal counts after an addition; an addition of what is active and a removal of what isn't change nothing;
    entries without a list, pattern, time or known action are ignored.
    """
    valid = entries.filter("list IS NOT NULL AND pattern IS NOT NULL AND at IS NOT NULL AND action IN ('add', 'remove')")
    # of several entries of one time the last action holds
    once = valid.groupBy("list", F.lower("pattern").alias("pattern"), "at").agg(F.max("action").alias("action"))
    w = Window.partitionBy("list", "pattern").orderBy("at")
    changes = once.withColumn("was", F.lag("action").over(w)).filter("NOT action <=> was")
    return changes.withColumn("until", F.lead("at").over(w)).filter("action = 'add'").select("list", "pattern", F.col("at").alias("since"), "until")


def _split_join(tried: DataFrame, active: DataFrame, holds: Column) -> DataFrame:
    """`tried` with the intervals of `active` that hold (nulls where none does), in a shuffle by pattern.

    Every capture below `com` tries `com`, whether or not it is a pattern. What many captures try is split into as many shares as
    their number asks for, and only its own intervals are sent to each share.
    """
    share = max(SHARE, tried.count() // HOT)
    hot = tried.filter("try_ IS NOT NULL").groupBy("try_").count().filter(F.col("count") > share)
    # fewer than HOT rows, as each stands for more than a HOT-th of all that is tried
    hot = F.broadcast(checkpointed(hot.select(F.col("try_").alias("hot_"), F.ceil(F.col("count") / share).cast("int").alias("shares_"))))
    number = F.coalesce("shares_", F.lit(1))
    shares = active.join(hot, F.col("pattern") == F.col("hot_"), "left").withColumn("salt_", F.explode(F.sequence(F.lit(0), number - 1))).drop("hot_", "shares_")
    mine = tried.join(hot, F.col("try_") == F.col("hot_"), "left").withColumn("mine_", F.when(F.col("try_").isNull(), F.col("row_")).otherwise(F.pmod(F.xxhash64("row_"), number.cast("long")))).drop("hot_", "shares_")
    return mine.join(shares, (F.col("try_") == F.col("pattern")) & (F.col("mine_") == F.col("salt_")) & holds, "left")


def filter_urls(captures: DataFrame, entries: DataFrame, key: str = "page_id", url: str = "url", at: str = "fetched") -> DataFrame:
    """One row per capture: key, host, lists (of active entries, sorted, joined by commas), pattern (the longest, then first, that matched), blocked.

    A capture is blocked if an entry of any list but ALLOW is active and none of ALLOW. A null or empty URL has no host and no patterns; a null
    time is in no interval: neither is blocked. Repeated rows and null keys are judged row by row; an empty table gives no rows.
    """
    active = intervals(entries)
    u = F.coalesce(F.col(url).cast("string"), F.lit(""))
    rows = captures.select(F.monotonically_increasing_id().alias("row_"), F.col(key).alias("key_"), host_of(u).alias("host"), path_of(u).alias("path_"), F.col(at).alias("at_"))
    tried = rows.select("row_", "key_", "host", "at_", F.explode_outer(patterns_of(F.col("host"), F.col("path_"))).alias("try_"))
    holds = (F.col("at_") >= F.col("since")) & (F.col("until").isNull() | (F.col("at_") < F.col("until")))
    if active.limit(FEW + 1).count() <= FEW:
        joined = tried.join(F.broadcast(active), (F.col("try_") == F.col("pattern")) & holds, "left")
    else:
        joined = _split_join(tried, active, holds)
    best = F.min(F.when(F.col("pattern").isNotNull(), F.struct((-F.length("pattern")).alias("n"), F.col("pattern").alias("p"))))
    judged = joined.groupBy("row_", "key_", "host").agg(F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists"), best.alias("b"), F.max(F.col("list") != ALLOW).alias("bad"), F.max(F.col("list") == ALLOW).alias("good"))
    return judged.select(F.col("key_").alias(key), "host", "lists", F.col("b.p").alias("pattern"), (F.coalesce("bad", F.lit(False)) & ~F.coalesce("good", F.lit(False))).alias("blocked"))
