"""Mixing sources to target weights by a Pfair schedule.

Rows of a source are put into blocks of a fixed number of rows. With weight w (a share of Q units), block i of a source may
start at slot floor(i * Q / w) and must be done by slot ceil((i + 1) * Q / w). Earliest deadline first over these release times
and deadlines meets them all, so that after any number of slots a source is less than one block away from its share. The
schedule repeats after Q slots, so it is computed once for Q slots (a number that depends on the weights, not on the
data), and block b of a source takes the slot of block b mod w in period b div w. Where a source has run out its slots stay
empty, and the others keep their proportions; no row is dropped or repeated.

Rows are numbered within their source without gathering a source in one task: a source is cut into ranges of a hash, ranges
are counted, and a row's number is what lies in the ranges before plus its place in its own.
"""

from __future__ import annotations

import heapq
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.common import checkpointed

#: Rows of a block, slots of a period at least, exponent that flattens the sources' own sizes where no weights are given.
BLOCK_ROWS = 16
PERIOD = 1000
ALPHA = 0.7
#: Rows of a hash range, about.
RANGE_ROWS = 20_000
LEAST_RANGES = 64
#: Columns that `mix` adds.
RESULT = ("block", "slot", "place", "release", "deadline")
#: Sources that a schedule is made for at most: it is made on the driver, with some 4 slots for each, and broadcast.
SOURCES = 10_000


def units(weights: dict, period: int = PERIOD) -> dict:
    """Whole units that sum to the period, by largest remainder, one at least for each weight; ties by the key's text."""
    period = max(period, 4 * len(weights))
    total = sum(weights.values())
    share = {k: (w / total if total > 0 else 1 / len(weights)) * period for k, w in weights.items()}
    out = {k: max(1, int(s)) for k, s in share.items()}
    order = sorted(weights, key=lambda k: (-(share[k] - out[k]), str(k)))
    while (gap := period - sum(out.values())) > 0:
        for k in order[:gap]:
            out[k] += 1
    while (gap := sum(out.values()) - period) > 0:  # units that went to weights of less than one come from the largest
        out[max(out, key=lambda k: (out[k], str(k)))] -= 1
    return out


def schedule(unit: dict) -> list[tuple]:
    """(key, block, slot, release, deadline) for each block of one period, by slot."""
    period = sum(unit.values())
    coming = sorted((i * period // u, -(-(i + 1) * period // u), str(k), i, k) for k, u in unit.items() for i in range(u))
    ready: list[tuple] = []
    out, at = [], 0
    for slot in range(period):
        while at < len(coming) and coming[at][0] <= slot:
            release, deadline, name, i, k = coming[at]
            heapq.heappush(ready, (deadline, name, i, release, at, k))
            at += 1
        deadline, _, i, release, _, k = heapq.heappop(ready)
        out.append((k, i, slot, release, deadline))
    return out


def numbered(rows: DataFrame, source: str, most: int, order: list[Column]) -> DataFrame:
    """`rows` with n: the number (from 0) of a row in its source, by a hash of `order` and then `order`. No column of `rows` has a name of one letter or a word; `most` rows have one source at most."""
    # as many ranges for each source as hold RANGE_ROWS of the largest on average, and so many that a hot source is spread at any size
    ranges = most // RANGE_ROWS + LEAST_RANGES
    h = rows.select("*", F.xxhash64(*order).alias("h"))
    h = h.withColumn("r", F.floor((F.shiftrightunsigned("h", 32) * ranges) / (1 << 32)).cast("int"))
    counts = checkpointed(h.groupBy(F.col(source).alias("s"), "r").count())
    before = F.coalesce(F.sum("count").over(Window.partitionBy("s").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = counts.select("s", F.col("r").alias("q"), before.alias("before"))
    place = F.row_number().over(Window.partitionBy(source, "r").orderBy(F.shiftrightunsigned("h", 1), "h", *order))
    joined = h.withColumn("p", place).join(before, F.col(source).eqNullSafe(F.col("s")) & (F.col("r") == F.col("q")), "left")
    return joined.select(*rows.columns, (F.col("before") + F.col("p") - 1).alias("n"))


def mix(df: DataFrame, key: str = "doc_id", source: str = "source", weights: dict | None = None, block_rows: int = BLOCK_ROWS, period: int = PERIOD, tie: str | None = "text") -> DataFrame:
    """`df` with block, slot, place, release and deadline; sorting by (slot, place) gives the mixture.

    `weights` are any positive numbers by source; a source that they lack gets one unit. Without weights they are the sources' row counts
    to the power ALPHA. A null source is a source of its own. Rows of one source come in the order of a hash of their key, then of the
    key and of column `tie`; of wholly equal rows any may come first. An empty table gives no rows. Columns of `df` that are named
    like a result are replaced. More than SOURCES sources are an error.
    """
    df = df.drop(*RESULT)
    counts = {r[0]: r[1] for r in df.groupBy(source).count().limit(SOURCES + 1).collect()}
    if len(counts) > SOURCES:
        raise ValueError(f"{source} has more than {SOURCES} values: weights and a schedule are for sources, not for single documents")
    if not counts:
        return df.select("*", *(F.lit(0).cast("long").alias(c) for c in RESULT))
    chosen = {k: (n**ALPHA if weights is None else weights.get(k, 0)) for k, n in counts.items()}
    unit = units(chosen, period)
    q = sum(unit.values())
    plan = json.dumps([{"s": k, "u": unit[k], "i": i, "at": t, "rel": r, "due": d} for k, i, t, r, d in schedule(unit)])
    kind = df.schema[source].dataType.simpleString()
    told = lambda rows, fields: df.sparkSession.range(1).select(F.inline(F.from_json(F.lit(rows), f"array<struct<{fields}>>")))
    table = told(plan, f"s:{kind},u:bigint,i:bigint,at:bigint,rel:bigint,due:bigint")
    share = told(json.dumps([{"w": k, "units": u} for k, u in unit.items()]), f"w:{kind},units:bigint")

    # the caller's columns have numbers here, so that no name of theirs meets one from here, and each can still be pruned
    names = {c: f"column{i}" for i, c in enumerate(df.columns)}
    rows = df.toDF(*names.values())
    order = [F.col(names[key])] + ([F.xxhash64(names[tie])] if tie and tie in names else [])
    n = numbered(rows, names[source], max(counts.values()), order).withColumn("block", F.floor(F.col("n") / block_rows)).withColumn("place", F.col("n") % block_rows)
    # both tables have at most q rows, which the weights bound
    n = n.join(F.broadcast(share), F.col(names[source]).eqNullSafe(F.col("w")))
    n = n.join(F.broadcast(table), F.col(names[source]).eqNullSafe(F.col("s")) & (F.col("block") % F.col("units") == F.col("i")))
    start = F.floor(F.col("block") / F.col("units")) * q
    return n.select(*(F.col(to).alias(c) for c, to in names.items()), "block", (start + F.col("at")).alias("slot"), "place", (start + F.col("rel")).alias("release"), (start + F.col("due")).alias("deadline"))
