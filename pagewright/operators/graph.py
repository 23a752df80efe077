"""The weighted graph that evidence spreads over, and chains of versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions import fixed
from pagewright.operators.links import weak_degree
from pagewright.plans.cut import cut


def adjacency(resolved: DataFrame, fanout: int = fixed.FANOUT, damp: bool = True, of: DataFrame | None = None) -> DataFrame:
    """src, dst, w, own_block: links in both directions with the weight of the strongest, weak ones damped by the receiver's degree.

    Supersedes links carry no weight, but count where own_block is the block of the first link from src to dst. Each page
    keeps its `fanout` strongest neighbours. With `of` (page_id) only the rows of these pages are made, from the links that they and their neighbours have.
    """
    r = resolved.filter("dst IS NOT NULL")
    every = resolved
    if of is not None:
        r = cut(touching(r, of))
        every = cut(touching(resolved.filter("dst IS NOT NULL"), r.select("page_id").union(r.select("dst")).distinct()))
    own = r.groupBy("page_id", "dst").agg(F.min_by("block_id", "ord").alias("own_block"))
    w = F.when(F.col("kind") == "related", fixed.RELATED_WEIGHT).otherwise(fixed.OTHER_WEIGHT)
    both = r.filter("kind <> 'supersedes'").select(F.explode(F.array(F.struct(F.col("page_id").alias("src"), F.col("dst").alias("dst")), F.struct(F.col("dst").alias("src"), F.col("page_id").alias("dst")))).alias("e"), w.alias("w"))
    pairs = both.groupBy("e.src", "e.dst").agg(F.max("w").alias("w"))
    if of is not None:
        pairs = pairs.join(of.select(F.col("page_id").alias("src")), "src", "left_semi")
    if damp:
        into = weak_degree(every).withColumnRenamed("page_id", "dst")
        pairs = pairs.join(into, "dst", "left").withColumn("w", F.when(F.col("w") < 1, F.round(F.col("w") / (1 + F.log(F.greatest(F.coalesce("weak_in", F.lit(1)), F.lit(1)).cast("double"))), 6)).otherwise(F.col("w")))
    n = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("w"), "dst"))
    top = pairs.withColumn("n", n).filter(F.col("n") <= fanout)
    named = own.select(F.col("page_id").alias("src"), "dst", "own_block")
    return top.join(named, ["src", "dst"], "left").select("src", "dst", "w", F.coalesce("own_block", F.lit("")).alias("own_block"))


def touching(resolved: DataFrame, pages: DataFrame) -> DataFrame:
    """The links (with dst) that have one of the pages at either end, each once."""
    near = pages.select(F.col("page_id").alias("p_"), F.lit(True).alias("at_"))
    rows = resolved.join(near.select(F.col("p_").alias("page_id"), F.col("at_").alias("from_")), "page_id", "left").join(near.select(F.col("p_").alias("dst"), F.col("at_").alias("to_")), "dst", "left")
    return rows.filter("from_ OR to_").select(*resolved.columns)


def versions_around(supersedes: DataFrame, pages: DataFrame) -> DataFrame:
    """page_id of all pages that chains of the links (page_id, dst) join to the given ones: their components."""
    ways = cut(supersedes.select("page_id", "dst").union(supersedes.select("dst", "page_id")).distinct())
    found = cut(pages.select("page_id").distinct())
    edge = found
    while True:  # a round for each step away from the pages, chains being short; only new pages go on
        edge = cut(ways.join(edge, "page_id", "left_semi").select(F.col("dst").alias("page_id")).distinct().join(found, "page_id", "left_anti"))
        if edge.isEmpty():
            return found
        found = cut(found.union(edge))


def chains(resolved: DataFrame) -> DataFrame:
    """page_id, head, state: where following the newer version leads, for all pages that have one.

    Of several newer versions the least is followed, and the state is fork for all that lead there; a page that leads into a
    circle is its own head with the state cycle. Pointers are doubled, so the rounds grow with the logarithm of the longest chain.
    """
    newer = resolved.filter("kind = 'supersedes' AND dst IS NOT NULL").select(F.col("dst").alias("page_id"), F.col("page_id").alias("newer")).distinct()
    step = newer.groupBy("page_id").agg(F.min("newer").alias("to"), (F.count("*") > 1).alias("fork"))
    step = cut(step)
    n = step.count()
    walk = step.select("page_id", "to", "fork")
    rounds = max(1, n.bit_length() + 1)
    for i in range(rounds):
        ahead = walk.select(F.col("page_id").alias("to"), F.col("to").alias("further"), F.col("fork").alias("fork_ahead"))
        walk = walk.join(ahead, "to", "left").select("page_id", F.coalesce("further", "to").alias("to"), (F.col("fork") | F.coalesce("fork_ahead", F.lit(False))).alias("fork"), F.col("further").isNotNull().alias("moved"))
        walk = cut(walk)
        if walk.filter("moved").isEmpty():
            break
        walk = walk.drop("moved")
    # what still moves after that many doublings goes round in a circle
    open_ = walk.drop("moved").join(step.select(F.col("page_id").alias("to")), "to", "left_semi").select("page_id", F.lit(True).alias("circle"))
    out = walk.join(open_, "page_id", "left")
    circle = F.coalesce("circle", F.lit(False))
    return out.select("page_id", F.when(circle, F.col("page_id")).otherwise(F.col("to")).alias("head"), F.when(circle, "cycle").when(F.col("fork"), "fork").otherwise("stale").alias("state"))


def superseding_blocks(resolved: DataFrame) -> DataFrame:
    """page_id, sup_block: the block of a page's first supersedes link."""
    return resolved.filter("kind = 'supersedes' AND dst IS NOT NULL").groupBy("page_id").agg(F.min_by("block_id", "ord").alias("sup_block"))
