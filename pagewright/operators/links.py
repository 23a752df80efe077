"""Link resolution, display edges and degrees."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions import fixed
from pagewright.functions import text as T


def page_keys(pages: DataFrame) -> DataFrame:
    """key, prio, page_id: ids and slugs come before titles; empty keys name nothing."""
    keys = F.array(*(F.struct(T.link_key(c).alias("key"), F.lit(p).alias("prio")) for c, p in (("page_id", 0), ("slug", 0), ("title", 1))))
    return pages.select("page_id", F.explode(F.array_distinct(keys)).alias("k")).select("k.key", "k.prio", "page_id").filter("key <> ''")


def lookup(pages: DataFrame) -> DataFrame:
    """The page that each key means: of equal keys the one of least prio, then of least page_id."""
    return page_keys(pages).groupBy("key").agg(F.min_by("page_id", F.struct("prio", "page_id")).alias("dst"))


def resolve(links: DataFrame, pages: DataFrame) -> DataFrame:
    """`links` with key and dst (null where nothing has the key, or where it is the page itself)."""
    keyed = links.withColumn("key", T.link_key("target"))
    found = keyed.join(lookup(pages), "key", "left")
    return found.withColumn("dst", F.when(F.col("dst") != F.col("page_id"), F.col("dst")))


def implied(pages: DataFrame, declared: DataFrame, blocks: DataFrame, supersedes: str | None = None, related: str | None = None) -> DataFrame:
    """All links of pages: declared ones, then new [[links]] of the blocks in order, then new sources, supersedes and related.

    Declared links stay as they are, repeated or not; others are added once for each key and kind. References to users and raw
    files are no links.
    """
    body = blocks.select("page_id", "pos", "block_id", F.posexplode(T.refs_in("text")).alias("i", "target"))
    body = body.select("page_id", F.lit(1).alias("part"), F.col("pos").alias("a"), F.col("i").alias("b"), "target", F.lit("wiki").alias("kind"), "block_id")
    refs = [("sources", "source")] + [(c, k) for c, k in ((supersedes, "supersedes"), (related, "related")) if c]
    parts = [body]
    for n, (column, kind) in enumerate(refs):
        r = pages.select("page_id", F.posexplode(column).alias("i", "ref")).withColumn("p", T.ref_parts("ref"))
        r = r.filter(~F.col("p.prefix").isin("user", "raw") & (F.col("p.target") != ""))
        parts.append(r.select("page_id", F.lit(2).alias("part"), F.lit(n).alias("a"), F.col("i").alias("b"), F.col("p.target").alias("target"), F.lit(kind).alias("kind"), F.lit("").alias("block_id")))
    new = parts[0]
    for x in parts[1:]:
        new = new.unionByName(x)
    own = declared.filter(F.trim("target") != "").select("page_id", F.lit(0).alias("part"), F.col("ord").alias("a"), F.lit(0).alias("b"), "target", "kind", F.coalesce("block_id", F.lit("")).alias("block_id"))
    every = own.unionByName(new).withColumn("key", T.link_key("target"))
    first = F.row_number().over(Window.partitionBy("page_id", "key", "kind").orderBy("part", "a", "b"))
    kept = every.withColumn("n", first).filter("part = 0 OR (n = 1 AND key <> '')")
    order = F.row_number().over(Window.partitionBy("page_id").orderBy("part", "a", "b")) - 1
    return kept.select("page_id", order.alias("ord"), "target", "kind", F.col("target").alias("label"), F.lit("").alias("anchor"), "block_id")


def display_edges(resolved: DataFrame) -> DataFrame:
    """edge_id, source, target, kind: one edge for each ordered pair of pages, with the kind of its first link."""
    pairs = resolved.filter("dst IS NOT NULL").groupBy("page_id", "dst").agg(F.min_by("kind", "ord").alias("kind"))
    return pairs.select(T.edge_id("page_id", "dst").alias("edge_id"), F.col("page_id").alias("source"), F.col("dst").alias("target"), "kind")


def degrees(pages: DataFrame, edges: DataFrame) -> DataFrame:
    """page_id, incoming, outgoing, degree, orphan."""
    ends = edges.select(F.col("source").alias("page_id"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionAll(edges.select("target", F.lit(1), F.lit(0)))
    counted = ends.groupBy("page_id").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
    d = pages.select("page_id").join(counted, "page_id", "left").na.fill(0, ["i", "o"])
    return d.select("page_id", F.col("i").alias("incoming"), F.col("o").alias("outgoing"), (F.col("i") + F.col("o")).alias("degree"), (F.col("i") + F.col("o") == 0).alias("orphan"))


def weak_degree(resolved: DataFrame) -> DataFrame:
    """page_id, weak_in: how many links that aren't curated touch a page at either end."""
    weak = resolved.filter(F.col("dst").isNotNull() & ~F.col("kind").isin(*fixed.CURATED))
    return weak.select("page_id").unionAll(weak.select("dst")).groupBy("page_id").agg(F.count("*").alias("weak_in"))


def dangling(resolved: DataFrame, pages: DataFrame) -> DataFrame:
    """Links whose key no page has."""
    return resolved.join(lookup(pages).select("key"), "key", "left_anti").select("page_id", "ord", "target", "kind")


def neighbours(resolved: DataFrame, selected: DataFrame) -> DataFrame:
    """page_id of the pages that are linked with the selected ones in either direction, without these."""
    r = resolved.filter("dst IS NOT NULL").select("page_id", "dst")
    out = r.join(selected, "page_id", "left_semi").select(F.col("dst").alias("page_id"))
    into = r.join(selected.withColumnRenamed("page_id", "dst"), "dst", "left_semi").select("page_id")
    return out.union(into).distinct().join(selected, "page_id", "left_anti")


def edges_of_blocks(resolved: DataFrame, blocks: DataFrame) -> DataFrame:
    """block_id, kind, dst, back: curated links of blocks, with the block of the first link back (or an empty one)."""
    r = resolved.filter("dst IS NOT NULL")
    back = r.groupBy(F.col("page_id").alias("dst"), F.col("dst").alias("page_id")).agg(F.min_by("block_id", "ord").alias("back"))
    own = r.filter(F.col("kind").isin(*fixed.CURATED) & (F.col("block_id") != "")).join(blocks.select("block_id"), "block_id", "left_semi")
    return own.join(back, ["page_id", "dst"], "left").select("page_id", "block_id", "kind", "dst", F.coalesce("back", F.lit("")).alias("back"))
