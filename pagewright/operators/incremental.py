"""Changes of pages, and an index that follows them. What comes out equals an index built anew."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.functions import fixed
from pagewright.functions import text as T
from pagewright.operators import graph
from pagewright.operators import index as I
from pagewright.operators import links as L
from pagewright.plans.cut import cut
from pagewright.sources.tables import KnowledgeBase


def changes(old: DataFrame, new: DataFrame, key: str = "page_id", digest: str = "sha256") -> DataFrame:
    """key, change (added, deleted, modified) between two tables of digests; equal ones have no row. Times don't count, only digests."""
    o = old.select(key, F.col(digest).alias("o"))
    n = new.select(key, F.col(digest).alias("n"))
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "deleted").otherwise("modified")
    return o.join(n, key, "full").filter(~F.col("o").eqNullSafe(F.col("n"))).select(key, change.alias("change"))


def upsert(state: DataFrame, batch: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key of both tables, by `order`; of one batch the last one counts."""
    cols = [c for c in state.columns if c != key]
    every = state.unionByName(batch.select(*state.columns))
    return every.groupBy(key).agg(F.max_by(F.struct(*cols), order).alias("r")).select(key, "r.*").select(*state.columns)


def merged(table: DataFrame, gone: DataFrame, delta: DataFrame, key: str = "page_id") -> DataFrame:
    """`table` without the rows of the keys in `gone` and with those of `delta`: read together, not written."""
    return table.join(gone.select(key), key, "left_anti").unionByName(delta.select(*table.columns))


def _relinked(index: I.Index, kb: KnowledgeBase, changed: DataFrame) -> DataFrame:
    """page_id of unchanged pages whose links lead elsewhere, because keys of changed pages came, went or passed to another page."""
    old, new = L.page_keys(index.pages.join(changed, "page_id", "left_semi")), L.page_keys(kb.pages.join(changed, "page_id", "left_semi"))
    cols = ["key", "prio", "page_id"]
    moved = cut(old.select(*cols).exceptAll(new.select(*cols)).union(new.select(*cols).exceptAll(old.select(*cols))).select("key").distinct())
    if moved.isEmpty():
        return moved.select(F.col("key").alias("page_id"))
    leads = L.page_keys(kb.pages).join(moved, "key", "left_semi").groupBy("key").agg(F.min_by("page_id", F.struct("prio", "page_id")).alias("to"))
    rows = index.links.join(moved, "key", "left_semi").join(changed, "page_id", "left_anti").join(leads, "key", "left")
    to = F.when(F.col("to") != F.col("page_id"), F.col("to"))
    return rows.filter(~to.eqNullSafe(F.col("dst"))).select("page_id").distinct()


def _resolved(kb: KnowledgeBase, touched: DataFrame) -> DataFrame:
    """The links of the touched pages with key and dst, by the keys that they name alone."""
    keyed = cut(kb.links.join(touched, "page_id", "left_semi").withColumn("key", T.link_key("target")))
    named = keyed.select("key").distinct()
    leads = L.page_keys(kb.pages).join(named, "key", "left_semi").groupBy("key").agg(F.min_by("page_id", F.struct("prio", "page_id")).alias("dst"))
    return keyed.join(leads, "key", "left").withColumn("dst", F.when(F.col("dst") != F.col("page_id"), F.col("dst")))


def apply(index: I.Index, kb: KnowledgeBase, changed: DataFrame, clean=None) -> I.Index:
    """The index of `kb`, from that of an earlier state and the pages that changed since (page_id).

    Changes go on along what depends on them and no further: keys that came, went or passed on touch the pages whose links they resolve;
    links that changed touch the weights of their ends and of the neighbours of ends whose degree changed, and the components
    of chains that they belong to; blocks are tokenised again where their page changed or their anchors did. All that is
    written are the rows of touched pages. The tables that come out read these together with the older ones, without the touched
    pages' rows; `I.settled` writes them whole, which is due when many updates have piled up.
    """
    changed = cut(changed.select("page_id").distinct())
    touched = cut(changed.union(_relinked(index, kb, changed)))
    links = cut(_resolved(kb, touched).select(*index.links.columns))
    before = cut(index.links.join(touched, "page_id", "left_semi"))
    resolved = merged(index.links, touched, links)

    old_anchors, new_anchors = I.anchors(before), I.anchors(links)
    moved = old_anchors.exceptAll(new_anchors).union(new_anchors.exceptAll(old_anchors)).select("page_id")
    again = cut(changed.union(moved).distinct())
    part = KnowledgeBase(kb.pages.join(again, "page_id", "left_semi"), kb.blocks.join(again, "page_id", "left_semi"), links)
    fresh = cut(I.indexed_blocks(part, links, clean))
    new = cut(I.postings(fresh))
    blocks = merged(index.blocks, again, fresh)

    # terms, and the figures of the whole, by what goes and what comes
    gone = index.postings.join(again, "page_id", "left_semi")
    shift = lambda rows, sign: rows.groupBy("term").agg((sign * F.count("*")).alias("by"))
    shifts = cut(shift(gone, -1).unionByName(shift(new, 1)).groupBy("term").agg(F.sum("by").alias("by")).filter("by <> 0"))
    terms = shifts.join(index.terms, "term", "left").select("term", (F.coalesce("df", F.lit(0)) + F.col("by")).alias("df")).filter("df > 0")
    figures = lambda b, p, sign: b.agg(F.count("*").alias("b"), F.coalesce(F.sum("len"), F.lit(0)).alias("l")).crossJoin(p.agg(F.count("*").alias("p"))).select(*((sign * F.col(c)).alias(c) for c in "blp"))  # noqa: E731  one row each
    by = figures(fresh, kb.pages.join(changed, "page_id", "left_semi"), 1).union(figures(index.blocks.join(again, "page_id", "left_semi"), index.pages.join(changed, "page_id", "left_semi"), -1)).agg(*(F.sum(c).alias(c) for c in "blp"))
    stats = I.averages(index.stats.select("n_pages", "n_blocks", "total_len").crossJoin(by).select((F.col("n_pages") + F.col("p")).alias("n_pages"), (F.col("n_blocks") + F.col("b")).alias("n_blocks"), (F.col("total_len") + F.col("l")).alias("total_len")))

    # links that went or came, and what hangs on them
    cols = ["page_id", "dst", "kind", "block_id", "ord"]
    led = lambda rows: rows.filter("dst IS NOT NULL").select(*cols)
    moves = cut(led(before).exceptAll(led(links)).union(led(links).exceptAll(led(before))))
    heads, adjacency, refolded = index.heads, index.adjacency, touched
    if not moves.isEmpty():
        ends = lambda rows: rows.select("page_id").union(rows.select("dst")).distinct()
        versions = moves.filter("kind = 'supersedes'")
        if not versions.isEmpty():
            every = resolved.filter("kind = 'supersedes' AND dst IS NOT NULL")
            region = graph.versions_around(every.select("page_id", "dst").union(versions.select("page_id", "dst")), ends(versions))
            heads = merged(heads, region, cut(graph.chains(every.join(region, "page_id", "left_semi"))))
            refolded = cut(touched.union(region).distinct())
        weaker = ends(moves.filter(~F.col("kind").isin(*fixed.CURATED)))
        around = graph.touching(index.links.filter("dst IS NOT NULL").select("page_id", "dst").union(led(links).select("page_id", "dst")), cut(weaker))
        near = cut(ends(moves).union(ends(around)).distinct())
        rows = cut(graph.adjacency(resolved, of=near))
        adjacency = merged(adjacency, near.withColumnRenamed("page_id", "src"), rows, "src")

    mine = lambda rows: rows.join(refolded, "page_id", "left_semi")
    facts = I.with_heads(I.page_facts(mine(kb.pages), mine(kb.blocks), mine(blocks)), mine(heads), mine(resolved))
    pages = merged(index.pages, refolded, cut(facts.select(*index.pages.columns)))
    return I.Index(pages, blocks, merged(index.postings, again, new), merged(index.terms, shifts, cut(terms), "term"), cut(stats), resolved, adjacency, heads)


def migrate(pages: DataFrame, steps: dict, target: str) -> DataFrame:
    """Pages of older schema versions, taken through `steps` ({version: (next version, function of a DataFrame)}) to the target.

    Newer or unknown versions fail rather than being written.
    """
    known = [target]
    for version, (following, change) in steps.items():
        known.append(version)
        at = pages.filter(F.col("schema_version") == version)
        pages = pages.filter(~F.col("schema_version").eqNullSafe(version)).unionByName(change(at).withColumn("schema_version", F.lit(following)))
    stray = F.raise_error(F.concat(F.lit("unknown schema version "), F.coalesce("schema_version", F.lit("null"))))
    return pages.withColumn("schema_version", F.when(F.col("schema_version") == target, F.col("schema_version")).otherwise(stray))
