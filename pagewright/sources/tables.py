"""The knowledge base that the driver's tables hold, and how any tables become one.

A knowledge base is three DataFrames:

pages   page_id, slug, title, type, created, updated, tags, keywords, projects, sources, summary
blocks  page_id, pos, block_id, kind, text, level, unresolved (pos gives the order within a page)
links   page_id, ord, target, kind, label, anchor, block_id (declared, body and curated links, in order)
"""

from __future__ import annotations

from functools import cached_property
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.plans.cut import cut


class KnowledgeBase(NamedTuple):
    pages: DataFrame
    blocks: DataFrame
    links: DataFrame


class Deferred:
    """The tables of `KnowledgeBase`, by the same names, each written once and only when it is first asked for."""

    def __init__(self, derived: KnowledgeBase):
        self.derived = derived

    @cached_property
    def pages(self) -> DataFrame:
        return cut(self.derived.pages)

    @cached_property
    def blocks(self) -> DataFrame:
        return cut(self.derived.blocks)

    @cached_property
    def links(self) -> DataFrame:
        return cut(self.derived.links)

    def passed_over(self) -> KnowledgeBase:
        """The same tables for a reader that goes over the blocks once and writes what it makes of them: they aren't written for it."""
        return KnowledgeBase(self.pages, self.blocks_once(), self.links)

    def blocks_once(self) -> DataFrame:
        """The blocks of `passed_over`, without the other tables."""
        return self.blocks if "blocks" in vars(self) else self.derived.blocks


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents_as_pages(docs: DataFrame) -> DataFrame:
    """One page for each document: the first line is the title, doc_id gives type and date, lang the tag, source the project. A null text is an empty one."""
    r = F.col("doc_id") % 100
    kind = F.when(r < 50, "source").when(r < 75, "entity").when(r < 94, "synthesis").when(r < 99, "concept").otherwise("project")
    slug = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 365).cast("int")), "yyyy-MM-dd")
    none = F.array().cast("array<string>")
    return docs.filter("doc_id IS NOT NULL").withColumn("text", F.coalesce("text", F.lit(""))).select(
        "doc_id", F.concat(F.lit("page:"), slug).alias("page_id"), slug.alias("slug"), F.trim(F.substring_index("text", "\n", 1)).alias("title"), kind.alias("type"), day.alias("created"), day.alias("updated"),
        F.array("lang").alias("tags"), none.alias("keywords"), F.array("source").alias("projects"), none.alias("sources"), T.clip(F.col("text"), 240).alias("summary"), "text",
    )


def documents_as_blocks(pages: DataFrame, repeated: DataFrame | None = None) -> DataFrame:
    """Lines are blocks, the first is a heading; blank ones are dropped, equal ones get numbers.

    They are numbered within their document's row. Only of pages that several rows have (`repeated`, page_id) are lines dealt out for it.
    """
    if repeated is not None:
        one, several = pages.join(repeated, "page_id", "left_anti"), pages.join(repeated, "page_id", "left_semi")
        return documents_as_blocks(one).unionByName(_numbered_across(several))
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("pos"), x.alias("text"))), lambda x: F.trim(x["text"]) != "")
    kind = lambda pos: F.when(pos == 0, "heading").otherwise("paragraph")
    rows = pages.select("page_id", "slug", F.transform(lines, lambda x: F.struct(x["pos"].alias("pos"), x["text"].alias("text"), T.fingerprint(kind(x["pos"]), x["text"]).alias("print"))).alias("line"))
    rows = rows.withColumn("nth", T.occurrences(F.transform("line", lambda x: x["print"]))).select("page_id", "slug", F.explode(F.arrays_zip("line", "nth")).alias("b"))
    pos = F.col("b.line.pos")
    return rows.select("page_id", pos.alias("pos"), T.block_id("slug", F.col("b.line.print"), F.col("b.nth")).alias("block_id"), kind(pos).alias("kind"), F.col("b.line.text").alias("text"), F.when(pos == 0, 1).alias("level"), F.lit(False).alias("unresolved"))


def _numbered_across(pages: DataFrame) -> DataFrame:
    """Blocks of pages that have several rows each: equal lines are numbered across these."""
    lines = pages.select("page_id", "slug", F.posexplode(F.split("text", "\n")).alias("pos", "text")).filter(F.trim("text") != "")
    rows = lines.withColumn("kind", F.when(F.col("pos") == 0, "heading").otherwise("paragraph")).withColumn("print", T.fingerprint("kind", "text"))
    n = F.row_number().over(Window.partitionBy("page_id", "kind", "print").orderBy("pos"))
    return rows.select("page_id", "pos", T.block_id("slug", "print", n).alias("block_id"), "kind", "text", F.when(F.col("pos") == 0, 1).alias("level"), F.lit(False).alias("unresolved"))


def documents_as_links(pages: DataFrame) -> DataFrame:
    """Two wiki links by arithmetic, a related link to the source's next document, a supersedes link to the previous equal text. The last two have the column first of `pages`."""
    n = pages.agg(F.count("*").alias("n"))
    ids = pages.select("doc_id", "page_id", "projects", "first", F.sha2("text", 256).alias("sha"))
    to = lambda x: F.concat(F.lit("doc-"), x.cast("string"))
    wiki = ids.crossJoin(F.broadcast(n)).select("page_id", F.posexplode(F.array((F.col("doc_id") * 7 + 1) % F.col("n"), (F.col("doc_id") * 13 + 5) % F.col("n"))).alias("ord", "to"))  # one row of a count
    wiki = wiki.select("page_id", "ord", to(F.col("to")).alias("target"), F.lit("wiki").alias("kind"), F.lit(None).cast("string").alias("first"))
    # neighbours within a source: a source is cut into ranges so that no task gets a whole source
    related = _next(ids.select("doc_id", "page_id", "first", F.col("projects")[0].alias("source")), "source").filter("nxt IS NOT NULL").select("page_id", F.lit(2).alias("ord"), to(F.col("nxt")).alias("target"), F.lit("related").alias("kind"), "first")
    w = Window.partitionBy("sha").orderBy("doc_id")
    older = ids.select("doc_id", "page_id", "first", "sha").withColumn("old", F.lag("doc_id").over(w)).filter("old IS NOT NULL").select("page_id", F.lit(3).alias("ord"), to(F.col("old")).alias("target"), F.lit("supersedes").alias("kind"), "first")
    return wiki.unionByName(related).unionByName(older)


def _next(rows: DataFrame, by: str, size: int = 10_000) -> DataFrame:
    """`rows` with nxt: the next doc_id of the same group; ranges of doc_id are handled apart and stitched at their borders."""
    cut = rows.withColumn("range_", F.floor(F.col("doc_id") / size))
    inner = cut.withColumn("nxt", F.lead("doc_id").over(Window.partitionBy(by, "range_").orderBy("doc_id")))
    first = cut.groupBy(by, "range_").agg(F.min("doc_id").alias("first_"))
    after = first.withColumn("after_", F.lead("first_").over(Window.partitionBy(by).orderBy("range_"))).select(F.col(by).alias("by_"), F.col("range_").alias("r_"), "after_")
    return inner.join(after, F.col(by).eqNullSafe(F.col("by_")) & (F.col("range_") == F.col("r_")), "left").withColumn("nxt", F.coalesce("nxt", "after_")).drop("range_", "by_", "r_", "after_")


def from_documents(spark: SparkSession, sf_dir: str) -> KnowledgeBase:
    """The knowledge base of the table `documents`. Related and supersedes links hang on the first body block of their page."""
    pages = documents_as_pages(table(spark, sf_dir, "documents"))
    repeated = cut(pages.groupBy("page_id").agg(F.count("*").alias("n")).filter("n > 1").select("page_id"))
    if repeated.isEmpty():
        # the first line behind the heading that isn't blank: no earlier one is a paragraph, so it is the first of its kind
        line = F.get(F.filter(F.split("text", "\n"), lambda x, i: (i > 0) & (F.trim(x) != "")), F.lit(0))
        blocks, hung_on = documents_as_blocks(pages), pages.withColumn("first", F.when(line.isNotNull(), T.block_id("slug", T.fingerprint(F.lit("paragraph"), line), F.lit(1))))
    else:
        blocks = documents_as_blocks(pages, repeated)
        hung_on = pages.join(blocks.filter("pos > 0").groupBy("page_id").agg(F.min_by("block_id", "pos").alias("first")), "page_id", "left")
    links = documents_as_links(hung_on)
    hung = F.when(F.col("kind").isin("related", "supersedes"), F.coalesce("first", F.lit(""))).otherwise(F.lit(""))
    links = links.select("page_id", "ord", "target", "kind", F.col("target").alias("label"), F.lit("").alias("anchor"), hung.alias("block_id"))
    return KnowledgeBase(pages.drop("doc_id", "text"), blocks, links)


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qid and text of the benchmark's passages."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")
