"""Queries of addressing, context, changes and incremental maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright.operators import incremental
from pagewright.operators import index as I
from pagewright.plans import context
from pagewright.queries import query
from pagewright.queries.common import base, index
from pagewright.queries.evaluation import gold
from pagewright.queries.sql import sql
from pagewright.sources import json_pages, tables


@query(sql("SELECT page_id, block_id, 1 AS level, text, pos FROM blk WHERE kind = 'heading'", "blk"))
def outline(spark, d):
    return json_pages.outline(base(spark, d).blocks)


@query(sql("SELECT h.block_id AS heading_id, b.page_id, b.pos, b.block_id FROM blk b JOIN blk h ON h.page_id = b.page_id AND h.kind = 'heading'", "blk"))
def section_range(spark, d):
    return json_pages.sections(base(spark, d).blocks)


@query(sql("SELECT s AS selector, page_id FROM (SELECT 'doc-' || doc_id AS s, page_id FROM page UNION ALL SELECT 'Page:DOC_' || doc_id, page_id FROM page)", "page"))
def lookup_selector(spark, d):
    """Both spellings of every page."""
    p = base(spark, d).pages
    return json_pages.find_pages(p, p.select(F.col("slug").alias("selector")).union(p.select(F.concat(F.lit("Page:DOC_"), F.split_part("slug", F.lit("-"), F.lit(2))))))


@query(sql("SELECT block_id AS wanted, block_id FROM blk UNION SELECT print, arg_min(block_id, {'a': page_id, 'b': pos}) FROM blk GROUP BY print", "blk"))
def get_blocks(spark, d):
    """Every block by its id and by its fingerprint."""
    b = base(spark, d).blocks
    wanted = b.select(F.col("block_id").alias("wanted")).union(b.select(F.split_part("block_id", F.lit(":"), F.lit(3)).alias("wanted")))
    return json_pages.find_blocks(b, spark.createDataFrame([], "old_id string, block_id string"), wanted)


@query("""SELECT event_id, unnest(['/k', '/none', '/a~1b/0', '/a~1b/3', '/m~0n']) AS pointer, unnest([props->>'$.k', NULL, event_type, NULL, user_id::VARCHAR]) AS value FROM events""")
def json_pointer(spark, d):
    """What pointers find in the properties of each event, and in a record whose keys need escapes."""
    events = tables.table(spark, d, "events")
    record = F.parse_json(F.to_json(F.struct(F.array("event_type").alias("a/b"), F.col("user_id").cast("string").alias("m~n"))))
    at = lambda v, p: F.struct(F.lit(p).alias("pointer"), json_pages.pointer(v, p).cast("string").alias("value"))
    props = F.parse_json("props")
    rows = events.select("event_id", F.explode(F.array(at(props, "/k"), at(props, "/none"), at(record, "/a~1b/0"), at(record, "/a~1b/3"), at(record, "/m~0n"))).alias("x"))
    return rows.select("event_id", "x.pointer", "x.value")


@query("SELECT 'page:doc-' || doc_id AS page_id, CASE doc_id % 10 WHEN 0 THEN 'added' WHEN 1 THEN 'deleted' ELSE 'modified' END AS change FROM documents WHERE doc_id % 10 IN (0, 1, 2)")
def map_delta(spark, d):
    t = tables.table(spark, d, "documents").filter("doc_id IS NOT NULL").select("doc_id", F.concat(F.lit("page:doc-"), "doc_id").alias("page_id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))
    old = t.filter("doc_id % 10 <> 0")
    new = t.filter("doc_id % 10 <> 1").withColumn("sha256", F.when(F.col("doc_id") % 10 == 2, F.lit("other")).otherwise(F.col("sha256")))
    return incremental.changes(old, new)


@query("SELECT 'raw/' || doc_id || '.txt' AS rel FROM documents WHERE doc_id % 3 <> 0")
def pending_raw(spark, d):
    t = tables.table(spark, d, "documents")
    raw = t.select(F.concat(F.lit("raw/"), "doc_id", F.lit(".txt")).alias("rel"))
    refs = t.filter("doc_id % 3 = 0").select(F.concat(F.lit("raw:./x/raw/"), "doc_id", F.lit(".txt")).alias("ref"))
    return json_pages.pending(raw, refs)


@query(sql("SELECT 'postings' AS name, count(*) AS n_rows, true AS equal FROM post UNION ALL SELECT 'terms', count(*), true FROM term UNION ALL SELECT 'adjacency', (SELECT count(*) FROM adj), true UNION ALL SELECT 'blocks', count(*), true FROM iblk", "post", "adj"))
def incremental_equals_full(spark, d):
    """An index without each tenth page's last body, brought up to date, against the index built anew."""
    kb, full = base(spark, d), index(spark, d)
    some = kb.pages.filter(F.split_part("slug", F.lit("-"), F.lit(2)).cast("long") % 10 == 3).select("page_id")
    short = kb.blocks.join(some, "page_id", "left_anti").unionByName(kb.blocks.join(some, "page_id", "left_semi").filter("pos < 2"))
    moved = incremental.apply(I.build(tables.KnowledgeBase(kb.pages, short, kb.links)), kb, some)
    out = None
    for name in ("postings", "terms", "adjacency", "blocks"):
        a, b = getattr(full, name), getattr(moved, name)
        one = I.digest(a).crossJoin(I.digest(b.select(*a.columns)).toDF("n2", "d2"))  # one row each
        one = one.select(F.lit(name).alias("name"), "n_rows", (F.col("digest") == F.col("d2")).alias("equal"))
        out = one if out is None else out.unionByName(one)
    return out


@query()
def render_context(spark, d):
    """Context of each passage; text within budgets is a sequence of choices, which tests check."""
    return context.contexts(index(spark, d), tables.questions(spark, d)).select("qid", "grade", "top", "text", F.octet_length("text").cast("long").alias("n_bytes"))


@query(sql("SELECT qid, count(*) AS n FROM (SELECT r.*, max(score) OVER (PARTITION BY qid) AS best FROM result r) a WHERE score >= 0.5::DOUBLE * best OR (head <> page_id AND EXISTS (SELECT 1 FROM (SELECT r.*, max(score) OVER (PARTITION BY qid) AS best FROM result r) b WHERE b.qid = a.qid AND b.page_id = a.head AND b.score >= 0.5::DOUBLE * b.best)) GROUP BY qid", "comb", "head", "fold", "final"))
def cut_filter(spark, d):
    from pagewright.plans.search import search

    return context.cut_hits(search(index(spark, d), tables.questions(spark, d))).groupBy("qid").agg(F.count("*").alias("n"))


@query()
def eval_three_numbers(spark, d):
    """How often context holds a gold page, and what unrelated passages get."""
    from pagewright.operators.evaluation import context_metrics

    i = index(spark, d)
    g = gold(spark, d)[0].join(i.pages.select("page_id", "slug"), "page_id").select("qid", "slug")
    return context_metrics(context.contexts(i, tables.questions(spark, d)), g)
