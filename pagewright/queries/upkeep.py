"""Queries of upkeep: errors of a store, origins, fields, versions, what an ingestion would do, what payloads deliver, differences and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright.functions import fixed
from pagewright.functions import text as T
from pagewright.operators import evaluation as E
from pagewright.operators import links as L
from pagewright.operators import pages as P
from pagewright.operators import upkeep as U
from pagewright.queries import query
from pagewright.queries.common import base
from pagewright.queries.notes import _NOTE, _blocks, _parsed
from pagewright.queries.sql import sql
from pagewright.sources import json_pages, notes, tables

def _n():
    """The document's number in a page's slug."""
    return F.split_part("slug", F.lit("-"), F.lit(2)).cast("long")


@query(_NOTE + """SELECT DISTINCT page_id, 'missing link target [[Doc ' || goal || ']]' AS error FROM q WHERE k = 6 AND goal NOT IN (SELECT doc_id FROM d)
UNION ALL SELECT page_id, 'source page:doc-' || doc_id * 2 || ' has no page' FROM d WHERE doc_id * 2 NOT IN (SELECT doc_id FROM d)
UNION ALL SELECT page_id, 'duplicate slug doc-even' FROM d WHERE doc_id % 10 = 0 AND page_id <> (SELECT min(page_id) FROM d WHERE doc_id % 10 = 0)
UNION ALL SELECT 'page:doc-' || doc_id || '-copy', 'duplicate block id ' || block_id || ' (also in ' || page_id || ')' FROM q WHERE pos = 0""")
def note_errors(spark, d):
    """Links and sources that lead nowhere, a slug that each tenth page has, and a copy of each page's first block."""
    pages = tables.documents_as_pages(tables.table(spark, d, "documents")).withColumn("title", F.col("slug")).withColumn("sources", F.array(F.concat(F.lit("page:doc-"), (_n() * 2).cast("string"))))
    rows = _parsed(spark, d).select("page_id", "pos", F.col("id").alias("block_id"), F.explode(T.links_in("source_text")).alias("x"))
    declared = rows.select("page_id", F.col("pos").alias("ord"), "x.target", F.lit("wiki").alias("kind"), "x.label", "x.anchor", "block_id")
    blocks = _blocks(spark, d).select("page_id", "pos", "block_id")
    copies = blocks.filter("pos = 0").withColumn("page_id", F.concat("page_id", F.lit("-copy")))
    # pages are still found by their id, so that a slug that many share misleads no link
    return U.lint_errors(pages.withColumn("slug", F.when(_n() % 10 == 0, F.lit("doc-even")).otherwise(F.col("slug"))), blocks.unionByName(copies), L.resolve(declared, pages))


def _json(*fields):
    """A JSON object of (key, JSON text) pairs; null texts leave their key out."""
    return F.concat(F.lit("{"), F.concat_ws(",", *(F.concat(F.lit(f'"{k}":'), v) for k, v in fields)), F.lit("}"))


def _records(spark, d):
    """A JSON page for each document: origins in all the places that can name one, and fields to pick."""
    i = F.col("doc_id").cast("string")
    say = lambda *parts: F.to_json(F.array(F.concat(*parts)))
    one = lambda *parts: F.regexp_extract(say(*parts), r"^\[(.*)\]$", 1)
    page = _json(
        ("id", one(F.lit("page:doc-"), i)), ("raw_ref", F.when(F.col("doc_id") % 2 == 0, one(F.lit(" ./raw\\a/"), i)).otherwise("7")), ("source_snapshot", F.when(F.col("doc_id") % 3 == 0, _json(("path", one(F.lit("././raw/b/"), i))))),
        ("history", F.concat(F.lit("["), _json(("at", F.lit('"2024"')), ("note", one(F.lit("raw/c/"), i))), F.lit(","), _json(("source", one(F.lit("source:./raw/d/"), i))), F.lit(",5]"))),
        ("sources", F.concat(F.lit("["), one(F.lit("source:raw/e/"), i), F.lit(","), one(F.lit("raw/c/"), i), F.lit(',"  "]'))), ("parts", F.concat(F.lit('[{"0":'), i, F.lit('},{"a\'b":['), i, F.lit(",null]}]"))),
    )
    return tables.table(spark, d, "documents").filter("doc_id IS NOT NULL").select("doc_id", page.alias("page"))


@query("SELECT 'page:doc-' || doc_id AS page_id, r AS ref FROM (SELECT doc_id, unnest(list_filter([CASE WHEN doc_id % 2 = 0 THEN 'raw/a/' || doc_id END, CASE WHEN doc_id % 3 = 0 THEN 'raw/b/' || doc_id END, 'raw/c/' || doc_id, 'raw/d/' || doc_id, 'raw/e/' || doc_id], lambda x: x IS NOT NULL)) AS r FROM documents WHERE doc_id IS NOT NULL)")
def raw_origins(spark, d):
    """Every raw file that every page names, wherever it does."""
    return json_pages.raw_refs(_records(spark, d))


@query("SELECT doc_id, doc_id::VARCHAR AS by_number, doc_id::VARCHAR AS by_key FROM documents WHERE doc_id IS NOT NULL")
def picked_fields(spark, d):
    """Fields of every page by paths through lists and objects, with a key that is a number and one with a quote."""
    v = F.parse_json("page")
    return _records(spark, d).select("doc_id", json_pages.picked(v, ["parts", "0", "0"]).cast("string").alias("by_number"), json_pages.picked(v, ["parts", "1", "a'b", "0"]).cast("string").alias("by_key"))


@query("""SELECT version, count(*) AS n, version = CASE WHEN bool_or(version = 'next') OVER () THEN 'next' WHEN bool_or(version = '1.9') OVER () THEN '1.9' ELSE '1.10' END AS lowest
FROM (SELECT CASE doc_id % 3 WHEN 0 THEN '1.10' WHEN 1 THEN '1.9' ELSE 'next' END AS version FROM documents WHERE doc_id IS NOT NULL) GROUP BY version""")
def version_counts(spark, d):
    n = F.col("doc_id") % 3
    return U.schema_versions(tables.table(spark, d, "documents").filter("doc_id IS NOT NULL").select(F.when(n == 0, "1.10").when(n == 1, "1.9").otherwise("next").alias("schema_version")))


_DIRS = "MAP {" + ", ".join(f"'{k}': '{v + '/' if v else ''}'" for k, v in fixed.PAGE_DIRS.items()) + "}"


@query(sql(f"""SELECT page_id, CASE WHEN doc_id % 4 = 0 THEN 'added' ELSE 'updated' END AS action, {_DIRS}[kind] || slug || '.json' AS path, CASE WHEN doc_id % 4 <> 0 AND kind <> type THEN {_DIRS}[type] || slug || '.json' END AS moved_from
FROM (SELECT *, CASE WHEN doc_id % 3 = 0 THEN 'concept' ELSE type END AS kind FROM page)
UNION ALL SELECT 'page:doc ' || doc_id, 'clash', {_DIRS}[type] || slug || '.json', NULL FROM page WHERE doc_id % 4 <> 0""", "page"))
def ingest_actions(spark, d):
    """What all pages would do that come in again, a third with another type, and three quarters beside a page whose name gives the same file."""
    p = base(spark, d).pages.select("page_id", "slug", "type")
    old = p.filter(_n() % 4 != 0)
    again = p.withColumn("type", F.when(_n() % 3 == 0, "concept").otherwise(F.col("type"))).select("page_id", "type")
    beside = old.select(F.concat(F.lit("page:doc "), _n().cast("string")).alias("page_id"), "type")
    return U.ingest_plan(old, again, update=True).unionByName(U.ingest_plan(old, beside, update=True))


@query("SELECT 'page:doc-' || doc_id AS page_id, 2 AS n_blocks, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 0 END AS n_live, CASE WHEN doc_id % 3 = 1 THEN 2 ELSE 0 END AS n_lost FROM documents WHERE doc_id IS NOT NULL")
def current_blocks(spark, d):
    """Decisions that name an old id (a third of the pages), one that is gone (a third), or nothing."""
    p = P.from_markdown(notes.heads(tables.table(spark, d, "documents")), "2024-01-01")
    named = F.when(_n() % 3 == 0, F.lit("old")).when(_n() % 3 == 1, F.lit("gone"))
    decided = lambda b: F.struct(F.lit("resolved").alias("status"), named.alias("current"), F.lit(None).cast("string").alias("decided_at"))
    p = p.withColumn("blocks", F.transform_values("blocks", lambda _, b: b.withField("resolution", decided(b)))).withColumn("block_aliases", F.create_map(F.lit("old"), F.element_at("block_order", 1)))
    of = F.transform(F.map_values("blocks"), lambda b: b["resolution"]["current"])
    return json_pages.follow_current(p).select(F.col("id").alias("page_id"), F.size("block_order").alias("n_blocks"), F.size(F.filter(of, lambda c: c == F.element_at("block_order", 1))).alias("n_live"), F.size(F.filter(of, lambda c: c == "gone")).alias("n_lost"))


_DELIVERY = sql("""SELECT p.page_id AS qid, coalesce(strlen(flat), 0)::BIGINT AS payload_bytes, f.qid IS NOT NULL AS gold_page, coalesce(gold_block, false) AS gold_block, g.qid IS NOT NULL AS gold_addr, coalesce(gold_hits, 0)::BIGINT AS gold_hits, coalesce(mismatch, 0)::BIGINT AS mismatch,
coalesce(span <> '' AND contains(flat, span), false) AS answer, s.qid IS NOT NULL AS stale_body, s.qid IS NOT NULL AND doc_id % 2 = 1 AS stale_leak
FROM (SELECT *, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS span FROM page) p LEFT JOIN f ON f.qid = page_id LEFT JOIN g ON g.qid = page_id LEFT JOIN s ON s.qid = page_id""", "blk").replace("\nSELECT p.page_id AS qid", """,
c AS (SELECT page_id, pos, CASE WHEN length(t) <= 240 THEN t ELSE rtrim(left(t, 239)) || '…' END AS key FROM (SELECT page_id, pos, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM blk)),
f AS (SELECT page_id AS qid, coalesce(string_agg(key, ' ' ORDER BY pos) FILTER (pos % 3 <> 2), '') AS flat FROM c GROUP BY page_id),
g AS (SELECT qid, count(*) FILTER (seen AND body) AS gold_hits, count(*) FILTER (seen <> body) AS mismatch, bool_and(seen AND body) AS gold_block FROM (SELECT f.qid, contains(flat, key) AS seen, pos % 3 <> 2 AS body FROM f JOIN c ON c.page_id = f.qid WHERE pos < 3) GROUP BY qid),
s AS (SELECT DISTINCT f.qid FROM f JOIN page USING (text) JOIN c ON c.page_id = 'page:doc-' || (doc_id + 1) WHERE contains(flat, key))
SELECT p.page_id AS qid""").replace("FROM f JOIN page USING (text)", "FROM f JOIN page ON page.page_id = f.qid")


@query(_DELIVERY)
def delivery(spark, d):
    """Payloads of two thirds of each page's blocks, judged by its first three blocks, its title and the next page, which each second payload marks as out of date."""
    kb = base(spark, d)
    blocks = kb.blocks.select("page_id", "pos", "block_id", "text")
    body = F.col("pos") % 3 != 2
    lines = F.transform(F.array_sort(F.collect_list(F.when(body, F.struct("pos", T.clip("text", 240).alias("t"))))), lambda x: x["t"])
    texts = blocks.groupBy(F.col("page_id").alias("qid")).agg(F.array_join(lines, " ").alias("text"))
    after = F.concat(F.lit("page:doc-"), (_n() + 1).cast("string"))
    shown = blocks.select(F.col("page_id").alias("qid"), "page_id", "block_id", body.alias("body"), F.lit("").alias("status"))
    old = kb.pages.filter(_n() % 2 == 0).select(F.col("page_id").alias("qid"), after.alias("page_id"), F.lit(None).cast("string").alias("block_id"), F.lit(False).alias("body"), F.lit("superseded").alias("status"))
    gold = blocks.filter("pos < 3").groupBy("page_id").agg(F.collect_list("block_id").alias("gold_blocks"))
    questions = kb.pages.join(gold, "page_id", "left").select(F.col("page_id").alias("qid"), F.array("page_id").alias("gold_pages"), "gold_blocks", F.array(after).alias("stale_pages"), F.col("title").alias("span"))
    return E.delivered(questions, texts, shown.unionByName(old), blocks)


@query(f"""SELECT count(*) AS n, round(avg((payload_bytes > 0)::INT), 4) AS injected, round(avg(gold_page::INT), 4) AS gold_page, round(avg(gold_block::INT), 4) AS gold_block, round(avg(gold_addr::INT), 4) AS gold_addr, round(avg(answer::INT), 4) AS answer,
round(avg(stale_body::INT), 4) AS stale_body, round(avg(stale_leak::INT), 4) AS stale_leak, sum(mismatch)::BIGINT AS mismatch, round(avg(payload_bytes), 1) AS bytes_mean, round(sum(payload_bytes) / sum(gold_hits), 1) AS bytes_per_hit FROM ({_DELIVERY})""")
def delivery_summary(spark, d):
    return E.delivery_rates(delivery(spark, d))


@query()
def dense_windows(spark, d):
    """The window of 300 characters of every document that holds most of its title's words; a test holds it against all windows."""
    docs = tables.table(spark, d, "documents").withColumn("title", F.substring_index(F.coalesce("text", F.lit("")), "\n", 1))
    return U.dense_windows(docs, "text", T.tokens("title"), 300)


@query()
def drift_diffs(spark, d):
    """The difference between every note's block and the block with its first word left out; a test holds it against literal cases."""
    b = _parsed(spark, d).select("page_id", "pos", "source_text")
    return b.select("page_id", "pos", U.drift_diff("source_text", F.regexp_replace("source_text", "^\\S+ ", "")).alias("lines"))


@query(sql("SELECT page_id FROM page WHERE type IN ('concept', 'source') AND doc_id % 5 <> 0 AND doc_id % 2 = 1", "page"))
def visible_nodes(spark, d):
    """Nodes of two types without orphans and with open conflicts, both planted."""
    nodes = base(spark, d).pages.select("page_id", "type", F.lit("g").alias("group"), (_n() % 5 == 0).alias("orphan"), (_n() % 2).alias("unresolved_conflicts"))
    return U.visible(nodes, "type", ["concept", "source"], orphans=False, conflicts_only=True).select("page_id")
