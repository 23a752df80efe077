"""Queries over Markdown in which all kinds of blocks occur: the parser, sections, links, drift, front matter and schemas."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright.functions import fixed, markdown
from pagewright.functions import text as T
from pagewright.operators import index as I
from pagewright.operators import integrity as N
from pagewright.operators import links as L
from pagewright.operators import pages as P
from pagewright.queries import query
from pagewright.queries.common import kept, limit_batches
from pagewright.sources import json_pages, notes, tables

_NOTE = f"""WITH d AS (SELECT doc_id, 'page:doc-' || doc_id AS page_id, 'doc-' || doc_id AS slug, coalesce(text, '') AS text, count(*) OVER () AS n FROM documents WHERE doc_id IS NOT NULL),
l AS (SELECT *, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM d),
t AS (SELECT * EXCLUDE (raw, text), trim(regexp_replace(raw, '{notes.CONTROL}', ' ', 'g')) AS t, (doc_id * 31 + line) % 12 AS k FROM l),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) - 1 AS pos,
  CASE k WHEN 0 THEN 'heading' WHEN 1 THEN 'conflict' WHEN 2 THEN 'open_question' WHEN 3 THEN 'list' WHEN 4 THEN 'table' WHEN 5 THEN 'current' ELSE 'paragraph' END AS kind,
  CASE WHEN k = 0 THEN 1 + (doc_id + line) % 4 END AS level, (doc_id * 7 + line) % (2 * n) AS goal,
  CASE k WHEN 0 THEN repeat('#', (1 + (doc_id + line) % 4)::INT) || ' ' || t WHEN 1 THEN '> {fixed.CONFLICT_MARK}: ' || t
    WHEN 2 THEN '> {fixed.OPEN_MARK}: ' || t || chr(10) || '> owner: o' || doc_id % 7 || chr(10) || '> due: 2024-05-' || lpad((1 + line % 28)::VARCHAR, 2, '0')
    WHEN 3 THEN '- ' || t || chr(10) || '  more' || chr(10) || '- last' WHEN 4 THEN '| ' || replace(t, '|', '/') || ' | \\| x |' || chr(10) || '|---|---|'
    WHEN 5 THEN '> {fixed.CURRENT_MARK}: ' || t WHEN 6 THEN 'see [[Doc ' || (doc_id * 7 + line) % (2 * n) || '|this]] ' || t ELSE 'text ' || t END AS src FROM t WHERE t <> ''),
p AS (SELECT *, left(sha256(kind || chr(0) || trim(regexp_replace(src, '\\s+', ' ', 'g'))), 16) AS print FROM b),
q AS (SELECT *, 'block:' || slug || ':' || print || ':' || row_number() OVER (PARTITION BY doc_id, print ORDER BY pos) AS block_id FROM p)
"""


def _parsed(spark, d):
    """The blocks of all notes, parsed once in a session."""
    limit_batches(spark)
    return kept("notes", spark, d, lambda: markdown.parse_pages(notes.bodies(tables.table(spark, d, "documents"))))


def _blocks(spark, d):
    """The parsed blocks in the form of the knowledge base's."""
    return _parsed(spark, d).select("page_id", "pos", F.col("id").alias("block_id"), "kind", F.coalesce("text", "source_text").alias("text"), "level", F.coalesce(F.col("status") == "unresolved", F.lit(False)).alias("unresolved"))


@query(_NOTE + """SELECT page_id, pos, block_id, kind, level, print AS fingerprint, CASE k WHEN 1 THEN 'unresolved' WHEN 5 THEN 'resolved' END AS status, CASE WHEN k = 2 THEN 'o' || doc_id % 7 END AS owner,
CASE WHEN k = 2 THEN '2024-05-' || lpad((1 + line % 28)::VARCHAR, 2, '0') END AS due, CASE WHEN k = 3 THEN t || ' more;last' END AS items, CASE WHEN k = 4 THEN trim(replace(t, '|', '/')) || ';| x' END AS cells, sha256(src) AS sha FROM q""")
def note_blocks(spark, d):
    """Every block of every note with what the parser reads from it."""
    b = _parsed(spark, d)
    return b.select(
        "page_id", "pos", F.col("id").alias("block_id"), "kind", "level", "fingerprint", "status", "owner", "due", F.when(F.col("kind") == "list", F.array_join("items", ";")).alias("items"),
        F.when(F.col("kind") == "table", F.array_join(F.col("rows")[0], ";")).alias("cells"), F.sha2("source_text", 256).alias("sha"),
    )


@query(_NOTE + "SELECT page_id, pos, 'Doc ' || goal AS target, 'this' AS label, 'doc-' || goal AS key FROM q WHERE k = 6")
def note_links(spark, d):
    """Every link of every block, with its label and the key under which its page is looked up."""
    rows = _parsed(spark, d).select("page_id", "pos", F.explode(T.links_in("source_text")).alias("x"))
    return rows.select("page_id", "pos", "x.target", "x.label", T.link_key("x.target").alias("key"))


@query(_NOTE + "SELECT page_id, 'Doc ' || goal AS target, count(*) AS n FROM q WHERE k = 6 AND goal NOT IN (SELECT doc_id FROM d) GROUP BY 1, 2")
def note_dangling(spark, d):
    """Links that lead to no page: half of the targets don't exist."""
    pages = tables.documents_as_pages(tables.table(spark, d, "documents")).withColumn("title", F.col("slug"))
    rows = _parsed(spark, d).select("page_id", "pos", F.col("id").alias("block_id"), F.explode(T.links_in("source_text")).alias("x"))
    declared = rows.select("page_id", F.col("pos").alias("ord"), "x.target", F.lit("wiki").alias("kind"), "x.label", "x.anchor", "block_id")
    return L.dangling(L.resolve(declared, pages), pages).groupBy("page_id", "target").agg(F.count("*").alias("n"))


@query(_NOTE + "SELECT page_id, block_id, level, t AS text, pos FROM q WHERE k = 0")
def note_outline(spark, d):
    return json_pages.outline(_blocks(spark, d))


@query(_NOTE + """SELECT h.block_id AS heading_id, c.page_id, c.pos, c.block_id FROM q h JOIN q c ON c.doc_id = h.doc_id AND c.pos >= h.pos
WHERE h.k = 0 AND NOT EXISTS (SELECT 1 FROM q s WHERE s.doc_id = h.doc_id AND s.k = 0 AND s.pos > h.pos AND s.pos <= c.pos AND s.level <= h.level)""")
def note_sections(spark, d):
    """Each heading's section, with headings of four levels in each page."""
    return json_pages.sections(_blocks(spark, d))


@query(_NOTE + """, o AS (SELECT c.page_id, c.pos, h.level, h.pos AS hp, h.t FROM q c JOIN q h ON h.doc_id = c.doc_id AND h.k = 0 AND h.pos < c.pos
  WHERE c.k <> 0 AND NOT EXISTS (SELECT 1 FROM q s WHERE s.doc_id = c.doc_id AND s.k = 0 AND s.pos > h.pos AND s.pos < c.pos AND s.level <= h.level))
SELECT q.page_id, q.pos, coalesce(string_agg(o.t, ' / ' ORDER BY o.level), '') AS hpath FROM q LEFT JOIN o ON o.page_id = q.page_id AND o.pos = q.pos GROUP BY 1, 2""")
def note_paths(spark, d):
    """The headings above each block."""
    return I.heading_paths(_blocks(spark, d))


@query(_NOTE + "SELECT count(*) FILTER (k = 1) AS unresolved_conflicts, count(*) FILTER (k = 2) AS open_questions FROM q")
def note_issues(spark, d):
    return N.issue_counts(_blocks(spark, d))


@query(_NOTE + """SELECT 'late_question' AS kind, page_id, block_id, '2024-05-' || lpad((1 + line % 28)::VARCHAR, 2, '0') AS detail FROM q WHERE k = 2 AND 1 + line % 28 < 15""")
def note_late_questions(spark, d):
    """Questions that were due before a day."""
    return N.late_questions(_blocks(spark, d).join(_parsed(spark, d).select(F.col("page_id"), "pos", "due"), ["page_id", "pos"]), "2024-05-15").select("kind", "page_id", "block_id", "detail")


@query(_NOTE + """SELECT page_id, block_id, p AS problem FROM (SELECT page_id, block_id, unnest(CASE pos % 5 WHEN 0 THEN ['fingerprint differs from the source', 'block id has another fingerprint']
WHEN 1 THEN CASE WHEN k = 6 THEN ['refs differ from the source'] ELSE [] END ELSE [] END) AS p FROM q)""")
def note_drift(spark, d):
    """Blocks whose fingerprint (each fifth) or references (each fifth) no longer fit their source."""
    b = _parsed(spark, d).withColumnRenamed("id", "block_id")
    b = b.withColumn("fingerprint", F.when(F.col("pos") % 5 == 0, F.lit("0" * 16)).otherwise(F.col("fingerprint"))).withColumn("refs", F.when(F.col("pos") % 5 == 1, F.array().cast("array<string>")).otherwise(F.col("refs")))
    return N.block_drift(b.withColumn("data", F.lit(None).cast("string")))


@query("""SELECT 'page:doc-' || doc_id AS page_id, 'Title ' || doc_id AS title, 'concept' AS type, coalesce(lang, 'none') || ';a, ' || doc_id % 3 AS tags, coalesce(source, 'none') || ';p' AS projects,
'folded line ' || doc_id AS summary, 2 AS n_blocks FROM documents WHERE doc_id IS NOT NULL""")
def note_heads(spark, d):
    """Canonical pages of files whose heads have comments, quotes, lists of both forms and block scalars."""
    p = P.from_markdown(notes.heads(tables.table(spark, d, "documents")), "2024-01-01")
    return p.select(F.col("id").alias("page_id"), "title", "type", F.array_join("tags", ";").alias("tags"), F.array_join("projects", ";").alias("projects"), "summary", F.size("block_order").alias("n_blocks"))


@query("SELECT 'page:doc-' || doc_id AS page_id, unnest(CASE doc_id % 5 WHEN 0 THEN ['block_order mismatch'] WHEN 1 THEN ['alias points at unknown block gone'] WHEN 2 THEN ['duplicate ids in block_order'] ELSE [] END) AS error FROM documents WHERE doc_id IS NOT NULL")
def note_structure(spark, d):
    """Canonical pages with planted faults of order and aliases."""
    p = P.from_markdown(notes.heads(tables.table(spark, d, "documents")), "2024-01-01")
    n = F.split_part("slug", F.lit("-"), F.lit(2)).cast("long") % 5
    order = F.when(n == 0, F.slice("block_order", 1, 1)).when(n == 2, F.concat("block_order", "block_order")).otherwise(F.col("block_order"))
    return N.structure_errors(p.withColumn("block_aliases", F.when(n == 1, F.create_map(F.lit("old"), F.lit("gone")))).withColumn("block_order", order))


SCHEMA = {
    "type": "object", "required": ["id", "source"], "additionalProperties": False, "$defs": {"name": {"type": "string", "minLength": 2}},
    "properties": {"id": {"type": "string", "pattern": "[02468]$"}, "lang": {"enum": ["en", "fr"]}, "source": {"$ref": "#/$defs/name"}, "n": {"type": "integer"}, "parts": {"type": "array", "items": {"type": ["integer", "null"]}, "uniqueItems": True}},
}


@query("""SELECT doc_id, unnest(list_filter([CASE WHEN doc_id % 2 = 1 THEN '/id: does not match [02468]$' END, CASE WHEN lang NOT IN ('en', 'fr') THEN '/lang: is none of the listed values' END,
CASE WHEN doc_id % 3 = 0 THEN '/: lacks source' END, CASE WHEN doc_id % 4 = 0 THEN '/parts: repeats an item' END, CASE WHEN doc_id % 6 = 0 THEN '/: has a key that is not listed' END,
CASE WHEN doc_id % 5 = 0 THEN '/n: has another type than integer' END, CASE WHEN doc_id % 7 = 0 THEN '/parts/0: has another type than integer or null' END], lambda x: x IS NOT NULL)) AS error FROM documents WHERE doc_id IS NOT NULL""")
def schema_rows(spark, d):
    """JSON made of every document, with planted faults, against a schema."""
    i = F.col("doc_id")
    js = F.concat(
        F.lit('{"id":"'), i.cast("string"), F.lit('"'), F.when(F.col("lang").isNotNull(), F.concat(F.lit(',"lang":"'), F.col("lang"), F.lit('"'))).otherwise(""), F.when(i % 3 != 0, ',"source":"src"').otherwise(""),
        F.when(i % 6 == 0, ',"other":1').otherwise(""), F.when(i % 5 == 0, ',"n":1.5').otherwise(',"n":3'),
        F.lit(',"parts":['), F.when(i % 7 == 0, '"x"').otherwise("null"), F.when(i % 4 == 0, ",5,5").otherwise(",5,6"), F.lit("]}"),
    )
    rows = tables.table(spark, d, "documents").filter("doc_id IS NOT NULL").select("doc_id", js.alias("j"))
    return N.json_errors(rows, "j", SCHEMA).select("doc_id", F.explode("errors").alias("error"))
