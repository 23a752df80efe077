"""Queries of validation, lint and redaction."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright.functions import redact
from pagewright.functions import text as T
from pagewright.operators import integrity as N
from pagewright.queries import query
from pagewright.queries.common import base, index
from pagewright.queries.sql import sql
from pagewright.sources import tables

NEAR = "near AS (SELECT page_id, dst AS other FROM link WHERE dst IS NOT NULL UNION SELECT dst, page_id FROM link WHERE dst IS NOT NULL)"


@query(sql("""SELECT p.page_id, count(*) AS n, array_to_string(list(o.slug ORDER BY o.slug)[1:5], ', ') AS newer FROM near JOIN page p USING (page_id) JOIN page o ON o.page_id = near.other
WHERE p.type = 'concept' AND o.type = 'source' AND o.updated > p.updated GROUP BY p.page_id""", "link").replace("\nSELECT p.page_id", f",\n{NEAR}\nSELECT p.page_id"))
def compile_debt(spark, d):
    return N.compile_debt(base(spark, d).pages, index(spark, d).links)


@query(sql("SELECT page_id FROM page p WHERE type = 'source' AND NOT EXISTS (SELECT 1 FROM link l JOIN page o ON o.page_id = l.dst WHERE l.page_id = p.page_id AND o.type IN ('concept', 'entity', 'synthesis'))", "link"))
def unintegrated_sources(spark, d):
    return N.unintegrated(base(spark, d).pages, index(spark, d).links)


@query(sql("""SELECT kind, count(*) AS n FROM (
SELECT 'compile_debt' AS kind, p.page_id FROM near JOIN page p USING (page_id) JOIN page o ON o.page_id = near.other WHERE p.type = 'concept' AND o.type = 'source' AND o.updated > p.updated GROUP BY p.page_id
UNION ALL SELECT 'unintegrated_source', page_id FROM page p WHERE type = 'source' AND NOT EXISTS (SELECT 1 FROM link l JOIN page o ON o.page_id = l.dst WHERE l.page_id = p.page_id AND o.type IN ('concept', 'entity', 'synthesis'))
UNION ALL SELECT 'orphan', page_id FROM page WHERE page_id NOT IN (SELECT page_id FROM near)
UNION ALL SELECT 'empty_summary', page_id FROM page WHERE trim(regexp_replace(text, '\\s+', ' ', 'g')) = ''
UNION ALL SELECT 'summary_dump', page_id FROM page WHERE starts_with(trim(text), '|')
UNION ALL SELECT 'page_too_large', page_id FROM (SELECT page_id, sum(octet_length(encode(text))) AS b FROM blk GROUP BY page_id) WHERE b > 204800
UNION ALL SELECT 'missing_supersedes', page_id FROM blk b WHERE regexp_matches(text, '(?i)\\b(?:supersedes|replaces|obsoletes)\\b') AND NOT EXISTS (SELECT 1 FROM link l WHERE l.kind = 'supersedes' AND l.page_id = b.page_id) GROUP BY page_id) GROUP BY kind""", "link").replace("\nSELECT kind", f",\n{NEAR}\nSELECT kind", 1))
def warning_kinds(spark, d):
    kb, i = base(spark, d), index(spark, d)
    return N.warning_kinds(N.lint(i.pages, kb.blocks, i.links))


@query(sql("SELECT 0::BIGINT AS unresolved_conflicts, 0::BIGINT AS open_questions", "page"))
def issue_counts(spark, d):
    return N.issue_counts(base(spark, d).blocks)


@query("SELECT doc_id, count(*) AS n FROM documents GROUP BY doc_id HAVING count(*) > 1")
def duplicate_ids(spark, d):
    return N.duplicates(tables.table(spark, d, "documents"), "doc_id")


@query("SELECT 'page:doc-' || doc_id AS page_id, e AS error FROM (SELECT doc_id, unnest(CASE WHEN doc_id % 7 = 0 THEN ['created must be YYYY-MM-DD', 'invalid type'] ELSE [] END) AS e FROM documents WHERE doc_id IS NOT NULL)")
def validate_rows(spark, d):
    p = base(spark, d).pages
    bad = F.split_part("slug", F.lit("-"), F.lit(2)).cast("long") % 7 == 0
    return N.page_errors(p.withColumn("type", F.when(bad, "other").otherwise(F.col("type"))).withColumn("created", F.when(bad, "1.2.2024").otherwise(F.col("created"))))


def _spelled(spark, d):
    """Pages whose tags are spelled in three ways."""
    p = base(spark, d).pages
    n = F.split_part("slug", F.lit("-"), F.lit(2)).cast("long") % 5
    tag = F.when(n == 0, F.upper(F.col("tags")[0])).when(n == 1, F.concat(F.col("tags")[0], F.lit("_"))).otherwise(F.col("tags")[0])
    return p.withColumn("tags", F.array(tag))


_TAGS = "t AS (SELECT page_id, CASE doc_id % 5 WHEN 0 THEN upper(lang) WHEN 1 THEN lang || '_' ELSE lang END AS tag FROM page), k AS (SELECT *, trim(regexp_replace(lower(tag), '[\\s_./-]+', '-', 'g'), '-') AS key FROM t), s AS (SELECT key, tag AS spelling FROM (SELECT key, tag, row_number() OVER (PARTITION BY key ORDER BY count(*) DESC, tag) AS r FROM k GROUP BY key, tag) WHERE r = 1)"


@query(sql("SELECT key, spelling FROM s", "page").replace("\nSELECT key", f",\n{_TAGS}\nSELECT key"))
def tag_spellings(spark, d):
    return N.tag_spellings(_spelled(spark, d))


@query(sql("SELECT page_id, 'tag_variant' AS kind, tag || ' -> ' || spelling AS detail FROM k JOIN s USING (key) WHERE tag <> spelling", "page").replace("\nSELECT page_id, 'tag", f",\n{_TAGS}\nSELECT page_id, 'tag"))
def tag_variants(spark, d):
    return N.tag_warnings(_spelled(spark, d)).select("page_id", "kind", "detail")


@query(sql("SELECT page_id, CASE WHEN key IN ('en', 'de') THEN spelling ELSE spelling END AS tags, CASE WHEN key IN ('en', 'de') THEN '' ELSE '' END AS keywords FROM k JOIN s USING (key)", "page").replace("\nSELECT page_id, CASE", f",\n{_TAGS}\nSELECT page_id, CASE"))
def tag_split(spark, d):
    p = _spelled(spark, d)
    out = N.sorted_tags(p, N.tag_spellings(p), ["en", "de"])
    return out.select("page_id", F.array_join("tags", ",").alias("tags"), F.array_join("keywords", ",").alias("keywords"))


@query()
def redact_docs(spark, d):
    """All rules over all documents, which SQL can't express; tests hold it against literal cases of each rule."""
    return tables.table(spark, d, "documents").select("doc_id", redact.redacted("text").alias("text"))


@query()
def secret_labels(spark, d):
    """The full rule set, which SQL can't express; tests hold it against literal cases."""
    return tables.table(spark, d, "documents").select("doc_id", redact.secret_of("text").alias("label")).filter("label IS NOT NULL")


@query(sql("SELECT page_id, pos, left(trim(regexp_replace(regexp_replace(regexp_replace(trim(text), '^\\s*(?:[-*+]|\\d+\\.)\\s+', ''), '[*`#|]', '', 'g'), '\\s+', ' ', 'g')), 60) AS lead FROM blk", "blk"))
def block_leads(spark, d):
    """Of all blocks, list items included. The tables' blocks hold no [[links]]."""
    return base(spark, d).blocks.select("page_id", "pos", F.left(T.lead_text("text"), F.lit(60)).alias("lead"))
