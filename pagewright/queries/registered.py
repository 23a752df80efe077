"""Queries in SQL over the session's registered functions."""

from __future__ import annotations

from pagewright.functions import registered
from pagewright.queries import query
from pagewright.queries.common import base
from pagewright.queries.notes import _NOTE
from pagewright.queries.sql import sql
from pagewright.sources import notes as N
from pagewright.sources import tables


def _view(name: str, df) -> str:
    df.createOrReplaceTempView(name)
    return name


@query(sql("SELECT page_id, pos, count(*) AS n_tokens, count(DISTINCT term) AS n_terms FROM tok GROUP BY 1, 2", "post"))
def sql_tokens(spark, d):
    """`tokenize_terms` in SQL: tokens of all titles and blocks."""
    registered.register(spark)
    kb = base(spark, d)
    titles, blocks = _view("kb_pages", kb.pages), _view("kb_blocks", kb.blocks)
    return spark.sql(f"""
        WITH texts AS (SELECT page_id, -1 AS pos, title AS text FROM {titles} WHERE title <> '' UNION ALL SELECT page_id, pos, text FROM {blocks}),
             terms AS (SELECT page_id, pos, kb_tokens(text) AS words FROM texts)
        SELECT page_id, pos, count(*) AS n_tokens, count(DISTINCT term) AS n_terms FROM terms LATERAL VIEW explode(words) AS term GROUP BY page_id, pos""")


@query(_NOTE + "SELECT page_id, pos, block_id, kind, print AS fingerprint, sha256(src) AS sha FROM q")
def sql_note_blocks(spark, d):
    """`note_blocks` in SQL: every block of every note by the parser as a table function."""
    registered.register(spark)
    bodies = _view("kb_notes", N.bodies(tables.table(spark, d, "documents")))
    return spark.sql(f"SELECT n.page_id, b.pos, b.block_id, b.kind, b.fingerprint, sha2(b.source_text, 256) AS sha FROM {bodies} AS n, LATERAL kb_markdown_blocks(n.page_id, n.body) AS b")


@query(sql("SELECT page_id, ord, key FROM link", "link"))
def sql_link_keys(spark, d):
    """The key of every link's target in SQL."""
    registered.register(spark)
    links = _view("kb_links", base(spark, d).links)
    return spark.sql(f"SELECT page_id, ord, kb_link_key(target) AS key FROM {links}")
