"""Queries of the projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright.operators import artifacts as A
from pagewright.operators import links
from pagewright.queries import query
from pagewright.queries.common import base, index
from pagewright.queries.sql import sql


def _groups(spark, d):
    """The groups of the sources: a configuration, of as many rows as there are sources."""
    kb = base(spark, d)
    projects = [r[0] for r in kb.pages.select(F.explode("projects").alias("p")).distinct().filter("p IS NOT NULL").collect()]
    groups = A.group_table(spark, A.project_groups(projects))
    return A.page_groups(kb.pages, groups), groups


@query(sql("SELECT page_id, slug, title, type, updated, source AS projects, lang AS tags, '' AS sources, CASE WHEN length(t) <= 240 THEN t ELSE rtrim(left(t, 239)) || '…' END AS summary FROM (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM page)", "page"))
def catalog(spark, d):
    return A.catalog(base(spark, d).pages)


@query(sql("SELECT page_id AS id, page_id, '' AS pointer, 'page' AS kind, 'pages/' || slug || '.json' AS data_url FROM page UNION ALL SELECT block_id, page_id, '/blocks/' || block_id, kind, 'pages/' || replace(page_id, 'page:', '') || '.json' FROM blk", "blk"))
def map_rows(spark, d):
    kb = base(spark, d)
    return A.map_rows(kb.pages, kb.blocks)


@query(sql("SELECT (SELECT count(*) FROM page) AS pages, (SELECT count(*) FROM blk) AS blocks, (SELECT count(*) FROM (SELECT DISTINCT page_id, dst FROM link WHERE dst IS NOT NULL)) AS edges, 0::BIGINT AS unresolved_conflicts", "link"))
def graph_stats(spark, d):
    kb, i = base(spark, d), index(spark, d)
    return A.stats(kb.pages, kb.blocks, links.display_edges(i.links))


@query(sql('SELECT lower(source) AS "group", page_id FROM page', "page"))
def routes(spark, d):
    grouped, groups = _groups(spark, d)
    return A.routes(grouped, groups)


@query(sql("""SELECT page_id, lower(source) AS "group", round(r * cos(a), 6) AS x, round(r * sin(a), 6) AS y FROM (
SELECT *, 18.0::DOUBLE * sqrt((i + 0.72::DOUBLE) / (n + 0.72::DOUBLE)) AS r, -pi() / 2 + 2 * pi() * start / total + pad + (span - 2 * pad) * (i * 0.6180339887498949::DOUBLE - floor(i * 0.6180339887498949::DOUBLE)) AS a FROM (
SELECT page_id, source, n, i, total, 2 * pi() * n / total AS span, least(0.035::DOUBLE, 2 * pi() * n / total * 0.04::DOUBLE) AS pad, start FROM (
SELECT page_id, source, row_number() OVER (PARTITION BY source ORDER BY page_id) - 1 AS i FROM page) JOIN (
SELECT source, n, sum(n) OVER () AS total, coalesce(sum(n) OVER (ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM (SELECT source, count(*) AS n FROM page GROUP BY source)) USING (source)))""", "page"))
def layout_xy(spark, d):
    return A.layout(*_groups(spark, d))
