"""Queries of hash trees over pages."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pagewright.operators import trees
from pagewright.plans.cut import shared_folder
from pagewright.queries import query
from pagewright.queries.common import base
from pagewright.queries.sql import sql
from pagewright.sources import tables


def _states(spark, d):
    """Two states of the pages: of ids that begin with 7, some went, some came and some changed; all others are equal."""
    t = tables.table(spark, d, "documents").filter("doc_id IS NOT NULL").select("doc_id", F.concat(F.lit("page:doc-"), "doc_id").alias("page_id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))
    seven, n = F.col("doc_id").cast("string").startswith("7"), F.col("doc_id") % 10
    old = t.filter(~seven | (n != 0))
    new = t.filter(~seven | (n != 1)).withColumn("sha256", F.when(seven & (n == 2), F.lit("other")).otherwise(F.col("sha256")))
    return old, new


@query("SELECT 'page:doc-' || doc_id AS page_id, CASE doc_id % 10 WHEN 0 THEN 'added' WHEN 1 THEN 'deleted' ELSE 'modified' END AS change FROM documents WHERE doc_id::VARCHAR LIKE '7%' AND doc_id % 10 IN (0, 1, 2)")
def tree_delta(spark, d):
    """What differs between two states, by their trees and the rows of ranges that differ."""
    places = [f"{shared_folder(spark)}/trees/{uuid.uuid4().hex}" for _ in range(2)]
    for rows, place in zip(_states(spark, d), places, strict=True):
        trees.write_state(rows, place)
    return trees.tree_diff(spark, *places)


_TREE = """
leaf AS (SELECT left(sha256(page_id), 2) AS range, sha256(string_agg(page_id || chr(0) || sha, chr(10) ORDER BY page_id || chr(0) || sha)) AS digest, count(*) AS n FROM page GROUP BY 1),
mid AS (SELECT left(range, 1) AS range, sha256(string_agg(range || ':' || digest, chr(10) ORDER BY range || ':' || digest)) AS digest, sum(n)::BIGINT AS n FROM leaf GROUP BY 1),
root AS (SELECT '' AS range, sha256(string_agg(range || ':' || digest, chr(10) ORDER BY range || ':' || digest)) AS digest, sum(n)::BIGINT AS n FROM mid HAVING count(*) > 0)"""
_NODES = "SELECT 2 AS level, * FROM leaf UNION ALL SELECT 1, * FROM mid UNION ALL SELECT 0, * FROM root"


@query(sql(f"\n{_NODES}", "page").replace(f"\n{_NODES}", f",{_TREE}\n{_NODES}"))
def hash_tree(spark, d):
    """Every node of the tree over all documents."""
    rows = tables.documents_as_pages(tables.table(spark, d, "documents")).select("page_id", F.sha2("text", 256).alias("sha256"))
    return trees.tree(trees.ranged(rows))


@query(sql("""SELECT page_id, sha256('{"created":"' || updated || '","keywords":[],"page_id":"' || page_id || '","slug":"' || slug || '","tags":[' || coalesce('"' || lang || '"', 'null') || '],"type":"' || type || '"}') AS sha256 FROM page""", "page"))
def page_digests(spark, d):
    """The digest of each page's canonical JSON, of fields without free text, which JSON writers escape in different ways."""
    p = base(spark, d).pages.select("type", "tags", "slug", "page_id", "keywords", "created")
    return p.select("page_id", trees.page_digest(p).alias("sha256"))
