"""Queries of the retrieval pipeline, for the passages of `benchmark`."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright.plans import search as S
from pagewright.queries import query
from pagewright.queries.common import index
from pagewright.queries.sql import sql
from pagewright.sources import tables


def _parts(spark, d, o=S.Options()):
    i, q = index(spark, d), tables.questions(spark, d)
    w = S.weighed_terms(i, S.query_terms(q))
    return i, q, w, S.block_scores(i, w, o)


@query(sql("SELECT qid, page_id, pos, round(score, 4) AS score, round(content, 4) AS content FROM blks", "lex"))
def bm25_blocks(spark, d):
    _, _, _, b = _parts(spark, d)
    return b.select("qid", "page_id", "pos", F.round("score", 4).alias("score"), F.round("content", 4).alias("content"))


@query(sql("SELECT qid, page_id, round(lex, 4) AS lex, n FROM pages_", "lex"))
def lex_pages(spark, d):
    _, _, _, b = _parts(spark, d)
    return S.page_scores(b).select("qid", "page_id", F.round("lex", 4).alias("lex"), "n")


@query(sql("""SELECT qid, term, df, round(idf, 6) AS idf FROM qterm""", "lex"))
def query_term_idf(spark, d):
    _, _, w, _ = _parts(spark, d)
    return w.select("qid", "term", "df", F.round("idf", 6).alias("idf"))


@query(sql("SELECT qid, term, df FROM kept", "lex"))
def kept_query_terms(spark, d):
    _, _, w, _ = _parts(spark, d)
    return S.kept_terms(w).select("qid", "term", "df")


@query(sql("""
SELECT c.qid, n_terms, posted_terms, round(posted_terms::DOUBLE / n_terms, 6) AS coverage, round(got / CASE WHEN alls = 0 THEN 1 ELSE alls END, 6) AS idf_coverage,
  round(coalesce(lex, 0), 4) AS raw_top, round(coalesce(c_, 0), 4) AS content_raw_top, round(coalesce(b_, 0), 4) AS top_block_impact, round(coalesce(best, 0), 4) AS top1_best_block,
  coalesce(n, 0) AS top1_n_blocks, round(coalesce(lex, 0) * posted_terms::DOUBLE / n_terms, 4) AS raw_x_cov FROM
(SELECT qid, count(*) AS n_terms, count(df) AS posted_terms, sum(idf) AS alls, coalesce(sum(idf) FILTER (df IS NOT NULL), 0) AS got FROM qterm GROUP BY qid) c
LEFT JOIN (SELECT qid, arg_min(lex, r) AS lex, arg_min(best, r) AS best, arg_min(n, r) AS n, max(content_lex) AS c_ FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(lex, 6) DESC, page_id) AS r FROM pages_) GROUP BY qid) t USING (qid)
LEFT JOIN (SELECT qid, max(score) AS b_ FROM blks GROUP BY qid) b USING (qid)""", "lex"))
def coverage_signals(spark, d):
    _, _, w, b = _parts(spark, d)
    s = S.signals(w, b, S.page_scores(b))
    r = lambda n, *c: [F.round(x, n).alias(x) for x in c]
    return s.select("qid", "n_terms", "posted_terms", *r(6, "coverage", "idf_coverage"), *r(4, "raw_top", "content_raw_top", "top_block_impact", "top1_best_block"), "top1_n_blocks", *r(4, "raw_x_cov"))


@query(sql("SELECT qid, page_id, round(rel, 4) AS rel FROM rel", "rel"))
def rerank_pages(spark, d):
    i, _, _, b = _parts(spark, d)
    return S.reranked(i, S.page_scores(b)).select("qid", "page_id", F.round("rel", 4).alias("rel"))


@query(sql("SELECT qid, page_id, round(g, 9) AS g, own FROM graph", "graph"))
def ppr_scores(spark, d):
    i, _, _, b = _parts(spark, d)
    return S.spread(i, S.relative(S.reranked(i, S.page_scores(b)))).select("qid", "page_id", F.round("g", 9).alias("g"), "own")


@query(sql("SELECT qid, page_id, round(score, 6) AS score FROM comb", "comb"))
def noisy_or_scores(spark, d):
    i, _, _, b = _parts(spark, d)
    rel = S.relative(S.reranked(i, S.page_scores(b)))
    return S.combined(rel, S.spread(i, rel)).select("qid", "page_id", F.round("score", 6).alias("score"))


@query(sql("SELECT * FROM result", "comb", "head", "fold", "final"))
def search_topk(spark, d):
    return S.search(index(spark, d), tables.questions(spark, d))


@query(sql("SELECT * FROM result", "comb", "head", "nofold", "final"))
def search_nofold(spark, d):
    return S.search(index(spark, d), tables.questions(spark, d), S.Options(fold=False))


@query(sql("SELECT * FROM result", "comb_lexical", "head", "fold", "final"))
def search_nograph(spark, d):
    return S.search(index(spark, d), tables.questions(spark, d), S.Options(graph=False))


@query(sql("SELECT qid, CASE WHEN raw * cov >= 770 THEN 'strong' WHEN raw * cov >= 100 THEN 'weak' ELSE 'none' END AS grade FROM (SELECT qid, coalesce(max(lex), 0) AS raw FROM (SELECT DISTINCT qid FROM qterm) LEFT JOIN pages_ USING (qid) GROUP BY qid) JOIN (SELECT qid, count(df)::DOUBLE / count(*) AS cov FROM qterm GROUP BY qid) USING (qid)", "lex"))
def query_grades(spark, d):
    _, _, w, b = _parts(spark, d)
    return S.signals(w, b, S.page_scores(b)).select("qid", S.grade(F.col("raw_x_cov"), 770.0, 100.0).alias("grade"))
