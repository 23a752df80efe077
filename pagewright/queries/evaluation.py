"""Queries that measure rankings, scores and the scan path, and those over events and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright.operators import evaluation as E
from pagewright.operators import vectors
from pagewright.plans import scan, scan_best, search
from pagewright.queries import query
from pagewright.queries.common import base, index, limit_batches
from pagewright.queries.sql import sql
from pagewright.sources import tables

GOLD = "gs AS (SELECT b.item_id AS qid, p.page_id, coalesce(h.head, p.page_id) <> p.page_id AS old FROM page p JOIN benchmark b ON contains(p.text, b.text) LEFT JOIN head h USING (page_id))"


def gold(spark, d):
    """Gold and stale pages of each passage: those that hold it verbatim, current ones and older versions."""
    held = scan.holding(tables.documents_as_pages(tables.table(spark, d, "documents")).select("page_id", "text"), tables.questions(spark, d))
    known = held.join(index(spark, d).heads, "page_id", "left").select("qid", "page_id", (F.coalesce("head", "page_id") != F.col("page_id")).alias("old"))
    return known.filter("NOT old").select("qid", "page_id"), known.filter("old").select("qid", "page_id")


def _rounded(df, *but):
    return df.select(*(c if c in but or t != "double" else F.round(c, 6).alias(c) for c, t in df.dtypes))


@query(sql("SELECT qid, page_id, old FROM gs", "head").replace("\nSELECT", f",\n{GOLD}\nSELECT"))
def gold_pages(spark, d):
    a, b = gold(spark, d)
    return a.withColumn("old", F.lit(False)).unionByName(b.withColumn("old", F.lit(True)))


_METRICS = sql("""SELECT qid, round(CASE WHEN n > 0 THEN f1 / n ELSE 0 END, 6) AS recall_1, round(CASE WHEN n > 0 THEN f5 / n ELSE 0 END, 6) AS recall_5, round(CASE WHEN n > 0 THEN f10 / n ELSE 0 END, 6) AS recall_10,
  (f1 > 0)::INT::DOUBLE AS hit_1, (f5 > 0)::INT::DOUBLE AS hit_5, (f10 > 0)::INT::DOUBLE AS hit_10, round(CASE WHEN n > 0 THEN f5 / 5.0::DOUBLE ELSE 0 END, 6) AS precision_5,
  round(CASE WHEN first <= 10 THEN 1.0::DOUBLE / first ELSE 0 END, 6) AS mrr_10, round(CASE WHEN n > 0 THEN dcg / list_sum(list_transform(range(1, least(n, 10)::BIGINT + 1), lambda i: 1 / log2(i + 1.0::DOUBLE))) ELSE 0 END, 6) AS ndcg_10,
  CASE WHEN ns = 0 THEN -1.0::DOUBLE WHEN first_stale IS NULL THEN 0 WHEN first IS NULL OR first_stale < first THEN 1 ELSE 0 END AS stale_above
FROM (SELECT item_id AS qid, coalesce(n, 0)::DOUBLE AS n, coalesce(ns, 0) AS ns, coalesce(f1, 0)::DOUBLE AS f1, coalesce(f5, 0)::DOUBLE AS f5, coalesce(f10, 0)::DOUBLE AS f10, first, first_stale, coalesce(dcg, 0)::DOUBLE AS dcg FROM benchmark
  LEFT JOIN (SELECT qid AS item_id, count(*) FILTER (NOT old) AS n, count(*) FILTER (old) AS ns FROM gs GROUP BY qid) USING (item_id)
  LEFT JOIN (SELECT r.qid AS item_id, count(*) FILTER (NOT old AND rank <= 1) AS f1, count(*) FILTER (NOT old AND rank <= 5) AS f5, count(*) FILTER (NOT old AND rank <= 10) AS f10, min(rank) FILTER (NOT old) AS first,
    min(rank) FILTER (old) AS first_stale, sum(1 / log2(rank + 1.0::DOUBLE)) FILTER (NOT old AND rank <= 10) AS dcg FROM result r JOIN gs ON gs.qid = r.qid AND gs.page_id = r.page_id GROUP BY r.qid) USING (item_id))""", "comb", "head", "fold", "final").replace("\nSELECT qid, round(CASE", f",\n{GOLD}\nSELECT qid, round(CASE")


@query(_METRICS)
def ir_metrics(spark, d):
    q = tables.questions(spark, d)
    return _rounded(E.query_metrics(q, search.search(index(spark, d), q), *gold(spark, d)))


@query("SELECT round(sum(CASE WHEN p.v > n.v THEN 1.0::DOUBLE WHEN p.v = n.v THEN 0.5::DOUBLE ELSE 0 END) / count(*), 6) AS auc FROM (SELECT n_chars AS v FROM documents JOIN labels USING (doc_id) WHERE quality = 1) p, (SELECT n_chars AS v FROM documents JOIN labels USING (doc_id) WHERE quality = 0) n")
def auc(spark, d):
    return _rounded(E.auc(_labelled(spark, d), "n_chars", "good"))


def _labelled(spark, d):
    return tables.table(spark, d, "documents").join(tables.table(spark, d, "labels"), "doc_id").select("doc_id", "lang", "n_chars", (F.col("quality") == 1).alias("good"))


_ROC = """WITH s AS (SELECT n_chars AS v, count(*) FILTER (quality = 1) AS p, count(*) FILTER (quality <> 1) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1),
c AS (SELECT v AS threshold, sum(p) OVER (ORDER BY v DESC)::DOUBLE / (SELECT sum(p) FROM s) AS tpr, sum(n) OVER (ORDER BY v DESC)::DOUBLE / (SELECT sum(n) FROM s) AS fpr FROM s)
"""


@query(_ROC + "SELECT threshold, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr FROM c")
def roc_sweep(spark, d):
    return _rounded(E.roc(_labelled(spark, d), "n_chars", "good"))


@query(_ROC + "SELECT threshold, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr FROM c WHERE fpr <= 0.05 ORDER BY tpr DESC, threshold DESC LIMIT 1")
def best_threshold(spark, d):
    return _rounded(E.best_threshold(E.roc(_labelled(spark, d), "n_chars", "good")))


@query("""WITH v AS (SELECT lang, n_chars AS x, row_number() OVER (PARTITION BY lang ORDER BY n_chars) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents WHERE n_chars IS NOT NULL)
SELECT lang, max(n) AS n, max(x) FILTER (i = round_even(0.05::DOUBLE * (n - 1), 0)) AS p05, max(x) FILTER (i = round_even(0.5::DOUBLE * (n - 1), 0)) AS p50, max(x) FILTER (i = round_even(0.95::DOUBLE * (n - 1), 0)) AS p95,
max(x) FILTER (i = round_even(0.99::DOUBLE * (n - 1), 0)) AS p99, min(x) AS least, max(x) AS most, round(avg(x), 4) AS mean FROM v GROUP BY lang""")
def percentile_summary(spark, d):
    x = E.distribution(tables.table(spark, d, "documents"), ["lang"], "n_chars")
    return x.withColumn("mean", F.round("mean", 4))


@query("SELECT round(avg(x) FILTER (x >= 0), 4) AS x, count(*) FILTER (x >= 0) AS x_n FROM (SELECT CASE WHEN quality = 1 THEN toxic ELSE -1 END AS x FROM labels)")
def mean_where_known(spark, d):
    return E.mean_where_known(tables.table(spark, d, "labels").select(F.when(F.col("quality") == 1, F.col("toxic")).otherwise(-1).cast("double").alias("x")), "x")


_RRF = sql("""SELECT qid, page_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(sum(1.0::DOUBLE / (60 + rank)), 12) DESC, page_id) AS rank FROM (
  SELECT * FROM (SELECT qid, page_id, row_number() OVER (PARTITION BY qid ORDER BY round(lex, 6) DESC, page_id) AS rank FROM pages_) WHERE rank <= 10
  UNION ALL SELECT * FROM (SELECT qid, page_id, row_number() OVER (PARTITION BY qid ORDER BY round(rel, 6) DESC, page_id) AS rank FROM rell) WHERE rank <= 10) GROUP BY qid, page_id""", "rel")


@query(_RRF)
def rrf_fusion(spark, d):
    return E.rrf(*_two(spark, d)).select("qid", "page_id", F.round("score", 9).alias("score"), "rank")


def _two(spark, d):
    i, q = index(spark, d), tables.questions(spark, d)
    w = search.weighed_terms(i, search.query_terms(q))
    p = search.page_scores(search.block_scores(i, w))
    rel = search.relative(search.reranked(i, p))
    top = lambda x, c: x.withColumn("rank", search._rank(["qid"], F.desc(F.round(c, 6)), "page_id")).filter("rank <= 10").select("qid", "rank", "page_id", F.col(c).alias("score"))
    return top(p, "lex"), top(rel, "rel")


@query(sql("""SELECT qid, rank, page_id FROM (
  SELECT qid, rank, page_id FROM a UNION ALL
  SELECT b.qid, s.n + row_number() OVER (PARTITION BY b.qid ORDER BY b.rank), b.page_id FROM b JOIN s USING (qid) WHERE NOT sure AND NOT EXISTS (SELECT 1 FROM a WHERE a.qid = b.qid AND a.page_id = b.page_id)) WHERE rank <= 10""", "rel").replace("\nSELECT qid, rank, page_id FROM (", """,
a AS (SELECT * FROM (SELECT qid, page_id, lex AS score, row_number() OVER (PARTITION BY qid ORDER BY round(lex, 6) DESC, page_id) AS rank FROM pages_) WHERE rank <= 10),
b AS (SELECT * FROM (SELECT qid, page_id, row_number() OVER (PARTITION BY qid ORDER BY round(rel, 6) DESC, page_id) AS rank FROM rell) WHERE rank <= 10),
s AS (SELECT qid, max(rank) AS n, max(score) FILTER (rank = 1) >= 3.0 AND (max(score) FILTER (rank = 1) - coalesce(max(score) FILTER (rank = 2), 0)) / max(score) FILTER (rank = 1) >= 0.15 AS sure FROM a GROUP BY qid)
SELECT qid, rank, page_id FROM (""", 1))
def confident_fusion(spark, d):
    return E.append_unless_confident(*_two(spark, d))


@query("""SELECT qid, rank, vec_id, round(score, 4) AS score FROM (SELECT q.vec_id AS qid, e.vec_id, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS score,
row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9) DESC, e.vec_id) AS rank FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0) WHERE rank <= 10""")
def vector_topk(spark, d):
    e = tables.table(spark, d, "embeddings")
    q = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), "embedding")
    return vectors.nearest(e, q).select("qid", "rank", "vec_id", F.round("score", 4).alias("score"))


def _prompts(spark, d):
    """The first user turn of each conversation is a prompt of the scan path."""
    c = tables.table(spark, d, "conversations").filter("role = 'user'").groupBy(F.col("conv_id").alias("qid")).agg(F.min_by("text", F.struct("turn", "text")).alias("text"))
    return c.withColumn("text", F.coalesce("text", F.lit("")))


def _scanned(spark, d, top):
    limit_batches(spark)
    kb = base(spark, d)
    return scan_best.best(scan.fields(kb.pages, kb.blocks_once()), scan.query_tokens(_prompts(spark, d)), top)


@query()
def scan_rank(spark, d):
    """The best pages of each prompt. SQL holds each token against each text and is too slow for whole tables; a test does it on small ones."""
    return _scanned(spark, d, 20).select("qid", "rank", "page_id", "score", "matched")


@query()
def scan_gate(spark, d):
    return scan.gate(_prompts(spark, d), _scanned(spark, d, 1))


@query(sql("SELECT qid, page_id, round(l + 0.02::DOUBLE * q, 6) AS score FROM rell JOIN page USING (page_id) JOIN (SELECT updated, (dense_rank() OVER (ORDER BY updated) - 1)::DOUBLE / greatest(count(*) OVER () - 1, 1) AS q FROM (SELECT DISTINCT updated FROM page)) USING (updated)", "rel"))
def recency_rank(spark, d):
    i, q = index(spark, d), tables.questions(spark, d)
    w = search.weighed_terms(i, search.query_terms(q))
    rel = search.relative(search.reranked(i, search.page_scores(search.block_scores(i, w))))
    return E.recency(rel.select("qid", "page_id", F.col("l").alias("score")), i.pages).withColumn("score", F.round("score", 6))


@query("SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def events_windows(spark, d):
    e = tables.table(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return e.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", "total")


@query("""WITH g AS (SELECT *, sum(CASE WHEN prev IS NULL OR ts >= prev + INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events))
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM g GROUP BY user_id, s""")
def events_sessions(spark, d):
    e = tables.table(spark, d, "events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return e.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("SELECT user_id, event_type, count(*) AS n_days FROM (SELECT DISTINCT user_id, event_type, ts::DATE AS day FROM events) GROUP BY 1, 2")
def events_dedup(spark, d):
    e = tables.table(spark, d, "events").select("user_id", "event_type", F.to_date("ts").alias("day")).dropDuplicates()
    return e.groupBy("user_id", "event_type").agg(F.count("*").alias("n_days"))
