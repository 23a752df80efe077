"""What a query writes and deals out: only the tables that it reads, blocks' text once, and no table of the index to meet a batch's rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pagewright.operators import index as I
from pagewright.plans import context as C
from pagewright.plans import cut as K
from pagewright.plans import search as S
from pagewright.queries import load
from pagewright.sources import tables

DOCS = [(i, f"Alpha {i}\nbeta gamma word{i % 3}\n\ndelta beta line{i % 2}\nbeta gamma word{i % 3}", "en", f"s{i % 2}", 10) for i in range(9)] + [(9, None, "de", "t", 0), (10, "Alpha 1\nbeta gamma word1\n\ndelta beta line1\nbeta gamma word1", "en", "s1", 10)]


@pytest.fixture
def small(spark, tmp_path):
    spark.createDataFrame(DOCS, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "beta word1"), (2, "delta line0 gamma"), (3, "nothing known")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


@pytest.fixture
def written(monkeypatch):
    """The tables that are written, each with its columns."""
    out = []
    for module in (tables, I, S):
        monkeypatch.setattr(module, "cut", lambda df, sort=None, real=module.cut: (out.append(df), real(df, sort))[1])
    return out


@pytest.mark.parametrize("name", ["display_edges", "adjacency_top64", "supersede_chains"])
def test_queries_on_links_write_no_blocks(spark, small, written, name):
    assert load()[0][name](spark, small).count() > 0
    assert written and not [df.columns for df in written if "text" in df.columns]


def test_blocks_are_written_once_with_their_bags(spark, small, written):
    for name in ("tokenize_terms", "term_df", "corpus_stats", "search_topk"):
        assert load()[0][name](spark, small).count() > 0
    assert ["bag" in df.columns for df in written if "text" in df.columns] == [True]


def test_blank_blocks_count_for_their_page_alone(spark):
    pages = spark.createDataFrame([("p", "p", "Title", "source", [], [])], "page_id string, slug string, title string, type string, tags array<string>, keywords array<string>")
    blocks = spark.createDataFrame([("p", 0, "a", "heading", "Head", 1, False), ("p", 1, "b", "paragraph", " ", None, True), ("p", 2, "c", "paragraph", None, None, False), ("p", 3, "d", "paragraph", "one two", None, False)], "page_id string, pos int, block_id string, kind string, text string, level int, unresolved boolean")
    links = spark.createDataFrame([], "page_id string, ord int, target string, kind string, label string, anchor string, block_id string")
    for paths in (False, True):
        index = I.Deferred(tables.KnowledgeBase(pages, blocks, links), with_paths=paths)
        p, s = index.pages.first(), index.stats.first()
        assert (p.n_blocks, p.unresolved, p.n_body, p.first_ev) == (4, 1, 2, "d") and s.n_blocks == 3
        assert sorted(r.pos for r in index.blocks.collect()) == [-1, 0, 3] and index.blocks.columns == [c for c in index.bags.columns if c != "bag"]


def test_a_batch_meets_the_index_without_dealing_it_out(spark, small, written, monkeypatch):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    met = []
    real = {m: m.few for m in (S, C)}
    try:
        index, asked, got = I.Deferred(tables.from_documents(spark, small)), tables.questions(spark, small), []
        for few in (K.FEW, 0):
            monkeypatch.setattr(K, "FEW", few)
            met.clear()
            for m in (S, C):
                monkeypatch.setattr(m, "few", lambda df, f=real[m]: (met.append(df.columns), f(df))[1])
            written.clear()
            got.append(sorted(map(str, C.contexts(index, asked).collect())))
            scores = next(df for df in written if df.columns == ["qid", "page_id", "pos", "ev", "score", "content"])
            plan = scores._jdf.queryExecution().executedPlan().toString()
            assert ("BroadcastHashJoin" in plan) == (few > 0)
            assert len(met) == 2 + S.Options().steps + 1 and ["term", "idf", "avg_len"] in met and met.count(["qid", "src", "mass"]) == S.Options().steps
            spreads = S.spread(index, S.relative(S.reranked(index, S.page_scores(scores))))
            assert ("BroadcastHashJoin" in spreads.select(F.col("qid"))._jdf.queryExecution().executedPlan().toString()) == (few > 0)
        assert got[0] == got[1] and any("beta" in r for r in got[0])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
