"""What a Python worker holds is bounded, whatever comes in one Arrow batch, and nothing is lost by it."""

from __future__ import annotations

from pagewright.functions import markdown
from pagewright.plans import scan
from pagewright.queries import common


def test_parsed_blocks_come_out_in_parts(spark, monkeypatch):
    df = spark.createDataFrame([(f"p{i}", "# A\n\ntext\n\n- x\n- y") for i in range(7)] + [("none", None)], "page_id string, body string").coalesce(1)
    whole = sorted(map(str, markdown.parse_pages(df).collect()))
    monkeypatch.setattr(markdown, "PART", 2)
    assert sorted(map(str, markdown.parse_pages(df).collect())) == whole and len(whole) == 21


def test_strengths_in_passes_and_parts_are_those_of_one(spark, monkeypatch):
    docs = spark.createDataFrame([(f"p{i}", "alpha beta", "en", "s", "gammas", f"delta{i} beta alphabet") for i in range(9)], "page_id string, title string, tags string, projects string, summary string, body string").coalesce(1)
    tokens = spark.createDataFrame([(1, "alpha"), (1, "gammasteel"), (2, "delta3"), (2, "alpha"), (3, "nowhere")], "qid int, token string")
    whole = sorted(map(tuple, scan.token_strengths(docs, tokens).collect()))
    monkeypatch.setattr(scan, "WORDS", 1)
    monkeypatch.setattr(scan, "HITS", 1)
    assert sorted(map(tuple, scan.token_strengths(docs, tokens).collect())) == whole and len(whole) > 20


def test_batches_are_limited_and_smaller_limits_stay(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(name)
    try:
        for given, got in (("10000", "1000"), ("0", "1000"), ("50", "50")):
            spark.conf.set(name, given)
            common.limit_batches(spark)
            assert spark.conf.get(name) == got
    finally:
        spark.conf.set(name, old)
