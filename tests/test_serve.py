"""The service functions, on the knowledge base of test_engine."""

from pyspark.sql import functions as F

from pagewright.plans import serve
from tests.test_engine import idx, kb, wiki  # noqa: F401


def test_prompts(spark):
    df = spark.createDataFrame([(" ", "hello there"), ("/cmd x", None), ("ab", ""), ("see <kb-context v=1>", "")], "a string, b string").withColumn("p", serve.prompt_of("a", "b"))
    assert [r.s for r in df.select(serve.should_skip("p").alias("s")).collect()] == [False, True, True, True]


def test_pages_in_parts(spark, idx, kb):  # noqa: F811
    rows = serve.always(kb.pages, kb.blocks, ["policy-2", "hub"]).orderBy("place").collect()
    assert [r.slug for r in rows] == ["policy-2", "hub"] and serve.always(kb.pages, kb.blocks, ["hub"], budget=3).count() == 0
    assert serve.get_outline(kb.blocks, ["page:alpha"]).filter("conflict").count() == 1
    assert serve.page_meta(kb.pages, ["slug", "title", "nope"]).columns == ["slug", "title"]
    ids = [r.block_id for r in kb.blocks.filter("page_id = 'page:alpha'").orderBy("pos").collect()]
    wanted = spark.createDataFrame([(0, ids[1]), (1, "old"), (2, "nowhere"), (3, ids[1])], "n int, wanted string")
    got = serve.get_blocks(kb.blocks, spark.createDataFrame([("old", ids[0])], "old_id string, block_id string"), wanted).orderBy("n").collect()
    assert [(r.n, r.block_id) for r in got] == [(0, ids[1]), (1, ids[0]), (2, None)]


def test_search_rows_and_probe(spark, idx):  # noqa: F811
    q = spark.createDataFrame([(0, "zebra retention thirty")], "qid long, text string")
    rows = serve.search_rows(idx, q, 500).orderBy("rank").collect()
    assert rows[1].superseded_by == "page:policy-2" and rows[0].superseded_by is None
    assert "policy-2" not in [r.slug for r in serve.without_pinned(serve.search_rows(idx, q), ["PAGE:policy-2"]).collect()]
    probe = serve.probe_query(idx).first()
    asked = spark.createDataFrame([(0, probe.query)], "qid long, text string")
    assert probe.page_id in [r.page_id for r in serve.search_rows(idx, asked).collect()]


def test_thresholds(spark, monkeypatch):
    monkeypatch.setenv("X_HUB", "nope")
    assert serve.threshold("hub", {"hub": "7"}, 3.0, "X_HUB") == 7.0 and serve.threshold("hub", {"hub": -1}, 3.0) == 3.0
    df = spark.range(100).select("id", F.col("id").alias("s"), (F.col("id") >= 50).alias("y"))
    r = serve.calibrated(df, "s", "y", "id").first()
    assert r.tpr >= 0.95 and r.fpr <= 0.06
