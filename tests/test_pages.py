"""Ingestion, edits, migration and the glossary."""

import pytest
from pyspark.sql import functions as F

from pagewright.functions import glossary as G
from pagewright.functions import text as T
from pagewright.operators import incremental, integrity, pages
from pagewright.sources import json_pages

NOTE = "---\ntype: concept\ntags: [a, \"b, c\"]\nsources: [hub, user:2024-01-01]\nrelated: [other]\n---\n# My note\n\n- first [[Hub|the hub]]\n\nBody text.\n\nBody text.\n"


@pytest.fixture(scope="module")
def notes(spark):
    return pages.from_markdown(spark.createDataFrame([("/x/my_note.md", NOTE), ("/x/plain.md", "only text")], "path string, value string"), "2024-05-05").cache()


def test_from_markdown(notes):
    p = {r.slug: r for r in notes.collect()}
    a = p["my-note"]
    assert (a.title, a.type, a.tags, a.sources, a.summary) == ("My note", "concept", ["a", "b, c"], ["page:hub", "user:2024-01-01"], "first the hub")
    assert [x.kind for x in a.links] == ["wiki", "related"] and len(a.block_order) == 4
    assert p["plain"].title == "plain"
    assert integrity.structure_errors(notes).count() == 0


def test_credentials_stop_it(spark):
    with pytest.raises(Exception):
        pages.from_markdown(spark.createDataFrame([("a.md", "password: hunter22")], "path string, value string"), "2024-05-05").collect()


def test_ingest_keeps_ids(spark, notes):
    new = pages.from_markdown(spark.createDataFrame([("/x/my_note.md", NOTE.replace("# My note\n", "# My note\n\nNew first.\n"))], "path string, value string"), "2024-06-06")
    with pytest.raises(Exception):
        pages.ingest(notes, new, "2024-06-06").collect()
    got = {r.slug: r for r in pages.ingest(notes, new, "2024-06-06", update=True).collect()}
    old = {r.slug: r for r in notes.collect()}["my-note"].block_order
    assert [i for i in got["my-note"].block_order if i in old] == old and len(got["my-note"].block_order) == 5
    assert got["my-note"].created == "2024-05-05" and got["my-note"].updated == "2024-06-06" and len(got) == 2


def test_edit_leaves_an_alias(spark, notes):
    old = {r.slug: r for r in notes.collect()}["my-note"]
    head, item = old.block_order[:2]
    edits = spark.createDataFrame([(old.id, head, "# New title"), (old.id, item, "para [[Zed]]\n\n- second")], "page_id string, block_id string, fragment string")
    got = {r.slug: r for r in pages.edit(notes, edits, "2024-07-07").collect()}["my-note"]
    assert got.title == "New title" and set(got.block_aliases) == {head, item}
    assert got.blocks[got.block_aliases[item]].kind == "list" and [x.target for x in got.links] == ["other", "Zed"]
    again = spark.createDataFrame([(old.id, item, "- third")], "page_id string, block_id string, fragment string")
    twice = {r.slug: r for r in pages.edit(spark.createDataFrame([got], notes.schema), again, "2024-07-08").collect()}["my-note"]
    assert twice.blocks[twice.block_aliases[item]].data.items == ["third"] and set(twice.block_aliases.values()) <= set(twice.blocks)


def test_markdown_round_trip(spark, notes):
    files = pages.as_markdown(notes).select(F.concat(F.regexp_replace("page_id", "page:", ""), F.lit(".md")).alias("path"), F.col("markdown").alias("value"))
    back = {r.slug: r for r in pages.from_markdown(files, "2024-05-05").collect()}
    for r in notes.collect():
        assert back[r.slug].block_order == r.block_order and back[r.slug].tags == r.tags


def test_migrate(spark):
    old = spark.createDataFrame([("a", "1.0"), ("b", "1.1")], "id string, schema_version string")
    got = incremental.migrate(old, {"1.0": ("1.1", lambda d: d.withColumn("id", F.upper("id")))}, "1.1")
    assert sorted(map(tuple, got.collect())) == [("A", "1.1"), ("b", "1.1")]
    with pytest.raises(Exception):
        incremental.migrate(old.withColumn("schema_version", F.lit("9")), {}, "1.1").collect()


def test_glossary(spark):
    g = G.parse([["feature", "변수"], ["ae", "auto encoder"], ["x"], ["실행 계획", "execution plan"], ["plan", "계획"]])
    assert g.expand("변수별 통계") == {"feature": frozenset({"변수"})}
    assert g.found("환경변수") == {} and g.found("aerial") == {} and set(g.found("ae model")) == {1}
    assert set(g.found("실행 계획을")) == {2}
    assert G.parse([["a"]]) is None
    df = spark.createDataFrame([(0, "변수별 통계"), (1, None), (2, "ae")], "qid long, text string")
    assert {(r.qid, r.term) for r in G.added_terms(df, g).collect()} == {(0, "feature"), (2, "auto"), (2, "encoder")}
    for t in ("기능에서는 v2.3.1 x_y-zed", "바꿨다던데 login_rate"):
        assert spark.range(1).select(T.tokens(F.lit(t), query=True).alias("t")).first().t == G.query_tokens(t)


def test_pending_and_raw_files(spark, tmp_path):
    for name in ("a.txt", "b.md", ".hidden", "c.log"):
        (tmp_path / name).write_text("x")
    files = json_pages.file_states(spark, str(tmp_path), "*")
    raw = json_pages.raw_files(files, tmp_path.name, ["*.log"])
    assert sorted(r.rel for r in raw.collect()) == ["a.txt", "b.md"]
    assert [r.rel for r in json_pages.pending(raw, spark.createDataFrame([("raw:x/y/a.txt",)], "ref string")).collect()] == ["b.md"]
