"""Stores that are wrong or out of date, their files, differences, windows and payloads, on small cases and against brute force."""

import os
import random

import pytest
from pyspark.sql import functions as F

from pagewright.operators import evaluation as E
from pagewright.operators import upkeep as U
from pagewright.sources import json_pages
from tests.test_engine import PAGES, wiki  # noqa: F401


def window_by_trying(text, terms, limit):
    """Every place where a window can begin; those that no term touches in the asked ways are left out."""
    text = " ".join(text.split())
    if len(text) <= limit:
        return text
    low, last = text.lower(), len(text) - limit
    best = None
    for b in range(last + 1):
        low_here = [t for t in set(terms) for x in (b, b + limit // 2, b + limit - len(t)) if low.startswith(t, x)]
        clipped = b == 0 or b == last  # also what would begin before the text or end behind it
        if not (low_here or clipped):
            continue
        w = low[b : b + limit]
        held = [t for t in set(terms) if t in w]
        score = (len(held), sum(w.count(t) for t in held), sum(max(0, min(w.find(t), limit - w.find(t) - len(t))) for t in held))
        if best is None or score > best[0]:
            best = (score, b)
    b = best[1]
    return ("…" if b else text[0]) + text[b + 1 : b + limit - 1] + ("…" if b < last else text[-1])


def test_dense_window(spark):
    rng = random.Random(5)
    words = ["ledger", "zebra", "aa", "aaa", "of", "한글", "X1", "the"]
    cases = [(" ".join(rng.choice(words) for _ in range(rng.randrange(0, 60))), rng.sample(["ledger", "zebra", "aa", "한글", "x1", "none"], 3)) for _ in range(150)]
    for text, terms in cases:
        assert U.densest(text, terms, 40) == window_by_trying(text, terms, 40)
    rows = spark.createDataFrame([("a b", ["a"]), (None, ["a"]), ("x " * 100, None), ("", [])], "text string, terms array<string>")
    for _ in range(2):
        got = [r.window for r in U.dense_windows(rows.withColumn("doc_id", F.lit(1)), "text", "terms", 10).collect()]
        assert got == ["a b", "", ("x " * 100)[:9] + "…", ""]


def test_drift_diff(spark):
    rows = spark.createDataFrame([("a\nb\nc\nd", "a\nb\nX\nd"), ("same", "same"), (None, "new"), ("token = 0123456789abcdef0123456789abcdef01234567", "gone")], "a string, b string")
    got = [r[0] for r in rows.select(U.drift_diff("a", "b")).collect()]
    assert got[0] == ["--- source_text", "+++ data", "@@ -2,3 +2,3 @@", " b", "-c", "+X", " d"]
    assert got[1] == [] and got[2][-1] == "+new" and not any("0123456789abcdef" in x for x in got[3])
    key = "-----BEGIN RSA PRIVATE KEY-----\nMIIEabc\nMIIEdef\n-----END RSA PRIVATE KEY-----"
    lines = spark.createDataFrame([(f"a\n{key}\nb", "a\nb")], "a string, b string").select(U.drift_diff("a", "b")).first()[0]
    assert lines and not any("MIIE" in x for x in lines)


def test_stale_index(spark, tmp_path):
    now = spark.createDataFrame([("page:a", "1"), ("page:b", "2")], "page_id string, sha256 string")
    at = str(tmp_path / "map")
    assert U.stale_index(spark, at, now) == ["missing"]
    now.write.parquet(at)
    assert U.stale_index(spark, at, now) == []
    assert U.stale_index(spark, at, now.filter("page_id = 'page:a'")) == ["stale"]
    assert U.stale_index(spark, at, now.withColumn("sha256", F.lit("1"))) == ["stale"]
    os.makedirs(tmp_path / "bad")
    (tmp_path / "bad" / "x.parquet").write_text("no table")
    assert U.stale_index(spark, str(tmp_path / "bad"), now) == ["unreadable"]


def test_compact(spark, tmp_path):
    a, b = str(tmp_path / "many"), str(tmp_path / "few")
    spark.range(1000).repartition(16).write.parquet(a)
    assert U.compact(spark, a, b) and spark.read.parquet(b).count() == 1000
    assert len([x for x in os.listdir(b) if x.endswith(".parquet")]) == 1
    assert not U.compact(spark, b, a) and spark.read.parquet(a).count() == 1000
    assert U.compact(spark, b, str(tmp_path / "again"), force=True)


def test_shards_follow_changes(spark, wiki, tmp_path):  # noqa: F811
    """Changed pages are replaced, removed ones go, those of the same shards and of others stay, even if a shard loses its last page."""
    pages, at = json_pages.read_pages(spark, wiki), str(tmp_path / "out")
    for shards in (2, 64):
        path = f"{at}-{shards}"
        json_pages.write_pages(pages, path, shards)
        new = pages.filter("slug = 'hub'").withColumn("title", F.lit("Other"))
        json_pages.update_pages(spark, path, new, spark.createDataFrame([("page:long",), ("page:never",)], "id string"), shards)
        back = {r.slug: r for r in json_pages.read_shards(spark, path).collect()}
        assert back.keys() == PAGES.keys() - {"long"} and back["hub"].title == "Other"
        before = {r.slug: r for r in pages.drop("file", "sha256").collect()}
        assert all(back[s].blocks == before[s].blocks and back[s].links == before[s].links for s in back)
        json_pages.update_pages(spark, path, new.limit(0), spark.createDataFrame([], "id string"), shards)
        assert json_pages.read_shards(spark, path).count() == len(back)


def test_paths_stay_inside():
    assert json_pages.inside("/w", "a/../b.json") == "/w/b.json"
    for bad in ("../x.json", "/etc/passwd", "a/../../x", "..", ".", "..\\x"):
        with pytest.raises(ValueError):
            json_pages.inside("/w", bad)


def test_log_keeps_order_of_equal_times(spark, tmp_path):
    at = str(tmp_path / "log")
    for n in range(4):
        json_pages.append_log(spark.createDataFrame([("2024-01-01", 2 * n), ("2024-01-01", 2 * n + 1)], "at string, n long").coalesce(1), at)
    assert [r.n for r in json_pages.read_log(spark, at, 3).collect()] == [5, 6, 7]
    assert json_pages.read_log(spark, at).count() == 8


def test_missing_field_fails(spark):
    df = spark.createDataFrame([('{"a":[1]}',)], "j string").select(F.parse_json("j").alias("v"))
    assert df.select(json_pages.picked(F.col("v"), []).cast("string")).first()[0] == '{"a":[1]}'
    for fields in (["b"], ["a", "1"], ["a", "x"], ["a", "0", "0"]):
        with pytest.raises(Exception, match="no field"):
            df.select(json_pages.picked(F.col("v"), fields).cast("string")).collect()


def test_versions_and_plan(spark):
    v = spark.createDataFrame([("1.10",), ("1.9",), (None,), ("1.9",)], "schema_version string")
    assert {(r.version, r.n, r.lowest) for r in U.schema_versions(v).collect()} == {("", 1, True), ("1.9", 2, False), ("1.10", 1, False)}
    old = spark.createDataFrame([("page:a", "source")], "page_id string, type string")
    new = spark.createDataFrame([("page:a", "entity"), ("page:b", "home"), ("page:x y", "source"), ("page:x-y", "source")], "page_id string, type string")
    rows = {r.page_id: (r.action, r.path, r.moved_from) for r in U.ingest_plan(old, new).collect()}
    assert rows["page:a"] == ("refused", "entities/a.json", None) and rows["page:b"] == ("added", "b.json", None)
    assert {rows["page:x y"][0], rows["page:x-y"][0]} == {"added", "clash"}
    assert [r.moved_from for r in U.ingest_plan(old, new, update=True).filter("action = 'updated'").collect()] == ["sources/a.json"]


def test_delivery_without_gold(spark):
    """Questions without gold, without a payload, and gold that no block is."""
    q = spark.createDataFrame([("1", None, None, None, None), ("2", ["page:a"], ["gone"], ["page:b"], "words")], "qid string, gold_pages array<string>, gold_blocks array<string>, stale_pages array<string>, span string")
    payloads = spark.createDataFrame([("2", "some  words here")], "qid string, text string")
    shown = spark.createDataFrame([("2", "page:a", "block:1", True, "")], "qid string, page_id string, block_id string, body boolean, status string")
    blocks = spark.createDataFrame([("page:b", "block:2", "words here"), ("page:b", "block:3", "")], "page_id string, block_id string, text string")
    got = {r.qid: r for r in E.delivered(q, payloads, shown, blocks).collect()}
    assert got["1"].payload_bytes == 0 and got["1"].stale_leak is None and not got["1"].gold_page and not got["1"].answer
    assert got["2"].gold_page and not got["2"].gold_block and got["2"].answer and got["2"].stale_leak and got["2"].gold_hits == 0
    assert E.delivery_rates(E.delivered(q, payloads, shown, blocks)).first().stale_leak == 1.0
