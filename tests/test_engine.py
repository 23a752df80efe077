"""Search, context, incremental maintenance, sources, integrity and streams on small knowledge bases."""

import json
import os

import pytest
from pyspark.sql import functions as F

from pagewright.functions import fixed, markdown
from pagewright.operators import artifacts, evaluation, incremental, integrity, links
from pagewright.operators import index as I
from pagewright.plans import context, scan, search
from pagewright.sources import json_pages
from pagewright.sources.tables import KnowledgeBase
from pagewright.streaming import changes

PAGES = {
    "hub": ("concept", "# Hub\n\nAll topics meet here."),
    "alpha": ("concept", "# Alpha\n\nThe alpha platform stores ledgers.\n\n> ⚠️ 상충: ledger size is 3 or 4"),
    "beta": ("source", "# Beta\n\nBeta imports ledgers from alpha with login_rate_limited calls. See [[alpha]]."),
    "policy-1": ("source", "# Policy one\n\nRetention is thirty days for zebra records."),
    "policy-2": ("source", "# Policy two\n\nRetention is sixty days for zebra records."),
    "long": ("entity", "# Long\n\n" + "\n\n".join(f"Row {i} speaks of giraffe number {i}." for i in range(30))),
}
LINKS = [("beta", "alpha", "related"), ("policy-2", "policy-1", "supersedes"), ("long", "hub", "wiki"), ("alpha", "hub", "wiki"), ("beta", "nowhere", "wiki")]


def canonical(slug, kind, body, extra=()):
    blocks = markdown.parse(f"page:{slug}", body)
    own = next((b["id"] for b in blocks if b["kind"] != "heading"), "")
    declared = [{"target": t, "label": t, "anchor": "", "kind": k, "block_id": own if k != "wiki" else ""} for s, t, k in [*LINKS, *extra] if s == slug]
    return {
        "schema_version": fixed.SCHEMA_VERSION, "id": f"page:{slug}", "slug": slug, "title": markdown.norm(body.split("\n")[0].lstrip("# ")), "type": kind, "created": "2024-01-01", "updated": "2024-01-02",
        "tags": ["t"], "projects": ["p"], "sources": ["page:hub"] if slug == "beta" else [], "summary": "" if slug == "hub" else body[:40], "blocks": {b["id"]: b for b in blocks}, "block_order": [b["id"] for b in blocks],
        "links": declared, "history": [{"at": "2024-01-01", "action": "created", "actor": "x"}],
    }


def write(path, pages, name="pages.json"):
    os.makedirs(path, exist_ok=True)
    with open(f"{path}/{name}", "w") as f:
        json.dump(pages, f, ensure_ascii=False)


@pytest.fixture(scope="module")
def wiki(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("wiki"))
    every = [canonical(s, k, b) for s, (k, b) in PAGES.items()]
    write(path, every[:3])
    write(f"{path}/deep", every[3], "policy-1.json")
    write(path, every[4:], "rest.json")
    write(path, [1], ".hidden.json")
    with open(f"{path}/broken.json", "w") as f:
        f.write("{nope")
    return path


@pytest.fixture(scope="module")
def kb(spark, wiki):
    return json_pages.knowledge_base(json_pages.read_pages(spark, wiki))


@pytest.fixture(scope="module")
def idx(spark, kb):
    return I.build(kb)


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "qid long, text string")


def hits(spark, idx, text, **o):
    return search.search(idx, asked(spark, text), search.Options(**o)).orderBy("rank").collect()


def test_read_pages(spark, wiki, kb):
    assert {r.page_id for r in kb.pages.collect()} == {f"page:{s}" for s in PAGES}
    assert kb.blocks.filter("unresolved").count() == 1
    with pytest.raises(Exception):
        json_pages.read_pages(spark, wiki, strict=True).collect()


def test_shards_and_log(spark, wiki, tmp_path):
    pages = json_pages.read_pages(spark, wiki)
    json_pages.write_pages(pages, str(tmp_path / "out"), 4)
    back = json_pages.read_shards(spark, str(tmp_path / "out"))
    assert back.count() == len(PAGES) and back.filter("size(blocks) = 0").count() == 0
    for n in range(3):
        json_pages.append_log(spark.createDataFrame([(f"2024-01-0{n + 1}", "edit")], "at string, action string"), str(tmp_path / "log"))
    assert [r.at for r in json_pages.read_log(spark, str(tmp_path / "log"), 2).collect()] == ["2024-01-02", "2024-01-03"]
    assert json_pages.file_states(spark, wiki).count() >= 3


def test_search_folds_versions(spark, idx):
    got = hits(spark, idx, "zebra retention thirty")
    assert [r.slug for r in got][:2] == ["policy-2", "policy-1"]
    assert got[1].state == "stale" and got[1].score == pytest.approx(0.3 * got[0].score, abs=1e-6)
    flat = hits(spark, idx, "zebra retention thirty", fold=False)
    assert flat[0].slug == "policy-1"


def test_search_reaches_neighbours(spark, idx):
    assert "alpha" in [r.slug for r in hits(spark, idx, "login_rate_limited")]
    assert "alpha" not in [r.slug for r in hits(spark, idx, "login_rate_limited", graph=False)]
    assert hits(spark, idx, "xylophone quux") == [] and hits(spark, idx, "") == []


def test_anchor_and_noisy_or():
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    rel = spark.createDataFrame([(0, "a", 0.5), (0, "b", 1.0)], "qid long, page_id string, l double")
    g = spark.createDataFrame([(0, "a", 1.0, "x"), (0, "b", 3.0, "y"), (0, "c", 0.2, "z")], "qid long, page_id string, g double, own string")
    got = {r.page_id: r.score for r in search.combined(rel, g).collect()}
    assert got == {"a": pytest.approx(0.925), "b": pytest.approx(1.0), "c": pytest.approx(0.17)}


def test_published_index_gives_the_same(spark, idx, tmp_path):
    I.publish(idx, str(tmp_path / "i"), spark, 1)
    again = I.open_published(str(tmp_path / "i"), spark)
    assert hits(spark, again, "ledgers alpha") == hits(spark, idx, "ledgers alpha")
    with pytest.raises(FileNotFoundError):
        I.open_published(str(tmp_path / "none"), spark)


def test_context_keeps_both_budgets(spark, idx):
    q = asked(spark, "giraffe number 7", "zebra retention", "ledgers alpha login", "xylophone quux")
    for most, tokens in ((6000, 2000), (500, 2000), (6000, 130), (120, 2000)):
        for r in context.contexts(idx, q, most_bytes=most, most_tokens=tokens).collect():
            assert len(r.text.encode()) <= most and context.tokens_of(r.text) <= tokens
    texts = {r.qid: r.text for r in context.contexts(idx, q).collect()}
    assert "B policy-2#" in texts[1] and "sup→policy-2" in texts[1] and "thirty days" not in texts[1]
    assert texts[3] == "" and "giraffe number 7" in texts[0]
    weak = {r.qid: r.text for r in context.contexts(idx, q, silence=1e9, hint=0.001).collect()}
    assert "A " in weak[0] or weak[0] == "" or "weak" in weak[0]


def test_select_rows():
    table = "| name | size |\n|---|---|\n" + "\n".join(f"| item{i} | {i} |" for i in range(60))
    got = context.select_rows(table, {"item42": 2.0})
    assert got.startswith("| name | size |") and "item42" in got and len(got) <= 320 and "---" not in got
    assert context.select_rows("short  text", {}) == "short text"
    assert len(context.select_rows("word " * 200, {})) <= 320
    assert context.select_rows("x" * 400 + "\n" + "y" * 400, {"y": 1.0}).startswith("y" * 300)


MUTATIONS = {
    "body edit": lambda p: p["alpha"].update(canonical("alpha", "concept", "# Alpha\n\nNow it stores giraffe files.")),
    "delete head": lambda p: p.pop("policy-2"),
    "new page resolves a dangling link": lambda p: p.update(nowhere=canonical("nowhere", "concept", "# Nowhere\n\nFound at last.")),
    "title collision and new edge": lambda p: p.update(again=canonical("again", "source", "# Alpha\n\nAnother.", [("again", "policy-2", "supersedes"), ("again", "long", "related")])),
}


@pytest.mark.parametrize("name", sorted(MUTATIONS))
def test_incremental_equals_full(spark, idx, tmp_path, name):
    pages = {s: canonical(s, k, b) for s, (k, b) in PAGES.items()}
    MUTATIONS[name](pages)
    write(str(tmp_path), list(pages.values()))
    new = json_pages.knowledge_base(json_pages.read_pages(spark, str(tmp_path)))
    hashes = lambda ps: spark.createDataFrame([(p["id"], json.dumps(p, sort_keys=True)) for p in ps], "page_id string, sha256 string")
    old_pages = [canonical(s, k, b) for s, (k, b) in PAGES.items()]
    delta = incremental.changes(hashes(old_pages), hashes(pages.values()))
    moved, full = incremental.apply(idx, new, delta), I.build(new)
    for t in I.TABLES:
        a, b = getattr(full, t), getattr(moved, t)
        assert I.digest(a).collect() == I.digest(b.select(*a.columns)).collect(), t


def test_lint_and_validation(spark, kb, idx, wiki):
    kinds = {(r.page_id, r.kind) for r in integrity.lint(idx.pages, kb.blocks, idx.links).collect()}
    assert ("page:beta", "missing_target") in kinds and ("page:hub", "empty_summary") in kinds and ("page:alpha", "unresolved_conflict") in kinds
    pages = json_pages.read_pages(spark, wiki)
    assert integrity.structure_errors(pages).count() == 0
    broken = pages.withColumn("block_order", F.slice("block_order", 1, 1)).withColumn("block_aliases", F.create_map(F.lit("x"), F.lit("gone")))
    errors = {r.error for r in integrity.structure_errors(broken).collect()}
    assert "block_order mismatch" in errors and "alias points at unknown block gone" in errors
    assert integrity.page_errors(kb.pages).count() == 0


def test_schema_errors(spark):
    schema = {"type": "object", "required": ["id"], "additionalProperties": False, "properties": {"id": {"$ref": "#/$defs/id"}, "tags": {"type": "array", "items": {"type": "string", "minLength": 2}, "uniqueItems": True}, "at": {"type": ["string", "null"], "format": "date"}}, "$defs": {"id": {"type": "string", "pattern": "^page:"}}}
    assert integrity.schema_errors({"id": "page:x", "tags": ["ab"], "at": None}, schema) == []
    got = integrity.schema_errors({"id": "x", "tags": ["a", "a"], "at": "1.1.2024", "more": 1}, schema)
    assert len(got) == 6 and integrity.schema_errors({}, schema) == ["/: lacks id"] and integrity.schema_errors([], schema)
    df = integrity.json_errors(spark.createDataFrame([('{"id":"page:x"}',), ("{",), (None,)], "j string"), "j", schema)
    assert [len(r.errors) for r in df.collect()] == [0, 1, 1]


def test_drift_and_repair(spark, wiki):
    b = json_pages.read_pages(spark, wiki).select(F.col("id").alias("page_id"), F.explode(F.map_values("blocks")).alias("b"))
    rows = b.select("page_id", F.col("b.id").alias("block_id"), "b.kind", "b.source_text", "b.fingerprint", "b.refs", F.lit(None).cast("string").alias("data"))
    assert integrity.block_drift(rows).count() == 0
    bad = rows.withColumn("source_text", F.when(F.col("kind") == "paragraph", F.concat("source_text", F.lit(" more"))).otherwise(F.col("source_text"))).withColumn("data", F.when(F.col("kind") == "paragraph", F.to_json(F.struct(F.regexp_replace("source_text", " more$", "").alias("text")))))
    assert integrity.block_drift(bad).count() > 0
    verdicts = {r.verdict for r in integrity.repair(bad).collect()}
    assert verdicts == {"source"}
    assert integrity.repair(rows.withColumn("refs", F.array(F.lit("zzz")))).filter("verdict <> 'derived'").count() == 0


def test_keep_block_ids(spark):
    old = spark.createDataFrame([("p", 0, "a1", "f"), ("p", 1, "a2", "f")], "page_id string, pos int, block_id string, fingerprint string")
    new = spark.createDataFrame([("p", 0, "n1", "g"), ("p", 1, "n2", "f"), ("p", 2, "n3", "f"), ("p", 3, "n4", "f")], "page_id string, pos int, block_id string, fingerprint string")
    assert [r.block_id for r in integrity.keep_block_ids(old, new).orderBy("pos").collect()] == ["n1", "a1", "a2", "n4"]


def test_metrics(spark):
    q = spark.createDataFrame([(0,), (1,), (2,)], "qid long")
    h = spark.createDataFrame([(0, 1, "b"), (0, 2, "a"), (1, 1, "s"), (1, 2, "g")], "qid long, rank int, page_id string")
    gold = spark.createDataFrame([(0, "a"), (1, "g")], "qid long, page_id string")
    stale = spark.createDataFrame([(1, "s"), (2, "t")], "qid long, page_id string")
    got = {r.qid: r for r in evaluation.query_metrics(q, h, gold, stale).collect()}
    assert (got[0].recall_1, got[0].recall_5, got[0].mrr_10) == (0.0, 1.0, 0.5) and got[0].ndcg_10 == pytest.approx(0.63093, abs=1e-5)
    assert (got[0].stale_above, got[1].stale_above, got[2].stale_above) == (-1.0, 1.0, 0.0)


def test_groups_and_routes(spark, kb):
    g = artifacts.project_groups(["b", "a", "A"], {"multi": {"match": []}, "x": {"color": "#65e79c", "match": ["B"]}})
    assert list(g) == ["x", "a", "multi"] and g["a"]["color"] == "#ff8dca" and g["a"]["label"] == "A"
    table = artifacts.group_table(spark, g)
    pages = spark.createDataFrame([("p1", ["b"]), ("p2", ["a", "b"]), ("p3", []), ("p4", ["A"])], "page_id string, projects array<string>")
    assert {r.page_id: r.group for r in artifacts.page_groups(pages, table).collect()} == {"p1": "x", "p2": "multi", "p3": "ungrouped", "p4": "a"}


def test_implied_links(spark):
    p = spark.createDataFrame([("page:p", ["user:x", "page:q", "source:r"])], "page_id string, sources array<string>")
    declared = spark.createDataFrame([("page:p", 0, "A", "wiki", "")], "page_id string, ord int, target string, kind string, block_id string")
    blocks = spark.createDataFrame([("page:p", 0, "b0", "[[a]] and [[c]]"), ("page:p", 1, "b1", "[[c]]")], "page_id string, pos int, block_id string, text string")
    got = [(r.target, r.kind, r.block_id) for r in links.implied(p, declared, blocks).orderBy("ord").collect()]
    assert got == [("A", "wiki", ""), ("c", "wiki", "b0"), ("q", "source", ""), ("r", "source", "")]


def test_scan_blocks(spark, kb):
    t = spark.createDataFrame([(0, "zebra"), (0, "retention")], "qid long, token string")
    idf = spark.createDataFrame([("zebra", 2.0)], "token string, idf double")
    pairs = spark.createDataFrame([(0, "page:policy-1"), (0, "page:alpha"), (0, "page:hub")], "qid long, page_id string")
    got = {(r.page_id, r.pos) for r in scan.rank_blocks(kb.blocks, pairs, t, idf).collect()}
    assert got == {("page:policy-1", 1), ("page:alpha", 2), ("page:hub", 1)}


def test_scan_rank_against_the_columns(spark, kb):
    """The automaton gives what `match_strength` gives token by token."""
    from pagewright.functions import text as T

    docs = scan.fields(kb.pages, kb.blocks)
    t = scan.query_tokens(asked(spark, "zebras retentions alpha-platform giraffes 30 login_rate 정책은", "the ledgers policy 2", ""))
    total = sum((w * T.match_strength(F.col("token"), F.col(c)) for c, w in fixed.FIELD_WEIGHTS.items()), F.lit(0.0))
    want = {(r.token, r.page_id): round(r.s, 9) for r in docs.crossJoin(t.select("token").distinct()).select("token", "page_id", total.alias("s")).filter("s > 0").collect()}
    got = {(r.token, r.page_id): round(r.strength, 9) for r in scan.token_strengths(docs, t).collect()}
    assert got == want and len(got) > 5


def test_stream_follows_pages(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    pages = {s: canonical(s, k, b) for s, (k, b) in PAGES.items()}

    def drop(ps, name):
        os.makedirs(src, exist_ok=True)
        with open(f"{src}/{name}", "w") as f:
            f.writelines(json.dumps(p, ensure_ascii=False) + "\n" for p in ps)
        changes.follow_pages(spark, src, out, ck).awaitTermination()

    drop(list(pages.values()), "1.json")
    assert hits(spark, I.open_published(out, spark), "okapi") == []
    pages["alpha"] = canonical("alpha", "concept", "# Alpha\n\nThe okapi moved in.")
    drop([pages["alpha"]], "2.json")
    moved = I.open_published(out, spark)
    assert [r.slug for r in hits(spark, moved, "okapi")][:1] == ["alpha"]
    assert I.latest(out, spark) == 1
    write(str(tmp_path / "full"), list(pages.values()))
    full = I.build(json_pages.knowledge_base(json_pages.read_pages(spark, str(tmp_path / "full"))))
    assert I.digest(full.postings).collect() == I.digest(moved.postings.select(*full.postings.columns)).collect()


def test_event_streams(spark, tmp_path, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").orderBy("ts")
    e.coalesce(1).write.parquet(str(tmp_path / "e"))
    s = spark.readStream.schema(e.schema).parquet(str(tmp_path / "e"))
    for name, df in (("w", changes.windowed(s)), ("s", changes.sessions(s)), ("o", changes.once(s))):
        q = df.writeStream.format("memory").queryName(f"out_{name}").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    assert spark.table("out_o").count() == e.count()
    assert 0 < spark.table("out_w").agg(F.sum("n")).first()[0] <= e.count()
