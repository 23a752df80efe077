import base64
import hashlib
import re

import public_tokenizers as P
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline as C
from pagewright.llm import mixing, quality
from tests.llm.test_neardup import brute as near_brute


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    before, kept = docs.collect(), None
    for k, (name, stage) in enumerate(C.STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        rows = docs.collect()
        if k < len(C.STAGES) - 1:
            assert docs.columns == columns and set(rows) <= set(before) and len(rows) == len({r.doc_id for r in rows})
            kept = {r.doc_id for r in rows}
        if name == "quality classifier":
            labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
            known = [r.doc_id for r in before if r.doc_id in labels]
            assert sum((i in kept) == (labels[i] == 1) for i in known) >= 0.97 * len(known)
        elif name == "exact dedup":
            groups = {}
            for r in before:
                groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", "", r.text), []).append((-len(r.text), r.doc_id))
            assert kept == {min(g)[1] for g in groups.values()}
        elif name == "near dedup":
            assert kept == {k for k, _, _, stays in near_brute([(r.doc_id, r.text) for r in before]) if stays}
        elif name == "mixing":
            assert set(rows) == set(before)
            place = {r.doc_id: (r.slot, r.place) for r in mixing.mix(spark.createDataFrame(before)).collect()}
            order = [place[r.doc_id] for r in out.collect()]
            assert order == sorted(order)
        else:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
            e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
            texts = {r.doc_id: r.text for r in before}
            assert {r.doc_id for r in rows} == set(texts)
            for r in rows:
                ids = e.encode_ordinary(texts[r.doc_id])
                assert list(memoryview(bytes(r.ids)).cast("I")) == ids
                assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
        before = rows
    assert C.run(spark, sf_dir).count() == len(before)


def test_edges(spark, sf_dir, tmp_path):
    """Nulls, empty texts and repeated rows pass through all stages; an empty table stays empty."""
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "Some words of a text.", "en", "a", 21), (3, "x y z", "en", None, 5), (3, "x y z", "en", None, 5)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    for k, table in enumerate((rows, [])):
        docs = spark.createDataFrame(table, schema)
        for i, (_, stage) in enumerate(C.STAGES):
            stage(spark, docs, sf_dir).write.parquet(str(tmp_path / f"{k}-{i}"))
            docs = spark.read.parquet(str(tmp_path / f"{k}-{i}"))
        ids = sorted((r.doc_id for r in docs.collect()), key=str)
        assert ids == ([1, 3, None] if table else [])  # the row that came twice stays once


def test_quality_without_labels(spark, sf_dir):
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert not len(quality.train(docs, labels).vectors)


def test_a_table_that_came_twice(spark, sf_dir):
    """A corpus that was ingested twice gives what it gives once, also where ids are missing or other columns differ."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    again = docs.withColumn("source", F.concat("source", F.lit("-again")))
    for decide in (C.once, C.distinct_enough):
        one = sorted((r.doc_id, r.text) for r in decide(spark, docs, sf_dir).collect())
        for twice in (docs.union(docs), docs.union(again)):
            assert sorted((r.doc_id, r.text) for r in decide(spark, twice, sf_dir).collect()) == one
        none = docs.withColumn("doc_id", F.lit(None).cast("long"))
        assert decide(spark, none.union(none), sf_dir).count() == len(one)


def test_decided_by_row(spark, sf_dir):
    """A copy goes even if another row of its doc_id stays or if it has no doc_id; different texts of one doc_id stay."""
    w = [f"w{i}" for i in range(60)]
    near = [*w[:-1], "other"]
    texts = [(1, "a b c"), (2, "a b  c"), (2, "d e f"), (None, "a b c"), (None, "g h i"), (None, "g h i"), (None, " g h i"), (4, "d e f"), (6, " ".join(w)), (7, " ".join(near)), (7, "j k l"), (None, " ".join([*w, "x"]))]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in texts], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    rows = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    exact = C.once(spark, docs, sf_dir)
    assert rows(exact) == sorted([(2, "a b  c"), (2, "d e f"), (None, " g h i"), *texts[8:]], key=str)
    assert rows(C.distinct_enough(spark, exact, sf_dir)) == sorted([(2, "a b  c"), (2, "d e f"), (None, " g h i"), texts[8], texts[10]], key=str)
    stripped = sorted(((i, t.strip()) for i, t in rows(C.distinct_enough(spark, docs, sf_dir))), key=str)  # of equal sets any text may stay
    assert stripped == sorted([(1, "a b c"), (2, "d e f"), (None, "g h i"), texts[8], texts[10]], key=str)


def test_names_of_helper_columns(spark, sf_dir, tmp_path):
    """Columns that are named like those of a stage or an operator come out as they went in."""
    names = ["row", "row_", "told", "told_", "doc", "score", "quality_score_", "key_", "k_", "n", "n_", "i", "at", "kept", "level", "name", "s"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("doc_id < 60")
    docs = docs.select("*", *(F.concat(F.lit(f"{n}:"), F.col("doc_id").cast("string")).alias(n) for n in names))
    docs = docs.union(docs.filter("doc_id < 5"))
    for i, (_, stage) in enumerate(C.STAGES[:-1]):
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        got = docs.collect()
        assert got and all(r[n] == f"{n}:{r.doc_id}" for r in got for n in names)
    assert C.STAGES[-1][1](spark, docs, sf_dir).count() == len(got)
