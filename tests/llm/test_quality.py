import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.llm import quality as Q

GOOD, BAD = "Then the men went home, and all was well again.", "THEN!! THE!! MEN!! WENT!! HOME!!"


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = Q.classify(docs, Q.train(docs, labels)).join(labels, "doc_id").filter(Q.held_out("doc_id")).select("score", "quality").collect()
    y, p = np.array([r[1] for r in got]), np.array([r[0] for r in got]) >= Q.ACCEPT
    assert len(got) > 500 and (p == (y == 1)).mean() > 0.98
    assert (p & (y == 1)).sum() >= 0.99 * (y == 1).sum()


def test_labels_of_the_fold_are_not_used(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    other = labels.withColumn("quality", F.when(Q.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (Q.classify(docs, Q.train(docs, x)).select("doc_id", "score").orderBy("doc_id", "score").collect() for x in (labels, other))
    assert a == b
    fold = {r[0] for r in docs.filter(Q.held_out("doc_id")).select("doc_id").collect()}
    assert fold == {r[0] for r in docs.select("doc_id").collect() if zlib.crc32(str(r[0]).encode()) % 4 == 2}


def test_votes_against_brute_force():
    g = np.random.default_rng(1)
    counts = g.integers(0, 9, (60, len(Q.terms(b"")))).astype(np.float32)
    y = np.array([0, 1, 1] * 20)
    m = Q.fit(counts, y, {0: 0.3, 1: 0.7})
    x = g.integers(0, 9, (7, counts.shape[1])).astype(np.float32)
    a, b = m.latent(x), m.latent(counts)
    for i, s in enumerate(m.score(x)):
        near = sorted(((float(a[i] @ b[j]), j) for j in range(60)), reverse=True)[: Q.NEIGHBOURS]
        w = [max(c, 0) ** Q.POWER * m.weights[j] for c, j in near]
        assert s == pytest.approx(sum(v * y[j] for v, (_, j) in zip(w, near, strict=True)) / sum(w), rel=1e-4)


def test_terms_carry_meaning():
    """Texts of the same shape but of other words or another script differ, in any script."""
    texts = ["The ships came in late.", "The trees grew up slow.", "Суда пришли поздно ночью", "Деревья растут медленно", "船は夜遅くに港へ着いた", "木は静かな森で育っている"]
    t = [Q.terms(x.encode()) for x in texts]
    assert all((a[-Q.SUBWORDS :] != b[-Q.SUBWORDS :]).any() for i, a in enumerate(t) for b in t[:i])
    again = Q.terms("船は夜遅くに港へ着いた。船は夜遅くに港へ着いた".encode())[-Q.SUBWORDS :]
    cos = lambda a, b: float(a @ b / np.linalg.norm(a) / np.linalg.norm(b))
    assert cos(again, t[4][-Q.SUBWORDS :]) > 0.9 > 0.3 > cos(again, t[5][-Q.SUBWORDS :])
    assert (Q.terms(b"ABC def")[-Q.SUBWORDS :] == Q.terms(b"abc\nDEF")[-Q.SUBWORDS :]).all()


def test_axes_are_singular_vectors():
    g = np.random.default_rng(3)
    x = (g.standard_normal((300, 12)) * 2.0 ** -np.arange(12)) @ g.standard_normal((12, 90)) + 1e-5 * g.standard_normal((300, 90))
    x = x.astype(np.float32)
    _, _, v = np.linalg.svd(x)
    assert np.abs(np.abs(np.diag(v[:6] @ Q._axes(x, 6))) - 1).max() < 1e-3


def test_the_model_is_reproducible(spark):
    """A repeated key gives the same row whatever the order in which rows come."""
    rows = [(i % 5, t) for i, t in enumerate([GOOD, BAD, "x y", "1 2 3", None] * 5 + ["other text"])]
    labels = spark.createDataFrame([(i, i % 2) for i in range(5)], "doc_id bigint, quality int")
    a, b = (Q.train(spark.createDataFrame(r, "doc_id bigint, text string"), labels) for r in (rows, rows[::-1]))
    assert (a.vectors == b.vectors).all() and (a.labels == b.labels).all()


def test_edges(spark):
    texts = [None, "", " ", GOOD, BAD, GOOD, "x" * 200_000]
    docs = spark.createDataFrame([(i, t, 9.0, "z") for i, t in enumerate(texts)] + [(None, GOOD, 9.0, None)], "doc_id bigint, text string, score double, label string")
    labels = spark.createDataFrame([(3, 1), (3, 1), (5, 1), (4, 0), (None, 1), (1, None), (2, 7), (77, 0)], "doc_id bigint, quality int")
    got = {(r.doc_id, r.text): r for r in Q.classify(docs, Q.train(docs, labels)).collect()}
    assert len(got) == 8 and all(0 <= r.score <= 1 for r in got.values())
    assert got[0, None].score == got[1, ""].score and got[5, GOOD].label == "z"
    assert all(r.score == 0.5 for r in Q.classify(docs, Q.train(docs, labels.limit(0))).collect())
    assert Q.classify(docs.limit(0), Q.train(docs.limit(0), labels)).count() == 0
