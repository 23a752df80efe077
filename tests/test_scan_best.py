"""The best pages of prompts without a row for each pair of a prompt and a page."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.plans import scan, scan_best
from pagewright.queries import evaluation


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "page_id string, slug string, title string, tags string, projects string, summary string, body string")


def tokens_of(spark, prompts):
    return spark.createDataFrame([(q, t) for q, own in prompts.items() for t in own], "qid long, token string")


WORDS = ["zebra", "zebras", "retention", "alpha-platform", "30", "2024", "an", "정책은", "정책", "ledger"]


def some_pages(n=70):
    """Pages in which words come whole, cut and not at all; each third is a copy of one before it."""
    at = lambda i, k: " ".join(w[: len(w) - (i + j) % 3] for j, w in enumerate(WORDS) if (i * 7 + j * k) % 5 == 0)
    return [(f"page:{i:02}", f"s{i}", at(j := i - i % 3 // 2 * 2, 1), at(j, 2), None, at(j, 3), at(j, 4)) for i in range(n)]


PROMPTS = {1: WORDS, 2: ["zebras", "30"], 3: ["2024", "30"], 4: ["giraffe"], 5: ["정책은", "an"], 6: ["ledger"]}


@pytest.mark.parametrize(("top", "limits"), [(1, {}), (3, {}), (50, {}), (3, {"ENTRIES": 4}), (3, {"WIDE": 5}), (3, {"ENTRIES": 4, "WIDE": 1})])
def test_best_is_the_head_of_rank(spark, monkeypatch, top, limits):
    for name, most in limits.items():
        monkeypatch.setattr(scan_best, name, most)
    docs, tokens = docs_of(spark, some_pages()).repartition(3), tokens_of(spark, PROMPTS)
    want = scan.rank(docs, tokens).filter(F.col("rank") <= top)
    assert sorted(map(tuple, scan_best.best(docs, tokens, top).collect())) == sorted(map(tuple, want.collect()))


def test_rows_of_one_page_are_added(spark):
    rows = some_pages(12)
    docs, tokens = docs_of(spark, [*rows, *rows[:4], *[("page:01", *r[1:]) for r in rows[5:7]]]).repartition(4), tokens_of(spark, PROMPTS)
    want = scan.rank(docs, tokens).filter("rank <= 5")
    assert sorted(map(tuple, scan_best.best(docs, tokens, 5).collect())) == sorted(map(tuple, want.collect()))


def test_nothing_asked_and_nothing_there(spark):
    docs, none = docs_of(spark, some_pages(5)), tokens_of(spark, PROMPTS).limit(0)
    assert scan_best.best(docs, none, 3).columns == scan.rank(docs, none).columns
    assert scan_best.best(docs, none, 3).collect() == []
    assert scan_best.best(docs.limit(0), tokens_of(spark, PROMPTS), 3).collect() == []


@pytest.mark.parametrize("part", [1, 7, 512])
def test_parts_of_pages_against_all_pairs(monkeypatch, part):
    monkeypatch.setattr(scan_best, "PAIRS", 5)
    monkeypatch.setattr(scan_best, "PROMPTS", 2)
    words = sorted({w for own in PROMPTS.values() for w in own})
    p, number = scan_best.Prefixes(words), {w: i for i, w in enumerate(words)}
    at = np.append(0, np.cumsum([len(own) for own in PROMPTS.values()]))
    idf = np.linspace(0.7, 3.0, len(words))
    best = scan_best.Best(p, words, at, np.array([number[w] for own in PROMPTS.values() for w in own]), idf, 4)
    pages, weights = some_pages(), list(scan_best.fixed.FIELD_WEIGHTS.values())
    score = defaultdict(float)
    held = np.zeros((len(pages), len(p.of)), np.uint8)
    for k, row in enumerate(pages):
        for f, text in enumerate(row[2:]):
            held[k, p.found_in(text or "")] |= 1 << f
            for q, own in PROMPTS.items():
                for w in own:
                    least = min(len(w), 2 if w.startswith("정책") else 4)
                    longest = next((n for n in range(len(w), least - 1, -1) if w[:n] in (text or "")), 0)
                    score[q, row[0]] += idf[number[w]] * weights[f] * longest / len(w)
    for k in range(0, len(pages), part):
        best.take([r[0] for r in pages[k : k + part]], held[k : k + part], np.arange(len(pages[k : k + part])))
    got = {q: list(zip(f.page_id, f.score.round(4), strict=True)) for q, f in next(best.rows(list(PROMPTS))).groupby("qid")}
    for q in PROMPTS:
        want = sorted(((p, math.floor(s * 1e4 + 0.5) / 1e4) for (of, p), s in score.items() if of == q and s > 0), key=lambda x: (-x[1], x[0]))[:4]
        assert got.get(q, []) == [(p, pytest.approx(s)) for p, s in want]


@pytest.mark.parametrize("query", [evaluation.scan_rank, evaluation.scan_gate])
def test_queries_make_no_row_for_each_pair(spark, sf_dir, monkeypatch, query):
    """They did: all pairs of prompts and pages that share a token were grouped, which 0.1 GB didn't finish."""

    def pairs(*a, **k):
        raise AssertionError("a row for each token and page")

    monkeypatch.setattr(scan, "token_strengths", pairs)
    written, one_batch = [], scan_best._one_batch
    monkeypatch.setattr(scan_best, "_one_batch", lambda docs, tokens, top: written.append((top, tokens.select("qid").distinct().count(), out := one_batch(docs, tokens, top))) or out)
    assert query(spark, sf_dir).count() > 0
    for top, prompts, out in written:
        assert 0 < out.count() <= top * prompts * max(spark.sparkContext.defaultParallelism, 1)
