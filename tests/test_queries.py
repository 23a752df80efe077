"""Every registered query of the knowledge base against its SQL, on the smallest tables."""

import math
import re
from collections import defaultdict

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from pagewright.functions import fixed
from pagewright.functions import text as T
from pagewright.plans import scan
from pagewright.queries import load
from pagewright.queries.common import base
from pagewright.queries.evaluation import _prompts
from tests.oracle import connect, differences
from tests.test_upkeep import window_by_trying

QUERIES, SQL = load()


def windows(spark, sf_dir):
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", T.tokens(F.substring_index(F.coalesce("text", F.lit("")), "\n", 1)).alias("terms")).collect():
        yield Row(doc_id=r.doc_id, window=window_by_trying(r.text or "", [t for t in r.terms if t], 300))


def scanned(spark, sf_dir):
    """The best 20 pages of each prompt by looking for every token's prefixes in every field of every page."""
    kb = base(spark, sf_dir)
    docs = {r.page_id: r.asDict() for r in scan.fields(kb.pages, kb.blocks).collect()}
    tokens = defaultdict(list)
    for r in scan.query_tokens(_prompts(spark, sf_dir)).collect():
        tokens[r.qid].append(r.token)

    def strength(token, page):
        least = min(len(token), 2 if re.fullmatch("[가-힣]+", token) else 4)
        lengths = range(len(token), least - 1, -1)
        return sum(w * next((n for n in lengths if token[:n] in docs[page][f]), 0) / len(token) for f, w in fixed.FIELD_WEIGHTS.items())

    found = {t: {p: s for p in docs if (s := strength(t, p))} for t in {t for own in tokens.values() for t in own}}
    for qid, own in tokens.items():
        score, matched, wordy = defaultdict(float), defaultdict(int), defaultdict(bool)
        for t in own:
            for p, s in found[t].items():
                score[p] += math.log(1 + len(docs) / (1 + len(found[t]))) * s
                matched[p] += 1
                wordy[p] |= not re.fullmatch("[0-9]+", t)
        order = sorted((p for p in score if round(score[p], 4) > 0), key=lambda p: (-round(score[p], 4), p))
        yield from (Row(qid=qid, rank=i, page_id=p, score=round(score[p], 4), matched=matched[p]) for i, p in enumerate(order[:20], 1))


#: Rows of queries without SQL by brute force. Redaction, contexts and gates have theirs in other files of this folder.
BRUTE = {"dense_windows": windows, "scan_rank": scanned}


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    if name in SQL:
        assert differences(df, con, SQL[name])[:3] == []
    else:
        rows = sorted(map(str, df.collect()))
        assert rows or name == "secret_labels"  # the smallest tables have none
        assert sorted(map(str, QUERIES[name](spark, sf_dir).collect())) == rows  # all columns, and again in the same session
        if name in BRUTE:
            assert rows == sorted(map(str, BRUTE[name](spark, sf_dir)))


def test_entry_imports_and_runs(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
