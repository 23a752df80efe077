import hashlib
import re
from collections import defaultdict

from pagewright.llm.dedup import dedup_exact


def brute(rows):
    groups = defaultdict(list)
    for k, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", "", t or "")].append((-len(t or ""), k is None, k if k is not None else 0, k))
    out = []
    for k, t in rows:
        n = re.sub(r"[\x20\x09-\x0D]+", "", t or "")
        first = min(groups[n])[3]
        out.append((k, first, len(groups[n]), k == first, hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out, key=str)


def check(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, row string, name int")
    assert sorted((tuple(r) for r in dedup_exact(df, **kw).collect()), key=str) == brute(rows)


def test_small_blocks(spark):
    texts = ["", None, " \n", "a", "a ", "\ta", "abcdefgh", "abcd efgh", "abcdefgh" * 9, "abcdefgh" * 9 + "x", "é" * 7, " é" * 7, "efghabcd", "a\x0bb", "a\x85b"]
    check(spark, [(i, t) for i, t in enumerate(texts * 2)], size=4)


def test_nulls_ties_and_long(spark):
    long = "lorem ipsum " * 30_000
    rows = [(None, "q"), (None, "q"), (5, "q"), (5, "q"), (7, "q "), (8, "q "), (9, long), (10, long + " "), (11, long + "."), (5, "other")]
    check(spark, rows)


def test_empty(spark):
    assert dedup_exact(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
