"""The SQL functions against the column functions, on all documents and on literal cases."""

import pytest
from pyspark.sql import functions as F

from pagewright.functions import redact, registered
from pagewright.functions import text as T

CASES = ["", None, "Page: Alpha_Beta  x", "정책은 v2.3.1 login_rate_limited a.", "See [[b]] [[ a |x]] [[b#c]] [[ ]] [[page:]]", " \t\n--x_y--", "API정책은 the THE of it", "réaux éa"]
COLUMNS = {
    "kb_tokens": T.tokens, "kb_scan_tokens": T.scan_tokens, "kb_squeezed": T.squeezed, "kb_link_key": T.link_key, "kb_tag_key": T.tag_key, "kb_token_estimate": T.token_estimate,
    "kb_fingerprint": lambda c: T.fingerprint(F.lit("k"), c), "kb_refs_in": T.refs_in,
}


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    registered.register(spark)
    assert set(registered.register(spark)) == {*COLUMNS, "kb_redact", "kb_markdown_blocks"}
    rows = spark.createDataFrame([(-i, t) for i, t in enumerate(CASES, 1)], "doc_id bigint, text string").union(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    rows.createOrReplaceTempView("kb_test_texts")
    return rows


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_same_as_columns(spark, texts, name):
    call = f"{name}('k', text)" if name == "kb_fingerprint" else f"{name}(text)"
    want = texts.select("doc_id", COLUMNS[name]("text").alias("v"))
    got = spark.sql(f"SELECT doc_id, {call} AS v FROM kb_test_texts")
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_redaction(spark, texts):
    got = {r.doc_id: r.v for r in spark.sql("SELECT doc_id, kb_redact(text) AS v FROM kb_test_texts").collect()}
    assert all(got[r.doc_id] == (None if r.text is None else redact.redact(r.text)) for r in texts.collect())
    assert spark.sql("""SELECT kb_redact('run --password hunter22x now') AS v""").first().v == f"run --password {redact.MASK} now"
