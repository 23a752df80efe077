"""Literal cases of text functions, redaction and the Markdown parser."""

import random

import pytest
from pyspark.sql import functions as F

from pagewright.functions import markdown as M
from pagewright.functions import redact as R
from pagewright.functions import text as T


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize("text,want", [("v2.3.1", ["v2.3.1"]), ("login_rate_limited", ["login_rate_limited", "login", "rate", "limited"]), ("abc.", ["abc"]), ("a b", []), ("réaux", ["aux"]), ("정책은", ["정책", "책은"]), (None, []), ("가", [])])
def test_tokens(spark, text, want):
    assert value(spark, T.tokens(F.lit(text).cast("string"))) == want


def test_query_tokens(spark):
    assert value(spark, T.tokens(F.lit("정책은"), query=True)) == ["정책"]
    assert value(spark, T.query_stem(F.lit("결과"))) == "결과"


def test_small_functions(spark):
    assert value(spark, T.clip(F.lit("abcdef"), 4)) == "abc…"
    assert value(spark, T.token_estimate(F.lit("1234567"))) == 3
    assert value(spark, T.link_key(F.lit("Page:Alpha Platform"))) == "alpha-platform"
    assert value(spark, T.link_key(F.lit("Straße"), fold=True)) == "strasse"
    assert value(spark, T.tag_key(F.lit("pre_v0_1-1"))) == "pre-v0-1-1"
    assert value(spark, T.table_cells(F.lit("| a | str \\| None |"))) == ["a", "str | None"]
    assert [value(spark, T.retry_delay(F.lit(n))) for n in (1, 2, 3, 6)] == [3600, 7200, 14400, 86400]
    assert tuple(value(spark, T.ref_parts(F.lit("Source: handbook ")))) == ("source", "handbook")
    assert tuple(value(spark, T.split_address(F.lit("a#b")))) == ("a", "b")
    assert value(spark, T.clip_lead(F.lit("one two three"), 8)) == "one two"
    assert value(spark, T.match_strength(F.lit("running"), F.lit("they run runn fast"))) == pytest.approx(4 / 7)
    assert value(spark, T.safe_name(F.lit("page:a b/c"))) == "a-b-c.json"


MARK = R.MASK


@pytest.mark.parametrize("text,want", [
    ("password: hunter22", f"password: {MARK}"),
    ("token: 128k", "token: 128k"),
    ("page_token: password=hunter2", f"page_token: password={MARK}"),
    ("value_token: abcdef1", "value_token: abcdef1"),
    ("api_key = 'abc123xyz'", f"api_key = '{MARK}'"),
    ("password: <your password>", "password: <your password>"),
    ("password: string", "password: string"),
    ("redis://:pa55@host", f"redis://{MARK}@host"),
    ("Authorization: Bearer abcdefgh12", f"Authorization: Bearer {MARK}"),
    ("basic authentication", "basic authentication"),
    ("ghp_abcdefghij0123456789", MARK),
    ("--db-password s3cr3t", f"--db-password {MARK}"),
    ("password: 사용자 비밀번호", "password: 사용자 비밀번호"),
    ("a\x00b", "ab"),
    (None, ""),
])
def test_redact(text, want):
    assert R.redact(text) == want
    assert R.redact(want) == want


def test_redact_json_and_paths():
    v = {"password": "hunter22", "a": ["token=abcdef12", 3], "value_token": "x1y2z3", "n/m": {"api_key": 1234567}}
    assert R.secret_paths(v) == [("/password", "password"), ("/a/0", "token"), ("/n~1m/api_key", "api_key")]
    r = R.redact_value(v)
    assert r["password"] == MARK and r["a"][0] == f"token={MARK}" and r["value_token"] == "x1y2z3" and r["n/m"]["api_key"] == MARK
    assert R.redact_value(r) == r


PAGE = """# Title

Some text with [[Alpha|a link]].
More.

> ⚠️ 상충: two claims
> ❓ not this

> ❓ 미결: who?
> owner: Kim
> due: 2024-05-01

| a | b \\| c |
|---|---|
| 1 | 2 |

- one
  more
- two

---
```py
x = 1

```
Some text with [[Alpha|a link]].
More.
```
open

"""


def test_parse():
    b = M.parse("page:p", PAGE)
    assert [x["kind"] for x in b] == ["heading", "paragraph", "conflict", "open_question", "table", "list", "thematic_break", "code", "paragraph", "code"]
    assert b[1]["refs"] == ["Alpha"] and b[1]["id"].endswith(":1") and b[8]["id"] == b[1]["id"][:-1] + "2"
    assert b[3]["data"]["owner"] == "Kim" and b[3]["data"]["due"] == "2024-05-01"
    assert b[4]["data"]["rows"][0] == ["a", "b | c"] and b[5]["data"]["items"] == ["one more", "two"]
    assert b[7]["data"] == {"language": "py", "text": "x = 1\n"} and b[9]["source_text"] == "```\nopen"
    assert b[2]["resolution"] == {"status": "unresolved"}


def test_random_markdown_keeps_its_blocks():
    r = random.Random(9)
    lines = ["# h", "text", "- i", "  more", "1. n", "> q", "> ⚠️ 상충", "| a | b |", "```", "---", "", "", "  ", "[[x]]", "#x"]
    for _ in range(500):
        text = "\n".join(r.choice(lines) for _ in range(r.randint(0, 25)))
        blocks = M.parse("page:p", text)
        again = M.parse("page:p", "\n\n".join(b["source_text"] for b in blocks))
        assert [(b["id"], b["data"]) for b in again] == [(b["id"], b["data"]) for b in blocks], text
        for b in blocks:
            one = M.parse_one("page:p", b["source_text"])
            assert one is not None and one["kind"] == b["kind"] and one["data"] == b["data"]


def test_frontmatter_round_trip():
    page = {"type": "concept", "created": "2024-01-01", "updated": "2024-01-02", "tags": ["a, b", "c"], "projects": [], "sources": ["page:x"], "summary": "s", "blocks": M.parse("page:p", "# T\n\nx"), "links": [{"kind": "related", "target": "y"}]}
    head, body = M.frontmatter(M.markdown(page))
    assert head["tags"] == ["a, b", "c"] and head["summary"] == "s" and head["related"] == ["y"] and body.strip() == "# T\n\nx"
    assert M.frontmatter("no head") == ({}, "no head")


def test_heads():
    """Lists in brackets and of lines, quotes, comments, block scalars, truth values and nulls; a fence is three dashes and nothing else."""
    text = "---\na: 1\n# a comment\ntags:\n  - x\n  - 'y z'\nl: [a, \"b, c\", 'd']\nsummary: >\n  one\n\n  - two\nn: ~\nb: TRUE\n---\nbody"
    head, body = M.frontmatter(text)
    assert head == {"a": "1", "tags": ["x", "y z"], "l": ["a", "b, c", "d"], "summary": ">", "n": None, "b": True} and body == "body"
    assert M.frontmatter_scalar(text, "summary") == "one - two" and M.frontmatter_scalar(text, "l") == "[a, \"b, c\", 'd']" and M.frontmatter_scalar(text, "z") is None
    for other in ("--- \na: 1\n---\nx", "---\na: 1\n--- \nx", "---\na: 1\n---", "a: 1"):
        assert M.frontmatter(other) == ({}, other) and M.frontmatter_scalar(other, "a") is None


def test_html():
    h = M.page_html({"page_id": "page:p", "blocks": M.parse("page:p", PAGE)})
    assert '<a href="#" data-wiki-target="Alpha">a link</a>' in h and "<th>b | c</th>" in h and "<hr>" in h and "---" not in h


def test_parse_pages(spark):
    df = spark.createDataFrame([("page:p", PAGE), ("page:q", None)], "page_id string, body string")
    assert M.parse_pages(df).count() == 10
