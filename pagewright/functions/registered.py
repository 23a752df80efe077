"""The engine in SQL: `register(spark)` makes its functions known to a session, under names that begin with kb_.

Text functions are SQL functions, whose bodies the optimiser inlines, so that no Python runs; tests hold each against the column function of
the same name on every document. The Markdown parser is a table function to be joined with LATERAL; redaction works on Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from pagewright.functions import fixed, markdown, redact

_T = "coalesce(text, '')"
_SQUEEZED = f"trim(regexp_replace({_T}, r'\\s+', ' '))"
_KEY = r"trim(BOTH '-' FROM regexp_replace(regexp_replace(lower(trim(coalesce({0}, ''))), r'^page:', ''), r'[\s_]+', '-'))"
_RUNS = f"regexp_extract_all(lower({_T}), r'{fixed.RUN}', 0)"
_WORD = f"regexp_replace(r, r'{fixed.RUN_TAIL}', '')"
_PARTS = f"filter(split({_WORD}, r'{fixed.RUN_PARTS}'), p -> length(p) >= 2)"
_NONE = "cast(array() as array<string>)"
_PAIRS = f"if(length(r) >= 2, transform(sequence(1, greatest(length(r) - 1, 1)), i -> substring(r, i, 2)), {_NONE})"
_SCAN = "', '".join(fixed.SCAN_STOP_WORDS)
#: name: (parameters, result, body).
BODIES = {
    "kb_tokens": ("text STRING", "ARRAY<STRING>", f"flatten(transform({_RUNS}, r -> CASE WHEN r RLIKE r'^[가-힣]' THEN {_PAIRS} WHEN length({_WORD}) < 2 THEN {_NONE} WHEN size({_PARTS}) > 1 THEN concat(array({_WORD}), {_PARTS}) ELSE array({_WORD}) END))"),
    "kb_scan_tokens": ("text STRING", "ARRAY<STRING>", f"array_distinct(filter(transform(regexp_extract_all({_T}, r'{fixed.SCAN_TOKEN}', 0), t -> lower(t)), t -> length(t) >= 2 AND t NOT IN ('{_SCAN}')))"),
    "kb_squeezed": ("text STRING", "STRING", _SQUEEZED),
    "kb_link_key": ("target STRING", "STRING", _KEY.format("target")),
    "kb_tag_key": ("tag STRING", "STRING", r"trim(BOTH '-' FROM regexp_replace(lower(trim(coalesce(tag, ''))), r'[\s_./-]+', '-'))"),
    "kb_token_estimate": ("text STRING", "INT", "cast(ceil(octet_length(text) / 3) as int)"),
    "kb_fingerprint": ("kind STRING, text STRING", "STRING", f"left(sha2(concat(kind, chr(0), {_SQUEEZED}), 256), 16)"),
    "kb_refs_in": ("text STRING", "ARRAY<STRING>", f"array_sort(array_distinct(filter(transform(regexp_extract_all({_T}, r'{fixed.WIKILINK}', 1), x -> trim(x)), t -> {_KEY.format('t')} <> '')))"),
}
BLOCK = "pos INT, block_id STRING, kind STRING, source_text STRING, fingerprint STRING"


class MarkdownBlocks:
    """The blocks of one Markdown text of a page, in order; none of a null text."""

    def eval(self, page_id: str, text: str) -> Iterator[tuple]:
        for pos, b in enumerate(markdown.parse(page_id or "", text) if text else ()):
            yield pos, b["id"], b["kind"], b["source_text"], b["fingerprint"]


def _redacted(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else redact.redact(t))


def register(spark: SparkSession) -> list[str]:
    """Makes all functions known to the session, again if they are already; their names."""
    for name, (parameters, result, body) in BODIES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    spark.udf.register("kb_redact", F.pandas_udf(_redacted, StringType()))
    spark.udtf.register("kb_markdown_blocks", F.udtf(MarkdownBlocks, returnType=BLOCK))
    return [*BODIES, "kb_redact", "kb_markdown_blocks"]
