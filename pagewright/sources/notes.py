"""The table `documents` as Markdown files in which all kinds of blocks occur, planted by arithmetic over ids and lines.

Each line of a document that isn't blank becomes one block, whose kind is (31 * doc_id + line) modulo KINDS: headings of four levels,
open conflicts, decisions, questions with an owner and a date, lists, tables, paragraphs with links of which some lead
nowhere, and plain paragraphs. A null text is a page without blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions import fixed

KINDS = 12
#: What counts as a line end for Markdown, or would be none for other readers.
CONTROL = "[\\x00-\\x1f\\x7f\\x{85}\\x{2028}\\x{2029}]"


def _block(text: Column, doc_id: Column, line: Column, n_pages: Column) -> Column:
    kind = (doc_id * 31 + line) % KINDS
    lit = lambda s: F.lit(s)
    made = (
        F.concat(F.repeat(lit("#"), (1 + (doc_id + line) % 4).cast("int")), lit(" "), text),
        F.concat(lit(f"> {fixed.CONFLICT_MARK}: "), text),
        F.concat(lit(f"> {fixed.OPEN_MARK}: "), text, lit("\n> owner: o"), (doc_id % 7).cast("string"), lit("\n> due: 2024-05-"), F.lpad((1 + line % 28).cast("string"), 2, "0")),
        F.concat(lit("- "), text, lit("\n  more\n- last")),
        F.concat(lit("| "), F.replace(text, lit("|"), lit("/")), lit(" | \\| x |\n|---|---|")),
        F.concat(lit(f"> {fixed.CURRENT_MARK}: "), text),
        F.concat(lit("see [[Doc "), ((doc_id * 7 + line) % (n_pages * 2)).cast("string"), lit("|this]] "), text),
    )
    out = F.concat(lit("text "), text)
    for k, m in enumerate(made):
        out = F.when(kind == k, m).otherwise(out)
    return out


def bodies(docs: DataFrame) -> DataFrame:
    """page_id, doc_id, slug, body: a document's blocks with blank lines between them."""
    known = docs.filter("doc_id IS NOT NULL").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = F.broadcast(known.agg(F.count("*").alias("n_pages")))  # one row
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(F.trim(F.regexp_replace(x, CONTROL, " ")).alias("t"), i.alias("i")))
    kept = F.filter(lines, lambda x: x["t"] != "")
    made = F.transform(kept, lambda x: _block(x["t"], F.col("doc_id"), x["i"].cast("long"), F.col("n_pages")))
    slug = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))
    return known.crossJoin(n).select(F.concat(F.lit("page:"), slug).alias("page_id"), "doc_id", slug.alias("slug"), F.array_join(made, "\n\n").alias("body"))


def heads(docs: DataFrame) -> DataFrame:
    """path, value: files with a head of every form that one can have, and a short body."""
    value = lambda c: F.coalesce(F.col(c), F.lit("none"))
    i = F.col("doc_id").cast("string")
    text = F.concat(
        F.lit('---\ntitle: "Doc '), i, F.lit('"\n# a comment\ntype: concept\ntags: ['), value("lang"), F.lit(', "a, '), (F.col("doc_id") % 3).cast("string"), F.lit('"]\nprojects:\n  - '), value("source"),
        F.lit("\n  - 'p'\nsummary: >\n  folded\n\n  line "), i, F.lit("\n---\n# Title "), i, F.lit("\n\nbody\n"),
    )
    return docs.filter("doc_id IS NOT NULL").select(F.concat(F.lit("notes/doc_"), i, F.lit(".md")).alias("path"), text.alias("value"))
