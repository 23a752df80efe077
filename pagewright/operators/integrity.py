"""Validation, drift, lint and repair verdicts as rows: (page_id, block_id, kind, message)."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from pagewright.functions import fixed, markdown, redact
from pagewright.functions import text as T
from pagewright.operators import links as L


def duplicates(df: DataFrame, column: str) -> DataFrame:
    """Values that more than one row has, with their number."""
    return df.groupBy(column).agg(F.count("*").alias("n")).filter("n > 1")


def page_errors(pages: DataFrame) -> DataFrame:
    """page_id, error of the rules that hold for a page alone (columns of the page schema)."""
    not_date = lambda c: ~F.coalesce(F.col(c), F.lit("")).rlike(fixed.DATE)
    rules: list[tuple[Column, str]] = [
        (~F.col("page_id").startswith("page:"), "invalid page id"),
        (F.col("page_id") != F.concat(F.lit("page:"), "slug"), "id must be page: and the slug"),
        (~F.col("type").isin(*fixed.PAGE_TYPES), "invalid type"),
        (not_date("created"), "created must be YYYY-MM-DD"),
        (not_date("updated"), "updated must be YYYY-MM-DD"),
        (F.exists("sources", lambda s: ~s.rlike(fixed.SOURCE_REF)), "invalid source ref"),
    ]
    if "schema_version" in pages.columns:
        rules.append((~F.col("schema_version").eqNullSafe(fixed.SCHEMA_VERSION), f"schema_version must be {fixed.SCHEMA_VERSION}"))
    found = F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(True)), F.lit(m)) for bad, m in rules)))
    return pages.select("page_id", F.explode(F.array_sort(found)).alias("error"))


def structure_errors(canonical: DataFrame) -> DataFrame:
    """page_id, error of pages in canonical form (blocks as a map): order, aliases, kinds, states, questions and links."""
    b, order = F.col("blocks"), F.col("block_order")
    ids, values = F.map_keys(b), F.map_values(b)
    aliases = F.coalesce(F.col("block_aliases"), F.expr("cast(map() as map<string,string>)"))
    some = lambda cond, m: F.when(cond, F.array(F.lit(m))).otherwise(F.array().cast("array<string>"))
    each = lambda bad, m: F.transform(F.filter(values, bad), lambda x: F.concat(x["id"], F.lit(": " + m)))
    due = lambda x: x["data"]["due"].isNotNull() & ~x["data"]["due"].rlike(fixed.DATE)
    found = F.concat(
        some(F.size(F.array_distinct(order)) != F.size(order), "duplicate ids in block_order"),
        some((F.size(F.array_except(order, ids)) > 0) | (F.size(F.array_except(ids, order)) > 0), "block_order mismatch"),
        some(F.exists(F.map_entries(b), lambda e: e["key"] != e["value"]["id"]), "block key and id differ"),
        each(lambda x: ~x["kind"].isin(*fixed.BLOCK_KINDS), "invalid block kind"),
        each(lambda x: x["resolution"]["status"].isNotNull() & ~x["resolution"]["status"].isin("resolved", "unresolved"), "invalid resolution status"),
        each(lambda x: (x["kind"] == "open_question") & x["data"]["owner"].isNull(), "open question needs an owner"),
        each(lambda x: (x["kind"] == "open_question") & due(x), "open question needs a due date or null"),
        F.transform(F.filter(F.map_entries(aliases), lambda e: F.array_contains(ids, e["key"])), lambda e: F.concat(F.lit("alias is a live block "), e["key"])),
        F.transform(F.filter(F.map_entries(aliases), lambda e: ~F.array_contains(ids, e["value"])), lambda e: F.concat(F.lit("alias points at unknown block "), e["value"])),
        some(F.exists("links", lambda x: ~x["kind"].isin(*fixed.LINK_KINDS)), "invalid link kind"),
        some(F.exists("links", lambda x: F.trim(F.coalesce(x["target"], F.lit(""))) == ""), "empty link target"),
        some(F.exists("links", lambda x: F.coalesce(x["block_id"] != "", F.lit(False)) & ~F.array_contains(ids, x["block_id"])), "link of an unknown block"),
    )
    return canonical.select(F.col("id").alias("page_id"), F.explode(F.array_sort(F.array_distinct(found))).alias("error"))


class Check(NamedTuple):
    """One rule of a compiled schema: the places it holds for (ANY stands for each item or each key that isn't listed), and what must hold there."""

    path: tuple
    code: str
    holds: Callable[[object], bool]


class _Any(NamedTuple):
    """Steps into every item of a list, or into every key of an object but those listed."""

    listed: frozenset = frozenset()


KINDS = {"object": dict, "array": list, "string": str, "boolean": bool, "number": (int, float), "integer": int, "null": type(None)}


def _is(kind: str, v) -> bool:
    return isinstance(v, KINDS[kind]) and (kind == "boolean" or not isinstance(v, bool))


def _only(kind: str, holds) -> Callable[[object], bool]:
    """A rule that only says something about values of one kind."""
    return lambda v: not _is(kind, v) or holds(v)


#: Keyword of a schema: what it says, as a function of the keyword's value that gives (code, rule) pairs.
KEYWORDS: dict[str, Callable] = {
    "const": lambda want: [(f"is not {json.dumps(want, ensure_ascii=False)}", lambda v: v == want)],
    "enum": lambda all_: [("is none of the listed values", lambda v: v in all_)],
    "type": lambda kinds: [("has another type than " + " or ".join(_listed(kinds)), lambda v: any(_is(k, v) for k in _listed(kinds)))],
    "pattern": lambda p: [(f"does not match {p}", _only("string", lambda v: re.search(p, v) is not None))],
    "minLength": lambda n: [(f"has fewer than {n} characters", _only("string", lambda v: len(v) >= n))],
    "format": lambda f: [("is no date", _only("string", lambda v: re.fullmatch(r"\d{4}-\d{2}-\d{2}", v) is not None))] if f == "date" else [],
    "required": lambda names: [(f"lacks {n}", _only("object", lambda v, n=n: n in v)) for n in names],
    "uniqueItems": lambda yes: [("repeats an item", _only("array", lambda v: len({json.dumps(x, sort_keys=True) for x in v}) == len(v)))] if yes else [],
}


def _listed(x) -> list:
    return [x] if isinstance(x, str) else list(x)


def compiled(schema: dict) -> list[Check]:
    """A JSON Schema (the keywords of KEYWORDS, properties, additionalProperties, items and local references) as a flat list of checks.

    A schema that refers to itself has no flat list: that is an error.
    """
    out: list[Check] = []
    todo: list[tuple[tuple, dict, tuple]] = [((), schema, ())]
    while todo:
        path, node, through = todo.pop()
        while ref := node.get("$ref"):
            if ref in through:
                raise ValueError(f"{ref} refers to itself")
            through += (ref,)
            node = reduce(lambda at, part: at[part], ref.removeprefix("#/").split("/"), schema)
        out += [Check(path, code, rule) for keyword, said in KEYWORDS.items() if keyword in node for code, rule in said(node[keyword])]
        known = node.get("properties", {})
        todo += [((*path, k), sub, through) for k, sub in known.items()]
        others, items = node.get("additionalProperties", True), node.get("items")
        if others is False:
            out.append(Check(path, "has a key that is not listed", _only("object", lambda v, known=known: v.keys() <= known.keys())))
        elif isinstance(others, dict):
            todo.append(((*path, _Any(frozenset(known))), others, through))
        if isinstance(items, dict):
            todo.append(((*path, _Any()), items, through))
    return out


def _places(value, path: tuple) -> list[tuple[str, object]]:
    """(pointer, value) of all places that a path leads to."""
    at = [("", value)]
    for step in path:
        inner = []
        for pointer, v in at:
            if isinstance(step, _Any):
                entries = enumerate(v) if isinstance(v, list) and not step.listed else ((k, x) for k, x in v.items() if k not in step.listed) if isinstance(v, dict) else ()
            else:
                entries = [(step, v[step])] if isinstance(v, dict) and step in v else ()
            inner += [(f"{pointer}/{k}", x) for k, x in entries]
        at = inner
    return at


def schema_errors(value, checks: list[Check] | dict) -> list[str]:
    """What is wrong with a JSON value under a schema (or its compiled checks): sorted, each with its place."""
    checks = compiled(checks) if isinstance(checks, dict) else checks
    return sorted(f"{pointer or '/'}: {c.code}" for c in checks for pointer, v in _places(value, c.path) if not c.holds(v))


def json_errors(df: DataFrame, column: str, schema: dict) -> DataFrame:
    """`df` with errors: what is wrong with a JSON column under a schema, credentials in it included. Arrow batches, no shuffle."""
    # rules are functions, which don't travel: each worker compiles the schema once for a batch

    @F.pandas_udf(ArrayType(StringType()))
    def check(x: pd.Series) -> pd.Series:
        checks = compiled(schema)

        def one(s):
            try:
                v = json.loads(s)
            except (TypeError, ValueError) as e:
                return [f"/: no JSON ({type(e).__name__})"]
            return sorted(set(schema_errors(v, checks) + [f"{p}: credential '{n}'" for p, n in redact.secret_paths(v)]))

        return x.map(one)

    return df.withColumn("errors", check(F.col(column)))


DATA_FREE = ("conflict", "current", "raw", "markdown")


def block_drift(blocks: DataFrame) -> DataFrame:
    """page_id, block_id, problem of blocks (page_id, block_id, kind, source_text, fingerprint, refs, data as JSON) that differ from their source."""
    schema = "page_id string, block_id string, problem string"

    def run(frames):
        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                if not isinstance(r.source_text, str) or not isinstance(r.kind, str):
                    continue
                add = lambda p: out.append((r.page_id, r.block_id, p))  # noqa: E731, B023
                print_ = markdown.fingerprint(r.kind, r.source_text)
                if r.fingerprint != print_:
                    add("fingerprint differs from the source")
                if r.kind not in DATA_FREE:
                    one = markdown.parse_one(r.page_id, r.source_text)
                    if one is None:
                        add("source is not one block")
                    elif one["kind"] != r.kind:
                        add(f"source is a {one['kind']}")
                    elif r.data is not None and one["data"] != json.loads(r.data):
                        add("data differs from the source")
                if r.refs is not None and set(r.refs) != set(markdown.refs_in(r.source_text)):
                    add("refs differ from the source")
                if not re.fullmatch(re.escape("block:" + r.page_id.removeprefix("page:")) + r":[0-9a-f]{16}:[1-9]\d*", r.block_id):
                    add("block id has another form")
                elif r.block_id.split(":")[-2] != r.fingerprint:
                    add("block id has another fingerprint")
            yield pd.DataFrame(out, columns=["page_id", "block_id", "problem"])

    return blocks.select("page_id", "block_id", "kind", "source_text", "fingerprint", "refs", "data").mapInPandas(run, schema)


def link_drift(declared: DataFrame, blocks: DataFrame) -> DataFrame:
    """page_id, key, problem: wiki links of bodies that aren't declared, and the other way round."""
    body = blocks.select("page_id", F.explode(F.transform(T.refs_in("text"), T.link_key)).alias("key")).distinct()
    own = declared.filter("kind = 'wiki'").select("page_id", T.link_key("target").alias("key")).filter("key <> ''").distinct()
    missing = body.join(own, ["page_id", "key"], "left_anti").withColumn("problem", F.lit("missing from links"))
    return missing.unionByName(own.join(body, ["page_id", "key"], "left_anti").withColumn("problem", F.lit("not in the body")))


def _warn(df: DataFrame, kind: str, detail: Column | None = None, block: str | None = None) -> DataFrame:
    return df.select("page_id", (F.col(block) if block else F.lit("")).alias("block_id"), F.lit(kind).alias("kind"), (F.lit("") if detail is None else detail).alias("detail"))


def link_warnings(pages: DataFrame, resolved: DataFrame) -> DataFrame:
    """Missing targets of wiki links and pages without any link (but for those that need none)."""
    missing = L.dangling(resolved, pages).filter("kind = 'wiki'")
    ends = resolved.filter("dst IS NOT NULL")
    touched = ends.select("page_id").union(ends.select("dst")).distinct()
    orphans = pages.filter(~F.col("type").isin(*fixed.UNLINKED_TYPES)).join(touched, "page_id", "left_anti")
    return _warn(missing, "missing_target", F.col("target")).unionByName(_warn(orphans, "orphan"))


def compile_debt(pages: DataFrame, resolved: DataFrame) -> DataFrame:
    """page_id, n, newer (five slugs at most): sources next to a concept that are newer than it."""
    r = resolved.filter("dst IS NOT NULL").select("page_id", F.col("dst").alias("other"))
    near = r.union(r.select("other", "page_id")).distinct()
    p = pages.select("page_id", "slug", "type", "updated")
    o = p.select(F.col("page_id").alias("other"), F.col("slug").alias("other_slug"), F.col("type").alias("other_type"), F.col("updated").alias("other_updated"))
    new = near.join(p.filter("type = 'concept'"), "page_id").join(o.filter("other_type = 'source'"), "other").filter(F.coalesce("other_updated", F.lit("")) > F.coalesce("updated", F.lit("")))
    w = Window.partitionBy("page_id").orderBy("other_slug")
    five = new.withColumn("r", F.row_number().over(w))
    return five.groupBy("page_id").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("r") <= 5, F.col("other_slug")))), ", ").alias("newer"))


def unintegrated(pages: DataFrame, resolved: DataFrame) -> DataFrame:
    """page_id of sources that link to no concept, entity or synthesis."""
    into = resolved.join(pages.filter(F.col("type").isin(*fixed.COMPILED_TYPES)).select(F.col("page_id").alias("dst")), "dst", "left_semi").select("page_id")
    return pages.filter("type = 'source'").join(into, "page_id", "left_anti").select("page_id")


# What a summary that is a table looks like, and words that say a page replaces another.
SUMMARY_TABLE = "^(?:항목|구분)\\s*\\|?\\s*(?:값|내용)(?:\\s|\\||$)|^\\||(?s)^.{0,110}?(?:^|\\s)\\|?\\s*:?-{3,}:?\\s*\\|?\\s+\\|?\\s*:?-{3,}:?"
SUPERSEDES = "(?:을|를)\\s*(?:대체|갈음)(?:한다|합니다|했다|하였다|함|하며|하고|하는)|(?i:\\b(?:supersedes|replaces|obsoletes)\\b)"
LARGE = 200 * 1024


def content_warnings(pages: DataFrame, blocks: DataFrame, resolved: DataFrame) -> DataFrame:
    """Empty or table-like summaries, pages too large, phrases of replacement without a supersedes link, open conflicts and questions."""
    s = F.trim(F.coalesce("summary", F.lit("")))
    out = _warn(pages.filter(s == ""), "empty_summary").unionByName(_warn(pages.filter(s.rlike(SUMMARY_TABLE)), "summary_dump"))
    size = blocks.groupBy("page_id").agg(F.sum(F.octet_length("text")).alias("b"))
    out = out.unionByName(_warn(size.filter(F.col("b") > LARGE), "page_too_large", F.floor(F.col("b") / 1024).cast("string")))
    says = blocks.filter((F.col("kind") != "code") & F.col("text").rlike(SUPERSEDES)).groupBy("page_id").agg(F.min_by("block_id", "pos").alias("block_id"))
    out = out.unionByName(_warn(says.join(resolved.filter("kind = 'supersedes'"), "page_id", "left_anti"), "missing_supersedes", block="block_id"))
    out = out.unionByName(_warn(blocks.filter("unresolved"), "unresolved_conflict", block="block_id"))
    return out.unionByName(_warn(blocks.filter("kind = 'open_question'"), "open_question", T.open_question("text")["due"], "block_id"))


def late_questions(blocks: DataFrame, today: str) -> DataFrame:
    """Warnings of open questions (with a column due) whose day is over; those without one are never late."""
    late = blocks.filter((F.col("kind") == "open_question") & ~F.col("unresolved") & (F.col("due") < today))
    return _warn(late, "late_question", F.col("due"), "block_id")


def tag_spellings(pages: DataFrame, vocabulary: list[str] | None = None) -> DataFrame:
    """key, spelling: the listed spelling of a tag, else the most frequent, then the first one."""
    n = pages.select(F.explode("tags").alias("tag")).groupBy(T.tag_key("tag").alias("key"), "tag").agg(F.count("*").alias("n"))
    best = n.filter("key <> ''").groupBy("key").agg(F.min_by("tag", F.struct(-F.col("n"), F.col("tag"))).alias("spelling"))
    if not vocabulary:
        return best
    own = pages.sparkSession.createDataFrame([(v,) for v in vocabulary], "spelling string").select(T.tag_key("spelling").alias("key"), "spelling")
    return best.join(own, "key", "left_anti").unionByName(own)


def tag_warnings(pages: DataFrame, vocabulary: list[str] | None = None) -> DataFrame:
    """Tags that are spelled otherwise, and those that aren't on the list (if there is one)."""
    rows = pages.select("page_id", F.explode("tags").alias("tag")).withColumn("key", T.tag_key("tag")).join(tag_spellings(pages, vocabulary), "key", "left")
    out = _warn(rows.filter("spelling <> tag"), "tag_variant", F.concat_ws(" -> ", "tag", "spelling"))
    if vocabulary is not None:
        listed = pages.sparkSession.createDataFrame([(v,) for v in vocabulary], "v string").select(T.tag_key("v").alias("key"))
        out = out.unionByName(_warn(rows.filter("spelling IS NULL OR spelling = tag").join(listed, "key", "left_anti"), "tag_off_list", F.col("tag")))
    return out


def sorted_tags(pages: DataFrame, spellings: DataFrame, allowed: list[str]) -> DataFrame:
    """page_id, tags, keywords: words that aren't on the list become keywords, listed keywords tags; without any listed word a page stays."""
    words = pages.select("page_id", F.posexplode(F.concat(F.transform("tags", lambda t: F.struct(t.alias("w"), F.lit(0).alias("from"))), F.transform("keywords", lambda t: F.struct(t.alias("w"), F.lit(1).alias("from"))))).alias("i", "x"))
    words = words.select("page_id", "i", "x.w", "x.from", T.tag_key("x.w").alias("key")).join(spellings, "key", "left").filter("key <> ''")
    words = words.withColumn("w", F.when(F.col("from") == 0, F.coalesce("spelling", "w")).otherwise(F.col("w"))).withColumn("in_", F.col("key").isin(*allowed) if allowed else F.lit(False))
    any_ = F.max("in_").over(Window.partitionBy("page_id"))
    side = F.when(any_, F.when(F.col("in_"), 0).otherwise(1)).otherwise(F.col("from"))
    words = words.withColumn("side", side).withColumn("order_", F.when((F.col("side") == 1) & (F.col("from") == 0), F.col("i") + 1_000_000).otherwise(F.col("i")))
    words = words.withColumn("n", F.row_number().over(Window.partitionBy("page_id", "side", "key").orderBy("order_"))).filter("n = 1")
    pick = lambda s: F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == s, F.struct("order_", "w")))), lambda x: x["w"])
    return words.groupBy("page_id").agg(pick(0).alias("tags"), pick(1).alias("keywords"))


WARNING_ORDER = ("unresolved_conflict", "open_question", "empty_summary", "orphan", "summary_dump", "unintegrated_source", "compile_debt", "page_too_large", "missing_supersedes", "tag_variant", "tag_off_list", "missing_target")


def lint(pages: DataFrame, blocks: DataFrame, resolved: DataFrame, vocabulary: list[str] | None = None) -> DataFrame:
    """All warnings: page_id, block_id, kind, detail."""
    debt = compile_debt(pages, resolved)
    out = link_warnings(pages, resolved).unionByName(content_warnings(pages, blocks, resolved)).unionByName(_warn(unintegrated(pages, resolved), "unintegrated_source"))
    return out.unionByName(_warn(debt, "compile_debt", F.concat_ws(": ", F.col("n").cast("string"), "newer"))).unionByName(tag_warnings(pages, vocabulary))


def warning_kinds(warnings: DataFrame) -> DataFrame:
    """kind, n; kinds without warnings have no row."""
    return warnings.groupBy("kind").agg(F.count("*").alias("n"))


def issue_counts(blocks: DataFrame) -> DataFrame:
    """One row: unresolved_conflicts and open_questions."""
    return blocks.agg(F.count_if("unresolved").alias("unresolved_conflicts"), F.count_if((F.col("kind") == "open_question") & ~F.col("unresolved")).alias("open_questions"))


def keep_block_ids(prior: DataFrame, new: DataFrame) -> DataFrame:
    """`new` blocks (page_id, pos, block_id, fingerprint) with the ids that blocks of the same fingerprint had in `prior`, in order."""
    n = F.row_number().over(Window.partitionBy("page_id", "fingerprint").orderBy("pos"))
    old = prior.withColumn("n", n).select("page_id", "fingerprint", "n", F.col("block_id").alias("old_id"))
    joined = new.withColumn("n", n).join(old, ["page_id", "fingerprint", "n"], "left")
    return joined.withColumn("block_id", F.coalesce("old_id", "block_id")).drop("n", "old_id")


def repair(blocks: DataFrame) -> DataFrame:
    """page_id, block_id, verdict, source_text, data: what puts a drifted block right.

    derived: fingerprint, references or data follow the source; source: the source is rendered from data that parse
    back to themselves; undecided: neither gives the other.
    """
    drifted = block_drift(blocks).select("page_id", "block_id").distinct()
    schema = "page_id string, block_id string, verdict string, source_text string, data string"

    def run(frames):
        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                one = markdown.parse_one(r.page_id, r.source_text or "")
                data = json.loads(r.data) if r.data else None
                if r.kind in DATA_FREE or (one is not None and one["kind"] == r.kind and (data is None or markdown.fingerprint(r.kind, r.source_text) == r.fingerprint)):
                    out.append((r.page_id, r.block_id, "derived", r.source_text, json.dumps(one["data"], ensure_ascii=False) if one and r.kind not in DATA_FREE else r.data))
                elif data is not None and (text := markdown.render_data(r.page_id, r.kind, data)) is not None and markdown.fingerprint(r.kind, text) == r.fingerprint:
                    out.append((r.page_id, r.block_id, "source", text, r.data))
                else:
                    out.append((r.page_id, r.block_id, "undecided", r.source_text, r.data))
            yield pd.DataFrame(out, columns=["page_id", "block_id", "verdict", "source_text", "data"])

    return blocks.join(drifted, ["page_id", "block_id"], "left_semi").select("page_id", "block_id", "kind", "source_text", "fingerprint", "refs", "data").mapInPandas(run, schema)
