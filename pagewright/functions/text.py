"""Text functions as Spark columns. All but `nfc`, `folded` and, for some texts, `nfkc` stay in the JVM."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from pagewright.functions import fixed


@F.pandas_udf(StringType())
def nfc(x: pd.Series) -> pd.Series:
    """Unicode NFC, trimmed; null is empty. Needed only where sources aren't in NFC already."""
    return x.fillna("").map(lambda s: unicodedata.normalize("NFC", s).strip())


@F.pandas_udf(StringType())
def _nfkc(x: pd.Series) -> pd.Series:
    return x.fillna("").map(lambda s: unicodedata.normalize("NFKC", s))


#: Characters that NFKC may change: all but ASCII and Latin letters with accents.
_OTHER = "[^\\x00-\\x7fÀ-ÿ]"


def nfkc(x) -> Column:
    """Unicode NFKC; null is empty. Only texts with other characters than ASCII and Latin letters with accents, which stay as they are, go through Python."""
    t = F.coalesce(_column(x), F.lit(""))
    other = t.rlike(_OTHER)
    return F.when(other, _nfkc(F.when(other, t))).otherwise(t)


@F.pandas_udf(StringType())
def folded(x: pd.Series) -> pd.Series:
    """NFC, trimmed and case-folded, for keys of text beyond ASCII."""
    return x.fillna("").map(lambda s: unicodedata.normalize("NFC", s).strip().casefold())


def normalised(rows: DataFrame, column: str) -> DataFrame:
    """`rows` with a column of texts in NFKC; null is empty. Rows that stay as they are (see `nfkc`) don't pass by Python; `rows` are read twice for it."""
    other = F.coalesce(F.col(column).rlike(_OTHER), F.lit(False))
    plain = rows.filter(~other).withColumn(column, F.coalesce(column, F.lit("")))
    return plain.unionByName(rows.filter(other).withColumn(column, _nfkc(column)))


def _column(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def squeezed(x) -> Column:
    """White space trimmed and squeezed to single spaces; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(_column(x), F.lit("")), "\\s+", " "))


def _bound(value: Column, use) -> Column:
    """`use` of a value that is computed once, however often `use` and its inner functions name it."""
    return F.transform(F.array(value), use)[0]


def _starts(s: Column, same) -> Column:
    """Where, from 1, a run of equal items begins in a sorted array; `same` is what two items are compared by."""
    return F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == 1) | (same(F.get(s, i - 1)) != same(F.get(s, i - 2))))


def counted(words) -> Column:
    """Array of (term, tf) of the distinct items of an array, sorted. Within the row, so nothing is shuffled; time is that of the sort."""
    none = F.array().cast("array<struct<term:string,tf:int>>")
    tf = lambda s, st, at, j: (F.coalesce(F.get(st, j + 1), F.size(s) + 1) - at).alias("tf")
    runs = lambda s: _bound(_starts(s, lambda x: x), lambda st: F.transform(st, lambda at, j: F.struct(F.get(s, at - 1).alias("term"), tf(s, st, at, j))))
    w = _column(words)
    return F.when(F.size(w) > 0, _bound(F.sort_array(w), runs)).otherwise(none)


def occurrences(items) -> Column:
    """For each item of an array, how many equal ones there are up to it, itself included."""
    w = _column(items)

    def numbered(s):
        one = lambda st, at, j: F.transform(F.sequence(at, F.coalesce(F.get(st, j + 1) - 1, F.size(s))), lambda k: F.struct(F.get(s, k - 1)["i"].alias("i"), (k - at + 1).alias("n")))
        return _bound(_starts(s, lambda x: x["x"]), lambda st: F.flatten(F.transform(st, lambda at, j: one(st, at, j))))

    placed = F.sort_array(_bound(F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("x"), i.alias("i")))), numbered))
    return F.when(F.size(w) > 0, F.transform(placed, lambda p: p["n"])).otherwise(F.array().cast("array<int>"))


def query_stem(run: Column) -> Column:
    """A Korean run without one ending, then without one particle, if two syllables are left each time."""
    for suffixes in (fixed.QUERY_ENDINGS, fixed.QUERY_PARTICLES):
        # the stem is taken as short as it may be, so that the longest suffix goes
        run = F.regexp_replace(run, f"^(.{{2,}}?)(?:{'|'.join(suffixes)})$", "$1")
    return run


def tokens(text, query: bool = False, normalise: bool = False) -> Column:
    """Array of search tokens, repeated ones included, in the order of the text.

    Korean runs give overlapping pairs of syllables (of the stem, for a query), others the whole run and, if it has more than one
    part of two or more characters, its parts. `normalise` applies NFKC first.
    """
    t = _column(text)
    # a run ends with its last character that isn't a mark
    runs = F.regexp_extract_all(F.lower(nfkc(t) if normalise else F.coalesce(t, F.lit(""))), F.lit(fixed.RUN.replace("*|", "*(?<![.\\-:/])|")), F.lit(0))
    none = F.array().cast("array<string>")

    def pairs(r):
        r = query_stem(r) if query else r
        return F.when(F.length(r) >= 2, F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substring(r, i, F.lit(2)))).otherwise(none)

    def words(r):
        return _bound(F.filter(F.split(r, fixed.RUN_PARTS), lambda p: F.length(p) >= 2), lambda parts: F.when(F.size(parts) > 1, F.concat(F.array(r), parts)).otherwise(F.array(r)))

    # most runs have neither marks nor Korean syllables
    one = lambda r: F.when(F.length(r) < 2, none).when(~r.rlike("[_.\\-:/가-힣]"), F.array(r)).when(r.rlike("^[가-힣]"), pairs(r)).otherwise(words(r))
    return F.flatten(F.transform(runs, one))


def plain_tokens(text) -> Column:
    """Tokens without parts and stems: pairs of Korean syllables and whole other runs."""
    runs = F.regexp_extract_all(F.lower(F.coalesce(_column(text), F.lit(""))), F.lit(fixed.RUN), F.lit(0))
    none = F.array().cast("array<string>")

    def one(r):
        pairs = F.when(F.length(r) >= 2, F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substring(r, i, F.lit(2)))).otherwise(none)
        word = F.regexp_replace(r, fixed.RUN_TAIL, "")
        return F.when(r.rlike("^[가-힣]"), pairs).when(F.length(word) >= 2, F.array(word)).otherwise(none)

    return F.flatten(F.transform(runs, one))


def stop_tokens() -> Column:
    """The bigrams of the question words."""
    return F.array_distinct(tokens(F.lit(" ".join(fixed.STOP_WORDS))))


def scan_tokens(text) -> Column:
    """Distinct tokens of the scan path in order: lower case, two or more characters, no stop word."""
    found = F.transform(F.regexp_extract_all(F.coalesce(_column(text), F.lit("")), F.lit(fixed.SCAN_TOKEN), F.lit(0)), F.lower)
    kept = F.filter(found, lambda t: (F.length(t) >= 2) & ~t.isin(*fixed.SCAN_STOP_WORDS))
    return F.array_distinct(kept)


def match_strength(token: Column, haystack: Column) -> Column:
    """1 if the token occurs, else the share of its longest prefix that does (2 characters or more if Korean, else 4), else 0."""
    least = F.when(token.rlike("^[가-힣]+$"), 2).otherwise(4)
    sizes = F.sequence(F.length(token) - 1, least, F.lit(-1))
    longest = F.aggregate(sizes, F.lit(0), lambda got, n: F.when((got == 0) & F.contains(haystack, F.substring(token, F.lit(1), n)), n).otherwise(got))
    backed = F.when(F.length(token) - 1 >= least, longest / F.length(token)).otherwise(F.lit(0.0))
    return F.when((token == "") | (haystack == ""), 0.0).when(F.contains(haystack, token), 1.0).otherwise(backed)


def link_key(value, fold: bool = False) -> Column:
    """The key under which a link target, id, slug or title is found. `fold` case-folds text beyond ASCII in an Arrow function."""
    t = folded(_column(value)) if fold else F.lower(F.trim(F.coalesce(_column(value), F.lit(""))))
    return F.trim(F.regexp_replace(F.regexp_replace(t, "^page:", ""), "[\\s_]+", "-"), F.lit("-"))


def tag_key(value, fold: bool = False) -> Column:
    """The key that the spellings of a tag share."""
    t = folded(nfkc(_column(value))) if fold else F.lower(F.trim(F.coalesce(_column(value), F.lit(""))))
    return F.trim(F.regexp_replace(t, "[\\s_./-]+", "-"), F.lit("-"))


def token_estimate(text) -> Column:
    """One token for each three bytes, rounded up."""
    return F.ceil(F.octet_length(_column(text)) / 3).cast("int")


def clip(text, limit: int) -> Column:
    """Squeezed text of at most `limit` characters, the last of which is … where it was cut."""
    t = squeezed(text)
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, max(0, limit - 1))), F.lit("…")))


def clip_lead(text, limit: int = 280) -> Column:
    """A text cut behind a word, at the last space within `limit` + 1 characters."""
    t = _column(text)
    head = F.substring(t, 1, limit + 1)
    cut = F.regexp_extract(head, "(?s)^(.+) ", 1)
    return F.when(F.length(t) <= limit, t).otherwise(F.rtrim(F.when(cut != "", cut).otherwise(F.substring(t, 1, limit))))


def lead_text(text) -> Column:
    """Text without list markers and marks, links as their labels."""
    t = F.regexp_replace(F.trim(_column(text)), "\\[\\[[^\\]|#]+(?:#[^\\]|]+)?\\|([^\\]]+)\\]\\]", "$1")
    t = F.regexp_replace(t, "\\[\\[([^\\]|#]+)(?:#[^\\]|]+)?\\]\\]", "$1")
    t = F.regexp_replace(t, "(?m)^\\s*(?:[-*+]|\\d+\\.)\\s+", "")
    return squeezed(F.regexp_replace(t, "[*`#|]", ""))


def refs_in(text) -> Column:
    """Sorted distinct targets of the [[links]] of a text; links that name no page are none."""
    found = F.transform(F.regexp_extract_all(F.coalesce(_column(text), F.lit("")), F.lit(fixed.WIKILINK), F.lit(1)), lambda x: F.trim(x))
    return F.array_sort(F.array_distinct(F.filter(found, lambda t: link_key(t) != "")))


def links_in(text) -> Column:
    """Array of (target, anchor, label) of the [[links]] of a text, in order, repeated ones included."""
    t = F.coalesce(_column(text), F.lit(""))
    part = lambda g: F.transform(F.regexp_extract_all(t, F.lit(fixed.WIKILINK), F.lit(g)), lambda x: F.trim(x))
    zipped = F.arrays_zip(part(1).alias("target"), part(2).alias("anchor"), part(3).alias("label"))
    kept = F.filter(zipped, lambda x: link_key(x["target"]) != "")
    return F.transform(kept, lambda x: F.struct(x["target"].alias("target"), x["anchor"].alias("anchor"), F.when(x["label"] == "", x["target"]).otherwise(x["label"]).alias("label")))


def ref_parts(ref) -> Column:
    """Struct of a reference's lower-case prefix and its rest; the prefix is empty where there is no rest."""
    r = F.trim(_column(ref))
    rest = F.trim(F.regexp_extract(r, "(?s)^[^:]*:(.*)$", 1))
    bare = rest == ""
    return F.struct(F.when(bare, "").otherwise(F.lower(F.substring_index(r, ":", 1))).alias("prefix"), F.when(bare, r).otherwise(rest).alias("target"))


def fingerprint(kind, raw) -> Column:
    """16 hexadecimal digits of the hash of a block's kind and squeezed source."""
    return F.left(F.sha2(F.concat(_column(kind), F.lit("\0"), squeezed(raw)), 256), F.lit(16))


def block_id(slug, print_, occurrence) -> Column:
    return F.concat_ws(":", F.lit("block"), _column(slug), _column(print_), _column(occurrence).cast("string"))


def edge_id(source, target) -> Column:
    return F.concat(F.lit("edge:"), F.left(F.sha2(F.concat_ws("|", _column(source), _column(target)), 256), F.lit(16)))


def group_key(project) -> Column:
    """Configuration key of a project value."""
    k = F.regexp_replace(F.regexp_replace(F.lower(F.trim(_column(project))), "[^a-zA-Z0-9가-힣._-]+", "-"), "^[-._]+|[-._]+$", "")
    return F.when(k != "", k).otherwise(F.concat(F.lit("project-"), F.left(F.sha2(F.trim(_column(project)), 256), F.lit(8))))


def safe_name(page_id) -> Column:
    """File name of a page."""
    k = F.regexp_replace(F.regexp_replace(F.regexp_replace(_column(page_id), "^page:", ""), "[^a-zA-Z0-9가-힣._-]+", "-"), "^[-. ]+|[-. ]+$", "")
    return F.concat(F.when(k != "", k).otherwise(F.left(F.sha2(_column(page_id), 256), F.lit(12))), F.lit(".json"))


def table_cells(row) -> Column:
    """Cells of a table row; an escaped pipe is part of its cell."""
    r = F.regexp_replace(F.regexp_replace(F.trim(_column(row)), "^[|]+", ""), "(?:(?<!\\\\)[|])+$", "")
    return F.transform(F.split(r, "(?<!\\\\)\\|"), lambda c: F.replace(F.trim(c), F.lit("\\|"), F.lit("|")))


def split_rows(raw) -> Column:
    """Rows of a block: lines, without a table's separator rows; a single line is cut into sentences."""
    lines = F.filter(F.transform(F.split(_column(raw), "\n"), squeezed), lambda x: x != "")
    rows = F.filter(lines, lambda x: ~x.rlike("^\\|?[\\s\\-:|]+\\|?$"))
    sentences = F.filter(F.transform(F.split(lines[0], "(?<=[.!?。]) |(?<=다\\.) "), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(lines) == 0, lines).when(lines[0].startswith("|"), rows).when(F.size(lines) >= 2, lines).otherwise(sentences)


def open_question(text) -> Column:
    """Struct of owner (empty if none) and due (null if none) of an open question."""
    t = _column(text)
    due = F.regexp_extract(t, "(?mi)^[ \\t]*(?:due|기한)[ \\t]*:[ \\t]*(\\d{4}-\\d{2}-\\d{2})[ \\t]*$", 1)
    return F.struct(F.regexp_extract(t, "(?mi)^[ \\t]*(?:owner|담당)[ \\t]*:[ \\t]*(\\S.*?)[ \\t]*$", 1).alias("owner"), F.when(due != "", due).alias("due"))


def string_list(value) -> Column:
    """Distinct trimmed items of a comma-separated string, in order."""
    return F.array_distinct(F.filter(F.transform(F.split(_column(value), ","), lambda x: F.trim(x)), lambda x: x != ""))


def split_address(selector) -> Column:
    """Struct of the page and block part of a selector; a block id has an empty page, a page no block."""
    s = F.trim(_column(selector))
    at = F.instr(s, "#")
    page = F.when(s.startswith("block:"), "").when(at > 0, F.trim(F.substring_index(s, "#", 1))).otherwise(s)
    block = F.when(s.startswith("block:"), s).when(at > 0, F.trim(F.substring(s, at + 1, F.length(s))))
    return F.struct(page.alias("page"), block.alias("block"))


def retry_delay(attempts) -> Column:
    """Seconds before the next attempt: an hour, doubled each time, a day at most."""
    return F.least(3600 * F.pow(F.lit(2.0), _column(attempts) - 1), F.lit(86400.0)).cast("int")


def string_hash(text) -> Column:
    """Absolute 32-bit hash with multiplier 31."""
    codes = F.transform(F.filter(F.split(_column(text), ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    wrap = lambda x: F.pmod(x + (1 << 31), F.lit(1 << 32)) - (1 << 31)
    return F.abs(F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: wrap(h * 31 + c)))
