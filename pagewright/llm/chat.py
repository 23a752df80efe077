"""Chat formatting: heterogeneous records become canonical turns, and turns become text with a loss mask.

A record is a JSON text in some layout. Its fingerprint is the hash of those of its nested field paths that any layout knows, so
that further fields (a name, an id) and other types (a number as content) don't matter; the fingerprint selects a declarative
mapping (which path holds the turns, or which paths are turns of which role). Mappings are data: adding a layout means adding an entry
to LAYOUTS. All of it is DataFrame functions.

The template writes each turn as `### role`, a line feed, the text, `</turn>` and a line feed. Inside roles and texts the
characters that control strings begin with are escaped (backslash to \\b, `<` to \\l, `#` to \\h, and in roles a
line feed to \\n), so that a text can hold any control string and reading back gives the same text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import bound, offsets

#: name: (example record, how to read it). A list of turns is read by its path and its fields for role and text, whose value may also be a list
#: of parts; their texts are joined. Other layouts list (role, path) in the order of the turns, and an absent or null path gives no turn.
LAYOUTS: dict[str, tuple[str, dict]] = {
    "messages": ('{"messages":[{"content":"","role":""}]}', {"list": "$.messages", "role": "role", "text": "content", "parts": "text"}),
    "shares": ('{"conversations":[{"from":"","value":""}]}', {"list": "$.conversations", "role": "from", "text": "value"}),
    "prompt": ('{"prompt":"","response":""}', {"turns": [("user", "$.prompt"), ("assistant", "$.response")]}),
    "instruction": ('{"input":"","instruction":"","output":""}', {"turns": [("system", "$.instruction"), ("user", "$.input"), ("assistant", "$.output")]}),
    "nested": ('{"data":{"context":"","question":""},"reply":{"text":""}}', {"turns": [("system", "$.data.context"), ("user", "$.data.question"), ("assistant", "$.reply.text")]}),
}
#: Names that layouts use for the three roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "user": "user", "assistant": "assistant", "system": "system"}
END = "</turn>\n"
EMPTY_LIST = '{"%s":[]}'
#: Code points of roles and texts up to which `records_of` writes them into the record; beyond, the record holds their places.
INLINE = 1 << 20
#: Column with the turns whose places a record holds; null where the record holds them itself.
HELD = "held_"
#: No JSON text of fewer bytes is beyond the parser's limits: a string of 20,000,000 characters, a variant of 128 MiB.
PARSER_BYTES = 20_000_000
TURNS = "array<struct<role:string,text:string>>"
#: Why a record has no turns.
NOT_JSON, TOO_LARGE, UNKNOWN = "not JSON", "larger than the parser takes", "unknown layout"


def paths_of(how: dict) -> list[tuple[str, str | None]]:
    """Field paths that a mapping reads: (path, None), or (path of a list, field of its items)."""
    if "list" in how:
        return [(how["list"], None), (how["list"], how["role"]), (how["list"], how["text"])]
    return [(path, None) for _, path in how["turns"]]


def _there(record: Column, path: str, field: str | None) -> Column:
    """Whether a variant has a path, or any item of the list there has the field."""
    if field is None:
        return F.variant_get(record, path, "variant").isNotNull()
    return F.coalesce(F.exists(F.try_variant_get(record, path, "array<variant>"), lambda x: F.variant_get(x, "$." + field, "variant").isNotNull()), F.lit(False))


def fingerprint(record: Column, layouts: dict = LAYOUTS) -> Column:
    """Hash of the nested field paths of a variant, of those that `layouts` know; null where the record is null."""
    known = sorted({p for _, how in layouts.values() for p in paths_of(how)}, key=str)
    found = [F.when(_there(record, p, f), F.lit(p if f is None else f"{p}[].{f}")) for p, f in known]
    return F.when(record.isNotNull(), F.xxhash64(F.array_join(F.array_compact(F.array(*found)), "\n")))


def _only_complete(record: Column, layouts: dict) -> Column:
    """The layout all of whose paths a variant has, if there is one such layout: further paths of other layouts are strays then."""
    full = [F.when(reduce(Column.__and__, [_there(record, p, f) for p, f in paths_of(how)]), F.lit(n)) for n, (_, how) in layouts.items()]
    return bound(F.array_compact(F.array(*full)), lambda x: F.when(F.size(x) == 1, x[0]))


def _read(record: Column, how: dict) -> Column:
    if "list" in how:
        items = F.variant_get(record, how["list"], "array<variant>")
        get = lambda x, f: F.variant_get(x, "$." + how[f], "string")

        def text(x):
            if "parts" not in how:
                return get(x, "text")
            part = lambda y: F.coalesce(F.variant_get(y, "$." + how["parts"], "string"), F.when(F.schema_of_variant(y) == "STRING", y.cast("string")))
            parts = F.try_variant_get(x, "$." + how["text"], "array<variant>")
            return F.when(parts.isNotNull(), F.array_join(F.transform(parts, part), "")).otherwise(get(x, "text"))

        return F.transform(items, lambda x: F.struct(get(x, "role").alias("role"), text(x).alias("text")))
    turns = [F.struct(F.lit(role).alias("role"), F.variant_get(record, path, "string").alias("text")) for role, path in how["turns"]]
    return F.filter(F.array(*turns), lambda x: x["text"].isNotNull())


def _places(df: DataFrame, held: str | None) -> str | None:
    """The column that holds what records name places of: the one named, else that of `records_of`, told by name and type."""
    return held or next((f.name for f in df.schema.fields if f.name == HELD and f.dataType.simpleString() == TURNS), None)


def _taken(turns: Column, roles: bool, held: str) -> Column:
    """Turns whose texts, and roles if `roles`, are places in the column `held`, with what is there."""
    at = lambda place: F.get(F.col(held), place.cast("int"))
    role = lambda x: at(x["role"])["role"] if roles else x["role"]
    return F.transform(turns, lambda x: F.struct(role(x).alias("role"), at(x["text"])["text"].alias("text")))


def canonical_turns(df: DataFrame, record: str = "record", layouts: dict = LAYOUTS, aliases: dict = ROLES, held: str | None = None) -> DataFrame:
    """`df` with the columns layout (null if no mapping has the record's fingerprint), turns (then null too) and problem (why, else null).

    Roles are mapped by `aliases` whatever their case, others stay; a null role or text is empty. A record whose list of turns is empty has
    no turns. Text that isn't JSON, or is larger than the parser takes (a string of 20,000,000 characters, 128 MiB in all), has no layout,
    nor has a record with all paths of two layouts; single paths of others don't matter. Where the column `held` (unless named, that of `records_of`, if the
    table has it) isn't null, the record's strings are places in it, and roles and texts are taken from there. No other column is changed; columns named like a result are replaced.
    """
    held = _places(df, held)
    names = list(layouts)
    shown = df.sparkSession.range(1).select(*(fingerprint(F.parse_json(F.lit(layouts[n][0])), layouts) for n in names)).first()
    prints = {p: n for n, p in zip(names, shown, strict=True)}
    lists = {n: how["list"] for n, (_, how) in layouts.items() if "list" in how}
    if lists:
        none = df.sparkSession.range(1).select(*(fingerprint(F.parse_json(F.lit(EMPTY_LIST % path.removeprefix("$."))), layouts) for path in lists.values())).first()
        prints |= {p: n for n, p in zip(lists, none, strict=True) if p not in prints}
    variant = "record_"
    while variant in df.columns:
        variant += "_"
    known = F.create_map(*(F.lit(x) for kv in prints.items() for x in kv))
    out = df.withColumn(variant, F.try_parse_json(F.col(record)))
    out = out.withColumn("layout", F.coalesce(known[fingerprint(F.col(variant), layouts)], _only_complete(F.col(variant), layouts)))
    turns = F.lit(None).cast(TURNS)
    for n in names:
        read = _read(F.col(variant), layouts[n][1])
        if held:
            read = F.when(F.col(held).isNull(), read).otherwise(_taken(read, "list" in layouts[n][1], held))
        turns = F.when(F.col("layout") == n, read).otherwise(turns)
    role = F.create_map(*(F.lit(x) for kv in aliases.items() for x in kv)) if aliases else None
    mapped = lambda r: F.coalesce(role[F.lower(r)], r) if aliases else r
    clean = lambda x: F.struct(F.coalesce(mapped(x["role"]), F.lit("")).alias("role"), F.coalesce(x["text"], F.lit("")).alias("text"))
    large = F.octet_length(record) > PARSER_BYTES
    problem = F.when(F.col("layout").isNotNull(), F.lit(None)).when(F.col(variant).isNotNull(), UNKNOWN).when(large, TOO_LARGE).otherwise(NOT_JSON)
    return out.withColumn("turns", F.transform(turns, clean)).withColumn("problem", problem).drop(variant)


def _escaped(x: Column, line: bool = False) -> Column:
    for a, b in [("\\", "\\b"), ("<", "\\l"), ("#", "\\h")] + [("\n", "\\n")] * line:
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def _unescaped(x: Column, line: bool = False) -> Column:
    for a, b in [("\n", "\\n")] * line + [("<", "\\l"), ("#", "\\h"), ("\\", "\\b")]:
        x = F.replace(x, F.lit(b), F.lit(a))
    return x


def render(turns: Column) -> Column:
    """Struct of the formatted text and its loss spans: start and length of each assistant text in code points, and in bytes (at, bytes)."""
    parts = F.transform(turns, lambda t: F.struct(t["role"].alias("role"), F.concat(F.lit("### "), _escaped(t["role"], True), F.lit("\n")).alias("head"), _escaped(t["text"]).alias("body")))

    def written(p):
        size = lambda of: offsets(F.transform(p, lambda x: of(x["head"]) + of(x["body"]) + len(END)))  # noqa: E731  of a turn with its marks
        placed = F.transform(
            F.arrays_zip(p.alias("p"), size(F.char_length).alias("c"), size(F.octet_length).alias("b")),
            lambda x: F.struct(
                x["p"]["role"].alias("role"),
                F.struct(
                    (x["c"] + F.char_length(x["p"]["head"])).alias("start"), F.char_length(x["p"]["body"]).cast("long").alias("length"),
                    (x["b"] + F.octet_length(x["p"]["head"])).alias("at"), F.octet_length(x["p"]["body"]).cast("long").alias("bytes"),
                ).alias("span"),
            ),
        )
        text = F.array_join(F.transform(p, lambda x: F.concat(x["head"], x["body"], F.lit(END))), "")
        return F.struct(text.alias("formatted"), F.transform(F.filter(placed, lambda x: x["role"] == "assistant"), lambda x: x["span"]).alias("loss"))

    return bound(parts, written)


def parse(formatted: Column) -> Column:
    """The turns that `render` wrote."""
    pieces = F.filter(F.split(formatted, END), lambda p: p != "")
    head = lambda p: F.substring_index(p, "\n", 1)
    return F.transform(pieces, lambda p: F.struct(_unescaped(F.replace(head(p), F.lit("### "), F.lit("")), True).alias("role"), _unescaped(F.substring(p, F.char_length(head(p)) + 2, F.char_length(p))).alias("text")))


def masked_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss spans, unescaped. It is cut out of the bytes, as looking for code points would walk from the start for each span."""
    cut = lambda raw: F.transform(loss, lambda s: F.substring(raw, (s["at"] + 1).cast("int"), s["bytes"].cast("int")).cast("string"))
    return _unescaped(F.array_join(bound(formatted.cast("binary"), cut), ""))


def records_of(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One JSON record per conversation (columns key, record, HELD), in the layout that its roles fit.

    A conversation is one record, so its rows must fit in one row (2 GiB). Roles and texts of more than INLINE code points in all are
    beyond what JSON parsers take sooner or later: they stay in HELD, and the record has their places instead. Turns are ordered by turn, then role, then text (nulls first).
    Null texts and roles are empty. A null key names no conversation, so each row with one is a conversation of its own (however many
    there are, they never meet in one row). user + assistant becomes "prompt", system + user + assistant
    "instruction", conversations that start with a system turn "shares", all others "messages".
    """
    turns = F.transform(
        F.array_sort(F.collect_list(F.struct(F.col(turn).alias("n"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")))),
        lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")),
    )
    conv = rows.groupBy(F.col(key).alias("key_"), F.when(F.col(key).isNull(), F.monotonically_increasing_id()).alias("own_")).agg(turns.alias("t"))
    roles = F.transform("t", lambda x: x["role"])
    points = F.aggregate("t", F.lit(0).cast("long"), lambda n, x: n + F.char_length(x["role"]) + F.char_length(x["text"]))
    places = F.transform("t", lambda x, i: F.struct(i.cast("string").alias("role"), i.cast("string").alias("text")))
    conv = conv.select("key_", roles.alias("roles"), F.when(points > INLINE, F.col("t")).alias(HELD), F.when(points > INLINE, places).otherwise(F.col("t")).alias("t"))
    roles = F.col("roles")
    said = lambda i: F.col("t")[i]["text"]
    of = lambda *names: roles == F.array(*map(F.lit, names))
    as_list = lambda top, a, b: F.struct(F.transform("t", lambda x: F.struct(x["text"].alias(b), x["role"].alias(a))).alias(top))
    record = (
        F.when(of("user", "assistant"), F.to_json(F.struct(said(0).alias("prompt"), said(1).alias("response"))))
        .when(of("system", "user", "assistant"), F.to_json(F.struct(said(0).alias("instruction"), said(1).alias("input"), said(2).alias("output"))))
        .when(roles[0] == "system", F.to_json(as_list("conversations", "from", "value")))
        .otherwise(F.to_json(as_list("messages", "role", "content")))
    )
    return conv.select(F.col("key_").alias(key), record.alias("record"), HELD)


def format_chats(records: DataFrame, key: str = "conv_id", record: str = "record", aliases: dict = ROLES, held: str | None = None) -> DataFrame:
    """One row per record: key, layout, formatted, loss, problem.

    A record without turns of a known layout has a problem instead of a layout, a text and spans; none is left out. `aliases` are other names
    of roles, which foreign layouts use; rows whose roles must come out as they are have none. `held` is as in `canonical_turns`. No other
    column is read, whatever its name.
    """
    held = _places(records, held)
    own = records.select(F.col(key).alias("key_"), F.col(record).alias("record"), *([F.col(held).alias(HELD)] if held else []))
    known = canonical_turns(own, aliases=aliases, held=HELD if held else None)
    return known.withColumn("r", F.when(F.col("turns").isNotNull(), render(F.col("turns")))).select(F.col("key_").alias(key), "layout", "r.formatted", "r.loss", "problem")


def format_rows(rows: DataFrame, key: str = "conv_id") -> DataFrame:
    """Formatted conversations from rows by turn, with roles as they are. A conversation that could not be formatted is an error, never left out."""
    done = format_chats(records_of(rows, key), key, aliases={}, held=HELD)
    error = F.raise_error(F.concat(F.lit("a conversation can't be formatted: "), F.col("problem")))
    return done.withColumn("formatted", F.when(F.col("problem").isNull(), F.col("formatted")).otherwise(error))


def digests(formatted: DataFrame, key: str = "conv_id") -> DataFrame:
    """What is read back from formatted chats: counts and digests."""
    sha = lambda s: F.sha2(s.cast("binary"), 256)
    back = formatted.select(key, "formatted", parse(F.col("formatted")).alias("turns"), masked_text(F.col("formatted"), F.col("loss")).alias("masked"))
    return back.select(
        key,
        F.size("turns").cast("long").alias("n_turns"),
        sha(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")).alias("turns_sha256"),
        F.char_length("masked").cast("long").alias("loss_chars"),
        sha(F.col("masked")).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
