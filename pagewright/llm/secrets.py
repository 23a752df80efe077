"""Secret scan: fixed patterns, and windows of high entropy in long strings.

Positions are code points, ends exclusive. A pattern's matches are found in one pass each: a regular expression
takes the gap before a match together with the match, so that the lengths of gaps and matches add up to positions.

The method proper looks at candidates, which are runs of 20 or more characters of [A-Za-z0-9+/_=-] that mix letters and digits.
A window of 20 characters slides over a candidate. The counts c of its characters (a byte each) and the sum of
c * log2(c) over them are carried from one window to the next: only the counts of the character that leaves and of the one that
enters change. Time grows with the length of a text and the number of its matches. A candidate is reported if the highest entropy of its windows reaches the
threshold of its character class (hexadecimal, alphanumeric, base64), unless it is on the allow list. All of it is DataFrame functions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import bound, offsets

#: The base kinds in the order in which they are listed, with their patterns and least lengths (of the group named).
ASSIGN = "(?:(?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ASSIGN_LEAST = 6
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "entropy")
#: Characters of a window, windows of a slice.
WINDOW, STEPS = 20, 4096
#: First of the characters that are counted, and their number: + to z.
FIRST = ord("+")
SLOTS = ord("z") - FIRST + 1
#: Bits a character that a window must reach, by class, from the narrowest class to the widest.
CLASSES = (("[0-9a-fA-F]+", 3.01), ("[A-Za-z0-9]+", 3.61), ("[A-Za-z0-9+/_=-]+", 3.81))
#: Candidates that are never reported: UUIDs and dates with times, paths, and words joined by marks without any digit.
ALLOW = (
    "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    "[0-9]{4}-[0-9]{2}-[0-9]{2}[0-9T_-]*",
    "[A-Za-z]*(?:[/_=+-]+[A-Za-z]+)*[/_=+-]*",
)


def _matches(text: Column, pattern: str, groups: int = 0) -> tuple[Column, Column, Column]:
    """Gaps before the matches, the matches, and the last group of each; the last gap has no match behind it."""
    whole = f"(?s)(.*?)(?:({pattern})|\\z)"
    return tuple(F.regexp_extract_all(text, F.lit(whole), F.lit(g)) for g in (1, 2, 2 + groups))


def _spans(text: Column, pattern: str, groups: int, keep) -> Column:
    """Array of (start, end) of the leftmost non-overlapping matches that `keep` (a function of match and group) accepts."""
    gaps, found, group = _matches(text, pattern, groups)

    def placed(z):
        before = offsets(F.transform(z, lambda x: F.char_length(x["g"]) + F.char_length(x["m"])))
        spans = F.zip_with(z, before, lambda x, at: F.struct((at + F.char_length(x["g"])).alias("s"), (at + F.char_length(x["g"]) + F.char_length(x["m"])).alias("e"), x["m"].alias("m"), x["v"].alias("v")))
        return F.transform(F.filter(spans, lambda x: (x["m"] != "") & keep(x["m"], x["v"])), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))

    return bound(F.arrays_zip(gaps.alias("g"), found.alias("m"), group.alias("v")), placed)


def _least_sum(s: Column, window: int) -> Column:
    """Least sum of c * log2(c) over the counts c of the windows of a string; the counts (a byte for each character) are carried along."""
    clog = [c * math.log2(c) if c else 0.0 for c in range(window + 2)]
    # what one more of c characters adds to the sum, and the byte that stands for c
    more = F.expr("array(" + ",".join(f"{clog[c + 1] - clog[c]!r}D" for c in range(window + 1)) + ")")
    byte = F.expr("array(" + ",".join(f"X'{c:02x}'" for c in range(window + 1)) + ")")
    zero = F.struct(F.lit(bytes(SLOTS)).alias("counts"), F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("least"))

    def count(counts, slot):
        return F.ascii(F.substring(counts, slot, F.lit(1)).cast("string"))

    def step(acc, x):
        # o is the character that leaves (0 before the first window is full), i the one that enters
        i, o = x["i"], x["o"]
        gone = count(acc["counts"], o) - 1
        come = count(acc["counts"], i) - F.when(i == o, 1).otherwise(0)
        rest = F.when(o == 0, acc["counts"]).otherwise(F.overlay(acc["counts"], F.get(byte, gone), o, F.lit(1)))
        return F.struct(
            F.overlay(rest, F.get(byte, come + 1), i, F.lit(1)).alias("counts"),
            (acc["sum"] + F.get(more, come) - F.when(o == 0, 0.0).otherwise(F.get(more, gone))).alias("sum"),
            F.when(o > 0, F.least(acc["least"], acc["sum"])).alias("least"),
        )

    def folded(x):
        moves = F.arrays_zip(x.alias("i"), F.slice(F.concat(F.array_repeat(F.lit(0), window), x), F.lit(1), F.size(x)).alias("o"))
        return F.aggregate(moves, zero, step, lambda acc: F.least(acc["least"], acc["sum"]))

    return bound(F.transform(F.split(s, ""), lambda c: F.ascii(c) - FIRST + 1), folded)


def reaches(s: Column, bar: Column, window: int = WINDOW) -> Column:
    """Whether a window of a string (of characters from + to z, at least `window` long) has `bar` bits of Shannon entropy a character.

    With S = sum of c*log2(c) over the counts c of a window of w characters, its entropy is log2(w) - S/w. A long string is
    worked off in slices of STEPS windows, so that time grows with its length and memory doesn't; a slice with fewer than 2**bar
    different characters has no such window.
    """

    def sliced(raw):
        last = F.floor((F.octet_length(raw) - window) / STEPS).cast("int")
        cut = lambda i: F.substring(raw, i * STEPS + 1, F.lit(STEPS + window - 1)).cast("string")  # noqa: E731  of bytes: no walk from the start
        varied = lambda x: F.log2(F.size(F.array_distinct(F.split(x, ""))).cast("double")) >= bar - 1e-6
        return F.exists(F.sequence(F.lit(0), last), lambda i: bound(cut(i), lambda x: varied(x) & (F.lit(math.log2(window)) - _least_sum(x, window) / window >= bar)))

    return bound(s.cast("binary"), sliced)


def _suspicious(m: Column, allow: tuple[str, ...]) -> Column:
    ok = m.rlike("[0-9]") & m.rlike("[A-Za-z]")
    for a in allow:
        ok &= ~m.rlike(f"^(?:{a})$")
    bar = F.lit(CLASSES[-1][1])
    for pattern, least in reversed(CLASSES):
        bar = F.when(m.rlike(f"^{pattern}$"), least).otherwise(bar)
    # `ok` guards the loop over windows: it only runs for what is left
    return F.when(ok, bound(bar, lambda b: reaches(m, b))).otherwise(False)


def _joined(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed."""
    listed = F.create_map(*(F.lit(x) for i, k in enumerate(KINDS) for x in (i, k)))
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", listed[x["k"]], x["s"].cast("string"), x["e"].cast("string"))), ",")


def scan_secrets(df: DataFrame, key: str = "doc_id", text: str = "text", allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """One row per row of `df`: key, n_assign, n_access, n_hex, base_sha256, spans (of all kinds).

    Narrow: no shuffle. A null text counts as empty: no spans. Null and repeated keys and repeated rows are carried along,
    empty tables give no rows, other columns are not read. Kinds overlap freely; within one kind matches don't.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    true = lambda m, v: F.lit(True)
    empty = F.expr("cast(array() as array<struct<s:bigint,e:bigint>>)")

    def found(pattern, groups, keep, hint):  # the hint is a cheap look whether a match is there at all
        return F.when(F.col("t").rlike(hint), _spans(F.col("t"), pattern, groups, keep)).otherwise(empty)

    rows = df.select(F.col(key).alias("key_"), t.alias("t")).select(
        "key_",
        found(ASSIGN, 1, lambda m, v: F.char_length(v) >= ASSIGN_LEAST, "(?i)password|passwd|secret|token|api_?key").alias("assign"),
        found(ACCESS, 0, true, "AKIA").alias("access"),
        found(HEX, 0, true, HEX).alias("hex"),
        found(CANDIDATE, 0, lambda m, v: _suspicious(m, allow), CANDIDATE).alias("entropy"),
    )

    def tag(i):
        return F.transform(KINDS[i], lambda x: F.struct(x["s"].alias("s"), F.lit(i).alias("k"), x["e"].alias("e")))

    tagged = {k: tag(i) for i, k in enumerate(KINDS)}
    base = F.concat(*(tagged[k] for k in KINDS[:3]))
    return rows.select(
        F.col("key_").alias(key),
        *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"),
        _joined(F.concat(base, tagged["entropy"])).alias("spans"),
    )
