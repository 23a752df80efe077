"""Repair of the order of turns in conversations by a weighted automaton that is determinised as it is used.

A conversation is a string of symbols: each row's role initial and its first fault. Edits (keep, rerole, delete, insert) make its roles match
`(s?(ua)+)?` at the least cost. The automaton has four states: nothing yet, after s, after u, after a. What the rest of a conversation costs
from each of them is a vector; less its least element, there are few different ones, since each state can be left by an insertion. These normalised
vectors are the states of a deterministic automaton, made when they are first met and kept in a table by symbol, so that the cost of a
conversation is one scan of a table, from its last row to its first. Each entry also holds the tight arcs: from each state the
edits, least in ASCII, that reach the cost. They are followed backward over the scan, that is in reading order, which gives the audit.

Rows are sorted by range, not by conversation, so a long conversation is spread over tasks. Of each row one symbol goes into its conversation's
string: a byte for a row, as in the audit, which is one value by definition. Texts are never gathered: they stream, in order, through the
task that hashes or writes the repaired conversation.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import checkpointed, tidied

#: Costs of the edits, and what a truncated row that stays adds.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Initials by number, and where rows with them lead from each state (nothing yet, after s, after u, after a); None: nowhere.
INITIALS = "sua"
NEXT = ((1, None, None, None), (2, 2, None, 2), (None, None, 3, None), (None, None, None, None))
#: Where the next user or assistant turn leads, and what that turn's role is.
FILL, ROLE = (2, 2, 3, 2), ("user", "user", "assistant", "user")
#: Faults by number. A symbol is 4 * initial + fault, as a hexadecimal digit.
BLANK, DUPLICATE, CUT = 1, 2, 3
#: Insertions that end a conversation in each state.
TAIL = (0, 2, 1, 0)
#: Rows of a conversation whose symbols are joined at once, as a power of two.
CHUNK = 12
SEEN = "[^\\x20\\x09-\\x0D]"


class Repairs:
    """The transition table, shared by all conversations of a Python worker."""

    def __init__(self):
        self.number: dict[tuple, int] = {}
        self.vectors: list[tuple] = []
        self.table: list[list] = []
        self.end = self._state(tuple(n * INSERT for n in TAIL))

    def _state(self, vector: tuple) -> int:
        if vector not in self.number:
            self.number[vector] = len(self.vectors)
            self.vectors.append(vector)
            self.table.append([None] * 16)
        return self.number[vector]

    def _entry(self, after: int, symbol: int) -> tuple:
        """(state before the symbol, what its least element is above that of the state after it, (edits, state) by state)."""
        rest, (initial, fault) = self.vectors[after], divmod(symbol, 4)
        more = TRUNCATED if fault == CUT else 0
        edits = []  # by state: (letter, cost with the rest, state after it), in ASCII order but for insertions
        for q in range(4):
            own = [("D", DELETE + rest[q], q)]
            if fault not in (BLANK, DUPLICATE):
                if (to := NEXT[initial][q]) is not None:
                    own.append(("K", KEEP + more + rest[to], to))
                own.append(("R", REROLE + more + rest[FILL[q]], FILL[q]))
            edits.append(own)
        cost = [min(c for _, c, _ in own) for own in edits]
        for _ in range(3):  # a chain of insertions that passes a state twice only costs more
            cost = [min(c, INSERT + cost[FILL[q]]) for q, c in enumerate(cost)]
        arcs = []
        for q in range(4):
            letters, at = "", q
            while True:
                tight = [(x, to) for x, c, to in edits[at] if c == cost[at]]
                if INSERT + cost[FILL[at]] == cost[at]:
                    tight.append(("I", at))
                letter, to = min(tight)
                letters += letter
                if letter != "I":
                    break
                at = FILL[at]
            arcs.append((letters, to))
        least = min(cost)
        return self._state(tuple(c - least for c in cost)), least, tuple(arcs)

    def solve(self, symbols: str) -> tuple[int, str]:
        """Least cost, and of the cheapest edits the letters that are least in ASCII."""
        at, cost, path = self.end, 0, []
        for s in reversed(symbols):
            symbol = int(s, 16)
            entry = self.table[at][symbol]
            if entry is None:
                entry = self.table[at][symbol] = self._entry(at, symbol)
            at = entry[0]
            cost += entry[1]
            path.append(entry[2])
        cost += self.vectors[at][0]
        q, out = 0, []
        while path:
            letters, q = path.pop()[q]
            out.append(letters)
        return cost, "".join(out) + "I" * TAIL[q]


@lru_cache(maxsize=1)
def repairs() -> Repairs:
    return Repairs()


@lru_cache(maxsize=50_000)
def _solved(symbols: str) -> tuple[int, str]:
    return repairs().solve(symbols)


def solved(symbols: str) -> tuple[int, str]:
    """`Repairs.solve` by the worker's table; short conversations are remembered whole."""
    return _solved(symbols) if len(symbols) <= 32 else repairs().solve(symbols)


def _initial(role: Column) -> Column:
    return F.when(F.substring(role, 1, 1).isin(*INITIALS), F.instr(F.lit(INITIALS), F.substring(role, 1, 1)) - 1).otherwise(len(INITIALS))


def ordered(df: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    """k_, t_, r_, x_, sha_ and pos_, which grows in the order of rows: key, turn (nulls first), then role, text's beginning, digest of both."""
    rows = df.select(F.col(key).alias("k_"), F.col(turn).cast("long").alias("t_"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(a) for c, a in ((role, "r_"), (text, "x_"))))
    rows = rows.withColumn("sha_", F.unhex(F.sha2(F.concat(F.octet_length("r_").cast("string"), F.lit(":"), "r_", "x_").cast("binary"), 256))).withColumn("id_", F.monotonically_increasing_id())
    order = ["k_", "t_", F.substring("r_", 1, 64), F.substring("x_", 1, 64), "sha_", "id_"]
    return checkpointed(rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("id_").withColumn("pos_", F.monotonically_increasing_id()))


def _symbols(rows: DataFrame) -> DataFrame:
    """k_, symbols: one row per conversation."""
    firsts = rows.groupBy("k_", "sha_").agg(F.min("pos_").alias("pos_"))
    told = rows.select("k_", "pos_", _initial(F.col("r_")).alias("initial"), F.regexp_extract("x_", f"({SEEN})[\\x20\\x09-\\x0D]*\\z", 1).alias("last"))
    told = told.join(firsts.select("pos_", F.lit(True).alias("first")), "pos_", "left")
    fault = F.when(F.col("last") == "", BLANK).when(F.col("first").isNull(), DUPLICATE).when(~F.col("last").isin(".", "!", "?"), CUT).otherwise(0)
    joined = lambda of, by: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by, of))), lambda x: x[of]), "")
    told = told.select("k_", "pos_", F.lower(F.hex((F.col("initial") * 4 + fault).cast("long"))).alias("symbol"))
    chunks = told.groupBy("k_", F.shiftright("pos_", CHUNK).alias("chunk")).agg(joined("symbol", "pos_").alias("symbol"))
    return chunks.groupBy("k_").agg(joined("symbol", "chunk").alias("symbols"))


def _audits(symbols: DataFrame) -> DataFrame:
    kind = symbols.schema["k_"].dataType.simpleString()
    names = ["blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    legal = {(a, b) for a, b in ("su", "ua", "au")}

    def run(batches):
        by_fault = [[f"{4 * i + fault:x}" for i in range(4)] for fault in (BLANK, DUPLICATE, CUT)]
        initial = {f"{4 * i + f:x}": (INITIALS + "?")[i] for i in range(4) for f in range(4)}
        for b in batches:
            rows = []
            for symbols in b.column(1).to_pylist():
                initials = [initial[s] for s in symbols]
                rows.append((*(sum(map(symbols.count, own)) for own in by_fault), sum(p not in legal for p in zip(initials, initials[1:], strict=False)), *solved(symbols)))
            cols = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols[:-1]), pa.array(cols[-1], pa.string())], ["k_", *names])

    return symbols.mapInArrow(tidied(run), f"k_ {kind}, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string")


def _lines(rows: DataFrame, audits: DataFrame, make, schema: str) -> DataFrame:
    """`make(key, lines)` for each conversation: lines yields (role, text) of the repaired conversation, while its rows stream by."""
    plan = audits.select("k_", F.lit(-1).cast("long").alias("pos_"), F.lit("").alias("r_"), F.col("audit").alias("x_"))
    stream = plan.unionByName(rows.select("k_", "pos_", "r_", "x_")).repartition("k_").sortWithinPartitions("k_", "pos_")
    kind = rows.schema["k_"].dataType.simpleString()
    names = ["k_", *(part.split()[0] for part in schema.split(", "))]
    kinds = {"string": pa.string(), "bigint": pa.int64()}
    types = [kinds[part.split()[1]] for part in schema.split(", ")]

    def run(batches):
        flat = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        ahead = next(flat, None)
        keys, out = [], []
        key_type = None

        def edited(audit):
            nonlocal ahead
            q, source = 0, None
            for letter in audit:
                if letter == "I":
                    q, line = FILL[q], (ROLE[q], "")
                else:
                    source, ahead = ahead, next(flat, None)
                    if letter == "D":
                        continue
                    if letter == "K":
                        q, line = NEXT[INITIALS.index(source[2][0])][q], source[2:4]
                    else:
                        q, line = FILL[q], (ROLE[q], source[3])
                yield line

        while ahead is not None:
            key, _, _, audit = ahead
            ahead = next(flat, None)
            for made in make(edited(audit)):
                keys.append(key)
                out.append(made)
                if len(out) >= 1000:
                    yield batch(keys, out)
                    keys, out = [], []
        if out:
            yield batch(keys, out)

    from pyspark.sql.pandas.types import to_arrow_type

    arrow_key = to_arrow_type(rows.schema["k_"].dataType)

    def batch(keys, out):
        return pa.RecordBatch.from_arrays([pa.array(keys, arrow_key), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True))], names)

    return stream.mapInArrow(tidied(run), f"k_ {kind}, {schema}")


def _digest(lines):
    h, first = hashlib.sha256(), True
    for role, text in lines:
        h.update(f"{'' if first else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
        first = False
    yield (h.hexdigest(),)


def _numbered(lines):
    yield from ((i, role, text) for i, (role, text) in enumerate(lines))


def _gaps(rows: DataFrame) -> DataFrame:
    """k_, gaps: turns that are missing between the least and the greatest, as a 64-bit number at most."""
    turns = rows.select("k_", "t_").distinct().groupBy("k_").agg(F.max("t_").cast("decimal(20,0)").alias("hi"), F.min("t_").cast("decimal(20,0)").alias("lo"), F.count("t_").alias("n"))
    gaps = F.col("hi") - F.col("lo") + 1 - F.col("n")
    return turns.select("k_", F.least(F.coalesce(gaps, F.lit(0).cast("decimal(20,0)")), F.lit((1 << 63) - 1).cast("decimal(20,0)")).cast("long").alias("gaps"))


def repair_conversations(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation of `df`: its key, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows are taken by turn, nulls first; of equal turns by role, the first 64 characters of the text, and a digest of both. A row's first fault
    counts: blank text, role and text seen earlier in the conversation, no `.!?` at the end. Null roles and texts are one space. All rows
    with a null key are one conversation. Wholly equal rows are duplicates of the first. An empty table gives no rows. Other columns aren't read, whatever their names.
    """
    rows = ordered(df, key, turn, role, text)
    audits = checkpointed(_audits(_symbols(rows)))
    digests = _lines(rows, audits, _digest, "repaired_sha256 string")
    same = lambda other: F.col("k_").eqNullSafe(F.col(other))
    out = audits.join(_gaps(rows).withColumnRenamed("k_", "g_"), same("g_")).join(digests.withColumnRenamed("k_", "d_"), same("d_"))
    return out.select(F.col("k_").alias(key), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def repaired_turns(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The repaired conversations themselves: key, place (from 0), role, text. A conversation of which nothing stays has no rows; else as `repair_conversations`."""
    rows = ordered(df, key, turn, role, text)
    out = _lines(rows, checkpointed(_audits(_symbols(rows))), _numbered, "place_ bigint, role_ string, text_ string")
    return out.select(F.col("k_").alias(key), F.col("place_").alias("place"), F.col("role_").alias("role"), F.col("text_").alias("text"))
