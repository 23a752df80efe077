import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest

from pagewright.llm import turns
from pagewright.llm.queries import damaged
from pagewright.llm.turns import Repairs, repair_conversations, repaired_turns

FAULTS = {"": 0, "blank": 1, "duplicate": 2, "truncated": 3}


def faults(rows):
    """The first fault of each (role, text)."""
    seen, out = set(), []
    for role, text in rows:
        shown = re.sub("[\x20\x09-\x0d]", "", text)
        out.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, audit, lines) by a search over all edits: states are (rows done, roles so far as the pattern sees them)."""
    told = faults(rows)
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}
    heap = [(0, "", 0, "", ())]
    done = set()
    while heap:
        cost, audit, i, last, lines = heapq.heappop(heap)
        if (i, last) in done:
            continue
        done.add((i, last))  # of equal costs the least letters come first, and what follows doesn't depend on them
        if i == len(rows) and last in ("", "a"):
            return cost, audit, lines
        for r in ("user", "assistant"):
            if r[0] in follow[last]:
                heapq.heappush(heap, (cost + 5, audit + "I", i, r[0], (*lines, (r, ""))))
        if i < len(rows):
            role, text = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, last, lines))
            if told[i] not in ("blank", "duplicate"):
                more = 5 if told[i] == "truncated" else 0
                if role and role[0] in follow[last]:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, role[0], (*lines, (role, text))))
                for r in ("user", "assistant"):
                    if r[0] in follow[last]:
                        heapq.heappush(heap, (cost + 1 + more, audit + "R", i + 1, r[0], (*lines, (r, text))))


def symbols(rows):
    return "".join(f"{4 * ('sua'.find(role[:1]) if role[:1] in ('s', 'u', 'a') else 3) + FAULTS[f]:x}" for (role, _), f in zip(rows, faults(rows), strict=True))


def brute(conversations):
    out = {}
    for key, rows in conversations.items():
        rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        numbers = [r[0] for r in rows if r[0] is not None]
        pairs = [(r[1:]) for r in rows]
        told = faults(pairs)
        cost, audit, lines = cheapest(pairs)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(pairs, pairs[1:], strict=False))
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()
        out[key] = (gaps, *(told.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)
    return out


ROLES = ["user", "assistant", "system", "tool", "sam", "User", "", " "]


def conversations(seed, n, most=9):
    r = random.Random(seed)
    return {k: [(r.choice([None, *range(12)]), r.choice(ROLES[:3] * 4 + ROLES), r.choice(["", " \n", "Yes.", "No", "Why? ", "a.b", "\x85", "é!\t", str(r.random()) + "."])) for _ in range(r.randint(1, most))] for k in range(n)}


def test_costs_and_audits_by_search():
    made, r = Repairs(), random.Random(1)
    for _ in range(4000):
        rows = [(r.choice(ROLES), r.choice(["", "Yes.", "No", str(r.random()) + ".", str(r.random())])) for _ in range(r.randint(0, 8))]
        cost, audit, _ = cheapest(rows)
        assert made.solve(symbols(rows)) == (cost, audit), rows
    assert len(made.vectors) < 100  # few normalised vectors, however many conversations


def test_long_conversations_use_the_same_table():
    made, r = Repairs(), random.Random(2)
    for n in (10_000, 1_000_000):
        made.solve("".join(r.choice("0123456789abcdef") for _ in range(n)))
    assert len(made.vectors) < 100
    assert made.solve("48" * 100_000) == (0, "K" * 200_000)


def test_rows(spark):
    held = conversations(3, 200)
    rows = [(k, *row) for k, v in held.items() for row in v]
    random.Random(4).shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(5)
    got = {r.conv_id: tuple(r)[1:] for r in repair_conversations(df).collect()}
    assert got == brute(held)
    lines = defaultdict(list)
    for r in sorted(repaired_turns(df).collect()):
        lines[r.conv_id].append((r.role, r.text))
    for k, v in got.items():
        assert hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines[k]).encode()).hexdigest() == v[-1]
        assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in lines[k]))


def test_damage(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    want = []
    for r in rows.collect():
        code = zlib.crc32(f"{' ' if r.conv_id is None else r.conv_id}:{' ' if r.turn is None else r.turn}".encode()) % 20
        role, text = (" " if x is None else x for x in (r.role, r.text))
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        want += [(r.conv_id, r.turn, "user" if code == 4 else role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    assert sorted(map(tuple, damaged(rows).collect()), key=str) == sorted(want, key=str)


def test_edges(spark):
    schema = "conv_id bigint, turn bigint, role string, text string, k_ int, t_ int, audit string, pos_ int, symbols int"
    big = "word " * 100_000
    rows = [(1, 0, "user", big, 1, 1, "x", 1, 1), (1, 1, "assistant", big + "end.", 1, 1, "x", 1, 1)]
    rows += [(None, None, None, None, 1, 1, None, 1, 1), (None, 3, "user", "Hi.", 1, 1, None, 1, 1)]
    rows += [(2, 5, "user", "Same.", 1, 1, "x", 1, 1)] * 3
    rows += [(3, 9_000_000_000_000_000_000, "user", "A.", 1, 1, "x", 1, 1), (3, -9_000_000_000_000_000_000, "assistant", "B.", 1, 1, "x", 1, 1)]
    df = spark.createDataFrame(rows, schema)
    got = {r.conv_id: r for r in repair_conversations(df).collect()}
    held = {1: [(0, "user", big), (1, "assistant", big + "end.")], None: [(None, " ", " "), (3, "user", "Hi.")], 2: [(5, "user", "Same.")] * 3}
    for k, v in brute(held).items():
        assert tuple(got[k])[1:] == v
    assert got[2].duplicate == 2
    assert got[3].gaps == 2**63 - 1
    assert repair_conversations(df.filter("false")).count() == 0
    assert repair_conversations(df.withColumnRenamed("conv_id", "sha_"), key="sha_").count() == 4


def test_one_conversation_over_many_chunks(spark, monkeypatch):
    """A conversation of many rows, with the same null turn or different ones, in chunks of a few rows."""
    monkeypatch.setattr(turns, "CHUNK", 3)
    held = {k: [(turn if k == 7 else None, *row) for turn, (_, *row) in enumerate(v)] for k, v in conversations(8, 8, most=120).items()}
    df = spark.createDataFrame([(k, *row) for k, v in held.items() for row in v], "conv_id bigint, turn bigint, role string, text string").repartition(6)
    assert {r.conv_id: tuple(r)[1:] for r in repair_conversations(df).collect()} == brute(held)
