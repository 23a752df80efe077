import random
from collections import Counter

import pytest

from pagewright.llm import mixing as X


def test_schedule_meets_releases_and_deadlines():
    r = random.Random(1)
    for _ in range(60):
        w = {f"s{i}": r.choice([1, 1, 2, 5, 40, 300]) for i in range(r.randint(1, 30))}
        u = X.units(w, 200)
        q = sum(u.values())
        assert q == max(200, 4 * len(w)) and min(u.values()) >= 1
        plan = X.schedule(u)
        assert [p[2] for p in plan] == list(range(q))
        done = Counter()
        for k, i, slot, release, deadline in plan:
            assert release <= slot < deadline and done[k] == i
            done[k] += 1
            assert all(abs(done[s] - u[s] * (slot + 1) / q) < 1 for s in u)


def test_units():
    assert X.units({"a": 1, "b": 1}, 10) == {"a": 5, "b": 5}
    assert X.units({"a": 0, "b": 1}, 10) == {"a": 1, "b": 9}
    assert sum(X.units({None: 3.5, "b": 1e-9, "c": 1e9}, 7).values()) == 12


def test_rows(spark, monkeypatch):
    monkeypatch.setattr(X, "RANGE_ROWS", 50)
    r = random.Random(2)
    rows = [(i, f"t{i}", "hot" if i % 3 == 0 else r.choice(["a", "b", None]), 1) for i in range(1200)] + [(5, "t5", "hot", 1)] * 3 + [(None, None, "b", 1)] * 2
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, slot int")
    weights = {"hot": 2, "a": 1, "b": 1}
    got = X.mix(df, weights=weights, block_rows=8, period=100).collect()
    assert Counter((x.doc_id, x.text, x.source) for x in got) == Counter(x[:3] for x in rows)
    size = Counter(x[2] for x in rows)
    of = {s: sorted((x.block, x.place) for x in got if x.source == s) for s in size}
    assert all(of[s] == [divmod(i, 8) for i in range(size[s])] for s in size)
    assert all(x.release <= x.slot < x.deadline for x in got)
    slots = {}
    for x in got:
        assert slots.setdefault(x.slot, (x.source, x.block)) == (x.source, x.block)
    u = X.units({k: weights.get(k, 0) for k in size}, 100)
    last = {s: -(-size[s] // 8) for s in size}  # while all have blocks, each is less than one away from its share
    done = Counter()
    for t in range(max(slots) + 1):
        if t in slots:
            done[slots[t][0]] += 1
        if all(done[s] < last[s] for s in size):
            assert all(abs(done[s] - u[s] * (t + 1) / 100) < 1 for s in size)


def test_too_many_sources(spark, monkeypatch):
    monkeypatch.setattr(X, "SOURCES", 3)
    df = spark.createDataFrame([(i, f"s{i % 4}") for i in range(9)], "doc_id bigint, source string")
    with pytest.raises(ValueError, match="more than 3"):
        X.mix(df, tie=None)
    assert X.mix(df.filter("source <> 's3'"), tie=None).count() == 7


def test_default_weights_and_empty(spark):
    df = spark.createDataFrame([(i, "t", "x" if i < 90 else "y") for i in range(100)], "doc_id bigint, text string, source string")
    assert X.mix(df).count() == 100
    empty = X.mix(df.limit(0))
    assert empty.count() == 0 and empty.columns == X.mix(df).columns


def test_names_of_helper_columns(spark):
    """Any column that isn't named like a result comes out as it went in."""
    names = ["i", "at", "s", "u", "w", "q", "h", "r", "p", "n", "q_", "h_", "r_", "p_", "n_", "s_", "before", "before_", "units", "rel", "due", "row", "count", "a.b"]
    rows = [(k, f"t{k}", f"s{k % 3}", *(f"{n}{k}" for n in names)) for k in range(100)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, " + ", ".join(f"`{n}` string" for n in names))
    got = X.mix(df).collect()
    assert sorted(tuple(x)[: len(rows[0])] for x in got) == rows
    for n in ("row", "n", "s"):
        renamed = df.drop(n).withColumnRenamed("source", n)
        assert X.mix(renamed, source=n).count() == 100
        assert X.mix(df.drop(n).withColumnRenamed("doc_id", n), key=n).count() == 100
