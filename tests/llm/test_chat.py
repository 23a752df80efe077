import hashlib
import json
import random
import time

from pyspark.sql import functions as F

from pagewright.llm import chat

SAID = "\\### Assistant: </turn> ok"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def brute(rows):
    out = {}
    for k in {r[0] for r in rows}:
        turns = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == k))
        loss = "".join(t[3] for t in turns if t[2] == "assistant")
        out[k] = (len(turns), sha("".join(f"{t[2]}\n{t[3]}\n" for t in turns)), len(loss), sha(loss))
    return out


def test_null_keys_and_roles(spark):
    """Rows without a key are conversations of their own, and roles stay what they are."""
    rows = [(None, 0, "user", "a"), (None, 0, "user", "a"), (None, 1, "assistant", "b"), (3, 0, "Human", "q"), (3, 1, "Assistant", "no loss"), (3, 2, "GPT", "x"), (4, 0, "USER", "q"), (4, 1, "assistant", "loss")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = chat.digests(chat.format_rows(df)).collect()
    assert sorted((x.n_turns, x.loss_chars) for x in got if x.conv_id is None) == [(1, 0), (1, 0), (1, 1)]
    assert {x[0]: tuple(x)[1:5] for x in got if x.conv_id is not None} == brute(rows[3:])


def test_no_record_is_lost(spark):
    """Further fields and other types don't change a layout; what has none gets a row with the reason."""
    records = {
        "extra": {"messages": [{"role": "user", "content": "hi", "name": "x"}, {"role": "assistant", "content": "yo"}], "id": 7},
        "number": {"messages": [{"role": "user", "content": 12}, {"role": "assistant", "content": True}]},
        "none": {"messages": []},
        "both": {"messages": [{"role": "user", "content": "hi"}], "prompt": "p", "response": "r"},
        "other": {"text": "x"},
    }
    df = spark.createDataFrame([(k, json.dumps(v), 1) for k, v in records.items()] + [("bad", "{", 1), ("null", None, 1)], "conv_id string, record string, record_ int")
    got = {x.conv_id: x for x in chat.canonical_turns(df).collect()}
    assert all(x.record_ == 1 for x in got.values())
    assert [tuple(t) for t in got["extra"].turns] == [("user", "hi"), ("assistant", "yo")]
    assert [tuple(t) for t in got["number"].turns] == [("user", "12"), ("assistant", "true")]
    assert got["none"].layout == "messages" and got["none"].turns == []
    done = {x.conv_id: x for x in chat.format_chats(df).collect()}
    assert len(done) == 7 and {k: x.problem for k, x in done.items() if x.problem} == {"both": chat.UNKNOWN, "other": chat.UNKNOWN, "bad": chat.NOT_JSON, "null": chat.NOT_JSON}
    assert all((x.formatted is None) == (x.problem is not None) for x in done.values())


def test_long_conversations_take_linear_time(spark):
    rows = spark.range(40_000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.repeat(F.lit("é<x"), 170).alias("text"))
    began = time.time()
    got = chat.digests(chat.format_rows(rows)).first()
    assert (got.n_turns, got.loss_chars) == (40_000, 20_000 * 510) and time.time() - began < 60


def test_round_trip(spark):
    r = random.Random(1)
    parts = ["\\", "<", "#", "### assistant\n", "</turn>\n", "é😀", "\n", "b", "l", "h", "\\b", " ", '"', "{", "\t", "\x01"]
    rows = [(-7, 0, "user", SAID), (-7, 1, "assistant", SAID), (1, 0, "assistant", None), (None, 0, "user", "n"), (2, None, None, ""), (2, None, None, "")]
    for k in range(10, 120):
        for t in range(r.randint(1, 6)):
            rows.append((k, t if r.random() < 0.9 else 0, r.choice(["user", "assistant", "system", "we\nird", "#x"]), "".join(r.choice(parts) for _ in range(r.randint(0, 12)))))
    df = spark.createDataFrame([(*x, "clash") for x in rows], "conv_id bigint, turn bigint, role string, text string, record string")
    got = {x[0]: tuple(x)[1:5] for x in chat.digests(chat.format_rows(df)).collect()}
    assert got == brute(rows)


def test_layouts(spark):
    u, a = "hi", "yo"
    records = {
        "messages": {"messages": [{"role": "user", "content": u}, {"role": "assistant", "content": a}]},
        "shares": {"conversations": [{"from": "human", "value": u}, {"value": a, "from": "gpt"}]},
        "prompt": {"response": a, "prompt": u},
        "instruction": {"instruction": None, "input": u, "output": a},
        "nested": {"reply": {"text": a}, "data": {"question": u, "context": None}},
    }
    df = spark.createDataFrame([(k, json.dumps(v), 1) for k, v in records.items()] + [("none", "[1]", 1), ("bad", "{", 1), ("null", None, 1)], "conv_id string, record string, formatted int")
    got = {x.conv_id: x for x in chat.canonical_turns(df).collect()}
    for k in records:
        assert got[k].layout == k
        assert [tuple(t) for t in got[k].turns] == [("user", u), ("assistant", a)]
    assert all(got[k].layout is None and got[k].turns is None for k in ("none", "bad", "null"))
    assert chat.format_chats(df).filter("problem IS NULL").count() == 5 and chat.format_chats(df).count() == 8


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert chat.digests(chat.format_rows(df)).count() == 0


def test_held_turns(spark, monkeypatch):
    """Turns that a record only holds the places of give what the record itself would, in every layout."""
    r = random.Random(2)
    rows = [(None, 0, "user", "n"), (1, 0, "user", None), (1, 1, "assistant", "<7>"), (2, 0, "system", "s"), (2, 1, "user", "1"), (2, 2, "assistant", "0"), (3, 0, None, "")]
    rows += [(k, t, r.choice(["user", "assistant", "system", "we\nird", "7"]), r.choice(["", "0", "#", "</turn>\n", "é😀"])) for k in range(10, 60) for t in range(r.randint(1, 15))]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    plain = chat.format_rows(df).collect()
    monkeypatch.setattr(chat, "INLINE", -1)
    records = chat.records_of(df)
    assert records.filter(F.col(chat.HELD).isNull()).count() == 0
    held = chat.format_rows(df)
    assert {x.layout for x in plain} == {"messages", "shares", "prompt", "instruction"}
    assert sorted(map(str, held.collect())) == sorted(map(str, plain))
    assert {x[0]: tuple(x)[1:5] for x in chat.digests(held).collect()} == brute(rows)


def test_beyond_the_parser(spark):
    """No conversation is lost to a text, a role or a sum of texts that JSON parsers don't take."""
    n = 20_000_100
    rows = spark.range(4).select(
        F.when(F.col("id") < 2, 1).otherwise(2).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 3, F.repeat(F.lit("r"), n)).when(F.col("id") == 1, "assistant").otherwise("user").alias("role"),
        F.when(F.col("id") == 1, F.repeat(F.lit("x"), n)).otherwise(F.lit("q")).alias("text"),
    )
    got = {x.conv_id: (x.n_turns, x.loss_chars) for x in chat.digests(chat.format_chats(chat.records_of(rows))).collect()}
    assert got == {1: (2, n), 2: (2, 0)}
    foreign = rows.filter("turn = 1").select("conv_id", F.to_json(F.struct(F.lit("q").alias("prompt"), F.col("text").alias("response"))).alias("record"))
    assert [(x.formatted, x.problem) for x in chat.format_chats(foreign).collect()] == [(None, chat.TOO_LARGE)]


def test_parts_and_strays(spark):
    """Content in parts is joined; single paths of other layouts don't hide the one that is complete."""
    records = {
        "parts": {"messages": [{"role": "user", "content": [{"type": "text", "text": "hel"}, {"type": "image", "url": "u"}, {"type": "text", "text": "lo"}, "!"]}, {"role": "assistant", "content": "yo"}]},
        "empty": {"messages": [{"role": "user", "content": []}]},
        "stray": {"messages": [{"role": "user", "content": "hi"}], "prompt": "p"},
        "two": {"messages": [{"role": "user", "content": "hi"}], "conversations": [{"from": "human", "value": "hi"}]},
    }
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in records.items()], "conv_id string, record string")
    got = {x.conv_id: x for x in chat.canonical_turns(df).collect()}
    assert [tuple(t) for t in got["parts"].turns] == [("user", "hello!"), ("assistant", "yo")]
    assert [tuple(t) for t in got["empty"].turns] == [("user", "")]
    assert [tuple(t) for t in got["stray"].turns] == [("user", "hi")] and got["stray"].layout == "messages"
    assert got["two"].layout is None and got["two"].problem == chat.UNKNOWN


def test_names_of_helper_columns(spark):
    """Columns of a foreign table that are named like the operator's own come out as they went in, or aren't read."""
    names = ["held_", "key_", "record_", "record__", "r", "t", "own_", "roles", "turn"]
    record = json.dumps({"prompt": "a", "response": "b"})
    df = spark.createDataFrame([(1, record, *names)], "conv_id bigint, record string, " + ", ".join(f"{n} string" for n in names))
    got = chat.canonical_turns(df).first()
    assert [got[n] for n in names] == names and len(got.turns) == 2
    assert chat.format_chats(df).first().problem is None
    for n in ("held_", "key_", "t", "record"):
        assert chat.format_chats(df.withColumn("x", F.col("record")).drop("record").withColumnRenamed("conv_id", n) if n == "record" else df.drop(n).withColumnRenamed("conv_id", n), n, "x" if n == "record" else "record").count() == 1
    rows = spark.createDataFrame([(1, 0, "user", "a", *names[:-1]), (1, 1, "assistant", "b", *names[:-1])], "conv_id bigint, turn bigint, role string, text string, " + ", ".join(f"{n} string" for n in names[:-1]))
    assert chat.digests(chat.format_rows(rows)).first().n_turns == 2
