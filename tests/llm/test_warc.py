import hashlib
import random

import pytest

from pagewright.llm import warc as W


def brute(rows):
    first = {}
    for i, _, t in sorted(rows):
        first.setdefault(t or "", i)
    out = {}
    for i, _, t in rows:
        b = (t or "").encode()
        again = len(b) >= W.LEAST and first[t or ""] != i
        out[i] = (len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[t or ""] if again else None)
    return out


def test_round_trip(spark, tmp_path):
    r = random.Random(2)
    parts = ["\r\n\r\n", "WARC/1.1\r\n", "0\r\n\r\n", "é😀", "abc", "\n", "<p>", "\x00"]
    texts = [None, "", "x", "y" * 99, "y" * 100, "z" * W.SEGMENT, "q" * 200_000, "".join(r.choice(parts) for _ in range(30_000))]
    texts += ["".join(r.choice(parts) for _ in range(r.randint(0, 60))) for _ in range(100)] + ["y" * 99, "y" * 100, "y" * 100, "q" * 200_000, ""]
    rows = [(3 * i + 1, "http://a/\r\nX: y" if i else None, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(*x, 1) for x in rows], "page_id bigint, url string, html string, payload int").repartition(3)
    path = str(tmp_path / "a")
    got = {x[0]: tuple(x)[1:] for x in W.round_trip(df, path).collect()}
    assert got == brute(rows)
    payloads = {int(x.name): x.payload for x in W.read_warc(spark, path).collect() if x.record_type == "response"}
    assert all(bytes(payloads[i]).decode() == (t or "") for i, _, t in rows if i in payloads)


def test_bad_archives(spark, tmp_path):
    recs = W.records("1", "u", b"a" * 50_000, hashlib.sha256(b"a" * 50_000).hexdigest(), None)
    assert len(recs) == 4
    for name, data in {"gap": [recs[0], recs[1], recs[3]], "cut": [recs[0][:-1], *recs[1:]], "digest": [W.records("1", "u", b"b", "0" * 64, None)[0]]}.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.warc").write_bytes(b"".join(x + b"\r\n\r\n" for x in data))
        with pytest.raises(Exception):
            W.read_warc(spark, str(tmp_path / name)).collect()
    with pytest.raises(ValueError):
        W.unframe(b"5\r\nabc\r\n0\r\n\r\n")


def test_null_and_repeated_keys(spark, tmp_path):
    long = "z" * 150
    rows = [(None, "u", long), (4, "u", long), (4, "u", long), (2, None, long), (None, None, None), (7, "u", "s"), (7, "u", "other")]
    got = sorted((tuple(x)[0], x.payload_bytes, x.record_type, x.refers_to) for x in W.round_trip(spark.createDataFrame(rows, "page_id bigint, url string, html string"), str(tmp_path / "n")).collect() if x.page_id)
    assert got == [(2, 150, "response", None), (4, 150, "revisit", 2), (4, 150, "revisit", 2), (7, 1, "response", None), (7, 5, "response", None)]
    nulls = [x for x in W.round_trip(spark.createDataFrame(rows, "page_id bigint, url string, html string"), str(tmp_path / "m")).collect() if x.page_id is None]
    assert sorted((x.payload_bytes, x.record_type, x.refers_to) for x in nulls) == [(0, "response", None), (150, "revisit", 2)]
    odd = spark.createDataFrame([("a:b>\n", "u", "x")], "page_id string, url string, html string")
    assert W.round_trip(odd, str(tmp_path / "o")).first().page_id == "a:b>\n"


@pytest.mark.parametrize("few", [W.FEW, 0])
def test_references_name_records(spark, tmp_path, monkeypatch, few):
    """Names are unique, and each WARC-Refers-To names the response in the archive that has the same digest."""
    monkeypatch.setattr(W, "FEW", few)
    texts = [None, "", "y" * 99, *(c * n for c in "abc" for n in (100, 40_000))] * 4
    rows = [(i if i % 5 else None, "u", t) for i, t in enumerate(texts)] + [(3, "u", "a" * 100)] * 3 + [(None, "u", "only here" * 20), (900, "u", "twice" * 30), (900, "u", "twice" * 30)]
    path = tmp_path / "r"
    W.write_warc(W.captures(spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(3)), str(path))
    heads = [h for f in path.glob("part-*") for h, _ in W.parse_records(W.plain(f.read_bytes()))]
    names = {h["warc-record-id"]: h for h in heads}
    assert len(names) == len(heads)
    revisits = [h for h in heads if h["warc-type"] == "revisit"]
    assert len(revisits) == 6 * 3
    for h in revisits:
        response = names[h["warc-refers-to"]]
        assert response["warc-type"] == "response" and response["warc-payload-digest"] == h["warc-payload-digest"]
    assert all(h["warc-segment-origin-id"] in names for h in heads if h["warc-type"] == "continuation")


def test_empty(spark, tmp_path):
    assert W.round_trip(spark.createDataFrame([], "page_id bigint, url string, html string"), str(tmp_path / "e")).count() == 0
