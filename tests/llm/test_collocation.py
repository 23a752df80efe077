import random
import re
from collections import Counter

import numpy as np
import pytest

from pagewright.llm.collocation import BYTES, collocations, count_shard, frequent_phrases, intervals, word_ids


def counted(rows, words):
    """Counts of all phrases by language, word by word."""
    out = Counter()
    for text, lang in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            ws = [w for w in re.split("[ \t]", piece) if w]
            out.update((lang or "und", " ".join(ws[i : i + n])) if lang is not None or lang else ("und", " ".join(ws[i : i + n])) for n in range(1, words + 1) for i in range(len(ws) - n + 1))
            if ws:
                out["und" if lang is None else lang, ""] += len(ws)
    return out


def brute(rows, words, least, covered, top):
    f = counted(rows, words)
    kept = {}
    for (lang, phrase), a in f.items():
        ws = phrase.split(" ")
        if len(ws) < 2 or a < least:
            continue
        cuts = [(1_000_000 * a * a // (f[lang, " ".join(ws[:k])] * f[lang, " ".join(ws[k:])]), k) for k in range(1, len(ws))]
        score, k = min(cuts)
        kept[lang, phrase] = (score, a, f[lang, " ".join(ws[:k])], f[lang, " ".join(ws[k:])])
    out = []
    for lang in {x for x, _ in kept}:
        own = [(-s, -a, p.encode(), l, r) for (g, p), (s, a, l, r) in kept.items() if g == lang and not any(g2 == lang and len(q) > len(p) and f" {p} " in f" {q} " and 100 * v[1] >= covered * a for (g2, q), v in kept.items())]
        for rank, (s, a, p, l, r) in enumerate(sorted(own)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, f[lang, ""], -s))
    return sorted(out)


def texts(seed, n, vocabulary, most=40):
    r = random.Random(seed)
    return [("".join(r.choice(vocabulary) + r.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r"]) for _ in range(r.randint(0, most))), r.choice(["en", "fr", None])) for _ in range(n)]


@pytest.mark.parametrize("words", [2, 3, 4, 5])
def test_whole_result(spark, words):
    rows = texts(words, 150, ["a", "b", "A", "é", "ß", "É", "\x85", "日本", "x-y", "\x00"])
    df = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    for bits, shard in ((1 << 16, 1 << 20), (64, 200)):  # a crowded bitmap and many shards change nothing
        got = collocations(df, words=words, least=3, top=30, bits=bits, shard=shard).collect()
        assert sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in got) == brute(rows, words, 3, 50, 30)


def test_counts_of_all_phrases(spark):
    rows = texts(9, 60, ["u", "v", "w"])
    got = {(r.lang_, r.phrase): r.a for r in frequent_phrases(spark.createDataFrame(rows, "text string, lang string"), words=4, least=1, bits=1 << 12).collect()}
    assert got == dict(counted(rows, 4))


def test_intervals_of_a_shard():
    r = np.random.default_rng(3)
    for depth in (1, 2, 3, 5, 7):
        ids = r.integers(0, 4, 400)
        want = {n: Counter(tuple(ids[i : i + n]) for i in range(len(ids) - n + 1) if (ids[i : i + n] > 0).all()) for n in range(1, depth + 1)}
        for n, at, count in intervals(ids, depth, np.flatnonzero(ids)):
            assert {tuple(ids[i : i + n]): c for i, c in zip(at, count, strict=True)} == want[n]


def test_word_ids():
    ids, words = word_ids(b"A b\tB.\n c".translate(BYTES))
    assert [words[i].as_py() for i in ids if i] == [b"a", b"b", b"b", b"c"]
    assert (ids == 0).tolist() == [False, False, False, True, True, False]
    assert [x for p, n in count_shard("en", b"", 2, None) for x in zip(p.to_pylist(), n, strict=True)] == [("", 0)]


def test_edges(spark):
    schema = "text string, lang string, phrase string, a int, k int, lang_ int, t_ int"
    rows = [("x y " * 50_000, "en", "p", 1, 2, 3, 4), (None, None, None, 1, 2, 3, 4), ("", "en", None, 1, 2, 3, 4), ("x y z. " * 10, "", None, 1, 2, 3, 4), ("ab " * 9, "de", None, 1, 2, 3, 4)]
    df = spark.createDataFrame(rows, schema)
    got = {(r.lang, r.phrase): (r.a, r.l, r.r, r.n) for r in collocations(df).collect()}
    assert got == {("", "x y z"): (10, 10, 10, 30), ("en", "x y x"): (49_999, 50_000, 50_000, 100_000), ("en", "y x y"): (49_999, 50_000, 50_000, 100_000)}
    assert collocations(df.filter("false")).count() == 0


def test_large_counts_are_exact(spark):
    """Products beyond 64 bits."""
    a = 3_000_000_017
    exact = spark.range(1).selectExpr(f"cast(cast(cast({a} as decimal(19,0)) * cast({a} as decimal(19,0)) * 1000000BD as decimal(38,0)) div cast(cast({a + 7} as decimal(19,0)) * cast({a + 9} as decimal(19,0)) as decimal(38,0)) as bigint) as s").first().s
    assert exact == 1_000_000 * a * a // ((a + 7) * (a + 9))
