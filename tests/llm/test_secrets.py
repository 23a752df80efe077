import hashlib
import math
import random
import re
import time
from collections import Counter

from pyspark.sql import functions as F

from pagewright.llm import secrets as S


def entropy(s, w=S.WINDOW):
    return max(math.log2(w) - sum(c * math.log2(c) for c in Counter(s[i : i + w]).values()) / w for i in range(len(s) - w + 1))


def brute(text):
    t = text or ""
    spans = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    base = ",".join(f"{S.KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))
    for m in re.finditer(S.CANDIDATE, t):
        c = m[0]
        if re.search("[0-9]", c) and re.search("[A-Za-z]", c) and not any(re.fullmatch(a, c) for a in S.ALLOW):
            bar = next(b for p, b in S.CLASSES if re.fullmatch(p, c))
            if entropy(c) >= bar:
                spans.append((m.start(), 3, m.end()))
    n = Counter(k for _, k, _ in spans)
    return n[0], n[1], n[2], hashlib.sha256(base.encode()).hexdigest(), ",".join(f"{S.KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def test_against_brute_force(spark):
    r = random.Random(5)
    parts = ["token", "=", " ", ":", '"', "password", "passwd=", "AKIA", "ABCDEFGH12345678", "deadbeef0123456789abcdef", "é", "😀", "\n", "x", "Secret", "api_key",
             "APIKEY", "0f" * 20, "Zx9+/aQ", "a-b_c", "123e4567-e89b-12d3-a456-426614174000", "2024-01-02T10-20-30-40-50-60", "."]
    texts = [None, "", "token=abcde", "token=abcdef", "token='abc", "AKIA" + "A" * 15, "AKIA" + "A" * 16, "a" * 24, "x" * 3000 + "token: k9j8h7g6" + "y" * 3000]
    texts += ["".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(600)]
    texts += ["".join(r.choice("abcdef0123456789ABCxyz+/") for _ in range(r.randint(20, 60))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("spans", F.lit("clash"))
    got = {x.doc_id: tuple(x)[1:] for x in S.scan_secrets(df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i] == brute(t), t


def test_entropy_against_brute_force(spark):
    """Slices of a long string overlap so that no window is lost, and the bar is met exactly."""
    r = random.Random(7)
    texts = ["".join(r.choice(a) for _ in range(n)) for a in ("ab1", "abcdefgh0", "Zx9+/_=-", "0123456789abcdefghijk") for n in (20, 21, 40, 400)]
    texts += ["a1" * 3000 + "Qw3rTyUiOpAsDfGhJkL9" + "b2" * n for n in range(S.STEPS // 2 - 3020, S.STEPS // 2 - 2980)]
    df = spark.createDataFrame([(i, t, bar) for i, t in enumerate(texts) for bar in (entropy(t) - 1e-9, entropy(t) + 1e-9)], "i int, t string, bar double")
    assert all(x[1] == (x[0] <= entropy(texts[x[2]])) for x in df.select("bar", S.reaches(F.col("t"), F.col("bar")), "i").collect())


def test_time_grows_with_length(spark):
    """A candidate and a run of matches of 1 MB each take seconds, not hours."""
    r = random.Random(8)
    texts = ["x", "".join(r.choice("ab1") for _ in range(1_000_000)), "".join(r.choice("abcdefghijklmnop1") for _ in range(1_000_000)), "token=abcdef " * 80_000]
    took = []
    for i, t in enumerate(texts):
        df = spark.createDataFrame([(i, t)], "doc_id bigint, text string")
        q = S.scan_secrets(df)
        began = time.time()
        row = q.first()
        took.append(time.time() - began)
        assert row.n_assign == (80_000 if i == 3 else 0)
    assert max(took[1:]) < took[0] + 6


def test_edges(spark):
    df = spark.createDataFrame([(None, "token=abcdefg"), (1, "a"), (1, "a")], "doc_id bigint, text string")
    got = sorted(map(tuple, S.scan_secrets(df).collect()), key=str)
    assert len(got) == 3 and got[2][1] == 1
    assert S.scan_secrets(df.limit(0)).count() == 0
