import random
import re
from collections import defaultdict

import numpy as np
import pytest

from pagewright.llm import neardup as N


def words(text):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", t)


def shingle_set(text):
    w = words(text)
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    by_key = defaultdict(list)
    for i, (k, _) in enumerate(rows):
        if k is not None:
            by_key[k].append(i)
    for same in by_key.values():
        for i in same[1:]:
            up[find(i)] = find(same[0])
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                up[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        r = find(i)
        old = least.get(r)
        least[r] = k if old is None else old if k is None else min(old, k)
    return sorted(((k, len(sets[i]), least[find(i)], k == least[find(i)]) for i, (k, _) in enumerate(rows)), key=str)


def check(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, component_id string")
    got = sorted((tuple(r) for r in N.near_duplicates(df).collect()), key=str)
    assert got == brute(rows)


def test_shingles_match_sets():
    r = random.Random(1)
    seen = {}
    for _ in range(400):
        t = "".join(r.choice(["a", "B", "b", "é", " ", "\n", "\x0b", "\x1c", "\x85", "word", "x y"]) for _ in range(r.randint(0, 40)))
        s = N.shingles(t.encode())
        assert len(s) == len(shingle_set(t)), t
        key = frozenset(shingle_set(t))
        assert seen.setdefault(key, tuple(s)) == tuple(s)
    assert len(set(seen.values())) == len(seen)


def test_sketch_estimates_and_merge():
    g = np.random.default_rng(2)
    for j in (0.5, 0.75, 0.9):
        n = 2000
        common = int(2 * n * j / (1 + j))
        x = g.integers(0, 2**63, 2 * n).astype(np.uint64)
        a, b = x[:n], np.concatenate((x[:common], x[n : 2 * n - common]))
        s = N.sketches([a, b, np.concatenate((a, b))])
        assert (np.maximum(s[0], s[1]) == s[2]).all()
        same = (s[0] == s[1]).mean()
        assert j - 0.1 < same < j + 0.15
        ok = N.estimate(s[:1], s[1:2], np.array([n]), np.array([n]))[0]
        assert ok == (j >= 0.7)


def test_groups(spark):
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows, k = [], 0
    for n in (1, 3, 4, 5, 6, 9, 30, 60, 120, 300):
        for _ in range(4):
            base = [r.choice(vocabulary) for _ in range(n)]
            for edits in (0, 0, 1, 1, 2, 3, 5, 8):
                w = list(base)
                for _ in range(min(edits, n)):
                    w[r.randrange(n)] = r.choice(vocabulary)
                k += 1
                rows.append((k * 7 % 1009, (" " if k % 3 else "\n").join(w).upper() if k % 5 == 0 else " ".join(w)))
    passage = " ".join(r.choice(vocabulary) for _ in range(60))
    rows += [(5000 + i, passage + " " + " ".join(r.choice(vocabulary) for _ in range(20 + i % 30))) for i in range(60)]
    rows += [(None, None), (6000, ""), (6001, " \n"), (6002, None), (6003, "one"), (6004, "One"), (6004, "other words"), (6005, "other words"), (None, "one")]
    check(spark, rows)


def test_small_blocks_chunks_and_shares(spark, monkeypatch):
    """Buckets in several parts, by members and by bytes, stars in several shares, and shuffles instead of broadcasts lose no link."""
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for g in range(6):  # a family of texts that share a template and are near the threshold of each other, and some that are nearer
        template = [r.choice(vocabulary) for _ in range(100)]
        for i in range(30):
            w = list(template)
            for at in r.sample(range(100), r.choice([1, 2, 3, 4])):
                w[at] = r.choice(vocabulary)
            rows.append((g * 100 + i, " ".join(w)))
    hot = [r.choice(vocabulary) for _ in range(90)]
    rows += [(1000 + i, " ".join([*hot, f"x{i}", f"y{i}"])) for i in range(60)]
    for name, value in {"BLOCK": 4, "BLOCK_BYTES": 3000, "CHUNK": 10, "CHUNK_BYTES": 5000, "STAR": 3, "FEW": 0, "STAR_BANDS": 2, "EDGES": 5}.items():
        monkeypatch.setattr(N, name, value)
    check(spark, rows)


def test_components_of_the_tables_are_exact(spark):
    """All documents of sf0.1 against an exact join: texts that reach the threshold share one of the rarest shingles of each."""
    rows = [(x.doc_id, x.text) for x in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").collect()]
    sets = {k: N.shingles((t or "").encode()) for k, t in rows}
    values, counts = np.unique(np.concatenate(list(sets.values())), return_counts=True)
    up = {k: k for k in sets}

    def find(k):
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    index, prints = defaultdict(list), {}
    for k, s in sets.items():
        if (same := prints.setdefault(s.tobytes(), k)) != k and len(s):
            up[max(find(k), find(same))] = min(find(k), find(same))
            continue
        rarest = s[np.lexsort((s, counts[np.searchsorted(values, s)]))]
        seen = set()
        for h in rarest[: len(s) - -(-3 * len(s) // 4) + 1].tolist():
            for j in index[h]:
                if j not in seen and find(j) != find(k):
                    seen.add(j)
                    both = len(np.intersect1d(s, sets[j], assume_unique=True))
                    if 100 * both >= 75 * (len(s) + len(sets[j]) - both):
                        up[max(find(j), find(k))] = min(find(j), find(k))
            index[h].append(k)
    got = {x.doc_id: x.component_id for x in N.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {k: find(k) for k in sets}


def test_chain_and_cross_component_links(spark):
    """A chain of texts, each near its neighbours only, is one component."""
    w = [f"v{i}" for i in range(400)]
    check(spark, [(i, " ".join(w[i * 6 : i * 6 + 120])) for i in range(40)])


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(60)] + [(7, 7)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    got = {x.id: x.component for x in N.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "a b c d e f")]])
def test_small(spark, rows):
    check(spark, rows)
