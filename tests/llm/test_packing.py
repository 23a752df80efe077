import random
import zlib
from array import array
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from pagewright.llm import packing
from pagewright.llm.packing import CAPACITY, pack_documents, plan, words_of

PATH = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(PATH)


def ids(text):
    return array("I", words_of(PATH).packed(text)).tolist()


def test_ids_are_the_tokenizers(reference):
    r = random.Random(5)
    parts = ["a", "B", " ", "  ", "'s", "'S", "Straße", "É", "é", "H̱", "ẖ", "İ", "Σ", "ΑΣ", "1", "²", "½", "\xa0", "\x1c", "\x85", "\n", "日本", "😀", "--", "’", "œ", "ŉ", "ſ", "<|endoftext|>", "<|", " ", "　", "µ", "ª", "×", "\x00", "­"]
    for _ in range(4000):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 12)))
        assert ids(t) == reference.encode(t, add_special_tokens=False).ids, repr(t)


@pytest.mark.parametrize("text", ["a" * 100_000, "é" * 30_000, "-" * 50_000, "x y " * 100_000, "日" * 20_000, " " * 100_000])
def test_long_texts(reference, text):
    assert ids(text) == reference.encode(text, add_special_tokens=False).ids


def expand(histogram, capacity):
    """Sequences as lists of (offset, length), from the runs; each piece once."""
    runs, n = plan(histogram, capacity)
    out = defaultdict(list)
    for length in histogram:
        own = runs[runs[:, 0] == length]
        for number in range(histogram[length]):
            _, first, sequence, each, offset = own[np.searchsorted(own[:, 1], number, side="right") - 1]
            out[int(sequence + (number - first) // each)].append((int(offset + (number - first) % each * length), length))
    assert len(out) == n
    return out


def check(out, histogram, capacity):
    assert Counter(length for s in out.values() for _, length in s) == Counter(histogram)
    for s in out.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= capacity


def best_fit(histogram, capacity):
    rooms = []
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            fit = [i for i, x in enumerate(rooms) if x >= length]
            if fit:
                rooms[min(fit, key=lambda i: rooms[i])] -= length
            else:
                rooms.append(capacity - length)
    return len(rooms)


def test_plans_are_gapless_and_no_worse_than_best_fit():
    r = random.Random(7)
    for trial in range(40):
        capacity = r.choice([10, 64, 300])
        histogram = Counter(min(capacity, int(r.expovariate(1 / r.choice([3, 30, 120])) + 1)) for _ in range(r.randint(1, 600)))
        out = expand(histogram, capacity)
        check(out, histogram, capacity)
        least = -(-sum(k * v for k, v in histogram.items()) // capacity)
        assert least <= len(out) <= best_fit(histogram, capacity) + max(packing.GROUPS) // 4 + 1, trial


@pytest.mark.parametrize("histogram", [{}, {4096: 3}, {1: 10_000}, {2048: 7}, {2049: 5, 2047: 5}, {1366: 10, 1365: 20}, {3000: 50, 1000: 40, 96: 30, 1: 7}])
def test_special_histograms(histogram):
    out = expand(histogram, CAPACITY)
    check(out, histogram, CAPACITY)
    assert len(out) == {0: 0, 3: 3, 10_000: 3, 7: 4, 10: 5, 30: 10, 127: 50}[sum(histogram.values())]


def test_configurations_reach_the_optimum():
    """Three sizes for which packing the largest first wastes: the linear programme mixes them."""
    histogram = {44: 300, 24: 300, 32: 300}
    out = expand(histogram, 100)
    check(out, histogram, 100)
    assert len(out) == 300
    assert best_fit(histogram, 100) >= 300


def test_rows(spark, sf_dir, reference):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = {r.doc_id: reference.encode(r.text or "", add_special_tokens=False).ids + [1] for r in df.collect()}
    got = pack_documents(df, path=PATH).collect()
    assert Counter(r.doc_id for r in got) == {k: -(-len(v) // CAPACITY) for k, v in want.items()}
    for r in got:
        own = want[r.doc_id][r.start : r.start + CAPACITY]
        assert (r.start, r.length) == (r.piece * CAPACITY, len(own))
        assert r.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes())
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    check(sequences, Counter(r.length for r in got), CAPACITY)
    assert len(sequences) <= -(-sum(r.length for r in got) // CAPACITY) + 1


def test_edges(spark):
    schema = "length bigint, text string, task_ string, k_ int, t_ int, n_ int"
    rows = [(1, None, "x", 1, 2, 3), (2, "", "x", 1, 2, 3), (3, "hi", "x", 1, 2, 3), (3, "hi", "x", 1, 2, 3), (None, "é " * 5000, None, 1, 2, 3)]
    df = spark.createDataFrame(rows, schema)
    got = pack_documents(df.withColumnRenamed("length", "doc_id"), path=PATH).collect()
    assert sorted((str(r.doc_id), r.piece, r.length) for r in got) == [("1", 0, 1), ("2", 0, 1), ("3", 0, 2), ("3", 0, 2), ("None", 0, 4096), ("None", 1, 905)]
    assert len({(r.sequence_id, r.offset) for r in got}) == 6
    assert pack_documents(df.filter("false").withColumnRenamed("length", "doc_id"), path=PATH).count() == 0
    assert pack_documents(df, key="length", path=PATH).count() == 6
    assert pack_documents(df, key="k_", path=PATH).count() == 6
