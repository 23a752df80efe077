import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from pagewright.llm.bpe import codec, encode_bpe

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(text):
    return [i for _, p in codec(PATH, P.PATTERN).encode(text) for i in memoryview(p).cast("I")]


def test_random_texts(reference):
    r = random.Random(3)
    parts = ["a", "b", " ", "  ", "th", "e", "é", "1", "\n", "'s", "ing", "日", "😀", "\t", "_", "==", "\x85", "　"]
    for _ in range(3000):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 50)))
        assert ids(t) == reference.encode_ordinary(t)


@pytest.mark.parametrize("text", ["a" * 4000, " " * 4000, "ab" * 2000, "=-" * 2000, "\n" * 999, "<|endoftext|>", "x y" * 500_000])
def test_long_runs(reference, text):
    assert ids(text) == reference.encode_ordinary(text)


def test_long_pieces_are_not_remembered(reference):
    """A memo's size in bytes is bounded: long pieces, which hardly ever return, aren't kept."""
    c = codec(PATH, P.PATTERN)
    for t in ("日本語" * 2000, "Zx9" * 5000, "short"):
        assert ids(t) == reference.encode_ordinary(t)
    assert max(map(len, [*c.memo, *c.memo.old]), default=0) <= 32


def test_rows(spark, sf_dir, reference):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = {r.doc_id: reference.encode_ordinary(r.text or "") for r in df.collect()}
    got = encode_bpe(df, path=PATH, pattern=P.PATTERN).collect()
    assert len(got) == df.count()
    for r in got:
        assert r.n_tokens == len(want[r.doc_id])
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, want[r.doc_id])).encode()).hexdigest()


def test_edges(spark):
    schema = "n_tokens bigint, text string, ids string"
    rows = [(1, None, "x"), (2, "", "x"), (3, "hi", "x"), (3, "hi", "x"), (None, "é", None)]
    got = sorted(encode_bpe(spark.createDataFrame(rows, schema).withColumnRenamed("n_tokens", "doc_id"), path=PATH, pattern=P.PATTERN).collect(), key=str)
    assert [r.n_tokens for r in got if r.doc_id in (1, 2)] == [0, 0]
    assert len(got) == 5
    assert all(r.decoded_sha256 == hashlib.sha256(b"hi").hexdigest() for r in got if r.doc_id == 3)
    assert encode_bpe(spark.createDataFrame([], "doc_id bigint, text string"), path=PATH, pattern=P.PATTERN).count() == 0
    clash = encode_bpe(spark.createDataFrame(rows, schema), key="n_tokens", path=PATH, pattern=P.PATTERN, with_ids=True)
    assert clash.count() == 5
