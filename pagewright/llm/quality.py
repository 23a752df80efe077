"""Quality classifier: nearest-neighbour voting in a latent-semantic space.

Terms of a text are of two kinds. Subwords: the runs of GRAM bytes of the lower-cased text, hashed, which tell languages, subjects and wording
apart in any script. Shapes: characters are mapped to classes (lower and upper case, digits, spaces, line ends, and each
punctuation mark), runs of letters, digits or spaces count as one, and singles and pairs of classes are counted, together with two
figures of how often words repeat. Square roots of a term's share in its kind, weighted by inverse document frequency, are projected on
the leading singular vectors of a bounded sample of labelled rows. The sample's vectors are broadcast; every document's cosines with all of
them are computed exactly, in blocks, and its nearest neighbours vote with weights that grow with their similarity.
"""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import tidied

#: Labelled rows of each class that the model is fitted on at most: those with the smallest hashes of their keys.
PER_CLASS = 2000
#: Latent dimensions, voting neighbours, power of the cosine in a vote's weight, score from which a text is accepted.
LATENT, NEIGHBOURS, POWER, ACCEPT = 32, 15, 8, 0.7
#: Documents whose cosines are computed at once.
BLOCK = 256
#: Bytes of a subword, hashed subwords (a power of 2), weight of subwords beside shapes.
GRAM, SUBWORDS, MEANING = 6, 1024, 0.5


@lru_cache(maxsize=1)
def _classes() -> tuple[np.ndarray, np.ndarray, int]:
    """Class of each byte, whether runs of a byte's class count as one, number of classes. Bytes beyond ASCII count as lower-case letters."""
    def name(b):
        c = chr(b)
        if b >= 128 or "a" <= c <= "z":
            return "a"
        if "A" <= c <= "Z":
            return "A"
        if c.isdigit():
            return "0"
        return c if c == "\n" or 32 < b < 127 else " " if c in " \t\r\x0b\x0c" else "control"

    names: dict[str, int] = {}
    of = np.array([names.setdefault(name(b), len(names)) for b in range(256)])
    return of, np.array([name(b) in "aA0 " for b in range(256)]), len(names)


@lru_cache(maxsize=1)
def _folded() -> np.ndarray:
    """Each byte as it counts in subwords: A-Z lower-cased, white space a blank."""
    low = np.arange(256, dtype=np.uint64)
    low[65:91] += 32
    low[9:14] = 32
    return low + 1


def subwords(b: np.ndarray) -> np.ndarray:
    """Counts of a text's hashed runs of GRAM bytes; of a shorter text the whole is one."""
    low = _folded()[b]
    n = max(1, len(low) - GRAM + 1)
    h = np.zeros(n, np.uint64)
    for j in range(min(GRAM, len(low))):
        h = (h + low[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
    return np.bincount((h >> np.uint64(64 - SUBWORDS.bit_length() + 1)).astype(np.int64), minlength=SUBWORDS)


def terms(text: bytes) -> np.ndarray:
    """Term counts of a text in UTF-8, shapes before subwords; all 0 if it is empty."""
    of, runs, k = _classes()
    out = np.zeros(k * k + k + 11 + SUBWORDS, np.float32)
    if not text:
        return out
    b = np.frombuffer(text, np.uint8)
    out[-SUBWORDS:] = subwords(b)
    s = of[b]
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != s[:-1]) | ~runs[b[1:]]
    s = s[keep]
    out[: k * k] = np.bincount(s[:-1] * k + s[1:], minlength=k * k)
    out[k * k : k * k + k] = np.bincount(s, minlength=k)
    words = text.split()
    if len(words) > 1:
        again = sum(map(bytes.__eq__, words, words[1:])) / (len(words) - 1)
        known = 1 - len(set(words)) / len(words)
        out[k * k + k] = again * len(s)
        out[k * k + k + 1 + min(9, int(known * 10))] = 0.2 * len(s)
    return out


def _shares(counts: np.ndarray) -> np.ndarray:
    """Square roots of the terms' shares, those of each kind by themselves."""
    shapes, words = counts[:, :-SUBWORDS], counts[:, -SUBWORDS:]
    share = lambda c: np.sqrt(c / np.maximum(c.sum(axis=1, keepdims=True), 1e-9))
    return np.concatenate((share(shapes), np.float32(MEANING) * share(words)), axis=1)


def _axes(x: np.ndarray, n: int) -> np.ndarray:
    """The n leading right singular vectors of x, as columns: by subspace iteration from a fixed start, in time linear in x's size."""
    d = x.shape[1]
    q = np.random.default_rng(0).standard_normal((d, min(d, 2 * n))).astype(np.float32)
    for _ in range(8):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    return (q @ v.T)[:, :n].astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


class Voters(NamedTuple):
    """A fitted model: what it takes to project terms, the labelled vectors, their labels and weights, and the share of label 1."""

    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    weights: np.ndarray
    prior: float

    def latent(self, counts: np.ndarray) -> np.ndarray:
        return _unit(_unit(_shares(counts) * self.idf) @ self.axes)

    def score(self, counts: np.ndarray) -> np.ndarray:
        """Similarity-weighted share of label 1 among the nearest labelled vectors; the prior where none is similar at all."""
        if not len(self.vectors):
            return np.full(len(counts), self.prior)
        near = self.latent(counts) @ self.vectors.T
        n = min(NEIGHBOURS, near.shape[1])
        at = np.argpartition(-near, n - 1, axis=1)[:, :n]
        w = np.maximum(np.take_along_axis(near, at, axis=1), 0).astype(np.float64) ** POWER * self.weights[at]
        total = w.sum(axis=1)
        return np.where(total > 0, (w * self.labels[at]).sum(axis=1) / np.maximum(total, 1e-300), self.prior)


def fit(counts: np.ndarray, labels: np.ndarray, share: dict[int, float]) -> Voters:
    """Voters from the sample's term counts and labels; `share` is each class's share among all labelled rows."""
    d = counts.shape[1]
    prior = share.get(1, 0.0) if share else 0.5
    if not len(counts):
        return Voters(np.ones(d, np.float32), np.zeros((d, 0), np.float32), np.zeros((0, 0), np.float32), labels, labels, prior)
    seen = (counts > 0).sum(axis=0)
    idf = np.where(seen > 1, np.log((1 + len(counts)) / (1 + seen)) + 0.3, 0).astype(np.float32)
    axes = _axes(_unit(_shares(counts) * idf), LATENT)
    size = {c: max(1, int((labels == c).sum())) for c in (0, 1)}
    weights = np.array([share.get(int(c), 0) / size[int(c)] for c in labels])
    model = Voters(idf, axes, np.zeros((0, 0), np.float32), labels.astype(float), weights / max(weights.max(), 1e-300), prior)
    return model._replace(vectors=model.latent(counts))


def _with_terms(df: DataFrame, text: str) -> DataFrame:
    """`df` (key_, label, and the text) with the terms in place of the text."""
    def run(batches):
        for b in batches:
            rows = [terms(v.as_buffer().to_pybytes() if v.is_valid else b"").tobytes() for v in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(rows, pa.binary())], ["label", "terms"])

    return df.select("key_", "label", F.col(text).cast("string").cast("binary")).mapInArrow(tidied(run), "label int, terms binary")


def held_out(key: str) -> Column:
    """Whether a row is held out: crc32 of the key as text is 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> Voters:
    """A model from the labelled rows that aren't held out.

    PER_CLASS rows of each class, those with the smallest hashes of their keys, are the sample; their classes vote by the shares
    of all labelled rows. Labels other than 0 and 1 and null keys are ignored; of a repeated key the row
    whose text has the least hash is taken, so that the same tables give the same model.
    """
    known = labels.filter(~held_out(key) & F.col(label).isin(0, 1)).select(F.col(key).alias("key_"), F.col(label).cast("int").alias("label"))
    known = known.groupBy("key_").agg(F.max("label").alias("label"))
    n = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    order = [F.xxhash64("key_"), F.col("key_")]
    pick = [known.filter(F.col("label") == c).orderBy(*order).limit(PER_CLASS) for c in (0, 1)]
    sample = pick[0].union(pick[1])
    rows = documents.select(F.col(key).alias("k_"), F.col(text).alias("t_")).join(F.broadcast(sample), F.col("k_") == F.col("key_"))  # 2 * PER_CLASS keys at most
    text_ = F.coalesce(F.col("t_").cast("string"), F.lit(""))
    rows = rows.groupBy("key_", "label").agg(F.min(F.struct(F.sha2(text_.cast("binary"), 256).alias("h"), text_.alias("t"))).alias("x")).select("key_", "label", F.col("x.t").alias("t_"))
    got = _with_terms(rows, "t_").collect()
    d = len(terms(b""))
    counts = np.frombuffer(b"".join(r[1] for r in got), np.float32).reshape(-1, d)
    y = np.array([r[0] for r in got], dtype=int)
    order = sorted(range(len(got)), key=lambda i: (y[i], got[i][1]))  # so that the model doesn't depend on the order of arrival
    return fit(counts[order], y[order], {c: v / sum(n.values()) for c, v in n.items()})


def classify(df: DataFrame, model: Voters, text: str = "text", score: str = "score") -> DataFrame:
    """`df` with the column `score`, 0 to 1. Narrow: no shuffle, no other column is changed; `score` replaces a column of that name.

    A null text counts as empty. An empty text has no terms and no neighbour, so that its score is the share of label 1; without
    any labelled rows all scores are 0.5.
    """
    kept = df.drop(score)
    shared = df.sparkSession.sparkContext.broadcast(model)
    place = kept.columns.index(text)
    as_bytes = kept.withColumn(text, F.col(text).cast("string"))
    schema = as_bytes.withColumn(score, F.lit(0.0)).schema

    def run(batches):
        m = shared.value
        for b in batches:
            out = []
            rows = b.column(place)
            for i in range(0, len(rows), BLOCK):
                out.append(m.score(np.stack([terms(v.as_buffer().to_pybytes() if v.is_valid else b"") for v in rows[i : i + BLOCK]])))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(out) if out else [], pa.float64())], [*b.schema.names, score])

    return as_bytes.mapInArrow(tidied(run), schema)
