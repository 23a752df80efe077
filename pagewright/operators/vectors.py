"""Exact nearest vectors for a set of query vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Query vectors that are sent to all tasks at most; more are handled in several passes.
QUERIES = 2_000


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """qid, rank, key, score: the k vectors of highest cosine for each query (qid, column), ties by key.

    Each task keeps the k best of its rows for each query, so what is shuffled is k rows per query and task. Queries are a stated set;
    they are sent in blocks of QUERIES. A null or zero vector has cosine 0.
    """
    rows = queries.select("qid", column).collect()
    out = None
    for i in range(0, len(rows), QUERIES):
        ids = [r[0] for r in rows[i : i + QUERIES]]
        q = np.array([r[1] for r in rows[i : i + QUERIES]], np.float64)
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
        part = vectors.select(key, column).mapInArrow(_best(ids, q, k, key), f"qid bigint, {key} bigint, score double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return vectors.select(F.col(key).alias("qid"), F.lit(0).alias("rank"), key, F.lit(0.0).alias("score")).limit(0)
    r = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), key))
    return out.withColumn("rank", r).filter(F.col("rank") <= k).select("qid", "rank", key, "score")


def _best(ids, q, k, key):
    def run(batches):
        kept = [(np.empty(0, np.int64), np.empty(0)) for _ in ids]
        for b in batches:
            own = b.column(0).to_numpy(zero_copy_only=False)
            x = np.array([v if v is not None else [0.0] * q.shape[1] for v in b.column(1).to_pylist()], np.float64).reshape(-1, q.shape[1])
            cos = q @ (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)).T
            for j, (n, s) in enumerate(kept):
                n, s = np.concatenate((n, own)), np.concatenate((s, cos[j]))
                order = np.lexsort((n, -np.round(s, 9)))[:k]
                kept[j] = n[order], s[order]
        for i, (n, s) in zip(ids, kept, strict=True):
            yield pa.RecordBatch.from_arrays([pa.array([i] * len(n), pa.int64()), pa.array(n, pa.int64()), pa.array(s, pa.float64())], ["qid", key, "score"])

    return run
