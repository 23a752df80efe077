"""A training corpus from `documents`: what is good, once, in a mixture of its sources, as tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs. All but the
last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import bpe, dedup, mixing, neardup, quality
from pagewright.llm.common import checkpointed, limit_batches, table
from pagewright.llm.queries import rank_file

#: So many dropped ids are broadcast at most; more meet the documents in a shuffle.
FEW = 200_000


def _by_row(docs: DataFrame) -> DataFrame:
    """doc (all columns of `docs`, so that none of their names meets one of ours), text, and row: what tells a row from others, in the order in which copies stay: doc_id, nulls last, and the text."""
    text = F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    return docs.select(F.struct("*").alias("doc"), "text", F.struct(F.col("doc_id").isNull().alias("null"), F.col("doc_id").alias("id"), text.alias("text")).alias("row"))


def _without_dropped(docs: DataFrame, decide) -> DataFrame:
    """The rows of `docs` that `decide`, a function of a table and its key, keeps, each once.

    It decides by row, not by doc_id: rows with the same doc_id and different texts are different documents. Rows with the same doc_id
    and text (or with the same text and no doc_id) are one row that came several times: one of them stays, if any, the first by its other columns.
    """
    rows = _by_row(docs)
    told = decide(rows.select("row", "text"), key="row").groupBy("row").agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    told = checkpointed(told.filter("NOT kept OR n > 1").select("row", F.when(F.col("kept"), "repeated").otherwise("dropped").alias("told")))
    kept = rows.select("doc", "row").join(F.broadcast(told) if told.count() <= FEW else told, "row", "left")
    once = kept.filter("told IS NULL").select("doc.*")
    if told.filter("told = 'repeated'").isEmpty():
        return once
    first = kept.filter("told = 'repeated'").groupBy("row").agg(F.min("doc").alias("doc")).select("doc.*")
    return once.unionByName(first)


def accept(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. Without labels nothing is known, and all are kept."""
    limit_batches(spark)
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    if not len(model.vectors):
        return docs
    rows = docs.select(F.struct("*").alias("doc"), "text")
    return quality.classify(rows, model, score="score").filter(F.col("score") >= quality.ACCEPT).select("doc.*")


def once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of equal texts."""
    return _without_dropped(docs, dedup.dedup_exact)


def distinct_enough(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of near duplicates."""
    limit_batches(spark)
    return _without_dropped(docs, neardup.near_duplicates)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mixture."""
    return mixing.mix(docs).orderBy("slot", "place").select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, ids (32-bit little-endian) in the order of the mixture."""
    limit_batches(spark)
    path, pattern = rank_file()
    return bpe.encode_bpe(docs, path=path, pattern=pattern, with_ids=True)


STAGES = [
    ("quality classifier", accept),
    ("exact dedup", once),
    ("near dedup", distinct_enough),
    ("mixing", mixed),
    ("byte-level BPE", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: None: classifier, near duplicates and merges have no SQL; tests/llm/test_pipeline.py holds each stage against a brute-force version.
ORACLE_SQL = None
