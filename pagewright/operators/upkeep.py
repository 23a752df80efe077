"""Upkeep of a store: what is wrong with it, whether its index still fits, versions, what an ingestion would do, files made larger, differences shown."""

from __future__ import annotations

import difflib

import numpy as np
import pandas as pd
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from pagewright.functions import fixed, redact
from pagewright.functions import text as T
from pagewright.operators import incremental
from pagewright.operators import links as L
from pagewright.sources import json_pages


def lint_errors(pages: DataFrame, blocks: DataFrame, resolved: DataFrame) -> DataFrame:
    """page_id, error of what makes a store wrong as a whole: slugs and block ids that several have, links and sources that lead to no page.

    The first page (by id) with a slug, or the first block (by page and place) with an id, is right, the others are not.
    """
    slugs = pages.groupBy("slug").agg(F.min("page_id").alias("first_"), F.count("*").alias("n")).filter("n > 1")
    twice = pages.join(slugs, "slug").filter(F.col("page_id") != F.col("first_")).select("page_id", F.concat(F.lit("duplicate slug "), "slug").alias("error"))
    ids = blocks.groupBy("block_id").agg(F.min(F.struct("page_id", "pos")).alias("f"), F.count("*").alias("n")).filter("n > 1")
    again = blocks.join(ids, "block_id").filter(F.struct("page_id", "pos") != F.col("f")).select("page_id", F.concat(F.lit("duplicate block id "), "block_id", F.lit(" (also in "), "f.page_id", F.lit(")")).alias("error"))
    missing = L.dangling(resolved, pages).filter("kind = 'wiki'").select("page_id", F.concat(F.lit("missing link target [["), "target", F.lit("]]")).alias("error"))
    refs = pages.select("page_id", F.explode("sources").alias("ref")).filter(F.col("ref").startswith("page:")).withColumn("key", T.link_key("ref"))
    lost = refs.join(L.lookup(pages).select("key"), "key", "left_anti").select("page_id", F.concat(F.lit("source "), "ref", F.lit(" has no page")).alias("error"))
    return twice.unionByName(again).unionByName(missing).unionByName(lost).distinct()


def stale_index(spark: SparkSession, path: str, current: DataFrame) -> list[str]:
    """Why the kept digests (page_id, sha256) below `path` don't serve the current ones: missing, unreadable or stale; nothing if they do."""
    try:
        kept = spark.read.parquet(path)
    except AnalysisException as e:
        return ["missing" if e.getCondition() == "PATH_NOT_FOUND" else "unreadable"]
    except (PySparkException, Py4JJavaError):
        return ["unreadable"]
    if not {"page_id", "sha256"} <= set(kept.columns):
        return ["unreadable"]
    return [] if incremental.changes(kept, current).isEmpty() else ["stale"]


def version_key(version: Column) -> Column:
    """What versions are ordered by: their numbers, so that 1.10 comes behind 1.9; those that hold anything else come first."""
    parts = F.transform(F.split(version, "\\."), lambda x: F.try_to_number(x, F.lit("999999999")).cast("int"))
    return F.when(F.exists(parts, lambda x: x.isNull()), F.array(F.lit(-1))).otherwise(parts)


def schema_versions(pages: DataFrame) -> DataFrame:
    """version, n, lowest: the versions of a store (null counts as empty), and whether it is the one that the store as a whole has."""
    n = pages.groupBy(F.coalesce("schema_version", F.lit("")).alias("version")).agg(F.count("*").alias("n"))
    low = n.agg(F.min_by("version", F.struct(version_key(F.col("version")), F.col("version"))).alias("low_"))  # one row
    return n.crossJoin(F.broadcast(low)).select("version", "n", (F.col("version") == F.col("low_")).alias("lowest"))


def ingest_plan(existing: DataFrame, new: DataFrame, update: bool = False) -> DataFrame:
    """page_id, action, path, moved_from of pages (page_id, type) that would come in, without writing any.

    The type gives the folder. A page that is there already is 'updated' (with `update`) or 'refused', and one whose type changed moves. Another
    page whose file has the same name is 'clash'. Several new pages of one name are 'clash' but the first by id.
    """
    dirs = F.create_map(*(F.lit(x) for pair in fixed.PAGE_DIRS.items() for x in pair))
    place = lambda kind: F.when(F.coalesce(dirs[kind], F.lit("")) != "", F.concat(dirs[kind], F.lit("/"))).otherwise("")
    old = existing.select(F.col("page_id").alias("old_id"), T.safe_name("page_id").alias("name_"), F.col("type").alias("old_type"))
    old = old.groupBy("name_").agg(F.min(F.struct("old_id", "old_type")).alias("o"))
    fresh = new.select("page_id", "type", T.safe_name("page_id").alias("name_"))
    first = fresh.groupBy("name_").agg(F.min("page_id").alias("first_"))
    rows = fresh.join(first, "name_").join(old, "name_", "left")
    known = F.col("o").isNotNull()
    clash = (known & (F.col("o.old_id") != F.col("page_id"))) | (F.col("first_") != F.col("page_id"))
    action = F.when(clash, "clash").when(known & F.lit(not update), "refused").when(known, "updated").otherwise("added")
    moved = (F.col("action") == "updated") & ~F.col("type").eqNullSafe(F.col("o.old_type"))
    return rows.withColumn("action", action).select("page_id", "action", F.concat(place(F.col("type")), "name_").alias("path"), F.when(moved, F.concat(place(F.col("o.old_type")), "name_")).alias("moved_from"))


def compact(spark: SparkSession, source: str, target: str, file_bytes: int = 128 << 20, spare: float = 0.1, force: bool = False) -> bool:
    """Writes a Parquet table again in fewer files of about `file_bytes`, if it has more than a share `spare` of files too many. No shuffle."""
    size = json_pages.file_states(spark, source, "*.parquet").agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("b")).first()
    wanted = max(1, -(-size["b"] // file_bytes))
    if not force and size["n"] <= wanted * (1 + spare):
        return False
    spark.read.parquet(source).coalesce(wanted).write.mode("overwrite").parquet(target)
    return True


@F.pandas_udf(ArrayType(StringType()))
def _diffs(source: pd.Series, other: pd.Series) -> pd.Series:
    def one(a, b):
        # whole texts are redacted, as a credential may go over several lines
        return list(difflib.unified_diff(redact.redact(a).splitlines(), redact.redact(b).splitlines(), "source_text", "data", lineterm="", n=1))

    return pd.Series([one(a or "", b or "") for a, b in zip(source, other, strict=True)], dtype=object)


def drift_diff(source, other) -> Column:
    """Lines of the unified diff of two texts (one line around each change), credentials masked; null counts as empty."""
    return _diffs(source, other)


def _places(text: str, term: str) -> np.ndarray:
    """Where a term begins in a text, overlapping itself or not."""
    at = [text.find(term)]
    while at[-1] >= 0:
        at.append(text.find(term, at[-1] + 1))
    return np.array(at[:-1], dtype=np.int64)


def densest(text: str, terms: list[str], limit: int) -> str:
    """The window of a text (blanks squeezed) that holds most different terms, then most in all, then the ones furthest from its edges, then the first.

    Windows begin where a term stands at their start, in their middle or at their end, at the text's start, or end with the text. What is cut off is marked.
    A sweep: an occurrence enters the window that ends behind it and leaves with the one that begins behind its first letter, so that sums over
    these events give what every window holds.
    """
    text = " ".join(text.split())
    last = len(text) - limit
    if last <= 0:
        return text
    low = text.lower()
    if len(low) != len(text):  # letters whose lower case is longer would shift all places
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    seen = {t: at for t in sorted(set(terms)) if t and len(at := _places(low, t))}
    edges = [np.array([0, last])] + [at - back for t, at in seen.items() for back in (0, limit // 2, limit - len(t))]
    begins = np.unique(np.clip(np.concatenate(edges), 0, last))
    held = np.zeros((3, len(begins)), dtype=np.int64)  # different terms, all occurrences, distance from the edges
    for t, at in seen.items():
        if len(t) > limit:
            continue
        events = np.zeros(last + 2, dtype=np.int64)
        np.add.at(events, np.clip(at + len(t) - limit, 0, last + 1), 1)
        np.add.at(events, np.minimum(at + 1, last + 1), -1)
        inside = np.cumsum(events)[begins]
        if (np.diff(at) < len(t)).any():  # of a term that overlaps itself, occurrences are those that don't
            inside = np.array([low.count(t, b, b + limit) for b in begins.tolist()])
        first = at[np.minimum(np.searchsorted(at, begins), len(at) - 1)] - begins
        held += np.where(inside > 0, np.stack([np.ones_like(inside), inside, np.maximum(0, np.minimum(first, limit - first - len(t)))]), 0)
    best = int(begins[np.lexsort((begins, *-held[::-1]))[0]])
    return ("…" if best else text[0]) + text[best + 1 : best + limit - 1] + ("…" if best < last else text[-1])


def dense_windows(df: DataFrame, text: Column | str, terms: Column | str, limit: int, key: str = "doc_id") -> DataFrame:
    """key, window: `densest` of each row's text by its terms (an array of strings). Null texts and terms count as empty; rows stay as many as they are.

    It goes through the table, not through a column function, so that `terms` may be any expression.
    """
    rows = df.select(F.col(key).alias("k"), F.coalesce(text if isinstance(text, Column) else F.col(text), F.lit("")).alias("t"), (terms if isinstance(terms, Column) else F.col(terms)).alias("w"))
    kind = rows.schema["k"].dataType.simpleString()

    def run(batches):
        for b in batches:
            found = [densest(t, w or [], limit) for t, w in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.string())], ["k", "window"])

    return rows.mapInArrow(run, f"k {kind}, window string").withColumnRenamed("k", key)


def visible(nodes: DataFrame, by: str, enabled: list[str], orphans: bool = True, conflicts_only: bool = False) -> DataFrame:
    """Nodes (group, type, orphan, unresolved_conflicts) that a view shows: those of enabled groups or types (by tag all), with or without orphans, or only those in conflict."""
    column = {"project": "group", "type": "type"}.get(by)
    rows = nodes.filter(F.col(column).isin(enabled)) if column else nodes
    rows = rows if orphans else rows.filter(~F.col("orphan"))
    return rows.filter("unresolved_conflicts > 0") if conflicts_only else rows


def in_order(rows: DataFrame) -> DataFrame:
    """Edges by source, target and kind, nodes by id, as they are written."""
    return rows.orderBy(*(c for c in ("source", "target", "kind") if c in rows.columns)) if "source" in rows.columns and "target" in rows.columns else rows.orderBy("id")


