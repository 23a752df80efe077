"""What a service asks of the engine: prompts, pinned pages, pages in parts, search rows, probes, thresholds."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions import fixed, redact
from pagewright.functions import text as T
from pagewright.operators.index import Index
from pagewright.plans import search as S

META = ("page_id", "slug", "title", "type", "created", "updated", "projects", "tags", "sources", "summary")


def prompt_of(*candidates) -> Column:
    """The first of several columns that isn't blank, as it is."""
    return F.coalesce(*(F.when(F.trim(c) != "", F.col(c)) for c in candidates))


def should_skip(prompt) -> Column:
    """Whether a prompt isn't asked: too short, a command, or with context in it already."""
    p = F.trim(F.coalesce(F.col(prompt), F.lit("")))
    return (F.length(p) < 4) | p.startswith("/") | F.contains(p, F.lit("<kb-context"))


def without_pinned(hits: DataFrame, pinned: list[str]) -> DataFrame:
    """Hits whose id and slug aren't pinned, whatever the case; pinned ones are shown anyway."""
    low = [p.lower().removeprefix("page:") for p in pinned]
    return hits.filter(~F.lower("slug").isin(low)) if low else hits


def always(pages: DataFrame, blocks: DataFrame, slugs: list[str], most_blocks: int = 5, chars: int = 150, budget: int = 800) -> DataFrame:
    """slug, place, line of pinned pages: a few clipped blocks each, as many lines in order as the bytes allow."""
    chosen = pages.filter(F.col("slug").isin(slugs)).select("page_id", "slug", F.array_position(F.array(*map(F.lit, slugs)), F.col("slug")).alias("order_"))
    rows = blocks.filter(~F.col("kind").isin(*fixed.NO_EVIDENCE_KINDS)).join(chosen, "page_id")
    n = F.row_number().over(Window.partitionBy("slug").orderBy("pos"))
    lines = rows.withColumn("n", n).filter(F.col("n") <= most_blocks).select("slug", "order_", "n", T.clip(redact.redacted("text"), chars).alias("line"))
    upto = Window.orderBy("order_", "n")  # a few lines of a few pages
    used = F.sum(F.octet_length("line") + 1).over(upto)
    return lines.withColumn("used", used).filter(F.col("used") <= budget).select("slug", (F.row_number().over(upto)).alias("place"), "line")


def page_meta(pages: DataFrame, fields: list[str] = ()) -> DataFrame:
    """The listed fields of pages (all of META by default), texts redacted."""
    wanted = [f for f in (fields or META) if f in META]
    return pages.select(*(redact.redacted(f).alias(f) if f in ("title", "summary") else F.col(f) for f in wanted))


def get_outline(blocks: DataFrame, page_ids: list[str], chars: int = 120) -> DataFrame:
    """page_id, pos, block_id, kind, preview, conflict of all blocks of pages."""
    b = blocks.filter(F.col("page_id").isin(page_ids))
    conflict = F.col("unresolved") | F.contains("text", F.lit(fixed.CONFLICT_MARK))
    return b.select("page_id", "pos", "block_id", "kind", T.clip(redact.redacted("text"), chars).alias("preview"), conflict.alias("conflict"))


def get_blocks(blocks: DataFrame, aliases: DataFrame, wanted: DataFrame) -> DataFrame:
    """n, wanted, block_id, text of blocks asked for (n, wanted) in that order, each block once; what isn't found has no block_id."""
    from pagewright.sources.json_pages import find_blocks

    found = wanted.join(find_blocks(blocks, aliases, wanted), "wanted", "left")
    first = F.row_number().over(Window.partitionBy(F.coalesce("block_id", F.concat(F.lit("?"), "wanted"))).orderBy("n"))
    once = found.withColumn("f", first).filter("f = 1").drop("f")
    return once.join(blocks.select("block_id", "text"), "block_id", "left").select("n", "wanted", "block_id", redact.redacted(F.coalesce("text", F.lit(""))).alias("text"))


def search_rows(index: Index, queries: DataFrame, limit: int = 10) -> DataFrame:
    """qid, rank, score (4 digits), page_id, slug, title, summary, blocks, superseded_by of the best pages; the limit lies in 1 to 100."""
    hits = S.search(index, queries, S.Options(top=max(1, min(100, limit))))
    info = index.pages.select("page_id", "title", T.clip("summary", 240).alias("summary"))
    return hits.join(info, "page_id").select("qid", "rank", F.round("score", 4).alias("score"), "page_id", "slug", "title", "summary", "blocks", F.when(F.col("head") != F.col("page_id"), F.col("head")).alias("superseded_by"))


def probe_query(index: Index, n: int = 6) -> DataFrame:
    """One row: page_id and query of the rarest words of the longest body block of a current page, which should find that page."""
    body = index.blocks.filter("ev").join(index.pages.filter("state = ''").select("page_id"), "page_id", "left_semi")
    longest = body.orderBy(F.desc(F.length("text")), "page_id", "pos").limit(1)
    words = longest.select("page_id", F.posexplode(F.array_distinct(T.tokens("text"))).alias("i", "term")).join(index.terms, "term")
    best = words.withColumn("r", F.row_number().over(Window.partitionBy("page_id").orderBy("df", F.desc(F.length("term")), "i"))).filter(F.col("r") <= n)
    return best.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "term"))), lambda x: x["term"]), " ").alias("query"))


def threshold(name: str, config: dict, default: float, env: str | None = None) -> float:
    """A positive number from the environment, else from the configuration, else the default; what can't be read or isn't positive doesn't count."""
    for value in (os.environ.get(env) if env else None, config.get(name)):
        try:
            if value is not None and float(value) > 0:
                return float(value)
        except (TypeError, ValueError):
            continue
    return default


def calibrated(scores: DataFrame, score: str, positive: str, key: str, most_fpr: float = 0.05) -> DataFrame:
    """One row: the best threshold on odd keys, and the rates that it has on even ones."""
    from pagewright.operators import evaluation as E

    train, test = scores.filter(F.col(key) % 2 == 1), scores.filter(F.col(key) % 2 == 0)
    t = E.best_threshold(E.roc(train, score, positive), most_fpr).select("threshold")
    hit = F.col(score) >= F.col("threshold")
    return test.crossJoin(F.broadcast(t)).groupBy("threshold").agg(F.avg(F.when(F.col(positive), hit.cast("double"))).alias("tpr"), F.avg(F.when(~F.col(positive), hit.cast("double"))).alias("fpr"))  # one row
