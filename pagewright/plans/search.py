"""Ranked search for a batch of queries: lexical scores, re-ranking, spreading over the graph, folding of versions, evidence.

Every step keeps `qid`, so a batch is one job; limits are windows with all ties broken. Only rows of the queries' terms leave
the postings.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions import fixed
from pagewright.functions import text as T
from pagewright.operators.index import Index
from pagewright.plans.cut import cut, few


class Options(NamedTuple):
    """How a search differs from the default one."""

    fold: bool = True
    graph: bool = True
    rerank: bool = True
    steps: int = fixed.STEPS
    idf_power: float = fixed.IDF_POWER
    tail: float = fixed.TAIL_WEIGHT
    additive: bool = False
    top: int = fixed.TOP
    hub_labels: int = fixed.HUB_LABELS
    hub_blocks: int = fixed.HUB_BLOCKS


def idf(n: Column, df: Column) -> Column:
    return F.log(1.0 + (n - df + 0.5) / (df + 0.5))


def _rank(by: list[str], *order) -> Column:
    """Place within `by`. Sums are rounded where they give the order, as their last bits depend on how rows were dealt out."""
    return F.row_number().over(Window.partitionBy(*by).orderBy(*order))


def query_terms(queries: DataFrame) -> DataFrame:
    """qid, term, weight (1.0) of the distinct tokens of queries (qid, text)."""
    return queries.select("qid", F.explode(F.array_distinct(T.tokens("text", query=True))).alias("term"), F.lit(1.0).alias("weight"))


def expanded_terms(index: Index, queries: DataFrame, glossary) -> DataFrame:
    """The terms of queries and those that a glossary adds, at half the weight or less.

    An added term's idf is cut to that of the surface that called it, or a rare synonym would outweigh the word that was asked.
    """
    from pagewright.functions.glossary import added_terms

    extra = cut(added_terms(queries, glossary))
    n = index.stats.select("n_blocks")
    of = lambda t: t.join(index.terms, "term", "left").crossJoin(F.broadcast(n)).withColumn("idf", idf(F.col("n_blocks"), F.coalesce("df", F.lit(0)).cast("double")))  # noqa: E731  one row
    own = of(extra.select("qid", "term", "sources")).select("qid", "term", F.col("idf").alias("own"))
    caps = of(extra.select("qid", F.col("term").alias("added"), F.explode("sources").alias("term"))).groupBy("qid", F.col("added").alias("term")).agg(F.max("idf").alias("cap"))
    share = F.least(F.lit(1.0), F.coalesce("cap", "own") / F.col("own"))
    weighed = own.join(caps, ["qid", "term"], "left").filter("own > 0").select("qid", "term", (fixed.SYNONYM_WEIGHT * F.pow(share, F.lit(fixed.IDF_POWER))).alias("weight"))
    return query_terms(queries).unionByName(weighed)


def weighed_terms(index: Index, terms: DataFrame) -> DataFrame:
    """`terms` with df (null if no block has the term), idf and the corpus figures."""
    known = terms.join(index.terms, "term", "left").crossJoin(F.broadcast(index.stats))  # one row of figures
    return cut(known.withColumn("idf", idf(F.col("n_blocks"), F.coalesce("df", F.lit(0)).cast("double"))))


def coverage(weighed: DataFrame) -> DataFrame:
    """qid, n_terms, posted_terms, coverage, idf_coverage over the terms that were asked."""
    asked = weighed.filter("weight >= 1")
    posted = F.col("df").isNotNull()
    a = asked.groupBy("qid").agg(F.count("*").alias("n_terms"), F.count_if(posted).alias("posted_terms"), F.sum("idf").alias("all_"), F.sum(F.when(posted, F.col("idf")).otherwise(0.0)).alias("got_"))
    return a.select("qid", "n_terms", "posted_terms", (F.col("posted_terms") / F.col("n_terms")).alias("coverage"), (F.col("got_") / F.when(F.col("all_") == 0, 1.0).otherwise(F.col("all_"))).alias("idf_coverage"))


def kept_terms(weighed: DataFrame) -> DataFrame:
    """The terms that are looked up: not too frequent (or the rarest, if all are), the rarest of the asked and of the added ones."""
    found = weighed.filter("df IS NOT NULL")
    rare = F.col("df") <= fixed.MAX_DF_SHARE * F.col("n_blocks")
    w = Window.partitionBy("qid")
    marked = found.withColumn("rare", rare).withColumn("any_", F.max("rare").over(w)).withColumn("n_", _rank(["qid"], "df", "term"))
    kept = marked.filter("rare OR (NOT any_ AND n_ = 1)").withColumn("asked", F.col("weight") >= 1)
    return kept.withColumn("n_", _rank(["qid", "asked"], "df", "term")).filter(F.col("n_") <= fixed.MAX_TERMS).drop("n_", "rare", "any_", "asked")


def block_scores(index: Index, weighed: DataFrame, o: Options = Options()) -> DataFrame:
    """qid, page_id, pos, ev, score, content (without the bigrams of question words)."""
    content = ~F.array_contains(T.stop_tokens(), F.col("term"))
    kept = cut(kept_terms(weighed).select("qid", "term", "idf", "avg_len", (F.pow("idf", F.lit(o.idf_power - 1)) * F.col("weight")).alias("by"), content.alias("is_content")))
    # what a posting adds depends on its term alone: the best postings are picked once for each term of the batch, however many queries ask for it.
    # A batch has MAX_TERMS terms of each kind and query at most, so they are broadcast, and postings aren't shuffled but for the best of each task.
    asked = few(kept.select("term", "idf", "avg_len").distinct())
    hit = index.postings.join(asked, "term")
    impact = F.col("idf") * F.col("tf") * (fixed.K1 + 1) / (F.col("tf") + fixed.K1 * (1 - fixed.B) + fixed.K1 * fixed.B / F.col("avg_len") * F.col("len")) * F.col("mult")
    best = hit.withColumn("impact", impact).withColumn("n_", _rank(["term"], F.desc("impact"), "page_id", "pos")).filter(F.col("n_") <= fixed.MAX_POSTINGS)
    top = best.select("term", "page_id", "pos", "ev", "impact").join(kept.select("qid", "term", "by", "is_content"), "term").withColumn("v", F.col("impact") * F.col("by"))
    return cut(top.groupBy("qid", "page_id", "pos", "ev").agg(F.sum("v").alias("score"), F.sum(F.when(F.col("is_content"), F.col("v")).otherwise(0.0)).alias("content")))


def page_scores(blocks: DataFrame, o: Options = Options()) -> DataFrame:
    """qid, page_id, best, rest, n, lex (best + a share of the rest), content_lex."""
    p = blocks.groupBy("qid", "page_id").agg(F.max("score").alias("best"), F.sum("score").alias("sum_"), F.count("*").alias("n"), F.max("content").alias("cbest"), F.sum("content").alias("csum"))
    rest = F.col("sum_") - F.col("best")
    return p.select("qid", "page_id", "best", rest.alias("rest"), "n", (F.col("best") + o.tail * rest).alias("lex"), (F.col("cbest") + o.tail * (F.col("csum") - F.col("cbest"))).alias("content_lex"))


def signals(weighed: DataFrame, blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """One row per query: coverage, and the scores of the best page and block. 0 where nothing was found."""
    first = F.struct("lex", F.col("best"), "n")
    top = pages.withColumn("r", _rank(["qid"], F.desc(F.round("lex", 6)), "page_id")).groupBy("qid").agg(F.max(F.when(F.col("r") == 1, first)).alias("t"), F.max("content_lex").alias("c"))
    b = blocks.groupBy("qid").agg(F.max("score").alias("b"))
    s = coverage(weighed).join(top, "qid", "left").join(b, "qid", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    out = s.select("qid", "n_terms", "posted_terms", "coverage", "idf_coverage", zero("t.lex").alias("raw_top"), zero("c").alias("content_raw_top"), zero("b").alias("top_block_impact"), zero("t.best").alias("top1_best_block"), F.coalesce("t.n", F.lit(0)).alias("top1_n_blocks"))
    for name, column in (("raw", "raw_top"), ("impact", "top_block_impact"), ("content_raw", "content_raw_top")):
        out = out.withColumn(f"{name}_x_cov", F.col(column) * F.col("coverage")).withColumn(f"{name}_x_idfcov", F.col(column) * F.col("idf_coverage"))
    return out


def grade(signal: Column, silence: float = 0.0, hint: float = 0.0) -> Column:
    """strong, weak or none, by two thresholds; strong if both are off."""
    if silence <= 0:
        return F.lit("strong")
    return F.when(signal >= silence, "strong").when((F.lit(hint) > 0) & (signal >= hint), "weak").otherwise("none")


def reranked(index: Index, pages: DataFrame, o: Options = Options()) -> DataFrame:
    """qid, page_id, rel of the best candidates: the rest is divided by the page's length, type and hub weights are applied."""
    cand = pages.withColumn("r_", _rank(["qid"], F.desc(F.round("lex", 6)), "page_id")).filter(F.col("r_") <= fixed.CANDIDATES)
    if not o.rerank:
        return cand.select("qid", "page_id", F.col("lex").alias("rel"))
    facts = index.pages.select("page_id", "type", "labels", "n_blocks", "n_body")
    c = cand.join(facts, "page_id").crossJoin(F.broadcast(index.stats.select("avg_body")))  # one row
    norm = F.when(F.col("n_body") > 0, 1 / (1 - fixed.PAGE_B + fixed.PAGE_B * F.col("n_body") / F.col("avg_body"))).otherwise(1.0)
    kind = F.when(F.col("type").isin(*fixed.COMPILED_TYPES), fixed.TYPE_WEIGHT).otherwise(1.0)
    hub = F.when((F.col("labels") > o.hub_labels) | (F.col("n_blocks") > o.hub_blocks), fixed.HUB_WEIGHT).otherwise(1.0)
    return c.select("qid", "page_id", ((F.col("best") + o.tail * norm * F.col("rest")) * kind * hub).alias("rel"))


def relative(rel: DataFrame) -> DataFrame:
    """`rel` with l: the share of the query's best."""
    top = F.max("rel").over(Window.partitionBy("qid"))
    return cut(rel.withColumn("l", F.col("rel") / F.when(top == 0, 1.0).otherwise(top)))


def spread(index: Index, rel: DataFrame, o: Options = Options()) -> DataFrame:
    """qid, page_id, g, own: what comes from the seeds over the graph, and the block of the strongest edge.

    A page takes the strongest single path of each step. Mass over related edges is divided by their number, and doesn't go back
    over the edge that it came by.
    """
    mass = rel.withColumn("r_", _rank(["qid"], F.desc(F.round("rel", 6)), "page_id")).filter(F.col("r_") <= fixed.SEEDS).select("qid", F.col("page_id").alias("src"), F.col("l").alias("mass"))
    every, came = None, None
    for step in range(o.steps):
        rows = few(mass).join(index.adjacency, "src")  # SEEDS or FRONTIER rows a query
        curated = F.count_if(F.col("w") >= 1).over(Window.partitionBy("qid", "src"))
        rows = rows.withColumn("m", F.col("mass") * F.when(F.col("w") >= 1, F.col("w") / curated).otherwise(F.col("w"))).filter("w > 0")
        if came is not None:
            rows = rows.join(came, ["qid", "src", "dst"], "left_anti")
        came = rows.select("qid", F.col("dst").alias("src"), F.col("src").alias("dst"))
        got = rows.groupBy("qid", "dst").agg(F.max("m").alias("m"), F.min_by("own_block", F.struct(-F.round("m", 9), F.col("src"))).alias("own"), F.min_by("src", F.struct(-F.round("m", 9), F.col("src"))).alias("via"))
        d = fixed.STEP_DECAY**step
        part = got.select("qid", F.col("dst").alias("page_id"), (F.col("m") * d).alias("g"), "own", F.lit(step).alias("step"))
        every = part if every is None else every.unionByName(part)
        mass = got.withColumn("r_", _rank(["qid"], F.desc(F.round("m", 9)), "dst")).filter(F.col("r_") <= fixed.FRONTIER).select("qid", F.col("dst").alias("src"), F.col("m").alias("mass"))
    return every.groupBy("qid", "page_id").agg(F.sum("g").alias("g"), F.min_by("own", F.struct(-F.round("g", 9), F.col("step"))).alias("own"))


def combined(rel: DataFrame, graph: DataFrame | None, o: Options = Options()) -> DataFrame:
    """qid, page_id, score, own: both kinds of evidence by noisy-or (or their sum)."""
    if graph is None:
        return rel.select("qid", "page_id", F.col("l").alias("score"), F.lit(None).cast("string").alias("own"))
    both = rel.select("qid", "page_id", "l").join(graph, ["qid", "page_id"], "full")
    lex, g = F.coalesce("l", F.lit(0.0)), F.coalesce("g", F.lit(0.0))
    score = lex + fixed.GRAPH_WEIGHT * g if o.additive else lex + fixed.GRAPH_WEIGHT * F.least(g, F.lit(1.0)) * (1 - lex)
    return cut(both.select("qid", "page_id", score.alias("score"), "own"))


def folded(index: Index, scores: DataFrame) -> DataFrame:
    """`scores` with head, state and lifted: a head takes the best score of its versions, which then show at a share of the head's."""
    known = scores.join(index.pages.select("page_id", "head", "state", "sup_block", "slug"), "page_id")
    best = known.groupBy("qid", "head").agg(F.max("score").alias("top"), F.max(F.when(F.col("head") == F.col("page_id"), F.col("score"))).alias("mine"), F.max(F.col("head") != F.col("page_id")).alias("older"))
    new = best.filter("mine IS NULL").select("qid", F.col("head").alias("page_id"), F.lit(None).cast("string").alias("own"))
    new = new.join(index.pages.select("page_id", "head", "state", "sup_block", "slug"), "page_id").withColumn("score", F.lit(0.0))
    every = known.unionByName(new).drop("score").join(best, ["qid", "head"])
    stale = F.col("head") != F.col("page_id")
    # sums of equal parts in another order may differ in the last bits: that lifts nothing
    lifted = ~stale & F.col("older") & (F.col("mine").isNull() | (F.col("top") > F.col("mine") + 1e-9))
    return every.select("qid", "page_id", "slug", F.when(stale, F.col("top") * fixed.STALE_SHOW).otherwise(F.col("top")).alias("score"), "own", "head", "state", "sup_block", lifted.alias("lifted"), stale.alias("stale"))


def search(index: Index, queries: DataFrame, o: Options = Options(), terms: DataFrame | None = None, scored: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """qid, rank, page_id, slug, score, blocks (evidence, joined by commas), head, state of the best pages of each query.

    Older versions whose head is among the best follow, even beyond the limit. A query without known terms has no rows. `scored` are
    the weighed terms and block scores of the same queries, where they are known already.
    """
    if scored is None:
        weighed = weighed_terms(index, query_terms(queries) if terms is None else terms)
        scored = weighed, block_scores(index, weighed, o)
    blocks = scored[1]
    rel = relative(reranked(index, page_scores(blocks, o), o))
    scores = combined(rel, spread(index, rel, o) if o.graph else None, o)
    if o.fold:
        rows = folded(index, scores)
    else:
        rows = scores.join(index.pages.select("page_id", "slug", "head", "state", "sup_block"), "page_id").withColumn("lifted", F.lit(False)).withColumn("stale", F.lit(False))
    ranked = cut(rows.withColumn("rank", _rank(["qid"], F.desc(F.round("score", 9)), "page_id")))
    final = cut(with_stale(ranked, o))
    return with_evidence(index, final, blocks).select("qid", "rank", "page_id", "slug", F.round("score", 6).alias("score"), "blocks", "head", "state")


def with_stale(ranked: DataFrame, o: Options) -> DataFrame:
    """The best rows, and the older versions of those among them."""
    best = ranked.filter(F.col("rank") <= o.top)
    if not o.fold:
        return best.withColumn("head_of_stale", F.lit(False))
    heads = best.select("qid", F.col("page_id").alias("head")).withColumn("in_", F.lit(True))
    kept = ranked.join(heads, ["qid", "head"], "left").filter((F.col("rank") <= o.top) | (F.col("stale") & F.col("in_"))).drop("in_")
    of_stale = kept.filter("stale").select("qid", F.col("head").alias("page_id")).distinct().withColumn("head_of_stale", F.lit(True))
    return kept.join(of_stale, ["qid", "page_id"], "left").withColumn("head_of_stale", F.coalesce("head_of_stale", F.lit(False)))


def with_evidence(index: Index, final: DataFrame, blocks: DataFrame) -> DataFrame:
    """`final` with blocks: the supersedes block of a lifted head, the block of the strongest edge, the best blocks; else, for heads
    that versions lifted, the first block with evidence."""
    lex = blocks.filter("ev").join(final.select("qid", "page_id"), ["qid", "page_id"], "left_semi")
    lex = lex.withColumn("r_", _rank(["qid", "page_id"], F.desc(F.round("score", 6)), F.desc("pos"))).filter(F.col("r_") <= fixed.MAX_EVIDENCE)
    named = few(lex).join(index.blocks.select("page_id", "pos", "block_id"), ["page_id", "pos"])
    listed = named.groupBy("qid", "page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r_", "block_id"))), lambda x: x["block_id"]).alias("lex_"))  # three at most
    first = index.pages.select("page_id", F.col("first_ev").alias("first_"))
    none = F.array().cast("array<string>")
    rows = final.join(listed, ["qid", "page_id"], "left").join(first, "page_id", "left")
    ev = F.concat(F.when(F.col("lifted"), F.array("sup_block")).otherwise(none), F.array(F.coalesce("own", F.lit(""))), F.coalesce("lex_", none))
    ev = F.slice(F.array_distinct(F.filter(ev, lambda b: b != "")), 1, fixed.MAX_EVIDENCE + 1)
    fallback = (F.size(ev) == 0) & (F.col("head") == F.col("page_id")) & (F.col("lifted") | F.col("head_of_stale")) & F.col("first_").isNotNull()
    return rows.withColumn("blocks", F.when(fallback, F.col("first_")).otherwise(F.array_join(ev, ",")))
