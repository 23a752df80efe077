"""The scan path: ranking without an index, by how strongly tokens occur in the fields of whole pages."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions import fixed
from pagewright.functions import text as T
from pagewright.plans.cut import cut


#: Bytes of passages that are sent to all tasks in one go; more are looked for in several passes over the texts.
PASSAGES = 64 << 20
#: Distinct tokens that are looked for in one pass over the texts, and found rows that a worker holds at most (and those of one page).
WORDS, HITS = 100_000, 20_000


def holding(texts: DataFrame, passages: DataFrame) -> DataFrame:
    """qid, page_id of the passages (qid, text) that a text (page_id, text) holds verbatim. Each text is read once for all passages.

    An empty passage is in every text, a null one in none; null texts hold nothing.
    """
    size = passages.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    times = int(size // PASSAGES) + 1
    out = None
    for i in range(times):
        some = passages.filter(F.pmod(F.xxhash64("qid"), F.lit(times)) == i) if times > 1 else passages
        found = _holding(texts, [(r.qid, r.text) for r in some.filter("text IS NOT NULL").select("qid", "text").collect()], passages.schema["qid"].dataType.simpleString())
        out = found if out is None else out.unionByName(found)
    return out


def _holding(texts: DataFrame, known: list, kind: str) -> DataFrame:
    """`known` is a bounded list of (qid, passage)."""
    shared = texts.sparkSession.sparkContext.broadcast(known)

    def run(frames):
        import ahocorasick

        of: dict[str, list] = {}
        for qid, passage in shared.value:
            of.setdefault(passage, []).append(qid)
        everywhere = of.pop("", [])
        a = ahocorasick.Automaton()
        for passage in of:
            a.add_word(passage, passage)
        a.make_automaton()
        for f in frames:
            rows = []
            for page, text in zip(f["page_id"], f["text"], strict=True):
                if text is not None:
                    found = {p for _, p in a.iter(text)} if of else ()
                    rows += [(q, page) for p in found for q in of[p]] + [(q, page) for q in everywhere]
            yield pd.DataFrame(rows, columns=["qid", "page_id"])

    return texts.select("page_id", "text").mapInPandas(run, f"qid {kind}, page_id string")


def fields(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """page_id and its lower-case fields. A page's blocks make one body, in order."""
    body = blocks.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ").alias("b"))
    p = pages.join(body, "page_id", "left")
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    return p.select("page_id", "slug", low(F.col("title")).alias("title"), low(F.array_join("tags", " ")).alias("tags"), low(F.array_join("projects", " ")).alias("projects"), low(F.col("summary")).alias("summary"), low(F.concat_ws(" ", "slug", F.coalesce("b", F.lit("")))).alias("body"))


def query_tokens(queries: DataFrame) -> DataFrame:
    """qid, token of the queries' distinct tokens."""
    return queries.select("qid", F.explode(T.scan_tokens("text")).alias("token"))


def token_strengths(docs: DataFrame, tokens: DataFrame) -> DataFrame:
    """token, page_id, strength (weighted over the fields) of the pages in which each distinct token is found.

    The distinct tokens of a batch of queries, and their prefixes down to the least length, go into one Aho-Corasick automaton, with
    which each field is read once: time grows with the text and its hits, not with the number of tokens. `match_strength` is the
    same rule for one token as a column. Tokens are looked for in passes over the fields, each for so many of them (WORDS) that the
    automaton of a worker is bounded; what is found comes out in parts of HITS rows.
    """
    times = int(tokens.agg(F.count_distinct("token")).first()[0] // WORDS) + 1
    out = None
    for i in range(times):
        some = tokens.select("token").distinct()
        some = some.filter(F.pmod(F.xxhash64("token"), F.lit(times)) == i) if times > 1 else some
        found = _strengths(docs, sorted(r[0] for r in some.collect()))  # bounded by WORDS
        out = found if out is None else out.unionByName(found)
    return out


def _strengths(docs: DataFrame, words: list[str]) -> DataFrame:
    """`token_strengths` of a bounded list of distinct tokens."""
    shared = docs.sparkSession.sparkContext.broadcast(words)
    names = list(fixed.FIELD_WEIGHTS)
    weights = list(fixed.FIELD_WEIGHTS.values())
    most = HITS

    def run(frames):
        import ahocorasick

        words = shared.value
        a = ahocorasick.Automaton()
        of: dict[str, list[int]] = {}
        for i, w in enumerate(words):
            least = 2 if re.fullmatch("[가-힣]+", w) else 4
            for n in range(min(least, len(w)), len(w) + 1):
                of.setdefault(w[:n], []).append(i)
        for p in of:
            a.add_word(p, p)
        a.make_automaton()
        made = lambda out: pd.DataFrame(out, columns=["token", "page_id", "strength"])
        for f in frames:
            out: list[tuple[str, str, float]] = []
            for row in f.itertuples(index=False):
                total: dict[int, float] = {}
                for name, weight in zip(names, weights, strict=True):
                    best: dict[int, int] = {}
                    for p in {p for _, p in a.iter(getattr(row, name) or "")} if words else ():
                        for i in of[p]:
                            best[i] = max(best.get(i, 0), len(p))
                    for i, n in best.items():
                        total[i] = total.get(i, 0.0) + weight * n / len(words[i])
                out += [(words[i], row.page_id, t) for i, t in total.items()]
                if len(out) >= most:
                    yield made(out)
                    out = []
            yield made(out)

    return docs.select("page_id", *names).mapInPandas(run, "token string, page_id string, strength double")


def rank(docs: DataFrame, tokens: DataFrame, strengths: DataFrame | None = None) -> DataFrame:
    """qid, rank, page_id, score, matched, wordy (whether a matched token isn't a number), n_tokens."""
    hits = cut(token_strengths(docs, tokens)) if strengths is None else strengths
    n = docs.agg(F.count("*").alias("n"))
    df = hits.groupBy("token").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n)).select("token", F.log(1.0 + F.col("n") / (1.0 + F.col("df"))).alias("idf"))  # one row
    asked = tokens.groupBy("qid").agg(F.count("*").alias("n_tokens"))
    s = tokens.join(hits, "token").join(df, "token").groupBy("qid", "page_id").agg(F.round(F.sum(F.col("idf") * F.col("strength")), 4).alias("score"), F.count("*").alias("matched"), F.max(~F.col("token").rlike("^[0-9]+$")).alias("wordy"))
    r = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "page_id"))
    return s.filter("score > 0").withColumn("rank", r).join(asked, "qid").select("qid", "rank", "page_id", "score", "matched", "wordy", "n_tokens")


def gate(queries: DataFrame, ranked: DataFrame) -> DataFrame:
    """qid, verdict (body, hint, none), top, coverage, by the best page of each query."""
    best = ranked.filter("rank = 1")
    g = queries.select("qid").join(best, "qid", "left")
    matched = F.when(F.col("wordy"), F.col("matched")).otherwise(0)
    cover = F.coalesce(F.col("matched") / F.col("n_tokens"), F.lit(0.0))
    body = (F.col("score") >= fixed.SCAN_SCORE) & ((cover >= fixed.SCAN_COVERAGE) | (matched >= fixed.SCAN_MATCHED))
    hint = (matched > 0) & (F.col("score") >= fixed.HINT_SCORE) & ((cover >= fixed.HINT_COVERAGE) | (matched >= fixed.HINT_MATCHED))
    return g.select("qid", F.when(body, "body").when(hint, "hint").otherwise("none").alias("verdict"), F.coalesce("score", F.lit(0.0)).alias("top"), F.round(cover, 4).alias("coverage"))


def rank_blocks(blocks: DataFrame, pairs: DataFrame, tokens: DataFrame, idf: DataFrame, limit: int = 5) -> DataFrame:
    """qid, page_id, pos, score of the blocks that speak for a page in `pairs` (qid, page_id); headings and breaks don't count.

    An open conflict always has a bonus, other kinds only if a token is found. A page without such a block gives its first one.
    """
    body = blocks.filter(~F.col("kind").isin(*fixed.NO_EVIDENCE_KINDS) & (F.col("text") != ""))
    rows = body.join(pairs, "page_id").join(tokens, "qid").join(idf, "token", "left")
    scored = rows.groupBy("qid", "page_id", "pos", "kind", "unresolved", "text").agg(F.sum(F.coalesce("idf", F.lit(1.0)) * T.match_strength(F.col("token"), F.lower("text"))).alias("s"))
    flagged = F.col("unresolved") | F.contains("text", F.lit(fixed.CONFLICT_MARK))
    bonus = F.lit(0.0)
    for kind, b in fixed.KIND_BONUS.items():
        bonus = F.when(F.col("kind") == kind, b).otherwise(bonus)
    s = F.col("s") + F.when(flagged, fixed.KIND_BONUS["conflict"]).when(F.col("s") > 0, bonus).otherwise(0.0)
    w = Window.partitionBy("qid", "page_id")
    r = scored.withColumn("score", s).withColumn("n", F.row_number().over(w.orderBy(F.desc(F.round("score", 9)), "pos"))).withColumn("best", F.max("score").over(w))
    first = F.min(F.when(F.col("kind").isin("paragraph", "list", "current"), F.col("pos"))).over(w)
    kept = r.withColumn("first", first).filter(((F.col("score") > 0) & (F.col("n") <= limit)) | ((F.col("best") <= 0) & (F.col("pos") == F.col("first"))))
    return kept.select("qid", "page_id", "pos", "score")
