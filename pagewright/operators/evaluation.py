"""Measures of rankings, scores and context. Input rows are (qid, rank, page_id, ...); relevant pages are rows, too."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.plans.cut import cut


def query_metrics(queries: DataFrame, hits: DataFrame, gold: DataFrame, stale: DataFrame) -> DataFrame:
    """One row per query: recall and hit at 1, 5 and 10, precision at 5, mrr, ndcg, and whether something stale stands above all gold.

    `hits` is (qid, rank, page_id), `gold` and `stale` are distinct (qid, page_id). Without gold all but stale_above are 0;
    stale_above is -1 without stale pages.
    """
    marked = hits.join(gold.withColumn("g", F.lit(1)), ["qid", "page_id"], "left").join(stale.withColumn("s", F.lit(1)), ["qid", "page_id"], "left")
    r = F.col("rank")
    found = lambda n: F.count_if(F.col("g").isNotNull() & (r <= n))
    m = marked.groupBy("qid").agg(
        *(found(n).alias(f"f{n}") for n in (1, 5, 10)),
        F.min(F.when(F.col("g").isNotNull(), r)).alias("first"), F.min(F.when(F.col("s").isNotNull(), r)).alias("first_stale"),
        F.sum(F.when(F.col("g").isNotNull() & (r <= 10), 1 / F.log2(r + 1.0)).otherwise(0.0)).alias("dcg"),
    )
    n = queries.select("qid").join(gold.groupBy("qid").agg(F.count("*").alias("n")), "qid", "left").join(stale.groupBy("qid").agg(F.count("*").alias("ns")), "qid", "left").join(m, "qid", "left").na.fill(0, ["n", "ns", "f1", "f5", "f10"]).na.fill(0.0, ["dcg"])
    some = F.col("n") > 0
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least("n", F.lit(10)), F.lit(1)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))
    share = lambda c, of: F.when(some, F.col(c) / of).otherwise(0.0)
    above = F.when(F.col("ns") == 0, -1.0).when(F.col("first_stale").isNull(), 0.0).when(F.col("first").isNull() | (F.col("first_stale") < F.col("first")), 1.0).otherwise(0.0)
    return n.select(
        "qid", *(share(f"f{k}", F.col("n")).alias(f"recall_{k}") for k in (1, 5, 10)), *(F.when(F.col(f"f{k}") > 0, 1.0).otherwise(0.0).alias(f"hit_{k}") for k in (1, 5, 10)),
        share("f5", F.lit(5)).alias("precision_5"), F.when(F.col("first") <= 10, 1 / F.col("first")).otherwise(0.0).alias("mrr_10"), F.when(some, F.col("dcg") / ideal).otherwise(0.0).alias("ndcg_10"), above.alias("stale_above"),
    )


def block_recall(hits: DataFrame, gold_blocks: DataFrame, top: int = 5) -> DataFrame:
    """qid, block_recall: the share of gold blocks (qid, block_id) among the evidence of the first hits; queries without gold have no row."""
    got = hits.filter(F.col("rank") <= top).select("qid", F.explode(F.split("blocks", ",")).alias("block_id")).distinct().withColumn("in_", F.lit(1))
    return gold_blocks.join(got, ["qid", "block_id"], "left").groupBy("qid").agg((F.count("in_") / F.count("*")).alias("block_recall"))


def mean_where_known(df: DataFrame, *columns: str) -> DataFrame:
    """One row: the mean of each column over its values of 0 or more, and their number."""
    out = []
    for c in columns:
        v = F.when(F.col(c) >= 0, F.col(c))
        out += [F.round(F.avg(v), 4).alias(c), F.count(v).alias(f"{c}_n")]
    return df.agg(*out)


def rate(flag: Column) -> Column:
    """Mean of a boolean, null without rows."""
    return F.round(F.avg(flag.cast("double")), 4)


def percentiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Per group: values at the nearest rank round(p * (n - 1)), by name. Half ranks go to the even one.

    Equal values are counted before they are put in order, so a group costs one row per distinct value.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*by).orderBy(value)
    total = F.sum("c").over(Window.partitionBy(*by))
    upto = counts.withColumn("to", F.sum("c").over(w)).withColumn("n", total)
    at = lambda p: F.bround(F.lit(p) * (F.col("n") - 1), 0)
    return upto.groupBy(*by).agg(F.max("n").alias("n"), *(F.min(F.when(F.col("to") > at(p), F.col(value))).alias(name) for name, p in shares.items()))


def distribution(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Per group: n, least, p05, p50, p95, p99, most and mean."""
    p = percentiles(df, by, value, {"p05": 0.05, "p50": 0.5, "p95": 0.95, "p99": 0.99})
    a = df.filter(F.col(value).isNotNull()).groupBy(*by).agg(F.min(value).alias("least"), F.max(value).alias("most"), F.avg(value).alias("mean"))
    return p.join(a, by) if by else p.crossJoin(a)  # one row each


def _by_score(df: DataFrame, score: str, positive: str) -> DataFrame:
    return df.groupBy(F.col(score).alias("score")).agg(F.count_if(F.col(positive)).alias("pos"), F.count_if(~F.col(positive)).alias("neg"))


def running(df: DataFrame, order: Column, *columns: str) -> DataFrame:
    """`df` with a running total (to the row, inclusive) of each column by `order`, whose values are distinct, without one task for all rows.

    Rows are dealt to tasks by ranges of the order; a total is what lies in the ranges before plus what lies before in its own. Only one
    row of sums for each range goes over the driver.
    """
    ranged = cut(df.repartitionByRange(order).withColumn("range_", F.spark_partition_id()))
    sums = ranged.groupBy("range_").agg(*(F.sum(c).alias(c) for c in columns)).orderBy("range_").collect()
    starts, at = [], [0] * len(columns)
    for row in sums:
        starts.append((row[0], *at))
        at = [x + y for x, y in zip(at, row[1:], strict=True)]
    before = df.sparkSession.createDataFrame(starts, "range_ int" + "".join(f", before_{c} bigint" for c in columns))
    own = Window.partitionBy("range_").orderBy(order)
    joined = ranged.join(F.broadcast(before), "range_")  # one row a range
    return joined.select(*df.columns, *((F.col(f"before_{c}") + F.sum(c).over(own)).alias(f"{c}_upto") for c in columns))


def auc(df: DataFrame, score: str, positive: str) -> DataFrame:
    """One row: the chance that a positive row has the higher score than a negative one, ties half. One sort of the distinct scores."""
    s = running(_by_score(df, score, positive), F.col("score"), "neg")
    return s.agg((F.sum(F.col("pos") * (F.col("neg_upto") - F.col("neg") * 0.5)) / (F.sum("pos") * F.sum("neg"))).alias("auc"))


def roc(df: DataFrame, score: str, positive: str) -> DataFrame:
    """threshold, tpr, fpr at each distinct score (accepted from the threshold on)."""
    s = _by_score(df, score, positive)
    up = running(s, F.desc("score"), "pos", "neg").crossJoin(F.broadcast(s.agg(F.sum("pos").alias("np"), F.sum("neg").alias("nn"))))  # one row
    return up.select(F.col("score").alias("threshold"), (F.col("pos_upto") / F.col("np")).alias("tpr"), (F.col("neg_upto") / F.col("nn")).alias("fpr"))


def best_threshold(curve: DataFrame, most_fpr: float = 0.05) -> DataFrame:
    """The point of highest tpr whose fpr is small enough; of equal ones the highest threshold."""
    return curve.filter(F.col("fpr") <= most_fpr).orderBy(F.desc("tpr"), F.desc("threshold")).limit(1)


def rrf(*rankings: DataFrame, k: int = 60) -> DataFrame:
    """qid, page_id, score, rank of several rankings (qid, rank, page_id): sums of 1 / (k + rank)."""
    every = rankings[0].select("qid", "rank", "page_id")
    for r in rankings[1:]:
        every = every.unionByName(r.select("qid", "rank", "page_id"))
    s = every.groupBy("qid", "page_id").agg(F.sum(1 / (k + F.col("rank"))).alias("score"))
    return s.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(F.round("score", 12)), "page_id")))


def append_unless_confident(first: DataFrame, second: DataFrame, top: int = 10, least: float = 3.0, margin: float = 0.15) -> DataFrame:
    """The first ranking where its best score is high and well ahead of the second best, else with the other's new hits behind it.

    Rankings are (qid, rank, page_id, score)."""
    s = first.groupBy("qid").agg(F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("a"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("b"), F.max("rank").alias("n"))
    sure = s.withColumn("sure", (F.col("a") >= least) & ((F.col("a") - F.coalesce("b", F.lit(0.0))) / F.col("a") >= margin))
    new = second.join(first.select("qid", "page_id"), ["qid", "page_id"], "left_anti").join(sure, "qid", "left").filter("sure IS NULL OR NOT sure")
    new = new.withColumn("order_", F.row_number().over(Window.partitionBy("qid").orderBy("rank")) + F.coalesce("n", F.lit(0)))
    every = first.select("qid", "rank", "page_id").unionByName(new.select("qid", F.col("order_").alias("rank"), "page_id"))
    return every.filter(F.col("rank") <= top)


def context_metrics(contexts: DataFrame, gold: DataFrame) -> DataFrame:
    """One row from contexts (qid, text, top) and gold (qid, slug): gold_injected, top1, unrelated_bytes, unrelated_silent."""
    lines = F.filter(F.split("text", "\n"), lambda x: x.startswith("B "))
    slugs = F.array_distinct(F.transform(lines, lambda x: F.substring_index(F.substring(x, 3, F.length(x)), "#", 1)))
    g = gold.groupBy("qid").agg(F.collect_set("slug").alias("gold"))
    c = contexts.join(g, "qid", "left").withColumn("slugs", F.coalesce(slugs, F.array().cast("array<string>")))
    known = F.col("gold").isNotNull()
    return c.agg(
        F.count_if(known).alias("answerable"), F.count_if(~known).alias("unrelated"), rate(F.when(known, F.arrays_overlap("slugs", "gold"))).alias("gold_injected"),
        rate(F.when(known, F.array_contains("gold", F.col("top")))).alias("top1"), F.round(F.avg(F.when(~known, F.octet_length("text"))), 1).alias("unrelated_bytes"), rate(F.when(~known, F.col("text") == "")).alias("unrelated_silent"),
    )


def recency(scores: DataFrame, pages: DataFrame, weight: float = 0.02) -> DataFrame:
    """`scores` (qid, page_id, score) with a bonus for the place of a page's date among the distinct dates."""
    days = running(pages.select("updated").distinct().withColumn("one", F.lit(1)), F.col("updated"), "one")
    place = days.crossJoin(F.broadcast(days.agg(F.count("*").alias("n"))))  # one row
    place = place.select("updated", ((F.col("one_upto") - 1) / F.greatest(F.col("n") - 1, F.lit(1))).alias("q"))
    return scores.join(pages.select("page_id", "updated"), "page_id").join(place, "updated").select("qid", "page_id", (F.col("score") + weight * F.col("q")).alias("score"))


def delivered(questions: DataFrame, payloads: DataFrame, shown: DataFrame, blocks: DataFrame, chars: int = 240) -> DataFrame:
    """One row per question: what of its gold, and of what is out of date, its payload holds.

    questions: qid, gold_pages, gold_blocks, stale_pages (arrays, null as empty), span (the answer's words, or null); payloads: qid, text; shown: what a
    payload claims to hold (qid, page_id, block_id, body, status); blocks: page_id, block_id, text. A block is in a payload if its first `chars`
    characters are. stale_body and stale_leak (a page out of date that isn't marked so) are null for questions without stale pages.
    """
    none = F.array().cast("array<string>")
    q = questions.join(payloads.select("qid", "text"), "qid", "left").withColumn("flat", T.squeezed(F.coalesce("text", F.lit(""))))
    keys = blocks.select("page_id", "block_id", T.clip("text", chars).alias("key")).filter("key <> ''")
    listed = shown.filter("block_id IS NOT NULL").groupBy("qid", "block_id").agg(F.max("body").alias("body"))
    gold = q.select("qid", "flat", F.explode(F.array_distinct("gold_blocks")).alias("block_id")).join(keys.drop("page_id"), "block_id", "left").join(listed, ["qid", "block_id"], "left")
    seen, claimed = F.coalesce(F.contains("flat", "key"), F.lit(False)), F.coalesce("body", F.lit(False))
    gold = gold.groupBy("qid").agg(F.count_if(seen & claimed).alias("gold_hits"), F.count_if(seen != claimed).alias("mismatch"), F.every(seen & claimed).alias("gold_block"), F.every(F.col("body").isNotNull()).alias("gold_addr"))
    paged = q.select("qid", F.explode("gold_pages").alias("page_id")).join(shown.select("qid", "page_id"), ["qid", "page_id"], "left_semi").select("qid").distinct().withColumn("gold_page", F.lit(True))
    old = q.select("qid", "flat", F.explode("stale_pages").alias("page_id")).join(keys, "page_id").filter(F.contains("flat", "key")).select("qid", "page_id").distinct()
    marked = shown.filter("status = 'superseded'").select("qid", "page_id").distinct().withColumn("marked", F.lit(True))
    old = old.join(marked, ["qid", "page_id"], "left").groupBy("qid").agg(F.lit(True).alias("stale"), F.bool_or(F.col("marked").isNull()).alias("leak"))
    rows = q.join(gold, "qid", "left").join(paged, "qid", "left").join(old, "qid", "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    dated = F.size(F.coalesce("stale_pages", none)) > 0
    span = T.squeezed(F.coalesce("span", F.lit("")))
    return rows.select(
        "qid", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("payload_bytes"), yes("gold_page").alias("gold_page"), yes("gold_block").alias("gold_block"), yes("gold_addr").alias("gold_addr"),
        F.coalesce("gold_hits", F.lit(0)).alias("gold_hits"), F.coalesce("mismatch", F.lit(0)).alias("mismatch"), ((span != "") & F.contains("flat", span)).alias("answer"),
        F.when(dated, yes("stale")).alias("stale_body"), F.when(dated, yes("leak")).alias("stale_leak"),
    )


def delivery_rates(judged: DataFrame) -> DataFrame:
    """One row from the rows of `delivered`: rates, and what a hit costs in bytes."""
    flags = ("gold_page", "gold_block", "gold_addr", "answer", "stale_body", "stale_leak")
    return judged.agg(
        F.count("*").alias("n"), rate(F.col("payload_bytes") > 0).alias("injected"), *(rate(F.col(c)).alias(c) for c in flags), F.sum("mismatch").alias("mismatch"),
        F.round(F.avg("payload_bytes"), 1).alias("bytes_mean"), F.round(F.try_divide(F.sum("payload_bytes"), F.sum("gold_hits")), 1).alias("bytes_per_hit"),
    )
