"""Projections of a knowledge base: catalog, map, graph with layout, routes and stats."""

from __future__ import annotations

import hashlib
import math
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.functions import fixed
from pagewright.functions import text as T


def project_groups(projects: list[str], groups: dict | None = None) -> dict:
    """`groups` ({key: {label, color, match}}) with one for each project that none matches, reserved ones last. Configuration, not data."""
    groups = dict(groups or {})
    known = {m.strip().lower() for k, g in groups.items() if k not in fixed.RESERVED_GROUPS for m in g.get("match", [])}
    used = {g.get("color") for g in groups.values()}
    new: dict = {}
    for p in sorted({p.strip() for p in projects if p and p.strip()}):
        if p.lower() in known:
            continue
        known.add(p.lower())
        digest = hashlib.sha256(p.encode()).hexdigest()[:8]
        key = re.sub("[^a-zA-Z0-9가-힣._-]+", "-", p.lower()).strip("-._") or f"project-{digest}"
        key = f"{key}-{digest}" if key in groups or key in new else key
        colour = next((c for c in fixed.GROUP_COLOURS if c not in used), fixed.GROUP_COLOURS[len(new) % len(fixed.GROUP_COLOURS)])
        used.add(colour)
        new[key] = {"label": p.upper() if re.fullmatch("[A-Za-z0-9._-]{1,12}", p) else p, "color": colour, "match": [p]}
    reserved = {k: groups.pop(k) for k in fixed.RESERVED_GROUPS if k in groups}
    return groups | new | reserved


def group_table(spark: SparkSession, groups: dict) -> DataFrame:
    """group_key, ord, match (lower case) of a configuration: as many rows as it has entries."""
    rows = [(k, i, m.strip().lower()) for i, (k, g) in enumerate(groups.items()) for m in g.get("match") or [""]]
    return spark.createDataFrame(rows or [("ungrouped", 0, "")], "group_key string, ord int, match string")


def page_groups(pages: DataFrame, groups: DataFrame) -> DataFrame:
    """page_id, group: multi with several projects, else the first group that matches, else ungrouped."""
    own = pages.select("page_id", F.filter(F.transform("projects", lambda p: F.lower(F.trim(p))), lambda p: p != "").alias("p"))
    usable = F.broadcast(groups.filter(~F.col("group_key").isin(*fixed.RESERVED_GROUPS)))  # the configuration
    hit = own.filter("size(p) = 1").withColumn("match", F.col("p")[0]).join(usable, "match").groupBy("page_id").agg(F.min_by("group_key", "ord").alias("g"))
    return own.join(hit, "page_id", "left").select("page_id", F.when(F.size("p") > 1, "multi").otherwise(F.coalesce("g", F.lit("ungrouped"))).alias("group"))


def routes(grouped: DataFrame, groups: DataFrame) -> DataFrame:
    """group, page_id of every configured group; one without pages has a row without a page."""
    return groups.select(F.col("group_key").alias("group")).distinct().join(grouped, "group", "left").select("group", "page_id")


def layout(grouped: DataFrame, groups: DataFrame) -> DataFrame:
    """page_id, group, x, y: a disk whose sectors are the groups, in which pages lie on a golden spiral by id.

    Places within a group come from ranges of ids that are counted first, so that no task orders a whole group.
    """
    g = grouped.withColumn("range_", F.substring_index("page_id", "-", -1).substr(1, 2))
    counts = g.groupBy("group", "range_").agg(F.count("*").alias("c"), F.min("page_id").alias("lo"), F.max("page_id").alias("hi"))
    # ranges of leading digits are in the order of the ids only if they don't overlap; where they do, the group is one range
    w = Window.partitionBy("group").orderBy("lo")
    clash = counts.withColumn("over", F.col("lo") <= F.lag("hi").over(w)).groupBy("group").agg(F.coalesce(F.max("over"), F.lit(False)).alias("clash"))
    g = g.join(clash, "group").withColumn("range_", F.when(F.col("clash"), "").otherwise(F.col("range_")))
    counts = g.groupBy("group", "range_").agg(F.count("*").alias("c"), F.min("page_id").alias("lo"))
    before = counts.withColumn("before", F.coalesce(F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("group", "range_", "before")
    placed = g.withColumn("r", F.row_number().over(Window.partitionBy("group", "range_").orderBy("page_id"))).join(before, ["group", "range_"]).withColumn("i", F.col("before") + F.col("r") - 1)
    order = groups.groupBy(F.col("group_key").alias("group")).agg(F.min("ord").alias("ord"))
    sizes = grouped.groupBy("group").agg(F.count("*").alias("n")).join(order, "group", "left")
    seq = Window.orderBy(F.col("ord").asc_nulls_last(), "group")  # one row per group
    sizes = sizes.withColumn("start", F.coalesce(F.sum("n").over(seq.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("all_", F.sum("n").over(Window.partitionBy()))
    p = placed.join(F.broadcast(sizes), "group")  # one row per group
    span = 2 * math.pi * F.col("n") / F.col("all_")
    pad = F.least(F.lit(0.035), span * 0.04)
    turn = F.col("i") * fixed.GOLDEN
    angle = -math.pi / 2 + 2 * math.pi * F.col("start") / F.col("all_") + pad + (span - 2 * pad) * (turn - F.floor(turn))
    radius = fixed.LAYOUT_RADIUS * F.sqrt((F.col("i") + 0.72) / (F.col("n") + 0.72))
    return p.select("page_id", "group", F.round(radius * F.cos(angle), 6).alias("x"), F.round(radius * F.sin(angle), 6).alias("y"))


def catalog(pages: DataFrame) -> DataFrame:
    joined = lambda c: F.array_join(c, ",").alias(c)
    return pages.select("page_id", "slug", "title", "type", "updated", joined("projects"), joined("tags"), joined("sources"), "summary")


def map_rows(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """id, page_id, pointer, kind, data_url of pages and blocks."""
    url = F.concat(F.lit("pages/"), T.safe_name("page_id"))
    p = pages.select(F.col("page_id").alias("id"), "page_id", F.lit("").alias("pointer"), F.lit("page").alias("kind"), url.alias("data_url"))
    return p.unionByName(blocks.select(F.col("block_id").alias("id"), "page_id", F.concat(F.lit("/blocks/"), "block_id").alias("pointer"), "kind", url.alias("data_url")))


def stats(pages: DataFrame, blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: pages, blocks, edges, unresolved_conflicts."""
    b = blocks.agg(F.count("*").alias("blocks"), F.count_if("unresolved").alias("unresolved_conflicts"))
    return pages.agg(F.count("*").alias("pages")).crossJoin(b).crossJoin(edges.agg(F.count("*").alias("edges"))).select("pages", "blocks", "edges", "unresolved_conflicts")  # one row each


def map_root(page_hashes: DataFrame) -> DataFrame:
    """One row: a digest of all (page_id, sha256), whatever their order."""
    return page_hashes.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("page_id", "sha256").cast("decimal(38,0)")), F.lit(0)).cast("string").alias("root"))
