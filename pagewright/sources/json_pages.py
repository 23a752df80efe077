"""Canonical pages as JSON files (one page or an array of pages each), their log, and other files of a knowledge base."""

from __future__ import annotations

import fnmatch
import posixpath

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.plans.cut import cut
from pagewright.sources.tables import KnowledgeBase

BLOCK = "struct<id:string,kind:string,data:struct<level:int,text:string,statement:string,language:string,ordered:boolean,items:array<string>,rows:array<array<string>>,owner:string,due:string>,refs:array<string>,source_text:string,fingerprint:string,resolution:struct<status:string,current:string,decided_at:string>>"
LINK = "struct<target:string,label:string,anchor:string,kind:string,block_id:string>"
PAGE = (
    "schema_version string, id string, slug string, title string, type string, created string, updated string, tags array<string>, keywords array<string>, projects array<string>, sources array<string>, "
    f"raw_ref string, summary string, blocks map<string,{BLOCK}>, block_order array<string>, block_aliases map<string,string>, links array<{LINK}>, "
    "history array<struct<at:string,action:string,actor:string,note:string>>, source_snapshot struct<format:string,text:string,sha256:string>"
)


def read_pages(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Columns of PAGE, with file (path), sha256 of the file's text. Files whose names begin with a dot are left out.

    `strict` fails on a file that isn't JSON; else such files, and pages without id or blocks, are skipped.
    """
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "[!.]*.json").text(path).select("value", F.col("_metadata.file_path").alias("file"))
    array = F.when(F.ltrim("value").startswith("["), F.col("value")).otherwise(F.concat(F.lit("["), "value", F.lit("]")))
    options = {"mode": "FAILFAST" if strict else "PERMISSIVE"}
    rows = files.select("file", F.sha2("value", 256).alias("sha256"), F.explode(F.from_json(array, f"array<struct<{_fields()}>>", options)).alias("p")).select("p.*", "file", "sha256")
    return rows if strict else rows.filter("id IS NOT NULL AND blocks IS NOT NULL")


def _fields() -> str:
    return ", ".join(x.replace(" ", ":", 1) for x in PAGE.split(", "))


def block_text(block: Column) -> Column:
    """What a block says: data.text, else data.statement, else its source."""
    pick = lambda c: F.when(F.trim(c) != "", c)
    return F.coalesce(pick(block["data"]["text"]), pick(block["data"]["statement"]), block["source_text"], F.lit(""))


def knowledge_base(pages: DataFrame) -> KnowledgeBase:
    """Pages, blocks in order and declared links of canonical pages."""
    none = F.array().cast("array<string>")
    p = pages.select(F.col("id").alias("page_id"), "slug", F.coalesce("title", F.lit("")).alias("title"), "type", "created", "updated", *(F.coalesce(c, none).alias(c) for c in ("tags", "keywords", "projects", "sources")), "summary")
    order = F.coalesce("block_order", F.map_keys("blocks"))
    b = pages.select(F.col("id").alias("page_id"), "blocks", F.posexplode(order).alias("pos", "key")).withColumn("b", F.col("blocks")[F.col("key")]).filter("b IS NOT NULL")
    unresolved = (F.col("b.kind") == "conflict") & ~F.col("b.resolution.status").eqNullSafe("resolved")
    blocks = b.select("page_id", "pos", F.coalesce("b.id", "key").alias("block_id"), "b.kind", block_text(F.col("b")).alias("text"), "b.data.level", F.coalesce(unresolved, F.lit(False)).alias("unresolved"))
    links = pages.select(F.col("id").alias("page_id"), F.posexplode("links").alias("ord", "l")).select("page_id", "ord", "l.target", F.coalesce("l.kind", F.lit("wiki")).alias("kind"), "l.label", "l.anchor", F.coalesce("l.block_id", F.lit("")).alias("block_id"))
    return KnowledgeBase(p, blocks, links)


def write_pages(pages: DataFrame, path: str, shards: int = 64) -> None:
    """One JSON line per page below shard folders; only the folders of the pages given are replaced."""
    rows = pages.drop("file", "sha256")
    keyed = rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    keyed.repartition("shard").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").json(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """What `write_pages` and `update_pages` wrote."""
    return spark.read.schema(PAGE).json(path).filter("id IS NOT NULL").drop("shard")


def update_pages(spark: SparkSession, path: str, changed: DataFrame, removed: DataFrame, shards: int = 64) -> None:
    """Brings the shards of `write_pages` up to date: changed pages replace those of their id, removed ones (id) go; other shards aren't read.

    A shard that loses its last page keeps a row without id, which isn't read back.
    """
    of = lambda d: d.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    gone = changed.select("id").union(removed.select("id")).distinct()
    touched = sorted(r[0] for r in of(gone).select("shard").distinct().collect())  # as many numbers as there are shards
    if not touched:
        return
    old = spark.read.schema(PAGE + ", shard int").json(path).filter(F.col("shard").isin(touched) & F.col("id").isNotNull())
    none = spark.createDataFrame([(None, i) for i in touched], "id string, shard int")
    rows = old.join(gone, "id", "left_anti").unionByName(of(changed.drop("file", "sha256")), allowMissingColumns=True).unionByName(none, allowMissingColumns=True)
    cut(rows).repartition("shard").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("ignoreNullFields", "false").partitionBy("shard").json(path)


def inside(root: str, rel: str) -> str:
    """The path of a file below `root`; an error where `rel` leads out of it."""
    at = posixpath.normpath(rel.replace("\\", "/"))
    if at.startswith(("/", "../")) or at in (".", ".."):
        raise ValueError(f"{rel}: not below {root}")
    return posixpath.join(root, at)


def read_file(spark: SparkSession, root: str, rel: str) -> DataFrame:
    """The pages of one file below `root`; no other file is opened."""
    return read_pages(spark, inside(root, rel))


def file_states(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """path, modified, length of files, without reading them."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", F.col("modificationTime").alias("modified"), "length")


def newest(files: DataFrame) -> DataFrame:
    return files.agg(F.max("modified").alias("newest"))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """path, sha256 of whole files."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.sha2("content", 256).alias("sha256"))


def raw_files(files: DataFrame, root: str, ignore: list[str] = ()) -> DataFrame:
    """rel of files below `root` that aren't hidden and match none of the globs (on the path, its tail or the name)."""
    rel = F.regexp_replace("path", "^.*?" + root.rstrip("/").replace(".", "\\.") + "/", "")
    rows = files.select(rel.alias("rel")).filter(~F.col("rel").rlike("(^|/)\\."))
    for g in ignore:
        pattern = fnmatch.translate(g).removesuffix("\\z").removesuffix("\\Z")
        rows = rows.filter(~(F.col("rel").rlike(f"^{pattern}$") | F.substring_index("rel", "/", -1).rlike(f"^{pattern}$") | F.regexp_replace("rel", "^[^/]+/", "").rlike(f"^{pattern}$")))
    return rows


def pending(raw: DataFrame, refs: DataFrame) -> DataFrame:
    """Raw files (rel) that no reference (ref) names, by its whole path or by its end. References are cut into all their ends, so the join is on equal keys."""
    parts = F.split(F.regexp_replace("ref", "^(?:raw:)?(?:\\./)?", ""), "/")
    ends = refs.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("rel")).distinct()
    return raw.join(ends, "rel", "left_anti")


def append_log(entries: DataFrame, path: str) -> None:
    entries.write.mode("append").json(path)


def read_log(spark: SparkSession, path: str, last: int = 0) -> DataFrame:
    """The log's entries, all or the last ones in the order in which they came: by time, then by the place where they were appended."""
    log = spark.read.json(path)
    if last <= 0:
        return log
    place = [F.col("at"), F.col("_metadata.file_modification_time").alias("w_"), F.col("_metadata.file_path").alias("f_"), F.col("_metadata.file_block_start").alias("b_"), F.monotonically_increasing_id().alias("i_")]
    order = ["at", "w_", "f_", "b_", "i_"]
    rows = log.select(*(c for c in log.columns if c != "at"), *place)
    return rows.orderBy(*map(F.desc, order)).limit(last).orderBy(*order).select(*log.columns)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """q, gold (array of slugs) of a JSON array whose gold_slug is a string, an array or null."""
    q = spark.read.option("wholetext", True).text(path).select(F.explode(F.from_json("value", "array<struct<q:string,gold_slug:string>>")).alias("x")).select("x.*")
    many = F.from_json("gold_slug", "array<string>")
    gold = F.when(F.col("gold_slug").isNull(), F.array().cast("array<string>")).when(F.col("gold_slug").startswith("["), many).otherwise(F.array("gold_slug"))
    return q.select(F.trim("q").alias("q"), F.transform(gold, lambda g: F.regexp_replace(F.trim(g), "^page:", "")).alias("gold"))


def find_pages(pages: DataFrame, selectors: DataFrame) -> DataFrame:
    """selector, page_id: by id or slug as written, else by the key of id, slug or title; selectors are a small set of rows."""
    exact = pages.select("page_id", F.explode(F.array_distinct(F.array("page_id", "slug"))).alias("selector"))
    s = selectors.select("selector").distinct()
    first = s.join(exact, "selector").groupBy("selector").agg(F.min("page_id").alias("page_id"), F.lit(0).alias("prio"))
    from pagewright.operators.links import lookup

    loose = s.withColumn("key", T.link_key("selector")).join(lookup(pages), "key").select("selector", F.col("dst").alias("page_id"), F.lit(1).alias("prio"))
    return first.select("selector", "page_id", "prio").unionByName(loose).groupBy("selector").agg(F.min_by("page_id", "prio").alias("page_id"))


def find_blocks(blocks: DataFrame, aliases: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted, block_id: by id, by alias (old_id, block_id), or by the end of the id; of several the first by page and place."""
    by_id = blocks.select("page_id", "pos", "block_id", F.col("block_id").alias("wanted"), F.lit(0).alias("prio"))
    by_alias = aliases.join(blocks, "block_id").select("page_id", "pos", "block_id", F.col("old_id").alias("wanted"), F.lit(1).alias("prio"))
    tail = F.split("block_id", ":")
    ends = blocks.select("page_id", "pos", "block_id", F.explode(F.array(F.array_join(F.slice(tail, 3, 2), ":"), F.element_at(tail, 3))).alias("wanted"), F.lit(2).alias("prio"))
    every = by_id.unionByName(by_alias).unionByName(ends).join(wanted.select("wanted").distinct(), "wanted")
    return every.groupBy("wanted").agg(F.min_by("block_id", F.struct("prio", "page_id", "pos")).alias("block_id"))


def outline(blocks: DataFrame) -> DataFrame:
    """page_id, block_id, level, text, pos of headings."""
    return blocks.filter("kind = 'heading'").select("page_id", "block_id", F.coalesce("level", F.lit(2)).alias("level"), "text", "pos")


def sections(blocks: DataFrame) -> DataFrame:
    """heading_id, page_id, pos, block_id: for each heading its own block and those up to the next heading of its level or a higher one."""
    heads = blocks.filter("kind = 'heading'").select("page_id", F.col("block_id").alias("heading_id"), F.col("pos").alias("from_"), F.coalesce("level", F.lit(2)).alias("l"))
    w = Window.partitionBy("page_id").orderBy("from_").rowsBetween(1, Window.unboundedFollowing)
    levels = [F.min(F.when(F.col("l") <= n, F.col("from_"))).over(w).alias(f"e{n}") for n in range(1, 7)]
    ends = heads.select("page_id", "heading_id", "from_", "l", *levels)
    end = F.lit(None).cast("int")
    for n in range(1, 7):
        end = F.when(F.col("l") == n, F.col(f"e{n}")).otherwise(end)
    ranges = ends.select("page_id", "heading_id", "from_", end.alias("to_"))
    return ranges.join(blocks.select("page_id", "pos", "block_id"), "page_id").filter("pos >= from_ AND (to_ IS NULL OR pos < to_)").select("heading_id", "page_id", "pos", "block_id")


def _part(variant: Column, step: str) -> Column:
    """The value of a key, or the item of a number; null where there is none."""
    if "'" in step or "\\" in step:  # paths know no escapes
        inner = F.try_variant_get(variant, "$", "map<string,variant>")[step]
    else:
        inner = F.try_variant_get(variant, f"$['{step}']", "variant")
    return F.coalesce(F.try_variant_get(variant, f"$[{step}]", "variant"), inner) if step.isdecimal() else inner


def pointer(variant: Column, path: str) -> Column:
    """The part of a variant column that a JSON pointer names; null where there is none."""
    steps = [x.replace("~1", "/").replace("~0", "~") for x in path.lstrip("/").split("/")] if path not in ("", "/") else []
    for s in steps:
        variant = _part(variant, s)
    return variant


def picked(variant: Column, fields: list[str]) -> Column:
    """The part of a variant column that a list of fields leads to: keys of objects, or numbers of items. An error where there is none."""
    for f in fields:
        inner = _part(variant, f)
        variant = F.when(inner.isNotNull(), inner).otherwise(F.raise_error(F.lit(f"no field {f}")))
    return variant


def plain_ref(ref) -> Column:
    """A reference as a path below the store: slashes one way, without source: and leading ./"""
    blank = "^\\s+|\\s+$"
    path = F.replace(F.regexp_replace(ref, blank, ""), F.lit("\\"), F.lit("/"))
    return F.regexp_replace(F.regexp_replace(path, "^source:", ""), "^(?:\\./)+|" + blank, "")


def raw_refs(pages: DataFrame, column: str = "page") -> DataFrame:
    """page_id, ref: all raw files that pages (a column of JSON) name as their origin, in raw_ref, their snapshot, their history or their sources."""
    v = F.try_parse_json(column)
    said = lambda x: F.when(F.schema_of_variant(x) == "STRING", x.cast("string"))
    at = lambda x, key: said(F.try_variant_get(x, f"$.{key}", "variant"))
    many = lambda key: F.coalesce(F.try_variant_get(v, f"$.{key}", "array<variant>"), F.array().cast("array<variant>"))
    own = F.array(at(v, "raw_ref"), *(at(v, f"source_snapshot.{k}") for k in ("raw_ref", "path", "source")))
    past = F.flatten(F.transform(many("history"), lambda e: F.array(*(at(e, k) for k in ("note", "raw", "raw_ref", "source")))))
    refs = F.transform(F.array_compact(F.concat(own, past, F.transform(many("sources"), said))), plain_ref)
    return pages.select(F.try_variant_get(v, "$.id", "string").alias("page_id"), F.explode(F.array_distinct(refs)).alias("ref")).filter("ref <> ''")


def follow_current(pages: DataFrame) -> DataFrame:
    """Canonical pages whose decisions name the block that stands now where they name an old id of it."""
    here = F.map_keys("blocks")

    def moved(block: Column) -> Column:
        current = block["resolution"]["current"]
        live = F.when(F.array_contains(here, current), current).otherwise(F.col("block_aliases")[current])
        return F.when(F.array_contains(here, live) & (live != current), block.withField("resolution.current", live)).otherwise(block)

    return pages.withColumn("blocks", F.transform_values("blocks", lambda _, b: moved(b)))
