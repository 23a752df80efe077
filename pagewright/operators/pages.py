"""Pages from Markdown, ingestion and edits: canonical pages in, canonical pages out, one Arrow pass each."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.functions import fixed, markdown, redact
from pagewright.sources import json_pages


def summary_of(blocks: list[dict], limit: int = 280) -> str:
    """The first body block that says something, a table only if there is nothing else; cut behind a word."""
    body = [b for b in blocks if b["kind"] not in ("heading", "thematic_break", "code")]
    for b in sorted(body, key=lambda b: b["kind"] == "table"):
        t = markdown.LINK.sub(lambda m: markdown.norm(m[3]) or markdown.norm(m[1]), markdown.norm(b["data"].get("text") or b["source_text"]))
        t = " ".join(re.sub(r"[*`#|]", "", re.sub(r"(?m)^\s*(?:[-*+]|\d+\.)\s+", "", t)).split())
        if t:
            at = t.rfind(" ", 0, limit + 1)
            return t if len(t) <= limit else (t[:at] if at > 0 else t[:limit]).rstrip()
    return ""


def page_of(stem: str, text: str, today: str) -> dict:
    """The canonical page of a Markdown file: slug from its name, title from its first heading, the rest from its head."""
    head, body = markdown.frontmatter(text)
    slug = re.sub(r"[\s_]+", "-", markdown.norm(stem)).strip("-")
    blocks = markdown.parse(f"page:{slug}", body)
    names = lambda k: list(dict.fromkeys(filter(None, map(markdown.norm, head.get(k) if isinstance(head.get(k), list) else str(head.get(k) or "").split(",")))))
    sources = [s if ":" in s else f"page:{s}" for s in names("sources")]
    title = next((b["data"]["text"] for b in blocks if b["kind"] == "heading" and b["data"]["level"] == 1), slug)
    links = [
        {"target": markdown.norm(m[1]), "label": markdown.norm(m[3]) or markdown.norm(m[1]), "anchor": markdown.norm(m[2]), "kind": "wiki", "block_id": b["id"]}
        for b in blocks for m in markdown.LINK.finditer(b["source_text"]) if markdown.link_key(m[1])
    ]
    links += [{"target": t, "label": t, "anchor": "", "kind": k, "block_id": ""} for k in ("supersedes", "related") for t in names(k)]
    return {
        "schema_version": fixed.SCHEMA_VERSION, "id": f"page:{slug}", "slug": slug, "title": title, "type": str(head.get("type") or "source"), "created": str(head.get("created") or today), "updated": str(head.get("updated") or today),
        "tags": names("tags"), "keywords": names("keywords"), "projects": names("projects"), "sources": sources, "raw_ref": head.get("raw") or None, "summary": markdown.frontmatter_scalar(text, "summary") or summary_of(blocks),
        "blocks": {b["id"]: b for b in blocks}, "block_order": [b["id"] for b in blocks], "links": links, "history": [{"at": today, "action": "created", "actor": "ingest"}],
        "source_snapshot": {"format": "markdown", "text": text},
    }


def keep_ids(old: dict, new: dict, today: str) -> dict:
    """`new` with the ids that equal blocks had in `old`, its aliases, states and first date."""
    left: dict[str, list[str]] = {}
    for i in old["block_order"]:
        left.setdefault(old["blocks"][i]["fingerprint"], []).append(i)
    renamed = {i: (left[p].pop(0) if left.get(p := new["blocks"][i]["fingerprint"]) else i) for i in new["block_order"]}
    blocks = {}
    for i in new["block_order"]:
        b = new["blocks"][i] | {"id": renamed[i]}
        before = old["blocks"].get(renamed[i])
        if before and before.get("resolution"):
            b["resolution"] = before["resolution"]
        blocks[renamed[i]] = b
    aliases = {k: v for k, v in (old.get("block_aliases") or {}).items() if v in blocks}
    links = [x | {"block_id": renamed.get(x["block_id"], x["block_id"])} for x in new["links"]]
    history = [*old.get("history", []), {"at": today, "action": "updated", "actor": "ingest"}]
    return new | {"blocks": blocks, "block_order": [renamed[i] for i in new["block_order"]], "block_aliases": aliases, "links": links, "created": old["created"], "updated": today, "history": history}


def edited(page: dict, block_id: str, fragment: str, today: str) -> dict:
    """A page with one block replaced by the blocks of a Markdown fragment (none removes it).

    The first new block of the same kind, else the first one, takes the place of the old id, which stays as an alias; aliases never
    point at aliases.
    """
    aliases = dict(page.get("block_aliases") or {})
    live = block_id if block_id in page["blocks"] else aliases.get(block_id)
    if live not in page["blocks"]:
        raise ValueError(f"{page['id']}: no block {block_id}")
    old = page["blocks"][live]
    taken = {i for i in page["blocks"] if i != live}
    new = []
    for b in markdown.parse(page["id"], fragment):
        stem, n = b["id"].rsplit(":", 1)
        while f"{stem}:{n}" in taken:
            n = str(int(n) + 1)
        taken.add(f"{stem}:{n}")
        new.append(b | {"id": f"{stem}:{n}"})
    heir = next((b["id"] for b in new if b["kind"] == old["kind"]), new[0]["id"] if new else None)
    order = [x for i in page["block_order"] for x in ([b["id"] for b in new] if i == live else [i])]
    blocks = {i: next((b for b in new if b["id"] == i), page["blocks"].get(i)) for i in order}
    if heir != live:
        aliases = {k: (heir if v == live else v) for k, v in aliases.items()} | ({live: heir} if heir else {})
    aliases = {k: v for k, v in aliases.items() if v in blocks and k not in blocks}
    links = [x for x in page["links"] if x["kind"] != "wiki" or x.get("block_id") != live]
    links = [x | {"block_id": heir or ""} if x.get("block_id") == live else x for x in links]
    links += [{"target": t, "label": t, "anchor": "", "kind": "wiki", "block_id": b["id"]} for b in new for t in b["refs"]]
    title = page["title"]
    if old["kind"] == "heading" and old["data"].get("text") == title and heir and blocks[heir]["kind"] == "heading":
        title = blocks[heir]["data"]["text"]
    history = [*page.get("history", []), {"at": today, "action": "edited", "actor": "edit"}]
    return page | {"blocks": blocks, "block_order": order, "block_aliases": aliases, "links": links, "title": title, "updated": today, "history": history, "source_snapshot": None}


def _pages(df: DataFrame) -> DataFrame:
    """Columns of PAGE from a column of JSON pages."""
    return df.select(F.from_json("page", f"struct<{json_pages._fields()}>", {"mode": "FAILFAST"}).alias("p")).select("p.*")


def from_markdown(files: DataFrame, today: str) -> DataFrame:
    """Canonical pages of Markdown files (path, value); a file that holds a credential fails the job."""

    def run(frames):
        for f in frames:
            out = []
            for path, text in zip(f["path"], f["value"]):
                if name := redact.secret_label(text):
                    raise ValueError(f"{path}: looks like a credential: {name}")
                out.append(json.dumps(page_of(path.rsplit("/", 1)[-1].rsplit(".", 1)[0], text, today), ensure_ascii=False))
            yield pd.DataFrame({"page": out})

    return _pages(files.select("path", "value").mapInPandas(run, "page string"))


def ingest(existing: DataFrame, new: DataFrame, today: str, update: bool = False) -> DataFrame:
    """All pages after new ones came in. A page that is there already is only replaced with `update`, and keeps its block ids."""
    as_json = lambda d, c: d.select("id", F.to_json(F.struct(*[x for x in d.columns if x not in ("file", "sha256")]), {"ignoreNullFields": "false"}).alias(c))
    both = as_json(existing, "old").join(as_json(new, "new"), "id", "full")

    def run(frames):
        for f in frames:
            out = []
            for i, old, fresh in zip(f["id"], f["old"], f["new"]):
                if old and fresh and not update:
                    raise ValueError(f"{i} is there already")
                out.append(json.dumps(keep_ids(json.loads(old), json.loads(fresh), today), ensure_ascii=False) if old and fresh else old or fresh)
            yield pd.DataFrame({"page": out})

    return _pages(both.mapInPandas(run, "page string"))


def edit(pages: DataFrame, edits: DataFrame, today: str) -> DataFrame:
    """Pages with edits (page_id, block_id, fragment) applied; several edits of a page in the order of their block ids."""
    rows = pages.select("id", F.to_json(F.struct(*[c for c in pages.columns if c not in ("file", "sha256")]), {"ignoreNullFields": "false"}).alias("page"))
    todo = edits.groupBy(F.col("page_id").alias("id")).agg(F.to_json(F.array_sort(F.collect_list(F.struct("block_id", "fragment")))).alias("edits"))

    def run(frames):
        for f in frames:
            out = []
            for page, changes in zip(f["page"], f["edits"]):
                for e in json.loads(changes) if isinstance(changes, str) else []:
                    page = json.dumps(edited(json.loads(page), e["block_id"], e["fragment"], today), ensure_ascii=False)
                out.append(page)
            yield pd.DataFrame({"page": out})

    return _pages(rows.join(todo, "id", "left").select("page", "edits").mapInPandas(run, "page string"))


def as_markdown(pages: DataFrame) -> DataFrame:
    """page_id, markdown of canonical pages."""
    rows = pages.select(F.col("id").alias("page_id"), F.to_json(F.struct(*[c for c in pages.columns if c not in ("file", "sha256")])).alias("page"))

    def run(frames):
        for f in frames:
            texts = []
            for p in map(json.loads, f["page"]):
                texts.append(markdown.markdown(p | {"blocks": [p["blocks"][i] for i in p["block_order"]]}))
            yield pd.DataFrame({"page_id": f["page_id"], "markdown": texts})

    return rows.mapInPandas(run, "page_id string, markdown string")
