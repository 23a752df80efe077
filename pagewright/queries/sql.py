"""Parts of the oracle SQL: common table expressions over the driver's tables, each after those that it needs."""

from __future__ import annotations

from pagewright.functions import fixed

_STOP = ", ".join(f"'{a}'" for w in fixed.STOP_WORDS for a in {w[i : i + 2] for i in range(len(w) - 1)})


def _tokens(source: str, key: str, name: str) -> str:
    """Rows (key, term) of a source (key, text) by the rules of the search tokenizer."""
    return f"""
{name}_run AS (SELECT {key}, unnest(regexp_extract_all(lower(text), '[0-9a-z_][0-9a-z_.:/\\-]*|[가-힣]+')) AS r FROM {source}),
{name}_word AS (SELECT {key}, regexp_replace(r, '[.:/\\-]+$', '') AS w FROM {name}_run WHERE NOT regexp_matches(r, '^[가-힣]')),
{name}_part AS (SELECT {key}, w, list_filter(string_split_regex(w, '[_.:/\\-]+'), lambda p: length(p) >= 2) AS p FROM {name}_word WHERE length(w) >= 2),
{name} AS (SELECT {key}, w AS term FROM {name}_part UNION ALL SELECT {key}, unnest(p) FROM {name}_part WHERE len(p) > 1
  UNION ALL SELECT {key}, unnest(list_transform(range(1, length(r)), lambda i: r[i:i + 1])) FROM {name}_run WHERE regexp_matches(r, '^[가-힣]') AND length(r) >= 2)"""


PARTS = {
    "page": """
page AS (SELECT doc_id, 'page:doc-' || doc_id AS page_id, 'doc-' || doc_id AS slug, trim(string_split(text, chr(10))[1]) AS title,
  CASE WHEN doc_id % 100 < 50 THEN 'source' WHEN doc_id % 100 < 75 THEN 'entity' WHEN doc_id % 100 < 94 THEN 'synthesis' WHEN doc_id % 100 < 99 THEN 'concept' ELSE 'project' END AS type,
  strftime(DATE '2024-01-01' + (doc_id % 365)::INT, '%Y-%m-%d') AS updated, lang, source, text, sha256(text) AS sha FROM (SELECT * REPLACE (coalesce(text, '') AS text) FROM documents WHERE doc_id IS NOT NULL))""",
    "blk": """
line AS (SELECT page_id, slug, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM page),
printed AS (SELECT *, CASE WHEN pos = 0 THEN 'heading' ELSE 'paragraph' END AS kind,
  left(sha256(CASE WHEN pos = 0 THEN 'heading' ELSE 'paragraph' END || chr(0) || trim(regexp_replace(text, '\\s+', ' ', 'g'))), 16) AS print FROM line WHERE trim(text) <> ''),
blk AS (SELECT page_id, pos, kind, text, print, 'block:' || slug || ':' || print || ':' || row_number() OVER (PARTITION BY page_id, kind, print ORDER BY pos) AS block_id FROM printed)""",
    "link": """
n AS (SELECT count(*) AS n FROM page),
firstbody AS (SELECT page_id, arg_min(block_id, pos) AS b FROM blk WHERE pos > 0 GROUP BY page_id),
rawlink AS (
  SELECT page_id, 0 AS ord, 'doc-' || ((doc_id * 7 + 1) % n) AS target, 'wiki' AS kind FROM page, n
  UNION ALL SELECT page_id, 1, 'doc-' || ((doc_id * 13 + 5) % n), 'wiki' FROM page, n
  UNION ALL SELECT page_id, 2, 'doc-' || nxt, 'related' FROM (SELECT page_id, lead(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS nxt FROM page) WHERE nxt IS NOT NULL
  UNION ALL SELECT page_id, 3, 'doc-' || old, 'supersedes' FROM (SELECT page_id, lag(doc_id) OVER (PARTITION BY sha ORDER BY doc_id) AS old FROM page) WHERE old IS NOT NULL),
linkkey AS (SELECT r.*, CASE WHEN kind IN ('related', 'supersedes') THEN coalesce(b, '') ELSE '' END AS block_id,
  trim(regexp_replace(regexp_replace(lower(trim(target)), '^page:', ''), '[\\s_]+', '-', 'g'), '-') AS key FROM rawlink r LEFT JOIN firstbody USING (page_id)),
keys AS (SELECT DISTINCT trim(regexp_replace(regexp_replace(lower(trim(v)), '^page:', ''), '[\\s_]+', '-', 'g'), '-') AS key, prio, page_id FROM (
  SELECT page_id AS v, 0 AS prio, page_id FROM page UNION ALL SELECT slug, 0, page_id FROM page UNION ALL SELECT title, 1, page_id FROM page)),
best AS (SELECT key, page_id AS dst FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY prio, page_id) AS r FROM keys WHERE key <> '') WHERE r = 1),
link AS (SELECT l.*, CASE WHEN dst <> page_id THEN dst END AS dst FROM linkkey l LEFT JOIN best USING (key))""",
    "adj": """
own AS (SELECT page_id AS src, dst, arg_min(block_id, ord) AS own_block FROM link WHERE dst IS NOT NULL GROUP BY 1, 2),
weak AS (SELECT p AS page_id, count(*) AS weak_in FROM (SELECT page_id AS p FROM link WHERE dst IS NOT NULL AND kind = 'wiki' UNION ALL SELECT dst FROM link WHERE dst IS NOT NULL AND kind = 'wiki') GROUP BY p),
pair AS (SELECT src, dst, max(w) AS w FROM (
  SELECT page_id AS src, dst, CASE kind WHEN 'related' THEN 1.0::DOUBLE ELSE 0.15::DOUBLE END AS w FROM link WHERE dst IS NOT NULL AND kind <> 'supersedes'
  UNION ALL SELECT dst, page_id, CASE kind WHEN 'related' THEN 1.0::DOUBLE ELSE 0.15::DOUBLE END FROM link WHERE dst IS NOT NULL AND kind <> 'supersedes') GROUP BY 1, 2),
damped AS (SELECT src, dst, CASE WHEN w < 1 THEN round(w / (1 + ln(greatest(coalesce(weak_in, 1), 1))), 6) ELSE w END AS w FROM pair LEFT JOIN weak ON weak.page_id = pair.dst),
adj AS (SELECT src, dst, w, coalesce(own_block, '') AS own_block FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) AS r FROM damped) LEFT JOIN own USING (src, dst) WHERE r <= 64)""",
    "head": """
succ AS (SELECT dst AS page_id, min(page_id) AS nxt, count(DISTINCT page_id) > 1 AS fork FROM link WHERE kind = 'supersedes' AND dst IS NOT NULL GROUP BY dst),
walk AS (SELECT page_id, nxt AS hd, fork, [page_id, nxt] AS seen, false AS circle FROM succ
  UNION ALL SELECT w.page_id, s.nxt, w.fork OR s.fork, list_append(w.seen, s.nxt), list_contains(w.seen, s.nxt) FROM walk w JOIN succ s ON w.hd = s.page_id WHERE NOT w.circle),
ends AS (SELECT page_id, arg_max(hd, len(seen)) AS hd, arg_max(fork, len(seen)) AS fork, bool_or(circle) AS circle FROM walk GROUP BY page_id),
head AS (SELECT page_id, CASE WHEN circle THEN page_id ELSE hd END AS head, CASE WHEN circle THEN 'cycle' WHEN fork THEN 'fork' ELSE 'stale' END AS state FROM ends)""",
    "post": """
anchor AS (SELECT page_id, block_id FROM (SELECT page_id, block_id, arg_min(dst IS NOT NULL, ord) AS leads FROM link WHERE kind IN ('related', 'supersedes') AND block_id <> '' AND key <> '' GROUP BY 1, 2) WHERE leads),
ib AS (SELECT page_id, -1 AS pos, '' AS block_id, 'title' AS kind, title AS text FROM page WHERE title <> '' UNION ALL SELECT page_id, pos, block_id, kind, text FROM blk),"""
    + _tokens("ib", "page_id, pos", "tok")
    + """,
blen AS (SELECT page_id, pos, count(*) AS len FROM tok GROUP BY 1, 2),
iblk AS (SELECT ib.*, coalesce(len, 0) AS len, kind NOT IN ('title', 'heading') AS ev, CASE WHEN a.block_id IS NOT NULL THEN 1.35::DOUBLE ELSE 1.0::DOUBLE END AS mult
  FROM ib LEFT JOIN blen USING (page_id, pos) LEFT JOIN anchor a ON a.page_id = ib.page_id AND a.block_id = ib.block_id),
post AS (SELECT term, page_id, pos, count(*) AS tf FROM tok GROUP BY 1, 2, 3),
term AS (SELECT term, count(*) AS df FROM post GROUP BY term),
stats AS (SELECT (SELECT count(*) FROM page) AS n_pages, count(*) AS n_blocks, sum(len)::BIGINT AS total_len, sum(len)::DOUBLE / count(*) AS avg_len,
  greatest(1.0::DOUBLE, (count(*) - (SELECT count(*) FROM page))::DOUBLE / (SELECT count(*) FROM page)) AS avg_body FROM iblk)""",
    "lex": _tokens("(SELECT item_id AS qid, text FROM benchmark)", "qid", "qtok").lstrip("\n").replace("qtok_run", "\nqtok_run", 1)
    + f""",
qterm AS (SELECT qid, term, df, n_blocks, avg_len, ln(1.0::DOUBLE + (n_blocks - coalesce(df, 0) + 0.5::DOUBLE) / (coalesce(df, 0) + 0.5::DOUBLE)) AS idf
  FROM (SELECT DISTINCT qid, term FROM qtok) LEFT JOIN term USING (term), stats),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY df, term) AS k FROM (
  SELECT *, bool_or(rare) OVER (PARTITION BY qid) AS any_rare, row_number() OVER (PARTITION BY qid ORDER BY df, term) AS r
  FROM (SELECT *, df <= 0.30::DOUBLE * n_blocks AS rare FROM qterm WHERE df IS NOT NULL)) WHERE rare OR (NOT any_rare AND r = 1)) WHERE k <= 24),
imp AS (SELECT k.qid, k.term, p.page_id, p.pos, b.ev, k.idf,
  k.idf * p.tf * 2.2::DOUBLE / (p.tf + 1.2::DOUBLE * 0.25::DOUBLE + 1.2::DOUBLE * 0.75::DOUBLE / k.avg_len * b.len) * b.mult AS impact
  FROM kept k JOIN post p USING (term) JOIN iblk b ON b.page_id = p.page_id AND b.pos = p.pos),
blks AS (SELECT qid, page_id, pos, any_value(ev) AS ev, sum(impact * idf * idf) AS score, sum(CASE WHEN term IN ({_STOP}) THEN 0.0::DOUBLE ELSE impact * idf * idf END) AS content
  FROM (SELECT *, row_number() OVER (PARTITION BY qid, term ORDER BY impact DESC, page_id, pos) AS r FROM imp) WHERE r <= 400 GROUP BY 1, 2, 3),
pages_ AS (SELECT qid, page_id, max(score) AS best, sum(score) - max(score) AS rest, count(*) AS n, max(score) + 0.25::DOUBLE * (sum(score) - max(score)) AS lex,
  max(content) + 0.25::DOUBLE * (sum(content) - max(content)) AS content_lex FROM blks GROUP BY 1, 2)""",
    "facts": """
facts AS (SELECT p.page_id, p.slug, p.type, 1 AS labels, count(b.pos) AS n_blocks, count(b.pos) AS n_body FROM page p LEFT JOIN blk b USING (page_id) GROUP BY 1, 2, 3)""",
    "rel": """
rel AS (SELECT qid, page_id, (best + 0.25::DOUBLE * CASE WHEN n_body > 0 THEN 1 / (0.75::DOUBLE + 0.25::DOUBLE * n_body / avg_body) ELSE 1.0::DOUBLE END * rest)
  * CASE WHEN type IN ('concept', 'entity', 'synthesis') THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN labels > 200 OR facts.n_blocks > 300 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS rel
  FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(lex, 6) DESC, page_id) AS r FROM pages_) JOIN facts USING (page_id), stats WHERE r <= 200),
rell AS (SELECT *, rel / CASE WHEN max(rel) OVER (PARTITION BY qid) = 0 THEN 1 ELSE max(rel) OVER (PARTITION BY qid) END AS l FROM rel)""",
    "graph": """
seed AS (SELECT qid, page_id AS src, l AS mass FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(rel, 6) DESC, page_id) AS r FROM rell) WHERE r <= 30),
s1 AS (SELECT qid, src, dst, own_block, mass * CASE WHEN w >= 1 THEN w / count(*) FILTER (w >= 1) OVER (PARTITION BY qid, src) ELSE w END AS m FROM seed JOIN adj USING (src)),
g1 AS (SELECT qid, dst, max(m) AS m, arg_min(own_block, {'a': -round(m, 9), 'b': src}) AS own FROM s1 GROUP BY 1, 2),
f1 AS (SELECT qid, dst AS src, m AS mass FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(m, 9) DESC, dst) AS r FROM g1) WHERE r <= 50),
s2 AS (SELECT qid, src, dst, own_block, mass * CASE WHEN w >= 1 THEN w / count(*) FILTER (w >= 1) OVER (PARTITION BY qid, src) ELSE w END AS m FROM f1 JOIN adj USING (src)),
s2b AS (SELECT s2.* FROM s2 ANTI JOIN s1 ON s1.qid = s2.qid AND s1.src = s2.dst AND s1.dst = s2.src),
g2 AS (SELECT qid, dst, max(m) AS m, arg_min(own_block, {'a': -round(m, 9), 'b': src}) AS own FROM s2b GROUP BY 1, 2),
graph AS (SELECT qid, page_id, sum(g) AS g, arg_min(own, {'a': -round(g, 9), 'b': step}) AS own FROM (
  SELECT qid, dst AS page_id, m AS g, own, 0 AS step FROM g1 UNION ALL SELECT qid, dst, m * 0.5::DOUBLE, own, 1 FROM g2) GROUP BY 1, 2)""",
    "comb": """
comb AS (SELECT qid, page_id, coalesce(l, 0) + 0.85::DOUBLE * least(coalesce(g, 0), 1.0::DOUBLE) * (1 - coalesce(l, 0)) AS score, own FROM rell FULL JOIN graph USING (qid, page_id))""",
    "comb_lexical": """
comb AS (SELECT qid, page_id, l AS score, NULL::VARCHAR AS own FROM rell)""",
    "fold": """
known AS (SELECT c.*, coalesce(h.head, c.page_id) AS head FROM comb c LEFT JOIN head h USING (page_id)),
hb AS (SELECT qid, head, max(score) AS top, max(CASE WHEN head = page_id THEN score END) AS mine, bool_or(head <> page_id) AS older FROM known GROUP BY 1, 2),
every AS (SELECT qid, page_id, own, head FROM known UNION ALL SELECT qid, head, NULL, head FROM hb WHERE mine IS NULL),
sc AS (SELECT e.qid, e.page_id, e.own, e.head, CASE WHEN e.head <> e.page_id THEN top * 0.30::DOUBLE ELSE top END AS score, e.head <> e.page_id AS stale,
  e.head = e.page_id AND older AND (mine IS NULL OR top > mine + 1e-9) AS lifted FROM every e JOIN hb USING (qid, head))""",
    "nofold": """
sc AS (SELECT c.qid, c.page_id, c.own, coalesce(h.head, c.page_id) AS head, score, false AS stale, false AS lifted FROM comb c LEFT JOIN head h USING (page_id))""",
    "final": """
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, page_id) AS rank FROM sc),
final AS (SELECT r.* FROM ranked r WHERE rank <= 10 OR (stale AND EXISTS (SELECT 1 FROM ranked b WHERE b.qid = r.qid AND b.rank <= 10 AND b.page_id = r.head))),
top3 AS (SELECT qid, page_id, list(block_id ORDER BY r) AS lex FROM (
  SELECT b.qid, b.page_id, i.block_id, row_number() OVER (PARTITION BY b.qid, b.page_id ORDER BY round(score, 6) DESC, b.pos DESC) AS r FROM blks b JOIN iblk i ON i.page_id = b.page_id AND i.pos = b.pos WHERE b.ev) WHERE r <= 3 GROUP BY 1, 2),
supb AS (SELECT page_id, arg_min(block_id, ord) AS sup_block FROM link WHERE kind = 'supersedes' AND dst IS NOT NULL GROUP BY 1),
firstev AS (SELECT page_id, arg_min(block_id, pos) AS first FROM iblk WHERE ev GROUP BY 1),
hos AS (SELECT DISTINCT qid, head AS page_id FROM final WHERE stale),
evid AS (SELECT f.*, list_filter(list_concat(CASE WHEN lifted THEN [coalesce(sup_block, '')] ELSE [] END, [coalesce(own, '')], coalesce(lex, [])), lambda b: b <> '') AS raw, first, hos.qid IS NOT NULL AS hs
  FROM final f LEFT JOIN top3 USING (qid, page_id) LEFT JOIN supb USING (page_id) LEFT JOIN firstev USING (page_id) LEFT JOIN hos ON hos.qid = f.qid AND hos.page_id = f.page_id),
result AS (SELECT qid, rank, e.page_id, replace(e.page_id, 'page:', '') AS slug, round(score, 6) AS score,
  CASE WHEN len(raw) = 0 AND e.head = e.page_id AND (lifted OR hs) AND first IS NOT NULL THEN first
       ELSE array_to_string(list_filter(raw, lambda b, i: list_position(raw, b) = i)[1:4], ',') END AS blocks, e.head, coalesce(h.state, '') AS state
  FROM evid e LEFT JOIN head h ON h.page_id = e.page_id)""",
}
NEEDS = {"page": [], "blk": ["page"], "link": ["blk"], "adj": ["link"], "head": ["link"], "post": ["link"], "lex": ["post"], "facts": ["blk"], "rel": ["lex", "facts"], "graph": ["rel", "adj"], "comb": ["graph"], "comb_lexical": ["rel"]}


def sql(select: str, *parts: str) -> str:
    """The select with the parts that it names and all that these need."""
    out: list[str] = []

    def need(p: str) -> None:
        for q in NEEDS.get(p, []):
            need(q)
        if p not in out:
            out.append(p)

    for p in parts:
        need(p)
    return "WITH RECURSIVE " + ",".join(PARTS[p] for p in out) + "\n" + select
