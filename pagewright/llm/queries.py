"""The queries of this subpackage and their DuckDB SQL, by name."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright.llm import bpe, chat, collocation, dedup, media, mixing, neardup, packing, quality, secrets, turns, urls, warc
from pagewright.llm.common import limit_batches, table

QUERIES = {}
ORACLE_SQL = {}


def query(f):
    """Registers a function under its name."""
    QUERIES[f.__name__] = f
    return f


def rank_file() -> tuple[str, str]:
    """Path and pattern of the public byte-level vocabulary."""
    import public_tokenizers as p

    return p.path("byte_bpe_50k.tiktoken"), p.PATTERN


@query
def op3_byte_bpe(spark, sf_dir):
    limit_batches(spark)
    path, pattern = rank_file()
    return bpe.encode_bpe(table(spark, sf_dir, "documents"), path=path, pattern=pattern)


@query
def op5_block_dedup(spark, sf_dir):
    return dedup.dedup_exact(table(spark, sf_dir, "documents"))


ORACLE_SQL["op5_block_dedup"] = r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS t FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       first_value(doc_id) OVER w = doc_id AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t ORDER BY points DESC, doc_id)
"""


@query
def op6_entropy_secrets(spark, sf_dir):
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def _secret_oracle() -> str:
    """Each kind with the pattern that takes the gap before a match along; entropy() over every window instead of carried counts."""
    text = lambda s: "'" + s.replace("'", "''") + "'"  # noqa: E731
    allow = " AND ".join(f"NOT regexp_full_match(m, {text(a)})" for a in secrets.ALLOW)
    bar = "CASE " + " ".join(f"WHEN regexp_full_match(m, {text(p)}) THEN {b}" for p, b in secrets.CLASSES) + " END"
    w = secrets.WINDOW
    entropy = f"list_max(list_transform(range(1, length(m) - {w - 2}), lambda i: list_aggregate(string_split(substr(m, i, {w}), ''), 'entropy')))"
    kinds = (
        ("assign", secrets.ASSIGN, 3, f"length(v) >= {secrets.ASSIGN_LEAST}"),
        ("access", secrets.ACCESS, 2, "true"),
        ("hex", secrets.HEX, 2, "true"),
        ("entropy", secrets.CANDIDATE, 2, f"regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]') AND {allow} AND {entropy} >= {bar}"),
    )
    parts = []
    for k, (kind, pattern, group, keep) in enumerate(kinds):
        whole = text(f"(?s)(.*?)(?:({pattern})|\\z)")
        parts.append(f"""
SELECT doc_id, {k} AS k, '{kind}' AS kind, e - length(m) AS s, e FROM (
  SELECT doc_id, m, v, sum(length(g) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM (
    SELECT doc_id, unnest(regexp_extract_all(t, {whole}, 1)) AS g, unnest(regexp_extract_all(t, {whole}, 2)) AS m,
           unnest(regexp_extract_all(t, {whole}, {group})) AS v, generate_subscripts(regexp_extract_all(t, {whole}, 1), 1) AS i
    FROM d)) WHERE m <> '' AND {keep}""")
    joined = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), a AS ({' UNION ALL '.join(parts)}),
g AS (SELECT doc_id, count(*) FILTER (k = 0) AS a0, count(*) FILTER (k = 1) AS a1, count(*) FILTER (k = 2) AS a2,
             {joined} FILTER (k < 3) AS base, {joined} AS every FROM a GROUP BY doc_id)
SELECT d.doc_id, coalesce(a0, 0) AS n_assign, coalesce(a1, 0) AS n_access, coalesce(a2, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans FROM d LEFT JOIN g USING (doc_id)"""


ORACLE_SQL["op6_entropy_secrets"] = _secret_oracle()


@query
def op4_chat_format(spark, sf_dir):
    said = "\\### Assistant: </turn> ok"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long"), F.col("id"), F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(said))
    return chat.digests(chat.format_rows(rows.union(extra)))


ORACLE_SQL["op4_chat_format"] = r"""
WITH c AS (SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS own, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, NULL, x, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(x, r)),
e AS (SELECT *, length(text) + length(text) - length(replace(replace(replace(text, '\', ''), '<', ''), '#', '')) + length(role) + 5 + 8 AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(n)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id, own
"""


@query
def op2_media_columns(spark, sf_dir):
    limit_batches(spark)
    return media.media_features(media.store_texts(table(spark, sf_dir, "documents")))


@query
def op7_warc_round_trip(spark, sf_dir):
    limit_batches(spark)
    return warc.round_trip(table(spark, sf_dir, "pages"), warc.archive_folder(spark))


ORACLE_SQL["op7_warc_round_trip"] = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha256(b) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND first <> page_id THEN first END AS refers_to FROM f
"""


@query
def op10_setsketch_neardup(spark, sf_dir):
    limit_batches(spark)
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op9_pfair_mix(spark, sf_dir):
    out = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "source", "block", "slot", "place", "release", "deadline")


#: Lists of op8: the tables have no list of their own, so each second host, domain and first path segment of a page gets dated entries by a hash of its name.
LISTS = ("adult", "allow", "malware", "spam")


def list_entries(pages):
    """Entries (list, pattern, at, action): a host, a domain or a host with a path segment is added, removed again, and perhaps added a second time."""
    url = F.coalesce(F.col("url"), F.lit(""))
    segment = F.get(F.filter(F.split(urls.path_of(url), "/"), lambda x: x != ""), F.lit(0))
    names = pages.select(urls.host_of(url).alias("h"), segment.alias("s")).filter("h <> ''")
    names = names.select(F.explode(F.array("h", F.regexp_extract("h", "[^.]+[.][^.]+$", 0), F.concat_ws("/", "h", F.lower("s")))).alias("pattern")).filter("pattern <> ''").distinct()
    number = lambda i: F.conv(F.substring(F.md5("pattern"), i, 4), 16, 10).cast("int")  # noqa: E731
    day = lambda d: F.date_add(F.lit("2024-01-01").cast("date"), d)  # noqa: E731
    first = number(5) % 200
    steps = F.array(
        F.struct(first.alias("d"), F.lit("add").alias("action")),
        F.struct((first + 20 + number(9) % 60).alias("d"), F.lit("remove").alias("action")),
        F.struct((first + 100 + number(13) % 60).alias("d"), F.when(number(13) % 2 == 0, "add").otherwise("remove").alias("action")),
    )
    lists = F.element_at(F.array(*map(F.lit, LISTS)), number(1) % len(LISTS) + 1)
    return names.filter(number(1) % 8 < 4).select(lists.alias("list"), "pattern", F.explode(steps).alias("x")).select("list", "pattern", day(F.col("x.d")).alias("at"), "x.action")


@query
def op8_url_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), ((F.col("page_id") * 37) % 365).cast("int")).alias("fetched"))
    return urls.filter_urls(pages, list_entries(pages))


ORACLE_SQL["op8_url_filter"] = r"""
WITH u AS (SELECT page_id, regexp_replace(regexp_replace(trim(coalesce(url, '')), '^[A-Za-z][A-Za-z0-9+.-]*:', ''), '^//', '') AS rest,
                  DATE '2024-01-01' + ((page_id * 37) % 365)::INT AS day FROM pages),
c AS (SELECT page_id, day, regexp_replace(lower(regexp_replace(regexp_replace(regexp_extract(rest, '^[^/?#]*'), '^.*@', ''), ':[0-9]*$', '')), '[.]+$', '') AS host,
             list_filter(string_split(regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1), '/'), lambda x: x <> '') AS parts FROM u),
p AS (SELECT DISTINCT unnest([host, regexp_extract(host, '[^.]+[.][^.]+$'), concat_ws('/', host, lower(parts[1]))]) AS pattern FROM c WHERE host <> ''),
n AS (SELECT pattern, ('0x' || substr(md5(pattern), 1, 4))::INT AS a, ('0x' || substr(md5(pattern), 5, 4))::INT % 200 AS f,
             ('0x' || substr(md5(pattern), 9, 4))::INT AS b, ('0x' || substr(md5(pattern), 13, 4))::INT AS d FROM p WHERE pattern <> ''),
e AS (SELECT (['adult', 'allow', 'malware', 'spam'])[a % 4 + 1] AS list, pattern,
             unnest([{'d': f, 'x': 'add'}, {'d': f + 20 + b % 60, 'x': 'remove'}, {'d': f + 100 + d % 60, 'x': CASE WHEN d % 2 = 0 THEN 'add' ELSE 'remove' END}]) AS s
      FROM n WHERE a % 8 < 4),
x AS (SELECT list, pattern, DATE '2024-01-01' + s.d AS day, s.x AS action FROM e),
i AS (SELECT *, lead(day) OVER (PARTITION BY list, pattern ORDER BY day) AS until FROM x),
t AS (SELECT page_id, host, day, unnest(list_distinct(list_concat(
        list_transform(range(1, len(string_split(host, '.')) + 1), lambda k: array_to_string((string_split(host, '.'))[k:], '.')),
        list_transform(range(1, len(parts) + 1), lambda k: host || '/' || array_to_string(parts[1:k], '/'))))) AS pattern FROM c WHERE host <> ''),
m AS (SELECT t.page_id, i.list, i.pattern FROM t JOIN i ON t.pattern = i.pattern AND i.action = 'add' AND t.day >= i.day AND (i.until IS NULL OR t.day < i.until)),
g AS (SELECT page_id, string_agg(DISTINCT list, ',' ORDER BY list) AS lists, first(pattern ORDER BY length(pattern) DESC, pattern) AS pattern,
             bool_or(list <> 'allow') AND NOT bool_or(list = 'allow') AS blocked FROM m GROUP BY page_id)
SELECT c.page_id, c.host, coalesce(lists, '') AS lists, pattern, coalesce(blocked, false) AS blocked FROM c LEFT JOIN g USING (page_id)
"""


@query
def op1_lsa_quality(spark, sf_dir):
    limit_batches(spark)
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(documents, table(spark, sf_dir, "labels"))
    scored = quality.classify(documents, model).withColumn("held_out", quality.held_out("doc_id"))
    return scored.select("doc_id", "held_out", "score", F.when(F.col("score") >= quality.ACCEPT, 1).otherwise(0).alias("predicted"))


ORACLE_SQL["op10_setsketch_neardup"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS both_ FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
p AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * both_ >= 75 * (a.n + b.n - both_)),
e AS (SELECT x, y FROM p UNION ALL SELECT y, x FROM p),
r AS (SELECT doc_id AS x, doc_id AS m FROM documents UNION SELECT e.y, r.m FROM r JOIN e ON e.x = r.x WHERE r.m < e.y)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, m AS component_id, d.doc_id = m AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(m) AS m FROM r GROUP BY x) USING (doc_id)
"""


@query
def op13_linear_grouping_pack(spark, sf_dir):
    import public_tokenizers as p

    limit_batches(spark)
    return packing.pack_documents(table(spark, sf_dir, "documents"), path=p.path("word_bpe_49k.json"))


@query
def op12_collocations(spark, sf_dir):
    limit_batches(spark)
    return collocation.collocations(table(spark, sf_dir, "documents"))


ORACLE_SQL["op12_collocations"] = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase FROM w, (VALUES (1), (2), (3)) v(k) WHERE len(ws) >= k),
n AS (SELECT lang, count(*) AS n FROM g WHERE k = 1 GROUP BY lang),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 10),
c AS (SELECT lang, phrase, a, k, string_split(phrase, ' ') AS ws FROM f WHERE k >= 2),
x AS (SELECT lang, phrase, a, k, ws, unnest(range(1, k)) AS cut FROM c),
s AS (SELECT x.*, l.a AS l, r.a AS r, (1000000::HUGEINT * x.a * x.a) // (l.a::HUGEINT * r.a) AS score
      FROM x JOIN f l ON l.lang = x.lang AND l.phrase = array_to_string(ws[1:cut], ' ') JOIN f r ON r.lang = x.lang AND r.phrase = array_to_string(ws[cut + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
o AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, a, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS phrase FROM c WHERE k = 3) GROUP BY ALL),
d AS (SELECT b.* FROM b LEFT JOIN o USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 50 * a),
t AS (SELECT lang, phrase, a, l, r, score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM d)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM t JOIN n USING (lang) WHERE rank <= 2000
"""


def damaged(rows):
    """Rows of `conversations` with faults by a checksum of conversation and turn; nulls are one space."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))  # noqa: E731
    code = (F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn")).cast("binary")) % 20).cast("int")
    text = F.when(code == 1, "").when(code == 2, F.regexp_replace(told("text"), "[.!?]", "")).otherwise(told("text"))
    role = F.when(code == 4, "user").otherwise(told("role"))
    return rows.filter(code != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.when(code == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("again")).drop("again")


@query
def op11_turn_repair(spark, sf_dir):
    limit_batches(spark)
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    every = rows.select(F.col("conv_id").alias("c_")).distinct()
    fixed = turns.repair_conversations(damaged(rows))
    out = every.join(fixed, F.col("c_").eqNullSafe(F.col("conv_id")), "left")
    zeros = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("c_").alias("conv_id"), *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def _repair_oracle() -> str:
    """Each conversation folded from its last row to its first: for each state the least cost, its letters and the repaired lines after it."""
    add = lambda h, c, letter, line="''": f"{{'c': {h}.c + {c}, 'a': '{letter}' || {h}.a, 't': {line} || {h}.t}}"  # noqa: E731
    filled = {0: ("h2", "user"), 1: ("h2", "user"), 2: ("h3", "assistant"), 3: ("h2", "user")}

    def best(q):
        stays = "CASE WHEN x.f IN (1, 2) THEN 1000000 WHEN x.f = 3 THEN 5 ELSE 0 END"
        to = {0: "CASE x.i WHEN 's' THEN h.h1 WHEN 'u' THEN h.h2 END", 1: "CASE x.i WHEN 'u' THEN h.h2 END", 2: "CASE x.i WHEN 'a' THEN h.h3 END", 3: "CASE x.i WHEN 'u' THEN h.h2 END"}[q]
        keep = add(f"coalesce({to}, {{'c': 1000000, 'a': '', 't': ''}})", stays, "K", "x.role || ':' || x.text || chr(10)")
        after, role = filled[q]
        rerole = add(f"h.{after}", f"1 + {stays}", "R", f"'{role}:' || x.text || chr(10)")
        return f"list_min([{add(f'h.h{q}', '2', 'D')}, {keep}, {rerole}])"

    inserted = lambda q: add("g." + filled[q][0], "5", "I", f"'{filled[q][1]}:' || chr(10)")  # noqa: E731
    closed = lambda q: f"list_min([g.h{q}, {inserted(q)}])"  # noqa: E731
    # h0 and h1 are reached from h2 after its own insertion
    step = f"list_transform([{{{', '.join(f"'h{q}': {best(q)}" for q in range(4))}}}], lambda g: {{'h0': g.h0, 'h1': g.h1, 'h2': {closed(2)}, 'h3': {closed(3)}}})[1]"
    step = f"list_transform([{step}], lambda g: {{'h0': {closed(0)}, 'h1': {closed(1)}, 'h2': g.h2, 'h3': g.h3}})[1]"
    end = "{'h0': {'c': 0, 'a': '', 't': ''}, 'h1': {'c': 10, 'a': 'II', 't': 'user:' || chr(10) || 'assistant:' || chr(10)}, 'h2': {'c': 5, 'a': 'I', 't': 'assistant:' || chr(10)}, 'h3': {'c': 0, 'a': '', 't': ''}}"
    bits = "list_reduce(range(8), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)"
    crc = "xor(list_reduce(list_transform(string_split(s, ''), lambda c: ascii(c)::BIGINT), lambda a, b: xor(k[(xor(a, b) & 255) + 1], a >> 8), 4294967295::BIGINT), 4294967295::BIGINT)"
    return rf"""
WITH RECURSIVE k AS (SELECT list({bits} ORDER BY n) AS k FROM range(256) r(n)),
o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS s FROM conversations),
z AS (SELECT o.*, {crc} % 20 AS z FROM o, k),
d AS (SELECT conv_id, turn, CASE WHEN z = 4 THEN 'user' ELSE role END AS role,
             CASE z WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN z = 3 THEN [0, 1] ELSE [0] END) AS again FROM z WHERE z <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, again) AS pos FROM d),
e AS (SELECT *, regexp_extract(text, '([^ 	-])[ 	-]*$', 1) AS last, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) AS seen,
             role[1] AS i, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY pos) AS before FROM n),
f AS (SELECT *, CASE WHEN last = '' THEN 1 WHEN seen > 1 THEN 2 WHEN last NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS f FROM e),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (f = 1) AS blank, count(*) FILTER (f = 2) AS duplicate, count(*) FILTER (f = 3) AS truncated,
             count(*) FILTER (before IS NOT NULL AND before || i NOT IN ('su', 'ua', 'au')) AS illegal, max(pos) AS rows FROM f GROUP BY conv_id),
w AS (SELECT conv_id, rows + 1 AS pos, {end} AS h FROM g
      UNION ALL SELECT w.conv_id, x.pos, {step} FROM (SELECT conv_id, pos, h FROM w) w JOIN f x ON x.conv_id IS NOT DISTINCT FROM w.conv_id AND x.pos = w.pos - 1)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(h.h0.c, 0)::BIGINT AS cost, coalesce(h.h0.a, '') AS audit, sha256(regexp_replace(coalesce(h.h0.t, ''), '
$', '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN w ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND w.pos = 1
"""


ORACLE_SQL["op11_turn_repair"] = _repair_oracle()
