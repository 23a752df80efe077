"""Near-duplicate detection with SetSketch registers.

A document is the set of its 5-word shingles (64-bit hashes). Its sketch has M registers: register i is the truncated logarithm of
the least of exponentially distributed values that hash i gives the set's members, so sketches of parts merge by maximum, and the
chance that a register agrees grows with the similarity. Steps:

1. One pass over the texts gives each row its set's size, a 128-bit name of the set, and the sketch (one byte a register).
   Rows with equal sets form a class; only classes go on.
2. ROWS registers make a band; classes that agree in a band share a bucket. In the first STAR_BANDS bands each member is compared with
   its bucket's head, not with all: a group of many near copies becomes a few stars.
3. A pair's similarity is first estimated from both sketches by maximum likelihood; pairs for which the threshold is out of the
   question (by a likelihood ratio of 4 standard deviations) are dropped, the others are verified on the full sets.
4. Links make components. Buckets that then still hold several components get all their pairs across components compared, in
   blocks, so that no link between members of one bucket is lost; pairs within a component can't change it.

With M = 255 in bands of 5, a pair of similarity 0.75 shares no bucket with a chance of 1e-6, less for more similar pairs.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import checkpointed, tidied

WORDS = 5
#: Percent of the union that the intersection must reach.
PERCENT = 75
BANDS, ROWS = 51, 5
#: Bands whose buckets' members are compared with the head in step 2.
STAR_BANDS = 12
M = BANDS * ROWS
#: Base of the registers' logarithm, and what is added so that they fit a byte for sets of up to about 1e6 members; beyond, they are clamped.
BASE, SHIFT = 1.1, 40
#: Log-likelihood that the threshold may lie below the best estimate: 4 standard deviations.
SLACK = 8.0
#: Equal registers that a pair must have before its likelihood is computed: 5 standard deviations below what the threshold gives.
SAME = int(M * PERCENT / 100 - 5 * math.sqrt(M * PERCENT / 100 * (1 - PERCENT / 100)))
#: Rows of blocks that are handled at once in step 4, about, and bytes of their full sets, about.
CHUNK, CHUNK_BYTES = 4_000, 48 << 20
#: Edges of a task in the search for components, about.
EDGES = 100_000
#: Members of a part of a bucket in step 4, and bytes of their full sets; a block compares two parts.
BLOCK, BLOCK_BYTES = 512, 8 << 20
#: Members of a star that are verified behind one copy of its head's set.
STAR = 1_024
#: So many classes (of some 50 bytes) are broadcast to the texts at most; more meet them in a shuffle.
FEW = 100_000
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads all bits (the finaliser of splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@lru_cache(maxsize=1)
def _tables():
    """Fixed pseudo-random numbers: one for each byte, odd factors for words in a shingle, factors and offsets of the registers."""
    n = _mix(np.arange(1, 2000, dtype=_U) * _U(0x9E3779B97F4A7C15))
    lower = np.arange(256)
    lower[65:91] += 32
    return n[:256][lower], n[300 : 300 + WORDS] | _U(1), (n[400 : 400 + M] >> _U(32)).astype(np.uint32) | np.uint32(1), (n[800 : 800 + M] >> _U(32)).astype(np.uint32)


#: Base of the polynomial over a word's bytes, and its inverse modulo 2**64.
_P = 0x9E3779B97F4A7C15
_INVERSE = pow(_P, -1, 1 << 64)


@lru_cache(maxsize=1)
def _powers(n: int):
    out = []
    for p in (_P, _INVERSE):
        x = np.full(n, p, dtype=_U)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return out


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hashes of a text's words in order. A-Z are lower-cased, words are split at the six ASCII white-space characters."""
    if not data:
        return np.empty(0, _U)
    per_byte, _, _, _ = _tables()
    b = np.frombuffer(data, np.uint8)
    white = (b == 32) | ((b >= 9) & (b <= 13))
    edge = np.flatnonzero(np.diff(white, prepend=True, append=True))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.empty(0, _U)
    power, inverse = _powers(1 << max(16, len(b).bit_length()))
    total = np.zeros(len(b) + 1, _U)
    np.cumsum(per_byte[b] * power[: len(b)], out=total[1:])
    return _mix((total[end] - total[start]) * inverse[start] + (end - start).astype(_U))


def shingles(data: bytes) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles; of fewer words, of the whole sequence; none without words."""
    word = word_hashes(data)
    if not len(word):
        return word
    _, per_word, _, _ = _tables()
    k = min(WORDS, len(word))
    s = np.full(len(word) - k + 1, k, _U)
    for j in range(k):
        s = _mix(s * per_word[j] + word[j : len(word) - k + 1 + j])
    return np.unique(s)


def set_name(s: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set of hashes."""
    import xxhash

    d = xxhash.xxh3_128_intdigest(s.tobytes())
    return (d >> 64) - (1 << 63), (d & ((1 << 64) - 1)) - (1 << 63)


def registers(least: np.ndarray) -> np.ndarray:
    """Registers from the least 32-bit hash values: the value is made exponential, its logarithm truncated and kept in a byte."""
    x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2**32)
    return np.clip(np.floor(1 - np.log(x) / math.log(BASE)) + SHIFT, 0, 255).astype(np.uint8)


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """One row of M registers for each (non-empty) set."""
    _, _, a, c = _tables()
    at = np.cumsum([0] + [len(s) for s in sets[:-1]])
    x = np.concatenate(sets)
    x = (x >> _U(32)).astype(np.uint32) ^ x.astype(np.uint32) * np.uint32(0x85EBCA6B)
    out = np.empty((M, len(sets)), np.uint32)
    y, z = np.empty_like(x), np.empty_like(x)
    for i in range(M):
        np.multiply(x, a[i], out=y)
        y += c[i]
        np.right_shift(y, np.uint32(15), out=z)
        y ^= z
        y *= np.uint32(0x2C1B3C6D)
        out[i] = np.minimum.reduceat(y, at)
    return registers(out.T)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Whether the threshold is within reach of the pairs of sketches, by the likelihood of both sketches together.

    With u and v the shares of the two sizes in their sum, a register of the first is the larger one with probability
    p(u - v J) and the second's with p(v - u J), where p(x) = -log_B(1 - x (B - 1) / B).
    """
    n_a, n_b = n_a.astype(float), n_b.astype(float)
    more, less = np.count_nonzero(a > b, axis=1), np.count_nonzero(a < b, axis=1)
    same = M - more - less
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)

    def p(x):
        return np.clip(-np.log(1 - np.maximum(x, 0) * (BASE - 1) / BASE) / math.log(BASE), 1e-12, 1)

    def ll(j):
        p1, p2 = p(u - v * j), p(v - u * j)
        return more * np.log(p1) + less * np.log(p2) + same * np.log(np.maximum(1 - p1 - p2, 1e-12))

    top = np.minimum(u / v, v / u)
    bar = PERCENT / 100
    grid = np.linspace(0, 1, 41)
    every = np.array([ll(g * top) for g in grid])
    best = every.max(axis=0)
    reach = np.array([ll(bar + g * np.maximum(top - bar, 0)) for g in np.linspace(0, 1, 11)]).max(axis=0)
    return (top >= bar) & (best - reach <= SLACK)


def _likely(pairs: DataFrame) -> DataFrame:
    """Pairs (head, id) of those with sketches sa, sb and sizes na, nb that may reach the threshold."""

    def run(batches):
        for t in batches:
            if t.num_rows:
                a, b = (np.frombuffer(b"".join(t.column(c).to_pylist()), np.uint8).reshape(-1, M) for c in ("sa", "sb"))
                ok = estimate(a, b, t.column("na").to_numpy(), t.column("nb").to_numpy())
                yield t.select(["head", "id"]).filter(pa.array(ok))

    return pairs.select("head", "id", "sa", "sb", "na", "nb").mapInArrow(tidied(run), "head bigint, id bigint")


def _sketched(rows: DataFrame) -> DataFrame:
    """Rows (key_, t) with n_shingles, the set's name (s1, s2; null without words) and sketch."""
    schema = f"key_ {rows.schema['key_'].dataType.simpleString()}, n_shingles bigint, s1 bigint, s2 bigint, sketch binary"

    def run(batches):
        for b in batches:
            keys, got, todo, size = [], [], [], 0

            def flush():
                sk = iter(sketches([s for s in todo if len(s)])) if any(map(len, todo)) else iter(())
                got.extend((len(s), *(set_name(s) if len(s) else (None, None)), next(sk).tobytes() if len(s) else None) for s in todo)
                todo.clear()

            for v in b.column(1):
                s = shingles(v.as_buffer().to_pybytes())
                todo.append(s)
                size += len(s)
                if size > 30_000:  # fits a processor's cache
                    flush()
                    size = 0
            flush()
            cols = list(zip(*got, strict=True)) or [()] * 4
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["key_", "n_shingles", "s1", "s2", "sketch"])

    return rows.mapInArrow(tidied(run), schema)


def _sets(ids: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """id and hashes (the full set) of the classes in `ids`. Only their texts are made into sets again."""
    wanted = checkpointed(ids.select("id").distinct().join(classes, "id").select("id", "key_", "s1", "s2"))
    few = F.broadcast(wanted) if wanted.count() <= FEW else wanted
    found = texts.withColumnRenamed("key_", "k").join(few, F.col("k").eqNullSafe(F.col("key_")))

    def sets(batches):
        for b in batches:
            ids, out = [], []
            for i, s1, s2, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
                s = shingles(v.as_buffer().to_pybytes())
                if len(s) and set_name(s) == (s1, s2):  # a repeated key can have other texts, too
                    ids.append(i)
                    out.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], ["id", "hashes"])

    made = found.select("id", "s1", "s2", "t").mapInArrow(tidied(sets), "id bigint, hashes binary")
    return checkpointed(made.groupBy("id").agg(F.first("hashes").alias("hashes")))


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sets (sorted, distinct) reach the threshold."""
    if PERCENT * max(len(x), len(y)) > 100 * min(len(x), len(y)):
        return False
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    both = int(np.count_nonzero(y[at] == x))
    return 100 * both >= PERCENT * (len(x) + len(y) - both)


def _verified(stars: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the pairs (head, id) of classes whose full sets reach the threshold, as (a, b).

    A head's set is sent once for each STAR of its members, not once for each member: heads and members are sorted by head and
    share, the head first, and the members' sets stream past it. So a task holds one head's set and one batch.
    """
    full = _sets(stars.select(F.explode(F.array("head", "id")).alias("id")), classes, texts)
    shares = checkpointed(stars.groupBy("head").agg(F.ceil(F.count("*") / STAR).cast("int").alias("shares")))
    few = F.broadcast(shares) if shares.count() <= FEW else shares
    heads = full.withColumnRenamed("id", "head").join(few, "head").select("head", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(None).cast("long").alias("id"), "hashes")
    members = stars.join(few, "head").select("head", F.pmod(F.xxhash64("id"), F.col("shares").cast("long")).cast("int").alias("share"), "id").join(full, "id").select("head", "share", "id", "hashes")
    lined_up = heads.unionByName(members).repartition("head", "share").sortWithinPartitions("head", "share", F.col("id").asc_nulls_first())

    def confirm(batches):
        head, own = None, None
        for t in batches:
            a, b = [], []
            for h, i, v in zip(t.column(0).to_pylist(), t.column(1).to_pylist(), t.column(2), strict=True):
                x = np.frombuffer(v.as_buffer(), _U)
                if i is None:
                    head, own = h, x.copy()  # its batch goes
                elif h != head:
                    raise ValueError("a member without its head")
                elif similar(own, x):
                    a.append(min(h, i))
                    b.append(max(h, i))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return lined_up.select("head", "id", "hashes").mapInArrow(tidied(confirm), "a bigint, b bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): one row per node with `id` and `component`, the least node that it reaches.

    Large stars and small stars in turn: each round links a node's larger neighbours, then its smaller ones, to the least of
    them, until nothing changes; the number of rounds grows with the logarithm of the number of nodes. A node's neighbours are
    never gathered in one row.
    """
    e = checkpointed(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())

    def signature(d):
        return tuple(d.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = signature(e)
    parts = max(8, before[0] // EDGES)
    e = e.coalesce(parts)
    while before[0]:
        both = e.union(e.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").coalesce(parts)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).coalesce(parts)
        e = checkpointed(small.filter("a <> b").distinct().coalesce(parts))
        now = signature(e)
        if now == before:
            break
        before = now
    return e.select(F.col("a").alias("id"), F.col("b").alias("component")).union(e.select("b", "b").distinct())


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `df`: key, n_shingles, component_id (the smallest key reachable by links), kept (key = component_id).

    Texts whose sets have at least 75 % of their union in common are linked. A null or empty text, or one of white space, has an empty set
    and no links; one of fewer words than a shingle has one shingle of all of them. Rows with equal sets are linked
    (similarity 1). A repeated key is one document with the links of all its rows, so its rows are kept or not together; a
    null key comes after all others as a component_id. An empty table gives no rows. Other columns are not read.
    """
    texts = df.select(F.col(key).alias("key_"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("t"))
    base = checkpointed(_sketched(texts).withColumn("row", F.monotonically_increasing_id()))
    full = base.filter("s1 IS NOT NULL")
    # of each set one row, by (key, row), nulls last: what is shuffled is pre-aggregated, however many rows have the set
    classes = full.groupBy("s1", "s2").agg(F.min(F.struct(F.col("key_").isNull().alias("null"), "key_", "row")).alias("first"))
    classes = checkpointed(classes.select(F.col("first.row").alias("id"), F.col("first.key_").alias("key_"), "s1", "s2"))
    sketch = full.select(F.col("row").alias("id"), "sketch", F.col("n_shingles").alias("n")).join(classes.select("id"), "id", "left_semi")

    band = lambda i: F.conv(F.hex(F.substring("sketch", i * ROWS + 1, F.lit(ROWS))), 16, 10).cast("long") * 64 + i  # noqa: E731  5 bytes and the band's number: exact
    bands = sketch.select("id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), band)).alias("bucket"))
    # the head of a bucket is the member whose id, mixed with the bucket's own number, is least: a group that shares many buckets has many heads
    own = F.xxhash64("bucket").bitwiseAND(F.lit((1 << 62) - 1))
    heads = checkpointed(bands.groupBy("bucket").agg(F.min(F.col("id").bitwiseXOR(own)).bitwiseXOR(own).alias("head"), F.count("*").alias("n")).filter("n > 1"))
    members = checkpointed(bands.join(heads, "bucket").select("bucket", "id", "head", "n"))

    # stars of some bands join most of what belongs together; what they miss is found across components, in all bands
    stars = members.filter((F.col("id") != F.col("head")) & (F.col("bucket") % 64 < STAR_BANDS)).select("head", "id").distinct()
    a, b = (sketch.select(F.col("id").alias(x), F.col("sketch").alias(f"s{y}"), F.col("n").alias(f"n{y}")) for x, y in (("head", "a"), ("id", "b")))
    likely = checkpointed(_likely(stars.join(a, "head").join(b, "id")))
    links = checkpointed(_verified(likely, classes, texts))
    found = checkpointed(components(links))
    more = _across(members, found, sketch, classes, texts)
    if more is not None and not more.isEmpty():
        found = components(links.union(more))

    # rows of one key are one document: their sets' components are one, too
    found = checkpointed(classes.join(found, "id", "left").select("s1", "s2", F.coalesce("component", "id").alias("component")))
    rows = checkpointed(base.join(found, ["s1", "s2"], "left").select("row", "key_", "n_shingles", F.coalesce("component", "row").alias("component")))
    several = rows.groupBy("key_").agg(F.min("component").alias("a"), F.max("component").alias("b")).filter("a <> b AND key_ IS NOT NULL")
    if not several.isEmpty():
        pairs = rows.join(several.select("key_", "a"), "key_").select("a", F.col("component").alias("b"))
        merged = components(pairs).withColumnRenamed("component", "to")
        rows = checkpointed(rows.join(merged, rows["component"] == merged["id"], "left").select("row", "key_", "n_shingles", F.coalesce("to", "component").alias("component")))
    least = checkpointed(rows.groupBy("component").agg(F.min("key_").alias("component_id")))
    out = rows.join(least, "component")
    return out.select(F.col("key_").alias(key), "n_shingles", "component_id", F.col("key_").eqNullSafe(F.col("component_id")).alias("kept"))


def _pairs(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of likely pairs of a table of blocks: of one block, of different components, in the first band in which they agree.

    Rows are sorted by block, and a row is paired with the one `step` places further as long as their block goes on, for
    all blocks at once.
    """
    bucket, x, y, part, component, size = (t.column(k).to_numpy() for k in ("bucket", "x", "y", "part", "component", "size"))
    order = np.lexsort((y, x, bucket))
    sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(-1, M)
    new = np.ones(len(order), bool)
    new[1:] = np.any([k[order][1:] != k[order][:-1] for k in (bucket, x, y)], axis=0)
    end = np.append(np.flatnonzero(new), len(order))[np.cumsum(new)]  # behind the block of each row
    out, step, at = [np.empty((2, 0), np.int64)], 0, np.arange(len(order))
    while len(at):
        step += 1
        at = at[at + step < end[at]]
        i, j = order[at], order[at + step]
        ok = (component[i] != component[j]) & ((part[i] != part[j]) | (x[i] == y[i]))
        i, j = i[ok], j[ok]
        for k in range(0, len(i), 20_000):
            p, q = i[k : k + 20_000], j[k : k + 20_000]
            same = sketch[p] == sketch[q]
            ok = (same.sum(axis=1) >= SAME) & (same.reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1) == bucket[p] % 64)
            p, q = p[ok], q[ok]
            if len(p):
                ok = estimate(sketch[p], sketch[q], size[p], size[q])
                out.append(np.stack((p[ok], q[ok])))
    return tuple(np.concatenate(out, axis=1))


def _across(members: DataFrame, found: DataFrame, sketch: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame | None:
    """Links (a, b) between members of one bucket that are in different components so far; None if no pair is likely.

    Pairs are compared in blocks of a bucket and never leave them: first sketches tell which members have a likely partner,
    then those members' sets are compared, and only links that join components are given.
    """
    m = members.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = m.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("bucket")
    m = m.join(mixed, "bucket").select("bucket", "id", "component", "n").join(sketch.select("id", "sketch", F.col("n").alias("size")), "id")
    # a bucket has as many parts as its members or their sets' bytes ask for; a block compares two of them, so a member goes to as many blocks as
    # there are parts
    large = m.groupBy("bucket").agg(F.ceil(F.sum(F.col("size") * 8) / BLOCK_BYTES).cast("int").alias("by_bytes"))
    large = checkpointed(large.filter("by_bytes > 1"))
    m = m.join(F.broadcast(large) if large.count() <= FEW else large, "bucket", "left")
    parts = F.greatest(F.ceil(F.col("n") / BLOCK).cast("int"), F.coalesce("by_bytes", F.lit(1)))
    m = m.withColumn("part", F.pmod(F.xxhash64("id"), parts.cast("long")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    m = m.select("bucket", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"), "id", "component", "sketch", "size", "part")
    m = checkpointed(m)

    def chunked(d, chunks):  # several blocks are handled at once
        return d.groupBy(F.pmod(F.xxhash64("bucket", "x", "y"), F.lit(chunks)).alias("chunk"))

    def flag(t):
        return t.select(["bucket", "x", "y", "id"]).take(pa.array(np.unique(np.concatenate(_pairs(t)))))

    flagged = checkpointed(chunked(m, m.count() // CHUNK + 1).applyInArrow(flag, "bucket bigint, x int, y int, id bigint"))
    if flagged.isEmpty():
        return None
    full = _sets(flagged, classes, texts)
    m = m.join(flagged, ["bucket", "x", "y", "id"])
    rows, size = m.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    chunks = max(rows // CHUNK, 8 * size // CHUNK_BYTES) + 1
    m = m.join(full, "id")

    def link(t):
        i, j = _pairs(t)
        component = t.column("component").to_pylist()
        ids = t.column("id").to_numpy()
        sets = [np.frombuffer(v.as_buffer(), _U) for v in t.column("hashes")]
        up: dict[int, int] = {}

        def top(c):
            while c in up:
                c = up[c]
            return c

        a, b = [], []
        for p, q in zip(i.tolist(), j.tolist(), strict=True):
            u, v = top(component[p]), top(component[q])
            if u != v and similar(sets[p], sets[q]):
                up[max(u, v)] = min(u, v)
                a.append(ids[p])
                b.append(ids[q])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return checkpointed(chunked(m, chunks).applyInArrow(link, "a bigint, b bigint"))
