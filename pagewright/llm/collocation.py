"""Phrases whose words come together more often than by chance, from suffix arrays of word ids.

1. A task joins its texts of one language into shards of a bounded size. In a shard each word is an id, and punctuation a break. Prefix doubling ranks
   the suffixes by their first 1, 2, 4, ... words; in the suffix array the suffixes that share n words are neighbours, so each
   interval of the array of common prefixes (LCP) at depth n is an n-gram with its count.
2. Counts are added up over shards and tasks by language and phrase, exactly. Only phrases that reach the least count go on.
3. Phrases of one and two words are counted in the first pass. A phrase of n > 2 words can only be frequent where both its parts of n - 1 words are, so its
   pass only takes places at which both are in the set of frequent ones: a bitmap of a fixed size, in which a collision costs a row, but loses nothing.

The joins after that are on frequent phrases only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.common import checkpointed, tidied

#: Words of a phrase at most, the least count, percent of the count from which a longer phrase replaces it, phrases of a language.
WORDS, LEAST, COVERED, TOP = 3, 10, 50, 2000
#: Language of texts that name none.
NO_LANG = "und"
#: Bytes of text in a shard, bits of the bitmap of frequent phrases (16 MB, whatever the size of the corpus), rows of an Arrow batch.
SHARD_BYTES = 8 << 20
FILTER_BITS = 1 << 27
ROWS = 100_000
#: Parts of a language that are ranked by themselves before the language is.
PARTS = 64
_U = np.uint64
#: What ends a piece, as one break; letters A-Z; the two blanks.
BREAK = b"\n"
BYTES = bytes(b + 32 if 65 <= b <= 90 else 10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256))


def word_ids(text: bytes) -> tuple[np.ndarray, pa.Array]:
    """Ids from 1 on of the words of a shard in order, 0 for a break, and the word of each id (at its place)."""
    parts = pc.split_pattern(pa.array([text.replace(BREAK, b" \n ")], pa.large_binary()), " ").flatten()
    coded = parts.filter(pc.not_equal(pc.binary_length(parts), 0)).dictionary_encode()
    words = coded.dictionary
    ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1
    at = pc.index(words, pa.scalar(BREAK, words.type)).as_py()
    if at >= 0:
        ids[ids == at + 1] = 0
    return ids, pa.concat_arrays([pa.array([b""], words.type), words])


def suffix_ranks(ids: np.ndarray, depth: int, starts: np.ndarray) -> np.ndarray:
    """`starts`, places in `ids`, ordered by the `depth` words (at least) from there on; ranks double until they reach so far."""
    rank, words, length = ids, np.flatnonzero(ids), 1
    while True:
        last = length * 2 >= depth
        at = starts if last or length >= depth else words
        key = rank[at]
        if length < depth:
            after = np.minimum(at + length, len(ids) - 1)
            key = key * (int(rank.max(initial=0)) + 1) + np.where(at + length < len(ids), rank[after], 0)
        order = np.argsort(key, kind="stable")
        if last or length >= depth:
            return at[order]
        key = key[order]
        rank = np.zeros_like(ids)
        rank[at[order]] = np.concatenate(([1], 1 + np.cumsum(key[1:] != key[:-1]))) if len(at) else 0
        length *= 2


def intervals(ids: np.ndarray, depth: int, starts: np.ndarray):
    """For n = 1 to `depth`: n, a place of each n-gram at `starts`, and its count, from the LCP intervals at depth n."""
    sa = suffix_ranks(ids, depth, starts)
    padded = np.concatenate((ids, np.zeros(depth, ids.dtype)))
    same, whole = np.ones(max(len(sa) - 1, 0), bool), np.ones(len(sa), bool)
    for n in range(1, depth + 1):
        word = padded[sa + n - 1]
        same &= word[1:] == word[:-1]  # the common prefix with the suffix before reaches n words
        whole &= word > 0
        first = np.concatenate((np.zeros(min(1, len(sa)), np.int64), np.flatnonzero(~same) + 1))
        count = np.diff(np.append(first, len(sa)))
        keep = whole[first]
        yield n, sa[first[keep]], count[keep]


def _mixed(parts: list[np.ndarray]) -> np.ndarray:
    """One hash of the hashes of the words of a phrase."""
    h = parts[0]
    for p in parts[1:]:
        h = (h ^ (h >> _U(31))) * _U(0x9E3779B97F4A7C15) + p
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    return h ^ (h >> _U(27))


def _word_hashes(lang: str, words) -> np.ndarray:
    import xxhash

    own = lang.encode() + b"\0"
    return np.fromiter((xxhash.xxh64_intdigest(own + w) for w in words), np.uint64, len(words))


def _joined(ids: np.ndarray, words: pa.Array, at: np.ndarray, n: int) -> pa.Array:
    parts = [words.take(pa.array(ids[at + k])) for k in range(n)]
    out = pc.binary_join_element_wise(*parts, pa.scalar(b" ", words.type)) if n > 1 else parts[0]
    return out.cast(pa.large_string()).cast(pa.string())


def count_shard(lang: str, text: bytes, n: int, bitmap: np.ndarray | None):
    """(phrases, counts) of one shard: of up to `n` words and, as the empty phrase, the number of words; with a bitmap only of n words, where it holds both parts."""
    ids, words = word_ids(text)
    starts = np.flatnonzero(ids)
    if bitmap is None:
        yield pa.array([""]), np.array([len(starts)])
    else:
        starts = starts[starts <= len(ids) - n]
        hashes = _word_hashes(lang, words.to_pylist())[ids]
        for at in (0, 1):
            bit = _mixed([hashes[starts + at + k] for k in range(n - 1)]) % _U(8 * len(bitmap))
            inside = np.all([ids[starts + at + k] > 0 for k in range(n - 1)], axis=0)
            starts = starts[inside & (bitmap[(bit >> _U(3)).astype(np.int64)] >> (bit & _U(7)).astype(np.uint8) & 1).astype(bool)]
    for k, at, count in intervals(ids, n, starts):
        if len(at) and (bitmap is None or k == n):
            yield _joined(ids, words, at, k), count


def _counted(docs: DataFrame, n: int, bitmap=None, shard: int = SHARD_BYTES) -> DataFrame:
    """lang_, phrase, a: counts over all of `docs` (lang_, t_)."""

    def run(batches):
        bits = None if bitmap is None else np.frombuffer(bitmap.value, np.uint8)
        held: dict[str, list[bytes]] = {}
        size = 0

        def flush():
            for lang, texts in held.items():
                whole, at = BREAK.join(texts), 0
                while at < len(whole):  # a very long text is cut where a piece ends
                    end = whole.find(BREAK, at + shard)
                    end = len(whole) if end < 0 else end
                    for phrases, count in count_shard(lang, whole[at:end], n, bits):
                        for i in range(0, len(phrases), ROWS):
                            part = phrases.slice(i, ROWS)
                            yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang), len(part)), part, pa.array(count[i : i + ROWS], pa.int64())], ["lang_", "phrase", "a"])
                    at = end + 1
            held.clear()

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = text.as_buffer().to_pybytes().decode("utf-8", "replace").encode()
                held.setdefault(lang, []).append(raw.translate(BYTES))
                size += len(raw)
                if size >= shard:
                    yield from flush()
                    size = 0
        yield from flush()

    rows = docs.mapInArrow(tidied(run), "lang_ string, phrase string, a bigint")
    return rows.groupBy("lang_", "phrase").agg(F.sum("a").alias("a"))


def _bitmap(phrases: DataFrame, bits: int):
    """The broadcast bitmap of `phrases` (lang_, phrase), of a fixed number of bits; blocks of it are put together by tasks."""

    def run(batches):
        for b in batches:
            out = []
            for lang, phrase in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                out.append(int(_mixed([h.reshape(1) for h in _word_hashes(lang, phrase.encode().split(b" "))])[0]) % bits)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], ["bit"])

    block = 8192
    rows = phrases.select("lang_", "phrase").mapInArrow(run, "bit bigint").groupBy(F.floor(F.col("bit") / block).alias("block")).agg(F.collect_set((F.col("bit") % block).cast("int")).alias("at"))
    held = np.zeros(bits, bool)
    for r in rows.toLocalIterator():  # at most bits / block rows
        held[r.block * block + np.array(r.at)] = True
    return phrases.sparkSession.sparkContext.broadcast(np.packbits(held, bitorder="little").tobytes())


def frequent_phrases(df: DataFrame, text: str = "text", lang: str = "lang", *, words: int = WORDS, least: int = LEAST, bits: int = FILTER_BITS, shard: int = SHARD_BYTES) -> DataFrame:
    """lang_, phrase, a, k (its words): all phrases of 1 to `words` words that occur `least` times; and phrase "" with all word occurrences of a language."""
    docs = df.select(F.coalesce(F.col(lang).cast("string"), F.lit(NO_LANG)).alias("lang_"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t_"))
    size = F.when(F.col("phrase") == "", 0).otherwise(F.size(F.split("phrase", " ")))
    kept = lambda counted: checkpointed(counted.filter((F.col("a") >= least) | (F.col("phrase") == "")).withColumn("k", size))
    found = level = kept(_counted(docs, min(2, words), shard=shard))
    for n in range(3, words + 1):
        bitmap = _bitmap(level.filter(F.col("k") == n - 1), bits)
        level = kept(_counted(docs, n, bitmap, shard))
        bitmap.unpersist()
        found = found.unionByName(level)
    return found


def _slice(start: Column | int, length: Column) -> Column:
    return F.array_join(F.slice("w", start, length), " ")


def collocations(
    df: DataFrame, text: str = "text", lang: str = "lang", *, words: int = WORDS, least: int = LEAST, covered: int = COVERED, top: int = TOP, bits: int = FILTER_BITS, shard: int = SHARD_BYTES
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first `top` phrases of each language.

    Words are what blanks and tabs separate in the pieces that `.,;:!?` and line ends leave, with A-Z in lower case. A phrase of 2 to `words` words
    that occurs a >= `least` times is cut where floor(1000000 a a / (l r)) is least (then after the fewest words), l and r
    being the counts of its parts; it is dropped if a longer such phrase that contains it has `covered` percent of its count. Order:
    score, then count, descending, then the phrase in UTF-8 byte order. A null text counts as empty, a null language as NO_LANG;
    repeated rows count again; a language without such phrases and an empty table give no rows. Other columns aren't read, whatever their names.
    Arithmetic is in decimals of 38 digits: exact for counts below 10^16, an error beyond.
    """
    found = checkpointed(frequent_phrases(df, text, lang, words=words, least=least, bits=bits, shard=shard))
    phrases = found.filter("k >= 2").withColumn("w", F.split("phrase", " "))
    # each cut's two parts, looked up in one join; parts of a frequent phrase are frequent
    cuts = phrases.select("lang_", "phrase", "a", "k", "w", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    sides = F.array(F.struct(F.lit("l").alias("side"), _slice(1, F.col("cut")).alias("part")), F.struct(F.lit("r").alias("side"), _slice(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("part")))
    parts = cuts.select("lang_", "phrase", "a", "k", "cut", F.explode(sides).alias("s")).select("lang_", "phrase", "a", "k", "cut", "s.side", "s.part")
    counts = found.select("lang_", F.col("phrase").alias("part"), F.col("a").alias("f"))
    side = lambda x: F.max(F.when(F.col("side") == x, F.col("f"))).alias(x)
    scored = parts.join(counts, ["lang_", "part"]).groupBy("lang_", "phrase", "a", "k", "cut").agg(side("l"), side("r"))
    exact = lambda c: f"cast({c} as decimal(19,0))"
    score = F.expr(f"cast(cast({exact('a')} * {exact('a')} * 1000000BD as decimal(38,0)) div cast({exact('l')} * {exact('r')} as decimal(38,0)) as bigint)")
    best = scored.groupBy("lang_", "phrase", "a", "k").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("b"))

    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("k") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))))
    longer = phrases.filter("k > 2").select("lang_", F.explode(inner).alias("phrase"), "a").groupBy("lang_", "phrase").agg(F.max("a").alias("longer"))
    left = best.join(longer, ["lang_", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < covered * F.col("a")))
    totals = found.filter("phrase = ''").select("lang_", F.col("a").alias("n"))
    order = (F.col("b.score").desc(), F.col("a").desc(), F.col("phrase"))
    # a language's first phrases are among the first of its parts, so that no task sorts a whole language
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    left = left.withColumn("p", F.row_number().over(Window.partitionBy("lang_", part).orderBy(*order))).filter(F.col("p") <= top)
    ranked = left.withColumn("rank", F.row_number().over(Window.partitionBy("lang_").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang_").select(F.col("lang_").alias("lang"), "rank", "phrase", "a", F.col("b.l").alias("l"), F.col("b.r").alias("r"), "n", F.col("b.score").alias("score"))
