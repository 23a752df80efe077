"""The best pages of each prompt on the scan path, without a row for each pair of a prompt and a page.

A token's strength in a field is the share of it that its longest prefix found there has. Prefixes of what is found are found too, so
a score is a sum over found prefixes: a page is a list of them with the fields that hold each, a prompt a list of them with what each adds.
Pages come in parts, those that hold most first. A page is counted for a prompt only where what its shortest prefixes could give at most reaches
the prompt's worst kept score: this leaves none of the best out. What a worker holds is a part of the pages, a batch of the prompts and their best pages.
"""

from __future__ import annotations

import math
import re
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions import fixed
from pagewright.plans.cut import cut

#: Tokens of the prompts that are taken in one pass over the texts (a prompt of more than WIDE tokens is left to `scan.rank`), pages that a task takes at most where the cluster's cores are no limit.
ENTRIES, WIDE, PAGES = 1_000_000, 100_000, 65_536
#: Pages of a part at most, and bytes of what they hold; prompts and pairs that are counted at a time.
PART, BYTES, PROMPTS, PAIRS = 512, 96 << 20, 2_000, 20_000
WEIGHTS = np.array([sum(w for i, w in enumerate(fixed.FIELD_WEIGHTS.values()) if held >> i & 1) for held in range(1 << len(fixed.FIELD_WEIGHTS))])


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each run, one run behind the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


class Prefixes:
    """The numbered prefixes of distinct tokens, the shortest of each token first; token i has those from at[i] to at[i + 1] and each adds so many characters."""

    def __init__(self, words: list[str]):
        least = [min(len(w), 2 if re.fullmatch("[가-힣]+", w) else 4) for w in words]
        self.of: dict[str, int] = {}
        for w, n in zip(words, least, strict=True):
            self.of.setdefault(w[:n], len(self.of))
        self.shortest = len(self.of)
        nodes, adds, self.at = [], [], np.zeros(len(words) + 1, np.int64)
        for i, (w, n) in enumerate(zip(words, least, strict=True)):
            nodes += [self.of.setdefault(w[:k], len(self.of)) for k in range(n, len(w) + 1)]
            adds += [n, *[1] * (len(w) - n)]
            self.at[i + 1] = len(nodes)
        self.nodes, self.adds = np.array(nodes, np.int32), np.array(adds, np.float64)
        self.automaton = None

    def found_in(self, text: str) -> np.ndarray:
        if self.automaton is None:
            import ahocorasick

            self.automaton = ahocorasick.Automaton()
            for p, i in self.of.items():
                self.automaton.add_word(p, i)
            self.automaton.make_automaton()
        found = {i for _, i in self.automaton.iter(text)}
        return np.fromiter(found, np.int64, len(found))


_last: dict[str, Prefixes] = {}


def _prefixes(key: str, words: list[str]) -> Prefixes:
    """Those of the batch `key`. A worker keeps the last ones, as they take longer than many a task."""
    if key not in _last:
        _last.clear()
        _last[key] = Prefixes(words)
    return _last[key]


class Best:
    """The best `top` pages so far of the prompts of a batch. A prompt's tokens are those from `at` to the next one's `at` of `entries`."""

    def __init__(self, prefixes: Prefixes, words: list[str], at: np.ndarray, entries: np.ndarray, idf: np.ndarray, top: int):
        self.p, self.top, self.at, self.size = prefixes, top, at[:-1], np.diff(at)
        own, sizes = prefixes.at[:-1], np.diff(prefixes.at)
        lengths = np.array([len(w) for w in words], np.float64)
        self.first, self.idf = prefixes.nodes[own[entries]], idf[entries]
        self.wordy = np.array([not re.fullmatch("[0-9]+", w) for w in words], bool)[entries]
        spread = _spread(own[entries], sizes[entries])
        self.nodes, self.gives = prefixes.nodes[spread], prefixes.adds[spread] * np.repeat(self.idf / lengths[entries], sizes[entries])
        self.from_ = np.append(0, np.cumsum(sizes[entries]))[at]  # a prompt's prefixes
        self.most32 = self.idf.astype(np.float32)
        self.ids: list[str] = []
        self.scores = np.zeros((len(self.size), top))
        self.pages = np.full((len(self.size), top), -1, np.int64)
        self.matched, self.with_word = np.zeros_like(self.pages), np.zeros(self.pages.shape, bool)

    def take(self, pages: list[str], held: np.ndarray, begins: np.ndarray) -> None:
        """`held`: for each row the fields that hold each prefix; page i has the rows from begins[i] on."""
        base = len(self.ids)
        self.ids += pages
        single = len(begins) == len(held)
        per_page = lambda x, axis: x if single else np.add.reduceat(x, begins, axis=axis)
        most = np.ascontiguousarray(per_page(WEIGHTS[held[:, : self.p.shortest]], 0).T, dtype=np.float32)
        bound = np.append(0.0, np.cumsum(self.idf * most.max(axis=1)[self.first]))
        bound = bound[self.at + self.size] - bound[self.at]
        asked = np.flatnonzero(self._may(bound, self.scores[:, -1]))
        for i in range(0, len(asked), PROMPTS):
            some = asked[i : i + PROMPTS]
            up = np.empty((len(some), len(pages)), np.float32)
            for row, q in enumerate(some):
                e = slice(self.at[q], self.at[q] + self.size[q])
                np.dot(self.most32[e], most[self.first[e]], out=up[row])
            q, page = np.nonzero(self._may(up, self.scores[some, -1].astype(np.float32)[:, None]))
            q = some[q]
            kept = [self._counted(q[k : k + PAIRS], page[k : k + PAIRS], held, begins, single) for k in range(0, len(q), PAIRS)]
            if kept:
                q, page, score, matched, wordy = (np.concatenate(x) for x in zip(*kept, strict=True))
                self._merge(q, page + base, score, matched, wordy)

    @staticmethod
    def _may(bound, least):
        """Whether a score of at most `bound` may be kept. Bounds are sums of less precision, scores are rounded."""
        return (bound > 0) & (bound * 1.0001 + 0.001 >= least)

    def _counted(self, q: np.ndarray, page: np.ndarray, held: np.ndarray, begins: np.ndarray, single: bool):
        """Of pairs those with a score that may be kept: prompt, page, score, tokens found, whether one of these isn't a number."""
        ends = np.append(begins[1:], len(held))
        times = np.ones(len(q), np.int64) if single else ends[page] - begins[page]
        pair = np.repeat(np.arange(len(q)), times)
        row = _spread(begins[page], times)
        sizes = (self.from_[q + 1] - self.from_[q])[pair]
        at = _spread(self.from_[q][pair], sizes)
        each = np.repeat(np.arange(len(pair)), sizes)
        total = np.bincount(pair[each], WEIGHTS[held[row[each], self.nodes[at]]] * self.gives[at], len(q))
        score = np.floor(total * 1e4 + 0.5) / 1e4
        keep = (score > 0) & (score >= self.scores[q, -1])
        pair_kept = keep[pair]
        pair, row = pair[pair_kept], row[pair_kept]
        sizes = self.size[q[pair]]
        at = _spread(self.at[q[pair]], sizes)
        each = np.repeat(np.arange(len(pair)), sizes)
        hit = held[row[each], self.first[at]] > 0
        matched = np.bincount(pair[each], hit, len(q)).astype(np.int64)
        wordy = np.bincount(pair[each], hit & self.wordy[at], len(q)) > 0
        return q[keep], page[keep], score[keep], matched[keep], wordy[keep]

    def _merge(self, q, page, score, matched, wordy) -> None:
        """Pairs join the kept ones of their prompts. By score, then by page id."""
        own = np.unique(q)
        place = np.nonzero(self.pages[own] >= 0)
        join = lambda kept, new: np.concatenate([kept[own][place], new])
        q = np.concatenate([own[place[0]], q])
        page, score, matched, wordy = join(self.pages, page), join(self.scores, score), join(self.matched, matched), join(self.with_word, wordy)
        few, which = np.unique(page, return_inverse=True)
        rank = np.empty(len(few), np.int64)
        rank[sorted(range(len(few)), key=lambda i: self.ids[few[i]])] = np.arange(len(few))
        order = np.lexsort((rank[which], -score, q))
        q = q[order]
        starts = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, np.int64)
        nth = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q))))
        fits = nth < self.top
        order, q, nth = order[fits], q[fits], nth[fits]
        for kept, new in ((self.pages, page), (self.scores, score), (self.matched, matched), (self.with_word, wordy)):
            kept[q, nth] = new[order]

    def rows(self, qids: list, step: int = 100_000):
        q, nth = np.nonzero(self.pages >= 0)
        for i in range(0, len(q), step):
            at = q[i : i + step], nth[i : i + step]
            yield pd.DataFrame({"qid": [qids[k] for k in at[0]], "page_id": [self.ids[k] for k in self.pages[at]], "score": self.scores[at], "matched": self.matched[at], "wordy": self.with_word[at], "n_tokens": self.size[at[0]]})


def _found(docs: DataFrame, key: str, shared) -> DataFrame:
    """page_id, steps, held, heft of each row of `docs`: differences of the found prefixes' numbers, the fields that hold each, and the weight of the shortest ones. From each task also a row with counts: how many rows hold each of the shortest, and all rows."""
    names = list(fixed.FIELD_WEIGHTS)

    def run(frames):
        p = _prefixes(key, shared.value)
        counts, held = np.zeros(p.shortest + 1, np.int64), np.zeros(len(p.of), np.uint8)
        for f in frames:
            out = []
            for row in f.itertuples(index=False):
                for i, name in enumerate(names):
                    held[p.found_in(getattr(row, name) or "")] |= 1 << i
                nodes = np.flatnonzero(held)
                own = held[nodes]
                held[nodes] = 0
                first = int(np.searchsorted(nodes, p.shortest))
                counts[nodes[:first]] += 1
                counts[-1] += 1
                steps = np.diff(nodes, prepend=0)
                kind = np.uint16 if len(steps) == 0 or steps.max() < 1 << 16 else np.uint32
                out.append((row.page_id, steps.astype(kind).tobytes(), own.tobytes(), float(WEIGHTS[own[:first]].sum()), None))
            yield pd.DataFrame(out, columns=["page_id", "steps", "held", "heft", "counts"])
        yield pd.DataFrame([(None, None, None, None, counts.tobytes())], columns=["page_id", "steps", "held", "heft", "counts"])

    return cut(docs.select("page_id", *names).mapInPandas(run, "page_id string, steps binary, held binary, heft double, counts binary"))


def _counts(found: DataFrame) -> dict[int, int]:
    def run(frames):
        for f in frames:
            for x in f["counts"]:
                n = np.frombuffer(x, np.int64)
                at = np.flatnonzero(n)
                yield pd.DataFrame({"i": np.where(at == len(n) - 1, -1, at), "n": n[at]})

    rows = found.filter("counts IS NOT NULL").select("counts").mapInPandas(run, "i long, n long").groupBy("i").agg(F.sum("n").alias("n"))
    return {r.i: r.n for r in rows.collect()}  # bounded by the batch's tokens


def _one_batch(docs: DataFrame, tokens: DataFrame, top: int) -> DataFrame | None:
    """qid, page_id, score, matched, wordy, n_tokens: of each task the best pages of each prompt."""
    prompts = [(r.qid, r.words) for r in tokens.groupBy("qid").agg(F.collect_list("token").alias("words")).collect()]  # bounded by ENTRIES
    words = sorted({w for _, own in prompts for w in own})
    if not words:
        return None
    sc, key, number = docs.sparkSession.sparkContext, uuid.uuid4().hex, {w: i for i, w in enumerate(words)}
    shared = sc.broadcast(words)
    found = _found(docs, key, shared)
    count = _counts(found)
    n = count.get(-1, 0)
    p = Prefixes(words)
    idf = np.array([math.log(1.0 + n / (1.0 + count.get(i, 0))) for i in p.nodes[p.at[:-1]].tolist()])
    at = np.append(0, np.cumsum([len(own) for _, own in prompts]))
    entries = np.array([number[w] for _, own in prompts for w in own], np.int64)
    given = sc.broadcast(([q for q, _ in prompts], at, entries, idf))

    def run(frames):
        qids, at, entries, idf = given.value
        words = shared.value
        p = _prefixes(key, words)
        best = Best(p, words, at, entries, idf, top)
        most = max(16, min(PART, BYTES // len(p.of)))
        part = min(max(16, top), most)  # small parts at first: all pairs of the first one are counted
        held, pages, begins, used = np.zeros((most, len(p.of)), np.uint8), [], [], 0
        for f in frames:
            for page, all_steps, all_held in zip(f["page_id"], f["steps"], f["held"], strict=True):
                if used and used + len(all_steps) > part:
                    best.take(pages, held[:used], np.array(begins))
                    held[:used] = 0
                    pages, begins, used, part = [], [], 0, min(2 * part, most)
                if len(all_steps) > len(held):
                    held = np.zeros((len(all_steps), len(p.of)), np.uint8)
                pages.append(page)
                begins.append(used)
                for steps, fields in zip(all_steps, all_held, strict=True):
                    own = np.frombuffer(fields, np.uint8)
                    held[used, np.cumsum(np.frombuffer(steps, np.uint16 if len(steps) == 2 * len(own) else np.uint32), dtype=np.int64)] = own
                    used += 1
        if used:
            best.take(pages, held[:used], np.array(begins))
        yield from best.rows(qids)

    row = F.struct("steps", "held")
    pages = found.filter("counts IS NULL")
    if pages.groupBy("page_id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        pages = pages.select("page_id", "heft", F.array(row).alias("rows"))
    else:
        pages = pages.groupBy("page_id").agg(F.sum("heft").alias("heft"), F.collect_list(row).alias("rows"))
    tasks = max(sc.defaultParallelism, n // PAGES + 1)
    kind = tokens.schema["qid"].dataType.simpleString()
    dealt = pages.coalesce(tasks).sortWithinPartitions(F.desc("heft")).select("page_id", "rows.steps", "rows.held")
    return cut(dealt.mapInPandas(run, f"qid {kind}, page_id string, score double, matched long, wordy boolean, n_tokens long"))


def best(docs: DataFrame, tokens: DataFrame, top: int) -> DataFrame:
    """The rows of `scan.rank` with a rank of `top` at most."""
    from pagewright.plans.scan import rank

    r = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "page_id"))
    asked = cut(tokens.filter("qid IS NOT NULL AND token <> ''"))
    sizes = cut(asked.groupBy("qid").agg(F.count("*").alias("n")))
    wide = sizes.filter(F.col("n") > WIDE).select("qid")
    total = sizes.filter(F.col("n") <= WIDE).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    times = int(total // ENTRIES) + 1
    any_wide = not wide.isEmpty()
    narrow = asked.join(wide, "qid", "left_anti") if any_wide else asked
    docs = cut(docs) if times + any_wide > 1 else docs
    parts = [_one_batch(docs, narrow.filter(F.pmod(F.xxhash64("qid"), F.lit(times)) == i), top) for i in range(times)]
    out = [p.withColumn("rank", r).filter(F.col("rank") <= top).select("qid", "rank", "page_id", "score", "matched", "wordy", "n_tokens") for p in parts if p is not None]
    if any_wide or not out:
        out.append(rank(docs, asked.join(wide, "qid", "left_semi")).filter(F.col("rank") <= top))
    whole = out[0]
    for x in out[1:]:
        whole = whole.unionByName(x)
    return whole
