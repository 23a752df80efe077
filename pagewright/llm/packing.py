"""Packing token sequences by linear grouping and best fit.

A capacity of C tokens leaves at most C different lengths, however many pieces there are, so all that the plan needs is how many
pieces have each length. It is made on the driver from this histogram alone:

1. Pieces longer than C / SMALL are large. In order of length they are put into groups of equal cardinality, and each group's
   lengths count as its greatest. Few sizes are left.
2. For these sizes the linear programme of configurations is solved by column generation: a knapsack over C finds the configuration
   that the present prices make best, until none is better. Whole parts are taken; of what is left, each group has less than one
   configuration for each size, which is put where it fits best.
3. Actual lengths take the places of the rounded ones. The free rest of each sequence is known by this, in runs of equal sequences.
4. Small pieces go, longest first, to the sequence with the least rest that takes them, by runs as well.

The plan is a table of runs: pieces number a to b of a length go to sequences from s on, q to each. Its size depends on C alone. Pieces are
numbered within their length without gathering a length in one task: each task counts its own, and counts are added up over tasks.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.bpe import _Memo
from pagewright.llm.common import checkpointed, tidied

#: Tokens of a sequence, and the id that ends each document.
CAPACITY, END = 4096, 1
#: Pieces beyond this part of the capacity are large; numbers of groups that are tried, of which the one with the fewest sequences is taken.
SMALL, GROUPS = 8, (16, 32, 64)
#: Words in each of the two generations of a worker's memo.
WORDS = 300_000
#: Letters and signs for which this module cuts words itself: they have no decompositions, and their lower case depends on no neighbour.
LETTERS = "a-zß-öø-ÿĀ-įı-ňŊ-ž"
PLAIN = re.compile("[\t-\r -~¡-©«¬®-±´¶-¸»¿-ÿĀ-įı-ňŊ-ž‐-‧]*")
CUT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^\s{LETTERS}0-9]+")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in the vocabulary: printable ones for themselves, the others from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordTokens:
    """Ids (packed as 32-bit little-endian) of texts by a tokenizer file whose words end at white space, with memos of words.

    Words of plain texts are cut here and merged by the file's model. Other texts are cut at ASCII white space, across which no
    word, normal form or lower case reaches, and what isn't plain in them goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.words, self.chunks = _Memo(self._word, WORDS), _Memo(self._chunk, WORDS // 10)

    def _word(self, word: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize("".join([self.letters[b] for b in word.encode()]))]).tobytes()

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, CUT.findall(text.lower())))

    def _chunk(self, chunk: str) -> bytes:
        if PLAIN.fullmatch(chunk) and "<|" not in chunk:
            return self._plain(chunk)
        return array("I", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()

    def packed(self, text: str) -> bytes:
        if PLAIN.fullmatch(text) and "<|" not in text:
            return self._plain(text)
        return b"".join([self.chunks[c.decode()] for c in text.encode("utf-8", "surrogatepass").split()])


@lru_cache(maxsize=1)
def words_of(path: str) -> WordTokens:
    """The tokenizer of a file, made once in each Python worker."""
    return WordTokens(path)


def _best_column(price: np.ndarray, size: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The configuration of the highest price that fits: an exact knapsack, by number of members."""
    best, taken = np.zeros(capacity + 1), []
    for _ in range(capacity // int(size.min())):
        new, who = best.copy(), np.full(capacity + 1, -1)
        for k, s in enumerate(size):
            with_k = best[: capacity + 1 - s] + price[k]
            better = with_k > new[s:] + 1e-12
            new[s:][better], who[s:][better] = with_k[better], k
        if (who < 0).all():
            break
        best = new
        taken.append(who)
    column, room = np.zeros(len(size)), capacity
    for who in reversed(taken):
        if (k := who[room]) >= 0:
            column[k] += 1
            room -= size[k]
    return float(best[capacity]), column


def configurations(size: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Configurations (members by size) and how often each is used; together they hold the demand, whole parts of the programme's optimum and a rest."""
    base = np.diag(capacity // size).astype(float)
    used = demand / np.diag(base)
    for _ in range(40 * len(size)):
        value, column = _best_column(np.linalg.solve(base.T, np.ones(len(size))), size, capacity)
        if value <= 1 + 1e-9:
            break
        step = np.linalg.solve(base, column)
        ratio = np.where(step > 1e-9, used / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        base[:, out] = column
        used = np.maximum(np.linalg.solve(base, demand.astype(float)), 0)
    times = np.floor(used + 1e-9).astype(int)
    while ((left := demand - base.astype(int) @ times) < 0).any():  # a float that was rounded up
        short = int(left.argmin())
        times[np.flatnonzero((base[short] > 0) & (times > 0))[0]] -= 1
    out = [(base[:, j].astype(int), int(n)) for j, n in enumerate(times) if n]
    rest: list[list] = []  # [room, members]
    for k in np.argsort(-size, kind="stable"):
        for _ in range(int(left[k])):
            fitting = [b for b in rest if b[0] >= size[k]]
            if not fitting:
                fitting = [[capacity, np.zeros(len(size), int)]]
                rest += fitting
            tightest = min(fitting, key=lambda b: b[0])
            tightest[0] -= int(size[k])
            tightest[1][k] += 1
    return out + [(members, 1) for _, members in rest]


def _packed_runs(lengths: list[int], counts: list[int], capacity: int, groups: int) -> tuple[list[tuple], int]:
    """Runs (length, first number, sequence, pieces a sequence, offset) and the number of sequences; lengths descend."""
    runs: list[tuple] = []
    rooms: dict[int, list[tuple[int, int]]] = {}  # free tokens: (first sequence, how many)
    mask = 0  # bit r is set where rooms[r] holds any

    def free(room: int, first: int, n: int) -> None:
        nonlocal mask
        if room and n:
            rooms.setdefault(room, []).append((first, n))
            mask |= 1 << room

    large = sum(x * SMALL > capacity for x in lengths)
    ends = np.cumsum(counts[:large])
    bins = 0
    if large:
        total = int(ends[-1])
        cuts = ends if large <= groups else np.unique([total * (g + 1) // groups for g in range(groups)])
        cuts = cuts[cuts > 0]
        starts = np.concatenate(([0], cuts[:-1]))
        size = np.array(lengths[:large])[np.searchsorted(ends, starts, side="right")]
        at = starts.copy()
        for members, times in configurations(size, cuts - starts, capacity):
            slots = []  # the number, among all large pieces, of the one in each place of the first sequence
            for k in np.flatnonzero(members):
                for _ in range(int(members[k])):
                    slots.append(int(at[k]))
                    at[k] += times
            breaks = {0, times}
            for s in slots:
                inner = ends[np.searchsorted(ends, s, side="right") : np.searchsorted(ends, s + times, side="left")]
                breaks.update((inner - s).tolist())
            marks = sorted(breaks)
            for a, b in zip(marks, marks[1:], strict=False):
                offset = 0
                for s in slots:
                    i = int(np.searchsorted(ends, s + a, side="right"))
                    before = int(ends[i - 1]) if i else 0
                    runs.append((lengths[i], s + a - before, bins + a, 1, offset))
                    offset += lengths[i]
                free(capacity - offset, bins + a, b - a)
            bins += times
    for length, n in zip(lengths[large:], counts[large:], strict=True):
        number = 0
        while number < n:
            if above := mask >> length:
                room = length + (above & -above).bit_length() - 1
                first, many = rooms[room].pop()
            else:
                room, first, many = capacity, bins, -(-(n - number) // (capacity // length))
                bins += many
            each = room // length
            if whole := min(many, (n - number) // each):
                put, into = each, whole
            else:
                put, into = n - number, 1
            runs.append((length, number, first, put, capacity - room))
            number += put * into
            if room in rooms:
                if many > into:
                    rooms[room].append((first + into, many - into))
                elif not rooms[room]:
                    mask &= ~(1 << room)
            elif many > into:
                free(room, first + into, many - into)
            free(room - put * length, first, into)
    return runs, bins


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Runs, sorted by length and first number, of the number of groups that needs the fewest sequences; and that number of sequences."""
    lengths = sorted(histogram, reverse=True)
    counts = [histogram[x] for x in lengths]
    runs, n = min((_packed_runs(lengths, counts, capacity, g) for g in GROUPS), key=lambda x: x[1])
    return np.array(sorted(runs), dtype=np.int64).reshape(-1, 5), n


def pieces(df: DataFrame, key: str = "doc_id", text: str = "text", *, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Pieces of all documents: k_, piece, start, length, ids_crc32, and task_, local_: which piece of its length in which task it is."""
    kept = df.select(F.col(key).alias("k_"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t_"))
    names = ["piece", "start", "length", "ids_crc32", "task_", "local_"]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
    schema = f"k_ {kept.schema['k_'].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint, task_ int, local_ bigint"

    def run(batches):
        tokens, seen, task = words_of(path), Counter(), TaskContext.get().partitionId()
        last = array("I", [end]).tobytes()
        for b in batches:
            rows, of = [], []
            for i, value in enumerate(b.column(1)):
                ids = tokens.packed(value.as_buffer().to_pybytes().decode("utf-8", "replace")) + last
                n = len(ids) // 4
                for piece, start in enumerate(range(0, n, capacity)):
                    length = min(capacity, n - start)
                    rows.append((piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), task, seen[length]))
                    of.append(i)
                    seen[length] += 1
            cols = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of, pa.int64())), *map(pa.array, cols, kinds)], ["k_", *names])
        for memo in (tokens.words, tokens.chunks):
            memo.old = {}

    return kept.mapInArrow(tidied(run), schema)


def pack_documents(df: DataFrame, key: str = "doc_id", text: str = "text", *, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """One row per piece of each row of `df`: its key, piece, start, length, ids_crc32, sequence_id and offset.

    A document is the ids of its text by the tokenizer file `path` (special tokens aren't added, but are known where their strings
    occur), then `end`. Only a document longer than the capacity is cut, into pieces of it. A null or empty text has `end` alone; a repeated row
    or key is a document of its own; a null key stays null. An empty table gives no rows. Other columns of `df` aren't read,
    whatever their names. Which of several pieces of one length goes where is decided by their place in the input.
    `path` must name the file on every executor.
    """
    cut = checkpointed(pieces(df, key, text, path=path, capacity=capacity, end=end))
    counts = checkpointed(cut.groupBy("task_", "length").agg(F.count("*").alias("n_")))
    # at most `capacity` rows
    runs, _ = plan({r.length: r.n for r in counts.groupBy("length").agg(F.sum("n_").alias("n")).collect()}, capacity)
    before = F.coalesce(F.sum("n_").over(Window.partitionBy("length").orderBy("task_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = cut.join(counts.select("task_", "length", before.alias("before_")), ["task_", "length"])
    numbered = numbered.select("k_", "piece", "start", "length", "ids_crc32", (F.col("before_") + F.col("local_")).alias("number_"))
    kind = numbered.schema["k_"].dataType.simpleString()
    places = runs[:, 0] << 44 | runs[:, 1]

    def placed(batches):
        for b in batches:
            length, number = (b.column(i).to_numpy() for i in (3, 5))
            at = np.searchsorted(places, length << 44 | number, side="right") - 1
            along = number - runs[at, 1]
            sequence, offset = runs[at, 2] + along // runs[at, 3], runs[at, 4] + along % runs[at, 3] * length
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], ["k_", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    out = numbered.mapInArrow(placed, f"k_ {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
    return out.withColumnRenamed("k_", key)
