"""Byte-level BPE encoding and decoding by backtracking over longest matches.

Every token is put into an Aho-Corasick automaton as a Latin-1 string (one character a byte). The encoder walks a piece from
left to right with the longest token at each place, goes back to a shorter one where two neighbours could not stand side by
side in the result of the merges, and remembers from which places no encoding exists, so that each place is left at most once.
Whether two tokens can be neighbours is decided by undoing merges along their common border and is memoised. The ids are
those that the merges in rank order give.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import tidied

#: Entries in each of the two generations of a worker's memo, for pieces and for pairs of tokens, and characters of the longest piece
#: that is remembered, so that a generation has some 40 MB at most. Results don't depend on them.
MEMO, PAIRS, REMEMBERED = 120_000, 60_000, 32
#: Pieces handled at once, so that a very long text needs little memory besides itself.
CHUNK = 200_000


class _Memo(dict):
    """A dict that computes what it lacks. When it is full it becomes the old generation, from which used entries return."""

    def __init__(self, make, most=MEMO):
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        value = self.old[key] if key in self.old else self.make(key)
        if key.__class__ is str and len(key) > REMEMBERED:
            return value
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class BytePairCodec:
    """Encoder and decoder for one rank table {token bytes: id}, in which all 256 single bytes occur."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        self.ranks = ranks
        self.token = {i: t for t, i in ranks.items()}
        self.pieces = regex.compile(pattern)
        self.automaton = ahocorasick.Automaton()
        self.parts = {i: self._parts(t, i) for t, i in ranks.items()}
        self.size = {i: len(t) for t, i in ranks.items()}
        for t, i in ranks.items():
            if len(t) == 1 or self.parts[i]:  # others are never the result of merges
                self.automaton.add_word(t.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.merged = {p: i for i, p in self.parts.items() if p}
        self.shorter = _Memo(self._shorter)
        self.neighbours = _Memo(self._neighbours, PAIRS)
        self.memo = _Memo(self._packed)
        self.decimal = {i: str(i) for i in self.token}

    def _parts(self, token: bytes, rank: int) -> tuple[int, int] | None:
        """The two tokens that the merges join last when they make `token`."""
        if len(token) == 1:
            return None
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            at = min(range(len(parts) - 1), key=lambda i: (self.ranks.get(parts[i] + parts[i + 1], rank), i))
            if self.ranks.get(parts[at] + parts[at + 1], rank) >= rank:
                return None  # the merges never reach this token
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return self.ranks[parts[0]], self.ranks[parts[1]]

    def _shorter(self, i: int) -> int | None:
        """The longest token that is a proper prefix of token i."""
        t = self.token[i]
        found = (self.ranks.get(t[:n]) for n in range(len(t) - 1, 0, -1))
        return next((j for j in found if j is not None and (self.size[j] == 1 or self.parts[j])), None)

    def _neighbours(self, pair: int) -> bool:
        """Whether the merges can leave two tokens (packed as left << 32 | right) side by side.

        The later of the two merges along the border is undone again and again; a pair that could merge at a moment
        before either side had become whole would have been merged.
        """
        left, right = pair >> 32, pair & 0xFFFFFFFF
        before = 1 << 62
        while True:
            if self.merged.get((left, right), before) < before:
                return False
            a, b = self.parts[left], self.parts[right]
            if a is None and b is None:
                return True
            # of equal ranks the left one merges first, so the right one is undone first
            if b is None or (a is not None and left > right):
                before, left = left, a[1]
            else:
                before, right = right + 1, b[0]

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of one piece of the pattern."""
        raw = piece.encode("utf-8", "surrogatepass")
        if (whole := self.ranks.get(raw)) is not None and (len(raw) == 1 or self.parts[whole]):
            return [whole]
        n = len(raw)
        longest: list[int] = [0] * n
        size, shorter, neighbours = self.size, self.shorter, self.neighbours
        for end, i in self.automaton.iter(raw.decode("latin-1")):
            longest[end + 1 - size[i]] = i  # ends only grow: the last is the longest
        open_ = bytearray(b"\1") * (n + 1)
        out: list[int] = []
        at, wanted = 0, longest[0]
        while at < n:
            end = at + size[wanted]
            if open_[end] and (not out or neighbours[out[-1] << 32 | wanted]):
                out.append(wanted)
                at = end
                wanted = longest[at] if at < n else 0
            elif (less := shorter[wanted]) is not None:
                wanted = less
            else:
                open_[at] = 0
                wanted = out.pop()
                at -= size[wanted]
        return out

    def _packed(self, piece: str) -> bytes:
        return array("I", self.encode_piece(piece)).tobytes()

    def encode(self, text: str) -> Iterator[tuple[str, bytes]]:
        """Chunks of a text: the decimal ids joined by spaces, and the ids as little-endian 32-bit integers."""
        found = self.pieces.finditer(text) if len(text) > 1_000_000 else None
        if found is None:
            yield self._chunk(self.pieces.findall(text))
        else:
            while pieces := [m[0] for m in islice(found, CHUNK)]:
                yield self._chunk(pieces)

    def _chunk(self, pieces: list[str]) -> tuple[str, bytes]:
        packed = b"".join(map(self.memo.__getitem__, pieces))
        return " ".join(map(self.decimal.__getitem__, memoryview(packed).cast("I"))), packed

    def decode(self, packed: bytes) -> bytes:
        """The bytes that packed ids stand for."""
        return b"".join(map(self.token.__getitem__, memoryview(packed).cast("I")))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> BytePairCodec:
    """The codec of a rank file (lines of base64 token and rank), built once in each Python worker."""
    with open(path, "rb") as f:
        return BytePairCodec({base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}, pattern)


def encode_bpe(df: DataFrame, key: str = "doc_id", text: str = "text", *, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """One row per row of `df`: its key, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids (32-bit little-endian).

    Narrow: no shuffle. A null text counts as empty: 0 tokens and the digests of nothing. Empty tables give no rows; a null key
    stays null; repeated rows give repeated rows; other columns of `df`, whatever their names, are not read. Lone
    surrogates can't occur, as Spark's strings are UTF-8 (invalid bytes count as U+FFFD).
    `path` must name the rank file on every executor.
    """
    k = "key_"
    kept = df.select(F.col(key).alias(k), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t_"))
    kind = kept.schema[k].dataType.simpleString()
    schema = f"`{k}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids

    def run(batches):
        c = codec(path, pattern)
        for b in batches:
            rows = []
            for value in b.column(1):
                ids, decoded, n, packs, first = hashlib.sha256(), hashlib.sha256(), 0, [], True
                for decimal, packed in c.encode(value.as_buffer().to_pybytes().decode("utf-8", "replace")):
                    ids.update(decimal.encode() if first else b" " + decimal.encode())
                    decoded.update(c.decode(packed))
                    n += len(packed) // 4
                    first = False
                    if with_ids:
                        packs.append(packed)
                rows.append((n, ids.hexdigest(), decoded.hexdigest(), b"".join(packs)))
            cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
            out = [b.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())]
            yield pa.RecordBatch.from_arrays(out + [pa.array(cols[3], pa.binary())] * with_ids, [k, "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids)
        c.memo.old, c.neighbours.old = {}, {}

    out = kept.mapInArrow(tidied(run), schema)
    return out.withColumnRenamed(k, key)
