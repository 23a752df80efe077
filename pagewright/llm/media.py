"""Media columns: signature sniffing with format validators, type correction and carving.

One Aho-Corasick automaton over all magic bytes (as Latin-1) finds the places where a file could begin; the format's validator
then follows its structure and lengths and tells where the file ends, or that it isn't one. The value's type is that of the
valid file at offset 0; valid files further inside, that no larger valid file holds, are carved.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import tidied

#: Payloads are padded with zero bytes to a positive multiple of this.
UNIT = 64
RATE = 8000


def pad(payload: bytes) -> bytes:
    """The payload with zero bytes up to a positive multiple of UNIT."""
    return payload + bytes(-len(payload) % UNIT if payload else UNIT)


def wav(samples: bytes) -> bytes:
    """A one-channel 8-bit PCM file of the samples, without loss. The format's sizes are 32-bit."""
    if len(samples) + 37 >= 1 << 32:
        raise ValueError("more samples than a RIFF file can hold")
    odd = len(samples) & 1
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples) + odd, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(samples)) + samples + bytes(odd)


# Validators: f(data, at, memo) gives the offset behind the file that begins at `at`, or None. `memo` is a dict that lives as long as one value
# is sniffed: what one attempt has learned about a place (a chain of pages that breaks off, a stream that is no stream) isn't found out again by the
# next, so that many magic bytes in one value take time linear in its length.


def _followed(p: int, step: Callable[[int], int | tuple], known: dict):
    """What ends the chain of parts from `p` on. step(p) is the place of the next part, further on, or (what ends it,).

    Each place that is passed is remembered in `known`, so that chains that run together are walked once.
    """
    passed: list[int] = []
    while p not in known:
        passed.append(p)
        after = step(p)
        if isinstance(after, tuple):
            known[p] = after[0]
            break
        p = after
    known.update(dict.fromkeys(passed, known[p]))
    return known[p]


class _Chunks:
    """The forest of RIFF chunks of one value: each place has one next place. Nodes keep a jump of a skew-binary length, so that a later place on a chain is found in log steps."""

    def __init__(self, d: bytes):
        self.d, self.node = d, {}  # place: (next, jump, length of the chain, chunks of each needed kind on it)

    def _walk(self, p: int) -> None:
        passed = []
        while p not in self.node:
            if p + 8 > len(self.d):
                self.node[p] = (p, p, 0, (0, 0, 0))
                break
            passed.append(p)
            n = int.from_bytes(self.d[p + 4 : p + 8], "little")
            p += 8 + n + (n & 1)
        for q in reversed(passed):
            after, (_, jump, length, seen) = p, self.node[p]
            far = self.node[jump]
            # the lengths of two equal jumps behind each other become one
            to = far[1] if length - far[2] == far[2] - self.node[far[1]][2] else after
            kind = self.d[q : q + 4]
            self.node[q] = (after, to, length + 1, tuple(s + (kind == k) for s, k in zip(seen, (b"fmt ", b"data", b"LIST"), strict=True)))
            p = q

    def between(self, p: int, end: int) -> tuple | None:
        """How many chunks of each needed kind the chain from `p` has before `end`; None if it doesn't pass `end`."""
        self._walk(p)
        at = p
        while at < end:
            after, jump, length, _ = self.node[at]
            if not length:
                return None
            at = jump if jump <= end else after
        return tuple(a - b for a, b in zip(self.node[p][3], self.node[end][3], strict=True)) if at == end else None


def _riff(d: bytes, at: int, memo: dict) -> int | None:
    if len(d) < at + 12:
        return None
    end, kind = at + 8 + int.from_bytes(d[at + 4 : at + 8], "little"), d[at + 8 : at + 12]
    if end > len(d) or end < at + 20 or kind not in (b"WAVE", b"WEBP", b"AVI "):
        return None
    chunks = memo.get("riff") or memo.setdefault("riff", _Chunks(d))
    seen = chunks.between(at + 12, end)
    if seen is None:
        return None
    fmt, data, listed = seen
    return end if {b"WAVE": fmt and data, b"AVI ": listed}.get(kind, True) else None


#: Ranges from this size on get their CRC from those of prefixes, kept at each STRIDE bytes.
LONG, STRIDE = 1 << 16, 1 << 12


def _times(a: int, b: int) -> int:
    """The product of two polynomials modulo that of CRC-32; the highest bit is the constant term."""
    out = 0
    while a:
        if a & 1 << 31:
            out ^= b
        a = a << 1 & 0xFFFFFFFF
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
    return out


@lru_cache(maxsize=1)
def _powers() -> tuple[int, ...]:
    """x to the power 8 * 2^k, for k up to 40."""
    out = [1 << 23]
    for _ in range(40):
        out.append(_times(out[-1], out[-1]))
    return tuple(out)


def _crc(d: bytes, start: int, end: int, memo: dict) -> int:
    """CRC-32 of d[start:end]; that of a long range from two prefixes, so that long ranges that overlap don't add up."""
    view = memoryview(d)
    if end - start < LONG:
        return zlib.crc32(view[start:end])
    if "crc" not in memo:
        kept = memo.setdefault("crc", [0])
        for p in range(0, len(d) - STRIDE + 1, STRIDE):
            kept.append(zlib.crc32(view[p : p + STRIDE], kept[-1]))
    prefix = lambda p: zlib.crc32(view[p // STRIDE * STRIDE : p], memo["crc"][p // STRIDE])
    moved, n = prefix(start), end - start
    for k, power in enumerate(_powers()):
        if n >> k & 1:
            moved = _times(moved, power)
    return prefix(end) ^ moved


def _png(d: bytes, at: int, memo: dict) -> int | None:
    def whole(p: int) -> tuple[bytes, int] | None:
        """Kind and end of the chunk at `p`, if it fits; its bytes aren't looked at."""
        end = p + 12 + int.from_bytes(d[p : p + 4], "big")
        return (d[p + 4 : p + 8], end) if p + 12 <= len(d) and end <= len(d) else None

    sound = lambda p, end: _crc(d, p + 4, end - 4, memo) == int.from_bytes(d[end - 4 : end], "big")

    def shape(p: int):
        chunk = whole(p)
        if chunk is None or chunk[0] == b"IHDR":
            return (None,)
        return (chunk[1] if chunk[1] == p + 12 else None,) if chunk[0] == b"IEND" else chunk[1]

    def checked(p: int):
        kind, end = whole(p)
        if not sound(p, end):
            return (None,)
        return (end,) if kind == b"IEND" else end

    head = whole(at + 8)
    if head is None or head != (b"IHDR", at + 33) or not sound(at + 8, at + 33):
        return None
    # only chunks of chains that reach an end have their bytes checked
    if _followed(at + 33, shape, memo.setdefault("png shape", {})) is None:
        return None
    return _followed(at + 33, checked, memo.setdefault("png", {}))


def _gif(d: bytes, at: int, memo: dict) -> int | None:
    if len(d) < at + 14:
        return None
    inner = memo.setdefault("gif data", {})
    colours = lambda flags: 3 << ((flags & 7) + 1) if flags & 128 else 0

    def piece(q: int):
        return q + d[q] + 1 if q < len(d) and d[q] else (q + 1,)

    def block(p: int):
        if p >= len(d):
            return (None,)
        if d[p] == 0x3B:
            return (p + 1,)
        if d[p] == 0x21:
            return _followed(p + 2, piece, inner)
        if d[p] == 0x2C and p + 10 < len(d):
            return _followed(p + 11 + colours(d[p + 9]), piece, inner)
        return (None,)

    return _followed(at + 13 + colours(d[at + 10]), block, memo.setdefault("gif", {}))


def _jpeg(d: bytes, at: int, memo: dict) -> int | None:
    if at + 6 > len(d) or d[at + 3] in (0x00, 0x01, 0xFF) or 0xD0 <= d[at + 3] <= 0xD9:
        return None  # no segment begins so
    scans = memo.setdefault("jpeg data", {})

    def coded(q: int):
        """Entropy-coded data up to the next marker that isn't a restart or a stuffed byte: its place, or less than 0 for the end behind it."""
        if q < 0 or q + 1 >= len(d):
            return (None,)
        if d[q + 1] == 0xD9:
            return (-(q + 2),)
        return (q,) if d[q + 1] and not 0xD0 <= d[q + 1] <= 0xD7 else _next(d, 0xFF, q + 2, memo)

    def segment(p: int):
        if p + 4 > len(d) or d[p] != 0xFF:
            return (None,)
        kind, n = d[p + 1], int.from_bytes(d[p + 2 : p + 4], "big")
        if kind in (0x00, 0x01, 0xD8, 0xD9, 0xFF) or 0xD0 <= kind <= 0xD7 or n < 2:
            return (None,)
        if kind != 0xDA:
            return p + 2 + n
        stop = _followed(_next(d, 0xFF, p + 2 + n, memo), coded, scans)
        return (None,) if stop is None else (-stop,) if stop < 0 else stop

    return _followed(at + 2, segment, memo.setdefault("jpeg", {}))


def _bmp(d: bytes, at: int, memo: dict) -> int | None:
    if len(d) < at + 26:
        return None
    size, zero, start, header = struct.unpack_from("<IIII", d, at + 2)
    ok = zero == 0 and header in (12, 40, 52, 56, 64, 108, 124) and 14 + header <= start <= size
    return at + size if ok and at + size <= len(d) else None


def _next(d: bytes, byte: int, at: int, memo: dict) -> int:
    """Place of the next such byte from `at` on, or -1. What lies between a place that was asked for and the one found isn't looked at again."""
    start, found = memo.get(("next", byte), (0, -2))
    if found == -2 or at < start or 0 <= found < at:
        found = d.find(byte, at)
        memo["next", byte] = (at, found)
    return found


def _deflated(d: bytes, at: int) -> tuple[int, int, int] | None:
    """What the raw deflate stream at `at` holds: its end, and length and CRC of what it unpacks to. Input and output are handled in pieces."""
    z, p, size, crc, view = zlib.decompressobj(-15), at, 0, 0, memoryview(d)
    try:
        while not z.eof and p < len(d):
            rest = view[p : p + (1 << 16)]
            p += len(rest)
            while rest and not z.eof:
                out = z.decompress(rest, 1 << 20)
                size, crc, rest = size + len(out), zlib.crc32(out, crc), z.unconsumed_tail
    except zlib.error:
        return None
    return (p - len(z.unused_data), size, crc) if z.eof else None


def _gzip(d: bytes, at: int, memo: dict) -> int | None:
    if len(d) < at + 18 or d[at + 3] & 0xE0:
        return None
    flags, p = d[at + 3], at + 10
    if flags & 4:
        p += 2 + int.from_bytes(d[p : p + 2], "little")
    for name in (8, 16):
        if flags & name:
            if (end := _next(d, 0, p, memo)) < 0:
                return None
            p = end + 1
    start = p + 2 if flags & 2 else p
    streams = memo.setdefault("deflate", {})
    if start not in streams:
        streams[start] = _deflated(d, start)
    if streams[start] is None or (flags & 2 and zlib.crc32(memoryview(d)[at:p]) & 0xFFFF != int.from_bytes(d[p : p + 2], "little")):
        return None
    end, size, crc = streams[start]
    return end + 8 if d[end : end + 8] == struct.pack("<II", crc, size & 0xFFFFFFFF) else None


def _zip(d: bytes, at: int, memo: dict) -> int | None:
    """The closing record tells where its archive begins, so all closing records are looked up once for the whole value."""
    if "zip" not in memo:
        ends: dict[int, int] = memo.setdefault("zip", {})
        end = d.find(b"PK\5\6")
        while 0 <= end <= len(d) - 22:
            entries, size, offset, note = struct.unpack_from("<HIIH", d, end + 10)
            if end + 22 + note <= len(d) and (not entries or d[end - size : end - size + 4] == b"PK\1\2"):
                ends.setdefault(end - size - offset, end + 22 + note)
            end = d.find(b"PK\5\6", end + 4)
    return memo["zip"].get(at)


def _pdf(d: bytes, at: int, memo: dict) -> int | None:
    if not (d[at + 5 : at + 6].isdigit() and d[at + 6 : at + 7] == b"."):
        return None
    first = d.find(b"%PDF-", at + 5)
    end = d.rfind(b"%%EOF", at, first if first >= 0 else len(d))
    return end + 5 if end >= 0 and d.find(b"startxref", at, end) >= 0 else None


def _ogg(d: bytes, at: int, memo: dict) -> int | None:
    p, serial, broken, passed = at, d[at + 14 : at + 18], memo.setdefault("ogg", set()), []
    while p not in broken and p + 27 <= len(d) and d[p : p + 5] == b"OggS\0" and d[p + 14 : p + 18] == serial:
        passed.append(p)
        n = d[p + 26]
        last = d[p + 5] & 4
        p += 27 + n + sum(d[p + 27 : p + 27 + n])
        if last and p <= len(d):
            return p
    broken.update(passed)  # nor does the stream end for what begins at one of its pages
    return None


#: Boxes that a file of this family has at its top level.
BOXES = frozenset((b"ftyp", b"moov", b"mdat", b"free", b"skip", b"udta", b"meta", b"moof", b"sidx", b"styp", b"mfra", b"uuid", b"wide", b"pdin"))


def _mp4(d: bytes, magic: int, memo: dict) -> int | None:
    p, seen, passed = magic - 4, set(), []  # the magic bytes follow the length
    known: dict[int, int | None] = memo.setdefault("mp4", {})  # box: None if its chain is cut off, else the end of a chain of ftyp only
    while 0 <= p and p + 8 <= len(d) and d[p + 4 : p + 8] in BOXES:
        n = int.from_bytes(d[p : p + 4], "big")
        n = int.from_bytes(d[p + 8 : p + 16], "big") if n == 1 else n
        end = known.get(p, -1)
        if end is None or (end < 0 and (n < 8 or p + n > len(d))):
            known.update(dict.fromkeys(passed))
            return None
        seen.add(d[p + 4 : p + 8])
        if end >= 0:
            p = end
            break
        passed.append(p)
        p += n
    if b"ftyp" in seen and len(seen) > 1:
        return p
    known.update(dict.fromkeys(passed, p))
    return None


#: Type, magic bytes, offset of the magic bytes in the file, validator.
FORMATS: tuple[tuple[str, bytes, int, Callable[[bytes, int, dict], int | None]], ...] = (
    ("riff", b"RIFF", 0, _riff),
    ("image/png", b"\x89PNG\r\n\x1a\n", 0, _png),
    ("image/gif", b"GIF87a", 0, _gif),
    ("image/gif", b"GIF89a", 0, _gif),
    ("image/jpeg", b"\xff\xd8\xff", 0, _jpeg),
    ("image/bmp", b"BM", 0, _bmp),
    ("application/gzip", b"\x1f\x8b\x08", 0, _gzip),
    ("application/zip", b"PK\3\4", 0, _zip),
    ("application/pdf", b"%PDF-", 0, _pdf),
    ("audio/ogg", b"OggS\0", 0, _ogg),
    ("video/mp4", b"ftyp", 4, _mp4),
)
RIFF = {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/avi"}


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for i, (_, magic, _, _) in enumerate(FORMATS):
        a.add_word(magic.decode("latin-1"), i)
    a.make_automaton()
    return a


def sniff(data: bytes) -> list[tuple[str, int, int]]:
    """(type, start, end) of the valid files in `data`, outermost only, by start."""
    found, behind, memo = [], 0, {}
    for last, i in _automaton().iter(data.decode("latin-1")):
        kind, magic, offset, valid = FORMATS[i]
        at = last + 1 - len(magic)
        if at - offset < behind or (end := valid(data, at, memo)) is None:
            continue
        found.append((RIFF[data[at + 8 : at + 12]] if kind == "riff" else kind, at - offset, end))
        behind = end
    return found


def wav_samples(data: bytes, start: int, end: int) -> bytes:
    """The bytes of the data chunk of a valid WAVE file."""
    p = start + 12
    while p + 8 <= end:
        n = int.from_bytes(data[p + 4 : p + 8], "little")
        if data[p : p + 4] == b"data":
            return data[p + 8 : p + 8 + n]
        p += 8 + n + (n & 1)
    raise ValueError("no data chunk")


def sniff_media(df: DataFrame, key: str, media: str, declared: str | None = None) -> DataFrame:
    """One row per row of `df`: key, declared, detected (type of the file at offset 0, or null), corrected (whether both differ),
    type (detected, else declared), files (array of type, start and length, the carved ones included). A null value has no files."""
    kept = df.select(F.col(key).alias("key_"), F.col(media).cast("binary").alias("m"), (F.col(declared) if declared else F.lit(None)).cast("string").alias("d"))
    schema = f"key_ {kept.schema['key_'].dataType.simpleString()}, declared string, detected string, corrected boolean, type string, files array<struct<type:string,start:bigint,length:bigint>>"
    files = pa.list_(pa.struct([("type", pa.string()), ("start", pa.int64()), ("length", pa.int64())]))

    def run(batches):
        for b in batches:
            rows = []
            for m, d in zip(b.column(1), b.column(2).to_pylist(), strict=True):
                got = sniff(m.as_buffer().to_pybytes()) if m.is_valid else []
                kind = next((k for k, s, _ in got if s == 0), None)
                rows.append((d, kind, kind is not None and kind != d, kind or d, [{"type": k, "start": s, "length": e - s} for k, s, e in got]))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.string(), pa.string(), pa.bool_(), pa.string(), files)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], ["key_", "declared", "detected", "corrected", "type", "files"])

    return kept.mapInArrow(tidied(run), schema).withColumnRenamed("key_", key)


def store_texts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Media rows of texts: key, n_bytes (of the text in UTF-8), media (a WAVE file of the padded bytes), declared (unknown)."""
    kept = df.select(F.col(key).alias("key_"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("t"))

    def run(batches):
        for b in batches:
            raw = [x.as_buffer().to_pybytes() for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array([wav(pad(x)) for x in raw], pa.binary())], ["key_", "n_bytes", "media"])

    schema = f"key_ {kept.schema['key_'].dataType.simpleString()}, n_bytes bigint, media binary"
    return kept.mapInArrow(tidied(run), schema).select(F.col("key_").alias(key), "n_bytes", "media", F.lit("application/octet-stream").alias("declared"))


def media_features(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """Reads stored media back: key, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    Narrow: no shuffle. `feature` holds the detected type, whether the declared one was corrected, the number of carved files
    inside the payload, and count, mean and zero crossings of the samples. A null text is stored as 64 zero bytes, as an
    empty one is; null and repeated keys and repeated rows are carried along; an empty table gives no rows; other columns are not read.
    """
    import numpy as np

    schema = f"key_ {media.schema[key].dataType.simpleString()}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for b in batches:
            rows = []
            for m, d in zip(b.column(2), b.column(3).to_pylist(), strict=True):
                data = m.as_buffer().to_pybytes()
                kind, start, end = sniff(data)[0]
                payload = wav_samples(data, start, end)
                inner = sniff(payload)
                x = np.frombuffer(payload, np.uint8)
                high = x >= 128
                feature = f"{kind};corrected={int(kind != d)};carved={','.join(k for k, _, _ in inner) or '-'};samples={len(x)};sum={int(x.sum(dtype=np.int64))};crossings={int(np.count_nonzero(high[1:] != high[:-1]))}"
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), feature))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names)

    return media.select(F.col(key).alias("key_"), "n_bytes", "media", "declared").mapInArrow(tidied(run), schema).withColumnRenamed("key_", key)
