import gzip
import hashlib
import io
import random
import struct
import time
import zipfile
import zlib

from pagewright.llm import media as M


def png():
    def chunk(k, d):
        return struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def zipped():
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("a.txt", "hello")
    return b.getvalue()


FILES = {
    "image/png": png(),
    "application/zip": zipped(),
    "application/gzip": gzip.compress(b"hello" * 100),
    "audio/wav": M.wav(b"\1\2\3"),
    "image/gif": b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + bytes(6) + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\2\2\x4c\1\0\x3b",
    "image/jpeg": b"\xff\xd8\xff\xe0\0\4ab\xff\xda\0\4cdxy\xff\0z\xff\xd9",
    "image/bmp": b"BM" + struct.pack("<IIII", 58, 0, 54, 40) + bytes(40),
    "application/pdf": b"%PDF-1.4\nx\nstartxref\n0\n%%EOF",
    "audio/ogg": b"OggS\0\4" + bytes(8) + b"ser1" + bytes(8) + b"\1\3abc",
    "video/mp4": struct.pack(">I", 12) + b"ftypisom" + struct.pack(">I", 10) + b"mdatxy",
}


def test_formats_alone_embedded_and_broken():
    for kind, data in FILES.items():
        assert M.sniff(data) == [(kind, 0, len(data))], kind
        assert M.sniff(b"ab RIFF BM " + data + b" tail") == [(kind, 11, 11 + len(data))], kind
        if kind != "video/mp4":
            assert not any(s == 0 for _, s, _ in M.sniff(data[:-1])), kind
    every = b"..".join(FILES.values())
    assert [k for k, _, _ in M.sniff(every)] == list(FILES)
    assert M.sniff(M.wav(FILES["image/png"])) == [("audio/wav", 0, len(M.wav(FILES["image/png"])))]


def test_many_magic_bytes_take_linear_time():
    """1 MB of magic bytes, headers without an end and chains that break off, for each format."""
    page = b"OggS\0\0" + bytes(8) + b"ser1" + bytes(8) + b"\0"
    parts = [magic for _, magic, _, _ in M.FORMATS] + [b"\x1f\x8b\x08\x08" + b"x" * 20, b"PK\5\6" + bytes(16), page, struct.pack(">I", 8) + b"ftyp", b"PK\3\4PK\5\6", b"RIFF\xff\xff\0\0WAVE", b"%PDF-1."]
    for part in parts:
        data = part * (1_000_000 // len(part))
        began = time.time()
        assert len(M.sniff(data)) <= len(data) // 22
        assert time.time() - began < 2, part


def chains():
    """1 MB each of files whose parts run together without an end, in the formats that have chains of parts."""
    n = 1_000_000
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    head = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", bytes(13))
    yield "gif text", b"GIF89a" + b"abcd" + b"\0\0\0" + b"! " + (b"GIF89aabcd\0\0\0! " * (n // 15))
    yield "gif blocks", (b"GIF89a" + bytes(7)) * (n // 26) + b"!\xf9\1\1\0" * (n // 10)
    yield "gif data", (b"GIF89a" + bytes(7) + b"!\xfe\xf0") * (n // 32) + b"\1x" * (n // 4)
    yield "jpeg segments", (b"\xff\xd8\xff\xe0\0\4") * (n // 6)
    yield "jpeg tail", b"".join(b"\xff\xd8\xff\xe0" + struct.pack(">H", 60_000 - 6 * i) for i in range(10_000)) + b"\xff\xe0\0\2" * (n // 4)
    yield "jpeg data", b"".join(b"\xff\xd8\xff\xda" + struct.pack(">H", 60_000 - 6 * i) for i in range(9_900)) + b"\xff\0" * (n // 2)
    yield "png tail", (head + struct.pack(">I", 4) + b"IDAT") * (n // 82) + chunk(b"tEXt", b"") * (n // 24)
    yield "png long", b"".join(head + struct.pack(">I", n - 41 * i - 53) + b"IDAT" for i in range(n // 82)).ljust(n, b"x") + chunk(b"IEND", b"")
    yield "riff tail", b"".join(b"RIFF" + struct.pack("<I", n - 20 * i) + b"WAVE" + b"abcd" + struct.pack("<I", n // 2 - 20 * i) for i in range(n // 40)) + (b"fmt " + bytes(4)) * (n // 12)


def test_chains_that_run_together_take_linear_time():
    for name, data in chains():
        began = time.time()
        M.sniff(data)
        took = time.time() - began
        began = time.thread_time()
        sum(range(5_000_000))
        assert took < 2 + 20 * (time.thread_time() - began), (name, took)  # a slow machine has more time


def test_crc_of_ranges():
    r = random.Random(3)
    d, memo = r.randbytes(400_000), {}
    for _ in range(50):
        a, b = sorted(r.randrange(len(d)) for _ in range(2))
        assert M._crc(d, a, b, memo) == zlib.crc32(d[a:b])
    assert M._crc(d, 0, len(d), memo) == zlib.crc32(d)


def test_chunks_by_walking():
    """Chains of RIFF chunks against a walk, over bytes full of small lengths."""
    r = random.Random(4)
    for _ in range(300):
        d = b"".join(r.choice([b"fmt ", b"data", b"LIST", b"abcd"]) + struct.pack("<I", r.choice([0, 0, 1, 2, 4, 8, 13, 200])) for _ in range(40))
        chunks = M._Chunks(d)
        for _ in range(20):
            start, end = r.randrange(0, 160, 2), r.randrange(0, len(d) + 1)
            p, seen = start, [0, 0, 0]
            while p + 8 <= min(end, len(d)):
                for i, k in enumerate((b"fmt ", b"data", b"LIST")):
                    seen[i] += d[p : p + 4] == k
                n = int.from_bytes(d[p + 4 : p + 8], "little")
                p += 8 + n + (n & 1)
            if end > start:
                assert chunks.between(start, end) == (tuple(seen) if p == end else None)


def test_gzip_headers_and_ends():
    """Optional header fields, wrong trailers and streams that are cut off."""
    body = gzip.compress(b"hello" * 100)[10:]
    for flags, extra in ((0, b""), (4, b"\3\0abc"), (8, b"name\0"), (16, b"note\0"), (28, b"\1\0xn\0c\0")):
        head = b"\x1f\x8b\x08" + bytes([flags]) + bytes(6) + extra
        assert M.sniff(b"--" + head + body + b"--") == [("application/gzip", 2, 2 + len(head + body))]
        assert M.sniff(head + body[:-1]) == [] and M.sniff(head + body[:-8] + bytes(8)) == []
    head = b"\x1f\x8b\x08\x02" + bytes(6)
    assert len(M.sniff(head + struct.pack("<H", zlib.crc32(head) & 0xFFFF) + body)) == 1 and M.sniff(head + b"zz" + body) == []
    big = gzip.compress(bytes(30_000_000))
    assert M.sniff(b"x" + big) == [("application/gzip", 1, 1 + len(big))]


def test_columns(spark):
    rows = [(1, FILES["image/png"], "image/jpeg"), (2, FILES["image/gif"], "image/gif"), (3, b"text", "text/plain"), (4, None, None), (5, b"x" + FILES["image/png"], "text/plain")]
    got = {r.id: r for r in M.sniff_media(spark.createDataFrame(rows, "id int, m binary, type string"), "id", "m", "type").collect()}
    assert got[1].corrected and got[1].type == "image/png"
    assert not got[2].corrected and got[3].type == "text/plain" and got[3].detected is None and got[4].type is None
    assert got[5].type == "text/plain" and got[5].files[0].start == 1


def test_texts(spark):
    texts = [None, "", "a" * 63, "a" * 64, "a" * 65, "é" * 100, "RIFF....WAVE BM PK\3\4 \x1f", "x" * 300_000, "a" * 63]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "q", 1)], "doc_id bigint, text string, media int")
    got = {r.doc_id: r for r in M.media_features(M.store_texts(df)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        full = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        stored = M.wav(full)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(full), hashlib.sha256(full).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(full[-64:]), len(stored), hashlib.sha256(stored).hexdigest())
        assert r.feature.startswith("audio/wav;corrected=1;")
    assert got[2].feature == got[8].feature and None in got
    assert M.media_features(M.store_texts(df.limit(0))).count() == 0
