"""WARC archives: records written in segments, read back by segment reassembly.

Writing: a payload becomes an HTTP message in chunked transfer framing; what is longer than a segment is continued in
continuation records that name the first record (WARC-Segment-Origin-ID) and their number, the last one with the total
length. Records go through Spark's text writer (packed with gzip), whose line separator is the two line ends behind a WARC record, in files of a bounded
number of bounded records.

Reading: each file is parsed by the records' own lengths; continuation records are grouped by their origin, put in order by
segment number, their total length is verified, and the chunked framing is decoded. A payload's digest is checked.
"""

from __future__ import annotations

import gzip
import uuid
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.common import checkpointed, shared_folder, tidied

#: Bytes of a record's block at most, and records of an archive file at most: a file has 32 MB or less.
SEGMENT = 16_384
RECORDS = 1_900
#: Payloads of fewer bytes are never revisits.
LEAST = 100
CHUNK = 4_096
#: Repeated digests (of some 100 bytes) that are broadcast at most.
FEW = 50_000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def frame(payload: bytes, size: int = CHUNK) -> bytes:
    """Chunked transfer framing of a payload."""
    parts = [b"%x\r\n%s\r\n" % (len(c), c) for c in (payload[i : i + size] for i in range(0, len(payload), size))]
    return b"".join(parts) + b"0\r\n\r\n"


def unframe(data: bytes) -> bytes:
    """The payload of chunked transfer framing; ValueError if lengths don't fit."""
    out, p = [], 0
    while True:
        end = data.find(b"\r\n", p)
        if end < 0:
            raise ValueError("chunk without a size")
        n = int(data[p:end].split(b";")[0], 16)
        p = end + 2
        if n == 0:
            return b"".join(out)
        if data[p + n : p + n + 2] != b"\r\n":
            raise ValueError("chunk of another length")
        out.append(data[p : p + n])
        p += n + 2


def _record(head: dict, block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block


def _urn(key) -> str:
    """A key in a record's name: k and its text in percent encoding, or n for null."""
    return "urn:page:n" if key is None else "urn:page:k" + quote(str(key), safe="")


def _key(urn: str) -> str | None:
    bare = urn.strip("<>").removeprefix("urn:page:").split(":")[0]
    return unquote(bare[1:]) if bare[0] == "k" else None


def _name(key, row: int, digest: str | None) -> str:
    """A record's name: its key and what tells it from other captures of that key: the digest of the response that revisits refer to, else a row number."""
    return f"<{_urn(key)}:{digest or row}>"


def records(page_id, url: str, payload: bytes, digest: str, refers_to=None, revisit: bool = False, row: int = 0, named: bool = False) -> list[bytes]:
    """The records of one capture, each without the line ends behind it. A revisit has no payload.

    A response that is `named` can be referred to: its name is its key and digest, as a revisit, which has the same digest, writes it.
    All other captures are told apart by `row`.
    """
    name = _name(page_id, row, digest if named else None)
    head = {"WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": name, "WARC-Date": DATE, "WARC-Target-URI": url.replace("\r", "%0D").replace("\n", "%0A"), "WARC-Payload-Digest": f"sha256:{digest}", "Content-Type": "application/http;msgtype=response"}
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\nX-Payload-Length: {len(payload)}\r\n\r\n".encode()
    if revisit:
        return [_record(head | {"WARC-Refers-To": _name(refers_to, 0, digest), "WARC-Profile": PROFILE}, http)]
    block = http + frame(payload)
    parts = [block[i : i + SEGMENT] for i in range(0, len(block), SEGMENT)]
    if len(parts) == 1:
        return [_record(head, block)]
    out = [_record(head | {"WARC-Segment-Number": 1}, parts[0])]
    for n, part in enumerate(parts[1:], 2):
        more = {"WARC-Type": "continuation", "WARC-Record-ID": f"{name[:-1]}:{n}>", "WARC-Date": DATE, "WARC-Segment-Origin-ID": name, "WARC-Segment-Number": n}
        out.append(_record(more | ({"WARC-Segment-Total-Length": len(block)} if n == len(parts) else {}), part))
    return out


def captures(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Pages with payload, payload_digest, refers_to, row and named: of equal payloads of LEAST bytes or more, the smallest key is the response.

    Rows of that key are all responses, of which one is `named`; a null key comes after all others. Only digests, keys and row numbers are
    shuffled to find equal payloads. (Row numbers only decide which of several wholly equal responses is the named one, so
    they must come out alike when `pages` is read twice, as they do from a table.)
    """
    raw = F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).alias("page_id"), F.coalesce(F.col(url).cast("string"), F.lit("")).alias("url"), raw.alias("payload"), F.monotonically_increasing_id().alias("row"))
    rows = rows.withColumn("payload_digest", F.sha2("payload", 256))
    first = rows.filter(F.octet_length("payload") >= LEAST).groupBy("payload_digest").agg(F.min(F.struct(F.col("page_id").isNull().alias("null"), "page_id", "row")).alias("f"), F.count("*").alias("n"))
    first = checkpointed(first.filter("n > 1").select("payload_digest", F.col("f.page_id").alias("first"), F.col("f.row").alias("first_row")))
    long = F.octet_length("payload") >= LEAST
    again = long & F.col("first_row").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    named = long & F.coalesce(F.col("row") == F.col("first_row"), F.lit(True)) & ~again
    # payloads are only shuffled where more digests occur again than may be broadcast
    few = F.broadcast(first) if first.count() <= FEW else first
    return rows.join(few, "payload_digest", "left").select("page_id", "url", "payload", "payload_digest", F.when(again, F.col("first")).alias("refers_to"), "row", again.alias("revisit"), named.alias("named"))


def write_warc(caps: DataFrame, path: str) -> None:
    """Writes captures as WARC files below `path`, whole records in each."""

    def run(batches):
        for b in batches:
            out = []
            ids, urls, _, digests, refers, rows, again, named = (None if i == 2 else c.to_pylist() for i, c in enumerate(b.columns))
            for i, u, p, d, r, n, a, f in zip(ids, urls, b.column(2), digests, refers, rows, again, named, strict=True):
                out += records(i, u, p.as_buffer().to_pybytes(), d, r, a, n, f)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    lines = caps.select("page_id", "url", "payload", "payload_digest", "refers_to", "row", "revisit", "named").mapInArrow(tidied(run), "record binary")
    lines.select(F.col("record").cast("string").alias("value")).write.option("compression", "gzip").option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", RECORDS).mode("overwrite").text(path)


def plain(data: bytes) -> bytes:
    """An archive's bytes, unpacked if they are in gzip (of one or more members)."""
    return gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data


def parse_records(data: bytes):
    """(header, block) of each record of an archive."""
    p = 0
    while p < len(data):
        end = data.index(b"\r\n\r\n", p)
        version, *lines = data[p:end].split(b"\r\n")
        if not version.startswith(b"WARC/"):
            raise ValueError(f"no record at {p}")
        head = {k.decode().lower(): v.strip().decode() for k, _, v in (x.partition(b":") for x in lines)}
        n = int(head["content-length"])
        block = data[end + 4 : end + 4 + n]
        if len(block) != n or data[end + 4 + n : end + 8 + n] != b"\r\n\r\n":
            raise ValueError(f"record at {p} has another length")
        yield head, block
        p = end + 8 + n


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per capture of the archives: name, url, record_type, payload_digest, refers_to, payload_bytes, payload.

    Segments are grouped by origin (a capture of one record is its only segment), sorted by number and checked: numbers
    run from 1 without gaps, lengths add up to the total, the payload has its digest; if not, the read fails.
    """
    schema = "origin string, seg int, total bigint, type string, url string, digest string, refers string, block binary"
    names = [x.split()[0] for x in schema.split(", ")]

    def split(batches):
        for b in batches:
            for content in b.column(0):
                rows = []
                for h, block in parse_records(plain(content.as_buffer().to_pybytes())):
                    more = h["warc-type"] == "continuation"
                    total = h.get("warc-segment-total-length") if more or "warc-segment-number" in h else len(block)
                    rows.append((h["warc-segment-origin-id"] if more else h["warc-record-id"], int(h.get("warc-segment-number", 1)), None if total is None else int(total), None if more else h["warc-type"], h.get("warc-target-uri"), h.get("warc-payload-digest"), h.get("warc-refers-to"), block))
                cols = list(zip(*rows, strict=True)) or [()] * 8
                kinds = (pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

    segments = spark.read.format("binaryFile").load(path).select("content").mapInArrow(tidied(split), schema)
    # only the segments of what was split meet in a shuffle; a capture of one record is whole where it is read
    whole = segments.filter("type IS NOT NULL AND total IS NOT NULL").select("origin", F.expr("array(block)").alias("blocks"), F.lit(True).alias("ok"), "type", "url", "digest", "refers")
    cut = segments.filter("type IS NULL OR total IS NULL")
    parts = F.array_sort(F.collect_list(F.struct("seg", "block")))
    one = lambda c: F.max(c).alias(c)  # noqa: E731  only one segment has it
    joined = cut.groupBy("origin").agg(parts.alias("parts"), one("total"), one("type"), one("url"), one("digest"), one("refers"))
    sizes = F.aggregate("parts", F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x["block"]))
    in_order = F.transform("parts", lambda x: x["seg"]) == F.sequence(F.lit(1), F.size("parts"))
    joined = joined.select("origin", F.transform("parts", lambda x: x["block"]).alias("blocks"), F.coalesce(in_order & (sizes == F.col("total")), F.lit(False)).alias("ok"), "type", "url", "digest", "refers")

    out = "name string, url string, record_type string, payload_digest string, refers_to string, payload_bytes bigint, payload binary"

    def decode(batches):
        import hashlib

        for b in batches:
            rows = []
            for origin, blocks, ok, kind, url, digest, refers in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if not ok:
                    raise ValueError(f"{origin}: segments are missing or of another total length")
                head, _, body = b"".join(blocks).partition(b"\r\n\r\n")
                fields = {k.lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
                n = int(fields[b"x-payload-length"])
                payload = None
                if kind == "response":
                    payload = unframe(body) if fields.get(b"transfer-encoding") == b"chunked" else body
                    if f"sha256:{hashlib.sha256(payload).hexdigest()}" != digest or len(payload) != n:
                        raise ValueError(f"{origin}: the payload isn't what its digest says")
                rows.append((_key(origin), url, kind, digest.removeprefix("sha256:"), _key(refers) if refers else None, n, payload))
            cols = list(zip(*rows, strict=True)) or [()] * 7
            kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], [x.split()[0] for x in out.split(", ")])

    return whole.unionByName(joined).mapInArrow(tidied(decode), out)


def archive_folder(spark: SparkSession) -> str:
    """A new folder below the one that all executors share."""
    return f"{shared_folder(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"


def round_trip(pages: DataFrame, path: str, key: str = "page_id") -> DataFrame:
    """Writes pages as WARC files to `path`, reads them back and gives page_id, payload_bytes, payload_digest, record_type, refers_to.

    A null html is an empty payload, a null url an empty one. Null and repeated keys and repeated rows are captures of their own. An empty
    table gives no rows. Other columns are not read. Lengths and digests are
    of the full payload; a revisit's are those that its record states, which are its response's.
    """
    kind = pages.schema[key].dataType
    write_warc(captures(pages, key), path)
    rows = read_warc(pages.sparkSession, path)
    return rows.select(F.col("name").cast(kind).alias(key), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
