"""WARC archives: written with one gzip member for each record, and read back by a sequential reader.

Pages with equal payloads are stored once: the one with the largest id is a response,
the others are revisits that refer to it.  Each task writes files of its own through
Spark's writer, so a failed attempt leaves nothing behind and any store will do.

The reader takes one gzip member at a time, decompresses it in steps of bounded size,
frames the block by Content-Length and digests block and payload as they come by, so a
record never has to stand in memory unless its payload is asked for.  Archives of our own
are read in splits, since all their members start with the same ten bytes and hold them
nowhere else; those of others are read one file at a time.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import body, checkpoint_dir, discard, on_disk, quoted, resting_on, written

#: Fixed values of the formats: the start of a gzip member without a time or a name; the same, as an empty member.
HEADER = bytes.fromhex("1f8b08000000000000ff")
EMPTY = HEADER + bytes.fromhex("03000000000000000000")
VERSION, GZIP_MAGIC = b"WARC/1.1", b"\x1f\x8b\x08"
IDENTICAL = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
#: Bytes of archive that make up one row of the writer, and bytes that the reader decompresses at a time.
CHUNK, STEP = 4 << 20, 1 << 16
#: Longest header of a record or of HTTP that the reader accepts.
LONGEST_HEADER = 1 << 20
#: Payloads with copies, or originals of revisits, that may be broadcast: about 100 bytes each.
BROADCAST_GROUPS = 500_000
COLUMNS = "record_type string, record_id string, refers_to string, target_uri string, payload_bytes long, payload_digest string, verified boolean"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def member(record: bytes) -> bytes:
    """A gzip member that holds HEADER only at its start."""
    for level in (6, 1, 0):  # a chance of one in 2**80; stored text has no such bytes
        squeeze = zlib.compressobj(level, zlib.DEFLATED, -15)
        out = HEADER + squeeze.compress(record) + squeeze.flush() + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)
        if HEADER not in out[1:]:
            return out
    raise ValueError("a record holds the start of a gzip member")


def record(page_id: object, url: str | None, payload: bytes, original: object, date: str) -> bytes:
    """A response, or a revisit of the page `original` if that is given; in both the digest is that of the full payload."""
    sha = base32_sha1(payload)
    name = lambda i: f"<urn:page:{'' if i is None else i}:{sha}>".encode()
    block = HTTP + b"Content-Length: %d\r\n\r\n" % len(payload) + (payload if original is None else b"")
    fields = [(b"WARC-Type", b"response" if original is None else b"revisit"), (b"WARC-Record-ID", name(page_id)), (b"WARC-Date", date.encode())]
    if url is not None:  # what would end a line or a field is escaped as in a URI
        fields.append((b"WARC-Target-URI", re.sub(rb"[\x00-\x20\x7f]", lambda m: b"%%%02X" % m[0][0], url.encode())))
    if original is not None:
        fields += [(b"WARC-Refers-To", name(original)), (b"WARC-Profile", IDENTICAL)]
    fields += [
        (b"WARC-Payload-Digest", b"sha1:" + sha.encode()), (b"WARC-Block-Digest", b"sha1:" + base32_sha1(block).encode()),
        (b"Content-Type", b"application/http;msgtype=response"), (b"Content-Length", b"%d" % len(block)),
    ]
    return VERSION + b"\r\n" + b"".join(k + b": " + v + b"\r\n" for k, v in fields) + b"\r\n" + block + b"\r\n\r\n"


def with_originals(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", least: int = 0) -> DataFrame:
    """(id, url, html, original): the id of the response that a page with an equal payload revisits, or null.

    Payloads of fewer than `least` bytes are all responses.  The largest id of equal
    payloads is the response; rows that repeat it are responses too, as are all rows
    whose payload only rows without an id have.
    """
    rows = pages.select(quoted(id_col).alias("id"), quoted("url").cast("string").alias("url"), body(html_col).alias("html"))
    key = F.sha2("html", 256)
    long = F.octet_length("html") >= least
    groups = written(rows.where(long).groupBy(key.alias("sha")).agg(F.max("id").alias("original"), F.count("*").alias("rows")).where("rows > 1").select("sha", "original"))
    few = groups.count() <= BROADCAST_GROUPS
    told = rows.withColumn("sha", F.when(long, key)).join(F.broadcast(groups) if few else groups, "sha", "left")
    out = told.select("id", "url", "html", F.when(~F.col("id").eqNullSafe(F.col("original")), F.col("original")).alias("original"))
    return resting_on(out, groups)


def write_archives(rows: DataFrame, path: str, date: str = "2000-01-01T00:00:00Z") -> None:
    """Writes a record for each row of (id, url, html, original) to a folder of archives.

    A file is a sequence of gzip members, one a record, with an empty member after every
    few megabytes and at its end.
    """

    def archived(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for page_id, url, html, original in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(member(record(page_id, url, html.encode(), original, date)))
                size += len(held[-1])
                if size >= CHUNK:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)])], names=["value"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)])], names=["value"])

    chunks = rows.select("id", "url", "html", "original").mapInArrow(archived, "value binary")
    chunks.select(F.col("value").cast("string")).write.option("lineSep", EMPTY.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)


@dataclass
class Frame:
    """One record, taken in piece by piece."""

    keep: bool
    head: bytes = b""
    fields: dict[str, str] | None = None
    left: int = 0
    http: bytes | None = None
    size: int = 0
    tail: bytes = b""
    payload: list[bytes] = field(default_factory=list)

    def __post_init__(self):
        self.block_sha, self.payload_sha = hashlib.sha1(), hashlib.sha1()

    def feed(self, piece: bytes) -> None:
        if self.fields is None:
            self.head += piece
            if (end := self.head.find(b"\r\n\r\n")) < 0:
                if len(self.head) > LONGEST_HEADER:
                    raise ValueError("no end of the header")
                return
            piece = self.head[end + 4 :]
            version, *lines = self.head[:end].decode("utf-8", "replace").split("\r\n")
            if not version.startswith("WARC/"):
                raise ValueError("no WARC record")
            self.fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
            self.left = int(self.fields["content-length"])
            if self.left < 0:
                raise ValueError("negative length")
            self.http = b"" if self.fields.get("content-type", "").startswith("application/http") else None
        part, rest = piece[: self.left], piece[self.left :]
        self.left -= len(part)
        self.tail += rest
        if len(self.tail) > 4:
            raise ValueError("more than one record in a member")
        self.block_sha.update(part)
        if self.http is not None:
            self.http += part
            if (end := self.http.find(b"\r\n\r\n")) < 0:
                if len(self.http) > LONGEST_HEADER:
                    raise ValueError("no end of the HTTP header")
                return
            part, self.http = self.http[end + 4 :], None
        self.payload_sha.update(part)
        self.size += len(part)
        if self.keep:
            self.payload.append(part)

    def close(self) -> tuple | None:
        """A row of COLUMNS, with the payload at last if it is kept; None for an empty member."""
        if self.fields is None and not self.head:
            return None
        if self.fields is None or self.left or self.tail != b"\r\n\r\n":
            raise ValueError("the block does not end where its length says")
        f = self.fields
        stored = f.get("warc-type") != "revisit"
        digests = {k: base64.b32encode(h.digest()).decode() for k, h in (("block", self.block_sha), ("payload", self.payload_sha))}
        told = {k: f.get(f"warc-{k}-digest", "").removeprefix("sha1:") for k in digests}
        right = all(not told[k] or told[k] == digests[k] for k in (("block", "payload") if stored else ("block",)))
        row = (f.get("warc-type"), f.get("warc-record-id"), f.get("warc-refers-to"), f.get("warc-target-uri"), self.size if stored else None, digests["payload"] if stored else told["payload"], right)
        return (*row, b"".join(self.payload) if stored else None) if self.keep else row


def read_members(data: bytes, keep: bool = False) -> Iterator[tuple]:
    """The records of consecutive gzip members, in order.

    A member that can't be decompressed or framed gives a row of nulls with `verified`
    false, and reading goes on at the next place that looks like the start of a member.
    """
    at, view = 0, memoryview(data)
    while at < len(data):
        unzip, frame, pos = zlib.decompressobj(31), Frame(keep), at
        try:
            while not unzip.eof:
                if pos >= len(data):
                    raise ValueError("cut short")
                piece = unzip.decompress(view[pos : pos + STEP], STEP)
                pos += min(STEP, len(data) - pos)
                frame.feed(piece)
                while unzip.unconsumed_tail and not unzip.eof:
                    frame.feed(unzip.decompress(unzip.unconsumed_tail, STEP))
            at = pos - len(unzip.unused_data)
            found = frame.close()
        except (zlib.error, ValueError, KeyError):
            at = data.find(GZIP_MAGIC, at + 1)
            at = len(data) if at < 0 else at
            found = (*[None] * 6, False, *([None] if keep else []))
        if found:
            yield found


def _records(raw: DataFrame, start: bytes, keep: bool) -> DataFrame:
    """The records of a column of bytes, each row to be read after `start`."""
    names = [x.split()[0] for x in COLUMNS.split(", ")] + ["payload"] * keep
    kinds = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.bool_()] + [pa.binary()] * keep

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0

        def given() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for value in batch.column(0):
                if raw := value.as_py():
                    for row in read_members(start + raw, keep):
                        rows.append(row)
                        size += 200 + (row[4] or 0) * keep
                        if size >= CHUNK:
                            yield given()
                            rows, size = [], 0
        if rows:
            yield given()

    return raw.mapInArrow(read, COLUMNS + ", payload binary" * keep)


def read_archives(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """A row of COLUMNS for each record of archives of write_archives(), in splits of any size; with the payload if asked for.

    `verified` tells whether the lengths and both digests hold.  A revisit has the digest
    of the payload it refers to, and no length.
    """
    raw = spark.read.option("lineSep", HEADER.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)
    return _records(raw.select(F.col("value").cast("binary")), HEADER, payload)


def read_foreign(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """The same for archives of other writers (*.warc.gz): each file is read by one task, whole files of at most 2 GB."""
    return _records(spark.read.format("binaryFile").load(path).select("content"), b"", payload)


def resolved(records: DataFrame) -> DataFrame:
    """A written table of records with the length of the payload that a revisit refers to; such a row is verified only if that has its digest."""
    key = ["record_id", "payload_digest"]
    named = records.where("record_type = 'revisit'").groupBy(F.col("refers_to").alias("record_id"), "payload_digest").agg(F.count("*").alias("rows"))
    originals = written(records.where("record_type = 'response'").groupBy(*key).agg(F.max("payload_bytes").alias("n"), F.min("verified").alias("sound")).join(named, key, "left_semi"))
    few = originals.count() <= BROADCAST_GROUPS
    found = originals.select(F.col("record_id").alias("refers_to"), "payload_digest", "n", "sound")
    told = records.join(F.broadcast(found) if few else found, ["refers_to", "payload_digest"], "left")
    sound = F.when(F.col("record_type") == "revisit", F.col("verified") & F.coalesce("sound", F.lit(False))).otherwise(F.col("verified"))
    out = told.withColumns({"payload_bytes": F.coalesce("payload_bytes", "n"), "verified": sound}).select(*records.columns)
    return resting_on(out, originals, records)


def through_archives(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", least: int = 0) -> DataFrame:
    """What the archives of pages tell: a row of COLUMNS for each row of pages, revisits resolved.

    Null html is the empty payload, a null url is left out and a null id stands as an empty
    one.  Repeated rows are records of their own; other columns are ignored, an empty table
    gives no record.
    """
    spark = pages.sparkSession
    path = f"{checkpoint_dir(spark)}/warc/{uuid.uuid4().hex}"
    rows = with_originals(pages, id_col, html_col, least)
    write_archives(rows, path)
    records = written(read_archives(spark, path))
    discard(rows, on_disk(records.limit(0), path))
    return resolved(records)


def op12_warc(spark, sf_dir):
    found = through_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    number = lambda c: F.regexp_extract(c, "^<urn:page:(-?[0-9]*):", 1).try_cast("bigint")
    return found.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"), "verified")


OP12_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
g AS (SELECT body, max(page_id) AS keep FROM p GROUP BY body),
d AS (SELECT p.page_id, g.keep, strlen(p.body) AS n, sha1(p.body) AS hex FROM p JOIN g USING (body))
SELECT page_id, n AS payload_bytes,
  list_reduce(list_transform(range(8), lambda i: list_reduce(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, (5 * i + 1)::int, 5))::int >> s) & 31), 1)), lambda a, b: a || b)), lambda a, b: a || b) AS payload_digest,
  CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> keep THEN keep END AS refers_to, true AS verified
FROM d
"""
