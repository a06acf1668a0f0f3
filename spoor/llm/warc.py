"""WARC archives as a table of chunks.

Writing: a payload of any length becomes rows of bounded size, one WARC record each. A payload
beyond ``SEGMENT`` bytes is written as the segments that the format has for it: a first record
and ``continuation`` records with the identifier of the first and their own number. Text files
whose lines end with the blank line that ends a record are then valid archives, on any file
system that Spark writes.

Reading: Spark cuts the files at blank lines; a parser takes the pieces of a file as they come,
follows ``Content-Length`` and gives rows ``(record_id, chunk_no, data)`` with the bytes and the
SHA-1 so far. It holds one piece and one chunk, never a whole payload.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spoor.llm.common import shared_folder, stored
from spoor.scale import small_side

SEGMENT = 1 << 20  # bytes of a record's block
CHUNK = 1 << 18  # bytes of a chunk row
REVISIT_FROM = 1000  # bytes from which equal payloads are written once
BLANK = b"\r\n\r\n"
DATE = "1970-01-01T00:00:00Z"  # pages carry no time
# fixed values of the format
VERSION = "WARC/1.1"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = pa.schema(
    [
        ("record_id", pa.string()), ("type", pa.string()), ("page_id", pa.string()), ("uri", pa.string()),
        ("refers_to", pa.string()), ("stated_digest", pa.string()), ("chunk_no", pa.int64()), ("data", pa.binary()),
        ("bytes", pa.int64()), ("digest", pa.string()), ("last", pa.bool_()), ("complete", pa.bool_()),
    ]
)
SPARK_SCHEMA = (
    "record_id string, type string, page_id string, uri string, refers_to string, stated_digest string,"
    " chunk_no bigint, data binary, bytes bigint, digest string, last boolean, complete boolean"
)


def record_id(page_id: Column, sha1: Column) -> Column:
    """A name that follows from page and payload, so a task that runs again writes the same."""
    name = F.md5(F.concat_ws("|", F.coalesce(page_id.cast("string"), F.lit("")), sha1).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(name, "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5"), F.lit(">"))


def decided(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, uri, payload, sha1, keeper)``: the page that a page's record refers to, if any.

    Of equal payloads of at least ``REVISIT_FROM`` bytes the largest id is written; rows that
    share it are all written. Payloads meet by SHA-256, on counted groups only.
    """
    rows = pages.select(
        F.col(id_col).alias("page_id"),
        F.col(url_col).cast("string").alias("uri"),
        F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("key", F.sha2("payload", 256))
    groups = (
        rows.where(F.octet_length("payload") >= REVISIT_FROM)
        .groupBy("key")
        .agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n"))
        .where((F.col("n") > 1) & F.col("keeper").isNotNull())
        .select("key", "keeper")
    )
    return rows.join(small_side(groups), "key", "left").select(
        "page_id", "uri", "payload", F.sha1("payload").alias("sha1"),
        F.when(~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper")).alias("keeper"),
    )


def segments(rows: DataFrame, size: int = SEGMENT, date: str = DATE) -> DataFrame:
    """One row ``value`` per WARC record of ``decided()``: its head, a blank line and its block."""
    revisit = F.col("keeper").isNotNull()
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length("payload").cast("string"), F.lit("\r\n\r\n"),
    ).cast("binary")
    named = rows.select(
        record_id(F.col("page_id"), F.col("sha1")).alias("id"),
        F.when(revisit, "revisit").otherwise("response").alias("type"),
        F.when(revisit, record_id(F.col("keeper"), F.col("sha1"))).alias("refers_to"),
        F.col("page_id").cast("string").alias("page"),
        # a line break inside an address would end its line
        F.replace(F.replace("uri", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")).alias("uri"),
        "sha1",
        F.when(revisit, http).otherwise(F.concat(http, F.col("payload"))).alias("block"),
    )
    count = F.greatest(F.lit(1), F.ceil(F.octet_length("block") / size)).cast("int")
    cut = named.withColumn("n", count).select(
        "id", "type", "refers_to", "page", "uri", "sha1", "n", F.octet_length("block").alias("total"),
        F.posexplode(F.expr(f"transform(sequence(0, n - 1), k -> substring(block, k * {size} + 1, {size}))")).alias("k", "part"),
    )
    first, many, number = F.col("k") == 0, F.col("n") > 1, (F.col("k") + 1).cast("string")
    segment_id = record_id(F.concat_ws("/", F.col("page"), F.lit("segment"), number), F.col("sha1"))
    head = F.concat_ws(
        "\r\n",
        F.lit(VERSION),
        line("WARC-Type", F.when(first, F.col("type")).otherwise("continuation")),
        line("WARC-Record-ID", F.when(first, F.col("id")).otherwise(segment_id)),
        F.lit(f"WARC-Date: {date}"),
        line("WARC-Target-URI", F.col("uri")),
        line("X-Page-ID", F.col("page")),
        F.when(first, line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1")))),
        F.when(first & (F.col("type") == "revisit"), F.lit(f"WARC-Profile: {SAME_PAYLOAD}")),
        F.when(first, line("WARC-Refers-To", F.col("refers_to"))),
        F.when(many, line("WARC-Segment-Number", number)),
        F.when(~first, line("WARC-Segment-Origin-ID", F.col("id"))),
        F.when(many & (F.col("k") == F.col("n") - 1), line("WARC-Segment-Total-Length", F.col("total").cast("string"))),
        F.when(first, F.lit("Content-Type: application/http;msgtype=response")),
        line("Content-Length", F.octet_length("part").cast("string")),
    )
    return cut.select(F.concat(head.cast("binary"), F.lit(BLANK), F.col("part")).cast("string").alias("value"))


def write(
    pages: DataFrame, path: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    size: int = SEGMENT,
) -> str:
    """Archives of ``pages`` under ``path`` (default: the shared folder); gives the path.

    Each partition writes one gzip file; a file is read by one task, so it is the unit of
    reading. Defined results: null html is an empty payload; rows with a null id or address
    lack that line; repeated rows are records with the same identifier; an empty table writes
    archives without records; other columns are ignored. An id may not hold a line break.
    """
    path = path or f"{shared_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    rows = segments(decided(pages, id_col, url_col, html_col), size)
    rows.write.option("lineSep", BLANK.decode()).option("compression", "gzip").text(path)
    return path


class Payload:
    """What is known of the payload of a record so far, over all its segments."""

    def __init__(self, head: dict[str, str], record: str, whole: bool):
        self.fields = {
            "record_id": record, "type": head.get("warc-type"), "page_id": head.get("x-page-id"),
            "uri": head.get("warc-target-uri"), "refers_to": head.get("warc-refers-to"),
            "stated_digest": head.get("warc-payload-digest", "").removeprefix("sha1:") or None,
        }
        self.sha1, self.bytes, self.chunk_no, self.held, self.whole = hashlib.sha1(), 0, 0, bytearray(), whole
        # the payload of an HTTP message begins after its head
        self.http = bytearray() if head.get("content-type", "").startswith("application/http") else None

    def add(self, data: bytes, chunk: int) -> Iterator[dict]:
        if self.http is not None:
            self.http += data
            at = self.http.find(BLANK)
            if at < 0:
                return
            data, self.http = bytes(self.http[at + 4 :]), None
        self.held += data
        while len(self.held) > chunk:  # the last chunk stays until the record ends
            yield self.row(bytes(self.held[:chunk]))
            del self.held[:chunk]

    def row(self, data: bytes, last: bool = False, complete: bool = False) -> dict:
        self.sha1.update(data)
        self.bytes += len(data)
        self.chunk_no += 1
        return self.fields | {
            "chunk_no": self.chunk_no - 1, "data": data, "bytes": self.bytes, "digest": self.sha1.hexdigest(),
            "last": last, "complete": complete,
        }

    def end(self, complete: bool) -> dict:
        return self.row(bytes(self.held), True, complete and self.whole)


class Parser:
    """Chunk rows from the bytes of one archive, fed in pieces."""

    def __init__(self, chunk: int):
        self.chunk, self.held, self.left, self.skip = chunk, b"", None, 0
        self.open: Payload | None = None
        self.ends = True  # the record at hand is the last of its payload

    def feed(self, data: bytes) -> Iterator[dict]:
        self.held += data
        while self.held:
            if self.left is None:
                n = min(self.skip, len(self.held))
                self.held, self.skip = self.held[n:], self.skip - n
                at = self.held.find(BLANK)
                if self.skip or at < 0:
                    return
                head, self.held = self.held[:at], self.held[at + 4 :]
                yield from self.begin(head)
            n = min(self.left, len(self.held))
            part, self.held, self.left = self.held[:n], self.held[n:], self.left - n
            yield from self.open.add(part, self.chunk)
            if self.left:
                return
            self.left, self.skip = None, 4
            if self.ends:
                yield self.open.end(True)
                self.open = None

    def begin(self, head: bytes) -> Iterator[dict]:
        lines = head.decode("utf-8", "replace").lstrip("\r\n").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:80]!r}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        self.left = int(fields["content-length"])
        origin = fields.get("warc-segment-origin-id")
        number = int(fields.get("warc-segment-number", "1"))
        if self.open and (origin is None or self.open.fields["record_id"] != origin):
            yield self.open.end(False)  # its last segment is not in this file
            self.open = None
        if self.open is None:
            # a continuation without the segment before it has no digest of the whole payload
            self.open = Payload(fields, origin or fields.get("warc-record-id"), number == 1)
        self.ends = "warc-segment-number" not in fields or "warc-segment-total-length" in fields

    def finish(self) -> Iterator[dict]:
        if self.left is None and self.held.lstrip(b"\r\n"):
            yield from self.feed(BLANK)  # a head at the very end
        if self.open:
            yield self.open.end(self.left == 0 and self.ends)


def read(spark: SparkSession, path: str, chunk: int = CHUNK, data: bool = True) -> DataFrame:
    """Chunk rows of the archives under ``path``.

    ``record_id, type, page_id, uri, refers_to, stated_digest`` tell the record; ``chunk_no``
    counts from 0 over all segments; ``bytes`` and ``digest`` (lower-case hex SHA-1) cover the
    payload up to the end of the chunk, so those of the ``last`` chunk cover all of it. An empty
    payload has one empty chunk. ``complete`` is false on the last chunk of a record that is cut
    off or lacks a segment. With ``data=False`` the bytes are read but not returned. Archives
    must be compressed as whole files (or fit one split): a file is read by one task.
    """
    pieces = spark.read.option("lineSep", BLANK.decode()).text(path).select(
        F.col("value").cast("binary").alias("value"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
    )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        parser, file = None, None
        for batch in batches:
            for value, name, start in zip(*(batch.column(k) for k in ("value", "file", "start"))):
                if start.as_py():
                    raise ValueError(f"{name} spans several splits: compress it")
                if name.as_py() != file:
                    if parser:
                        yield from parser.finish()
                    parser, file = Parser(chunk), name.as_py()
                    yield from parser.feed(value.as_py())
                else:  # Spark cut the file at a blank line
                    yield from parser.feed(BLANK + value.as_py())
        if parser:
            yield from parser.finish()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for row in rows(batches):
            if data:
                size += len(row["data"])
            else:
                row["data"] = None
            held.append(row)
            if size >= 32 * CHUNK or len(held) >= 5000:
                yield pa.RecordBatch.from_pylist(held, SCHEMA)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, SCHEMA)

    return pieces.mapInArrow(run, SPARK_SCHEMA)


def payloads(chunks: DataFrame) -> DataFrame:
    """``(record_id, type, page_id, uri, refers_to, payload_bytes, payload_digest)`` per record.

    A revisit takes size and digest from the record to which it refers, ``refers_to`` is the page
    of that record. If it is not there, size and ``refers_to`` are null and the digest is the
    stated one.
    """
    last = stored(chunks.where("last").drop("data", "chunk_no", "last", "complete"))
    own = last.where(F.col("type") != "revisit")
    targets = own.groupBy(F.col("record_id").alias("refers_to")).agg(
        F.max("page_id").alias("page"), F.max("bytes").alias("n"), F.max("digest").alias("sha1")
    )
    revisits = last.where(F.col("type") == "revisit").join(targets, "refers_to", "left")
    names = ["record_id", "type", "page_id", "uri"]
    return own.select(
        *names, F.lit(None).cast("string").alias("refers_to"), F.col("bytes").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
    ).unionByName(
        revisits.select(
            *names, F.col("page").alias("refers_to"), F.col("n").alias("payload_bytes"),
            F.coalesce("sha1", "stated_digest").alias("payload_digest"),
        )
    )


ORACLE = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, ''))::BIGINT AS payload_bytes FROM pages),
k AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS keeper FROM p),
r AS (SELECT *, payload_bytes >= 1000 AND keeper IS NOT NULL AND page_id IS DISTINCT FROM keeper AS again FROM k)
SELECT page_id, payload_bytes, sha1(h) AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN again THEN keeper END AS refers_to
FROM r
"""
