"""WARC archives: writing and salvage reading (operator 10).

Writing: one record per page. Of pages with equal payloads (at least ``MIN_REVISIT_BYTES`` long) the one with the smallest
page_id becomes a ``response``, the others ``revisit`` records that name it. Spark's text writer makes the archives: a
record is one value, the line separator is the record's closing blank lines. Large payloads go to archives of their own
with few records, so no archive is much larger than ``ARCHIVE_BYTES`` (a single larger record aside). Payloads are
shuffled only if the table of repeated payloads is too large to broadcast, and then salted.

Reading: a record counts only if its version line, headers, length, closing blank lines and block digest hold. After a
failed check the reader goes on at the next version line at the start of a line or the next gzip member, whichever comes
first and holds, and logs the skipped bytes as a gap. What a gzip member inflates to is read in the same way, also the part
before the place where it is cut or damaged: one bad record costs no other record of its member. op10 refuses to go on if
one of its own archives shows a gap.

Null html is an empty payload; null urls leave out the target header. A null page_id is written and read back as null and
comes after every other id; pages with equal payload and equal smallest id are all responses. Line ends in urls are
percent-encoded. An empty table gives no archive and an empty result. Extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topicweave.llm.common import query, table
from topicweave.operators.bounded import counted_join
from topicweave.session import scratch_path, staged

CRLF = "\r\n"
END = b"\r\n\r\n"
MIN_REVISIT_BYTES = 0
ARCHIVE_BYTES = 32 << 20
#: payload sizes up to which a class of archives reaches, and records in each of its files
SIZE_CLASSES = [(64 << 10, 512), (1 << 20, 32), (1 << 62, 2)]
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_SCHEMA = (
    "kind string, archive string, start bigint, end bigint, reason string, page_id string, record_type string, "
    "url string, payload_bytes bigint, payload_digest string, refers_to string, payload binary"
)


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a binary column: 40 hex digits are eight groups of 20 bits, four digits each."""
    digest = F.sha1(data)
    part = lambda i: F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0")
    return F.translate(F.concat(*[part(i) for i in range(8)]), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def with_record_types(pages: DataFrame) -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest, record_type and refers_to of every page."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html")).withColumn("payload_bytes", F.octet_length("html").cast("bigint"))
    rows = rows.withColumn("payload_digest", base32_sha1(F.col("html").cast("binary")))
    keys = pages.select("page_id", html.alias("html")).where(F.octet_length("html") >= MIN_REVISIT_BYTES)
    groups = keys.select("page_id", base32_sha1(F.col("html").cast("binary")).alias("payload_digest")).groupBy("payload_digest")
    first = groups.agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    joined = counted_join(rows, first, ["payload_digest"], "left", F.struct("page_id", "url"))
    again = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return joined.select(
        "page_id", "url", "html", "payload_bytes", "payload_digest",
        F.when(again, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"),
        F.when(again, F.col("first_id")).alias("refers_to"),
    )


def _record(kind: Column) -> Column:
    """The text of a record up to its closing blank lines."""
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))).otherwise(F.lit(""))
    uri = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    http = F.concat(
        F.lit(CRLF.join(["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", "Content-Length: "])),
        F.col("payload_bytes").cast("string"), F.lit(CRLF * 2),
    )
    is_revisit = kind == "revisit"
    block = F.when(is_revisit, http).otherwise(F.concat(http, F.col("html")))
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    head = F.concat(
        F.lit("WARC/1.1" + CRLF), line("WARC-Type", kind), line("WARC-Record-ID", uri(F.col("page_id"))), line("WARC-Target-URI", url),
        line("WARC-Date", F.lit(DATE)), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        line("WARC-Block-Digest", F.concat(F.lit("sha1:"), base32_sha1(block.cast("binary")))),
        line("WARC-Refers-To", F.when(is_revisit, uri(F.col("refers_to")))), line("WARC-Profile", F.when(is_revisit, F.lit(PROFILE))),
        line("Content-Type", F.lit("application/http; msgtype=response")), line("Content-Length", F.octet_length(block).cast("string")),
    )
    return F.concat(head, F.lit(CRLF), block)


def write_archives(pages: DataFrame, path: str) -> None:
    """Write the pages to WARC files below ``path``."""
    rows = with_record_types(pages)
    low = -1
    for high, per_file in SIZE_CLASSES:
        part = rows.where((F.col("payload_bytes") > low) & (F.col("payload_bytes") <= high))
        out = part.select(_record(F.col("record_type")).alias("value")).write.mode("append")
        out.option("lineSep", END.decode()).option("maxRecordsPerFile", per_file).text(path)
        low = high


class BadRecord(Exception):
    pass


MAGIC = b"\x1f\x8b\x08"
VERSION = re.compile(rb"(?:^|(?<=\n))WARC/1\.[01]\r\n")


def _digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def parse_record(data: bytes, at: int) -> tuple[int, dict]:
    """The record at byte ``at`` and the place behind its closing blank lines; BadRecord if a check fails."""
    if not data.startswith((b"WARC/1.0\r\n", b"WARC/1.1\r\n"), at):
        raise BadRecord("no version line")
    head_end = data.find(END, at)
    if head_end < 0:
        raise BadRecord("headers do not end")
    headers = {}
    for line in data[at:head_end].split(b"\r\n")[1:]:
        name, sep, value = line.partition(b":")
        if not sep:
            raise BadRecord("malformed header")
        headers[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    size = headers.get("content-length", "")
    if not (size.isascii() and size.isdigit()):
        raise BadRecord("no length")
    begin, end = head_end + 4, head_end + 4 + int(size)
    if data[end : end + 4] != END:
        raise BadRecord("length does not fit")
    block = data[begin:end]
    stated = headers.get("warc-block-digest", "")
    if stated.startswith("sha1:") and stated[5:] != _digest(block):
        raise BadRecord("block digest differs")
    return end + 4, {"headers": headers, "block": block}


def _inflated(data: bytes, at: int) -> tuple[int, bytes, str]:
    """Place behind the gzip member at ``at``, what it inflates to, and what is wrong with it. Of a member that is cut or
    damaged, what comes before the bad place is there."""
    inflate, parts, fed, view = zlib.decompressobj(31), [], at, memoryview(data)
    while not inflate.eof:  # fed in steps, so that what follows the member is not copied
        if fed >= len(data):
            return fed, b"".join(parts), "member is cut short"
        before, step = inflate.copy(), view[fed : fed + 65536]
        try:
            parts.append(inflate.decompress(step))
        except zlib.error:
            try:  # again in small steps, up to the bad place
                for k in range(0, len(step), 64):
                    parts.append(before.decompress(step[k : k + 64]))
            except zlib.error:
                pass
            return fed, b"".join(parts), "member does not inflate"
        fed += len(step)
    return fed - len(inflate.unused_data), b"".join(parts), ""


def _plain(data: bytes) -> Iterator[tuple[str, int, int, object]]:
    """Records and gaps of uncompressed bytes: after a failed check, on from the next version line."""
    at, gap, reason = 0, None, ""
    while at < len(data):
        try:
            end, record = parse_record(data, at)
        except BadRecord as e:
            if gap is None:
                gap, reason = at, str(e)
            later = VERSION.search(data, at + 1)
            if later is None:
                break
            at = later.start()
            continue
        if gap is not None:
            yield "gap", gap, at, reason
            gap = None
        yield "record", at, end, record
        at = end
    if gap is not None:
        yield "gap", gap, len(data), reason


def _next_start(data: bytes, at: int) -> int:
    """The next version line or gzip member from ``at`` on, whichever comes first; the end if there is none."""
    later = VERSION.search(data, at)
    member = data.find(MAGIC, at, later.start() if later else len(data))
    return member if member >= 0 else later.start() if later else len(data)


def salvage(data: bytes) -> Iterator[tuple[str, int, int, object]]:
    """('record', start, end, record) and ('gap', start, end, reason) over a whole archive, in order and without holes.

    Records of one gzip member have the place of the member; so has the gap of a member some of whose records failed.
    """
    at, gap, reason = 0, None, ""
    while at < len(data):
        if data.startswith(MAGIC, at):
            end, plain, fault = _inflated(data, at)
            inner = [*_plain(plain)]
            records = [x[3] for x in inner if x[0] == "record"]
            if fault:
                end = _next_start(data, at + 1)
            fault = fault or next((x[3] for x in inner if x[0] == "gap"), "")
        else:
            try:
                end, record = parse_record(data, at)
                records, fault = [record], ""
            except BadRecord as e:
                end, records, fault = _next_start(data, at + 1), [], str(e)
        if gap is not None and (records or not fault):
            yield "gap", gap, at, reason
            gap = None
        for record in records:
            yield "record", at, end, record
        if records and fault:
            yield "gap", at, end, fault
        elif fault and gap is None:
            gap, reason = at, fault
        at = end
    if gap is not None:
        yield "gap", gap, len(data), reason


def _page(uri: str | None) -> str | None:
    if not uri:
        return None
    inner = uri.strip("<>")
    inner = inner.removeprefix("urn:page:")
    return None if inner == "null" else inner


def _row(record: dict) -> tuple:
    headers, block = record["headers"], record["block"]
    kind = headers.get("warc-type")
    head, sep, body = block.partition(END)
    http = "application/http" in headers.get("content-type", "") and sep
    payload = body if http else block
    size = len(payload)
    if kind == "revisit":
        stated = re.search(rb"(?i)^content-length:\s*(\d+)", head, re.M)
        size = int(stated[1]) if stated else None
    digest = headers.get("warc-payload-digest", "").removeprefix("sha1:") or (_digest(payload) if kind != "revisit" else None)
    return (
        _page(headers.get("warc-record-id")), kind, headers.get("warc-target-uri"), size, digest,
        _page(headers.get("warc-refers-to")), payload if kind != "revisit" else None,
    )


def _read_batches(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([
            ("kind", pa.string()), ("archive", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("reason", pa.string()),
            ("page_id", pa.string()), ("record_type", pa.string()), ("url", pa.string()), ("payload_bytes", pa.int64()),
            ("payload_digest", pa.string()), ("refers_to", pa.string()), ("payload", pa.binary()),
        ])
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = []
                for kind, start, end, what in salvage(content.as_py()):
                    fields = (None, *_row(what)) if kind == "record" else (what, *[None] * 7)
                    rows.append((kind, path, start, end, *(fields if with_payload else (*fields[:-1], None))))
                    if len(rows) == 256:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)

    return run


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """Rows of kind ``record`` (with what the headers and the block say) and of kind ``gap`` (the quarantine log)."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_read_batches(with_payload), RECORD_SCHEMA)


@query("op10_warc")
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    path = scratch_path(spark, "warc")
    write_archives(pages, path)
    read = staged(read_archives(spark, path), "warc-records")
    if not read.where("kind = 'gap'").isEmpty():
        raise ValueError(f"an archive below {path} is damaged")
    found = read.where("kind = 'record'")
    kind = pages.schema["page_id"].dataType
    return found.select(
        F.col("page_id").cast(kind), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to")
    )
