"""WARC archives: a writer that Spark's own text sink commits, and a salvaging reader.

Writing: every row is one record. Of equal payloads of at least MIN_REVISIT bytes the smallest id is the response and the
others are revisits that refer to it. Only ids and digests are shuffled to find that out; the rows that a response
stands for are joined to the payloads as a broadcast where they are few, otherwise as a shuffle join. Records are written
as text whose line separator is the empty line pair that ends a WARC record, so any file system that Spark writes to will
do, and the commit protocol covers lost executors.

Reading: archives are plain or gzip members of one or more records. A record whose version line, header, length, trailer
or payload digest fails is not returned; the reader looks for the next version line or member that reads as a whole valid
record, goes on from there, and reports the bytes between as a quarantined gap with its reason. What a member holds,
gaps included, is reported at the member's place; of a damaged member the whole records before the damage.

Edge cases: a null payload is empty, a null url is an empty target, line breaks in a url are percent-encoded. Null ids
are written without one and read back as null, and are the smallest of no group unless all ids are null. Rows that
repeat an id with an equal payload are captures of the same page: all with the smallest id are responses.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path

MIN_REVISIT = 100
END = "\r\n\r\n"
#: Rows of revisited ids up to which they are broadcast.
FEW = 200_000
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
#: Pages of a file by the largest payload that a page of the class may have: no file grows much over 128 MB but for one page.
CLASSES = [(1 << 16, 2_000), (1 << 20, 125), (None, 1)]
#: Compressed bytes that a member is read by, so that the rest of the archive is not copied for each of its members.
STEP = 1 << 15
VERSION = re.compile(rb"WARC/1\.[01]\r\n|\x1f\x8b\x08")


def roles(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) with payload_bytes, payload_digest, record_type and refers_to."""
    spark = pages.sparkSession
    html = F.coalesce(F.col("html"), F.lit(""))
    base = pages.select("page_id", "url", html.alias("html"), F.octet_length(html).cast("long").alias("payload_bytes"), F.sha2(html.cast("binary"), 256).alias("payload_digest"))
    groups = base.filter(F.col("payload_bytes") >= MIN_REVISIT).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("payload_digest", "first")
    path = fresh_path(spark, "groups")
    groups.write.parquet(path)
    groups = spark.read.schema(groups.schema).parquet(path)
    groups = F.broadcast(groups) if groups.count() <= FEW else groups
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    return base.join(groups, "payload_digest", "left").select("page_id", "url", "html", "payload_bytes", "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to"))


def record() -> F.Column:
    """The text of one record without its end."""
    target = F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), "\r", "%0D"), "\n", "%0A")
    revisit = F.col("record_type") == "revisit"
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")), F.lit(""))
    http = F.concat(F.lit(HTTP), F.col("payload_bytes").cast("string"), F.lit(END))
    block = F.when(revisit, http).otherwise(F.concat(http, "html"))
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"))),
        line("WARC-Target-URI", target),
        line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
        F.when(revisit, "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n").otherwise(""),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "payload_digest")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", F.octet_length(block)),
        F.lit("\r\n"),
        block,
    )


def write(pages: DataFrame, path: str) -> None:
    """Archive pages (page_id, url, html) under a path, as plain WARC files; large pages share a file with few others."""
    records = roles(pages)
    largest = pages.agg(F.max(F.octet_length("html"))).first()[0] or 0
    low = -1
    for high, records_a_file in CLASSES:
        own = F.col("payload_bytes") > low
        rows = records.filter(own & (F.col("payload_bytes") <= high) if high else own)
        rows.select(record().alias("value")).write.mode("append").option("lineSep", END).option("maxRecordsPerFile", records_a_file).text(path)
        if high is None or largest <= high:
            break
        low = high


def _record(data: bytes, at: int) -> tuple[dict[str, str], bytes, int] | str:
    """Header, block and end of the plain record at a place, or why there is none."""
    if data[at : at + 10] not in (b"WARC/1.0\r\n", b"WARC/1.1\r\n"):
        return "no version line"
    stop = data.find(b"\r\n\r\n", at)
    if stop < 0:
        return "no header end"
    header: dict[str, str] = {}
    for raw in data[at + 10 : stop].split(b"\r\n"):
        name, colon, value = raw.partition(b":")
        if not colon:
            return "broken header line"
        header[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    if not header.get("warc-record-id") or not header.get("warc-type"):
        return "no record id or type"
    length = header.get("content-length", "")
    if not (length.isascii() and length.isdigit() and len(length) < 16):
        return "no content length"
    end = stop + 4 + int(length)
    if data[end : end + 4] != b"\r\n\r\n":
        return "no record end"
    block = data[stop + 4 : end]
    digest = header.get("warc-payload-digest", "")
    if header.get("warc-type") == "response" and digest.startswith("sha256:") and hashlib.sha256(block.partition(b"\r\n\r\n")[2]).hexdigest() != digest[7:]:
        return "payload digest differs"
    return header, block, end + 4


Found = tuple[str | None, dict[str, str] | None, bytes | None]


def _member(data: bytes, at: int) -> tuple[list[Found], int | None] | str:
    """What the gzip member at a place holds and its end, or why it holds no record.

    Of a broken or cut member the whole records before the damage are held, then the reason; its end is not known.
    """
    member, plain, fed, reason = zlib.decompressobj(31), bytearray(), at, None
    while not member.eof and fed < len(data):
        before = member.copy()
        try:
            plain += member.decompress(data[fed : fed + STEP])
        except zlib.error:
            reason = "broken gzip member"
            try:  # what the step gives up to the damage
                for i in range(fed, fed + STEP, 64):
                    plain += before.decompress(data[i : i + 64])
            except zlib.error:
                pass
            break
        fed = min(fed + STEP, len(data))
    if reason is None and not member.eof:
        reason = "cut gzip member"
    inner = [x[2:] for x in salvage(bytes(plain), nested=True)]
    if reason:
        whole = [x for x in inner if x[0] is None]
        return (whole, None) if whole else reason
    if all(why for why, *_ in inner):
        return inner[0][0] if inner else "empty gzip member"
    return inner, fed - len(member.unused_data)


def _at(data: bytes, at: int, nested: bool = False) -> tuple[list[Found], int | None] | str:
    """What a plain record or a gzip member holds and its end, or why there is neither."""
    if data[at : at + 2] == b"\x1f\x8b" and not nested:
        return _member(data, at)
    got = _record(data, at)
    return got if isinstance(got, str) else ([(None, *got[:2])], got[2])


def salvage(data: bytes, nested: bool = False) -> Iterator[tuple[int, int, str | None, dict[str, str] | None, bytes | None]]:
    """(offset, length, reason, header, block) of every record, and of every gap with its reason. Nested: no member is looked for."""
    at = 0
    while at < len(data):
        got = _at(data, at, nested)
        found, end = ([], None) if isinstance(got, str) else got
        start, at = at, end
        if end is None:
            at = next((m.start() for m in VERSION.finditer(data, start + 1) if not isinstance(_at(data, m.start(), nested), str)), len(data))
        for one in found:
            yield start, at - start, *one
        if end is None:
            yield start, at - start, got if isinstance(got, str) else "damaged gzip member", None, None


FIELDS = "path string, offset long, length long, gap string, page_id string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string, payload binary"
LENGTH = re.compile(rb"(?i)^content-length:\s*([0-9]+)\s*$", re.MULTILINE)
URN = re.compile(r"^<urn:page:(.*)>$", re.DOTALL)


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records and gaps of all archives under a path: FIELDS. `gap` is null for records; gaps have only their place and reason."""

    def urn(text: str | None) -> str | None:
        found = URN.match(text or "")
        return found[1] or None if found else None

    def row(name, data):
        for offset, length, reason, header, block in salvage(data):
            if header is None:
                yield name, offset, length, reason, *[None] * 7
                continue
            http, _, payload = block.partition(b"\r\n\r\n")
            said = LENGTH.search(http)
            kind = header.get("warc-type")
            size = int(said[1]) if said and kind == "revisit" else len(payload)
            yield name, offset, length, None, urn(header.get("warc-record-id")), header.get("warc-target-uri"), kind, urn(header.get("warc-refers-to")), size, header.get("warc-payload-digest", "").removeprefix("sha256:") or hashlib.sha256(payload).hexdigest(), payload if payloads else None

    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    names = [f.split()[0] for f in FIELDS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows, held = [], 0
                for r in row(name, data.as_py()):
                    rows.append(r)
                    held += len(r[-1] or b"") + 500
                    if held > 1 << 23:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, FIELDS)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages to the shared folder and read their records back, ids in their own type. Fails where bytes are unreadable."""
    path = fresh_path(pages.sparkSession, "archive")
    write(pages.select("page_id", "url", "html"), path)
    kind = pages.schema["page_id"].dataType
    lost = F.raise_error(F.concat(F.lit("unreadable bytes in "), "path", F.lit(": "), "gap")).cast("boolean")
    found = read(pages.sparkSession, path, payloads=False).filter(F.when(F.col("gap").isNull(), True).otherwise(lost))
    return found.select(F.col("page_id").cast(kind).alias("page_id"), "url", "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
