"""WARC archives: records written through Spark's writers, read back and assembled into captures.

Each page gives three records: a request, a response (or a revisit of an equal payload) and metadata,
the first and last naming the second as concurrent.  A record is one row whose text ends where the
writer's line separator, the archive's record terminator, begins; so archives are written to any file
system that Spark reaches.  Reading parses each file by content lengths and joins the records of a
transaction through their concurrent-to identifiers into one nested row per capture.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize

#: Fixed values of the format.
VERSION = "WARC/1.1"
CRLF = "\r\n"
END_OF_RECORD = "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

#: Bytes of payload in one archive file, about; a longer payload has a file of its own size.
FILE_BYTES = 16 << 20
#: Up to so many shared payloads their table is sent to every executor; a larger one is joined by a shuffle.
BROADCAST_PAYLOADS = 1_000_000
RECORD = "record_id string, type string, concurrent_to string, refers_to string, uri string, digest string, payload_bytes long, digest_ok boolean, payload binary"


def base32(sha1_hex: Column) -> Column:
    """40 hexadecimal digits of SHA-1 as 32 characters of upper-case base 32: four for each five digits."""
    pieces = [F.lpad(F.conv(F.substring(sha1_hex, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*pieces), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def _header(fields: list[tuple[str, Column]]) -> Column:
    lines = [F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)) for name, value in fields]
    return F.concat(F.lit(VERSION + CRLF), *lines, F.lit(CRLF))


def _line(text: Column) -> Column:
    """A header value on one line: controls and spaces are percent-coded."""
    return F.regexp_replace(F.replace(text, F.lit(" "), F.lit("%20")), "[\\x00-\\x1F\\x7F]", "%00")


def plan_records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0) -> DataFrame:
    """Per page: ``page_id, ordinal, url, html, bytes, digest, refers_id, refers_ordinal``; the latter null for responses.

    Of the pages with equal payloads of at least ``min_bytes`` bytes, the one with the smallest id is the
    response (null ids last) and the others revisit it; of repeated ids with one payload, the first row.
    Payloads meet by digest: identifiers only are grouped, with a map-side minimum.  ``pages`` is read
    twice and must give its rows in the same order each time, as a stored table does.
    """
    p = pages.select(
        F.col(page_id).cast("long").alias("page_id"), F.monotonically_increasing_id().alias("ordinal"), F.coalesce(F.col(url), F.lit("")).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html")
    ).withColumn("sha1", F.sha1("html")).withColumn("bytes", F.octet_length("html").cast("long"))
    place = F.struct(F.col("page_id").isNull().alias("unnamed"), F.col("page_id").alias("id"), F.col("ordinal").alias("row"))
    shared = p.where(F.col("bytes") >= min_bytes).groupBy("sha1").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    shared = materialize(shared.select(F.col("sha1").alias("of"), "first"), "shared-payloads")
    joined = p.join(F.broadcast(shared) if shared.count() <= BROADCAST_PAYLOADS else shared, (F.col("sha1") == F.col("of")) & (F.col("bytes") >= min_bytes), "left")
    again = F.col("first").isNotNull() & (F.col("first.row") != F.col("ordinal"))
    return joined.select(
        "page_id", "ordinal", "url", "html", "bytes", base32(F.col("sha1")).alias("digest"), again.alias("again"),
        F.when(again, F.col("first.id")).alias("refers_id"), F.when(again, F.col("first.row")).alias("refers_ordinal"),
    )


def record_id(page_id: Column, ordinal: Column, kind: str) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(":"), ordinal.cast("string"), F.lit(f":{kind}>"))


def render_records(planned: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Planned pages -> ``record string``, three rows each, without the record terminator."""
    own, uri = record_id(F.col("page_id"), F.col("ordinal"), "capture"), _line(F.col("url"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(CRLF + CRLF))
    block = F.when(F.col("again"), http).otherwise(F.concat(http, F.col("html")))
    size = lambda c: F.octet_length(c).cast("string")
    common = [("WARC-Date", F.lit(date)), ("WARC-Target-URI", uri)]
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))
    http_type = ("Content-Type", F.lit("application/http; msgtype=response"))
    response = F.concat(_header([("WARC-Type", F.lit("response")), ("WARC-Record-ID", own), *common, digest, http_type, ("Content-Length", size(block))]), block)
    refers = ("WARC-Refers-To", record_id(F.col("refers_id"), F.col("refers_ordinal"), "capture"))
    revisit = F.concat(_header([("WARC-Type", F.lit("revisit")), ("WARC-Record-ID", own), *common, ("WARC-Profile", F.lit(REVISIT_PROFILE)), refers, digest, http_type, ("Content-Length", size(block))]), block)
    ask = F.concat(F.lit("GET "), uri, F.lit(f" HTTP/1.1{CRLF}{CRLF}"))
    request = F.concat(_header([("WARC-Type", F.lit("request")), ("WARC-Record-ID", record_id(F.col("page_id"), F.col("ordinal"), "request")), ("WARC-Concurrent-To", own), *common, ("Content-Type", F.lit("application/http; msgtype=request")), ("Content-Length", size(ask))]), ask)
    note = F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(CRLF))
    metadata = F.concat(_header([("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", record_id(F.col("page_id"), F.col("ordinal"), "metadata")), ("WARC-Concurrent-To", own), *common, ("Content-Type", F.lit("application/warc-fields")), ("Content-Length", size(note))]), note)
    return planned.select(F.explode(F.array(request, F.when(F.col("again"), revisit).otherwise(response), metadata)).alias("record"))


def write(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0, file_bytes: int = FILE_BYTES) -> None:
    """Write ``pages`` as compressed WARC files of about ``file_bytes`` uncompressed bytes under ``path``.

    Tasks write the pages they hold, in several files each; no page is moved.
    """
    mean = pages.agg(F.avg(F.coalesce(F.octet_length(html), F.lit(0)) + 1024)).first()[0] or 1024
    records = render_records(plan_records(pages, page_id, url, html, min_bytes))
    per_file = max(3, int(3 * file_bytes / mean))
    records.write.option("lineSep", END_OF_RECORD).option("maxRecordsPerFile", per_file).option("compression", "gzip").text(path)


def _payload(kind: str, block: bytes) -> tuple[bytes | None, int | None]:
    """Payload of an HTTP message, and its length by the message's own header where it is left out."""
    if kind not in ("response", "revisit"):
        return None, None
    head, _, body = block.partition(b"\r\n\r\n")
    if kind == "response":
        return body, len(body)
    for line in head.split(b"\r\n"):
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length":
            return None, int(value)
    return None, None


def inflate(data: bytes) -> bytes:
    """The archive's bytes: one or more gzip members, or not compressed."""
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    while data:
        member = zlib.decompressobj(31)
        out.append(member.decompress(data))
        data = member.unused_data
    return b"".join(out)


def parse(data: bytes) -> Iterator[dict]:
    """Records of one archive by content lengths; raises on what is not WARC."""
    at = 0
    while at < len(data):
        stop = data.find(b"\r\n\r\n", at)
        lines = data[at : stop if stop >= 0 else len(data)].split(b"\r\n")
        if stop < 0 or not lines[0].startswith(b"WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = {n.strip().lower().decode(): v.strip().decode("utf-8", "replace") for n, _, v in (x.partition(b":") for x in lines[1:])}
        begin = stop + 4
        end = begin + int(fields["content-length"])
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} has another length than its header says")
        kind = fields["warc-type"]
        payload, size = _payload(kind, data[begin:end])
        digest = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
        own = None if payload is None else base64.b32encode(hashlib.sha1(payload).digest()).decode()
        yield {
            "record_id": fields["warc-record-id"], "type": kind, "concurrent_to": fields.get("warc-concurrent-to"), "refers_to": fields.get("warc-refers-to"),
            "uri": fields.get("warc-target-uri"), "digest": digest, "payload_bytes": size, "digest_ok": None if own is None else own == digest,
            "payload": payload if payload is not None else data[begin:end] if kind == "metadata" else None,
        }
        at = end + 4


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records of all archives under ``path``, one row each; without ``payloads`` those of responses are left out."""
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    schema = pa.schema([(n, kinds.get(t, pa.string())) for n, t in (x.split() for x in RECORD.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                held, size = [], 0
                for record in parse(inflate(content.as_py())):
                    if not payloads and record["type"] == "response":
                        record["payload"] = None
                    held.append(record)
                    size += len(record["payload"] or b"") + 500
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    files = spark.read.format("binaryFile").load(path).where("length > 0").select("content")
    return files.mapInArrow(run, RECORD)


def captures(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``capture_id, response, request, metadata``.

    ``response`` is the response or revisit record; requests and metadata that name it as concurrent
    stand beside it, null where there are none (of several, the one with the smallest id).  Records that
    name an absent response form a capture without one.
    """
    row = F.struct(*[F.col(c) for c in ("record_id", "type", "refers_to", "uri", "digest", "payload_bytes", "digest_ok", "payload")])
    of = lambda *kinds: F.min_by(F.when(F.col("type").isin(*kinds), row), F.when(F.col("type").isin(*kinds), F.col("record_id")))
    keyed = records.withColumn("capture_id", F.when(F.col("type").isin("response", "revisit"), F.col("record_id")).otherwise(F.coalesce("concurrent_to", "record_id")))
    return keyed.groupBy("capture_id").agg(of("response", "revisit").alias("response"), of("request").alias("request"), of("metadata").alias("metadata"))


def page_of(record: Column) -> Column:
    """Page id in a record id; null where the page had none."""
    part = F.element_at(F.split(record, ":"), 3)
    return F.when(part != "", part.cast("long"))


def page_rows(found: DataFrame) -> DataFrame:
    """Captures of pages written by ``write`` -> one digest row per page."""
    r = F.col("response")
    return found.select(
        page_of(F.col("capture_id")).alias("page_id"), r["payload_bytes"].alias("payload_bytes"), r["digest"].alias("payload_digest"), r["type"].alias("record_type"),
        F.when(r["type"] == "revisit", page_of(r["refers_to"])).alias("refers_to"),
        (F.col("request").isNotNull() & F.col("metadata").isNotNull()).alias("complete"), F.coalesce(r["digest_ok"], F.lit(True)).alias("digest_ok"),
    )
