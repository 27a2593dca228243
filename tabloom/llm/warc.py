"""WARC derivatives: metadata and plain-text conversion records linked to response records."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm.html_blocks import read_page

VERSION = "WARC/1.1"
RECORD = ("record_type string, record_id string, target_uri string, date string, content_type string, "
          "headers array<struct<name:string,value:string>>, block binary")
DERIVED = RECORD + ", refers_to string, block_digest string, payload_digest string"
_HEADER = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))
_CHARSET = re.compile(rb"charset\s*=\s*[\"']?\s*([A-Za-z0-9_:.-]+)", re.I)
# fixed values: headers of a record's own that a derived record sets anew
OWN = {"warc-type", "warc-record-id", "content-length", "content-type", "warc-block-digest", "warc-payload-digest", "warc-refers-to",
       "warc-refers-to-target-uri", "warc-refers-to-date", "warc-target-uri", "warc-date", "warc-concurrent-to", "warc-truncated"}


def digest(data: bytes) -> str:
    """Labelled SHA-1 in base 32, as archives write it."""
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(kind: str, *parts: bytes) -> str:
    """A urn:uuid made from a record's kind and parts, the same in every run."""
    h = hashlib.sha256(kind.encode())
    for p in parts:
        h.update(len(p).to_bytes(8, "big") + p)
    return f"<urn:uuid:{uuid.UUID(bytes=h.digest()[:16], version=5)}>"


def payload_of(block: bytes) -> tuple[bytes, bytes]:
    """Head and body of an HTTP message; a block without a head is all body."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    for gap in (b"\r\n\r\n", b"\n\n"):
        head, found, body = block.partition(gap)
        if found:
            return head, body
    return block, b""


def decode(head: bytes, body: bytes) -> str:
    """Body text by the charset of the head or of the first bytes of the page, or UTF-8."""
    m = _CHARSET.search(head) or _CHARSET.search(body[:2048])
    try:
        return body.decode(m[1].decode() if m else "utf-8", "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def is_html(head: bytes, body: bytes) -> bool:
    m = re.search(rb"^content-type:\s*([^\s;]+)", head, re.I | re.M)
    return (m[1].lower() in (b"text/html", b"application/xhtml+xml")) if m else b"<" in body[:1024]


def field(name: str, value: str) -> str:
    """A line of a warc-fields block; line breaks in values become spaces."""
    return f"{name}: {' '.join(value.split())}\r\n"


def derive_one(rid: str, uri: str, date: str, headers: list[tuple[str, str]], block: bytes) -> list[dict]:
    """The metadata and the conversion record of one response."""
    head, body = payload_of(block)
    source = {n.lower(): v for n, v in headers}
    payload_digest = source.get("warc-payload-digest") or digest(body)
    linked = [("WARC-Refers-To", rid), ("WARC-Refers-To-Target-URI", uri), ("WARC-Refers-To-Date", date)]
    linked += [(n, v) for n, v in headers if n.lower() not in OWN]
    linked = [(n, v) for n, v in linked if v]
    title, links, text = "", [], ""
    if is_html(head, body):
        blocks, links, title = read_page(decode(head, body))
        text = "\n".join(b.text for b in blocks)
    elif re.search(rb"^content-type:\s*text/", head, re.I | re.M):
        text = decode(head, body)
    status = head.split(b"\r\n")[0].decode("latin-1") if head else ""
    meta = "".join([field("source-record", rid), field("source-block-digest", source.get("warc-block-digest") or digest(block)),
                    field("source-payload-digest", payload_digest)]
                   + [field(n, v) for n, v in (("status", status), ("title", title)) if v]
                   + [field("outlink", f"{x.href} {x.text}") for x in links]).encode("utf-8", "replace")
    text_block = text.encode("utf-8", "replace")
    out = []
    for kind, content_type, data in (("metadata", "application/warc-fields", meta), ("conversion", "text/plain; charset=utf-8", text_block)):
        own = record_id(kind, rid.encode(), data)
        out.append({"record_type": kind, "record_id": own, "target_uri": uri, "date": date, "content_type": content_type,
                    "headers": [{"name": n, "value": v} for n, v in linked], "block": data, "refers_to": rid,
                    "block_digest": digest(data), "payload_digest": payload_digest})
    return out


def derive(records: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """A metadata and a conversion record for every ``response`` among the records.

    ``records`` has the columns of :data:`RECORD`.  Both results name the
    response in ``refers_to`` and in WARC-Refers-To, carry on the source's
    other headers (such as its IP address), and keep the source's payload
    digest, computed where it has none.  The metadata block has the source's
    digests, status line, title and links; the conversion block is the page's
    text, one line a block (empty for what is not text).  ``keep`` names
    columns to carry along.

    A narrow pass.  Null blocks count as empty, null URIs and dates are left
    out of the headers, a response without an id gets one from its URI, date
    and block; repeated rows are derived each; other record types are skipped.
    """
    df = records.where(F.col("record_type") == "response").select(
        F.struct(F.lit(0).alias("_"), *keep).alias("row"), "record_id", "target_uri", "date", "headers", "block")
    row_type = df.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pick, out = [], []
            for i, (rid, uri, date, headers, block) in enumerate(zip(*(b.column(c).to_pylist() for c in (
                    "record_id", "target_uri", "date", "headers", "block")))):
                block, uri, date = block or b"", uri or "", date or ""
                rid = rid or record_id("response", uri.encode(), date.encode(), block)
                two = derive_one(rid, uri, date, [(h["name"], h["value"]) for h in headers or [] if h and h["name"]], block)
                out += two
                pick += [i] * len(two)
            cols = {c: [r[c] for r in out] for c in ("record_type", "record_id", "target_uri", "date", "content_type", "headers", "block",
                                                     "refers_to", "block_digest", "payload_digest")}
            yield pa.RecordBatch.from_pydict({"row": b.column("row").take(pa.array(pick, pa.int64()))} | {
                c: pa.array(v, _HEADER if c == "headers" else pa.binary() if c == "block" else pa.string()) for c, v in cols.items()})

    out = df.mapInArrow(run, f"row {row_type}, {DERIVED}")
    return out.select(*[F.col("row").getField(c).alias(c) for c in keep], *[c for c in out.columns if c != "row"])


def page_responses(pages: DataFrame, keep: tuple[str, ...] = (), date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response records of fetched pages (``url``, ``html``): an HTTP message around the page as UTF-8."""
    html = F.coalesce(F.col("html"), F.lit(""))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.octet_length(html).cast("string"), F.lit("\r\n\r\n"))
    h = F.sha2(F.concat_ws("\n", F.coalesce("url", F.lit("")), html), 256)
    rid = F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3),
                   F.lit("-8"), F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))
    header = F.array(F.struct(F.lit("WARC-Identified-Payload-Type").alias("name"), F.lit("text/html").alias("value")))
    return pages.select(*keep, F.lit("response").alias("record_type"), rid.alias("record_id"), F.col("url").alias("target_uri"),
                        F.lit(date).alias("date"), F.lit("application/http; msgtype=response").alias("content_type"),
                        header.alias("headers"), F.concat(head, html).cast("binary").alias("block"))


def write_warc(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """Write records as WARC files, one a partition.

    A record ends with two empty lines, which is the writer's line separator;
    blocks must be UTF-8 (responses of other charsets are not written here).
    """
    def line(name: str, value) -> F.Column:
        return F.when(value.isNotNull() & (value != ""), F.concat(F.lit(name + ": "), value, F.lit("\r\n"))).otherwise("")

    block = F.coalesce(F.col("block"), F.lit(b""))
    extra = F.aggregate(F.coalesce("headers", F.array().cast("array<struct<name:string,value:string>>")), F.lit(""),
                        lambda a, h: F.concat(a, h["name"], F.lit(": "), F.coalesce(h["value"], F.lit("")), F.lit("\r\n")))
    digests = [line(n, F.col(c)) for n, c in (("WARC-Block-Digest", "block_digest"), ("WARC-Payload-Digest", "payload_digest")) if c in records.columns]
    value = F.concat(F.lit(VERSION + "\r\n"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", F.col("record_id")),
                     line("WARC-Target-URI", F.col("target_uri")), line("WARC-Date", F.col("date")), extra, *digests,
                     line("Content-Type", F.col("content_type")), F.lit("Content-Length: "), F.octet_length(block).cast("string"),
                     F.lit("\r\n\r\n"), F.decode(block, "UTF-8"))
    records.select(value.alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", compression).text(path)


def parse_warc(data: bytes) -> Iterator[dict]:
    """Records of an uncompressed WARC file; a damaged rest ends it."""
    at = 0
    while True:
        while data[at:at + 2] == b"\r\n":
            at += 2
        end = data.find(b"\r\n\r\n", at)
        if not data.startswith(b"WARC/", at) or end < 0:
            return
        headers = [tuple(x.strip() for x in h.split(":", 1)) for h in data[at:end].decode("utf-8", "replace").split("\r\n")[1:] if ":" in h]
        named = {n.lower(): v for n, v in headers}
        size = int(named.get("content-length") or 0)
        yield {"record_type": named.get("warc-type"), "record_id": named.get("warc-record-id"), "target_uri": named.get("warc-target-uri"),
               "date": named.get("warc-date"), "content_type": named.get("content-type"), "headers": [{"name": n, "value": v} for n, v in headers],
               "block": data[end + 4:end + 4 + size]}
        at = end + 4 + size


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files, plain or gzip (one member a file or one a record); a file is one task's."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gzip
        for b in batches:
            for data in b.column("content").to_pylist():
                rows = list(parse_warc(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data))
                yield pa.RecordBatch.from_pydict({c: pa.array([r[c] for r in rows], _HEADER if c == "headers" else pa.binary() if c == "block" else pa.string())
                                                  for c in ("record_type", "record_id", "target_uri", "date", "content_type", "headers", "block")})
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD)


def summary(records: DataFrame) -> DataFrame:
    """Columns of the registered query: every derived record by its links, digests and block."""
    names = F.transform("headers", lambda h: F.concat(h["name"], F.lit(": "), h["value"]))
    return records.select("page_id", F.col("target_uri").alias("url"), "record_type", "record_id", "refers_to", "content_type",
                          F.array_join(names, "\n").alias("source_headers"), F.octet_length("block").cast("long").alias("content_length"),
                          "block_digest", "payload_digest", F.decode("block", "UTF-8").alias("block"))
