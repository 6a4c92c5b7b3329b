"""WARC derivatives: metadata and plain-text conversion records of response records.

For every response one metadata record and one conversion record are built, as complete WARC/1.1 records
(bytes) and as columns. Both point to their source: WARC-Refers-To and, for metadata, WARC-Concurrent-To
name the response's record id, WARC-Target-URI, WARC-Date and WARC-IP-Address are the source's, and the
source's payload digest is kept beside the derivative's own block digest. Record ids are name-based UUIDs
of the source's id, so that a retried task writes the same records.

A response is a row (record_id, target_uri, date, ip, headers map<string,string>, block binary,
payload_digest, block_digest), the block being an HTTP message. `responses` makes such rows from a table
of pages, `warcfiles.read_responses` from WARC files; `warcfiles.write_warc` stores records in such files.
Transfer and content encodings (chunked, gzip, deflate) are undone before the text is read. The metadata record
holds the HTTP headers and the source's WARC headers as fields.

Defined cases: a null block is an empty one; a block without an empty line is all body; a missing digest
is computed; null ids and addresses leave their header out; repeated rows give records with equal ids; text
that isn't UTF-8 is decoded with replacement marks; a body whose encoding is unknown or broken has no text, and
the metadata field `contentEncodingKept` names the encoding; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from issueloom.llm.common import map_rows

NAMESPACE = uuid.UUID("6f1c7b0e-6a0e-4b7e-9d0b-0d9f5f6f2a11")
#: What holds no text, elements that end a line, and all other marks.
SILENT = re.compile(r"<!--.*?-->|<(script|style|template|noscript|head)\b.*?</\1\s*>|<!doctype[^>]*>", re.S | re.I)
BREAKS = re.compile(
    r"\s*</?(?:p|br|div|li|ul|ol|tr|table|h[1-6]|article|section|header|footer|nav|main|aside|pre|blockquote|hr|title|body|form|dl|dt|dd)\b[^>]*>\s*",
    re.I,
)
MARKS = re.compile(r"<[^>]*>")
BLANKS = re.compile(r"[ \t\r\f\v\xa0]+")
LINES = re.compile(r" ?\n[ \n]*")
TITLE = re.compile(r"<title\b[^>]*>(.*?)</title\s*>", re.S | re.I)
LANGUAGE = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z-]+)", re.I)
LINKS = re.compile(r"<a\b[^>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
CHARSET = re.compile(r"charset\s*=\s*[\"']?([\w-]+)", re.I)
EMPTY_LINE = re.compile(rb"\r?\n\r?\n")

RECORD = (
    "record_id string, warc_type string, refers_to string, target_uri string, date string, "
    "content_type string, block_digest string, source_payload_digest string, source_headers map<string,string>, "
    "content_length long, block binary, record binary"
)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def plain_text(page: str) -> str:
    """The visible text: one line per block element, entities resolved, blanks collapsed."""
    text = MARKS.sub("", BREAKS.sub("\n", SILENT.sub(" ", page).replace("\n", " ")))
    return LINES.sub("\n", BLANKS.sub(" ", html.unescape(text))).strip()


def split_http(block: bytes) -> tuple[list[tuple[str, str]], bytes]:
    """Headers, with the status line under an empty name first, and body of an HTTP message."""
    cut = EMPTY_LINE.search(block) if block[:5] == b"HTTP/" else None
    if cut is None:
        return [], block
    lines = block[: cut.start()].decode("latin-1").splitlines()
    pairs = [tuple(x.strip() for x in line.split(":", 1)) for line in lines[1:] if ":" in line]
    return [("", lines[0]), *pairs], block[cut.end() :]


def unchunked(body: bytes) -> bytes:
    """The body without the frames of chunked transfer; raises ValueError where they are broken."""
    parts, at = [], 0
    while True:
        end = body.index(b"\n", at)
        size = int(body[at:end].split(b";")[0].strip(), 16)
        if not size:
            return b"".join(parts)
        if size < 0 or end + 1 + size > len(body):
            raise ValueError("a chunk is cut off")
        parts.append(body[end + 1 : end + 1 + size])
        at = body.index(b"\n", end + 1 + size) + 1


UNDO = {
    "chunked": unchunked,
    "gzip": lambda b: zlib.decompressobj(47).decompress(b),
    "deflate": lambda b: zlib.decompressobj(15).decompress(b) if b[:1] == b"\x78" else zlib.decompressobj(-15).decompress(b),
    "identity": lambda b: b,
    "": lambda b: b,
}
UNDO["x-gzip"] = UNDO["gzip"]


def undone(body: bytes, encodings: str) -> tuple[bytes, str | None]:
    """The body with its encodings, a comma list in the order they were applied, undone; what could not be undone."""
    names = [x.strip().lower() for x in encodings.split(",")]
    while names:
        try:
            body = UNDO[names[-1]](body)
        except (KeyError, ValueError, zlib.error):
            return body, ", ".join(names)
        names.pop()
    return body, None


def decode(body: bytes, content_type: str) -> str:
    named = CHARSET.search(content_type)
    try:
        return body.decode(named[1] if named else "utf-8", "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def record_bytes(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    """A WARC record; headers without a value are left out, and line ends inside values become spaces."""
    lines = ["WARC/1.1", *(f"{k}: {' '.join(v.splitlines())}" for k, v in headers if v is not None)]
    return "\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def build(source: dict) -> list[dict]:
    """The metadata and the conversion record of one response."""
    block = source["block"] or b""
    http, body = split_http(block)
    by_name = {k.lower(): v for k, v in http}
    kind = by_name.get("content-type", "")
    body, framed = undone(body, by_name.get("transfer-encoding", ""))
    plain, kept = (body, framed) if framed else undone(body, by_name.get("content-encoding", ""))
    page = "" if kept else decode(plain, kind)
    warc_headers = source["headers"] or []
    warc_headers = list(warc_headers.items()) if isinstance(warc_headers, dict) else warc_headers
    payload_digest = source["payload_digest"] or digest(body)
    title, language = TITLE.search(page), LANGUAGE.search(page)
    fields = [
        ("sourcePayloadDigest", payload_digest),
        ("sourceBlockDigest", source["block_digest"] or digest(block)),
        ("sourceContentLength", str(len(body))),
        ("httpStatus", by_name.get("")),
        ("contentEncodingKept", kept),
        *((f"httpHeader-{k}", v) for k, v in http if k),
        *((f"sourceHeader-{k}", v) for k, v in warc_headers),
        ("title", html.unescape(title[1]).strip() if title else None),
        ("language", language[1] if language else None),
        *(("outlink", html.unescape(next(x for x in m if x))) for m in LINKS.findall(page) if any(m)),
    ]
    fields_text = "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in fields if v is not None)
    derived = [
        ("metadata", "application/warc-fields", fields_text.encode("utf-8", "replace")),
        ("conversion", "text/plain; charset=UTF-8", plain_text(page).encode("utf-8", "replace")),
    ]
    made = []
    for warc_type, content_type, own in derived:
        name = f"{source['record_id']} {source['target_uri']} {payload_digest} {warc_type}"
        record_id = f"<urn:uuid:{uuid.uuid5(NAMESPACE, name)}>"
        own_digest = digest(own)
        headers = [
            ("WARC-Type", warc_type),
            ("WARC-Record-ID", record_id),
            ("WARC-Refers-To", source["record_id"]),
            ("WARC-Concurrent-To", source["record_id"] if warc_type == "metadata" else None),
            ("WARC-Target-URI", source["target_uri"]),
            ("WARC-Date", source["date"]),
            ("WARC-IP-Address", source["ip"]),
            ("WARC-Block-Digest", own_digest),
            ("WARC-Source-Payload-Digest", payload_digest),
            ("Content-Type", content_type),
            ("Content-Length", str(len(own))),
        ]
        made.append(
            {
                "record_id": record_id,
                "warc_type": warc_type,
                "refers_to": source["record_id"],
                "target_uri": source["target_uri"],
                "date": source["date"],
                "content_type": content_type,
                "block_digest": own_digest,
                "source_payload_digest": payload_digest,
                "source_headers": warc_headers,
                "content_length": len(own),
                "block": own,
                "record": record_bytes(headers, own),
            }
        )
    return made


ARROW = pa.schema(
    [
        *[(n, pa.string()) for n in ("record_id", "warc_type", "refers_to", "target_uri", "date", "content_type", "block_digest", "source_payload_digest")],
        ("source_headers", pa.map_(pa.string(), pa.string())),
        ("content_length", pa.int64()),
        ("block", pa.binary()),
        ("record", pa.binary()),
    ]
)
KEY = "page_id"
BATCH = 256


def derive(responses: DataFrame, key: str | None = None) -> DataFrame:
    """Two rows per response. `key` names a whole-number column of the responses to carry along."""

    def make():
        def step(batch: pa.RecordBatch):
            for at in range(0, batch.num_rows, BATCH):
                rows = batch.slice(at, BATCH).to_pylist()
                made = [(r.get(key), build(r)) for r in rows]
                records = [x for _, pair in made for x in pair]
                out = pa.RecordBatch.from_pylist(records, schema=ARROW)
                if key:
                    keys = pa.array([k for k, pair in made for _ in pair], pa.int64())
                    out = pa.RecordBatch.from_arrays([keys, *out.columns], [key, *out.schema.names])
                yield out

        return step

    columns = ["record_id", "target_uri", "date", "ip", "headers", "block", "payload_digest", "block_digest"]
    keyed = [F.col(key).cast("long").alias(key)] if key else []
    return map_rows(responses.select(*keyed, *columns), (f"{key} long, " if key else "") + RECORD, make)


def responses(pages: DataFrame) -> DataFrame:
    """Response records of a table (page_id, url, html), with an HTTP message made around the page."""
    body = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    head = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.length(body).cast("string"), F.lit("\r\n\r\n")
    )
    block = F.concat(head.cast("binary"), body)
    name = F.sha1(F.concat_ws("\n", F.col("page_id").cast("string"), F.col("url")).cast("binary"))
    dashed = F.concat_ws("-", *[F.substring(name, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    return pages.select(
        F.col("page_id").cast("long"),
        F.concat(F.lit("<urn:uuid:"), dashed, F.lit(">")).alias("record_id"),
        F.col("url").cast("string").alias("target_uri"),
        F.lit("2024-01-01T00:00:00Z").alias("date"),
        F.lit(None).cast("string").alias("ip"),
        F.create_map(F.lit("WARC-Type"), F.lit("response"), F.lit("Content-Type"), F.lit("application/http; msgtype=response")).alias("headers"),
        block.alias("block"),
        F.lit(None).cast("string").alias("payload_digest"),
        F.lit(None).cast("string").alias("block_digest"),
    )


def parse_records(data: bytes) -> list[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record in uncompressed WARC bytes."""
    found, at = [], 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8").split("\r\n")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        n = int(headers["Content-Length"])
        found.append((headers, data[end + 4 : end + 4 + n]))
        at = end + 4 + n + 4
    return found
