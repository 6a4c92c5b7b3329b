import base64
import gzip
import hashlib

import re
import zlib
from html.parser import HTMLParser

import pytest

from issueloom.llm import warc, warcfiles
from issueloom.llm.common import table

PAGE = (
    '<!DOCTYPE html><html lang="fr"><head><title>T &amp; U</title><style>p{x:y}</style></head><body><script>var a="</p>";</script>'
    '<!-- no --><h1>One</h1><p>Two <b>bold</b>&nbsp;&lt;3\n more<br>Three <a href="/x?a=1&amp;b=2">link</a></body></html>'
)
SCHEMA = (
    "page_id long, record_id string, target_uri string, date string, ip string, headers map<string,string>, "
    "block binary, payload_digest string, block_digest string, record string"
)


def sha1(data):
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_plain_text():
    assert warc.plain_text(PAGE) == "One\nTwo bold <3 more\nThree link"
    assert warc.plain_text("") == "" and warc.plain_text("<p>a<p> <p>b") == "a\nb"


def test_records_keep_their_source(spark):
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-A: b\r\n\r\n" + PAGE.encode()
    latin = b"HTTP/1.1 404 Gone\nContent-Type: text/html; charset=iso-8859-1\n\n<p>caf\xe9"
    head = {"WARC-Type": "response", "WARC-IP-Address": "1.2.3.4"}
    rows = [
        (1, "<urn:a>", "http://h/1", "2020-01-01T00:00:00Z", "1.2.3.4", head, http, "sha1:GIVEN", None, "clash"),
        (2, "<urn:b>", "http://h/2", "2020-01-02T00:00:00Z", None, None, latin, None, None, "clash"),
        (3, None, None, None, None, None, None, None, None, None),
        (2, "<urn:b>", "http://h/2", "2020-01-02T00:00:00Z", None, None, latin, None, None, "clash"),
        (4, "<urn:c>", "http://h/3", "d", None, None, b"<p>\xff" + b"long " * 50_000, None, None, None),
    ]
    made = warc.derive(spark.createDataFrame(rows, SCHEMA), "page_id").collect()
    assert len(made) == 10 and len({r.record_id for r in made}) == 8
    by_key = {(r.page_id, r.warc_type): r for r in made}
    text, meta = by_key[1, "conversion"], by_key[1, "metadata"]
    assert bytes(text.block).decode() == "One\nTwo bold <3 more\nThree link"
    assert text.refers_to == meta.refers_to == "<urn:a>" and text.source_headers == head
    assert text.source_payload_digest == "sha1:GIVEN" and text.block_digest == sha1(bytes(text.block))
    fields = dict(x.split(": ", 1) for x in bytes(meta.block).decode().splitlines())
    assert fields["title"] == "T & U" and fields["language"] == "fr" and fields["outlink"] == "/x?a=1&b=2"
    assert fields["httpStatus"] == "HTTP/1.1 200 OK" and fields["httpHeader-X-A"] == "b"
    [(headers, block)] = warc.parse_records(bytes(meta.record))
    assert headers["WARC-Concurrent-To"] == headers["WARC-Refers-To"] == "<urn:a>" and block == bytes(meta.block)
    assert headers["WARC-Date"] == rows[0][3] and headers["WARC-Target-URI"] == "http://h/1" and headers["WARC-IP-Address"] == "1.2.3.4"
    other = by_key[2, "conversion"]
    assert bytes(other.block).decode() == "café" and other.source_payload_digest == sha1(b"<p>caf\xe9")
    assert bytes(by_key[3, "conversion"].block) == b"" and by_key[3, "metadata"].refers_to is None
    assert len(bytes(by_key[4, "conversion"].block)) > 200_000


def chunks(body, size=7):
    cut = [body[i : i + size] for i in range(0, len(body), size)]
    return b"".join(b"%x;a=b\r\n%s\r\n" % (len(c), c) for c in cut) + b"0\r\n\r\n"


def message(body, *headers):
    return "\r\n".join(["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", *headers, "", ""]).encode() + body


@pytest.mark.parametrize(
    "block, kept",
    [
        (message(gzip.compress(PAGE.encode()), "Content-Encoding: gzip"), None),
        (message(zlib.compress(PAGE.encode()), "Content-Encoding: deflate"), None),
        (message(zlib.compress(PAGE.encode())[2:-4], "Content-Encoding: deflate"), None),
        (message(chunks(PAGE.encode()), "Transfer-Encoding: chunked"), None),
        (message(chunks(gzip.compress(PAGE.encode())), "Transfer-Encoding: chunked", "Content-Encoding: x-gzip"), None),
        (message(gzip.compress(gzip.compress(PAGE.encode())), "Content-Encoding: gzip, gzip"), None),
        (message(b"\x8b\x02\x80", "Content-Encoding: br"), "br"),
        (message(b"not gzip", "Content-Encoding: gzip"), "gzip"),
        (message(b"ffff\r\nshort", "Transfer-Encoding: chunked"), "chunked"),
    ],
)
def test_encodings_are_undone(block, kept):
    source = {"block": block, "headers": {"X": "y"}, "record_id": "<a>", "target_uri": "u", "date": "d", "ip": None, "payload_digest": None, "block_digest": None}
    meta, text = warc.build(source)
    assert text["block"].decode() == ("" if kept else warc.plain_text(PAGE))
    fields = dict(x.split(": ", 1) for x in meta["block"].decode().splitlines())
    assert fields.get("contentEncodingKept") == kept and fields["sourceHeader-X"] == "y"


class Reader(HTMLParser):
    """The visible text, collected by a parser instead of by patterns."""

    LINES = {"p", "br", "div", "li", "ul", "h1", "h2", "article", "footer", "nav", "body", "table", "tr", "title"}

    def __init__(self):
        super().__init__()
        self.out, self.silent, self.links = [], 0, []

    def handle_starttag(self, tag, attrs):
        self.silent += tag in ("script", "style", "head", "template", "noscript")
        self.out.append("\n" if tag in self.LINES else "")
        self.links += [v for k, v in attrs if tag == "a" and k == "href" and v]

    def handle_endtag(self, tag):
        self.silent -= tag in ("script", "style", "head", "template", "noscript")
        self.out.append("\n" if tag in self.LINES else "")

    def handle_data(self, data):
        self.out.append("" if self.silent else data.replace("\n", " "))

    def text(self):
        lines = (re.sub("[ \t\r\f\v\xa0]+", " ", x).strip(" ") for x in "".join(self.out).split("\n"))
        return "\n".join(x for x in lines if x)


def test_pages_equal_records_built_by_a_parser(spark):
    pages = table(spark, "/root/testdata/sf0.001", "pages")
    made = {(r.page_id, r.warc_type): r for r in warc.derive(warc.responses(pages), "page_id").collect()}
    rows = pages.collect()
    assert len(made) == 2 * len(rows)
    for row in rows:
        parser = Reader()
        parser.feed(row.html or "")
        parser.close()
        text, meta = made[row.page_id, "conversion"], made[row.page_id, "metadata"]
        assert bytes(text.block).decode() == parser.text()
        lines = bytes(meta.block).decode().splitlines()
        assert [x.split(": ", 1)[1] for x in lines if x.startswith("outlink: ")] == [" ".join(x.split()) for x in parser.links]
        body = (row.html or "").encode()
        want = [
            "WARC/1.1", "WARC-Type: conversion", f"WARC-Record-ID: {text.record_id}", f"WARC-Refers-To: {meta.refers_to}",
            f"WARC-Target-URI: {row.url}", "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Block-Digest: {sha1(bytes(text.block))}",
            f"WARC-Source-Payload-Digest: {sha1(body)}", "Content-Type: text/plain; charset=UTF-8", f"Content-Length: {len(bytes(text.block))}",
        ]
        assert bytes(text.record) == "\r\n".join(want).encode() + b"\r\n\r\n" + bytes(text.block) + b"\r\n\r\n"


def test_records_survive_files(spark, tmp_path):
    schema = "page_id long, url string, html string, block int"
    pages = spark.createDataFrame([(1, "http://a/", PAGE, 0), (2, None, None, 0), (None, "u", "", 0)], schema).repartition(3)
    records = warc.derive(warc.responses(pages))
    out = f"{tmp_path}/out"
    warcfiles.write_warc(records, out)
    want = sorted((r.record_id, bytes(r.block)) for r in records.collect())
    read = warcfiles.read_warc(spark, out)
    assert sorted((r.headers["WARC-Record-ID"], bytes(r.block)) for r in read.collect()) == want
    assert all(sha1(bytes(r.block)) == r.headers["WARC-Block-Digest"] for r in read.collect())
    warcfiles.write_warc(records, out)
    assert warcfiles.read_warc(spark, out).count() == 2 * len(want)
    warcfiles.write_warc(records.limit(1), out, mode="overwrite")
    assert warcfiles.read_warc(spark, out).count() == 1 and not [p for p in (tmp_path / "out").iterdir() if p.name.startswith("_")]
    none = warc.derive(warc.responses(pages.limit(0)))
    warcfiles.write_warc(none, f"{tmp_path}/none")
    assert none.collect() == [] and warcfiles.read_warc(spark, f"{tmp_path}/none").collect() == []


def test_responses_are_read_from_files_and_derived(spark, tmp_path):
    bodies = {"<urn:1>": message(chunks(gzip.compress(PAGE.encode())), "Transfer-Encoding: chunked", "Content-Encoding: gzip"), "<urn:2>": message(PAGE.encode())}
    data = b"".join(
        warc.record_bytes([("WARC-Type", kind), ("WARC-Record-ID", i), ("WARC-Target-URI", "http://h/"), ("X-Own", "o"), ("Content-Length", str(len(b)))], b)
        for i, b in bodies.items()
        for kind in ("response", "request")
    )
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(data[: len(data) // 3]) + gzip.compress(data[len(data) // 3 :]))
    (tmp_path / "b.warc").write_bytes(data.replace(b"<urn:", b"<urn:b"))
    made = warc.derive(warcfiles.read_responses(spark, str(tmp_path))).collect()
    assert sorted(r.refers_to for r in made) == sorted(2 * ["<urn:1>", "<urn:2>", "<urn:b1>", "<urn:b2>"])
    texts = [bytes(r.block).decode() for r in made if r.warc_type == "conversion"]
    assert texts == [warc.plain_text(PAGE)] * 4
    assert all(b"sourceHeader-X-Own: o\r\n" in bytes(r.block) for r in made if r.warc_type == "metadata")
    (tmp_path / "c.warc").write_bytes(data[:-30])
    with pytest.raises(Exception, match="ends inside a record"):
        warcfiles.read_warc(spark, str(tmp_path)).collect()
