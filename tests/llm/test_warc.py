"""WARC derivatives: links, digests and text of derived records, round trip through files, awkward rows."""

import base64
import hashlib
import tempfile
from html.parser import HTMLParser

from tests.conftest import SMALL

from tabloom.llm import queries as Q
from tabloom.llm.warc import derive, page_responses, parse_warc, read_warc, write_warc


class Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.skip, self.links = [""], 0, []

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style", "title")
        self.blocks[-1] += " " if tag == "br" else ""
        if tag == "a":
            self.links.append(dict(attrs).get("href", ""))
        elif tag not in ("b", "br"):
            self.blocks.append("")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style", "title")
        if tag not in ("b", "a"):
            self.blocks.append("")

    def handle_data(self, data):
        if not self.skip:
            self.blocks[-1] += data


def sha1(data):
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_query_equals_independent_parser(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    rows = Q.op7_warc_derivatives(spark, SMALL).collect()
    assert len(rows) == 2 * len(pages) and len({r.record_id for r in rows}) == len(rows)
    responses = {r.page_id: r for r in page_responses(spark.read.parquet(f"{SMALL}/pages.parquet"), ("page_id",)).collect()}
    for r in rows:
        page, source = pages[r.page_id], responses[r.page_id]
        assert r.refers_to == source.record_id and f"WARC-Refers-To: {source.record_id}" in r.source_headers.split("\n")
        assert r.payload_digest == sha1(page.html.encode()) and r.block_digest == sha1(r.block.encode())
        assert r.content_length == len(r.block.encode()) and r.url == page.url
        p = Text()
        p.feed(page.html)
        p.close()
        if r.record_type == "conversion":
            assert r.block == "\n".join(t for b in p.blocks if (t := " ".join(b.split())))
        else:
            lines = r.block.split("\r\n")
            assert [x.split(" ")[1] for x in lines if x.startswith("outlink: ")] == p.links
            assert f"source-record: {source.record_id}" in lines and f"source-block-digest: {sha1(bytes(source.block))}" in lines


def test_files_round_trip(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").limit(30)
    responses = page_responses(pages)
    folder = tempfile.mkdtemp(prefix="warc-")
    write_warc(responses, f"{folder}/in")
    back = read_warc(spark, f"{folder}/in")
    key = lambda r: (r.record_id, r.target_uri, r.date, bytes(r.block))
    assert sorted(map(key, back.collect())) == sorted(map(key, responses.collect()))
    derived = derive(back)
    write_warc(derived, f"{folder}/out", "none")
    again = {r.record_id: r for r in read_warc(spark, f"{folder}/out").collect()}
    for r in derived.collect():
        x = again[r.record_id]
        named = {h.name: h.value for h in x.headers}
        assert bytes(x.block) == bytes(r.block) and named["WARC-Refers-To"] == r.refers_to and named["WARC-Payload-Digest"] == r.payload_digest
        assert named["WARC-Block-Digest"] == sha1(bytes(r.block)) and named["WARC-Identified-Payload-Type"] == "text/html"


def test_parse():
    one = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 7\r\n\r\na\r\n\r\nbc\r\n\r\n"
    assert [r["block"] for r in parse_warc(one * 2 + b"junk")] == [b"a\r\n\r\nbc"] * 2
    assert list(parse_warc(b"")) == []


def test_odd_records(spark):
    http = b"HTTP/1.1 404 Not Found\r\nContent-Type: text/html; charset=iso-8859-1\r\n\r\n<title>x\ny</title><p>caf\xe9 <a href='/z'>go</a>"
    rows = [("response", "<urn:uuid:1>", "http://a", "2020-01-01T00:00:00Z", "", [("WARC-IP-Address", "1.2.3.4"), ("WARC-Payload-Digest", "sha1:KEEP"), ("Content-Length", "9")], http),
            ("request", "<urn:uuid:2>", "http://a", "", "", [], b""), ("response", None, None, None, None, None, None),
            ("response", "<urn:uuid:3>", "http://b", "d", "", [(None, "x")], b"HTTP/1.1 200 OK\r\nContent-Type: image/png\r\n\r\n\x89PNG<p>"),
            ("response", "<urn:uuid:4>", "http://c", "d", "", [], b"HTTP/1.0 200 OK\nContent-Type: text/plain; charset=nope\n\nplain \xff"),
            ("response", "<urn:uuid:1>", "http://a", "2020-01-01T00:00:00Z", "", [], http)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "record_type string, record_id string, target_uri string, date string, content_type string, "
                               "headers array<struct<name:string,value:string>>, block binary, refers_to string")
    out = derive(df).collect()
    assert len(out) == 10
    text = {r.refers_to: bytes(r.block).decode() for r in out if r.record_type == "conversion"}
    assert text["<urn:uuid:1>"] == "café go" and text["<urn:uuid:3>"] == "" and text["<urn:uuid:4>"] == "plain �"
    meta = [r for r in out if r.record_type == "metadata" and r.refers_to == "<urn:uuid:1>" and r.payload_digest == "sha1:KEEP"][0]
    assert {"title: x y", "outlink: /z go", "status: HTTP/1.1 404 Not Found", "source-payload-digest: sha1:KEEP"} <= set(bytes(meta.block).decode().split("\r\n"))
    assert {(h.name, h.value) for h in meta.headers} >= {("WARC-IP-Address", "1.2.3.4"), ("WARC-Refers-To", "<urn:uuid:1>")}
    assert all(h.name != "Content-Length" for h in meta.headers)
    assert derive(df.limit(0)).count() == 0
