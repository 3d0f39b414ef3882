"""Pages and records of every form: elements that never close, tags that never end, headers as servers send them."""

import gzip
import json
import time
import uuid
from html.parser import HTMLParser

import numpy as np
import pytest

from tessera.llm import extract, warc
from tessera.llm.markup import END, HELD, START, TEXT, attributes, tokens


def whole(source):
    page = extract.Page(source)
    return page.text(np.ones(len(page.tags), bool))


@pytest.mark.parametrize(("source", "want"), [
    ("<article><p>one</p><svg width=1 /><p>two</p></article>", "one two"),
    ("<article><p>one</p><svg width=1><path d='x'/><g><text>no</text></g></svg><p>two</p></article>", "one two"),
    ("<article><p>one</p><svg width=1><circle r=1><p>two</p></article><p>three</p>", "one two three"),
    ("<div><p>one</p><select><option>a<option>b</div><p>two</p>", "one two"),
    ("<div><p>one</p><noscript><p>no</div><p>two</p>", "one two"),
    ("<p>one<template><div>no</div></template> two</p>", "one two"),
    ("<p>one</p><textarea>no</textarea><p>two</p>", "one two"),
    ("<p>one</p><textarea><p>two</p>", "one two"),
    ("<p>one</p><iframe src=x /><p>two</p>", "one two"),
    ("<p>one</p><iframe src=x><p>two</p>", "one two"),
    ("<title>no<p>one</p>", "no one"),
    ("<p>one</p><script>if (a < b) '</p>'</SCRIPT ><p>two</p>", "one two"),
    ("<p>one</p><script/><p>two</p>", "one two"),
    ("<p>one</p><script>x = 1; <p>no</p>", "one"),
    ("<p>one</p><!-- <p>no</p> --><p>two<!-- no", "one two"),
    ("<p title='a>b' x=\"c>d\">one <a title=it's>two's</a>", "one two's"),
    ("<p>1 < 2 and 3 <4 </p>", "1 < 2 and 3 <4"),
    ("<p>a &lt;b&gt; &amp;amp; c", "a <b> &amp; c"),
    ("one <a href=\"x>two</a> three", "one two three"),
])
def test_elements_that_do_not_close(source, want):
    assert whole(source) == want


@pytest.mark.parametrize("part", ['<a "', "<a b='", '<a b="', "<a ", "<", "</", "<!--", "<!", "<textarea>", "<svg>", "<x>", "<p><b>", "<div></p>", "<select><option>", "a<b c='d' e>", "&amp;", "</div>", '<a b="\'>'])
def test_time_in_proportion(part):
    def took(n):
        began = time.process_time()
        whole(part * n + "x>")
        return time.process_time() - began

    took(100)
    assert min(took(40_000) for _ in range(2)) < 4


def test_attributes():
    assert attributes(" href='a>b' ID = x checked title=\"it's\" href=c /") == {"href": "a>b", "id": "x", "checked": "", "title": "it's"}
    assert [(k, n) for k, n, _ in tokens("a<B c><title>x</title></b>")] == [(TEXT, ""), (START, "b"), (START, "title"), (HELD, "title"), (END, "b")]


class Reader(HTMLParser):
    """The visible text by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.hidden, self.links, self.title, self.in_title = [], 0, [], None, False

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style", "noscript", "template")
        self.out.append("\n" * (tag in warc._BLOCKS))
        self.in_title = tag == "title"
        for k, v in attrs:
            if warc._TARGETS.get(tag) == k:
                self.links.append({"path": f"{tag}@/{k}", "url": (v or "").strip()})

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style", "noscript", "template")
        self.out.append("\n" * (tag in warc._BLOCKS))
        self.in_title = False

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)
        if self.in_title and self.title is None:
            self.title = " ".join(data.split())


def read(html):
    p = Reader()
    p.feed(html)
    p.close()
    return "\n".join(x for line in "".join(p.out).split("\n") if (x := " ".join(line.split()))), p.title, p.links


def test_op7_records_by_brute_force(spark, data):
    extra = [(-1, None, None), (-2, "u\r\nx: y", ""), (-3, "http://a/ü", "<title> A &amp;\n B </title><p title='x>y'>z<br>é&nbsp;q</p><script>no</script><a href='/l?a=1&amp;b=2'>l</a>"), (-3, "http://a/ü", "<p>rep"), (-4, "v", "word " * 200_000)]
    pages = spark.read.parquet(f"{data}/pages.parquet").select("page_id", "url", "html").union(spark.createDataFrame(extra, "page_id long, url string, html string"))
    source = [(r.page_id, r.url, r.html) for r in pages.collect()]
    got = sorted(warc.derivatives(pages).collect(), key=lambda r: (r.page_id, bytes(r.conversion)))
    assert len(got) == len(source)
    by = {}
    for page, url, html in source:
        by.setdefault(page, []).append((url, html))
    for r in got:
        cases = by[r.page_id]
        payloads = {warc.digest((h or "").encode()): (u, h or "") for u, h in cases}
        url, html = payloads[r.payload_digest]
        text, title, links = read(html)
        payload = html.encode()
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(len(payload)).encode() + b"\r\n\r\n" + payload
        head, _, rest = bytes(r.conversion).partition(b"\r\n\r\n")
        assert rest == text.encode() + b"\r\n\r\n" and r.text_bytes == len(text.encode()) and r.conversion_digest == warc.digest(text.encode())
        safe = url and url.replace("\r", "%0D").replace("\n", "%0A")
        lines = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        target = {} if url is None else {"WARC-Target-URI": safe}
        common = {"WARC-Date": warc.DATE, "WARC-Refers-To": r.response_id, "WARC-Payload-Digest": r.payload_digest} | target
        assert lines == common | {"WARC-Type": "conversion", "WARC-Record-ID": r.conversion_id, "WARC-Block-Digest": r.conversion_digest, "Content-Type": "text/plain", "Content-Length": str(r.text_bytes)}
        assert r.response_id == f"<urn:uuid:{uuid.uuid5(warc._SPACE, f'response {r.page_id} {url}')}>" and r.linked and len({r.response_id, r.metadata_id, r.conversion_id}) == 3
        head, _, rest = bytes(r.metadata).partition(b"\r\n\r\n")
        envelope = json.loads(rest)["Envelope"]
        source_headers = {"WARC-Type": "response", "WARC-Record-ID": r.response_id, "WARC-Date": warc.DATE, "WARC-Payload-Digest": r.payload_digest, "WARC-Block-Digest": warc.digest(block), "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))} | target
        assert envelope["WARC-Header-Metadata"] == source_headers and envelope["Block-Digest"] == warc.digest(block) and envelope["Actual-Content-Length"] == len(block)
        answer = envelope["Payload-Metadata"]["HTTP-Response-Metadata"]
        assert answer["Headers"] == {"Content-Type": "text/html; charset=utf-8", "Content-Length": str(len(payload))} and answer["Entity-Digest"] == r.payload_digest and answer["Entity-Length"] == len(payload)
        assert answer["HTML-Metadata"] == {"Head": {"Title": title}, "Links": links} and answer["Response-Message"] == {"Version": "HTTP/1.1", "Status": "200", "Reason": "OK"}
        assert r.response_bytes == envelope["WARC-Header-Length"] + len(block) + 4 and r.metadata_bytes == len(rest) - 4 and r.metadata_digest == warc.digest(rest[:-4])


def test_op7_files_as_servers_write_them(spark):
    page = "<p>caf\xe9</p>".encode("latin-1")
    chunked = b"6;x=y\r\n" + page[:6] + b"\r\n" + f"{len(page) - 6:X}".encode() + b"\r\n" + page[6:] + b"\r\n0\r\n\r\n"
    http = b"HTTP/1.1 200 OK\r\nContent-Type:text/html;charset=ISO-8859-1\r\nSet-Cookie: a=1\r\nset-cookie: b=2\r\nX-Long: one\r\n two\r\nTransfer-Encoding: chunked\r\nBad line\r\n\r\n" + chunked
    zipped = b"HTTP/1.1 200\nContent-Encoding: gzip\n\n" + gzip.compress(b"<meta charset=windows-1251><p>\xe6\xf3\xea")
    image = b"HTTP/1.1 200 OK\r\nContent-Type: image/png\r\n\r\n\x89PNG"
    plain = b"HTTP/1.1 200 OK\r\nContent-Type: text/plain\r\n\r\na < b\n<p>"
    one = lambda kind, name, block: f"WARC/1.0\r\nWARC-Type:{kind}\r\nWARC-Record-ID:<{name}>\r\nWARC-Date:2020-02-02T00:00:00Z\r\nX-Mine: 1\r\nX-Mine: 2\r\nContent-Length:{len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    records = [one("warcinfo", "i", b"software: x"), one("response", "a", http), one("request", "q", b"GET /"), one("response", "b", zipped), one("response", "c", image), one("response", "d", plain)]
    whole_file = b"".join(records)
    files = [("plain", whole_file), ("gz", b"".join(map(gzip.compress, records))), ("cut", whole_file[:-30]), ("none", b"no record"), ("empty", b""), ("null", None), ("badgz", gzip.compress(whole_file)[:-9])]
    rows = warc.file_derivatives(spark.createDataFrame(files, "path string, content binary")).collect()
    got = {p: [r for r in rows if r.path == p] for p, _ in files}
    for p in ("plain", "gz"):
        assert [r.response_id for r in got[p]] == ["<a>", "<b>", "<c>", "<d>"] and all(r.linked and r.error is None for r in got[p])
        texts = [next(warc.parse(bytes(r.conversion)))[1].decode() for r in got[p]]
        assert texts == ["caf\xe9", "жук", "", "a < b\n<p>"]
        meta = json.loads(next(warc.parse(bytes(got[p][0].metadata)))[1])["Envelope"]
        assert meta["WARC-Header-Metadata"]["X-Mine"] == ["1", "2"] and meta["WARC-Header-Metadata"]["WARC-Date"] == "2020-02-02T00:00:00Z"
        headers = meta["Payload-Metadata"]["HTTP-Response-Metadata"]["Headers"]
        assert headers["Set-Cookie"] == ["a=1", "b=2"] and headers["X-Long"] == "one two" and headers["Bad line"] == ""
        assert got[p][0].payload_digest == warc.digest(chunked)
    assert [r.response_id for r in got["cut"]] == ["<a>", "<b>", "<c>", None] and got["cut"][-1].error and got["none"][0].error and got["badgz"][-1].error and not got["empty"] and not got["null"]


def test_clashing_columns_of_pages(spark):
    pages = spark.createDataFrame([(1, "u", "<article><p>" + "some text here " * 30 + "</p></article>", "x", "y", 1)], "page_id long, url string, html string, response string, text string, n_chars int")
    assert extract.extract(pages).first().n_chars > 300 and warc.derivatives(pages).count() == 1
