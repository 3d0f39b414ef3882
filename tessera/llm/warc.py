"""WARC derivatives: from response records to linked metadata records and plain-text conversion records.

Files of records may be plain or of gzip members; other kinds of record are passed over. Header lines may lack the
space after their colon, may be folded and may repeat: a repeated header keeps all its values, in order. A chunked or
compressed body is undone for its text; what is not as it says stays as it is. The charset is the header's, else the
page's own, else UTF-8.

Record ids are UUIDs derived from the page's id, its url and the record's kind, so that a retried task writes the same
records. Metadata and conversion records refer to their response by its id, keep its target, its date and its payload's
digest, and carry a block digest of their own; the metadata holds all headers of the source, and the digests of its
block and payload. The conversion of a response that is no text is empty.

Null html gives an empty payload; a null url leaves the target out. Pages have no date, so theirs is a parameter.
Payloads may be of any length. Repeated rows give repeated records. Extra columns are ignored. A file that is cut off or is no
WARC file gives its records up to that place and a row with the error.
"""

from __future__ import annotations

import base64
import hashlib
import html as entities
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_arrow, table
from .markup import HELD, RAW, START, TEXT, attributes, tokens

DATE = "2024-01-01T00:00:00Z"
_SPACE = uuid.UUID("6f2b6a34-7b0f-5d0a-9f55-0d8a2f0c7a11")
_BLOCKS = frozenset("address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol option p pre section table tbody td tfoot th thead title tr ul".split())
_HIDDEN = RAW | {"noscript", "template"}
_TARGETS = {"a": "href", "area": "href", "link": "href", "img": "src", "script": "src", "iframe": "src", "form": "action"}
_CHARSET = re.compile(rb"<meta\b[^>]*\bcharset\s*=\s*[\"']?\s*([a-zA-Z0-9_:.-]+)", re.I)

Headers = list[tuple[str, str]]


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(kind: str, page: object, url: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{kind} {page} {url}')}>"


def record(headers: Headers, block: bytes) -> bytes:
    clean = lambda v: v.replace("\r", "%0D").replace("\n", "%0A")
    head = "".join(f"{k}: {clean(v)}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def fields(lines: list[str]) -> Headers:
    """Header lines as (name, value); a line that starts with white space goes on with the value before, one without a colon has no value."""
    out: Headers = []
    for line in lines:
        if line[:1] in " \t" and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}".strip())
        elif line:
            name, _, value = line.partition(":")
            out.append((name.strip(), value.strip()))
    return out


def first(headers: Headers, name: str) -> str | None:
    return next((v for k, v in headers if k.lower() == name.lower()), None)


def as_map(headers: Headers) -> dict[str, str | list[str]]:
    """Names to values; a name that repeats, in whatever case, to the list of its values."""
    out: dict[str, str | list[str]] = {}
    spelt: dict[str, str] = {}
    for k, v in headers:
        k = spelt.setdefault(k.lower(), k)
        out[k] = v if k not in out else [*(x if isinstance(x := out[k], list) else [x]), v]
    return out


def members(data: bytes) -> Iterator[bytes]:
    """The data, or each of its gzip members."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    while data:
        z = zlib.decompressobj(31)
        out = z.decompress(data)
        if not z.eof:
            raise ValueError("a gzip member is cut off")
        yield out
        data = z.unused_data


def parse(data: bytes) -> Iterator[tuple[Headers, bytes, int]]:
    """Headers, block and length of the header of each record, by the records' own lengths."""
    for part in members(data):
        at = 0
        while at < len(part):
            if part[at : at + 2] == b"\r\n":
                at += 2
                continue
            end = part.find(b"\r\n\r\n", at)
            lines = part[at : max(end, at)].decode("utf-8", "replace").split("\r\n")
            headers = fields(lines[1:])
            size = first(headers, "Content-Length") or ""
            if end < 0 or not lines[0].startswith("WARC/") or not size.isdecimal():
                raise ValueError(f"no record at byte {at}")
            block = part[end + 4 : end + 4 + int(size)]
            if len(block) < int(size):
                raise ValueError(f"the record at byte {at} is cut off")
            yield headers, block, end + 4 - at
            at = end + 4 + int(size)


def response(page: object, url: str | None, html: str | None, date: str = DATE) -> bytes:
    payload = (html or "").encode("utf-8", "replace")
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    target = [("WARC-Target-URI", url)] if url is not None else []
    return record([("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", page, url)), ("WARC-Date", date), *target, ("WARC-Payload-Digest", digest(payload)), ("WARC-Block-Digest", digest(block)), ("Content-Type", "application/http; msgtype=response")], block)


def http(block: bytes) -> tuple[str, Headers, bytes]:
    """Status line, headers and payload."""
    m = re.search(rb"\r?\n\r?\n", block)
    head, payload = (block[: m.start()], block[m.end() :]) if m else (block, b"")
    lines = re.split(r"\r?\n", head.decode("utf-8", "replace"))
    return lines[0], fields(lines[1:]), payload


def unchunked(payload: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = payload.find(b"\r\n", at)
        size = payload[at : max(end, at)].split(b";")[0].strip()
        if end < 0 or not re.fullmatch(rb"[0-9a-fA-F]+", size):
            return payload
        n = int(size, 16)
        if not n:
            return b"".join(out)
        out.append(payload[end + 2 : end + 2 + n])
        at = end + 4 + n


def body(headers: Headers, payload: bytes) -> bytes:
    """The payload without its transfer coding and its gzip or deflate content coding."""
    if "chunked" in (first(headers, "Transfer-Encoding") or "").lower():
        payload = unchunked(payload)
    coding = (first(headers, "Content-Encoding") or "").strip().lower()
    for bits in {"gzip": (31,), "x-gzip": (31,), "deflate": (15, -15)}.get(coding, ()):
        try:
            return zlib.decompressobj(bits).decompress(payload)
        except zlib.error:
            continue
    return payload


def text_of(headers: Headers, payload: bytes) -> str | None:
    """The body as text by its charset; None if the header's type is not text."""
    mime = (first(headers, "Content-Type") or "text/html").lower()
    if not re.match(r"\s*(text/|application/(xhtml\+)?xml)", mime):
        return None
    data = body(headers, payload)
    named = re.search(r"charset\s*=\s*[\"']?([a-z0-9_:.-]+)", mime)
    name = named[1] if named else m[1].decode() if (m := _CHARSET.search(data[:4096])) else "utf-8"
    try:
        return data.decode(name, "replace")
    except LookupError:
        return data.decode("utf-8", "replace")


def _folded(text: str) -> str:
    return " ".join(entities.unescape(text).split())


def read_page(html: str) -> tuple[str, str | None, list[dict[str, str]]]:
    """All visible text (a line for each block, white space folded, character references decoded), the title, and the links."""
    parts, title, links = [], None, []
    for kind, name, rest in tokens(html, _HIDDEN):
        if kind == TEXT:
            parts.append(rest)
        elif kind == HELD:
            if name == "title":
                title = _folded(rest) if title is None else title
                parts += ["\n", rest, "\n"]
            elif name in ("textarea", "xmp"):
                parts.append(rest)
        else:
            if name in _BLOCKS:
                parts.append("\n")
            if kind == START and name in _TARGETS and (to := attributes(rest).get(_TARGETS[name])) is not None:
                links.append({"path": f"{name}@/{_TARGETS[name]}", "url": entities.unescape(to).strip()})
    text = entities.unescape("".join(parts))
    return "\n".join(x for line in text.split("\n") if (x := " ".join(line.split()))), title, links


def plain_text(html: str) -> str:
    return read_page(html)[0]


def derived(headers: Headers, block: bytes, size: int) -> tuple[bytes, bytes]:
    """The metadata and the conversion record of a response record, given its headers, its block and the length of its header."""
    status, inner, payload = http(block)
    version, _, rest = status.partition(" ")
    html = text_of(inner, payload)
    is_plain = (first(inner, "Content-Type") or "").lower().strip().startswith("text/plain")
    text, title, links = ("", None, []) if html is None else (html, None, []) if is_plain else read_page(html)
    refers = first(headers, "WARC-Record-ID") or ""
    payload_digest = first(headers, "WARC-Payload-Digest") or digest(payload)
    kept = [(k, v) for k in ("WARC-Date", "WARC-Target-URI") if (v := first(headers, k)) is not None]
    envelope = {
        "Envelope": {
            "Format": "WARC",
            "WARC-Header-Length": size,
            "Actual-Content-Length": len(block),
            "WARC-Header-Metadata": as_map(headers),
            "Block-Digest": digest(block),
            "Payload-Metadata": {
                "HTTP-Response-Metadata": {
                    "Response-Message": {"Version": version, "Status": rest.partition(" ")[0], "Reason": rest.partition(" ")[2]},
                    "Headers": as_map(inner),
                    "Entity-Length": len(payload),
                    "Entity-Digest": digest(payload),
                    "HTML-Metadata": {"Head": {"Title": title}, "Links": links},
                }
            },
        }
    }
    own = lambda kind: f"<urn:uuid:{uuid.uuid5(_SPACE, f'{kind} {refers}')}>"
    meta = json.dumps(envelope, ensure_ascii=False, separators=(",", ":")).encode("utf-8", "replace")
    made = [("metadata", meta, "application/json"), ("conversion", text.encode("utf-8", "replace"), "text/plain")]
    out = [record([("WARC-Type", kind), ("WARC-Record-ID", own(kind)), *kept, ("WARC-Refers-To", refers), ("WARC-Payload-Digest", payload_digest), ("WARC-Block-Digest", digest(b)), ("Content-Type", mime)], b) for kind, b, mime in made]
    return out[0], out[1]


_COLUMNS = "response_id string, metadata_id string, conversion_id string, refers_to string, payload_digest string, metadata_digest string, conversion_digest string, linked boolean, response_bytes long, metadata_bytes long, text_bytes long, metadata binary, conversion binary"
_NAMES = [x.split()[0] for x in _COLUMNS.split(", ")]


def _row(headers: Headers, block: bytes, size: int) -> tuple:
    """What _COLUMNS hold, read back from the records that were written."""
    meta, text = derived(headers, block, size)
    ((m, mb, _),), ((c, cb, _),) = parse(meta), parse(text)
    source, get = first(headers, "WARC-Record-ID"), first
    same = get(m, "WARC-Refers-To") == get(c, "WARC-Refers-To") == source and all(get(m, k) == get(c, k) == get(headers, k) for k in ("WARC-Target-URI", "WARC-Date"))
    return (source, get(m, "WARC-Record-ID"), get(c, "WARC-Record-ID"), get(m, "WARC-Refers-To"), get(m, "WARC-Payload-Digest"), get(m, "WARC-Block-Digest"), get(c, "WARC-Block-Digest"), same, size + len(block) + 4, len(mb), len(cb), meta, text)


def _responses(batch: pa.RecordBatch) -> dict:
    ids, urls, html = (batch.column(i).to_pylist() for i in range(3))
    return {"page_id": batch.column(0), "url": batch.column(1), "response": [response(*x) for x in zip(ids, urls, html, strict=True)]}


def responses(pages: DataFrame) -> DataFrame:
    """page_id, url and the response record of each page."""
    return map_arrow(pages.select("page_id", "url", "html"), _responses, f"page_id {dict(pages.dtypes)['page_id']}, url string, response binary")


def _of_pages(date: str):
    def rows(batch: pa.RecordBatch) -> dict:
        ids, urls, html = (batch.column(i).to_pylist() for i in range(3))
        out = [_row(*next(parse(response(page, url, h, date)))) for page, url, h in zip(ids, urls, html, strict=True)]
        return {"page_id": batch.column(0), "url": batch.column(1)} | dict(zip(_NAMES, zip(*out, strict=True), strict=True))

    return rows


def derivatives(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Per page: the ids, digests and sizes of its records, and the metadata and conversion records themselves."""
    return map_arrow(pages.select("page_id", "url", "html"), _of_pages(date), f"page_id {dict(pages.dtypes)['page_id']}, url string, {_COLUMNS}")


def _of_files(batch: pa.RecordBatch) -> dict | None:
    out = []
    for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        try:
            for headers, block, size in parse(data or b""):
                if (first(headers, "WARC-Type") or "").lower() == "response":
                    out.append((path, None, *_row(headers, block, size)))
        except (ValueError, zlib.error) as e:
            out.append((path, str(e), *[None] * len(_NAMES)))
    return dict(zip(("path", "error", *_NAMES), zip(*out, strict=True), strict=True)) if out else None


def file_derivatives(files: DataFrame) -> DataFrame:
    """The same columns for each response record of files (path, content), such as Spark's binaryFile source reads, and the error of a file."""
    return map_arrow(files.select("path", "content"), _of_files, f"path string, error string, {_COLUMNS}")


def op7_warc(spark, sf_dir: str) -> DataFrame:
    return derivatives(table(spark, sf_dir, "pages")).drop("metadata", "conversion")
