"""WARC derivatives: response records become linked metadata and conversion records.

``responses`` gives archived pages their response record. ``derive`` turns each
response into itself, a ``metadata`` record (links and counts as JSON) and a
``conversion`` record (plain text); both name the response in WARC-Refers-To and
carry its target URI, date and payload digest. ``serialise`` writes WARC/1.1 bytes
and ``parse`` reads them.

Defined results: a null html is an empty payload; a null url gives an empty target
URI; rows that repeat an id give records with the same record id; a null id gives
the id of the empty name; a tag, comment, script or style that never ends holds the rest
of the page, which is dropped, and a title that never ends is ordinary text; pages of any
length take time linear in it, whatever their mark-up; extra columns are not read; an empty table gives no rows. Rows are independent, so a hot host
costs nothing extra.
"""

from __future__ import annotations

import base64
import hashlib
import html as html_
import json
import re
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ints, thrifty, utf8, workers_find_us

RECORD = (
    "page_id long, warc_type string, record_id string, refers_to string, target_uri string, warc_date string, "
    "content_type string, source_headers string, payload_digest string, refers_to_payload_digest string, block_digest string, content_length long, content binary"
)
_FIELDS = [x.split()[0] for x in RECORD.split(", ")]
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # RFC 9562, namespace for URLs

#: Elements that are no text, and elements that end a line.
_DROPPED = "script style noscript template svg".split()
_BLOCKS = frozenset("p div br li ul ol h1 h2 h3 h4 h5 h6 tr table article section nav header footer main aside title body head html blockquote pre hr".split())
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
#: Where a tag may end, or a quoted value begins.
_STOP = re.compile(r""">|=\s*["']""")
_CLOSE = {name: re.compile(rf"</{name}(?=[\s/>])", re.I | re.A) for name in [*_DROPPED, "title"]}
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*)))?""")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, chr(0).join(map(str, parts)))}>"


def _tag_end(html: str, at: int) -> int:
    """Behind the > of the tag that begins at ``at``; quoted values may hold one. -1 if the tag never ends."""
    while m := _STOP.search(html, at):
        if m[0] == ">":
            return m.end()
        close = html.find(m[0][-1], m.end())
        if close < 0:
            return -1
        at = close + 1
    return -1


def scan(html: str) -> Iterator[tuple[str, str]]:
    """(kind, what) of the page's pieces in order: text, title, open and close tags (as written), and gaps where something was dropped.

    The place only moves forward, and what was looked for in vain isn't looked for again,
    so time is linear in the page.
    """
    at, missing = 0, False
    while (start := html.find("<", at)) >= 0:
        if html.startswith("<!--", start):
            kind, end = "gap", html.find("-->", start + 4)
            end = end + 3 if end >= 0 else -1
        elif html.startswith(("<!", "<?"), start):
            kind, end = "gap", html.find(">", start) + 1 or -1
        elif name := _NAME.match(html, start):
            kind, end = "close" if html[start + 1] == "/" else "open", _tag_end(html, name.end())
        else:  # a sign, not a tag
            yield "text", html[at : start + 1]
            at = start + 1
            continue
        yield "text", html[at:start]
        if end < 0:
            yield "gap", html[start:]
            return
        at = end
        if kind == "open" and (own := name[1].lower()) in _CLOSE and not (own == "title" and missing):
            close = _CLOSE[own].search(html, end)
            if own == "title":
                missing = close is None
                yield kind, html[start:end]
                if close:
                    yield "title", html[end : close.start()]
                    at = close.start()
                continue
            yield "gap", html[start : close.start() if close else len(html)]
            if close is None:
                return
            at = _tag_end(html, close.end())
            if at < 0:
                return
        else:
            yield kind, html[start:end]
    yield "text", html[at:]


def plain_text(pieces: Iterable[tuple[str, str]]) -> str:
    """Text without markup, of a scanned page: block elements end lines, blank lines go, spaces are joined."""
    out = []
    for kind, what in pieces:
        if kind in ("open", "close"):
            out.append("\n" if _NAME.match(what)[1].lower() in _BLOCKS else "")
        else:
            out.append(" " if kind == "gap" else what)
    lines = (" ".join(x.split()) for x in html_.unescape("".join(out)).split("\n"))
    return "\n".join(x for x in lines if x)


def outline(pieces: Iterable[tuple[str, str]]) -> dict:
    """The first title, and the target of each a, img and link tag that has one, of a scanned page."""
    title, links = None, []
    for kind, what in pieces:
        if kind == "title" and title is None:
            title = " ".join(html_.unescape(what).split())
        if kind == "open":
            name = _NAME.match(what)
            if (own := name[1].lower()) in ("a", "img", "link"):
                url = next((m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(what, name.end(), len(what) - 1) if m[1].lower() in ("href", "src") and m[0] != m[1]), None)
                if url is not None:
                    links.append({"path": own, "url": html_.unescape(url)})
    return {"title": title or "", "links": links}


def _records(page_id, url: str, raw: bytes, date: str) -> Iterator[tuple]:
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(raw)}\r\n\r\n"
    block, payload = head.encode() + raw, digest(raw)
    rid = record_id("response", "" if page_id is None else page_id, url)
    source = head.split("\r\n\r\n")[0]
    yield page_id, "response", rid, None, url, date, "application/http; msgtype=response", source, payload, None, digest(block), len(block), block
    pieces = list(scan(raw.decode()))
    about = outline(pieces) | {"source-headers": source, "payload-digest": payload, "payload-length": len(raw)}
    meta = json.dumps(about, ensure_ascii=False, sort_keys=True).encode()
    text = plain_text(pieces).encode()
    for kind, mime, data in (("metadata", "application/json", meta), ("conversion", "text/plain; charset=utf-8", text)):
        yield page_id, kind, record_id(kind, rid), rid, url, date, mime, source, digest(data), payload, digest(data), len(data), data


def derive(pages: DataFrame, warc_date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """The response, metadata and conversion record of each page."""
    workers_find_us(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, pa.int64() if n in ("page_id", "content_length") else pa.binary() if n == "content" else pa.string()) for n in _FIELDS])
        for b in batches:
            keys, urls, raws = ints(b, "page_id"), ints(b, "url"), utf8(b, "html")
            for lo in range(0, len(keys), 256):
                rows = [r for k, u, h in zip(keys[lo : lo + 256], urls[lo : lo + 256], raws[lo : lo + 256]) for r in _records(k, u or "", h, warc_date)]
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return pages.select("page_id", "url", "html").mapInArrow(thrifty(run), RECORD)


def serialise(row: dict) -> bytes:
    """One WARC/1.1 record. A derived record names its response's target, date, payload digest and header lines."""
    named = [
        ("WARC-Type", row["warc_type"]), ("WARC-Record-ID", row["record_id"]), ("WARC-Date", row["warc_date"]),
        ("WARC-Target-URI", row["target_uri"]), ("WARC-Refers-To", row["refers_to"]),
        ("WARC-Block-Digest", row["block_digest"]), ("WARC-Payload-Digest", row["payload_digest"]),
        ("Content-Type", row["content_type"]), ("Content-Length", str(row["content_length"])),
    ]
    if row["refers_to"] is not None:
        named += [("WARC-Refers-To-Target-URI", row["target_uri"]), ("WARC-Refers-To-Date", row["warc_date"]), ("WARC-Refers-To-Payload-Digest", row["refers_to_payload_digest"])]
        named += [("WARC-Source-Header", line) for line in row["source_headers"].split("\r\n")]
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in named if v is not None), "\r\n"]).encode() + row["content"] + b"\r\n\r\n"


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header and block of each record; lines of a repeated header come joined by line ends."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("no WARC record here")
        head: dict[str, str] = {}
        for k, v in (x.split(": ", 1) for x in lines[1:]):
            head[k] = f"{head[k]}\r\n{v}" if k in head else v
        n = int(head["Content-Length"])
        yield head, data[end + 4 : end + 4 + n]
        at = end + 4 + n + 4


def write_files(records: DataFrame, path: str) -> None:
    """Record-wise gzip WARC blocks as rows of a binary table: one row is one appendable member."""
    workers_find_us(records.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gzip

        for b in batches:
            members = [gzip.compress(serialise(r), mtime=0) for r in b.to_pylist()]
            yield pa.record_batch([b.column(b.schema.get_field_index("record_id")), pa.array(members, pa.binary())], ["record_id", "member"])

    records.mapInArrow(thrifty(run), "record_id string, member binary").write.parquet(path)
