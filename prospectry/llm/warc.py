"""WARC derivatives: metadata and plain-text conversion records from response records.

A response record holds a page as it came, with its HTTP header. From each one two records follow:
``metadata`` (JSON: the source's WARC and HTTP headers, digests, title and links) and ``conversion``
(its visible text), both of which refer to the response by ``WARC-Refers-To`` and carry a digest of
their own block. Ids are derived from the source's id, so reruns agree.
"""

from __future__ import annotations

import base64
import hashlib
import html
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DATE = "2024-01-01T00:00:00Z"
_END = b"\r\n\r\n"
_hidden = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|template|noscript)\b.*?(?:</\1\s*>|\Z)", re.I | re.S)
_breaks = re.compile(r"</?(?:address|article|aside|blockquote|br|dd|div|dl|dt|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul)\b[^>]*>", re.I)
_tags = re.compile(r"<[a-zA-Z/!?][^>]*>")
_gaps = re.compile(r"[ \t\r\f\v]+")
_lines = re.compile(r" ?\n[ \n]*")
_title = re.compile(r"<title\b[^>]*>(.*?)</title", re.I | re.S)
_links = re.compile(r"""<(a|area|link|img|script|iframe|source)\b[^>]*?\b(?:href|src)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(*parts: str) -> str:
    h = hashlib.md5("\n".join(parts).encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record's bytes: the headers, their block's digest and length, the block."""
    own = [*headers, ("WARC-Block-Digest", digest(block)), ("Content-Length", str(len(block)))]
    # a header's value is one line; what would break it is percent-encoded
    text = "".join(f"{k}: {re.sub(r'[\x00-\x1f\x7f]', lambda m: f'%{ord(m[0]):02X}', v)}\r\n" for k, v in own)
    return b"WARC/1.0\r\n" + text.encode() + b"\r\n" + block + _END


def parsed(raw: bytes) -> tuple[list[tuple[str, str]], bytes]:
    """Headers and block of a record."""
    head, _, rest = raw.partition(_END)
    headers = [tuple(x.split(": ", 1)) for x in head.decode("utf-8", "replace").split("\r\n")[1:] if ": " in x]
    return headers, rest[:int(dict(headers)["Content-Length"])]


def response(page_id: int | None, url: str | None, body: str | None) -> bytes:
    """A page of a table as the record of a response."""
    payload = (body or "").encode()
    block = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode() + payload
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", str(page_id), url or "", digest(payload))),
               ("WARC-Date", DATE), ("WARC-Target-URI", url or ""),
               ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", digest(payload))]
    return record([h for h in headers if h[1]], block)


def visible_text(page: str) -> str:
    """Text outside of markup, a line for each block."""
    text = _tags.sub("", _breaks.sub("\n", _hidden.sub(" ", page)))
    return _lines.sub("\n", _gaps.sub(" ", html.unescape(text))).strip()


def derived(raw: bytes) -> list[tuple[str, bytes]]:
    """The metadata and the conversion record of a response record."""
    headers, block = parsed(raw)
    source = dict(headers)
    head, _, payload = block.partition(_END)
    status, *fields = head.decode("utf-8", "replace").split("\r\n")
    http = dict(x.split(": ", 1) for x in fields if ": " in x)
    page = payload.decode("utf-8", "replace")
    title = _title.search(page)
    about = {
        "source": source, "http": {"status": status, "headers": http},
        "payload_digest": source.get("WARC-Payload-Digest"), "payload_length": len(payload),
        "title": html.unescape(title[1]).strip() if title else None,
        "links": [{"tag": t.lower(), "url": html.unescape(a or b or c)} for t, a, b, c in _links.findall(page)],
    }
    refers = source["WARC-Record-ID"]

    def made(kind: str, content_type: str, body: bytes) -> tuple[str, bytes]:
        own = [("WARC-Type", kind), ("WARC-Record-ID", record_id(kind, refers)), ("WARC-Date", source.get("WARC-Date", DATE)),
               ("WARC-Target-URI", source.get("WARC-Target-URI", "")), ("WARC-Refers-To", refers), ("Content-Type", content_type)]
        return kind, record([h for h in own if h[1]], body)

    return [made("metadata", "application/json", json.dumps(about, ensure_ascii=False).encode()),
            made("conversion", "text/plain; charset=utf-8", visible_text(page).encode())]


def responses(pages: DataFrame) -> DataFrame:
    """``page_id, record`` (bytes of a response record) of ``page_id, url, html`` rows. Null urls and
    bodies count as empty; an empty url has no header."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [response(p.as_py(), u.as_py(), h.as_py()) for p, u, h in zip(batch["page_id"], batch["url"], batch["html"], strict=True)]
            yield pa.record_batch([batch["page_id"], pa.array(made, pa.binary())], names=["page_id", "record"])

    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html").mapInArrow(
        run, "page_id bigint, record binary")


def derivatives(records: DataFrame) -> DataFrame:
    """Two rows for each row of ``records`` (``page_id, record``): ``page_id, record_type, record_id,
    refers_to, target_uri, source_digest, block_digest, content_length, record`` (as text).

    Markup that never closes hides what follows it; a page without text has an empty conversion.
    Repeated rows are derived alike; null records give nothing; other columns are not used.
    """
    names = ["page_id", "record_type", "record_id", "refers_to", "target_uri", "source_digest", "block_digest",
             "content_length", "record"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for page, raw in zip(batch["page_id"].to_pylist(), batch["record"], strict=True):
                source = dict(parsed(raw.as_py())[0])
                for kind, made in derived(raw.as_py()):
                    own = dict(parsed(made)[0])
                    rows.append((page, kind, own["WARC-Record-ID"], own["WARC-Refers-To"], own.get("WARC-Target-URI"),
                                 source.get("WARC-Payload-Digest"), own["WARC-Block-Digest"], int(own["Content-Length"]), made.decode()))
            kinds = [pa.int64(), *[pa.string()] * 6, pa.int64(), pa.string()]
            yield pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    return records.filter(F.col("record").isNotNull()).select("page_id", "record").mapInArrow(
        run, "page_id bigint, record_type string, record_id string, refers_to string, target_uri string,"
             " source_digest string, block_digest string, content_length bigint, record string")
