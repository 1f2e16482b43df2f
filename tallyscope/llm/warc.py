"""Operator 8: build derived WARC records.

Every page becomes a response record; from it follow a metadata record (what was extracted: title,
outlinks, language) and a conversion record (plain text), both naming the response in WARC-Refers-To
and carrying its target URI, date and digests. Record ids are UUIDs made from the content, so a task
that runs again writes the same records. One Arrow pass over the pages, which are not shuffled.

Defined cases: null html is an empty body, null url gives no WARC-Target-URI; repeated rows give
records with ids of their own, made from their number among equals; pages of any length are read whole;
an empty table gives no records. Only page_id, url and html are read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html as html_lib
import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscope.llm.common import numbered, places_among_equals, written
from tallyscope.llm.html_crf import RAW, RAW_ENDS, TOKEN

SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space of RFC 4122
SCHEMA = "page_id long, record_type string, record_id string, refers_to string, target_uri string, headers map<string,string>, source_headers map<string,string>, block_digest string, payload_digest string, content_length long, content string"

#: Elements whose content is no text of the page.
DROPPED = frozenset("script style template noscript iframe".split())
BREAKS = frozenset("p div br li ul ol h1 h2 h3 h4 h5 h6 tr table section article header footer nav aside main blockquote pre form title head body html hr dl dt dd td th caption figure figcaption fieldset legend details summary address option select textarea center".split())
_HREF = re.compile(r"(?:^|[\s\"'/])href\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_LANG = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([\w-]+)", re.I)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def read_page(html: str) -> tuple[str, str | None, list[str]]:
    """Text of a page (one line per block, references decoded), its first title, and the targets of its links, in one pass."""
    texts: list[str] = []
    links: list[str] = []
    title: str | None = None
    dropped: str | None = None  # an element without an end tag of its own kind so far
    at = 0
    while m := TOKEN.search(html, at):
        if dropped is None:
            texts.append(html[at : m.start()])
        at = m.end()
        closing, tag, attributes = m[1], m[2], m[3]
        tag = (tag or "").lower()
        if closing and tag == dropped:
            dropped = None
        elif dropped is None and tag:
            if tag in BREAKS or tag in DROPPED:
                texts.append("\n")
            if tag == "a" and not closing and (href := _HREF.search(attributes)):
                links.append(html_lib.unescape(next(x for x in href.groups() if x is not None)))
            if not closing and tag in RAW:
                end = RAW_ENDS[tag].search(html, at)
                inside = html[at : end.start() if end else len(html)]
                if tag == "noscript" and not end:
                    inside = ""
                at += len(inside)
                if tag == "title" and title is None:
                    title = " ".join(html_lib.unescape(inside).split())
                if tag not in DROPPED:
                    texts += [inside, "\n"]
            elif not closing and tag == "template":
                dropped = tag
    if dropped is None:
        texts.append(html[at:])
    lines = (" ".join(line.split()) for line in html_lib.unescape("".join(texts).replace("\r", " ")).split("\n"))
    return "\n".join(line for line in lines if line), title, links


def plain_text(html: str) -> str:
    """Text of a page, one line per block, references decoded."""
    return read_page(html)[0]


def derive(page_id: int | None, url: str | None, html: str | None, date: str, place: int = 0) -> list[dict]:
    """The response record of a page and the two derived from it. place: the page's number among equal rows."""
    body = html or ""
    payload = body.encode()
    status = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = status.encode() + payload
    source = {"Content-Type": "text/html; charset=utf-8", "Content-Length": str(len(payload))}
    key = f"{page_id}|{url}|{hashlib.sha256(block).hexdigest()}" + f"|{place}" * bool(place)
    response_id = f"<urn:uuid:{uuid.uuid5(SPACE, 'response|' + key)}>"
    text, title, links = read_page(body)
    lang = _LANG.search(body)
    facts = {
        "title": title or "",
        "languages": lang[1] if lang else "",
        "outlinks": links,
        "source-payload-digest": digest(payload),
    }
    made = [
        ("response", response_id, None, "application/http; msgtype=response", status + body),
        ("metadata", f"<urn:uuid:{uuid.uuid5(SPACE, 'metadata|' + key)}>", response_id, "application/json", json.dumps(facts, ensure_ascii=False)),
        ("conversion", f"<urn:uuid:{uuid.uuid5(SPACE, 'conversion|' + key)}>", response_id, "text/plain; charset=utf-8", text),
    ]
    out = []
    for kind, record_id, refers, content_type, content in made:
        data = content.encode()
        headers = {"WARC-Type": kind, "WARC-Record-ID": record_id, "WARC-Date": date, "Content-Type": content_type, "Content-Length": str(len(data)), "WARC-Block-Digest": digest(data)}
        if url is not None:
            headers["WARC-Target-URI"] = url
        if refers:
            headers["WARC-Refers-To"] = refers
            headers["WARC-Source-Payload-Digest"] = facts["source-payload-digest"]
        else:
            headers["WARC-Payload-Digest"] = facts["source-payload-digest"]
        out.append({"page_id": page_id, "record_type": kind, "record_id": record_id, "refers_to": refers, "target_uri": url, "headers": headers, "source_headers": source, "block_digest": headers["WARC-Block-Digest"], "payload_digest": facts["source-payload-digest"], "content_length": len(data), "content": content})
    return out


def build_records(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Three records per page (see SCHEMA). Pages are read where they lie; only digests are compared, to tell repeated rows apart."""
    arrow = pa.schema(
        [("page_id", pa.int64())]
        + [(c, pa.string()) for c in ("record_type", "record_id", "refers_to", "target_uri")]
        + [(c, pa.map_(pa.string(), pa.string())) for c in ("headers", "source_headers")]
        + [("block_digest", pa.string()), ("payload_digest", pa.string()), ("content_length", pa.int64()), ("content", pa.string())]
    )
    rows = numbered(pages.select("page_id", "url", "html"))
    digests = written(rows.select("file", "row", F.xxhash64("kept.page_id", "kept.url", "kept.html").alias("digest")), "digests")
    repeated = written(digests.groupBy("digest").count().where("count > 1").select("digest"), "repeated")
    placed = places_among_equals(digests.join(repeated, "digest"), F.col("digest")).where("place > 0")
    read = rows.join(placed, ["file", "row"], "left").select("kept.page_id", "kept.url", "kept.html", F.coalesce("place", F.lit(0)).cast("long").alias("place"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256).to_pydict()
                made = [r for x in zip(part["page_id"], part["url"], part["html"], part["place"]) for r in derive(*x[:3], date, x[3])]
                for r in made:
                    r["headers"], r["source_headers"] = list(r["headers"].items()), list(r["source_headers"].items())
                yield pa.RecordBatch.from_pylist(made, schema=arrow)

    return read.mapInArrow(run, SCHEMA)


def record_bytes(headers: dict[str, str], content: str) -> bytes:
    """One record as a gzip member of a WARC/1.1 file."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers.items()) + "\r\n"
    return gzip.compress(head.encode() + content.encode() + b"\r\n\r\n", mtime=0)


def as_members(records: DataFrame) -> DataFrame:
    """page_id, record_id and `member`: the record as a gzip member. A .warc.gz file is any run of members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256).to_pydict()
                members = [record_bytes(dict(h), c) for h, c in zip(part["headers"], part["content"])]
                yield pa.RecordBatch.from_pydict({"page_id": pa.array(part["page_id"], pa.int64()), "record_id": pa.array(part["record_id"], pa.string()), "member": pa.array(members, pa.binary())})

    return records.select("page_id", "record_id", "headers", "content").mapInArrow(run, "page_id long, record_id string, member binary")
