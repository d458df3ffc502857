"""Operator 6: WARC derivatives.

Each response record becomes a conversion record (its plain text) and a metadata record (title,
language, links), linked to it and to each other: both refer to the response by WARC-Refers-To with
its target, date and payload digest, and the metadata record names the conversion record in
WARC-Concurrent-To. Chosen headers of the source go over as ``WARC-Source-...`` fields, block and
payload digests are SHA-1 in base 32, and ids are name-based UUIDs of the source's id, so a rerun
after a lost executor writes the same records.

:func:`responses` makes response records of a table of crawled pages, :func:`derive` takes any table
of response records, and :func:`serialised` writes records as WARC/1.1 bytes.

One scan, no shuffle; a task holds one page at a time. A null html is an empty body and a null url an empty
target; an unclosed comment or script runs to the end of the page; rows that repeat a page give
records with the same ids; an empty table gives no records.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table

NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the URL namespace of RFC 4122
SOURCE_HEADERS = ("content-type", "content-language", "last-modified", "etag", "server")
RECORDS = """page_id long, warc_type string, record_id string, refers_to string, concurrent_to string, target_uri string,
  warc_date string, content_type string, payload_digest string, source_digest string, block_digest string,
  headers map<string,string>, block binary, n_links int"""

_DROPPED = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b.*?(?:</\1\s*>|\Z)", re.I | re.S)
_BREAK = re.compile(r"</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|footer|form|h[1-6]|head|header|hr|html|li|main|"
                    r"nav|ol|option|p|pre|section|table|td|th|title|tr|ul)\b[^<>]*>", re.I)
_TAG = re.compile(r"<[/!?a-zA-Z][^<>]*>")
_TITLE = re.compile(r"<title\b[^<>]*>(.*?)(?:</title\s*>|\Z)", re.I | re.S)
_LANG = re.compile(r"<html\b[^<>]*?\blang\s*=\s*[\"']?([A-Za-z0-9-]+)", re.I)
_HREF = re.compile(r"<a\b[^<>]*?\bhref\s*=\s*(?:\"([^\"<>]*)\"|'([^'<>]*)'|([^\s\"'<>]+))", re.I)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def plain_text(markup: str) -> str:
    text = html.unescape(_TAG.sub("", _BREAK.sub("\n", _DROPPED.sub(" ", markup))))
    lines = (" ".join(line.split()) for line in text.split("\n"))
    return "".join(line + "\n" for line in lines if line)


def page_facts(markup: str, url: str) -> tuple[str, str, list[str]]:
    """Title, language and links (absolute, in order, each once)."""
    shown = _DROPPED.sub(" ", markup)
    title, lang = _TITLE.search(shown), _LANG.search(shown)
    links: dict[str, None] = {}
    for m in _HREF.finditer(shown):
        target = html.unescape(next(g for g in m.groups() if g is not None)).strip()
        try:
            links[urljoin(url, target)] = None
        except ValueError:  # not a valid reference: kept as it stands
            links[target] = None
    one_line = " ".join(html.unescape(_TAG.sub("", title[1])).split()) if title else ""
    return one_line, lang[1].lower() if lang else "", [link for link in links if link and not re.search(r"[\r\n]", link)]


def name_id(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, name)}>"


def responses(pages: DataFrame, captured_at: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response records of a table page_id, url, html: record_id, target_uri, warc_date, http_headers, body."""
    body = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    headers = F.create_map(F.lit("content-type"), F.lit("text/html; charset=utf-8"),
                           F.lit("content-length"), F.octet_length(body).cast("string"))
    uri = F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("")), r"[\r\n]+", "")
    name = F.sha2(F.concat_ws(" ", F.col("page_id").cast("string"), uri, F.sha2(body, 256)), 256)
    hexes = [F.substring(name, start, n) for start, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *hexes), F.lit(">")).alias("record_id"),
                        uri.alias("target_uri"), F.lit(captured_at).alias("warc_date"), headers.alias("http_headers"), body.alias("body"))


def _derived(page_id, source_id: str, uri: str, date: str, http: dict[str, str], body: bytes) -> list[dict]:
    markup = body.decode("utf-8", "replace")
    title, lang, links = page_facts(markup, uri)
    text = plain_text(markup).encode()
    source_digest = digest(body)
    ids = {kind: name_id(f"{source_id} {kind}") for kind in ("conversion", "metadata")}
    kept = {f"WARC-Source-{k.title()}": re.sub(r"[\r\n]+", " ", v) for k, v in sorted(http.items()) if k.lower() in SOURCE_HEADERS and v is not None}
    fields = [("title", title), ("language", lang), ("text-digest", digest(text)), ("text-length", str(len(text)))]
    meta = "".join(f"{k}: {v}\r\n" for k, v in [*fields, *(("outlink", link) for link in links)]).encode()
    out = []
    for kind, block, content in (("conversion", text, "text/plain; charset=utf-8"), ("metadata", meta, "application/warc-fields")):
        other = ids["conversion"] if kind == "metadata" else None
        headers = {"WARC-Type": kind, "WARC-Record-ID": ids[kind], "WARC-Date": date, "WARC-Target-URI": uri, "WARC-Refers-To": source_id,
                   "WARC-Refers-To-Target-URI": uri, "WARC-Refers-To-Date": date, "WARC-Source-Payload-Digest": source_digest,
                   "WARC-Block-Digest": digest(block), "Content-Type": content, "Content-Length": str(len(block))} | kept
        if other:
            headers["WARC-Concurrent-To"] = other
        out.append({"page_id": page_id, "warc_type": kind, "record_id": ids[kind], "refers_to": source_id, "concurrent_to": other,
                    "target_uri": uri, "warc_date": date, "content_type": content, "payload_digest": digest(block),
                    "source_digest": source_digest, "block_digest": digest(block), "headers": list(headers.items()), "block": block,
                    "n_links": len(links)})
    return out


def derive(records: DataFrame) -> DataFrame:
    """Two rows per response record: its conversion and its metadata record."""
    schema = pa.schema([("page_id", pa.int64()), *((n, pa.string()) for n in (
        "warc_type", "record_id", "refers_to", "concurrent_to", "target_uri", "warc_date", "content_type", "payload_digest",
        "source_digest", "block_digest")), ("headers", pa.map_(pa.string(), pa.string())), ("block", pa.binary()), ("n_links", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows: list[dict] = []
                for r in batch.slice(at, 256).to_pylist():
                    rows += _derived(r["page_id"], r["record_id"] or "", r["target_uri"] or "", r["warc_date"] or "",
                                     dict(r["http_headers"] or ()), r["body"] or b"")
                yield pa.RecordBatch.from_pylist(rows, schema)

    return records.select("page_id", "record_id", "target_uri", "warc_date", "http_headers", "body").mapInArrow(run, RECORDS)


def serialised(records: DataFrame) -> DataFrame:
    """page_id, record_id and ``record``: the bytes of each record; files are their concatenation."""
    lines = F.transform(F.map_entries("headers"), lambda h: F.concat(h["key"], F.lit(": "), h["value"], F.lit("\r\n")))
    head = F.encode(F.concat(F.lit("WARC/1.1\r\n"), F.array_join(lines, ""), F.lit("\r\n")), "UTF-8")
    return records.select("page_id", "record_id", F.concat(head, F.col("block"), F.encode(F.lit("\r\n\r\n"), "UTF-8")).alias("record"))


def op6_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = derive(responses(read_table(spark, sf_dir, "pages")))
    return out.select("page_id", "warc_type", "record_id", "refers_to", "concurrent_to", "target_uri", "source_digest", "block_digest",
                      F.octet_length("block").cast("bigint").alias("content_length"), "n_links", F.sha2("block", 256).alias("block_sha256"))
