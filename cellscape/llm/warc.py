"""WARC derivative builder (operator 8): responses to linked metadata and plain-text conversion records.

`responses` makes response records of crawled pages. `derivatives` gives each response two records: a `conversion` with the page's
text and a `metadata` record (application/warc-fields) with title, language, links, source headers and digests. Both carry
WARC-Refers-To, the target URI and date of their response; the metadata names the conversion in WARC-Concurrent-To. Digests are
SHA-1 in base 32. `serialised` gives a record's bytes (WARC/1.1), so the parts of a table are WARC files when written in order.
Identifiers are name-based (kind, page, address, payload), so a rerun makes the same records; only rows that share a page_id and
address are told apart by their place in the table too. A table of pages has no fetch times, so the date is a parameter.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellscape.llm.common import arrow_map
from cellscape.llm.textarrays import slices

DATE = "2024-01-01T00:00:00Z"
_OPEN = re.compile(r"<(?:!--|[!?]|(/?)([A-Za-z][A-Za-z0-9]*))")
_RAW = {n: re.compile(rf"</{n}\s*>", re.I) for n in ("script", "style", "noscript", "template")}
_BREAK = frozenset("p div h1 h2 h3 h4 h5 h6 li ul ol tr table section article nav header footer main aside blockquote pre body head title form br".split())
_LANG = re.compile(r"\blang\s*=\s*[\"']?([\w-]+)", re.I)
_HREF = re.compile(r"\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPACE = re.compile(r"[^\S\n]+")
_LINES = re.compile(r" ?\n[\s]*")
RECORD = T.StructType(
    [T.StructField("page_id", T.LongType())]
    + [T.StructField(n, T.StringType()) for n in ("record_type", "record_id", "refers_to", "concurrent_to", "target_uri", "date", "content_type", "source_headers", "block_digest", "source_payload_digest")]
    + [T.StructField("content_length", T.LongType()), T.StructField("block", T.BinaryType())]
)


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(kind: str, page_id: int | None, url: str | None, payload: str, nth: int = 0) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind} {page_id} {url} {payload}' + (f' {nth}' if nth else ''))}>"


def _unescaped(text: str) -> str:
    return html.unescape(text) if "&" in text else text


def parse(page: str) -> tuple[str, str, str, list[str]]:
    """Text, title, language and links of a page, in one pass over its tags.

    Comments, scripts and styles are dropped (to the end, if they aren't closed), block elements are on lines of their own, entities
    are resolved; a title that isn't closed is none.
    """
    out: list[str] = []
    title, lang, links, begun, at = None, "", [], None, 0
    while (tag := _OPEN.search(page, at)) is not None:
        out.append(page[at : tag.start()])
        comment = tag[0] == "<!--"
        end = page.find("-->" if comment else ">", tag.end())
        if end < 0:
            at = len(page)
            break
        at = end + (3 if comment else 1)
        name, closing = (tag[2] or "").lower(), tag[1] == "/"
        if comment:
            out.append(" ")
        elif name in _RAW and not closing:
            last = _RAW[name].search(page, at)
            at = last.end() if last else len(page)
            out.append(" ")
        elif name in _BREAK:
            out.append("\n")
            if name == "title" and title is None:
                if not closing:
                    begun = len(out) if begun is None else begun
                elif begun is not None:
                    title = "".join(out[begun:])
        elif name == "html" and not lang and not closing:
            found = _LANG.search(page, tag.end(), end)
            lang = found[1] if found else ""
        elif name == "a" and not closing:
            found = _HREF.search(page, tag.end(), end)
            links.append(_unescaped(next(filter(None, found.groups()), "")) if found else "")
    out.append(page[at:])
    text = _LINES.sub("\n", _SPACE.sub(" ", _unescaped("".join(out)))).strip()
    return text, " ".join(_unescaped(title or "").split()), lang, [x for x in links if x]


def plain_text(page: str) -> str:
    return parse(page)[0]


def fields(page: str) -> tuple[str, str, list[str]]:
    """Title, language and links, in order of the page."""
    return parse(page)[1:]


def _clean(value: str | None) -> str:
    """A header's value on one line."""
    return " ".join((value or "").split())


def response_headers(payload: bytes) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """One response record a row of pages (page_id, url, html); a null page is an empty payload, other columns are left aside.

    Rows of one page_id and address, exact repeats too, are records of their own. An empty table gives none.
    """
    again = pages.groupBy("page_id", "url").count().where("count > 1").select(F.col("page_id").alias("_id"), F.col("url").alias("_url"))
    pages = pages.select("page_id", "url", "html", F.lit(0).cast("long").alias("nth"))
    if again.head(1):
        rows = pages.withColumn("nth", F.monotonically_increasing_id() + 1)
        met = rows.join(again, F.col("page_id").eqNullSafe(F.col("_id")) & F.col("url").eqNullSafe(F.col("_url")), "left")
        pages = met.select("page_id", "url", "html", F.when(F.col("_id").isNotNull() | F.col("_url").isNotNull() | F.col("page_id").isNull() & F.col("url").isNull(), F.col("nth")).otherwise(0).alias("nth"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                rows = []
                for page_id, url, page, nth in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    payload = (page or "").encode()
                    head = response_headers(payload)
                    source = digest(payload)
                    rows.append((page_id, "response", record_id("response", page_id, url, source, nth), None, None, _clean(url), date, "application/http; msgtype=response", head.decode().strip(), digest(head + payload), source, len(head) + len(payload), head + payload))
                yield _batch(rows)

    return arrow_map(pages, run, RECORD)


_ARROW = pa.schema([("page_id", pa.int64()), *[(f.name, pa.string()) for f in RECORD.fields[1:11]], ("content_length", pa.int64()), ("block", pa.binary())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(_ARROW)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


def derivatives(records: DataFrame) -> DataFrame:
    """A conversion and a metadata record for each response among records; others are passed over.

    An empty payload gives an empty conversion; a response without header end is read as payload only; repeated responses give
    their derivatives each; an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "block"):
                rows = []
                for page_id, kind, rid, uri, date, headers, source, block in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if kind != "response":
                        continue
                    payload = (block or b"").partition(b"\r\n\r\n")
                    page = (payload[2] if payload[1] else payload[0]).decode("utf-8", "replace")
                    text, title, lang, links = parse(page)
                    text = text.encode()
                    text_id = record_id("conversion", page_id, uri, rid)
                    lines = [("title", title), ("language", lang), ("source-payload-digest", source), ("converted-digest", digest(text)), *[("source-header", h) for h in (headers or "").splitlines()], *[("outlink", x) for x in links]]
                    facts = "".join(f"{k}: {_clean(v)}\r\n" for k, v in lines if v).encode()
                    rows.append((page_id, "conversion", text_id, rid, None, uri, date, "text/plain; charset=utf-8", headers, digest(text), source, len(text), text))
                    rows.append((page_id, "metadata", record_id("metadata", page_id, uri, rid), rid, text_id, uri, date, "application/warc-fields", headers, digest(facts), source, len(facts), facts))
                yield _batch(rows)

    wanted = records.select("page_id", "record_type", "record_id", "target_uri", "date", "source_headers", "source_payload_digest", "block")
    return arrow_map(wanted, run, RECORD)


def serialised(records: DataFrame) -> DataFrame:
    """page_id, record_type, warc: each record's bytes, named headers first; a derivative's payload is its block, so that its payload digest
    is its own, and the source's header lines and payload digest have headers of their names. Null fields leave their headers out."""
    names = (("WARC-Type", "record_type"), ("WARC-Record-ID", "record_id"), ("WARC-Date", "date"), ("WARC-Target-URI", "target_uri"), ("WARC-Refers-To", "refers_to"), ("WARC-Concurrent-To", "concurrent_to"), ("WARC-Block-Digest", "block_digest"), ("WARC-Payload-Digest", "payload_digest"), ("Content-Type", "content_type"), ("Content-Length", "content_length"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "block"):
                values = {n: part.column(n).to_pylist() for n in part.schema.names} | {"payload_digest": []}
                out = []
                for k in range(part.num_rows):
                    derived = values["record_type"][k] != "response"
                    values["payload_digest"].append(values["block_digest" if derived else "source_payload_digest"][k])
                    head = "".join(f"{name}: {values[c][k]}\r\n" for name, c in names if values[c][k] is not None)
                    if derived:
                        source = values["source_payload_digest"][k]
                        head += f"WARC-Source-Payload-Digest: {source}\r\n" if source is not None else ""
                        head += "".join(f"WARC-Source-Header: {_clean(h)}\r\n" for h in (values["source_headers"][k] or "").splitlines())
                    out.append(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + (values["block"][k] or b"") + b"\r\n\r\n")
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("record_type"), pa.array(out, pa.binary())], names=["page_id", "record_type", "warc"])

    return arrow_map(records, run, "page_id long, record_type string, warc binary")
