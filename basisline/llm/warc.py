"""WARC derivatives: linked metadata and plain-text conversion records built from response records.

Each response yields a `metadata` record (application/warc-fields: HTTP status, source headers, payload digest, title and
outlinks) and a `conversion` record (the page as plain text). Both refer to the response by its record id and keep its
target URI, date and digests; their own ids and block digests follow from their contents, so a rerun gives equal records.

Edge cases: null urls leave the target URI out; null and empty pages give an empty text; repeated rows give equal records;
bodies of any length are kept whole; an empty table gives an empty result; extra columns are ignored. What archives get wrong
never stops a job: an unknown or unusable charset is read as UTF-8; a gzip or deflate body that is none is kept as it came,
one that is cut gives what was readable; any other content encoding (br, zstd) has an empty conversion; each of these is named
in the metadata field `payload-note`. A missing, negative or unreadable record length lasts up to the next record or the end,
and a gzip archive that is cut gives its readable records.

One row of `derive` is one archive and one task reads it whole (Spark's 2 GB limit of a value holds; crawls write files of
1 GB): archives of more than that have to be cut at record boundaries first.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basisline.llm.common import table
from basisline.llm.dom import read_page

VERSION = b"WARC/1.1"
SPACE = uuid.UUID("5f6c0f0e-8d0f-5b53-9b7e-0c3a5a1d2b11")
CHARSET = re.compile(r"charset\s*=\s*[\"']?([\w.:-]+)", re.I)


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(*parts: bytes) -> str:
    """A URN that depends on the contents alone."""
    return f"<urn:uuid:{uuid.uuid5(SPACE, hashlib.sha256(b'\0'.join(parts)).hexdigest())}>"


def write_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in headers), b"Content-Length: %d" % len(block)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def inflated(data: bytes, wbits: int = 31) -> tuple[bytes, str]:
    """All members of a gzip (or, by wbits, deflate) stream as far as they can be read, and "" or what was wrong."""
    out, note = [], ""
    while data:
        z = zlib.decompressobj(wbits)
        try:
            out += [z.decompress(data), z.flush()]
        except zlib.error:
            note = "damaged" if out else "not compressed as said"
            break
        if not z.eof:
            note = "cut"
        data = z.unused_data.lstrip(b"\0")
    return b"".join(out), note


def read_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case; continued lines joined) and block of each record; gzip members are unpacked."""
    if data[:2] == b"\x1f\x8b":
        data = readable(data)
    pos = 0
    while (pos := data.find(b"WARC/", pos)) >= 0:
        end = data.find(b"\r\n\r\n", pos)
        if end < 0:
            return
        headers: dict[str, str] = {}
        name = ""
        for line in data[pos:end].split(b"\r\n")[1:]:
            if line[:1] in (b" ", b"\t") and name:
                headers[name] += " " + line.strip().decode("utf-8", "replace")
            else:
                k, _, v = line.partition(b":")
                name = k.strip().lower().decode("utf-8", "replace")
                headers[name] = v.strip().decode("utf-8", "replace")
        size = headers.get("content-length", "")
        if size.isascii() and size.isdigit():
            stop = end + 4 + int(size)
        else:
            stop = data.find(b"\r\n\r\nWARC/", end + 2)
            stop = len(data) if stop < 0 else max(stop, end + 4)
        yield headers, data[end + 4 : stop]
        pos = stop


def readable(data: bytes) -> bytes:
    """A gzip archive's records as far as they can be read; every record is a member, so a damaged one costs no other."""
    out, note = inflated(data)
    while note == "damaged" or note == "not compressed as said":
        data = data[1:]
        nxt = data.find(b"\x1f\x8b\x08", 1) if data else -1
        if nxt < 0:
            break
        data = data[nxt:]
        more, note = inflated(data)
        out += more
    return out


def response_record(url: str | None, html: str | None, date: str, page: str) -> bytes:
    """A response record of a page, as a crawler would write it."""
    body = (html or "").encode("utf-8", "surrogatepass")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body) + body
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", record_id(b"response", page.encode(), (url or "").encode(), body)), ("WARC-Date", date)]
    headers += [("WARC-Target-URI", url)] if url else []
    headers += [("WARC-Payload-Digest", digest(body)), ("WARC-Block-Digest", digest(http)), ("Content-Type", "application/http; msgtype=response")]
    return write_record(headers, http)


def split_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes, str]:
    """Status line, headers, payload and "" or a note on it; chunked bodies are joined, gzip and deflate ones unpacked."""
    head, _, body = block.partition(b"\r\n\r\n")
    lines = head.decode("latin-1").split("\r\n")
    headers = [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines[1:]) if k]
    named = {k.lower(): v.lower() for k, v in headers}
    if named.get("transfer-encoding") == "chunked":
        body = joined_chunks(body)
    note = ""
    for coding in reversed([x.strip() for x in named.get("content-encoding", "").split(",")]):
        if coding in ("gzip", "x-gzip", "deflate") and body:
            wbits = 31 if coding != "deflate" else 15 if body[0] & 15 == 8 and int.from_bytes(body[:2]) % 31 == 0 else -15
            plain, note = inflated(body, wbits)
            body = plain if plain or not note else body
        elif coding not in ("", "identity", "gzip", "x-gzip", "deflate"):
            return lines[0], headers, body, f"content encoding {coding} not read"
    return lines[0], headers, body, f"body {note}" if note else ""


def joined_chunks(body: bytes) -> bytes:
    """The chunks of a chunked body up to its end or the first that has no length; a body without any is kept as it came."""
    parts, pos = [], 0
    while (end := body.find(b"\r\n", pos)) >= 0:
        size = body[pos:end].split(b";")[0].strip()
        if not size or any(c not in b"0123456789abcdefABCDEF" for c in size):
            break
        n = int(size, 16)
        if not n:
            return b"".join(parts)
        parts.append(body[end + 2 : end + 2 + n])
        pos = end + 4 + n
    return b"".join(parts) if parts else body


def decoded(body: bytes, content_type: str) -> tuple[str, str]:
    """The text of a body by the charset it names, UTF-8 where that can't be used, and a note if so."""
    found = CHARSET.search(content_type) or CHARSET.search(body[:2048].decode("latin-1"))
    try:
        info = codecs.lookup(found[1] if found else "utf-8")
        if info._is_text_encoding and info.name not in ("idna", "punycode", "undefined", "unicode_escape", "raw_unicode_escape"):
            return body.decode(info.name, "replace"), ""
    except (LookupError, UnicodeError, ValueError):
        pass
    return body.decode("utf-8", "replace"), f"charset {found[1]} not known" if found else ""


def derivatives(headers: dict[str, str], block: bytes) -> list[tuple[str, str, bytes, bytes]]:
    """(type, record id, block, whole record) of the metadata and the conversion record of a response."""
    status, http, body, note = split_http(block)
    named = {k.lower(): v for k, v in http}
    html, charset_note = ("", "") if note.endswith("not read") else decoded(body, named.get("content-type", ""))
    source = headers.get("warc-record-id", "")
    shared = [(k, headers[k.lower()]) for k in ("WARC-Target-URI", "WARC-Date", "WARC-Payload-Digest") if k.lower() in headers]
    lines, title, links = read_page(html)
    fields = [("http-status", status.partition(" ")[2].partition(" ")[0]), *((f"http-header-{k.lower()}", v) for k, v in http), ("payload-digest", digest(body)), ("payload-length", str(len(body)))]
    fields += [("source-block-digest", headers.get("warc-block-digest") or digest(block))]
    fields += [("payload-note", x) for x in (note, charset_note) if x]
    fields += [("title", " ".join(title.split()))] if title is not None else []
    fields += [("outlink", re.sub(r"[\t\r\n]", "", link)) for link in links]
    out = []
    blocks_of = (("metadata", "application/warc-fields", "".join(f"{k}: {v}\r\n" for k, v in fields)), ("conversion", "text/plain; charset=utf-8", "\n".join(lines)))
    ids = {kind: record_id(kind.encode(), source.encode(), text.encode("utf-8", "replace")) for kind, _, text in blocks_of}
    for kind, content, text in blocks_of:
        data = text.encode("utf-8", "replace")
        other = ids["conversion" if kind == "metadata" else "metadata"]
        lines = [("WARC-Type", kind), ("WARC-Record-ID", ids[kind]), ("WARC-Refers-To", source), ("WARC-Concurrent-To", other), *shared, ("WARC-Block-Digest", digest(data)), ("Content-Type", content)]
        out.append((kind, ids[kind], data, write_record(lines, data)))
    return out


COLUMNS = "warc_type string, record_id string, refers_to string, target_uri string, warc_date string, payload_digest string, source_block_digest string, block_digest string, content_length long, block string, record binary"


def _rows(headers: dict[str, str], block: bytes) -> Iterator[tuple]:
    for kind, rid, data, record in derivatives(headers, block):
        yield (
            kind, rid, headers.get("warc-record-id"), headers.get("warc-target-uri"), headers.get("warc-date"), headers.get("warc-payload-digest"),
            headers.get("warc-block-digest"), digest(data), len(data), data.decode("utf-8"), record,
        )


def derive(archives: DataFrame, key: str, data: str) -> DataFrame:
    """Derivative rows of every response record in the WARC bytes of column `data`; `key` goes along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                found = [(i, row) for i, x in enumerate(part.column(1)) for h, block in read_records(x.as_py() or b"") if h.get("warc-type") == "response" for row in _rows(h, block)]
                kinds = [pa.string()] * 8 + [pa.int64(), pa.string(), pa.binary()]
                cols = [pa.array([r[c] for _, r in found], kinds[c]) for c in range(11)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array([i for i, _ in found], pa.int64())), *cols], names=[key, *[c.split()[0] for c in COLUMNS.split(", ")]])

    kind = archives.schema[key].dataType.simpleString()
    return archives.select(F.col(key), F.col(data)).mapInArrow(run, f"{key} {kind}, {COLUMNS}")


def responses(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """page_id and the WARC bytes of each page's response record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                p = b.slice(lo, 256)
                made = [response_record(u.as_py(), h.as_py(), date, str(k.as_py())) for k, u, h in zip(*p.columns, strict=True)]
                yield pa.RecordBatch.from_arrays([p.column(0), pa.array(made, pa.binary())], names=["page_id", "warc"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, warc binary")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """WARC files (gzip or plain) as rows (path, content), for `derive`."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def op10_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(responses(table(spark, sf_dir, "pages")), "page_id", "warc").drop("record")
