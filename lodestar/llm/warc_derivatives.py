"""WARC derivatives: metadata and plain-text conversion records made from response records.

Each response gives a metadata record (what the page says of itself, its links, and the source's headers and digests)
and, where its payload is text, a conversion record of the plain text. Both name the response they come from in
``WARC-Refers-To`` and each other in their fields, and carry digests of their own. Records are rows; they can be written
as WARC files, one gzip member a record, and such files can be read back, responses included; a reader streams through
a file, so that files of any size fit, and gives what it cannot read as errors.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html as html_lib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import urljoin

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import cut, map_rows, open_shared, write_shared

RESPONSE = "source_id long, record_id string, target_uri string, date string, http_header string, payload binary"
#: A block that is larger is passed over by the reader, as an error.
MOST_BYTES = 1 << 28
#: The most that a value of a table can have.
MOST_CELL = (1 << 31) - 1
RECORD = "source_id long, record_type string, record_id string, refers_to string, target_uri string, date string, content_type string, block_digest string, payload_digest string, content_length long, block binary"
#: Elements that start a new line of the text, and elements whose content is no text.
BREAKS = frozenset("address article aside blockquote body br caption dd div dl dt figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol option p pre section table tbody td tfoot th thead title tr ul".split())
HIDDEN = ("script", "style", "noscript", "template", "textarea", "svg")
MARKUP = re.compile(rf"<!--.*?(?:-->|\Z)|<({'|'.join(HIDDEN)})\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>|</?([a-zA-Z][a-zA-Z0-9]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S | re.I)
TITLE = re.compile(r"<title\b[^>]*>(.*?)</title\s*>", re.S | re.I)
LANG = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([\w-]+)", re.I)
HREF = re.compile(r"<a\b[^>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.S | re.I)
CHARSET = re.compile(r"charset\s*=\s*[\"']?([\w.:-]+)", re.I)
SPACES = re.compile(r"[ \t\r\f\v ]+")


def digest(data: bytes) -> str:
    """``sha1:`` and the digest in base 32, as WARC files write it."""
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def named_id(*parts: str) -> str:
    """A record id that is the same in every run: a version-5 UUID of the parts."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(0).join(parts))}>"


def one_word(uri: str) -> str:
    """A uri with white space and control characters in percent encoding: no header line could hold it as it is."""
    return re.sub(r"[\s\x00-\x1f\x7f]", lambda found: "".join(f"%{b:02X}" for b in found.group().encode()), uri)


def visible_text(page: str) -> str:
    """The page's text: one line for each block, markup, scripts and comments left out, entities resolved."""

    def put(found: re.Match) -> str:
        name = found.group(2)
        return "\n" if name and name.lower() in BREAKS else "" if name else " " if found.group(1) else ""

    lines = (SPACES.sub(" ", x).strip() for x in html_lib.unescape(MARKUP.sub(put, page)).split("\n"))
    return "\n".join(x for x in lines if x)


def outlinks(page: str, base: str) -> list[str]:
    """Targets of the page's links, made absolute, each once, in order."""
    found: dict[str, None] = {}
    for groups in HREF.findall(MARKUP.sub(lambda m: m.group() if m.group(2) else "", page)):
        target = html_lib.unescape("".join(groups)).strip()
        if target and not target.startswith(("#", "javascript:", "mailto:", "data:")):
            try:
                found[urljoin(base, target)] = None
            except ValueError:
                found[target] = None
    return list(found)


def header_fields(header: str | None) -> tuple[str, list[tuple[str, str]]]:
    """``(status line, fields)`` of an HTTP header."""
    lines = [x for x in re.split(r"\r?\n", header or "") if x.strip()]
    fields = [(k.strip(), v.strip()) for k, sep, v in (x.partition(":") for x in lines[1:]) if sep]
    return lines[0] if lines else "", fields


def unchunked(body: bytes) -> bytes:
    """A body without the framing of ``Transfer-Encoding: chunked``; a body that is not so framed stays as it is."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = body[at:end].split(b";")[0].strip() if end >= 0 else b""
        try:
            n = int(size, 16)
        except ValueError:
            return body
        if n == 0:
            return b"".join(out)
        if n < 0 or end + 2 + n > len(body):
            return body
        out.append(body[end + 2 : end + 2 + n])
        at = end + 2 + n + 2


def decoded(fields: list[tuple[str, str]], body: bytes) -> bytes | None:
    """The content of a response's body: transfer and content encodings taken off; null for one that is unknown or broken.

    Crawlers often store bodies that they have already decoded under the header that came with them; those stay as they
    are.
    """
    of = lambda name: [x.strip().lower() for k, v in fields if k.lower() == name for x in v.split(",") if x.strip()]
    if "chunked" in of("transfer-encoding"):
        body = unchunked(body)
    for coding in reversed(of("content-encoding")):
        try:
            if coding in ("gzip", "x-gzip"):
                body = zlib.decompressobj(31).decompress(body) if body[:2] == b"\x1f\x8b" else body
            elif coding == "deflate":
                try:
                    body = zlib.decompressobj().decompress(body)
                except zlib.error:
                    body = zlib.decompressobj(-15).decompress(body)
            elif coding == "zstd":
                body = zstandard.ZstdDecompressor().decompressobj().decompress(body) if body[:4] == b"\x28\xb5\x2f\xfd" else body
            elif coding != "identity":
                return None
        except (zlib.error, zstandard.ZstdError):
            return None
    return body


def derive_one(record_id: str | None, uri: str | None, date: str | None, header: str | None, payload: bytes | None) -> list[tuple]:
    """The records of one response as tuples of ``RECORD`` without ``source_id``."""
    payload = bytes(payload or b"")
    uri = None if uri is None else one_word(uri)
    status, fields = header_fields(header)
    content_type = next((v for k, v in fields if k.lower() == "content-type"), "")
    kind = content_type.split(";")[0].strip().lower()
    is_html = kind in ("text/html", "application/xhtml+xml") or not kind
    source = record_id or named_id(uri or "", date or "", digest(payload))
    ids = {x: named_id(source, x) for x in ("metadata", "conversion")}
    is_text = is_html or kind.startswith("text/")
    content = decoded(fields, payload) if is_text else b""
    is_text, is_html = is_text and content is not None, is_html and content is not None
    found = CHARSET.search(content_type)
    try:
        page = content.decode(found.group(1) if found else "utf-8", "replace") if is_text else ""
    except LookupError:
        page = content.decode("utf-8", "replace")
    out = []
    about = [("source-record", source), ("source-payload-digest", digest(payload)), ("source-payload-length", str(len(payload)))]
    about += [("source-http-status", status)] if status else []
    about += [(f"source-http-{k.lower()}", v) for k, v in fields]
    if is_html:
        if title := TITLE.search(page):
            about.append(("title", " ".join(html_lib.unescape(re.sub(r"<[^>]*>", "", title.group(1))).split())))
        if lang := LANG.search(page):
            about.append(("language", lang.group(1)))
        about += [("outlink", x) for x in outlinks(page, uri or "")]
    if is_text:
        about.append(("conversion", ids["conversion"]))
    block = "".join(f"{k}: {' '.join(v.splitlines())}\r\n" for k, v in about).encode()
    out.append(("metadata", ids["metadata"], source, uri, date, "application/warc-fields", digest(block), digest(payload), len(block), block))
    if is_text:
        block = (visible_text(page) if is_html else page).encode()
        out.append(("conversion", ids["conversion"], source, uri, date, "text/plain; charset=utf-8", digest(block), digest(payload), len(block), block))
    return out


NAMES = [x.split()[0] for x in RECORD.split(", ")]


def derive(responses: DataFrame) -> DataFrame:
    """Rows of ``RECORD`` from rows of ``RESPONSE``: one metadata record each, and one conversion record for text.

    ``refers_to`` is the response's id; ``payload_digest`` is the digest of the response's payload, ``block_digest`` of
    the record's own block. A response without an id is named after its uri, date and payload. A null or empty payload
    gives an empty text; without a content type it is taken for HTML; other than text, and text in an unknown or broken
    content encoding, gives metadata only. Null uris and dates stay null; white space in a uri becomes percent encoded. Rows alike in all columns are one response
    given twice: their records are alike, ids included. An empty table gives an empty result; other columns are
    not read. One pass, no shuffle.
    """

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            rows = []
            for source, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows += [(source, *x) for x in derive_one(*rest)]
            return dict(zip(NAMES, map(list, zip(*rows, strict=True)), strict=True))

        return step

    return map_rows(responses.select(*[x.split()[0] for x in RESPONSE.split(", ")]), RECORD, make)


def responses_of_pages(pages: DataFrame, date: str = "2024-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Response records of a table of fetched pages, which has no dates: ``date`` is that of the crawl.

    A page's record id is a version-5 UUID (SHA-1) of its id, url and payload, so rows that differ in any have ids of
    their own, null ids and urls included.
    """
    text = lambda c: F.coalesce(F.concat(F.lit("="), pages[c].cast("string")), F.lit("null"))
    seed = F.sha1(F.concat_ws("\u0000", F.lit("page"), text(id_col), text(url_col), F.sha1(F.coalesce(pages[html_col], F.lit("")))))
    variant = F.substring(F.lit("89ab"), F.pmod(F.conv(F.substring(seed, 17, 1), 16, 10).cast("int"), F.lit(4)) + 1, F.lit(1))
    parts = [F.substring(seed, 1, 8), F.substring(seed, 9, 4), F.concat(F.lit("5"), F.substring(seed, 14, 3)), F.concat(variant, F.substring(seed, 18, 3)), F.substring(seed, 21, 12)]
    return pages.select(
        pages[id_col].cast("long").alias("source_id"),
        F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">")).alias("record_id"),
        pages[url_col].alias("target_uri"),
        F.lit(date).alias("date"),
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n").alias("http_header"),
        F.coalesce(pages[html_col], F.lit("")).cast("binary").alias("payload"),
    )


def record_bytes(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    head = "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in headers if v is not None)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode("utf-8", "replace") + block + b"\r\n\r\n"


class Broken(Exception):
    """Bytes that are no WARC record; what follows may be."""


class Unpacked:
    """A file's bytes in turn, gzip members unpacked, with what is needed of it at hand only."""

    STEP = 1 << 20

    def __init__(self, read: Callable[[int], bytes]) -> None:
        self.source, self.raw, self.out, self.ended = read, b"", b"", False
        self.raw = read(self.STEP)
        self.packed = self.raw[:2] == b"\x1f\x8b"
        self.member = zlib.decompressobj(31)

    def _more(self) -> bool:
        """Whether there was more to append to ``out``."""
        while True:
            if not self.raw:
                self.raw = self.source(self.STEP)
                if not self.raw:
                    return False
            if not self.packed:
                self.out, self.raw = self.out + self.raw, b""
                return True
            if self.member.eof:
                self.member = zlib.decompressobj(31)
            data, self.raw = self.raw, b""
            try:
                got = self.member.decompress(data, self.STEP)
            except zlib.error as e:
                # Go on at the next thing that looks like a member; what is at hand belongs to a broken record.
                self.member, self.out = zlib.decompressobj(31), b""
                at = data.find(b"\x1f\x8b\x08", 1)
                while at < 0:
                    data = data[-2:] + (more := self.source(self.STEP))
                    at = data.find(b"\x1f\x8b\x08") if more else len(data)
                self.raw = data[at:]
                raise Broken(f"gzip: {e}") from None
            self.raw = self.member.unconsumed_tail or self.member.unused_data
            if self.member.eof:
                self.raw = self.raw.lstrip(b"\0")
            if got:
                self.out += got
                return True

    def line(self, most: int = 1 << 16) -> bytes:
        """The next line with its end; empty at the end of the file."""
        while (at := self.out.find(b"\n")) < 0 and len(self.out) < most and self._more():
            pass
        end = at + 1 if at >= 0 else min(len(self.out), most)
        found, self.out = self.out[:end], self.out[end:]
        return found

    def take(self, n: int, keep: bool = True) -> bytes:
        """The next ``n`` bytes, or none of them kept."""
        parts, open_ = [], n
        while open_ and (self.out or self._more()):
            part, self.out = self.out[:open_], self.out[open_:]
            open_ -= len(part)
            if keep:
                parts.append(part)
        if open_:
            raise Broken("record cut off")
        return b"".join(parts)


def parse_warc(read: Callable[[int], bytes], most_bytes: int = MOST_BYTES) -> Iterator[tuple[dict[str, str], bytes] | str]:
    """``(headers with lower-case names, block)`` of each record, or a message for one that cannot be read.

    After something unreadable the reader goes on at the next line that begins a record.
    """
    source = Unpacked(read)
    lost = False
    while True:
        try:
            line = source.line()
            if not line:
                return
            if not line.startswith(b"WARC/"):
                if line.strip() and not lost:
                    lost = True
                    yield "not a WARC record"
                continue
            lost = False
            headers: dict[str, str] = {}
            while (line := source.line()).strip():
                name, _, value = line.decode("utf-8", "replace").partition(":")
                headers[name.strip().lower()] = value.strip()
            size = headers.get("content-length", "")
            if not (size.isascii() and size.isdigit()):
                raise Broken("no content length")
            if int(size) > most_bytes:
                source.take(int(size), keep=False)
                raise Broken(f"block of {size} bytes")
            yield headers, source.take(int(size))
        except Broken as e:
            lost = True
            yield str(e)


#: Header fields of a written record, and the columns of ``RECORD`` that they carry.
FIELDS = {
    "WARC-Type": "record_type", "WARC-Record-ID": "record_id", "WARC-Refers-To": "refers_to", "WARC-Target-URI": "target_uri", "WARC-Date": "date", "WARC-Block-Digest": "block_digest",
    "WARC-Source-Payload-Digest": "payload_digest", "WARC-Source-Row": "source_id", "Content-Type": "content_type",
}


def write_warc(records: DataFrame, folder: str, file_bytes: int = 1 << 28) -> DataFrame:
    """Write derived records as ``.warc.gz`` files below a shared folder; the written manifest has a row for each.

    Files of attempts that failed are in no manifest. A task holds one file's compressed records.
    """

    def run(batches):
        task, number, parts, size = TaskContext.get().partitionId(), 0, [], 0

        def flush():
            nonlocal number, parts, size
            path = f"{folder}/derived-{task:06d}-{number:05d}-{uuid.uuid4().hex}.warc.gz"
            write_shared(path, b"".join(parts))
            row = pa.RecordBatch.from_pydict({"path": [path], "n_records": [len(parts)], "n_bytes": [size]})
            number, parts, size = number + 1, [], 0
            return row

        for batch in batches:
            for r in batch.to_pylist():
                headers = [(k, None if r[c] is None else str(r[c])) for k, c in FIELDS.items()]
                parts.append(gzip.compress(record_bytes(headers, bytes(r["block"])), 4, mtime=0))
                size += len(parts[-1])
                if size >= file_bytes:
                    yield flush()
        if parts:
            yield flush()

    return cut(records.mapInArrow(run, "path string, n_records long, n_bytes long"), "warc-manifest")


def _read(files: DataFrame, schema: str, row_of: Callable[[dict[str, str], bytes], tuple | None], most_bytes: int) -> DataFrame:
    """Rows that ``row_of`` makes of the records of the files in column ``path``, and a row with an ``error`` for each
    that cannot be read. A file is streamed; rows go on in batches of bounded size."""
    full = f"{schema}, path string, error string"
    names = [x.split()[0] for x in full.split(", ")]
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(T._parse_datatype_string(full))

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, size = [], 0
                with open_shared(path) as source:
                    for found in parse_warc(source.read, most_bytes):
                        if isinstance(found, str):
                            rows.append((*[None] * (len(names) - 2), path, found))
                        elif (row := row_of(*found)) is not None:
                            rows.append((*row, path, None))
                            size += len(found[1])
                        if len(rows) >= 500 or size > 1 << 23:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return files.select("path").repartition(max(1, min(files.count(), 10_000))).mapInArrow(run, full)


def read_warc(spark: SparkSession, path: str, kinds: tuple[str, ...] = ("response",), most_bytes: int = MOST_BYTES) -> DataFrame:
    """Rows of ``RESPONSE`` (``source_id`` null) with ``path`` and ``error`` from the WARC files at ``path``.

    A record that cannot be read (no record, no length, cut off, larger than ``most_bytes``, broken gzip) is a row with
    an ``error`` and nothing else; the others of its file are read. An empty file has no rows.
    """

    def row_of(headers: dict[str, str], block: bytes) -> tuple | None:
        if headers.get("warc-type") not in kinds:
            return None
        http, sep, payload = block.partition(b"\r\n\r\n") if block.startswith(b"HTTP/") else (b"", b"", block)
        return None, headers.get("warc-record-id"), headers.get("warc-target-uri"), headers.get("warc-date"), (http + sep).decode("utf-8", "replace"), payload

    return _read(spark.read.format("binaryFile").load(path).select("path"), RESPONSE, row_of, most_bytes)


def read_derived(manifest: DataFrame, most_bytes: int = MOST_CELL) -> DataFrame:
    """Rows of ``RECORD`` with ``path`` and ``error`` from the files of a manifest of :func:`write_warc`. A block came out
    of a cell of a table, so by default none is too large to be read."""
    columns = {c: k.lower() for k, c in FIELDS.items()}

    def row_of(headers: dict[str, str], block: bytes) -> tuple:
        made = {c: headers.get(k) for c, k in columns.items()} | {"content_length": len(block), "block": block}
        return tuple(int(made[c]) if c == "source_id" and made[c] is not None else made[c] for c in NAMES)

    return _read(manifest, RECORD, row_of, most_bytes)
