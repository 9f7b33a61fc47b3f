"""WARC archives of pages: written with revisits, read back, and joined to one row per capture."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusquery.llm.arrow import arrow_schema, rows_to_batch, slices
from corpusquery.llm.files import TaskFile, open_folder
from corpusquery.plans.joins import join_by_size, materialize
from corpusquery.session import shared_dir

# Formats that the standard fixes.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

READ_BYTES = 1 << 20
COMPRESSION = 6

RECORD_DDL = (
    "record_id string, type string, concurrent_to string, refers_to string, target_uri string, "
    "date string, payload_digest string, payload_bytes bigint, digest_ok boolean, "
    "head string, fields map<string,string>, payload binary"
)
MANIFEST_DDL = "path string, n_records bigint, n_bytes bigint"


def payload_sha1(data: bytes) -> str:
    """SHA-1 in upper-case base32, as archives write it."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(kind: str, key: str) -> str:
    """The same id for the same record, also when a task is repeated."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{kind} {key}'.encode()).digest())}>"


def _record(kind: str, headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    lines = [VERSION, f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers if v is not None)]
    head = "\r\n".join([*lines, f"Content-Length: {len(block)}"]) + "\r\n\r\n"
    squeeze = zlib.compressobj(COMPRESSION, zlib.DEFLATED, 31)
    return squeeze.compress(head.encode() + block + b"\r\n\r\n") + squeeze.flush()


def _one_line(text: str | None) -> str | None:
    """A header value; line ends would start another header."""
    return None if text is None else text.replace("\r", "%0D").replace("\n", "%0A")


def capture_records(page_id, url, html, response_id, date: str) -> Iterator[bytes]:
    """Response or revisit, request and metadata record of a page.

    ``response_id`` is the page whose response holds an equal payload; it is
    null for a response.
    """
    payload = (html or "").encode()
    digest = payload_sha1(payload)
    uri = _one_line(url)
    key = f"{page_id} {digest}"
    capture = record_id("capture", key)
    common = [("WARC-Date", date), ("WARC-Target-URI", uri)]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    own = [
        ("WARC-Record-ID", capture),
        *common,
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if response_id is None:
        yield _record("response", own, http + payload)
    else:
        source = record_id("capture", f"{response_id} {digest}")
        own += [("WARC-Refers-To", source), ("WARC-Profile", REVISIT_PROFILE)]
        yield _record("revisit", own, http)
    linked = [*common, ("WARC-Concurrent-To", capture)]
    rest = (uri or "").partition("://")[2]
    host, _, tail = rest.partition("/")
    request = f"GET /{tail} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode()
    yield _record(
        "request",
        [("WARC-Record-ID", record_id("request", key)), *linked, ("Content-Type", "application/http; msgtype=request")],
        request,
    )
    fields = "" if page_id is None else f"pageId: {page_id}\r\n"
    yield _record(
        "metadata",
        [("WARC-Record-ID", record_id("metadata", key)), *linked, ("Content-Type", "application/warc-fields")],
        f"{fields}fetched: yes\r\n".encode(),
    )


def revisited(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Add ``response_id``: of pages with equal payloads, the largest ``page_id``; null on that page.

    Payloads below ``min_bytes`` are never revisited.  Only digests that occur
    more than once are joined back.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    marked = pages.withColumn("_digest", F.sha1(payload.cast("binary")))
    last = (
        pages.where(F.octet_length(payload) >= min_bytes)
        .select("page_id", F.sha1(payload.cast("binary")).alias("_digest"))
        .groupBy("_digest")
        .agg(F.max("page_id").alias("_last"), F.count(F.lit(1)).alias("_n"))
        .where("_n > 1 AND _last IS NOT NULL")
        .drop("_n")
    )
    # One payload may be shared by very many pages.
    joined = join_by_size(marked, materialize(last, "payloads"), ["_digest"], "left", spread_by=["page_id"])
    older = F.col("page_id").isNull() | (F.col("page_id") < F.col("_last"))
    return joined.withColumn("response_id", F.when(older, F.col("_last"))).drop("_digest", "_last")


def write_warc(pages: DataFrame, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write pages ``(page_id, url, html)`` as archives, one per task; returns their manifest.

    A page gives a response or revisit record and, concurrent to it, a request
    and a metadata record with its ``pageId``.  Each record is a gzip member.

    A null ``html`` is an empty payload, a null ``url`` is left out.  Rows that
    repeat a page with its payload give equal records, all responses if the
    page is the last of its payload.  A null ``page_id`` is left out of the
    metadata and comes before all others.  Other columns are ignored.
    """
    folder = shared_dir(pages.sparkSession, "warc")
    schema = arrow_schema(MANIFEST_DDL)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, records, size = None, 0, 0
        for batch in batches:
            for part in slices(batch, "html"):
                if out is None:
                    out = TaskFile(folder, f"part-{TaskContext.get().partitionId():06d}.warc.gz")
                for row in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "html", "response_id"))):
                    for record in capture_records(*row, date):
                        out.write(record)
                        records, size = records + 1, size + len(record)
        if out is not None:
            yield rows_to_batch([(out.commit(), records, size)], schema)

    rows = revisited(pages.select("page_id", "url", "html"), min_bytes)
    return materialize(rows.mapInArrow(work, MANIFEST_DDL), "warc-files")


class _Reader:
    """Bytes of an archive, compressed or not, in members or as one stream."""

    def __init__(self, source):
        self.source, self.buffer, self.inflate = source, bytearray(), None
        head = source.read(READ_BYTES)
        self.packed = head[:2] == b"\x1f\x8b"
        self._take(head)

    def _take(self, data: bytes) -> None:
        if not self.packed:
            self.buffer += data
            return
        while data:
            if self.inflate is None:
                self.inflate = zlib.decompressobj(31)
            self.buffer += self.inflate.decompress(data)
            data = self.inflate.unused_data
            if self.inflate.eof:
                self.inflate = None

    def more(self) -> bool:
        data = self.source.read(READ_BYTES)
        self._take(data)
        return bool(data)

    def until(self, mark: bytes) -> bytes | None:
        """What comes before the mark, which is skipped; None at the end."""
        seen = 0
        while (at := self.buffer.find(mark, seen)) < 0:
            seen = max(0, len(self.buffer) - len(mark))
            if not self.more():
                return None
        out = bytes(self.buffer[:at])
        del self.buffer[: at + len(mark)]
        return out

    def exactly(self, n: int) -> bytes:
        while len(self.buffer) < n:
            if not self.more():
                raise ValueError("the archive ends within a record")
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out


def _headers(text: str) -> dict[str, str]:
    pairs = (line.partition(":") for line in text.split("\r\n") if ":" in line)
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def read_records(source) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers, their names in lower case, and block of every record of an open archive."""
    reader = _Reader(source)
    while (head := reader.until(b"\r\n\r\n")) is not None:
        headers = _headers(head.decode("utf-8", "replace").lstrip("\r\n"))
        yield headers, reader.exactly(int(headers["content-length"]))
        reader.exactly(4)


def _row(headers: dict[str, str], block: bytes, keep_payload: bool) -> tuple:
    kind = headers.get("warc-type")
    stated = headers.get("warc-payload-digest")
    digest = stated.rpartition(":")[2].upper() if stated else None
    head = payload = size = fits = None
    fields = {}
    if kind in ("response", "revisit", "request") and headers.get("content-type", "").startswith("application/http"):
        top, _, payload = block.partition(b"\r\n\r\n")
        head = top.decode("utf-8", "replace")
        if kind == "response":
            size, found = len(payload), payload_sha1(payload)
            fits = digest is None or digest == found
            digest = found
        elif kind == "revisit":
            length = _headers(head).get("content-length")
            size, payload = (int(length) if length else None), None
    elif kind == "metadata":
        fields = _headers(block.decode("utf-8", "replace"))
    return (
        headers.get("warc-record-id"),
        kind,
        headers.get("warc-concurrent-to"),
        headers.get("warc-refers-to"),
        headers.get("warc-target-uri"),
        headers.get("warc-date"),
        digest,
        size,
        fits,
        head,
        list(fields.items()),
        payload if keep_payload else None,
    )


def read_warc(files: DataFrame, keep_payload: bool = True) -> DataFrame:
    """All records of the archives in ``path``, one task per file.

    The payload of a response is measured and hashed as it is read.  A revisit
    has the length that its HTTP head states and the digest of its header.
    """
    schema = arrow_schema(RECORD_DDL)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, name = open_folder(path)
                rows, held = [], 0
                with fs.open_input_file(name) as source:
                    for headers, block in read_records(source):
                        rows.append(_row(headers, block, keep_payload))
                        held += len(block) if keep_payload else 500
                        if held > READ_BYTES:
                            yield rows_to_batch(rows, schema)
                            rows, held = [], 0
                if rows:
                    yield rows_to_batch(rows, schema)

    count = max(1, files.count())
    return files.select("path").repartition(count, "path").mapInArrow(work, RECORD_DDL)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: a response or revisit with what was concurrent to it.

    Columns: ``capture`` (struct of the record), ``request`` and ``metadata``
    (structs, null where missing), and ``refers_to_metadata``, the metadata of
    the response that a revisit refers to.  Of several requests or metadata
    records for one capture, the one with the smallest id counts.  A capture
    that is repeated is returned as often.
    """
    main = ["record_id", "type", "refers_to", "target_uri", "date", "payload_digest", "payload_bytes", "digest_ok", "head", "payload"]

    def linked(kind: str, column: str) -> DataFrame:
        found = records.where((F.col("type") == kind) & F.col("concurrent_to").isNotNull())
        value = F.struct("record_id", "target_uri", "date", F.col(column))
        return found.groupBy(F.col("concurrent_to").alias("_id")).agg(
            F.min_by(value, "record_id").alias(kind)
        )

    metadata = linked("metadata", "fields")
    captures = materialize(
        records.where(F.col("type").isin("response", "revisit"))
        .select(F.struct(*main).alias("capture"), F.col("record_id").alias("_id"), F.col("refers_to").alias("_source"))
        .join(linked("request", "head"), "_id", "left")
        .join(metadata, "_id", "left"),
        "captures",
    )
    # Very many revisits may refer to one response, and responses refer to none.
    revisits = captures.where("_source IS NOT NULL")
    referred = metadata.join(revisits.select(F.col("_source").alias("_id")).distinct(), "_id", "left_semi")
    sources = materialize(
        referred.select(F.col("_id").alias("_source"), F.col("metadata").alias("refers_to_metadata")), "revisited"
    )
    others = captures.where("_source IS NULL").withColumn("refers_to_metadata", F.lit(None).cast(sources.schema[1].dataType))
    found = join_by_size(revisits, sources, ["_source"], "left", spread_by=["_id"])
    return found.unionByName(others).drop("_id", "_source")
