"""WARC archives: one gzip member per record, written by tasks and read back as a stream.

Archives live in the shared folder. A task writes whole archives under names of its own and hands their paths
to a manifest table, so what a lost task leaves behind is never read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, stored

MIN_REVISIT_BYTES = 100
ARCHIVE_BYTES = 64 << 20
CHUNK = 1 << 20
DATE = "2026-01-01T00:00:00Z"
_ROW = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, digest_ok boolean"


def _record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to, date: str = DATE) -> bytes:
    """One record as a gzip member: a response with HTTP head and payload, or a revisit without payload."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(f"%{ord(c):02X}" if ord(c) < 33 or ord(c) == 127 else c for c in url))
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(refers_to)}", f"X-Refers-To-Page-Id: {refers_to}"]
    head += [f"X-Payload-Length: {len(payload)}", f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    gz = zlib.compressobj(6, zlib.DEFLATED, 31)
    return gz.compress("\r\n".join(head).encode() + b"\r\n\r\n") + gz.compress(block) + gz.compress(b"\r\n\r\n") + gz.flush()


def _write_archives(batches: Iterator[pa.RecordBatch], base: str, archive_bytes: int) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(base)
    name, out, size, records = "", None, 0, 0

    def closed():
        out.close()
        return pa.RecordBatch.from_pydict({"path": [f"{base}/{name}"], "records": pa.array([records], pa.int64()), "bytes": pa.array([size], pa.int64())})

    for batch in batches:
        for page_id, url, payload, digest, refers_to in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if out is None:
                name, size, records = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                out = store.open_output_stream(f"{path}/{name}", compression=None)  # the name would have it compressed again
            member = record(page_id, url, payload, digest, refers_to)
            out.write(member)
            size, records = size + len(member), records + 1
            if size >= archive_bytes:
                yield closed()
                out = None
    if out is not None:
        yield closed()


def write_warc(pages: DataFrame, min_revisit_bytes: int = MIN_REVISIT_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives every row of pages (page_id, url, html); returns the manifest (path, records, bytes).

    Null html is an empty payload. Of rows with equal payloads of at least ``min_revisit_bytes`` the smallest
    page_id is the response and the others are revisits; rows that repeat that page_id are responses too, and so
    is a payload whose page_ids are all null. Columns besides the three are ignored; an empty table gives an
    empty manifest.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    again = rows.where(F.octet_length("payload") >= min_revisit_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    typed = rows.join(again, "digest", "left").select("page_id", "url", "payload", "digest", F.when(F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")).alias("refers_to"))
    base = f"{shared_dir(spark)}/quillmill-warc-{uuid.uuid4().hex}"
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(base)
    fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(fs_path)
    return stored(typed.mapInArrow(lambda b: _write_archives(b, base, archive_bytes), "path string, records long, bytes long"), "manifest")


class _Member:
    """The inflated bytes of one gzip member, at most a chunk at a time."""

    def __init__(self, raw, rest: bytes) -> None:
        self.raw, self.pending, self.data, self.gz = raw, rest, b"", zlib.decompressobj(31)

    def more(self) -> bool:
        while not self.gz.eof:
            self.pending = self.pending or self.raw.read(CHUNK)
            if not self.pending:
                raise ValueError("the archive ends inside a record")
            got = self.gz.decompress(self.pending, CHUNK)
            self.pending = self.gz.unconsumed_tail
            if got:
                self.data += got
                return True
        return False

    def head(self) -> bytes:
        """Up to and without the next empty line."""
        while (at := self.data.find(b"\r\n\r\n")) < 0:
            if not self.more():
                raise ValueError("a record's head has no end")
        head, self.data = self.data[:at], self.data[at + 4 :]
        return head

    def pieces(self, n: int) -> Iterator[bytes]:
        """The next n bytes."""
        while n:
            if not self.data and not self.more():
                raise ValueError("a record is shorter than its Content-Length")
            piece, self.data = self.data[:n], self.data[n:]
            n -= len(piece)
            yield piece

    def end(self) -> bytes:
        """Checks that the member ends here; the bytes of the next."""
        while self.more():
            pass
        if self.data:
            raise ValueError("a record is longer than its Content-Length")
        return self.gz.unused_data


def _headers(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}


def records(raw) -> Iterator[dict]:
    """Every record of an open archive, one after the other; raises where framing is broken.

    ``digest_ok`` tells whether the block digest, and a response's payload digest, equal those recomputed.
    """
    rest = b""
    while rest := rest or raw.read(CHUNK):
        member = _Member(raw, rest)
        warc = _headers(member.head())
        left = int(warc["content-length"])
        block, payload, size = hashlib.sha256(), hashlib.sha256(), 0
        http, in_http = b"", warc.get("content-type", "").startswith("application/http")
        for piece in member.pieces(left):
            block.update(piece)
            if in_http:
                http += piece
                if (at := http.find(b"\r\n\r\n")) < 0:
                    continue
                piece, in_http = http[at + 4 :], False
            payload.update(piece)
            size += len(piece)
        if b"".join(member.pieces(4)) != b"\r\n\r\n":
            raise ValueError("a record doesn't end with two empty lines")
        rest = member.end()
        revisit = warc["warc-type"] == "revisit"
        stated = warc.get("warc-payload-digest", "").removeprefix("sha256:")
        digest = stated if revisit else payload.hexdigest()
        number = lambda k: int(warc[k]) if k in warc else None
        yield {"page_id": number("x-page-id"), "url": warc.get("warc-target-uri"), "record_type": warc["warc-type"], "refers_to": number("x-refers-to-page-id"), "payload_bytes": number("x-payload-length") if revisit else size, "payload_digest": digest, "digest_ok": digest == stated and warc.get("warc-block-digest") == f"sha256:{block.hexdigest()}"}


def _read_archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    kinds = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("digest_ok", pa.bool_())])
    for batch in batches:
        for uri in batch.column(0).to_pylist():
            store, path = fs.FileSystem.from_uri(uri)
            rows = []
            with store.open_input_stream(path, compression=None) as raw:
                for row in records(raw):
                    rows.append(row)
                    if len(rows) == 5000:
                        yield pa.RecordBatch.from_pylist(rows, kinds)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, kinds)


def read_warc(archives: DataFrame) -> DataFrame:
    """One row per record of the archives in column ``path``, each read from front to end in bounded memory.

    Raises if a digest differs, or if a revisit names a page that has no response of its digest and length; revisits
    that name no page are taken as they are. A null path is skipped.
    """
    n = max(1, archives.count())
    rows = stored(archives.where("path is not null").select("path").repartition(n).mapInArrow(_read_archives, _ROW), "records")
    responses = rows.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest", "payload_bytes", F.lit(True).alias("known")).distinct()
    read = rows.join(responses, ["refers_to", "payload_digest", "payload_bytes"], "left")
    fails = lambda bad, what: F.when(bad, F.raise_error(F.concat(F.lit(f"{what} page "), F.coalesce(F.col("page_id").cast("string"), F.lit("?")))))
    unknown = (F.col("record_type") == "revisit") & F.col("refers_to").isNotNull() & F.col("known").isNull()
    return read.where(F.coalesce(fails(~F.col("digest_ok"), "digest differs for"), fails(unknown, "no response for the revisit of"), F.lit(True))).select(*rows.columns)


def roundtrip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """What the archives written from pages hold."""
    return read_warc(write_warc(pages))
