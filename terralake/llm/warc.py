"""WARC archives: one gzip member per record, revisit records for equal payloads, and a sequential reader.

Each task writes one archive under the shared folder, first under a name of its own attempt and then moved into
place, so a task that runs again leaves one whole file. The reader decompresses a member step by
step, frames it by its Content-Length and verifies digests while it goes; a record's payload is
only held where the caller asks for it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terralake.llm.common import folder, in_steps, staged, table

CHUNK = 1 << 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "urn:page:"
DATE = "2000-01-01T00:00:00Z"
END = b"\r\n\r\n"


def digest(sha) -> str:
    return base64.b32encode(sha.digest()).decode("ascii")


def _record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record as a gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode("ascii")
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{RECORD}{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
    ]
    if url is not None:
        # Control characters would end a header line.
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha1:{digest(hashlib.sha1(payload))}")
    head.append(f"WARC-Block-Digest: sha1:{digest(hashlib.sha1(block))}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{RECORD}{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode("utf-8") + END) + packer.compress(block + END) + packer.flush()


def write_archives(df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0) -> DataFrame:
    """Writes a record for each row and returns (path, records, bytes) of the archives, one for each task that has rows.

    Of records with equal payloads of at least `least` bytes, that of the largest id is a response
    and the others revisit it; shorter ones are all responses. NULL html is an empty payload.
    Repeated rows of the largest id are all responses. A row with a NULL id revisits a row that has an
    id; among NULL ids only, all are responses. Other columns are not written. An empty table writes nothing.
    """
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    pages = df.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), html.alias("html"), F.sha1(html).alias("sha"))
    kept = pages.filter(F.octet_length("html") >= least).groupBy("sha").agg(F.max("id").alias("last"))
    rows = pages.join(kept, "sha", "left").select(
        "id", "url", F.col("html").cast("binary").alias("text"),
        F.when(F.col("last").isNotNull() & ~F.col("id").eqNullSafe(F.col("last")), F.col("last")).alias("refers_to"),
    )
    target = path.rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, base = fs.FileSystem.from_uri(target)
        final = f"{base}/part-{task.partitionId():06d}.warc.gz"
        own = f"{base}/.{task.partitionId():06d}-{task.attemptNumber()}-{uuid.uuid4().hex}"
        out, records, size = None, 0, 0
        for step in in_steps(batches):
            for page, url, payload, last in zip(*(step.column(n).to_pylist() for n in ("id", "url", "text", "refers_to"))):
                if out is None:
                    store.create_dir(base, recursive=True)
                    out = store.open_output_stream(own, compression=None)
                member = _record(page, url, payload, last, last is not None)
                out.write(member)
                records, size = records + 1, size + len(member)
        if out is not None:
            out.close()
            store.move(own, final)
            name = f"{target}/part-{task.partitionId():06d}.warc.gz"
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([records], pa.int64()), pa.array([size], pa.int64())], names=["path", "records", "bytes"])

    return staged(rows.mapInArrow(run, "path string, records long, bytes long"), "warc-manifest")


class Framed:
    """One record, fed as its bytes come out of the decompressor."""

    def __init__(self, keep: bool):
        self.keep, self.held, self.headers = keep, b"", None
        self.http, self.left = b"", 0
        self.in_payload = False
        self.block_sha, self.payload_sha, self.size, self.payload = hashlib.sha1(), hashlib.sha1(), 0, []
        self.tail = b""

    def feed(self, data: bytes) -> None:
        if self.headers is None:
            self.held += data
            head, end, data = self.held.partition(END)
            if not end:
                return
            version, *fields = head.decode("utf-8").split("\r\n")
            if not version.startswith("WARC/"):
                raise ValueError(f"no WARC record: {version[:40]!r}")
            self.headers = {k.strip().lower(): v.strip() for k, _, v in (f.partition(":") for f in fields)}
            self.left = int(self.headers["content-length"])
            self.in_payload = not self.headers.get("content-type", "").startswith("application/http")
            self.held = b""
        block, rest = data[: self.left], data[self.left :]
        self.left -= len(block)
        self.block_sha.update(block)
        if not self.in_payload:
            self.http += block
            head, end, block = self.http.partition(END)
            if not end:
                block = b""
            else:
                self.http, self.in_payload = head, True
        self.payload_sha.update(block)
        self.size += len(block)
        if self.keep:
            self.payload.append(block)
        self.tail += rest

    def checked(self) -> tuple:
        """The record's columns; ValueError if its frame or a digest is wrong."""
        if self.headers is None or self.left or self.tail != END:
            raise ValueError("the member ends before or after its record")
        h = self.headers
        revisit = h.get("warc-type") == "revisit"
        stated, found = h.get("warc-payload-digest"), f"sha1:{digest(self.payload_sha)}"
        if h.get("warc-block-digest", x := f"sha1:{digest(self.block_sha)}") != x:
            raise ValueError(f"wrong block digest in {h.get('warc-record-id')}")
        if not revisit and stated not in (None, found):
            raise ValueError(f"wrong payload digest in {h.get('warc-record-id')}")
        size = self.size
        if revisit:
            lengths = re.findall(rb"(?im)^content-length:[ \t]*(\d+)", self.http)
            size = int(lengths[0]) if lengths else None
        return (
            h.get("warc-record-id"), h.get("warc-type"), h.get("warc-target-uri"), h.get("warc-refers-to"), size,
            (stated if revisit else found or "").removeprefix("sha1:") if stated or not revisit else None,
            b"".join(self.payload) if self.keep and not revisit else None,
        )


def records(stream, keep: bool = False, chunk: int = CHUNK) -> Iterator[tuple]:
    """Columns of every record of an archive, read from its start to its end."""
    data = stream.read(chunk)
    while data:
        unpack, framed = zlib.decompressobj(31), Framed(keep)
        while not unpack.eof:
            data = data or stream.read(chunk)
            if not data:
                raise ValueError("the archive ends inside a member")
            out = unpack.decompress(data, chunk)
            data = unpack.unused_data if unpack.eof else unpack.unconsumed_tail
            framed.feed(out)
        yield framed.checked()
        data = data or stream.read(chunk)


FIELDS = "record_id string, record_type string, target_uri string, refers_to string, payload_bytes long, payload_digest string, payload binary"


def read_archives(paths: DataFrame, path_col: str = "path", payloads: bool = False) -> DataFrame:
    """One row for each record of the archives that `paths` lists: ids, type, URI, size and digest of the payload.

    Every record is verified; a broken frame, digest or member fails the job with the archive's name. A revisit
    has the size and digest of the payload that it stands for. `payload` is NULL unless asked for, and for
    revisits. NULL paths are skipped; an archive that is listed twice is read twice.
    """
    listed = paths.select(F.col(path_col).alias("path")).filter("path IS NOT NULL")
    schema = T.StructType.fromDDL(FIELDS)
    kinds = [pa.int64() if f.dataType == T.LongType() else pa.binary() if f.dataType == T.BinaryType() else pa.string() for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=schema.names)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, name = fs.FileSystem.from_uri(path)
                rows, held = [], 0
                try:
                    with store.open_input_stream(name, compression=None) as stream:
                        for row in records(stream, payloads):
                            rows.append(row)
                            held += 1000 + len(row[-1] or b"")
                            if held > 8_000_000:
                                yield made(rows)
                                rows, held = [], 0
                except (ValueError, zlib.error) as e:
                    raise ValueError(f"{path}: {e}") from e
                if rows:
                    yield made(rows)

    # As many partitions as archives: a list of names is small, what they hold is not.
    return listed.repartitionByRange(max(1, listed.count()), "path").mapInArrow(run, schema)


def page_of(record: Column) -> Column:
    return F.nullif(F.regexp_extract(record, f"^<{RECORD}(-?[0-9]*)>$", 1), F.lit("")).cast("long")


def op2_warc(spark, sf_dir: str) -> DataFrame:
    """Every page written to archives, and what the archives say of it."""
    written = write_archives(table(spark, sf_dir, "pages"), folder(spark, "warc"))
    found = read_archives(written)
    return found.select(
        page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_of(F.col("refers_to")).alias("refers_to")
    )


#: Base 32 of a SHA-1: eight groups of twenty bits, four letters each.
OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
h AS (SELECT page_id, octet_length(encode(body)) AS size, sha1(body) AS hex FROM p),
d AS (
    SELECT page_id, size, hex, max(page_id) OVER (PARTITION BY hex) AS last,
        list_transform(range(8), lambda g: ('0x' || hex[5 * g + 1 : 5 * g + 5])::BIGINT) AS groups
    FROM h
)
SELECT page_id, size::BIGINT AS payload_bytes,
    array_to_string(list_transform(range(32), lambda i:
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((groups[i // 4 + 1] >> (15 - 5 * (i % 4))) & 31) + 1]), '') AS payload_digest,
    CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> last THEN last END AS refers_to
FROM d
"""
