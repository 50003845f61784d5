"""WARC archives as a PySpark Python data source.

``df.write.format("warc")`` writes one gzip member per record; the member's header
carries its compressed length (the ``sl`` extra field), so a reader can step over a
record without inflating it.  ``spark.read.format("warc")`` plans partitions over the
archive files, accepts equality and membership predicates on the header columns, parses
the header of each record first, and inflates the payload only of records that pass and
only where the ``payload`` option asks for it.

Archives of other writers are read too: gzip with a member a record or without lengths,
plain ``.warc`` files, records of any type, headers that are missing, digests in base 32,
and HTTP responses, whose payload begins behind the HTTP header.

Record columns: record_type, page_id, url, payload_digest (bare lower-case hex SHA-1),
payload_bytes (of the full payload), refers_to (page_id of the record a revisit repeats),
payload (binary; null for revisits and where it was not asked for).

The payload's digest and length are null where a foreign record does not state them and its
payload was not asked for; page_id and refers_to are null where the ids are not of this
writer's form.

Edge cases: a null page_id or url has no header and reads back as null; an empty payload
is a response of zero bytes; records that repeat are kept; archives without records and
folders without archives read as empty.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    In,
    InputPartition,
    WriterCommitMessage,
)

from .textkit import attach, cut

SCHEMA = "record_type string, page_id long, url string, payload_digest string, payload_bytes long, refers_to long, payload binary"
_COLUMNS = [f.split()[0] for f in SCHEMA.split(", ")]
_ARROW = pa.schema([
    ("record_type", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_digest", pa.string()),
    ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary()),
])
#: Payloads below this are never stored as revisits.
REVISIT_BYTES = 1000
#: Size at which a writer starts another archive, and bytes of archives in a read partition.
ARCHIVE_BYTES, PARTITION_BYTES = 64 << 20, 16 << 20
_DATE = "2000-01-01T00:00:00Z"
_GZIP = b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff"


def _uri(page_id: int) -> str:
    return f"<urn:page:{page_id}>"


def record_header(row: dict) -> bytes:
    """Header block of a record."""
    revisit = row["record_type"] == "revisit"
    body = 0 if revisit else row["payload_bytes"]
    lines = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Date: {_DATE}"]
    if row["page_id"] is not None:
        lines.append(f"WARC-Record-ID: {_uri(row['page_id'])}")
    if row["url"] is not None:
        lines.append(f"WARC-Target-URI: {quote(row['url'], safe=':/?#[]@!$&()*+,;=%~-._')}")
    lines += [f"WARC-Payload-Digest: sha1:{row['payload_digest']}", f"WARC-Payload-Length: {row['payload_bytes']}"]
    if revisit:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    if row["refers_to"] is not None:
        lines.append(f"WARC-Refers-To: {_uri(row['refers_to'])}")
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {body}", "", ""]
    return "\r\n".join(lines).encode()


def member(data: bytes) -> bytes:
    """A gzip member whose extra field holds the member's own compressed length."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    packed = packer.compress(data) + packer.flush()
    extra = struct.pack("<2sHII", b"sl", 8, len(packed), len(data))
    return b"".join([_GZIP, struct.pack("<H", len(extra)), extra, packed, struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)])


def _page_number(uri: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?[0-9]+)>", uri or "")
    return int(m[1]) if m else None


def _hex_digest(value: str | None) -> str | None:
    """A SHA-1 of a header in lower-case hex; it may be written in base 32."""
    kind, _, digest = (value or "").partition(":")
    if kind.lower() != "sha1":
        return None
    return base64.b32decode(digest.upper()).hex() if len(digest) == 32 else digest.lower()


def parse_header(block: bytes) -> tuple[dict, dict]:
    """(record columns, all fields by lower-case name) of a header block."""
    lines = block.decode("utf-8", "replace").split("\r\n")[1:]
    fields = {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines) if value}
    length = fields.get("warc-payload-length")
    return {
        "record_type": fields.get("warc-type"),
        "page_id": _page_number(fields.get("warc-record-id")),
        "url": unquote(fields["warc-target-uri"].strip("<>")) if "warc-target-uri" in fields else None,
        "payload_digest": _hex_digest(fields.get("warc-payload-digest")),
        "payload_bytes": int(length) if length else None,
        "refers_to": _page_number(fields.get("warc-refers-to")),
    }, fields


class _Inflated:
    """The bytes of concatenated gzip members, read forward."""

    def __init__(self, stream, begun: bytes) -> None:
        self.stream, self.raw, self.ready = stream, begun, b""
        self.unpacker = zlib.decompressobj(31)

    def read(self, n: int) -> bytes:
        out = [self.ready[:n]]
        self.ready, n = self.ready[n:], n - len(out[0])
        while n > 0:
            if self.unpacker.eof:
                self.raw, self.unpacker = self.unpacker.unused_data or self.raw, zlib.decompressobj(31)
            self.raw = self.raw or self.stream.read(1 << 16)
            if not self.raw:
                break
            data = self.unpacker.decompress(self.raw, n)
            self.raw = self.unpacker.unconsumed_tail
            if self.unpacker.eof:
                self.raw, self.unpacker = self.unpacker.unused_data, zlib.decompressobj(31)
            out.append(data)
            n -= len(data)
        return b"".join(out)

    def skip(self, n: int) -> None:
        while n > 0 and (got := len(self.read(min(n, 1 << 16)))):
            n -= got


class _Plain:
    """The bytes of an uncompressed archive."""

    def __init__(self, stream) -> None:
        self.stream, self.read = stream, stream.read

    def skip(self, n: int) -> None:
        self.stream.seek(n, 1)


def _foreign_records(source, passes, payload: bool) -> Iterator[dict]:
    """Records of an archive without stated lengths; bodies of rejected records are skipped."""
    while True:
        block = b""
        while not block.endswith(b"\r\n\r\n"):
            byte = source.read(1)
            if not byte:
                return
            block = (block + byte).lstrip(b"\r\n") if not block else block + byte
        row, fields = parse_header(block)
        length = int(fields.get("content-length", 0))
        row["payload"] = None
        if not passes(row):
            source.skip(length)
        elif payload and row["record_type"] in ("response", "resource"):
            body = source.read(length)
            if fields.get("content-type", "").startswith("application/http"):
                body = body.partition(b"\r\n\r\n")[2]
            row["payload"], row["payload_bytes"] = body, len(body)
            row["payload_digest"] = row["payload_digest"] or hashlib.sha1(body).hexdigest()
            yield row
        else:
            source.skip(length)
            yield row


def read_records(stream, wanted: dict[str, set], payload: bool) -> Iterator[dict]:
    """Records of an archive whose header passes.

    Where a member states its length, the header is inflated from the first bytes and the
    stream steps over the rest of rejected records by a seek; others are inflated and dropped.
    """
    passes = lambda row: all(row[name] in values for name, values in wanted.items())
    while True:
        start = stream.read(12)
        if not start:
            return
        if not start.startswith(b"\x1f\x8b"):
            stream.seek(-len(start), 1)
            yield from _foreign_records(_Plain(stream), passes, payload)
            return
        extra = stream.read(struct.unpack("<H", start[10:12])[0]) if start[3] == 4 else b""
        if len(extra) != 12 or not extra.startswith(b"sl\x08\x00"):
            yield from _foreign_records(_Inflated(stream, start + extra), passes, payload)
            return
        left = struct.unpack("<2sHII", extra)[2]
        unpacker, head = zlib.decompressobj(-15), b""
        while b"\r\n\r\n" not in head and left:
            packed = stream.read(min(left, 512))
            left -= len(packed)
            head += unpacker.decompress(packed)
        block, _, begun = head.partition(b"\r\n\r\n")
        row, _ = parse_header(block)
        row["payload"] = None
        if passes(row) and payload and row["record_type"] == "response":
            body = begun + unpacker.decompress(stream.read(left))
            row["payload"], left = body[: row["payload_bytes"]], 0
        stream.seek(left + 8, 1)
        if passes(row):
            yield row


@dataclass
class Archives(InputPartition):
    paths: tuple[str, ...]

    def __init__(self, paths: tuple[str, ...]) -> None:
        self.paths = paths


@dataclass
class Written(WriterCommitMessage):
    paths: tuple[str, ...]


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool) -> None:
        self.path, self.payload, self.wanted = path, payload, {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes equality and membership on header columns; the rest stays with Spark."""
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and len(f.attribute) == 1 and f.attribute[0] in _COLUMNS[:-1]:
                name = f.attribute[0]
                self.wanted[name] = self.wanted.get(name, values) & values
            else:
                yield f

    def partitions(self) -> list[Archives]:
        """Archives in runs of about PARTITION_BYTES."""
        fs, root = pafs.FileSystem.from_uri(self.path)
        found = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
        out, run, size = [], [], 0
        for info in sorted(found, key=lambda i: i.path):
            if info.is_file and info.path.endswith((".warc.gz", ".warc")):
                if run and size + info.size > PARTITION_BYTES:
                    out.append(Archives(tuple(run)))
                    run, size = [], 0
                run.append(info.path)
                size += info.size
        return [*out, Archives(tuple(run))]

    def read(self, partition: Archives) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(self.path)
        for path in partition.paths:
            rows, size = [], 0
            with io.BufferedReader(fs.open_input_file(path), 1 << 20) as stream:
                for row in read_records(stream, self.wanted, self.payload):
                    rows.append(row)
                    size += 200 + len(row["payload"] or b"")
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                        rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)


class WarcWriter(DataSourceArrowWriter):
    """Each task writes archives of its own, named after the job; those that no committed task names are removed."""

    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(root, recursive=True)
        paths, out, size = [], None, 0
        try:
            for batch in iterator:
                for k in range(batch.num_rows):
                    row = {name: batch.column(name)[k].as_py() for name in _COLUMNS}
                    if out is None:
                        paths.append(f"{root}/{self.job}-{uuid.uuid4().hex}.warc.gz.part")
                        out, size = fs.open_output_stream(paths[-1], compression=None), 0
                    body = b"" if row["record_type"] == "revisit" else row["payload"] or b""
                    data = member(record_header(row) + body + b"\r\n\r\n")
                    out.write(data)
                    size += len(data)
                    if size >= ARCHIVE_BYTES:
                        out.close()
                        out = None
        finally:
            if out is not None:
                out.close()
        return Written(tuple(paths))

    def commit(self, messages: list[Written | None]) -> None:
        """Archives become visible under their final names."""
        fs, root = pafs.FileSystem.from_uri(self.path)
        if self.overwrite:
            for info in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
                if info.path.endswith(".warc.gz"):
                    fs.delete_file(info.path)
        for message in messages:
            for path in message.paths if message else ():
                fs.move(path, path.removesuffix(".part"))
        self._clear(fs, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*pafs.FileSystem.from_uri(self.path))

    def _clear(self, fs: pafs.FileSystem, root: str) -> None:
        """Removes what failed or repeated tasks of this job left."""
        for info in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
            if info.base_name.startswith(self.job) and info.path.endswith(".part"):
                fs.delete_file(info.path)


class WarcDataSource(DataSource):
    """Options: path, and payload (true by default; false leaves every payload undecoded)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() == "true")

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with predicate pushdown on."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def records(pages: DataFrame) -> DataFrame:
    """WARC records of pages (page_id, url, html): of equal payloads of at least REVISIT_BYTES
    bytes that with the largest page_id is the response, and the others revisit it.

    The greatest page_id of each repeated digest is aggregated over digests alone; those that
    occur once leave, and the rest are attached without gathering the pages of a digest.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    full = pages.select("page_id", "url", payload.alias("payload"))
    full = full.withColumns({"payload_digest": F.sha1("payload"), "payload_bytes": F.octet_length("payload").cast("long")})
    large = full.filter(F.col("payload_bytes") >= REVISIT_BYTES).select("page_id", "payload_digest")
    repeated = large.groupBy("payload_digest").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    repeated = cut(repeated.filter("n > 1 and first is not null").select("payload_digest", "first"))
    joined = attach(full, repeated, ["payload_digest"], salt_by=["page_id", "url"])
    again = F.coalesce(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.lit(False))
    return joined.select(
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        "page_id",
        "url",
        "payload_digest",
        "payload_bytes",
        F.when(again, F.col("first")).alias("refers_to"),
        "payload",
    )


def write_archives(pages: DataFrame, path: str) -> None:
    register(pages.sparkSession)
    records(pages).write.format("warc").mode("append").save(path)


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def index(spark: SparkSession, path: str) -> DataFrame:
    """Per record what its archive says; a response's length and digest are those of its payload as read."""
    read = read_archives(spark, path)
    return read.select(
        "page_id",
        F.coalesce(F.octet_length("payload").cast("long"), "payload_bytes").alias("payload_bytes"),
        F.coalesce(F.sha1("payload"), "payload_digest").alias("payload_digest"),
        "record_type",
        "refers_to",
    )


#: The same result in SQL, over a table ``pages``.
SQL = f"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), m AS (
  SELECT *, CASE WHEN payload_bytes >= {REVISIT_BYTES} THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM m
"""
