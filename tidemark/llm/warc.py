"""WARC archives: a writer with identical-payload revisits, and a sequential reader.

An archive is a file of gzip members, one for each record, in the folder that all executors share. The reader takes
archives in chunks, decompresses each member incrementally, frames header and block by their declared lengths and hashes
payloads as they pass, so that neither an archive nor a record has to fit in memory unless the payload is asked for.

Of records with equal payloads of at least REVISIT_BYTES, those with the smallest id are responses and the others revisits
that refer to it; smaller payloads are always responses. Null payloads count as empty. A null id has no record to be named
by: such rows are revisits of an equal payload with an id, or else responses. Rows that repeat the smallest id are all
responses. Only the named columns are read; an empty table gives no archive and no record.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import fresh_path, slices, utf8

#: Smaller payloads are never written as revisits.
REVISIT_BYTES = 100
#: Bytes after which a writing task begins another archive.
ARCHIVE_BYTES = 64 << 20
CHUNK = 256 << 10
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {}\r\n\r\n"
#: Characters that stay as they are in a target URI.
URI_SAFE = "!#$%&'()*+,/:;=?@[]~"

MANIFEST = "archive string, records long, bytes long"
RECORDS = (
    "archive string, offset long, record_id string, record_type string, target_uri string, refers_to string, "
    "payload_bytes long, payload_digest string, problem string, payload binary"
)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """A WARC/1.1 record, uncompressed. A revisit has the HTTP head alone and keeps digest and length of its payload."""
    head = HTTP_HEAD.format(len(payload)).encode()
    block = head if refers_to is not None else head + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=URI_SAFE)}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}", f"X-Payload-Length: {len(payload)}"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html", date: str = "1970-01-01T00:00:00Z", level: int = 4, folder: str | None = None) -> DataFrame:
    """Write a record for each row and return the manifest (archive, records, bytes), already written as a table.

    Tasks name their archives freshly, and the manifest lists those of the attempts that succeeded, so that a lost
    executor leaves unlisted files at worst.
    """
    spark = pages.sparkSession
    folder = folder or fresh_path(spark, "warc")
    rows = pages.select(
        F.col(page_id).cast("long").alias("page_id"),
        F.col(url).alias("url"),
        F.encode(F.coalesce(F.col(payload), F.lit("")), "utf-8").alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    large = F.octet_length("payload") >= REVISIT_BYTES
    firsts = rows.where(large).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select(F.col("digest").alias("key"), "first")
    # small payloads never match; their keys are spread by id
    keyed = rows.withColumn("key", F.when(large, F.col("digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id").cast("string"))))
    marked = keyed.join(firsts, "key", "left").select("page_id", "url", "payload", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, root = fs.FileSystem.from_uri(folder)
        place.create_dir(root, recursive=True)
        out, name, records, size = None, "", 0, 0
        done: list[tuple[str, int, int]] = []
        for whole in batches:
            for batch in slices(whole):
                for p, u, body, digest, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if out is None:
                        name = f"{uuid.uuid4().hex}.warc.gz"
                        out, records, size = place.open_output_stream(f"{root}/{name}", compression=None), 0, 0
                    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                    member = packer.compress(record(p, u, body, digest, refers, date)) + packer.flush()
                    out.write(member)
                    records, size = records + 1, size + len(member)
                    if size >= ARCHIVE_BYTES:
                        out.close()
                        done.append((f"{folder}/{name}", records, size))
                        out = None
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", records, size))
        yield pa.RecordBatch.from_pylist([dict(zip(("archive", "records", "bytes"), d, strict=True)) for d in done], pa.schema([("archive", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    listed = fresh_path(spark, "warc-manifest")
    marked.mapInArrow(run, MANIFEST).write.parquet(listed)
    return spark.read.schema(MANIFEST).parquet(listed)


@dataclass
class Member:
    """What is known of a record while its member is decompressed."""

    keep: bool
    head: bytes = b""
    headers: dict[str, str] | None = None
    left: int = 0
    http: bytes | None = b""
    payload_bytes: int = 0
    payload_hash: "hashlib._Hash" = field(default_factory=hashlib.sha256)
    block_hash: "hashlib._Hash" = field(default_factory=hashlib.sha256)
    payload: list[bytes] = field(default_factory=list)
    problem: str | None = None

    def feed(self, data: bytes) -> None:
        if self.headers is None:
            self.head += data
            end = self.head.find(b"\r\n\r\n")
            if end < 0:
                return
            lines = self.head[:end].decode("utf-8", "replace").split("\r\n")
            self.headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
            if not lines[0].startswith("WARC/"):
                self.problem = "no WARC version"
            length = self.headers.get("content-length", "")
            self.left = int(length) if length.isdigit() else 0
            if not length.isdigit():
                self.problem = "no content length"
            data, self.head = self.head[end + 4 :], b""
        block, self.left = data[: self.left], self.left - min(self.left, len(data))
        if block:
            self.block_hash.update(block)
            if self.http is not None and self.headers.get("content-type", "").startswith("application/http"):
                self.http += block
                end = self.http.find(b"\r\n\r\n")
                if end < 0:
                    return
                block, self.http = self.http[end + 4 :], None
            self.payload_bytes += len(block)
            self.payload_hash.update(block)
            if self.keep:
                self.payload.append(block)

    def row(self, archive: str, offset: int) -> dict:
        h = self.headers or {}
        kind = h.get("warc-type")
        problem = self.problem or ("no header" if self.headers is None else "short block" if self.left else None)
        said = h.get("warc-payload-digest", "").removeprefix("sha256:")
        block = h.get("warc-block-digest", "").removeprefix("sha256:")
        size, digest = self.payload_bytes, self.payload_hash.hexdigest()
        if kind == "revisit":
            length = h.get("x-payload-length", "")
            size, digest = int(length) if length.isdigit() else None, said or None
        elif said and said != digest:
            problem = problem or "payload digest differs"
        if block and block != self.block_hash.hexdigest():
            problem = problem or "block digest differs"
        return {
            "archive": archive, "offset": offset, "record_id": h.get("warc-record-id"), "record_type": kind, "target_uri": h.get("warc-target-uri"),
            "refers_to": h.get("warc-refers-to"), "payload_bytes": size, "payload_digest": digest, "problem": problem,
            "payload": b"".join(self.payload) if self.keep and kind != "revisit" else None,
        }


def members(stream, archive: str, keep: bool = False) -> Iterator[dict]:
    """Rows of RECORDS from an archive's byte stream; a damaged member ends the archive with a row that says so."""
    offset, read, data = 0, 0, b""
    while True:
        data = data or stream.read(CHUNK)
        if not data:
            return
        unpack, member, failed = zlib.decompressobj(31), Member(keep), None
        while not unpack.eof:
            try:
                rest = data
                while rest and not unpack.eof:
                    member.feed(unpack.decompress(rest, CHUNK))
                    rest = unpack.unconsumed_tail
            except zlib.error as e:
                failed = f"gzip: {e}"
                break
            read += len(data) - len(unpack.unused_data)
            data = unpack.unused_data
            if not unpack.eof:
                data = stream.read(CHUNK)
                if not data:
                    failed = "member ends early"
                    break
        if failed:
            member.problem = failed
        yield member.row(archive, offset)
        if failed:
            return
        offset = read


def read(manifest: DataFrame, payload: bool = False) -> DataFrame:
    """Records (columns of RECORDS) of the listed archives, an archive to a task; problem is null for sound records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"offset": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}
        names = [c.split()[0] for c in RECORDS.split(", ")]
        schema = pa.schema([(n, types.get(n, pa.string())) for n in names])
        for batch in batches:
            for archive in utf8(batch.column(0)):
                archive = archive.decode()
                place, path = fs.FileSystem.from_uri(archive)
                with place.open_input_stream(path, compression=None) as stream:
                    rows, size = [], 0
                    for row in members(stream, archive, payload):
                        rows.append(row)
                        size += 500 + len(row["payload"] or b"")
                        if size > CHUNK * 16:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                    yield pa.RecordBatch.from_pylist(rows, schema)

    archives = manifest.where("archive is not null").select("archive")
    return archives.repartition(max(1, archives.count()), "archive").mapInArrow(run, RECORDS)
