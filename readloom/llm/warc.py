"""WARC archives as tables of record chunks.

Payloads travel as rows (record, number of the chunk, bytes) of at most ``CHUNK``
bytes, each with the digest and the number of all bytes of its record so far. So
no step needs a record as a whole: the last chunk's row holds the digest and the
size of the full payload.

Writing: a first pass gives each payload's digest and size. Of records of equal
payloads, the one with the largest id becomes the response and the others
revisit it. Chunks then meet their record's decision, sorted by record and
chunk, and each task streams them into archives of its own, one gzip member a
record, at most one record beyond ``FILE_BYTES`` each. A file's name belongs to one
attempt of a task, and only the files of attempts that Spark committed are in
the list of files that is returned; what lost attempts left is never read.

Reading: each archive is streamed by one task into the table of chunks. Records
are read by their headers and lengths alone; digests are made anew.

A revisit keeps the HTTP header of its response, so the size is known without the
payload. Equal payloads are told by SHA-256 and size.

Defined results: a null payload is empty. A null id is smaller than any other; in a
group without any id all are responses. Rows of equal payload that share
the largest id are all responses. Rows that are equal altogether are written
as many times, one after the other. Addresses are percent-encoded, and left out where
null. Other columns are not read. Empty tables give no archives and no records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm.heavy import heavy, lookup
from readloom.llm.text import small_batches
from readloom.session import Workspace, spread

CHUNK = 64 << 10  # a batch of chunks has to fit a task
BATCH = 8 << 20
FILE_BYTES = 256 << 20
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"
NO_ID = -(2**63)
#: Fixed by the format.
VERSION, RESPONSE, REVISIT = "WARC/1.1", "response", "revisit"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"

PAYLOADS = "id long, key binary, sha1 binary, payload_bytes long"
CHUNKS = "id long, key binary, sha1 binary, payload_bytes long, copy long, uri string, chunk long, last boolean, data binary"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def named(id_: int, sha1: bytes) -> str:
    return f"<urn:x-page:{'null' if id_ == NO_ID else id_}:{base32(sha1)}>"


def sources(pages: DataFrame, id_: str, payload: str, uri: str | None) -> DataFrame:
    small_batches(pages.sparkSession)
    address = F.col(f"`{uri}`").cast("string") if uri else F.lit(None).cast("string")
    data = F.coalesce(F.col(f"`{payload}`").cast("binary"), F.lit(b""))
    return pages.select(F.coalesce(F.col(f"`{id_}`").cast("long"), F.lit(NO_ID)).alias("id"), address.alias("uri"), data.alias("data"))


def pieces(data: memoryview) -> Iterator[memoryview]:
    """The chunks of a payload; an empty one has one empty chunk."""
    for at in range(0, len(data), CHUNK) or (0,):
        yield data[at : at + CHUNK]


def payloads(pages: DataFrame) -> DataFrame:
    """id, digests and size of each payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, digests, sizes = [], [], []
            for value in batch.column("data"):
                data = memoryview(value.as_buffer())
                key, sha1 = hashlib.sha256(), hashlib.sha1()
                for piece in pieces(data):
                    key.update(piece)
                    sha1.update(piece)
                keys.append(key.digest())
                digests.append(sha1.digest())
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(keys, pa.binary()), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64())], names=["id", "key", "sha1", "payload_bytes"])

    return pages.select("id", "data").mapInArrow(run, PAYLOADS)


def chunked(pages: DataFrame) -> DataFrame:
    """The chunks of each payload. ``sha1`` is of all bytes up to the chunk's end,
    key and payload_bytes of the full payload; ``copy`` tells equal rows apart."""
    schema = ["id", "key", "sha1", "payload_bytes", "copy", "uri", "chunk", "last", "data"]
    types = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=schema)

        for batch in batches:
            for id_, copy, uri, value in zip(*(batch.column(c) for c in ("id", "copy", "uri", "data")), strict=True):
                data = memoryview(value.as_buffer())
                key, sha1, total = hashlib.sha256(), hashlib.sha1(), len(data)
                for piece in pieces(data):
                    key.update(piece)
                whole, number, at = key.digest(), 0, 0
                for piece in pieces(data):
                    sha1.update(piece)
                    at += len(piece)
                    rows.append((id_.as_py(), whole, sha1.digest(), total, copy.as_py(), uri.as_py(), number, at == total, bytes(piece)))
                    number, size = number + 1, size + len(piece) + 200
                    if size >= BATCH:
                        yield flush()
                        rows.clear()
                        size = 0
        if rows:
            yield flush()

    return pages.withColumn("copy", F.monotonically_increasing_id()).mapInArrow(run, CHUNKS)


def header(fields: list[tuple[str, object]]) -> bytes:
    return "".join([f"{VERSION}\r\n", *[f"{k}: {v}\r\n" for k, v in fields if v is not None], "\r\n"]).encode()


def write(
    pages: DataFrame, work: Workspace, id_: str = "page_id", payload: str = "html", uri: str | None = "url", least: int = 0, date: str = DATE
) -> DataFrame:
    """Write one record for each row; the list of files (file, n_records, n_bytes). Payloads under ``least`` bytes are never revisits."""
    pages = sources(pages, id_, payload, uri)
    each = work.keep("payloads", payloads(pages))
    known = F.when(F.col("id") != NO_ID, F.col("id"))
    groups = each.where(F.col("payload_bytes") >= least).groupBy("key", "payload_bytes").agg(F.max(known).alias("newest"), F.count("*").alias("n"))
    groups = work.keep("payload_groups", groups.where("n > 1"))
    met = lookup(each, groups.select("key", "payload_bytes", "newest"), ["key", "payload_bytes"], heavy(groups, each.count()))
    decided = met.select("id", "key", F.col("sha1").alias("full_sha1"), "newest").distinct()
    revisit = F.col("newest").isNotNull() & (F.col("newest") != F.col("id"))
    rows = chunked(pages).join(decided, ["id", "key"]).withColumn("revisit", revisit).where(~F.col("revisit") | (F.col("chunk") == 0))
    rows = rows.withColumn("data", F.when(~F.col("revisit"), F.col("data")))
    rows = rows.sortWithinPartitions("id", "key", "copy", "chunk").select(
        "id", "full_sha1", "payload_bytes", "uri", "chunk", "newest", "revisit", "data"
    )
    folder = work.path("archives")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = pyarrow.fs.FileSystem.from_uri(folder)
        system.create_dir(path, recursive=True)
        name, stream, records, start, packer, rest = "", None, 0, 0, None, 0
        done: list[tuple[str, int, int]] = []

        def end_record() -> None:
            nonlocal packer
            stream.write(packer.compress(b"\r\n\r\n") + packer.flush())
            packer = None

        def end_file() -> None:
            nonlocal stream
            done.append((name, records, stream.tell()))
            stream.close()
            stream = None

        try:
            for batch in batches:
                for row in batch.to_pylist():
                    if row["chunk"] == 0:
                        if packer:
                            end_record()
                        if stream and stream.tell() >= FILE_BYTES:
                            end_file()
                        if not stream:
                            name = f"{uuid.uuid4().hex}.warc.gz"
                            stream, records = system.open_output_stream(f"{path}/{name}", compression=None), 0
                        packer, records = zlib.compressobj(LEVEL, zlib.DEFLATED, 31), records + 1
                        stream.write(packer.compress(opening(row, date)))
                    if row["data"]:
                        stream.write(packer.compress(row["data"]))
            if packer:
                end_record()
            if stream:
                end_file()
        finally:
            if stream:
                stream.close()
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{d[0]}" for d in done], pa.string()), *(pa.array([d[k] for d in done], pa.int64()) for k in (1, 2))], names=["file", "n_records", "n_bytes"])

    return work.keep("files", rows.mapInArrow(run, "file string, n_records long, n_bytes long"))


def opening(row: dict, date: str) -> bytes:
    """Headers of a record and of its HTTP message."""
    http = HTTP.format(row["payload_bytes"]).encode()
    address = None if row["uri"] is None else urllib.parse.quote(row["uri"], safe="%/:=&?~#+!$,;'@()*[]")
    fields = [
        ("WARC-Type", REVISIT if row["revisit"] else RESPONSE), ("WARC-Record-ID", named(row["id"], row["full_sha1"])), ("WARC-Date", date),
        ("WARC-Target-URI", address), ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", "sha1:" + base32(row["full_sha1"])),
        ("WARC-Profile", PROFILE if row["revisit"] else None),
        ("WARC-Refers-To", named(row["newest"], row["full_sha1"]) if row["revisit"] else None),
        ("Content-Length", len(http) + (0 if row["revisit"] else row["payload_bytes"])),
    ]
    return header(fields) + http


def headers(stream: io.BufferedReader) -> tuple[dict[str, str], int]:
    """Fields up to the empty line, names in lower case, and the bytes they took. Continued lines join the line before."""
    out, size, last = {}, 0, None
    while True:
        line = stream.readline()
        size += len(line)
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if not text:
            if not line:
                raise ValueError("an archive ends inside a header")
            return out, size
        if text[0] in " \t" and last:
            out[last] += " " + text.strip()
        elif ":" in text:
            name, value = text.split(":", 1)
            last = name.strip().lower()
            out[last] = value.strip()


def records(stream: io.BufferedReader) -> Iterator[tuple[dict[str, str], int | None, Iterator[bytes]]]:
    """Fields of each record, the size that its HTTP header states, and its payload in chunks, to be read before the next record."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not the start of a record")
        fields, _ = headers(stream)
        left, stated = int(fields["content-length"]), None
        if fields.get("content-type", "").startswith("application/http") and left:
            first = stream.readline()
            http, size = headers(stream)
            left -= len(first) + size
            stated = int(http["content-length"]) if "content-length" in http else None

        def payload(left: int = left) -> Iterator[bytes]:
            while left:
                data = stream.read(min(left, CHUNK))
                if not data:
                    raise ValueError("an archive ends inside a record")
                left -= len(data)
                yield data

        yield fields, stated, payload()


READ = "file string, record long, chunk long, last boolean, payload_bytes long, sha1 binary, data binary, record_id string, record_type string, refers_to string, digest string, stated_digest string, stated_bytes long"


def read(files: DataFrame, with_data: bool = True) -> DataFrame:
    """The chunk table of archives named by the column ``file``: (file, record) and chunk number; size and
    digest of the payload so far; the fields of the record with its last chunk. A record without payload has
    one chunk. Without ``with_data`` only last chunks are given, and no bytes."""
    names = [x.split()[0] for x in READ.split(", ")]
    types = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.binary(), *[pa.string()] * 5, pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column("file").to_pylist():
                yield from one(file)

    def one(file: str) -> Iterator[pa.RecordBatch]:
        system, path = pyarrow.fs.FileSystem.from_uri(file)
        rows: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

        with system.open_input_stream(path, compression=None) as raw, io.BufferedReader(gzip.GzipFile(fileobj=raw) if file.endswith(".gz") else raw, 1 << 20) as stream:
            for number, (fields, stated, data) in enumerate(records(stream)):
                sha1, total, chunk, before = hashlib.sha1(), 0, 0, b""
                for piece in data:  # a chunk is given once the next one is there, as only the last one has the fields
                    if chunk and with_data:
                        rows.append((file, number, chunk - 1, False, total, sha1.digest(), before, *[None] * 6))
                        size += len(before) + 200
                    sha1.update(piece)
                    total, chunk, before = total + len(piece), chunk + 1, piece
                    if size >= BATCH:
                        yield flush()
                        rows.clear()
                        size = 0
                last = (fields.get("warc-record-id"), fields.get("warc-type"), fields.get("warc-refers-to"), "sha1:" + base32(sha1.digest()), fields.get("warc-payload-digest"), stated)
                rows.append((file, number, max(chunk - 1, 0), True, total, sha1.digest(), before if with_data else None, *last))
                size += len(before) + 400
                if size >= BATCH:
                    yield flush()
                    rows.clear()
                    size = 0
        if rows:
            yield flush()

    return spread(files.select("file"), "file").mapInArrow(run, READ)


def table_of(chunks: DataFrame) -> DataFrame:
    """One row for each record: page_id, size and digest of the full payload, type, the id it refers to, and
    whether a response's bytes have the digest and the size that it states."""
    number = lambda c: F.regexp_extract(c, r"^<urn:x-page:(-?[0-9]+):", 1).try_cast("long")
    full = F.col("record_type") == RESPONSE
    made = F.col("digest") == F.coalesce("stated_digest", "digest")
    return chunks.where("last").select(
        number("record_id").alias("page_id"),
        F.when(full, F.col("payload_bytes")).otherwise(F.col("stated_bytes")).alias("payload_bytes"),
        F.regexp_replace(F.when(full, F.col("digest")).otherwise(F.col("stated_digest")), "^sha1:", "").alias("payload_digest"),
        "record_type", number("refers_to").alias("refers_to"),
        (~full | (made & (F.col("payload_bytes") == F.coalesce("stated_bytes", "payload_bytes")))).alias("verified"),
    )
