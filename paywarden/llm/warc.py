"""WARC archives: write, normalise monolithic gzip, read through an offset index.

    pages ── largest page id per equal payload ── one archive per task, a single gzip stream
          ── normalise: inflate the stream once, write every record as a gzip member of its own,
             and its offset to a sidecar index
          ── read single records by offset

Payload equality uses the SHA-1 of the whole payload, counted before any payload moves: the count is
combined per task, and only payloads that occur more than once reach the join. The join's hot keys are
split by adaptive execution. Every step is one task per archive file and holds one record; manifests are
written tables, so archives of failed attempts are never read.

Null html is an empty payload. A null page id gets a record of its own kind and never is the original of
others. Rows that repeat the largest page id of a payload are all responses. A null url gives an empty
target address. An empty table gives no archive.
"""
from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paywarden.llm.common import file_system, new_folder, write_file

#: Fixed values of the WARC 1.1 format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: High halves of the record ids of pages with and without an id.
PAGE, NO_PAGE = 0x70617977_61724001, 0x70617977_61724002
LOW = (1 << 64) - 1
FILE_BYTES = 256 << 20           # an archive is closed once it holds as many bytes of records


def record_id(page_id: int | None, salt: bytes = b"") -> str:
    if page_id is None:
        return f"<urn:uuid:{uuid.UUID(int=NO_PAGE << 64 | int.from_bytes(hashlib.sha1(salt).digest()[:8], 'big'))}>"
    return f"<urn:uuid:{uuid.UUID(int=PAGE << 64 | page_id & LOW)}>"


def page_of(record: str | None) -> int | None:
    if not record:
        return None
    value = uuid.UUID(record.strip("<>").removeprefix("urn:uuid:")).int
    low = value & LOW
    return (low - (1 << 64) if low >> 63 else low) if value >> 64 == PAGE else None


def clean(value: str) -> str:
    """A header value: no line breaks or other control characters."""
    return "".join(c if c.isprintable() else "".join(f"%{b:02X}" for b in c.encode()) for c in value)


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """A response with its payload, or a revisit with the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [f"WARC-Type: {'revisit' if refers_to is not None else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest.encode() + (url or '').encode())}",
            f"WARC-Date: {date}", f"WARC-Target-URI: {clean(url or '')}", "Content-Type: application/http; msgtype=response",
            f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {PROFILE}"]
    return VERSION + b"\r\n" + "\r\n".join([*head, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")
    if lines[0] != VERSION.decode():
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    return {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}


def inflate(stream, step: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of a gzip file of one or several members, inflated once."""
    unzip, data = zlib.decompressobj(31), stream.read(step)
    while data:
        yield unzip.decompress(data)
        data = unzip.unused_data
        if unzip.eof:
            unzip = zlib.decompressobj(31)
            data = data or stream.read(step)
        else:
            data = stream.read(step)
            if not data:
                raise ValueError("the gzip stream ends early")


def records(parts: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, whole record) of every record of a stream."""
    held = bytearray()

    def need(n: int) -> bool:
        while len(held) < n:
            part = next(parts, None)
            if part is None:
                return False
            held.extend(part)
        return True

    while need(1):
        end = held.find(b"\r\n\r\n")
        while end < 0:
            seen = len(held)
            if not need(seen + 1):
                raise ValueError("a record ends early")
            end = held.find(b"\r\n\r\n", max(0, seen - 3))
        head = parse_head(bytes(held[:end]))
        size = end + 4 + int(head["content-length"]) + 4
        if not need(size):
            raise ValueError("a record ends early")
        yield head, bytes(held[:size])
        del held[:size]


def with_originals(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """id, url, payload, digest (hex) and `refers_to`: the page that a copy of its payload revisits."""
    rows = pages.select(F.col("page_id").cast("long").alias("id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload")).withColumn("digest", F.sha1("payload"))
    counted = rows.filter(F.length("payload") >= min_bytes).groupBy("digest").agg(F.max("id").alias("original"), F.count(F.lit(1)).alias("n"))
    originals = counted.filter("n > 1 and original is not null").select("digest", "original")
    return (rows.join(originals, "digest", "left")
            .select("id", "url", "payload", "digest", F.when(F.col("original") != F.coalesce("id", F.col("original") + 1), F.col("original")).alias("refers_to")))


def write_warc(pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", min_bytes: int = 0) -> DataFrame:
    """One gzip stream per archive (records aren't members of their own). Returns the manifest: file, records."""
    def run(batches):
        state = None
        for batch in batches:
            columns = [batch.column(c) for c in ("id", "url", "payload", "digest", "refers_to")]
            for i in range(batch.num_rows):
                page_id, url, payload, digest, refers_to = (c[i].as_py() for c in columns)
                if state is None:
                    raw, close = write_file(f"{folder}/raw-{uuid.uuid4().hex}.warc.gz")
                    state = [raw, close, zlib.compressobj(6, zlib.DEFLATED, 31), 0, 0]
                data = record(page_id, url, payload, base32(bytes.fromhex(digest)), refers_to, date)
                state[0].write(state[2].compress(data))
                state[3] += len(data)
                state[4] += 1
                if state[3] >= FILE_BYTES:
                    yield finish(state)
                    state = None
        if state is not None:
            yield finish(state)

    def finish(state) -> pa.RecordBatch:
        state[0].write(state[2].flush())
        return pa.RecordBatch.from_pylist([{"file": state[1](), "records": state[4]}])

    spark, schema = pages.sparkSession, "file string, records long"
    with_originals(pages, min_bytes).mapInArrow(run, schema).write.parquet(f"{folder}/raw-manifest")
    return spark.read.schema(schema).parquet(f"{folder}/raw-manifest")


def normalise(manifest: DataFrame, folder: str, level: int = 6) -> DataFrame:
    """Rewrite each archive of `manifest` (column file) with one gzip member per record and a sidecar index
    `<archive>.idx` of tab-separated lines: offset, length, type, record id. Returns file, index, records."""
    def run(batches):
        for batch in batches:
            for uri in batch.column("file").to_pylist():
                fs, path = file_system(uri)
                out, close = write_file(f"{folder}/part-{uuid.uuid4().hex}.warc.gz")
                lines, offset = [], 0
                with fs.open_input_file(path) as stream:
                    for head, whole in records(inflate(stream)):
                        member = gzip.compress(whole, level, mtime=0)
                        out.write(member)
                        lines.append(f"{offset}\t{len(member)}\t{head['warc-type']}\t{head['warc-record-id']}\n")
                        offset += len(member)
                done = close()
                index, close_index = write_file(f"{done}.idx")
                index.write("".join(lines).encode())
                yield pa.RecordBatch.from_pylist([{"file": done, "index": close_index(), "records": len(lines)}])

    spark, schema = manifest.sparkSession, "file string, index string, records long"
    manifest.select("file").repartition(max(1, manifest.count()), "file").mapInArrow(run, schema).write.parquet(f"{folder}/manifest")
    return spark.read.schema(schema).parquet(f"{folder}/manifest")


def read_indexed(fs, path: str, index: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record that the index names, each inflated from its own offset."""
    with fs.open_input_file(path) as f:
        for line in index.decode().splitlines():
            offset, length, _, name = line.split("\t")
            whole = gzip.decompress(f.read_at(int(length), int(offset)))
            end = whole.index(b"\r\n\r\n")
            head = parse_head(whole[:end])
            if head["warc-record-id"] != name:
                raise ValueError(f"{path}: the index points to another record at {offset}")
            yield head, whole[end + 4:-4]


def read_warc(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to (and payload; null for a revisit).
    A response's digest is computed from its payload and must be the one the record states."""
    def run(batches):
        for batch in batches:
            for uri, index in zip(batch.column("file").to_pylist(), batch.column("index").to_pylist()):
                fs, path = file_system(uri)
                with fs.open_input_file(file_system(index)[1]) as f:
                    lines = f.read()
                rows, held = [], 0
                for head, block in read_indexed(fs, path, lines):
                    http, _, body = block.partition(b"\r\n\r\n")
                    stated = head["warc-payload-digest"].removeprefix("sha1:")
                    size = int(http.decode().rpartition("Content-Length:")[2])
                    revisit = head["warc-type"] == "revisit"
                    if not revisit and (base32(hashlib.sha1(body).digest()) != stated or len(body) != size):
                        raise ValueError(f"{uri}: {head['warc-record-id']} isn't what its header says")
                    row = {"page_id": page_of(head["warc-record-id"]), "url": head["warc-target-uri"], "payload_bytes": size,
                           "payload_digest": stated, "record_type": head["warc-type"], "refers_to": page_of(head.get("warc-refers-to"))}
                    rows.append(row | ({"payload": None if revisit else body} if with_payload else {}))
                    held += len(body) + 200
                    if held >= 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, arrow)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, arrow)

    fields = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
              ("record_type", pa.string()), ("refers_to", pa.int64())] + [("payload", pa.binary())] * with_payload
    arrow = pa.schema(fields)
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    return manifest.select("file", "index").repartition(max(1, manifest.count()), "file").mapInArrow(run, schema)


def archive(pages: DataFrame, min_bytes: int = 0, with_payload: bool = False) -> DataFrame:
    """Write, normalise and read back, in a new folder of the shared checkpoint folder."""
    folder = new_folder(pages.sparkSession, "warc")
    return read_warc(normalise(write_warc(pages, f"{folder}/raw", min_bytes=min_bytes), folder), with_payload)
