"""Operator 6, WARC: archives written by tasks and a splittable reader.

Writer: every task streams gzip members, one a record, into a file of its own in the shared
folder and returns a manifest row (path, bytes, records). Only rows of attempts that
succeeded reach the manifest, so files of lost attempts are never read.

Reader: archives are cut into byte ranges. A task scans its range for the gzip magic number,
validates a candidate by inflating its first bytes and checking for a WARC header, and from
the first valid member on reads member after member; it owns the records that start inside
the range and reads past its end only to finish the last of them.

Revisits: of equal payloads of ``least`` bytes or more the row with the smallest id is the
response and the others are revisit records without payload. The digest counts are
aggregated before their shuffle and the join back is by digest, whose hot keys AQE splits.

Defined cases: null html is an empty payload; a null URL writes no target header; a null id
is written as an empty one and read back as null, never as the response while another row has an
id; rows that repeat the response's id are responses too; an empty table writes nothing.
Paths are opened by pyarrow's file systems (file, hdfs, s3), as executors see them.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_dir, materialize

SPLIT_BYTES = 8 << 20
#: Tasks of a read at most; beyond that a task reads several ranges.
MOST_TASKS = 100_000
MAGIC = b"\x1f\x8b\x08"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def opened(path: str):
    """(file system, path in it); a path without a scheme is local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def member(record_id: str, url: str | None, payload: bytes, refers_to: str | None) -> bytes:
    """One record as a gzip member."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:x-page:{record_id}>", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0) -> DataFrame:
    """Write one record per row; the manifest (path, bytes, records) of the archives."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    shared = rows.where(F.octet_length("html") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    ready = rows.join(shared, "digest", "left").select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size, records, path = None, 0, 0, ""
        for batch in batches:
            for page, url, html, refers in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    where = f"{folder}/part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
                    system, path = opened(where)
                    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
                    out = system.open_output_stream(path, compression=None)
                data = member("" if page is None else str(page), url, html.encode("utf-8", "surrogatepass"), None if refers is None else str(refers))
                out.write(data)
                size += len(data)
                records += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [where], "bytes": [size], "records": [records]})

    return materialize(ready.mapInArrow(run, "path string, bytes long, records long"), "manifest")


class Range:
    """A byte range of an archive and what follows, read in blocks as far as needed."""

    def __init__(self, file, start: int, end: int, size: int, block: int = 1 << 20):
        self.file, self.end, self.size, self.block = file, end, size, block
        self.at, self.data = start, b""  # data begins at byte ``at``
        file.seek(start)

    def more(self) -> bool:
        got = self.file.read(min(self.block, self.size - self.at - len(self.data)))
        self.data += got
        return bool(got)

    def drop(self, n: int) -> None:
        self.data, self.at = self.data[n:], self.at + n


def heads(data: bytes) -> bool:
    """Whether a gzip member that begins here holds a WARC record."""
    try:
        return zlib.decompressobj(31).decompress(data[:4096], 8).startswith(b"WARC/1.")
    except zlib.error:
        return False


def records(r: Range) -> Iterator[bytes]:
    """The records that start inside the range."""
    while True:  # the first valid member
        i = r.data.find(MAGIC)
        if i < 0:
            r.drop(max(0, len(r.data) - 2))
            if r.at + len(r.data) >= r.end + 2 or not r.more():
                return
            continue
        r.drop(i)
        while len(r.data) < 4096 and r.more():
            pass
        if r.at >= r.end:
            return
        if heads(r.data):
            break
        r.drop(1)
    while r.at < r.end and (r.data or r.more()):
        z, parts = zlib.decompressobj(31), []
        while not z.eof:
            if not r.data and not r.more():
                raise ValueError(f"archive ends inside the record at byte {r.at}")
            parts.append(z.decompress(r.data))
            r.drop(len(r.data) - len(z.unused_data))
        yield b"".join(parts)


def parsed(record: bytes) -> tuple:
    """(record_id, type, uri, digest, payload bytes, refers_to, payload) of a record."""
    head, _, block = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = block[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    named = lambda key: re.sub(r"^<urn:x-page:|>$", "", fields[key]) if key in fields else None
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
    if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        raise ValueError(f"payload of {fields['WARC-Record-ID']} doesn't match its digest")
    length = int(re.search(rb"(?im)^Content-Length: (\d+)", http)[1])
    return named("WARC-Record-ID"), kind, fields.get("WARC-Target-URI"), digest, length, named("WARC-Refers-To"), payload if kind == "response" else None


def read_warc(spark: SparkSession, manifest: DataFrame, split_bytes: int = SPLIT_BYTES, with_payload: bool = True) -> DataFrame:
    """Records of the archives in ``manifest`` (path, bytes), cut into ranges of ``split_bytes``."""
    names = ["record_id", "record_type", "uri", "payload_digest", "payload_bytes", "refers_to", *["payload"] * with_payload]
    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    schema = "record_id string, record_type string, uri string, payload_digest string, payload_bytes long, refers_to string" + ", payload binary" * with_payload
    splits = manifest.where("bytes > 0").select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    # A given number of tasks: by size alone AQE would put these tiny rows, which stand for much reading, into one.
    tasks = manifest.where("bytes > 0").agg(F.sum(F.ceil(F.col("bytes") / split_bytes))).first()[0] or 1
    dealt = splits.repartition(min(int(tasks), MOST_TASKS), F.col("path"), F.col("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, start in zip(*(c.to_pylist() for c in batch.columns)):
                system, inner = opened(path)
                rows, held = [], 0
                with system.open_input_file(inner) as file:
                    for record in records(Range(file, start, min(size, start + split_bytes), size)):
                        rows.append(parsed(record)[: len(names)])
                        held += len(record)
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return dealt.mapInArrow(run, schema)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0) -> DataFrame:
    """Write ``pages`` as archives and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    manifest = write_warc(pages, fresh_dir(spark, "warc"), id_col, url_col, html_col, least)
    back = read_warc(spark, manifest, with_payload=False)
    number = lambda c: F.when(F.col(c) != "", F.col(c).cast("long"))
    return back.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))
