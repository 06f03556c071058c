"""WARC archives in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each with whole WARC records. Two skippable frames end it: the
record index (JSON: record identifier, frame, offset in the frame, length) and, as the footer, the seek table of the
public seekable format (for each frame its compressed and its plain size). With them a record is read by seeking to one
frame. Bundles are written by tasks straight to the shared store under names of their own; only those of a task that
succeeded are in the index table, so a repeated task does no harm.
"""

from __future__ import annotations

import base64
import json
import posixpath
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotlens.llm.common import batch_of, column_bytes, column_list, map_arrow, prepared, table
from shotlens.session import materialise, shared_dir

#: Fixed values of the seekable format.
SKIPPABLE_INDEX, SKIPPABLE_SEEK, SEEK_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
FRAME_BYTES, BUNDLE_BYTES, LEVEL = 1 << 20, 256 << 20, 3
RECORD_ID = "urn:record:"
INDEX_SCHEMA = "record_id string, bundle string, frame long, frame_start long, frame_size long, offset long, length long"


def base32_sha1(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def warc_record(kind: str, record_id: str, uri: str | None, digest: str, payload: bytes, payload_bytes: int, refers_to: str | None = None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """A response with its payload, or a revisit with the HTTP head alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}"]
    if uri:
        head.append("WARC-Target-URI: " + " ".join(uri.split()))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if kind == "revisit":
        head += [f"WARC-Refers-To: <{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(record: bytes) -> dict:
    """Headers (lower-case names) under "headers", the payload under "payload" (of a revisit: None)."""
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError(f"not a WARC record: {version[:40]!r}")
    headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    block = rest[: int(headers["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    return {"headers": headers, "payload": payload if headers["warc-type"] == "response" else None, "payload_bytes": size}


class BundleWriter:
    """Append records; at close, the record index and the seek table follow the frames."""

    def __init__(self, stream, frame_bytes: int = FRAME_BYTES, level: int = LEVEL):
        self.stream, self.frame_bytes, self.zstd = stream, frame_bytes, zstandard.ZstdCompressor(level=level)
        self.frames: list[tuple[int, int]] = []
        self.entries: list[tuple[str, int, int, int]] = []
        self.pending, self.plain, self.size = [], 0, 0

    def add(self, record_id: str, record: bytes) -> None:
        if self.pending and self.plain + len(record) > self.frame_bytes:
            self.flush()
        self.entries.append((record_id, len(self.frames), self.plain, len(record)))
        self.pending.append(record)
        self.plain += len(record)

    def flush(self) -> None:
        if self.pending:
            packed = self.zstd.compress(b"".join(self.pending))
            self.stream.write(packed)
            self.frames.append((len(packed), self.plain))
            self.size += len(packed)
            self.pending, self.plain = [], 0

    def close(self) -> list[tuple[str, int, int, int, int, int]]:
        """(record id, frame, where the frame starts, its size, offset in the plain frame, length) of every record."""
        self.flush()
        index = self.zstd.compress(json.dumps(self.entries).encode())
        self.stream.write(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index)
        seek = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEK_MAGIC)
        self.stream.write(struct.pack("<II", SKIPPABLE_SEEK, len(seek)) + seek)
        starts, at = [], 0
        for packed, _ in self.frames:
            starts.append(at)
            at += packed
        return [(r, f, starts[f], self.frames[f][0], o, n) for r, f, o, n in self.entries]


def read_seek_table(stream, size: int) -> list[tuple[int, int, int]]:
    """(start, compressed size, plain size) of every frame, from the footer alone."""
    stream.seek(size - 9)
    n, _, magic = struct.unpack("<IBI", stream.read(9))
    if magic != SEEK_MAGIC:
        raise ValueError("no seek table")
    stream.seek(size - 9 - 8 * n)
    raw, at, out = stream.read(8 * n), 0, []
    for packed, plain in struct.iter_unpack("<II", raw):
        out.append((at, packed, plain))
        at += packed
    return out


def read_frame(stream, start: int, size: int, plain: int) -> bytes:
    stream.seek(start)
    return zstandard.ZstdDecompressor().decompress(stream.read(size), max_output_size=plain)


def mark_revisits(pages: DataFrame, min_bytes: int, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """id, url, payload, digest (hex) and the id that the record refers to (null for a response).

    The largest id of each payload is found by an aggregate, which is combined before its shuffle, and goes back by a
    join that Spark can split where one payload has very many copies."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload")).withColumn("digest", F.sha1("payload"))
    if min_bytes > 0:
        rows = rows.withColumn("share", F.when(F.length("payload") >= min_bytes, F.col("digest")))
    else:
        rows = rows.withColumn("share", F.col("digest"))
    first = rows.where("share is not null").groupBy("share").agg(F.max("id").alias("response_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    return rows.join(first, "share", "left").select("id", "url", "payload", "digest", F.when(~F.col("id").eqNullSafe(F.col("response_id")), F.col("response_id")).alias("refers_to"))


def write_archive(spark: SparkSession, pages: DataFrame, to: str, min_revisit_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Write a record of every row into bundles below `to`; returns the index table (INDEX_SCHEMA), which is stored.

    Of the rows with one payload of at least `min_revisit_bytes` bytes, that with the largest id becomes a response
    (all of them, if the row is repeated) and the others revisits of it. Null html is an empty payload; a null id makes
    a record without a number, a revisit if another row has its payload; a null URL leaves the target out; an empty
    table writes no bundle. `to` must be a path that all executors reach (file://, hdfs://, s3://, ...).
    """
    prepared(spark)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pafs.FileSystem.from_uri(to)
        store.create_dir(base, recursive=True)
        writer = stream = path = None

        def close() -> pa.RecordBatch:
            rows = writer.close()
            stream.close()
            rid, frame, start, size, offset, length = zip(*rows, strict=True)
            return batch_of(record_id=pa.array(rid), bundle=pa.array([path] * len(rows)), frame=pa.array(frame, pa.int64()), frame_start=pa.array(start, pa.int64()), frame_size=pa.array(size, pa.int64()), offset=pa.array(offset, pa.int64()), length=pa.array(length, pa.int64()))

        for b in batches:
            for i, url, payload, digest, ref in zip(*(column_list(b, c) for c in ("id", "url", "payload", "digest", "refers_to")), strict=True):
                if writer is None:
                    path = posixpath.join(base, f"bundle-{uuid.uuid4().hex}.warc.zst")
                    stream = store.open_output_stream(path, compression=None)
                    writer = BundleWriter(stream, frame_bytes)
                rid = RECORD_ID + ("" if i is None else str(i))
                writer.add(rid, warc_record("response" if ref is None else "revisit", rid, url, base32_sha1(digest), payload, len(payload), None if ref is None else f"{RECORD_ID}{ref}"))
                if writer.size >= bundle_bytes:
                    yield close()
                    writer = None
        if writer is not None:
            yield close()

    rows = mark_revisits(pages, min_revisit_bytes, id_col, url_col, html_col)
    return materialise(spark, map_arrow(rows, write, INDEX_SCHEMA), "warc-index")


def read_archive(spark: SparkSession, index: DataFrame, to: str, payload: bool = False) -> DataFrame:
    """The records of an index table, read back frame by frame: record_id, payload_bytes, payload_digest, record_type,
    refers_to (record id), and with `payload` the payload of responses. Each response's digest is checked."""
    prepared(spark)
    frames = index.groupBy("bundle", "frame", "frame_start", "frame_size").agg(F.sum("length").alias("plain"), F.collect_list(F.struct("offset", "length")).alias("records"))
    schema = "record_id string, payload_bytes long, payload_digest string, record_type string, refers_to string" + ", payload binary" * payload

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        store, _ = pafs.FileSystem.from_uri(to)
        for b in batches:
            for path, start, size, plain, records in zip(*(column_list(b, c) for c in ("bundle", "frame_start", "frame_size", "plain", "records")), strict=True):
                with store.open_input_file(path) as stream:
                    data = read_frame(stream, start, size, plain)
                out = []
                for at in records:
                    x = parse_record(data[at["offset"] : at["offset"] + at["length"]])
                    h, body = x["headers"], x["payload"]
                    digest = h["warc-payload-digest"].removeprefix("sha1:")
                    if body is not None and (base64.b32encode(hashlib.sha1(body).digest()).decode() != digest or len(body) != x["payload_bytes"]):
                        raise ValueError(f"damaged record {h['warc-record-id']} in {path}")
                    out.append((h["warc-record-id"][1:-1], x["payload_bytes"], digest, h["warc-type"], h["warc-refers-to"][1:-1] if "warc-refers-to" in h else None, *([body] if payload else [])))
                names = ["record_id", "payload_bytes", "payload_digest", "record_type", "refers_to", *(["payload"] if payload else [])]
                kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), *([pa.binary()] if payload else [])]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return map_arrow(frames, read, schema)


def record_number(col: str):
    return F.expr(f"try_cast(substr({col}, {len(RECORD_ID) + 1}) AS bigint)")


def op3_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    to = shared_dir(spark, "warc")
    index = write_archive(spark, table(spark, sf_dir, "pages"), to)
    back = read_archive(spark, index, to)
    return back.select(record_number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", record_number("refers_to").alias("refers_to"))


OP3_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages
), m AS (SELECT hex, max(page_id) AS response_id FROM p GROUP BY hex),
b AS (
  SELECT hex, list_aggregate(list_transform(range(40), lambda i: lpad(bin(strpos('0123456789abcdef', hex[i + 1]) - 1), 4, '0')), 'string_agg', '') AS bits, response_id FROM m
), d AS (
  SELECT hex, response_id, list_aggregate(list_transform(range(32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + CAST(
    16 * CAST(bits[5 * i + 1] AS int) + 8 * CAST(bits[5 * i + 2] AS int) + 4 * CAST(bits[5 * i + 3] AS int) + 2 * CAST(bits[5 * i + 4] AS int) + CAST(bits[5 * i + 5] AS int) AS int)]), 'string_agg', '') AS payload_digest
  FROM b
)
SELECT page_id, strlen(payload) AS payload_bytes, payload_digest, CASE WHEN page_id = response_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> response_id THEN response_id END AS refers_to
FROM p JOIN d USING (hex)
"""
