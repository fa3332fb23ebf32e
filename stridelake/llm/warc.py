"""Operator 4: WARC archives: whole-file gzip streams normalised to one gzip member a record, with an offset index.

Archives are rows (archive, content), as spark.read.format("binaryFile") gives them too. The normaliser inflates each
stream once, piece by piece, holding one record; every record is written as its own member, and its offset, length, type
and id go to the index. Archives are cut at `archive_bytes` of records, so a row stays small.

Defined cases: html null is an empty payload; very long pages are written whole, in an archive of their own size; url null
is left out; a stream that ends within a gzip member or a record is an error (its last records would be lost in silence); page_id null never becomes what others refer to; rows
that repeat a page_id with an equal payload are responses when that page_id is the smallest; an empty table gives no rows; other columns of pages are not read and clash with nothing.
"""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridelake.llm.shared import written

INDEX = "array<struct<offset:long,length:long,type:string,id:string>>"
LEVEL = 3


def record(page_id, url, payload: bytes, sha256: str, first) -> bytes:
    kind = "response" if first is None or first == page_id else "revisit"
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>")]
    if url:
        head.append(("WARC-Target-URI", " ".join(url.split())))
    head += [("WARC-Payload-Digest", f"sha256:{sha256}"), ("X-Payload-Length", str(len(payload)))]
    if kind == "revisit":
        head += [("WARC-Refers-To", f"<urn:page:{first}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
        payload = b""
    head.append(("Content-Length", str(len(payload))))
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n").encode() + payload + b"\r\n\r\n"


def archives(pages: DataFrame, least: int = 100, archive_bytes: int = 4 << 20) -> DataFrame:
    """Archives (archive, content), each one gzip stream, of all pages; equal payloads are stored once."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    p = p.withColumn("sha256", F.sha2("payload", 256)).withColumn("n", F.octet_length("payload"))
    first = written(p.where(F.col("n") >= least).groupBy("sha256").agg(F.min("page_id").alias("first"), F.count("*").alias("m")).where("m > 1").select("sha256", "first"), "payloads")
    known = p.join(first, "sha256", "left")

    def run(batches):
        from pyspark import TaskContext

        task, part, z, held, out = TaskContext.get().partitionId(), 0, None, 0, []
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "sha256", "first"))):
                if z is None:
                    z, held, out = zlib.compressobj(LEVEL, zlib.DEFLATED, 31), 0, []
                data = record(*row)
                out.append(z.compress(data))
                held += len(data)
                if held >= archive_bytes:
                    yield pa.record_batch([pa.array([f"{task}-{part}"]), pa.array([b"".join(out) + z.flush()])], names=["archive", "content"])
                    part, z = part + 1, None
        if z is not None:
            yield pa.record_batch([pa.array([f"{task}-{part}"]), pa.array([b"".join(out) + z.flush()])], names=["archive", "content"])

    return written(known.select("page_id", "url", "payload", "sha256", "first").mapInArrow(run, "archive string, content binary"), "archives")


def inflate(content: bytes, step: int = 1 << 16):
    """Inflated pieces of a gzip stream of one member or several; an error where the stream ends within a member."""
    z, at, inside = zlib.decompressobj(31), 0, False
    while at < len(content):
        piece = content[at : at + step]
        at += len(piece)
        while piece:
            yield z.decompress(piece)
            piece, inside = z.unused_data, not z.eof
            if z.eof:
                z = zlib.decompressobj(31)
    if inside:
        raise ValueError("the gzip stream is cut short")


def records(pieces):
    """Whole records (head with its blank line, payload) from inflated pieces; an error where the last one is cut short."""
    held = bytearray()
    size = head = None
    for piece in pieces:
        held += piece
        while True:
            if size is None:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                head = bytes(held[: end + 4])
                size = int(fields(head).get("content-length", 0))
            total = len(head) + size + 4
            if len(held) < total:
                break
            yield head, bytes(held[len(head) : len(head) + size])
            del held[:total]
            size = None
    if held:
        raise ValueError("the last record is cut short")


def fields(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines if ":" in x)}


def normalise(streams: DataFrame) -> DataFrame:
    """archive, content (one member a record) and the index of each archive."""

    def run(batches):
        for b in batches:
            for name, content in zip(b.column("archive"), b.column("content")):
                out, index, at = [], [], 0
                for head, payload in records(inflate(content.as_py())):
                    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                    member = z.compress(head + payload + b"\r\n\r\n") + z.flush()
                    f = fields(head)
                    index.append({"offset": at, "length": len(member), "type": f["warc-type"], "id": f["warc-record-id"]})
                    out.append(member)
                    at += len(member)
                kind = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string()), ("id", pa.string())]))
                yield pa.record_batch([pa.array([name.as_py()]), pa.array([b"".join(out)], pa.binary()), pa.array([index], kind)], names=["archive", "content", "index"])

    return written(streams.mapInArrow(run, f"archive string, content binary, index {INDEX}"), "members")


def sidecar(normalised: DataFrame) -> DataFrame:
    """The offset index as a table: archive, offset, length, type, id."""
    return normalised.select("archive", F.inline("index"))


def read_back(normalised: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and payload, each record by its offset."""

    def run(batches):
        for b in batches:
            for content, index in zip(b.column("content"), b.column("index")):
                blob, rows = memoryview(content.as_buffer()), []
                for e in index.as_py():
                    data = zlib.decompress(blob[e["offset"] : e["offset"] + e["length"]], 31)
                    head, payload = next(records([data]))
                    f = fields(head)
                    number = lambda s: int(s[10:-1]) if s and s[10:-1] else None
                    sha = hashlib.sha256(payload).hexdigest() if f["warc-type"] == "response" else f["warc-payload-digest"].split(":")[1]
                    n = len(payload) if f["warc-type"] == "response" else int(f["x-payload-length"])
                    rows.append((number(f["warc-record-id"]), n, sha, f["warc-type"], number(f.get("warc-refers-to")), payload))
                cols = list(zip(*rows)) if rows else [[]] * 6
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])

    return normalised.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")
