"""WARC archives: one gzip member per record, written and read as a sequence.

Each row becomes one record in a gzip member of its own, and Spark's text writer puts the
members of a task one behind the other.  That writer ends each row with a separator; here
it is the zero byte that nearly every member ends with anyway (the high byte of its
length), so a file is exactly its members.  A member that ends otherwise is followed by an
empty one, which ends so.  Files thus appear by Spark's commit protocol, on any file
system, and a lost task leaves nothing behind.

Pages with equal payloads of at least ``REVISIT_BYTES`` are stored once: the largest page
id is the response and the others are revisits that name it.

Defined cases: a null html is an empty payload; a null url is an empty target; a page with
a null id is always a response, and none revisits it; rows that repeat the id of the
response are responses too; an empty table makes an archive without records.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.llm.common import slices

#: Payloads of fewer bytes are always stored.
REVISIT_BYTES = 1000
#: Payload bytes that share an archive file, about.
FILE_BYTES = 48 << 20
#: A payload with this share of all rows or more is joined as a hot one; there are at most as many as its inverse.
HOT_SHARE = 1 / 1000
DATE = "2024-01-01T00:00:00Z"
_EMPTY = zlib.compress(b"", 9, 31)
_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "page-record").bytes[:8]


def record_id(page_id: int | None) -> str:
    """A record's name; it holds the page id in its low half, and none for an unknown page."""
    if page_id is None:
        return "<urn:uuid:00000000-0000-0000-0000-000000000000>"
    return f"<urn:uuid:{uuid.UUID(bytes=_SPACE + struct.pack('>q', page_id))}>"


def page_of(name: str) -> int | None:
    raw = uuid.UUID(name.strip("<>").removeprefix("urn:uuid:")).bytes
    return struct.unpack(">q", raw[8:])[0] if raw[:8] == _SPACE else None


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def build_record(page_id: int | None, url: str, payload: bytes, digest: str, target: int | None) -> bytes:
    """The bytes of one record; ``target`` makes it a revisit of that page's record."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (b"" if target is not None else payload)
    name = "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()
    headers = [
        "WARC/1.1", f"WARC-Type: {'response' if target is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {DATE}", f"WARC-Target-URI: {' '.join(url.split())}", f"WARC-Payload-Digest: {name}",
        f"WARC-Block-Digest: {_digest(block)}",
    ]
    if target is not None:
        headers += [
            f"WARC-Refers-To: {record_id(target)}",
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        ]
    headers += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(headers).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(record: bytes) -> bytes:
    """A gzip member (or two) without the zero byte at its end."""
    packed = zlib.compress(record, 6, 31)
    return (packed if packed[-1] == 0 else packed + _EMPTY)[:-1]


def revisit_targets(pages: DataFrame, total: int, parts: int) -> DataFrame:
    """(page_id, url, payload, payload_bytes, sha1, target): the page that each row's payload
    is stored with, or null.

    Digests are grouped and counted first inside tasks.  Payloads with a large share of the
    ``total`` rows are few by construction and are joined by broadcast; the others by key, in
    ``parts`` partitions, among which rows that cannot match are dealt by their page.
    """
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).select("page_id", "url", "payload", F.length("payload").cast("bigint").alias("payload_bytes"), F.sha1("payload").alias("sha1"))
    eligible = (F.col("payload_bytes") >= REVISIT_BYTES) & F.col("page_id").isNotNull()
    groups = (
        rows.where(eligible).groupBy("sha1", "payload_bytes").agg(F.max("page_id").alias("target"), F.count("*").alias("n")).where("n > 1")
    )
    hot = F.col("n") >= max(2.0, total * HOT_SHARE)
    often = groups.where(hot).select(F.col("sha1").alias("key"), F.col("payload_bytes").alias("size"), F.col("target").alias("often"))
    seldom = groups.where(~hot).select(F.col("sha1").alias("key"), F.col("payload_bytes").alias("size"), F.col("target").alias("seldom"))
    rows = rows.withColumn("key", F.when(eligible, F.col("sha1"))).withColumn("size", F.col("payload_bytes"))
    rows = rows.join(F.broadcast(often), ["key", "size"], "left")
    alone = F.col("key").isNull() | F.col("often").isNotNull()
    rows = rows.withColumn("key", F.when(alone, F.xxhash64("page_id", "url").cast("string")).otherwise(F.col("key")))
    target = F.coalesce("often", "seldom")
    # The one exchange of payloads: it serves the join and sizes the files.
    rows = rows.repartition(parts, "key", "size")
    return rows.join(seldom, ["key", "size"], "left").select(
        "page_id", "url", "payload", "payload_bytes", "sha1", F.when(target != F.col("page_id"), target).alias("target")
    )


def write_archives(pages: DataFrame, path: str) -> None:
    """Write a record per row to ``path``, in files of about ``FILE_BYTES`` of payload."""
    total, volume = pages.agg(F.count("*"), F.sum(F.octet_length(F.col("html").cast("string")).cast("bigint"))).first()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "payload"):
            columns = (part.column(c).to_pylist() for c in ("page_id", "url", "payload", "sha1", "target"))
            yield pa.record_batch([pa.array([member(build_record(*row)) for row in zip(*columns)], pa.binary())], ["record"])

    files = max(1, -(-(volume or 0) // FILE_BYTES))
    rows = revisit_targets(pages, total, files).select("page_id", "url", "payload", "sha1", "target")
    records = rows.mapInArrow(run, "record binary")
    records.select(F.col("record").cast("string")).write.option("lineSep", "\0").option("compression", "none").text(path)


class FormatError(ValueError):
    """An archive that does not hold what its headers say."""


def members(data: memoryview, step: int = 1 << 16) -> Iterator[bytes]:
    """The content of each gzip member, decompressed piece by piece; empty ones are passed over."""
    at = 0
    while at < len(data):
        unpack, parts = zlib.decompressobj(31), []
        while not unpack.eof:
            if at >= len(data):
                raise FormatError("the last member is cut short")
            chunk = data[at : at + step]
            parts.append(unpack.decompress(chunk))
            at += len(chunk) - len(unpack.unused_data)
        if record := b"".join(parts):
            yield record


def parse_record(record: bytes) -> dict:
    """Headers and payload of a record, framed by Content-Length and checked against its digests."""
    head, found, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not found or not lines[0].startswith("WARC/"):
        raise FormatError("no record begins here")
    headers = {name.lower(): value for name, _, value in (line.partition(": ") for line in lines[1:])}
    length = int(headers["content-length"])
    block = rest[:length]
    if len(block) != length or rest[length:] != b"\r\n\r\n":
        raise FormatError("the record does not have the length it names")
    if _digest(block) != headers["warc-block-digest"]:
        raise FormatError("the block does not have the digest it names")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(line[15:]) for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:"))
    if headers["warc-type"] == "response":
        if len(payload) != size:
            raise FormatError("the payload does not have the length it names")
        if _digest(payload) != headers["warc-payload-digest"]:
            raise FormatError("the payload does not have the digest it names")
    return {
        "page_id": page_of(headers["warc-record-id"]), "url": headers["warc-target-uri"], "payload_bytes": size,
        "payload_digest": base64.b32decode(headers["warc-payload-digest"].removeprefix("sha1:")).hex(),
        "record_type": headers["warc-type"],
        "refers_to": page_of(headers["warc-refers-to"]) if "warc-refers-to" in headers else None,
        "payload": payload,
    }


def read_archives(spark, path: str, payload: bool = True) -> DataFrame:
    """One row per record of all archive files under ``path``, in any order."""
    fields = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * payload
    kinds = dict(
        page_id=pa.int64(), url=pa.string(), payload_bytes=pa.int64(), payload_digest=pa.string(),
        record_type=pa.string(), refers_to=pa.int64(), payload=pa.binary(),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows):
            return pa.record_batch([pa.array([r[f] for r in rows], kinds[f]) for f in fields], fields)

        for files in batches:
            for content in files.column("content"):
                rows, size = [], 0
                for record in members(memoryview(content.as_buffer())):
                    rows.append(parse_record(record))
                    size += len(record)
                    if size >= 4 << 20:
                        yield batch(rows)
                        rows, size = [], 0
                yield batch(rows)

    names = dict(page_id="bigint", url="string", payload_bytes="bigint", payload_digest="string", record_type="string", refers_to="bigint", payload="binary")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(run, ", ".join(f"{f} {names[f]}" for f in fields))
