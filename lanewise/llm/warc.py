"""WARC archives: a writer that stores equal payloads once, and a sequential reader.

An archive is a file of gzip members, one for each record. The reader feeds
compressed bytes piece by piece to an incremental decompressor, starts anew at
each member's end, frames the block by Content-Length and checks the block and
payload digests; it holds one record at a time.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from io import BytesIO
from typing import BinaryIO

import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewise.llm.common import bit_filter, drop, held, may_hold, new_path, slot, small_batches, spread_join, text_or_empty, written
from lanewise.llm.files import opened, put

#: Bytes of an archive after which the next one begins, bytes read at once, the smallest payload that is stored once, and reading tasks at most.
ARCHIVE_BYTES, READ_BYTES, LEAST_PAYLOAD, MOST_READERS = 16 << 20, 1 << 16, 1000, 1 << 14
DATE = "2024-01-01T00:00:00Z"


@dataclass
class Record:
    """Header fields by lower-case name, the block, and the payload (the block after its HTTP header, if it has one)."""

    headers: dict[str, str]
    block: bytes
    payload: bytes


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str, payload: bytes, digest: bytes, size: int, refers_to: int | None) -> bytes:
    """A gzip member: response with the payload, or revisit with the HTTP header alone and what it refers to."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"), ("WARC-Date", DATE),
        ("WARC-Target-URI", " ".join(url.split())), ("WARC-Block-Digest", _digest(block)), ("WARC-Payload-Digest", "sha1:" + base64.b32encode(digest).decode()), ("X-Payload-Length", str(size)),
    ]
    if refers_to is not None:
        fields += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress(head.encode() + block + b"\r\n\r\n") + deflate.flush()


def _members(source: BinaryIO) -> Iterator[bytes]:
    """Each gzip member's bytes, decompressed a piece at a time."""
    rest = source.read(READ_BYTES)
    while rest:
        inflate, out = zlib.decompressobj(31), []
        while not inflate.eof:
            if not rest and not (rest := source.read(READ_BYTES)):
                raise ValueError("the archive ends within a gzip member")
            out.append(inflate.decompress(rest))
            rest = inflate.unused_data
        yield b"".join(out)
        rest = rest or source.read(READ_BYTES)


def read_records(source: BinaryIO) -> Iterator[Record]:
    """The records of an archive in their order; ValueError where framing or a digest is wrong."""
    for member in _members(source):
        head, found, body = member.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if not found or not lines[0].startswith("WARC/"):
            raise ValueError("a member does not begin with a WARC header")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        n = int(headers["content-length"])
        block = body[:n]
        if len(block) != n or body[n:] != b"\r\n\r\n":
            raise ValueError("Content-Length does not frame the block")
        if headers.get("warc-block-digest", _digest(block)) != _digest(block):
            raise ValueError("block digest")
        http = headers.get("content-type", "").startswith("application/http")
        payload = block.partition(b"\r\n\r\n")[2] if http else block
        if headers["warc-type"] == "response" and headers.get("warc-payload-digest", _digest(payload)) != _digest(payload):
            raise ValueError("payload digest")
        yield Record(headers, block, payload)


def _archiver(folder: str, sent: Broadcast, most: int):
    """Rows -> paths of the archives that hold them; a row whose slot the filter holds is not stored here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out, written_ = TaskContext.get().partitionId(), BytesIO(), []

        def close() -> None:
            nonlocal out
            # a name for each attempt at the task, so that what another one left behind is in no list
            put(name := f"{folder}/{part:06d}-{len(written_):06d}-{uuid.uuid4().hex}.warc.gz", out.getvalue())
            written_.append(name)
            out = BytesIO()

        for b in batches:
            b = b.filter(pa.array(~held(sent.value, b.column("slot"))))
            for row in b.to_pylist():
                out.write(record(row["page_id"], row["url"], row["payload"] or b"", bytes.fromhex(row["digest"]), row["bytes"], row["refers_to"]))
                if out.tell() >= most:
                    close()
        if out.tell():
            close()
        yield pa.RecordBatch.from_arrays([pa.array(written_, pa.string())], ["path"])

    return run


def write_archives(pages: DataFrame, folder: str | None = None, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives of pages(page_id, url, html, ...) in a folder of the shared store; a written table of their paths (path).

    Of rows with equal payloads of LEAST_PAYLOAD bytes or more, those with the
    largest page_id are responses and the others revisit it; rows with a null
    page_id count as smaller than any, and are responses where all are null;
    rows that share the largest page_id are responses all. A
    null html is an empty payload, a null url an empty one. An empty table
    makes no archive. Revisits are found from ids and digests alone, and their
    records carry no payload. Payloads aren't shuffled: a filter of bounded
    size keeps revisits out where pages are read, and the few others that it
    keeps out by accident are read once more.
    """
    spark = pages.sparkSession
    small_batches(spark)
    folder = folder or new_path(spark, "warc")
    payload = F.encode(text_or_empty("html"), "UTF-8")
    url = text_or_empty("url") if "url" in pages.columns else F.lit("")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("bytes", F.octet_length("payload").cast("long"))
    ids = written(rows.where(F.col("bytes") >= LEAST_PAYLOAD).drop("payload"), "ids")
    last = ids.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1 and refers_to is not null")
    found = spread_join(ids, last, "digest", "n", ids.count(), "page_id").where(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    revisits = written(found.select("page_id", "url", "digest", "bytes", "refers_to"), "revisits")
    key = slot("page_id", "digest")
    sent = bit_filter(revisits.select(key.alias("s")))
    same = lambda a, b: a["page_id"].eqNullSafe(b["page_id"]) & (a["digest"] == b["digest"])
    passed = ids.where(may_hold(sent, key)).select("page_id", "digest")
    mistaken = written(passed.join(revisits, same(passed, revisits), "left_anti").distinct(), "mistaken")
    none = F.lit(None).cast("long")
    columns = ("page_id", "url", "payload", "digest", "bytes")
    stored = rows.select(*columns, none.alias("refers_to"), F.when(F.col("bytes") >= LEAST_PAYLOAD, key).alias("slot"))
    if not mistaken.isEmpty():
        stored = stored.union(rows.join(mistaken, same(rows, mistaken), "left_semi").select(*columns, none, none))
    stored = stored.union(revisits.select("page_id", "url", F.lit(None).cast("binary"), "digest", "bytes", "refers_to", none))
    out = written(stored.mapInArrow(_archiver(folder, sent, archive_bytes), "path string"), "archives")
    drop(ids, revisits, mistaken)
    return out


def _id(urn: str) -> int | None:
    return int(x) if (x := urn.removeprefix("<urn:page:").removesuffix(">")) else None


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
    for b in batches:
        for path in b.column("path").to_pylist():
            rows = []
            with opened(path) as source:
                for r in read_records(source):
                    h = r.headers
                    response = h["warc-type"] == "response"
                    size = len(r.payload) if response else int(h["x-payload-length"])
                    digest = hashlib.sha1(r.payload).hexdigest() if response else base64.b32decode(h["warc-payload-digest"].removeprefix("sha1:")).hex()
                    rows.append((_id(h["warc-record-id"]), size, digest, h["warc-type"], None if response else _id(h["warc-refers-to"])))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def read_archives(archives: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record of archives(path), each read as a stream."""
    tasks = max(1, min(archives.count(), MOST_READERS))
    return archives.select("path").repartition(tasks).mapInArrow(_rows, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archived(pages: DataFrame) -> DataFrame:
    """Pages written to archives and read back: read_archives of them, one row for each row of pages."""
    return read_archives(write_archives(pages))
