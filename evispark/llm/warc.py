"""WARC archives: a writer of one gzip member per record and a sequential reader.

Archives are written and read by the tasks as files of any store that pyarrow knows by URI (local and shared folders, HDFS,
S3, ...). A file gets a name of its own in each task attempt, and only files that finished attempts report are read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evispark.llm.durable import durable, shared_folder

CHUNK = 1 << 16
END = b"\r\n\r\n"
# Of the WARC 1.1 standard.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def clean_header(value: str) -> str:
    """Control characters would end the header; they are written as %XX."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(kind: str, headers: list[tuple[str, str]], block: bytes, level: int = 6) -> bytes:
    """One record as one gzip member."""
    lines = [("WARC-Type", kind), *headers, ("WARC-Block-Digest", "sha1:" + sha1_base32(block)), ("Content-Length", str(len(block)))]
    head = VERSION + b"\r\n" + b"".join(f"{k}: {clean_header(v)}\r\n".encode() for k, v in lines) + b"\r\n"
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(head) + packer.compress(block) + packer.compress(END) + packer.flush()


def page_record(page_id: object, url: str | None, payload: bytes | None, size: int, digest: str, first: object, date: str) -> bytes:
    """A response with its payload; or, where ``payload`` is None, a revisit of ``first`` without it. The block's HTTP
    header states the size of the full payload in both."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    name = "" if page_id is None else str(page_id)
    headers = [("WARC-Record-ID", f"<urn:x-page:{name}>"), ("WARC-Date", date)]
    if url is not None:
        headers.append(("WARC-Target-URI", url))
    headers += [("WARC-Payload-Digest", "sha1:" + digest), ("Content-Type", "application/http; msgtype=response")]
    if payload is None:
        return record("revisit", [*headers, ("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:x-page:{first}>")], http)
    return record("response", headers, http + payload)


def members(stream: BinaryIO) -> Iterator[bytes]:
    """The content of each gzip member, decompressed chunk by chunk as the stream is read; one member is held at a time."""
    data = stream.read(CHUNK)
    while data:
        unpacker, parts = zlib.decompressobj(31), []
        while not unpacker.eof:
            if not data:
                raise ValueError("the archive ends within a record")
            parts.append(unpacker.decompress(data))
            data = unpacker.unused_data if unpacker.eof else stream.read(CHUNK)
        yield b"".join(parts)
        data = data or stream.read(CHUNK)


def read_records(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of each record; its length must be what the record states, and its block's digest too."""
    for content in members(stream):
        head, gap, rest = content.partition(END)
        lines = head.split(b"\r\n")
        if not gap or not lines[0].startswith(b"WARC/"):
            raise ValueError("a gzip member does not begin with a WARC record")
        headers = {k.strip().lower().decode(): v.strip().decode() for k, _, v in (line.partition(b":") for line in lines[1:])}
        length = int(headers["content-length"])
        if len(rest) != length + len(END) or rest[length:] != END:
            raise ValueError(f"record {headers.get('warc-record-id')}: wrong content length")
        block = rest[:length]
        stated = headers.get("warc-block-digest")
        if stated is not None and stated != "sha1:" + sha1_base32(block):
            raise ValueError(f"record {headers.get('warc-record-id')}: wrong block digest")
        yield headers, block


def _page_name(urn: str) -> str | None:
    return urn.removeprefix("<urn:x-page:").removesuffix(">") or None


def parse_page(headers: dict[str, str], block: bytes) -> dict:
    """A page of a record: a response's payload must have the stated size and digest."""
    http, _, payload = block.partition(END)
    size = int(re.search(rb"(?im)^content-length:\s*(\d+)", http)[1])
    digest = headers["warc-payload-digest"].removeprefix("sha1:")
    if headers["warc-type"] == "response" and (len(payload) != size or sha1_base32(payload) != digest):
        raise ValueError(f"record {headers['warc-record-id']}: wrong payload")
    return {
        "page": _page_name(headers["warc-record-id"]), "url": headers.get("warc-target-uri"), "payload_bytes": size, "payload_digest": digest,
        "record_type": headers["warc-type"], "refers": _page_name(headers["warc-refers-to"]) if "warc-refers-to" in headers else None,
        "payload": payload if headers["warc-type"] == "response" else None,
    }


def write_archives(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, archive_bytes: int = 64 << 20, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes archives of about ``archive_bytes`` below ``folder`` (a URI) and returns (path, records).

    The payload is the html in UTF-8. Of rows with equal payloads of at least ``least_bytes`` those with the smallest id
    become a response, the others a revisit that refers to it; smaller payloads always become responses.

    A null html is an empty payload, a null url has no header. A null id has no name and is never the smallest, but where
    all are null each is a response. Rows that repeat id and payload are written as often as they occur. An empty table
    writes no archive; other columns are not looked at. Control characters in a url become %XX.
    """
    body = F.encode(F.coalesce(F.col(html_col), F.lit("")), "utf-8")
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), body.alias("_body"), F.sha1(body).alias("_sha"))
    small = rows.select("_id", "_sha", F.octet_length("_body").alias("_n")).filter(F.col("_n") >= least_bytes)
    firsts = durable(small.groupBy("_sha").agg(F.min("_id").alias("_first"), F.count("*").alias("_many")).filter("_many > 1 AND _first IS NOT NULL"))
    again = small.join(firsts, "_sha").filter(~F.col("_id").eqNullSafe(F.col("_first"))).select(F.col("_id").alias("_page"), F.col("_sha").alias("_same"), "_first").distinct()
    ready = rows.join(again, (F.col("_sha") == F.col("_same")) & F.col("_id").eqNullSafe(F.col("_page")), "left").select(
        F.col("_id").cast("string").alias("_id"), "_url", F.when(F.col("_same").isNull(), F.col("_body")).alias("_body"),
        F.octet_length("_body").alias("_n"), "_sha", F.col("_first").cast("string").alias("_first"),
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out, path, size, count, files = None, "", 0, 0, 0
        done: list[tuple[str, int]] = []
        for batch in batches:
            for page, url, payload, n, sha, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    path = f"{root}/pages-{context.partitionId():06d}-{context.taskAttemptId()}-{files:04d}.warc.gz"
                    out, size, count, files = store.open_output_stream(path, compression=None), 0, 0, files + 1
                    size += out.write(record("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
                digest = base64.b32encode(bytes.fromhex(sha)).decode()
                size += out.write(page_record(page, url, payload, n, digest, first, date))
                count += 1
                if size >= archive_bytes:
                    out.close()
                    done, out = [*done, (path, count)], None
        if out is not None:
            out.close()
            done.append((path, count))
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([c for _, c in done], pa.int64())], names=["path", "records"])

    return durable(ready.mapInArrow(write, "path string, records long"))


def read_archives(archives: DataFrame, folder: str, *, payloads: bool = False) -> DataFrame:
    """Pages of the archives that the column ``path`` names, one archive to a task at a time: page, url, payload_bytes,
    payload_digest, record_type, refers, and the payload of responses if ``payloads``. A damaged record raises."""
    names = ["page", "url", "payload_bytes", "payload_digest", "record_type", "refers"] + ["payload"] * payloads
    kinds = {"payload_bytes": pa.int64(), "payload": pa.binary()}
    schema = pa.schema([(c, kinds.get(c, pa.string())) for c in names])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, held = [], 0
                with store.open_input_stream(path, compression=None) as stream:
                    for headers, block in read_records(stream):
                        if headers["warc-type"] in ("response", "revisit"):
                            page = parse_page(headers, block)
                            rows.append({c: page[c] for c in names})
                            held += 200 + payloads * page["payload_bytes"]
                            if held > 8 << 20:
                                yield pa.RecordBatch.from_pylist(rows, schema)
                                rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    fields = "page string, url string, payload_bytes long, payload_digest string, record_type string, refers string" + ", payload binary" * payloads
    dealt = archives.select("path").repartition(max(1, archives.count()))
    return dealt.mapInArrow(read, fields)


def round_trip(pages: DataFrame, *, id_col: str = "page_id", folder: str | None = None, **options) -> DataFrame:
    """Writes the pages and reads them back: id_col, payload_bytes, payload_digest, record_type, refers_to and url."""
    spark: SparkSession = pages.sparkSession
    folder = folder or f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    if "://" not in folder and not folder.startswith("file:"):
        folder = f"file://{folder}"
    kind = pages.schema[id_col].dataType
    found = read_archives(write_archives(pages, folder, id_col=id_col, **options), folder)
    return found.select(
        F.col("page").cast(kind).alias(id_col), "payload_bytes", "payload_digest", "record_type", F.col("refers").cast(kind).alias("refers_to"), "url"
    )
