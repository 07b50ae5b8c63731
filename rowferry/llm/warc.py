"""WARC archives with a two-level capture index.

Pages become gzip members of archive files, one record each; pages with equal
payloads share one response that the others revisit. Captures sorted by
reversed-host URL key are stored in compressed blocks, and a sparse directory
keeps the first key of each block. A lookup finds its block in the directory,
its line in the block by binary search, and reads one range of an archive.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import uuid
import zlib
from typing import NamedTuple
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowferry.llm.files import create, open_input
from rowferry.llm.words import groups
from rowferry.session import scratch_path

#: Capture lines in a compressed block of the index.
BLOCK_LINES = 1000
#: An archive is closed from this size.
ARCHIVE_BYTES = 1 << 30
_DATE = "1970-01-01T00:00:00Z"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CAPTURE = "key string, page_id long, file string, offset long, length long"
_DIRECTORY = "first_key string, last_key string, file string, offset long, length long, lines long"
_RECORD = ("page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
           "refers_to long, payload binary")


class CaptureIndex(NamedTuple):
    """Archives below ``folder`` and the directory of their captures."""

    folder: str
    directory: DataFrame


def url_key(url: str | None) -> str:
    """Sort key of a URL: reversed host, port, path and query, without scheme, ``www`` and fragment."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return quote(url, safe="/:?&=%")
    if host.startswith("www."):
        host = host[4:]
    port = f":{port}" if port and port not in (80, 443) else ""
    rest = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return quote(",".join(reversed(host.split("."))) + port + ")" + rest, safe="/:?&=%,)+;@!$'*~-._")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(text: str) -> str:
    return "".join(c if c >= " " and c != "\x7f" else quote(c) for c in text)


def _member(page_id, url, payload: bytes, refers_to) -> bytes:
    digest, revisit = payload_digest(payload), refers_to is not None
    # The length is that of the full payload for a revisit too, whose block has no payload.
    block = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
             ).encode() + (b"" if revisit else payload)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
            f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {_DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_line(url)}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        head += [f"WARC-Profile: {_REVISIT}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def _headers(lines: bytes) -> dict[str, str]:
    return dict(x.split(": ", 1) for x in lines.decode().split("\r\n")[1:] if ": " in x)


def parse(member: bytes) -> dict:
    """The record in one gzip member, checked against its own lengths and digest."""
    head, _, rest = zlib.decompress(member, 31).partition(b"\r\n\r\n")
    warc = _headers(head)
    block = rest[:int(warc["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(_headers(http)["Content-Length"])
    digest = warc["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = warc["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != size or payload_digest(payload) != digest):
        raise ValueError(f"damaged record {warc['WARC-Record-ID']}")
    page = warc["WARC-Record-ID"][len("<urn:page:"):-1]
    return {"page_id": int(page) if page else None, "url": warc.get("WARC-Target-URI"), "payload_bytes": size,
            "payload_digest": digest, "record_type": warc["WARC-Type"],
            "refers_to": int(warc["WARC-Refers-To"][len("<urn:page:"):-1]) if revisit else None,
            "payload": None if revisit else payload}


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url",
                   html_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Write a record per page below ``folder``; returns the captures, one row per record.

    Pages with equal payloads of at least ``min_bytes`` revisit the one with the
    largest id. Null html is an empty payload. Rows that repeat the largest id
    are responses all; a null id never refers and is not referred to, such rows
    revisit if another page has an id. A null url has an empty key. Other
    columns are not read. Every attempt of a task writes a file of its own name,
    and only files of attempts that Spark accepted are in the captures.
    """
    rows = pages.select(
        pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"),
        F.coalesce(pages[html_col].cast("string"), F.lit("")).alias("html")).withColumn(
        "same", F.when(F.octet_length("html") >= min_bytes, F.sha1(F.col("html").cast("binary"))))
    first = rows.where("same is not null").groupBy("same").agg(
        F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n")).where(
        "n > 1 and keeper is not null").drop("n")
    marked = rows.join(first, "same", "left").select(
        "page_id", "url", "html",
        F.when(~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper")).alias("refers_to"))

    def run(batches):
        out = None
        for batch in batches:
            for part in groups(batch, 2):
                captures = []
                for page in part.to_pylist():
                    if out is None:
                        name = f"{folder}/archive/{uuid.uuid4().hex}.warc.gz"
                        out, offset = create(name), 0
                    member = _member(page["page_id"], page["url"], page["html"].encode(), page["refers_to"])
                    out.write(member)
                    captures.append((url_key(page["url"]), page["page_id"], name, offset, len(member)))
                    offset += len(member)
                    if offset >= ARCHIVE_BYTES:
                        out.close()
                        out = None
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(zip(*captures, strict=True), (
                        pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)],
                    ["key", "page_id", "file", "offset", "length"])
        if out is not None:
            out.close()

    captures = marked.mapInArrow(run, _CAPTURE)
    captures.write.parquet(f"{folder}/captures")
    return pages.sparkSession.read.schema(captures.schema).parquet(f"{folder}/captures")


def build_index(captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> CaptureIndex:
    """Sort captures by key into compressed blocks and write their directory."""
    spark = captures.sparkSession

    def run(batches):
        out, offset, lines, rows = None, 0, [], []
        name = f"{folder}/index/{uuid.uuid4().hex}.gz"

        def shut():
            nonlocal out, offset
            if lines:
                if out is None:
                    out = create(name)
                member = gzip.compress("\n".join(lines).encode(), 6, mtime=0)
                out.write(member)
                rows.append((lines[0].split("\t", 1)[0], lines[-1].split("\t", 1)[0], name, offset, len(member),
                             len(lines)))
                offset += len(member)
                lines.clear()

        for batch in batches:
            for c in batch.to_pylist():
                page = "" if c["page_id"] is None else c["page_id"]
                lines.append(f"{c['key']}\t{page}\t{c['file']}\t{c['offset']}\t{c['length']}")
                if len(lines) == block_lines:
                    shut()
        shut()
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (
                    pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                ["first_key", "last_key", "file", "offset", "length", "lines"])

    # Page ids spread equal keys over partitions.
    ordered = captures.repartitionByRange("key", "page_id", "file", "offset").sortWithinPartitions(
        "key", "page_id", "file", "offset")
    directory = ordered.mapInArrow(run, _DIRECTORY)
    directory.write.parquet(f"{folder}/directory")
    return CaptureIndex(folder, spark.read.schema(directory.schema).parquet(f"{folder}/directory"))


def _block(row: dict) -> list[list[str]]:
    with open_input(row["file"]) as f:
        data = f.read_at(row["length"], row["offset"])
    return [x.split("\t") for x in zlib.decompress(data, 31).decode().split("\n")]


def read_all(index: CaptureIndex) -> DataFrame:
    """Every record, through the index: blocks are read by their ranges, then the archives by the captures'."""
    blocks = index.directory

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                by_file: dict[str, list[tuple[int, int]]] = {}
                for _, _, name, offset, length in _block(row):
                    by_file.setdefault(name, []).append((int(offset), int(length)))
                for name, ranges in by_file.items():
                    out, size = [], 0
                    with open_input(name) as f:
                        for offset, length in sorted(ranges):
                            out.append(parse(f.read_at(length, offset)))
                            size += out[-1]["payload_bytes"]
                            if size > 4 << 20:
                                yield _batch(out)
                                out, size = [], 0
                    if out:
                        yield _batch(out)

    parallel = max(1, blocks.sparkSession.sparkContext.defaultParallelism)
    return blocks.repartition(parallel * 4).mapInArrow(run, _RECORD)


def _batch(records: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(records, pa.schema([
        ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
        ("payload", pa.binary())]))


def lookup(index: CaptureIndex, url: str) -> list[dict]:
    """All records of one URL: directory, block, line by binary search, then one range of an archive each."""
    key = url_key(url)
    found = []
    hit = index.directory.where((F.col("first_key") <= key) & (F.col("last_key") >= key))
    for row in hit.orderBy("first_key", "file", "offset").toLocalIterator():
        lines = _block(row.asDict())
        at = bisect.bisect_left(lines, key, key=lambda x: x[0])
        while at < len(lines) and lines[at][0] == key:
            with open_input(lines[at][2]) as f:
                found.append(parse(f.read_at(int(lines[at][4]), int(lines[at][3]))))
            at += 1
    return found


def archive(spark: SparkSession, pages: DataFrame, folder: str | None = None, **columns) -> CaptureIndex:
    """Archives and index of ``pages``, by default in the session's shared folder."""
    folder = folder or scratch_path(spark, "warc")
    return build_index(write_archives(pages, folder, **columns), folder)
