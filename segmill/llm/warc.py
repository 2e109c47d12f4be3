"""WARC archives: written by tasks, indexed first, read back by byte ranges.

write_archives() writes a WARC/1.1 record per page, each a gzip member of its own, and returns the index: page_id, url,
file, offset, length, digest and record type of each record. read_records() takes any selection of index rows, sorts it
by file and offset, joins neighbours with small gaps to one range and reads each range once.

Of the pages with equal payloads of at least `min_bytes` bytes, the one with the largest page_id is a response and the
others are revisits that refer to it; smaller payloads are all responses. A task writes files under names of its own
attempt, and the index, which is written to the shared folder, names only files of tasks that ended, so a task that is
run again does no harm. Files are opened by their URI in the workers (local paths, HDFS and S3 as pyarrow knows them).

A record's id is made of page_id and digest where that is unique, so that revisits can name it; other records have a random
one. The page_id itself, and that of the response, are in fields of their own. Only rows whose payload may occur again are
shuffled; the others are told by a map of bits and written where they are read.

A null html is an empty payload, a null url leaves its header out. Rows with a null page_id are responses, referred to
by none unless all pages with their payload lack one too; then all of these are responses. Rows that repeat the largest page_id of a
payload are all responses; they have random ids, so their revisits name the page but no record. Extra columns are ignored; an
empty table gives an empty index.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmill.llm.common import lookup, materialise, may_be_in, new_folder, slices

#: Fixed values of the format.
VERSION, CRLF = b"WARC/1.1\r\n", b"\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = "page_id long, url string, file string, offset long, length long, digest string, record_type string"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
FILE_BYTES = 1 << 30
#: A range is at most so long, unless one record is longer, and skips gaps up to this.
RANGE_BYTES, GAP_BYTES = 8 << 20, 64 << 10
#: Bytes of records that a task reads, about, unless that makes more than MAX_TASKS.
TASK_BYTES, MAX_TASKS = 8 << 20, 50_000


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


#: Fields of this library's own.
PAGE, REFERS_TO_PAGE = "Page-ID", "Refers-To-Page-ID"


def page_uri(page_id: int, digest: str) -> str:
    return f"<urn:page:{page_id}:{digest}>"


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return VERSION + head.encode() + CRLF + block + CRLF + CRLF


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


@dataclass
class Page:
    page_id: int | None
    url: str | None
    payload: bytes
    refers_to: int | None
    is_revisit: bool
    #: Whether no other response has this page_id and payload; of a revisit, whether the one it refers to is such.
    is_named: bool


def page_record(page: Page, date: str) -> tuple[bytes, str]:
    """The record's bytes, and the payload's digest."""
    digest = sha1_base32(page.payload)
    own = page_uri(page.page_id, digest) if page.is_named and not page.is_revisit and page.page_id is not None else f"<urn:uuid:{uuid.uuid4()}>"
    headers = [("WARC-Type", "revisit" if page.is_revisit else "response"), ("WARC-Record-ID", own), ("WARC-Date", date), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if page.page_id is not None:
        headers.append((PAGE, str(page.page_id)))
    if page.url is not None:
        # a header is one line
        headers.append(("WARC-Target-URI", "".join(c if c >= " " else f"%{ord(c):02X}" for c in page.url)))
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(page.payload)}\r\n\r\n".encode()
    headers.append(("Content-Type", "application/http; msgtype=response"))
    if page.is_revisit:
        # as the profile says, a revisit keeps the HTTP header, whose Content-Length is that of the full payload
        headers += [("WARC-Profile", PROFILE), (REFERS_TO_PAGE, str(page.refers_to)), ("WARC-Truncated", "length")]
        if page.is_named:
            headers.append(("WARC-Refers-To", page_uri(page.refers_to, digest)))
        return _record(headers, head), digest
    return _record(headers, head + page.payload), digest


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers, by names in lower case, and block of an uncompressed record."""
    head, _, rest = data.partition(CRLF + CRLF)
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("no WARC record starts here")
    headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    return headers, rest[: int(headers["content-length"])]


class Writer:
    """Files of a folder, each begun with a warcinfo record and ended near FILE_BYTES."""

    def __init__(self, folder: str, name: str, date: str) -> None:
        self.folder, self.name, self.date, self.files, self.stream = folder, name, date, 0, None
        self.store, self.root = fs.FileSystem.from_uri(folder)
        self.store.create_dir(self.root, recursive=True)

    def add(self, record: bytes) -> tuple[str, int, int]:
        """File, offset and length."""
        if self.stream is not None and self.offset >= FILE_BYTES:
            self.close()
        if self.stream is None:
            self.file = f"{self.name}-{self.files}.warc.gz"
            self.files, self.offset = self.files + 1, 0
            self.stream = self.store.open_output_stream(f"{self.root}/{self.file}", compression=None)
            self._put(_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", self.date), ("WARC-Filename", self.file), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
        at = self.offset
        return f"{self.folder}/{self.file}", at, self._put(record)

    def _put(self, record: bytes) -> int:
        data = _gzip(record)
        self.stream.write(data)
        self.offset += len(data)
        return len(data)

    def close(self) -> None:
        if self.stream is not None:
            self.stream.close()
            self.stream = None


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """The index of the archives, written to the shared folder."""
    rows = pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.when(F.octet_length("html") >= min_bytes, F.sha1(F.encode("html", "UTF-8"))))
    # digests only: payloads that occur again, their largest page_id, and how many rows have it
    pairs = rows.where(F.col("digest").isNotNull()).groupBy("digest", "page_id").agg(F.count("*").alias("n"))
    again = pairs.groupBy("digest").agg(F.max("page_id").alias("largest"), F.sum("n").alias("n"), F.max_by("n", "page_id").alias("tops")).where("n > 1")
    again = materialise(again.select("digest", "n", "largest", (F.coalesce("tops", F.lit(2)) == 1).alias("named")), "digests")
    told = may_be_in(rows, again, "digest", "may_repeat")
    looked_up = lookup(told.where("may_repeat").drop("may_repeat"), again, "digest", "n", max(1, rows.count()))
    alone = told.where("not may_repeat").drop("may_repeat").withColumns({"largest": F.lit(None).cast("long"), "named": F.lit(None).cast("boolean")})
    is_revisit = F.coalesce(F.col("page_id") < F.col("largest"), F.lit(False))
    # without a digest, payloads may repeat unseen
    named = F.coalesce("named", F.col("digest").isNotNull())
    marked = looked_up.unionByName(alone).select("page_id", "url", "html", F.when(is_revisit, F.col("largest")).alias("refers_to"), is_revisit.alias("is_revisit"), named.alias("is_named"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = Writer(folder, f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}", date)
        for batch in slices(batches):
            index = []
            for page_id, url, html, refers_to, revisit, is_named in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                record, digest = page_record(Page(page_id, url, html.encode(), refers_to, revisit, is_named), date)
                index.append((page_id, url, *writer.add(record), digest, "revisit" if revisit else "response"))
            if index:
                columns = [pa.array(c, t) for c, t in zip(zip(*index, strict=True), (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "file", "offset", "length", "digest", "record_type"])
        writer.close()

    return materialise(marked.mapInArrow(write, INDEX), "index")


def read_ranges(rows: Iterator[tuple[str, int, int]]) -> Iterator[bytes]:
    """The stored bytes of records given by file, offset and length in this order, with one read for each range."""
    pending: list[tuple[int, int]] = []
    current, source = None, None

    def flush() -> Iterator[bytes]:
        if pending:
            start, end = pending[0][0], max(o + n for o, n in pending)
            data = source.read_at(end - start, start)
            for o, n in pending:
                yield data[o - start : o - start + n]
            pending.clear()

    for file, offset, length in rows:
        if file != current:
            yield from flush()
            if source is not None:
                source.close()
            store, path = fs.FileSystem.from_uri(file)
            current, source = file, store.open_input_file(path)
        elif pending and (offset - (pending[-1][0] + pending[-1][1]) > GAP_BYTES or offset + length - pending[0][0] > RANGE_BYTES):
            yield from flush()
        pending.append((offset, length))
    yield from flush()
    if source is not None:
        source.close()


def read_records(selected: DataFrame) -> DataFrame:
    """What the archives hold of the selected index rows; a payload that doesn't have its digest raises."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for stored in read_ranges(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                headers, block = parse_record(zlib.decompress(stored, 31))
                digest = headers["warc-payload-digest"].removeprefix("sha1:")
                head, _, payload = block.partition(CRLF + CRLF)
                size = int(head.rpartition(b"Content-Length: ")[2])
                if headers["warc-type"] == "response" and (len(payload) != size or sha1_base32(payload) != digest):
                    raise ValueError(f"record {headers['warc-record-id']} is damaged")
                page, refers = headers.get(PAGE.lower()), headers.get(REFERS_TO_PAGE.lower())
                out.append((page and int(page), headers.get("warc-target-uri"), size, digest, headers["warc-type"], refers and int(refers)))
            if out:
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    total = selected.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    per_task = max(TASK_BYTES, total // MAX_TASKS)
    # the number of tasks follows the archives' bytes; left to itself, Spark would follow those of the index
    n = max(1, -(-total // per_task))
    sought = selected.select("file", "offset", "length").withColumn("part", F.floor(F.col("offset") / per_task))
    sought = sought.repartition(n, "file", "part").sortWithinPartitions("file", "offset").drop("part")
    return sought.mapInArrow(read, RECORDS)


def archive_pages(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write all pages to a new folder and read every record back by the index."""
    return read_records(write_archives(pages, new_folder(pages.sparkSession, "warc"), min_bytes))
